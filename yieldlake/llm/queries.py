"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldlake.llm import (chat, fingerprints, hosts, language_id, line_dedup, mixing, ngram_join, quality_votes,
                           ranked_search, sentence_pieces, spelling_groups, vector_forest, warc)
from yieldlake.llm.registry import query, table

@query()
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT k, sum(size)::BIGINT AS source_size, count(*) AS documents FROM sized GROUP BY k),
ranked AS (SELECT *, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS weight, 3 * source_size AS cap FROM totals),
filled AS (
  SELECT *, cap / weight AS ratio,
         sum(cap) OVER (ORDER BY cap / weight, k) - cap AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, k) - weight AS weight_before,
         sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM ranked),
leveled AS (
  SELECT *, (all_size - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM filled),
share AS (SELECT arg_min(level, (ratio, k)) AS share FROM leveled WHERE level <= ratio),
targets AS (
  SELECT k, source_size, documents, least(cap::DOUBLE, coalesce(share, 0.0::DOUBLE) * weight) AS target
  FROM leveled CROSS JOIN share),
means AS (
  SELECT t.k, round(sum((size / (size + source_size / documents)) * size) / any_value(source_size), 9) AS mean_preference
  FROM sized JOIN targets t USING (k) WHERE source_size > 0 GROUP BY t.k),
plan AS (
  SELECT t.*, mean_preference,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         target - whole * source_size AS rest, rest / source_size AS share
  FROM targets t LEFT JOIN means USING (k)),
drawn AS (
  SELECT doc_id, s.k, size, source_size, target, whole, rest,
         ((('0x' || substr(md5('17|' || doc_id), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u,
         CASE WHEN source_size > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
           share + least(share, 1 - share) * (size / (size + source_size / documents) - mean_preference))) END AS p
  FROM sized s JOIN plan USING (k)),
odds AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM drawn),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY k ORDER BY q, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM odds WHERE q IS NOT NULL),
cuts AS (
  SELECT k, arg_min(upto, (abs(upto - rest), upto)) AS cut FROM (
    SELECT k, upto, rest FROM running
    UNION ALL SELECT k, 0, any_value(rest) FROM running GROUP BY k) GROUP BY k)
SELECT o.doc_id, o.size, o.source_size, o.target,
       ((o.whole + CASE WHEN r.upto <= c.cut AND c.cut > 0 THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM odds o LEFT JOIN running r ON r.doc_id = o.doc_id AND r.k = o.k LEFT JOIN cuts c ON c.k = o.k
"""


@query(MIX_SQL)
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

HOSTS_SQL = r"""
WITH parsed AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(nullif(regexp_extract(url, '/([0-9]+)[^/0-9]*[^/]*$', 1), '') AS BIGINT) AS doc_id
  FROM parsed),
outcome AS (
  SELECT p.host, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END AS bad
  FROM parts p JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL OR l.quality IS NOT NULL),
counted AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcome GROUP BY host),
known AS (
  SELECT h.host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, split(h.host, '.') AS labels FROM (SELECT DISTINCT host FROM parts) h LEFT JOIN counted USING (host)),
named AS (
  SELECT *, array_to_string(labels[-2:], '.') AS two FROM known),
leveled AS (
  SELECT host, n, bad,
         CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz') THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
         CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz') THEN two ELSE array_to_string(labels[-1:], '.') END AS suffix
  FROM named),
overall AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS above FROM leveled),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM leveled GROUP BY suffix),
s1 AS (SELECT s0.*, above FROM s0 CROSS JOIN overall),
sr AS (SELECT greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(CASE WHEN sum(n) > count(*) THEN
        (sum(pow(bad / n - above, 2) * n / (above * (1 - above))) - count(*)) / (sum(n) - count(*)) ELSE 0.5::DOUBLE END, 0.5::DOUBLE))) AS r FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (bad + (1 / r - 1) * above) / (n + (1 / r - 1)) AS rate FROM s1 CROSS JOIN sr),
d1 AS (SELECT d.*, s2.rate AS above FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM leveled GROUP BY ALL) d JOIN s2 USING (suffix)),
dr AS (SELECT greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(CASE WHEN sum(n) > count(*) THEN
        (sum(pow(bad / n - above, 2) * n / (above * (1 - above))) - count(*)) / (sum(n) - count(*)) ELSE 0.5::DOUBLE END, 0.5::DOUBLE))) AS r FROM d1 WHERE n > 0),
d2 AS (SELECT domain, (bad + (1 / r - 1) * above) / (n + (1 / r - 1)) AS rate FROM d1 CROSS JOIN dr),
h1 AS (SELECT l.host, l.n, l.bad, d2.rate AS above FROM leveled l JOIN d2 USING (domain)),
hr AS (SELECT greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(CASE WHEN sum(n) > count(*) THEN
        (sum(pow(bad / n - above, 2) * n / (above * (1 - above))) - count(*)) / (sum(n) - count(*)) ELSE 0.5::DOUBLE END, 0.5::DOUBLE))) AS r FROM h1 WHERE n > 0),
h2 AS (SELECT host, n, 1 / r - 1 AS strength, (bad + (1 / r - 1) * above) / (n + (1 / r - 1)) AS rate FROM h1 CROSS JOIN hr),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN rate - 2.0::DOUBLE * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN h2 USING (host)
"""


@query(HOSTS_SQL)
def op6_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A page shows the document whose number ends its path; that document's label is its outcome."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    labels = table(spark, folder, "labels").where("toxic is not null or quality is not null").select(
        F.col("doc_id").alias("__doc"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    shown = pages.select("page_id", F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]+)[^/0-9]*[^/]*$', 1), '') as bigint)").alias("__doc"))
    outcomes = shown.join(labels, "__doc").select("page_id", "bad")
    return hosts.judge_pages(pages, outcomes, RULES)


CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
         length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS text_chars,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS role_chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN place = 1 OR role <> before THEN role_chars + 4 + 2 + 8 ELSE 6 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query(CHAT_SQL)
def op9_format_chats(spark: SparkSession, folder: str) -> DataFrame:
    sample = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sample).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_conversations(turns)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chat.parse_conversations(made.select(
        F.struct("conv_id", "formatted", chat.loss_text(F.col("segments")).alias("loss")).alias("c"), "formatted"), "c")
    return read.select(
        "c.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("c.loss").cast("long").alias("loss_chars"), F.sha2("c.loss", 256).alias("loss_sha256"),
        F.length("c.formatted").cast("long").alias("formatted_chars"))


@query()
def op10_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return sentence_pieces.piece_digests(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, folder, "documents"))


@query()
def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, folder, "embeddings"))


WARC_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_page FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""


@query(WARC_SQL)
def op7_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
long AS (
  SELECT doc_id, line, norm FROM (
    SELECT doc_id, line, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM split)
  WHERE norm <> ''),
classes AS (SELECT norm, count(*) AS n, min((doc_id, line)) AS first_place, length(norm) AS size FROM long GROUP BY norm),
halves AS (
  SELECT DISTINCT norm, first_place, unnest(['a' || left(norm, m), 'b' || right(norm, m)]) AS key
  FROM (SELECT norm, first_place, unnest([size // 2, (size - 1) // 2]) AS m FROM classes WHERE size >= 20)),
near AS (
  SELECT DISTINCT l.norm FROM halves l JOIN halves e ON l.key = e.key AND e.first_place < l.first_place
  WHERE abs(length(l.norm) - length(e.norm)) <= 1 AND levenshtein(l.norm, e.norm) <= 1),
gone AS (
  SELECT DISTINCT o.doc_id, o.line FROM long o JOIN classes c USING (norm) LEFT JOIN near n ON n.norm = o.norm
  WHERE n.norm IS NOT NULL OR (o.doc_id, o.line) <> c.first_place),
kept AS (
  SELECT s.doc_id, string_agg(s.raw, chr(10) ORDER BY s.line) FILTER (g.line IS NULL) AS text, count(*) AS n_lines,
         count(g.line) AS gone_lines
  FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.line = s.line GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(gone_lines, 0)::INT AS gone_lines,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query(LINES_SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "gone_lines", F.sha2("text", 256).alias("text_sha256"))


SPELLING_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{00C0}-\x{00FF}]+')) AS word
    FROM documents) GROUP BY ALL),
hashed AS (
  SELECT word, n, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id || ':' || word, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc_table),
edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n
  FROM hashed),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word),
judged AS (
  SELECT v.word, v.n, count(near) AS n_near, max(near_n) AS most,
         (array_agg(near ORDER BY near_n DESC, encode(near)))[1] AS near
  FROM vocabulary v LEFT JOIN pairs p ON p.word = v.word GROUP BY v.word, v.n),
formed AS (SELECT word, n, n_near, CASE WHEN most >= 2 * n THEN near END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM judged),
steps AS (
  WITH RECURSIVE walk AS (
    SELECT word, word AS spot, 0 AS step FROM formed
    UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN formed f ON f.word = w.spot WHERE f.form IS NOT NULL)
  SELECT word, arg_max(spot, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN steps USING (word)
"""


@query(SPELLING_SQL)
def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.group_spellings(table(spark, folder, "documents"))


SEARCH_SQL = r"""
WITH terms AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
  UNION ALL
  SELECT 'q', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS (SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY ALL),
sized AS (
  SELECT id, n, 100 - 25 + (25 * n * count(*) OVER ()) // (sum(n) OVER ())::BIGINT AS m, count(*) OVER () AS documents
  FROM (SELECT id, sum(tf)::BIGINT AS n FROM counted WHERE kind = 'd' GROUP BY id)),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted JOIN sized USING (id) WHERE kind = 'd' GROUP BY term),
scored AS (
  SELECT q.id AS item_id, d.id AS doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m)))::BIGINT AS score
  FROM counted q JOIN counted d ON q.term = d.term AND q.kind = 'q' AND d.kind = 'd'
  JOIN weights t ON t.term = q.term JOIN sized s ON s.id = d.id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query(SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op13_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", quality_votes.held_out(F.col("doc_id")))
    model = quality_votes.train(docs.where(~F.col("held_out")), table(spark, folder, "labels").where(
        ~quality_votes.held_out(F.col("doc_id"))))
    return quality_votes.score_texts(docs, model).select("doc_id", "held_out", "score", "predicted")

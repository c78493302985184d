"""The pipeline on a small collection, each stage held against a plain version of what it does."""

import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from yieldlake.llm import language_id

from test_text_operators import components, near_copies, plain_dedup, plain_shingles, prose, speech

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def collection():
    draw = random.Random(9)
    texts = [(t, lang) for lang in ("aa", "bb") for t in speech(lang, 60, 3)]
    base = " ".join(speech("aa", 8, 4))
    texts += [(near_copies(draw, base, k), "aa") for k in (0, 0, 1, 2)]
    texts += [("\n".join([f"x{i} " + " ".join(speech("bb", 1, 50 + i)), "this very line is repeated in many of them"]), "bb") for i in range(8)]
    texts += [("12 34 !!", "aa"), (None, "aa"), ("", None), ("this very line is repeated in many of them", "bb")]
    return [(i, t, lang, draw.choice(["s", "s", "s", "t", None]), len(t or "")) for i, (t, lang) in enumerate(texts)]


def test_stages_and_run(spark, tmp_path):
    rows = collection()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append((before, docs.collect()))
        assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
    (start, spoken), (_, lines), (_, single), (_, mixed) = kept

    ids = {r.doc_id for r in spoken}
    assert {r.doc_id for r in start if not r.text or not language_id.has_letter(r.text)}.isdisjoint(ids)
    assert len(ids) >= len(start) - 6  # what has letters stays, but for a thousandth of clear texts

    want = plain_dedup([(r.doc_id, r.text) for r in spoken])
    gone = {i for i, t in want.items() if not t.strip()}
    assert {r.doc_id: r.text for r in lines} == {i: t for i, t in want.items() if i not in gone}
    assert all(r.n_chars == len(r.text) for r in lines) and gone

    sets = {r.doc_id: plain_shingles(r.text) for r in lines}
    names = sorted(sets)
    linked = [(a, b) for k, a in enumerate(names) for b in names[k + 1:]
              if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in single} == set(components(names, linked).values())

    size = {}
    for r in single:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    taken = {r.doc_id: 0 for r in single}
    for r in mixed:
        taken[r.doc_id] += 1
    assert max(taken.values()) <= 3 and {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    assert abs(sum(len(r.text.split()) for r in mixed) - sum(size.values())) <= 3 * 130

    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in mixed}
    assert len(last) == len(mixed)
    for r in last:
        found = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, last))

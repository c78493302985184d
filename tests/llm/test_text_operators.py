"""Brute force, round trips and odd inputs for the text operators."""

import gzip
import hashlib
import io
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from yieldlake.llm import (chat, fingerprints, hosts, language_id, line_dedup, mixing, ngram_join, sentence_pieces,
                           shingles, vector_forest, warc)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, long, "en", "a", len(long)), (4, "one two", None, "b", 7),
            (4, "one two", None, "b", 7), (5, "\n\n \t", "en", "b", 4), (None, "a null key with five words", "en", None, 3),
            (6, long, "en", "a", len(long)), (7, "ß " * 9 + "漢字 👍 \u2581 <0x0A> </s>", "en", "a", 30), (8, "12 34 !!", "en", "b", 8)]
    # Names that operators use inside.
    return docs_of(spark, [(*r, "x", 1) for r in rows], DOCS + ", size string, token int")


# -- sentence pieces ---------------------------------------------------------------------------------

def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentence_pieces.codec(MODEL)
    draw = random.Random(3)
    alphabet = "abcdefghi  ▁\n\t.,0123 éß漢字👍\0tHETHEing<0x0A></s>²"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    texts += ["", " ", "▁", " " * 500 + "a", "x" * 4000, "".join(draw.choice("abcdet") for _ in range(5000))]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids).removeprefix(" ") == library.decode(ids)


def test_piece_digests_and_columns(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentence_pieces.piece_digests(odd, MODEL).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    for r in odd.collect():
        ids = library.encode(r.text or "")
        assert by_id[r.doc_id].n_tokens == len(ids)
        assert by_id[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by_id[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    both = sentence_pieces.decode_ids(sentence_pieces.encode_texts(odd, MODEL), MODEL)
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in both.collect())
    assert sentence_pieces.piece_digests(odd.limit(0), MODEL).count() == 0


# -- language ----------------------------------------------------------------------------------------

def speech(language, count, seed):
    draw = random.Random(f"{language}{seed}")
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ich", "ung", "ei"], "cc": ["ção", "ñe", "ría", "que"]}[language]
    return [" ".join("".join(draw.choices(parts, k=3)) for _ in range(draw.randint(1, 40))) for _ in range(count)]


def test_number_signs_are_no_letters_and_rare_languages_do_not_train():
    model = language_id.fit(["ka lo mi"] * 10 + ["schr ich"] * 10, ["aa"] * 10 + ["bb"] * 10)
    for text in ("²", "½ 12", "Ⅷ ①", "", "12!", None):
        assert language_id.predict_text(model, text) == ("und", 0.0)
    assert language_id.predict_text(model, "² ka")[0] == "aa" and language_id.predict_text(model, "漢")[0] in ("aa", "bb")


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate((x, t) for x, n in (("aa", 30), ("bb", 20), ("cc", 5)) for t in speech(x, n, 1))]
    model = language_id.train(docs_of(spark, rows), options=language_id.LanguageOptions(max_languages=2))
    assert model.languages == ("aa", "bb")


def test_language_held_out_accuracy(spark, odd):
    rows = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate((x, t) for x in ("aa", "bb", "cc") for t in speech(x, 60, 1))]
    docs = docs_of(spark, rows)
    model = language_id.train(docs.where(~language_id.held_out(docs.doc_id)))
    judged = language_id.identify(docs, model).where(language_id.held_out(docs.doc_id)).collect()
    assert len(judged) > 30 and sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.97
    assert all(0 <= r.score <= 1 for r in judged)
    again = language_id.train(docs.where(~language_id.held_out(docs.doc_id)))
    assert np.array_equal(again.scores, model.scores)
    found = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 5, 8)] == ["und"] * 4 and not found[8].accepted
    assert found[3].lang_pred in ("aa", "bb", "cc")
    assert set(odd.columns) < set(language_id.identify(odd, model).columns)


def test_language_without_rows(spark, odd):
    model = language_id.train(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, model).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_long_text_is_read_whole():
    texts = speech("aa", 30, 2) + speech("bb", 30, 2)
    model = language_id.fit(texts, ["aa"] * 30 + ["bb"] * 30)
    long = speech("bb", 1, 5)[0] + " " + " ".join(speech("aa", 4000, 6))
    short = language_id.predict_text(model, " ".join(speech("aa", 50, 6)))
    assert len(long) > 200_000 and language_id.predict_text(model, long)[0] == short[0] == "aa"
    parts = list(language_id._pieces(np.zeros(language_id.SLICE_BYTES * 2 + 5, np.uint8)))
    assert len(parts) == 3 and sum(map(len, parts)) >= language_id.SLICE_BYTES * 2 + 5


# -- shingles, fingerprints --------------------------------------------------------------------------

def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def prose(draw, words, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def test_shingle_hashes_follow_words():
    draw = random.Random(1)
    texts = ["", "a", "A b\tc\x0bD  e", "a b c d e", "É ê a b c", None] + [prose(draw, draw.randint(1, 60), 5) for _ in range(200)]
    sets = list(shingles.shingle_sets([None if t is None else t.encode() for t in texts]))
    for text, found in zip(texts, sets):
        want = plain_shingles(text)
        assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
    for a, b in itertools.combinations(range(40), 2):
        assert len(np.intersect1d(sets[a], sets[b])) == len(plain_shingles(texts[a]) & plain_shingles(texts[b]))


def test_likeness_follows_jaccard():
    draw = random.Random(2)
    gaps = []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        words = prose(draw, 600, 10_000).split()
        other = words[:int(600 * share)] + prose(draw, 600 - int(600 * share), 10_000).split()
        a, b = plain_shingles(" ".join(words)), plain_shingles(" ".join(other))
        x, y = (fingerprints.fingerprint(s) for s in shingles.shingle_sets([" ".join(words).encode(), " ".join(other).encode()]))
        gaps.append(abs(fingerprints.likeness(x, y) - len(a & b) / len(a | b)))
    assert max(gaps) < 0.08
    assert len(x) == fingerprints.BINS * fingerprints.BITS // 4


def test_neighbours_against_brute_force(spark, odd):
    draw = random.Random(4)
    rows = [(int(k), prose(draw, draw.randint(0, 80)), None, None, None) for k in draw.sample(range(1000), 90)]
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (2002, "x", None, None, None)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(docs_of(spark, rows).repartition(5)).collect()}
    ordered = sorted(rows, reverse=True, key=lambda r: r[0])
    for row, following in zip(ordered, ordered[1:] + ordered[:1]):
        text, other = row[1] or "", following[1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + other[:half]
        marks = [fingerprints.fingerprint(s) for s in shingles.shingle_sets([text.encode(), changed.encode(), other.encode()])]
        found = got[row[0]]
        assert (found.n_chars, found.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (found.fingerprint, found.edited_fingerprint) == (marks[0], marks[1])
        assert found.near_next == fingerprints.likeness(marks[0], marks[2])
    assert fingerprints.fingerprint_neighbours(odd).count() == odd.count()
    assert fingerprints.fingerprint_neighbours(odd.limit(0)).count() == 0
    alone = fingerprints.fingerprint_neighbours(docs_of(spark, [(1, "a b c", None, None, None)])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# -- n-gram join -------------------------------------------------------------------------------------

def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(draw, base, edits):
    words = base.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10_000)}"
    return " ".join(words)


def test_similar_documents_against_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SIDE", 4)  # several tiles for a frequent token
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 5)
    monkeypatch.setattr(ngram_join, "PAIR_CHUNK", 50)
    draw = random.Random(5)
    passage = prose(draw, 55, 10_000)
    texts = []
    for size in (4, 6, 9, 30, 60, 200):
        base = prose(draw, size, 10_000)
        texts += [near_copies(draw, base, draw.randint(0, 1 + size // 18)) for _ in range(14)] + [base, base.upper()]
    texts += [prose(draw, draw.randint(5, 70), 10_000) + " " + passage for _ in range(40)]
    texts += [prose(draw, draw.randint(1, 40), 10_000) for _ in range(40)] + [None, "", " \n"]
    draw.shuffle(texts)
    sets = [plain_shingles(t) for t in texts]
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
              if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), linked)
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert len(set(want.values())) < len(texts) - 40  # the fixture does hold groups
    found = ngram_join.similar_documents(odd).collect()
    assert len(found) == odd.count()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 3, 7: 7, 8: 8, None: None}
    assert ngram_join.similar_documents(odd.limit(0)).count() == 0


def test_fitting_signatures_bound_the_overlap():
    rng = np.random.default_rng(12)
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in rng.integers(1, 400, 3))
        left, right = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
        marks = [np.frombuffer(ngram_join.fitting_signature(s), np.uint64) for s in (left, right)]
        may = ngram_join.fitting_bound(len(left), len(right), *marks)
        assert may or not ngram_join.similar(len(left), len(right), len(np.intersect1d(left, right)))


def test_tokens_of_the_same_sets_are_one(spark):
    rows = [(t, f, t % 7) for t in range(100, 140) for f in ((1, 2) if t % 2 else (1, 2, 3))] + [(900, 4, 0), (901, 4, 1), (901, 5, 1), (901, 5, 2)]
    got = ngram_join.shared_tokens(spark.createDataFrame(rows, "token bigint, f1 bigint, rank tinyint")).collect()
    held = {}
    for r in got:
        held.setdefault((r.token, r.rows), []).append((r.f1, r["rank"]))
    assert sorted((n, sorted(v)) for (_, n), v in held.items()) == [(2, [(1, 0), (2, 0)]), (2, [(4, 1), (5, 1)]), (3, [(1, 0), (2, 0), (3, 0)])]


def test_a_pair_is_compared_by_one_token_that_both_name():
    rng = np.random.default_rng(4)
    once = 0
    for _ in range(300):
        both, a, b = (rng.integers(-(1 << 63), ngram_join.NO_TOKEN, n) for n in rng.integers(1, 12, 3))
        low = [np.concatenate((np.unique(np.concatenate((both, x))), [ngram_join.NO_TOKEN] * ngram_join.LOWEST))[None, :ngram_join.LOWEST] for x in (a, b)]
        met = ngram_join.met_here(both, low[0].repeat(len(both), 0), low[1].repeat(len(both), 0))
        agreed = np.intersect1d(low[0][low[0] != ngram_join.NO_TOKEN], low[1])
        assert met.sum() == 1 if len(agreed) else met.all()
        once += len(agreed) > 0 and len(both) > 1
    assert once > 100


def test_pairs_of_many_common_tokens_are_made_once(spark, monkeypatch):
    """60 sets, each a cluster of its own, that lack a few of 200 tokens each: nearly every token has other sets."""
    rng = np.random.default_rng(9)
    sets = [np.sort(rng.choice(200, 190, replace=False)) for _ in range(60)]
    words = [np.frombuffer(ngram_join.signature(s.astype(np.uint64)), np.uint64) for s in sets]
    rows = np.array([(t, f) for t in range(200) for f in range(60) if t in sets[f]])
    token, owner = rows[:, 0].copy(), rows[:, 1].copy()
    yes, sizes = np.ones(len(rows), bool), np.full(len(rows), 190)
    lowest = np.stack([s[:ngram_join.LOWEST] for s in sets])[owner]
    made = [(owner[a], owner[b]) for x, y in ngram_join.tile_candidates(token, yes, yes, sizes, owner, np.stack(words)[owner], token, lowest)
            for a, b in zip(x, y)]
    every = set(itertools.combinations(range(60), 2))
    assert {(min(p), max(p)) for p in made} == every and len(made) < 2 * len(every)  # each token of a pair made it before, some 180
    monkeypatch.setattr(ngram_join, "TILE_SIDE", 16)
    shared = ngram_join.shared_tokens(spark.createDataFrame([(int(t), i, 0) for i, s in enumerate(sets) for t in s], "token bigint, f1 bigint, rank tinyint"))
    classes = spark.createDataFrame([(i, 190, i, bytearray(w.tobytes()), None) for i, w in enumerate(words)],
                                    "f1 bigint, n int, cluster bigint, bits binary, fit binary")
    assert {(r.a, r.b) for r in ngram_join.tile_pairs(shared, classes).collect()} == every


def test_signatures_with_more_room_tell_more_sets_apart():
    rng = np.random.default_rng(13)
    passed = {1: 0, ngram_join.FINE_ROOM: 0}
    for _ in range(100):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (240, 60, 60))  # two thirds in common
        for room in passed:
            marks = [np.frombuffer(ngram_join.fitting_signature(np.concatenate((both, x)), room), np.uint64) for x in (a, b)]
            passed[room] += ngram_join.fitting_bound(300, 300, *marks)
    assert passed[1] > 90 and passed[ngram_join.FINE_ROOM] < 10


def test_prefix_length_is_exact():
    for n in range(1, 300):
        assert ngram_join.prefix_length(n) == n - -(-3 * n // 4) + 1


# -- lines -------------------------------------------------------------------------------------------

def plain_dedup(rows):
    """Kept text per row by comparing every line with every earlier one."""
    def edit_one(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        if len(a) == len(b):
            return a[i + 1:] == b[i + 1:]
        return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i:]

    seen, out = [], {}
    for key, text in sorted(rows):
        kept = []
        for raw in text.split("\n"):
            norm = " ".join(raw.split()).lower()
            near = [s for s in seen if min(len(s), len(norm)) >= line_dedup.MIN_CHARS]
            gone = norm in seen or (len(norm) >= line_dedup.MIN_CHARS and any(edit_one(norm, s) for s in near))
            if norm:
                seen.append(norm)
            if not gone:
                kept.append(raw)
        out[key] = "\n".join(kept)
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_line_dedup_against_brute_force(spark, odd, shuffled, monkeypatch):
    if shuffled:
        monkeypatch.setattr(line_dedup, "LINE_BROADCAST", 0)
    draw = random.Random(6)
    bases = [prose(draw, draw.randint(5, 12), 50) for _ in range(25)] + ["a" * 30, "ab" * 12, "é" * 24]

    def line():
        text = draw.choice(bases)
        place, kind = draw.randrange(len(text)), draw.randrange(6)
        edited = {0: text, 1: text[:place] + text[place + 1:], 2: text[:place] + "z" + text[place:], 3: text[:place] + "q" + text[place + 1:],
                  4: text.upper(), 5: " " + text.replace(" ", "  ")}[kind]
        return draw.choice([edited, edited, "short", ""])

    rows = [(i, "\n".join(line() for _ in range(draw.randint(1, 8)))) for i in range(60)]
    got = line_dedup.dedup_lines(docs_of(spark, [(i, t, None, None, None) for i, t in rows]).repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == plain_dedup(rows)
    assert sum(r.gone_lines for r in got) > 50
    found = line_dedup.dedup_lines(odd)
    assert found.count() == odd.count() and set(odd.columns) < set(found.columns)
    kept = {r.doc_id: r for r in line_dedup.kept_documents(odd).collect()}
    assert 3 in kept and 6 not in kept and kept[1].text is None and kept[5].text == "\n\n \t"
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_swapped_words_of_two_letters_are_not_confused(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    twin = word.translate(str.maketrans("ab", "ba"))
    assert shingles.word_hashes([word.encode()])[0] != shingles.word_hashes([twin.encode()])[0]
    texts = [word, twin, f"one two three four five {word}", f"six seven eight nine ten {twin}", f" {word.upper()}\n"]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_kept_documents_drop_whole_copies_with_short_lines(spark):
    long = "a line that is long enough to be near"
    rows = [(1, f"{long}\nshort\n \nx"), (2, f"{long}\nshort\n \nx"), (3, f"Short\nown words\n{long}s\n\nX "), (4, "short"), (5, "shor"), (6, "\n ")]
    docs = docs_of(spark, [(i, t, None, None, len(t)) for i, t in rows]).repartition(3)
    same = {1: rows[0][1], 5: "shor", 6: "\n "}
    assert {r.doc_id: r.text for r in line_dedup.kept_documents(docs, exact_chars=20).collect()} == same | {3: "Short\nown words\n\nX ", 4: "short"}
    assert {r.doc_id: r.text for r in line_dedup.kept_documents(docs).collect()} == same | {3: "own words\n"}
    lost = {r.doc_id: r.gone_lines for r in line_dedup.dedup_lines(docs).collect()}
    assert lost == {1: 0, 2: 3, 3: 3, 4: 1, 5: 0, 6: 0}


# -- mixing ------------------------------------------------------------------------------------------

def test_mix_targets_and_nearness(spark, odd):
    draw = random.Random(7)
    rows = [(i, prose(draw, draw.randint(1, 60)), None, draw.choice(["a", "a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.copies for r in got} == again
    size, target, taken = {}, {}, {}
    for r in got:
        assert r.size == len(r.text.split()) and r.taken <= 3 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    left, open_, want = sum(size.values()), set(size), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < level * weights[s]}
        for s in full or open_:
            want[s] = 3 * size[s] if full else level * weights[s]
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(odd).count() == odd.count()
    assert set(mixing.mixed_documents(odd).columns) == set(odd.columns)
    assert mixing.mix(odd.limit(0)).count() == 0
    empty = mixing.mix(docs_of(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)] * 2


# -- chat --------------------------------------------------------------------------------------------

def test_chat_round_trip_and_ties(spark):
    nasty = "\\### assistant: </turn>\n<and/> \\b\\h\\l # < ok"
    turns = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "assistant", "z"),
             (2, None, None, None), (2, 1, "a: b# <", nasty), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (3, 5, "user", "a"),
             (None, 1, "user", "no id")]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id bigint, turn bigint, role string, text string, segments int")
    made = chat.format_conversations(rows)
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.parse_conversations(made).collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in (1, 2, 3, None):
        assert back[conv] == [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == conv), key=order)]
    loss = {r.conv_id: r.loss for r in made.select("conv_id", chat.loss_text(made.segments).alias("loss")).collect()}
    assert loss == {1: nasty + "z", 2: "", 3: "xx", None: ""}
    one = {r.conv_id: r for r in made.collect()}
    assert one[1].formatted == "".join(s.text for s in one[1].segments)
    assert one[1].formatted.count("### ") == 4 and one[3].formatted == "### assistant: x<and/>x</turn>\n### user: a</turn>\n"
    assert chat.format_conversations(rows.limit(0)).count() == 0


# -- hosts -------------------------------------------------------------------------------------------

def test_rules_and_reputation(spark):
    urls = {1: "HTTP://A.Example.NET/en/x?y", 2: "http://example.net?q", 3: "x://b.example.com/de/", 4: "x://org/fr/1", 5: None, 6: "no scheme",
            7: "x://notnet/", 8: "x://a.net/x#y", 9: "x://bad.co.uk/1", 10: "x://bad.co.uk/2", 11: "x://good.co.uk/1", 12: "x://net", 13: "x://new.bad.co.uk/"}
    rows = [(k, u, "h", 1) for k, u in urls.items()] + [(100 + i, "x://spam.io/p", "h", 1) for i in range(40)] + [(200 + i, "x://fine.io/p", "h", 1) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(200 + i, 0) for i in range(30)] + [(11, None)], "page_id bigint, bad int")
    rules = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
    got = {r.page_id: r for r in hosts.judge_pages(pages, outcomes, rules).collect()}
    assert len(got) == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule) == ("example.net", "", None)
    assert got[3].verdict == "block" and got[4].rule == "org/fr/" and got[7].rule is None and got[8].rule == "net/" and got[12].rule is None
    assert (got[5].host, got[5].path) == (got[6].host, got[6].path) == ("", "")
    assert got[139].verdict == "block" and got[239].verdict == "allow" and got[13].verdict == "allow"
    assert hosts.judge_pages(pages.limit(0), outcomes, rules).count() == 0
    assert hosts.judge_pages(pages, outcomes.limit(0), ()).where("verdict = 'allow'").count() == len(rows)


# -- archives ----------------------------------------------------------------------------------------

def test_archive_round_trip(spark):
    long = "é" * 200_000
    rows = [(1, "x://a", None), (2, "x://b", ""), (3, None, "dup " * 40), (4, "x://c\r\nEvil: 1", "dup " * 40), (5, "x://d", "dup " * 40),
            (5, "x://d", "dup " * 40), (6, "x://e", "small"), (7, "x://e", "small"), (8, "x://f", long), (9, "x://g", "WARC/1.1\r\n\r\nx" * 20),
            (None, "x://h", "dup " * 40)]
    pages = spark.createDataFrame([(*r, "k", 2) for r in rows], "page_id bigint, url string, html string, k string, u int").repartition(3)
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for key, _, html in rows:
        raw = (html or "").encode()
        assert (by_id[key].payload_bytes, by_id[key].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert by_id[key].payload is None or bytes(by_id[key].payload) == raw
    assert [(by_id[k].record_type, by_id[k].refers_to) for k in (3, 4, 5, 6, 7, None)] == [
        ("response", None), ("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None)]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_makes_members_with_offsets():
    records = [warc.page_record(i, f"x://{i}", "p" * (i * 5000), "d", i * 5000, None) for i in range(200)]
    # A first part of whole members and a second part as one stream: any mix is read.
    source = io.BytesIO(gzip.compress(records[0]) + gzip.compress(b"".join(records[1:])))
    target, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(source, target, index) == 200
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    assert gzip.decompress(target.getvalue()) == b"".join(records)
    for i in (0, 7, 199):
        piece = target.getvalue()[entries[i]["offset"]:entries[i]["offset"] + entries[i]["length"]]
        assert gzip.decompress(piece) == records[i]
        assert warc.read_record(target, entries[i]["offset"], entries[i]["length"]).headers["warc-record-id"] == f"<urn:page:{i}>"
    cut = io.BytesIO(gzip.compress(b"".join(records))[:-50])
    with pytest.raises((EOFError, ValueError)):
        warc.normalise(cut, io.BytesIO(), io.BytesIO())


# -- vectors -----------------------------------------------------------------------------------------

def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    near = np.concatenate([c + rng.normal(size=(12, 16)) * 0.12 for c in centres])
    values = [*near.tolist(), *rng.normal(size=(600, 16)).tolist(), *([centres[0].tolist()] * 30)]
    odd_rows = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    rows = [(i, None if v is None else v) for i, v in enumerate(values + odd_rows)] + [(None, near[0].tolist())]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, id string")
    options = vector_forest.ForestOptions(leaf_rows=64)
    got = {r.vec_id: r for r in vector_forest.near_vectors(frame, options=options).collect()}
    assert len(got) == len(rows)
    matrix = np.array(values, dtype=np.float32).astype(float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    hit = matrix @ matrix.T >= 0.9
    np.fill_diagonal(hit, False)
    found = np.array([got[i].n_links for i in range(len(values))])
    assert (found <= hit.sum(axis=1)).all() and found.sum() >= 0.95 * hit.sum()
    want = components(range(len(values)), zip(*np.nonzero(hit)))
    same = np.mean([got[i].component_id == want[i] for i in range(len(values))])
    assert same > 0.97
    for i in [*range(len(values), len(values) + len(odd_rows)), None]:
        assert (got[i].n_links, got[i].component_id) == (0, i) and got[i].kept
    assert vector_forest.near_vectors(frame.limit(0)).count() == 0

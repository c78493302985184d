"""Spelling variants, ranked search and quality votes against plain loops and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from yieldlake.llm import quality_votes, ranked_search, spelling_groups
from yieldlake.llm.quality_votes import QualityOptions
from yieldlake.llm.ranked_search import SearchOptions
from yieldlake.llm.spelling_groups import SpellingOptions

DOCS = "doc_id bigint, text string, word string, n int, id bigint, score double, terms string"


def docs_of(spark, rows):
    """Documents with more columns, whose names operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1, 2, 0.5, None) for k, t in rows], DOCS).repartition(3)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- spelling variants -------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(rows, options):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = ascii_lower(run)
            h = zlib.crc32(f"{key}:{word}".encode())
            if key is not None and options.drop_one_in and h % options.drop_one_in == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= options.least_letters and n >= options.least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= options.dominance * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def own_groups(spark, rows, options):
    found = spelling_groups.group_spellings(docs_of(spark, rows), options=options).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


@pytest.mark.parametrize("symbols,alphabet,block", [(2, "ab", 20_000), (4, "abcé÷", 20_000), (6, "abcdefgh", 20_000), (3, "abc", 4)])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, symbols, alphabet, block):
    monkeypatch.setattr(spelling_groups, "SLICE_LETTERS", 100)
    draw = random.Random(symbols)
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 7))) for _ in range(120)]
    rows = []
    for key in range(60):
        chosen = [draw.choice(words[:20 if draw.random() < 0.6 else 120]) for _ in range(60)]
        rows.append((key, "".join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in
                                  (x + draw.choice([" ", ", ", "1", "\n", "漢"]) for x in chosen))))
    options = SpellingOptions(symbols=symbols, least_letters=2, least_count=2, drop_one_in=7, block_words=block)
    want = plain_groups(rows, options)
    assert len(want) > 30 and any(f is not None for f, *_ in want.values())
    assert own_groups(spark, rows, options) == want


def test_spelling_odd_inputs(spark):
    long = "ab" * 3000  # one word of 6,000 letters and two words near to it
    rows = [(1, None), (2, ""), (3, "12 \n--"), (None, "colour colour Colour color"), (4, "colour color"), (4, "colour color"),
            (5, f"{long} {long} {long}x {long}x {long[1:]} {long[1:]} {long}"), (6, "COLOR colour colours ÉCOLE ÉCOLE ÉCOLE"),
            (7, "naïve naïve naïve naive naive naive naive naive naive naive")]
    options = SpellingOptions(drop_one_in=0, least_count=2)
    want = plain_groups(rows, options)
    got = own_groups(spark, rows, options)
    assert got == want
    assert got["naïve"][:2] == ("naive", "naive") and got["École"][0] is None
    assert got[long + "x"][3] == 1 and got[long][3] == 2
    assert own_groups(spark, [(1, None)], options) == {} and own_groups(spark, [], options) == {}


def test_spelling_chains_follow_to_the_root(spark):
    # Each form is twice as frequent as the one before: a chain of seven steps.
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb", "bbbbbbb"]
    text = " ".join(" ".join([w] * (3 * 2 ** i)) for i, w in enumerate(words))
    got = own_groups(spark, [(1, text)], SpellingOptions(drop_one_in=0))
    assert got["aaaaaaa"][0] == "aaaaaab" and all(got[w][1] == "bbbbbbb" for w in words)


def test_spelling_counts_flush_and_long_texts(spark, monkeypatch):
    rows = [(k, " ".join(f"{chr(97 + k)}abc{chr(97 + i % 26)}" for i in range(200))) for k in range(10)]
    want = plain_groups(rows, SpellingOptions())
    monkeypatch.setattr(spelling_groups, "HELD_WORDS", 3)
    monkeypatch.setattr(spelling_groups, "LONG_TEXT", 50)
    pieces = spelling_groups._words_of("1", rows[1][1], 97)
    assert Counter(dict(pieces)).total() == 200
    assert own_groups(spark, rows, SpellingOptions()) == want


# -- ranked search -----------------------------------------------------------------------------------

def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def plain_search(docs, items, top):
    counted = [(k, Counter(plain_terms(t))) for k, t in docs]
    held = [c for _, c in counted if c]
    n_all, length = len(held), sum(c.total() for c in held)
    df = Counter(t for c in held for t in c)
    out = defaultdict(list)
    for item, text in items:
        scored = []
        for key, c in counted:
            if not c:
                continue
            m = 75 + (25 * c.total() * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out[item] += [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return {k: sorted(v, key=repr) for k, v in out.items() if v}


def own_search(spark, docs, items, options):
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    out = defaultdict(list)
    for r in ranked_search.search(docs_of(spark, docs), queries, options=options).collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v, key=repr) for k, v in out.items()}


@pytest.mark.parametrize("window,block,share", [(4, 16, 4), (8, 64, 1000), (1024, 16384, 64)])
def test_search_equals_brute_force(spark, monkeypatch, window, block, share):
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "TEXT_SLICE", 40)
    draw = random.Random(window)
    words = [f"w{i}" for i in range(40)] + ["été", "Ärger", "漢字", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(draw.randint(0, 400), " ".join(draw.choices(words, weights, k=draw.randint(0, 40)))) for _ in range(300)]
    docs += [(k, "w1 w2 w30 w31") for k in range(1000, 1060)]  # many copies: ties by id
    docs += [(900, None), (901, ""), (902, "--- !"), (None, "w1 w2 w39 w39")]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w30, w31. W30!"), (103, "w5"), (104, "w39")]
    # Floats of the search: one term may repeat within an item.
    options = SearchOptions(block_documents=block, short_share=share)
    assert own_search(spark, docs, items, options) == plain_search(docs, items, 20)


def test_search_in_several_passes_and_without_rows(spark):
    docs = [(i, f"alpha beta{i % 5} gamma{i % 11}") for i in range(90)]
    items = [(i, f"beta{i % 5} gamma{i % 7} alpha alpha") for i in range(12)]
    small = SearchOptions(top=3, query_bytes=60)
    assert own_search(spark, docs, items, small) == plain_search(docs, items, 3)
    assert own_search(spark, [], items, small) == {} and own_search(spark, docs, [], small) == {}
    numbered = spark.createDataFrame([("b", "alpha"), ("a", "alpha"), (None, "alpha")], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "Alpha")], "item_id string, text string")
    got = ranked_search.search(numbered, queries).orderBy("rank").collect()
    assert got == [] or [r.doc_id for r in got] == ["a", "b", None]


def test_short_lists_add_up_and_windows_are_skipped(monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW", 4)
    one = ranked_search.PostingList(np.array([1, 5]), np.array([10, 20]))
    two = ranked_search.PostingList(np.array([5, 9]), np.array([1, 2]))
    both = ranked_search.accumulate([(one, 2), (two, 1)])
    assert both.rows.tolist() == [1, 5, 9] and both.scores.tolist() == [20, 41, 2]
    long = ranked_search.PostingList(np.arange(12), np.ones(12, dtype=np.int64)).bounded(3)
    rows, scores = ranked_search.search_block([(both.bounded(3), 1), (long, 1)], 3, 2, 1)
    assert rows.tolist() == [5, 1] and scores.tolist() == [42, 21]
    assert ranked_search.search_block([(both, 1), (long, 1)], 3, 2, 43)[0].tolist() == []


# -- quality votes -----------------------------------------------------------------------------------

def plain_counts(text):
    """The hashed terms with a loop over the bytes."""
    def bucket(code, salt, size):
        mixed = ((code ^ salt) * 2654435761) % 2 ** 32
        mixed ^= mixed >> 15
        return ((mixed * 2654435761) % 2 ** 32 >> 8) % size

    def kind(c):
        return 1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c == 32 or 9 <= c <= 13 else c + 5

    data = text.encode()
    low, kinds = data.lower(), [kind(c) for c in data]
    found = np.zeros(quality_votes.BUCKETS, dtype=np.int64)
    content, form = quality_votes._CONTENT, quality_votes._TWICE - quality_votes._CONTENT
    for width, salt in ((3, 0x1B873593), (4, 0x85EBCA6B)):
        for i in range(len(low) - width + 1):
            found[bucket(int.from_bytes(low[i:i + width], "big"), salt, content)] += 1
    for width, salt in ((1, 0x27D4EB2F), (2, 0x165667B1), (3, 0x9E3779B1)):
        for i in range(len(kinds) - width + 1):
            code = 0
            for k in kinds[i:i + width]:
                code = (code << 9) | k
            found[content + bucket(code, salt, form)] += 1
    words = low.split()
    for first, n in ((quality_votes._TWICE, sum(a == b for a, b in zip(words, words[1:]))), (quality_votes._AGAIN, len(words) - len(set(words)))):
        for tenth in range(10):
            if n * 10 > tenth * len(words):
                found[first + tenth] = 1000
    return found


@pytest.mark.parametrize("slice_bytes", [1 << 20, 16])
def test_quality_terms_equal_a_plain_loop(monkeypatch, slice_bytes):
    monkeypatch.setattr(quality_votes, "SLICE_BYTES", slice_bytes)
    draw = random.Random(4)
    for size in (0, 1, 2, 3, 4, 15, 16, 17, 200):
        text = "".join(draw.choice("abé AB12\n.!漢") for _ in range(size))
        got, want = quality_votes.term_counts(text.encode()), plain_counts(text)
        # Words at the edge of a slice are counted in parts; all windows are whole.
        until = len(got) if slice_bytes > 1000 else quality_votes._TWICE
        assert got[:until].tolist() == want[:until].tolist()


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    features = [(np.sort(rng.choice(200, 30, replace=False)), rng.random(30) + 0.5) for _ in range(60)]
    labels = [int(i % 3 > 0) for i in range(60)]
    options = QualityOptions(dimensions=8, neighbours=7)
    model = quality_votes.fit(features, labels, (400, 600), options)
    assert np.allclose((model.vectors ** 2).sum(axis=0), 1) and np.allclose(model.basis.T @ model.basis, np.eye(8))
    vectors = np.array([quality_votes.latent(model, *features[i]) for i in range(10)])
    got = quality_votes.vote(model, vectors, options)
    for mine, score in zip(vectors, got):
        near = sorted(((float(mine @ model.vectors[:, j]), j) for j in range(60)), reverse=True)[:7]
        scale = [400 / 20, 600 / 40]  # all rows of a label over its sampled rows
        weights = [(max(0, c) ** 8 * scale[labels[j]] / max(scale), labels[j]) for c, j in near]
        want = (sum(w for w, y in weights if y) + 0.05 * 0.6) / (sum(w for w, _ in weights) + 0.05)
        assert abs(score - want) < 1e-6
    # The basis spans the leading right singular space of the weighted rows.
    rows = np.zeros((60, quality_votes.BUCKETS))
    for r, (index, values) in zip(rows, features):
        r[index] = values * model.term_weights[index]
        r /= np.sqrt(r @ r)
    best = np.linalg.svd(rows, compute_uv=False)[:8]
    assert (np.linalg.norm(rows @ model.basis) ** 2) / (best ** 2).sum() > 0.9


def test_quality_held_out_accuracy_and_odd_rows(spark):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(300)]

    def good():
        return " ".join(draw.choice(words) for _ in range(draw.randint(5, 80))) + "."

    def bad():
        form = draw.randint(0, 2)
        text = [draw.choice(words) for _ in range(draw.randint(5, 60))]
        return " ".join(x + "$$%" for x in text) if form == 0 else " ".join(text).upper() + "!!" if form == 1 else " ".join(text[:1] * 40)

    rows = [(i, good() if i % 6 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(600)] + [(None, 1, 0), (1, None, 0), (2, 7, 0)],
                                   "doc_id bigint, quality int, toxic int")
    odd = [(700, None), (701, ""), (702, "x " * 300_000), (None, "a text without a key"), (3, rows[3][1])]
    docs = docs_of(spark, rows + odd)
    kept = docs.where(~quality_votes.held_out(docs.doc_id))
    model = quality_votes.train(kept, labels.where(~quality_votes.held_out(labels.doc_id)))
    got = quality_votes.score_texts(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.doc_id, r.predicted) for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum(p == int(k % 6 > 0) for k, p in held) / len(held) > 0.95
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text].add(r.score)
    assert all(len(x) == 1 for x in by_text.values()) and by_text[None] == by_text[""]
    assert quality_votes.score_texts(docs.limit(0), model).count() == 0
    none = quality_votes.train(docs, labels.limit(0))
    assert {r.score for r in quality_votes.score_texts(docs, none).collect()} == {0.5}
    # A key that repeats brings many rows, but no more than the bound into the sample.
    many = docs_of(spark, [(1, f"same key {i}") for i in range(50)])
    small = QualityOptions(rows_per_label=4)
    assert len(quality_votes.labelled_sample(many, labels, "doc_id", "text", "quality", small)[1]) <= 8

import random
import re

import numpy as np
import pytest

from tessera.functions.text import WS
from tessera.llm import bpe
from tessera.llm.leaks import Seeds, find_leaks, words_of
from tessera.llm.reading import FEATURES, Boosting, Lexicon, features, fit, grade_cuts, labelled, levels, train, word_ranks
from tessera.llm.split_items import Limits, split_oversized, split_spans, split_text
from tessera.llm.tokens import encode, token_totals

PATH = bpe.rank_file("byte_bpe_50k")
ODD = ["", " ", "‍", "İΣ'ſ", "a" * 5000, "漢字。" * 2000, " \n\t" * 2000, "<|endoftext|>", "x\x1cy", "é" * 1700, "it's  we'll　ok"]


def words(t):
    return re.findall(f"[^{WS}]+", t)


def check_pieces(text, limits):
    pieces, spans = split_text(text, limits), split_spans(text, limits)
    assert "".join(text[a:b] for _, a, b in spans) == text
    assert all(len(words(p)) <= limits.words and len(p) <= limits.chars for p in pieces)
    for (b0, _, e0), (b1, a1, _) in zip(spans, spans[1:]):
        carried = words(text[b1:a1])
        assert b1 >= b0 and len(carried) <= limits.overlap
        assert carried == words(text[b0:e0])[len(words(text[b0:e0])) - len(carried) :]
    return spans


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_odd_texts(text):
    check_pieces(text, Limits())
    check_pieces(text, Limits(20, 100, 5))


def test_pieces_of_random_texts():
    rnd = random.Random(3)
    for _ in range(150):
        parts = rnd.choices(["word ", "a. ", "\n", "\n\n", "x" * 40 + " ", "。", "1. ", "! "], k=rnd.randint(1, 400))
        check_pieces("".join(parts), Limits(30, 150, 6))


def test_cuts_fall_on_natural_boundaries():
    text = " ".join(f"Sentence number {i} tells this and that." for i in range(200))
    spans = check_pieces(text, Limits())
    assert len(spans) > 1 and all(text[:a].rstrip().endswith(".") for _, a, _ in spans[1:])
    assert all(len(words(text[b:a])) == 50 for b, a, _ in spans[1:])


def test_split_oversized_table(spark):
    rows = [("a", "w " * 351), ("a", "w " * 351), ("b", "w " * 350), ("c", None), (None, "x" * 3001), ("d", "x" * 3000), ("e", "")]
    df = spark.createDataFrame(rows, "piece string, text string").selectExpr("piece as id", "text", "1 as k0", "2 as piece_pos")
    got = split_oversized(df, "text", ["id"]).filter("piece_pos = 0").collect()
    assert sorted((r.id or "") for r in got) == ["", "a", "a"]
    assert split_oversized(df.limit(0), "text", ["id"]).count() == 0


def test_encoding_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    alphabet = list("ab'sreDé漢 \n\t 　‍.!19") + ["\U0001f44d", " the", "ing"]
    texts = ODD + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 80))) for _ in range(1500)]
    cutter, heap = bpe.CutEncoder(ranks), bpe.HeapBPE(ranks)
    for t in texts:
        want = enc.encode_ordinary(t)
        assert cutter.encode(t) == want
        assert heap.weigh([t]) == len(want)
    assert heap.weigh(texts) == sum(len(enc.encode_ordinary(t)) for t in texts)


def test_forced_boundaries_never_lie_inside_a_token():
    ranks = bpe.load_ranks(PATH)
    c = bpe.CutEncoder(ranks)
    for t in list(ranks)[::50]:
        assert len(c.cuts(np.frombuffer(t, np.uint8))) == 0
    cut = lambda s: c.cuts(np.frombuffer(s.encode(), np.uint8)).tolist()
    assert cut("two words  here") == [3, 9] and cut("") == [] and cut("a") == []
    assert cut("x\u3000\u3000y") == [1] and cut("!'s") == []  # not after white space, not at an apostrophe
    # Rare letters that are neighbours in no token are parted, and give what the whole gives.
    piece = "漢字漢字" * 20
    assert cut(piece) and c.encode(piece) == bpe.HeapBPE(ranks).encode(piece.encode())


def test_encoding_in_slices(spark):
    rows = [(k, t) for k, t in enumerate([None, "", "hello world", "a" * 50, None, "", "漢字 漢字", "x"])]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    c = bpe.CutEncoder(bpe.load_ranks(PATH))
    assert sorted((r.doc_id, r.ids) for r in encode(df, "doc_id", "text", slice_bytes=10).collect()) == [(k, c.encode(t) if t else []) for k, t in rows]


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "hello world", "z"), (2, "", "z"), (3, None, "z"), (1, "hello world", "z"), (None, "x", None)], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in encode(df, "doc_id", "text").collect())
    assert got == [(0, [87]), (1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_token_totals(spark):
    df = spark.createDataFrame([("a", None, "hello world"), ("a", None, None), ("b", "x", ""), ("b", "x", "hello"), ("b", "x", "hello")], "n_texts string, g0 string, text string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in token_totals(df, "text", ["n_texts", "g0"]).collect()}
    assert got == {("a", None): (2, 2), ("b", "x"): (3, 2)}
    assert token_totals(df.limit(0), "text", ["g0"]).count() == 0


def brute_leaks(docs, items, run=12):
    out = set()
    for d, t in docs:
        w = words_of(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, s in items:
            v = words_of(s)
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_leaks_equal_brute_force(spark, block):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([5, 11, 12, 30])))) for i in range(30)] + [(90, None), (91, "")]
    items.append((92, items[3][1]))
    docs = [(100, None), (101, ""), (102, "a b")]
    for d in range(60):
        w = rnd.choices(vocab, k=rnd.randint(0, 60))
        v = items[rnd.randrange(30)][1].split()
        a = rnd.randint(0, max(0, len(v) - 12))
        w[20:20] = [x.upper() for x in v[a : a + rnd.choice([11, 12, 20])]]
        docs.append((d, rnd.choice([" ", ", ", "\n-"]).join(w)))
    docs.append(docs[-1])
    c = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(c, "doc_id", "text", i, "item_id", "text", Seeds(block_words=block))
    assert {(r.doc_id, r.item_id) for r in got.collect() if r.longest_run >= 12} == brute_leaks(docs, items)
    assert find_leaks(c, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert find_leaks(c.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_leaks_with_substitutions(spark):
    v = [f"v{i}" for i in range(24)]
    w = list(v)
    w[6], w[17] = "other", "another"
    c = spark.createDataFrame([(1, " ".join(w))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(v))], "item_id bigint, text string")
    r = find_leaks(c, "doc_id", "text", i, "item_id", "text").collect()
    assert [(x.overlap_words, x.equal_words, x.longest_run) for x in r] == [(24, 22, 10)]


def test_leaks_with_any_substitutions(spark):
    from itertools import combinations

    v = [f"v{i}" for i in range(12)]
    places = list(combinations(range(12), 2))
    docs = [(d, " ".join("other" if i in p else w for i, w in enumerate(v))) for d, p in enumerate(places)]
    long = [f"u{i}" for i in range(60)]
    docs.append((100, " ".join("other" if i % 6 == 5 else w for i, w in enumerate(long))))
    docs.append((101, " ".join("other" if i in (1, 5, 9) else w for i, w in enumerate(v))))
    c = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(v)), (8, " ".join(long))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.equal_words) for r in find_leaks(c, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(d, 7): (12, 10) for d in range(66)} | {(100, 8): (60, 50)}


def test_leaks_at_the_first_word(spark):
    v = [f"v{i}" for i in range(12)]
    c = spark.createDataFrame([(1, " ".join(v[1:])), (2, None), (3, " ".join(v))], "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame([(7, " ".join(v))], "item_id bigint, text string")
    assert [(r.doc_id, r.longest_run) for r in find_leaks(c, "doc_id", "text", i, "item_id", "text").collect()] == [(3, 12)]


EASY = "The cat has the hat. The dog sees the box. The boy runs. "
HARD = "Notwithstanding the irrevocable administrative disqualification, contemporaneous experimentation necessitates interdisciplinary proportionality; "


def test_reading_levels(spark):
    rnd = random.Random(1)
    text = lambda lv: "".join(rnd.choices([EASY, HARD], weights=[5 - lv, lv - 1], k=12))
    docs = [(i, text(1 + i % 5), f"s{i % 3}") for i in range(300)] + [(900, None, None), (901, "", "s0"), (902, "...", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    labels = [(i, 1 + i % 5, "r1") for i in range(0, 300, 2)] + [(2, 3, "r2"), (2, 3, "r2"), (4, None, "r1"), (6, 9, "r3"), (7777, 1, "r1"), (None, 1, None)]
    lab = spark.createDataFrame(labels, "doc_id bigint, level int, rater string")
    ranks = word_ranks(d, "text", 10)
    assert ranks["the"] == 0 and len(ranks) == 10
    model = train(labelled(d, lab, "source"), ranks, Boosting(trees=30))
    got = {r.doc_id: r.level for r in levels(d, model).collect()}
    assert len(got) == 303 and got[900] is None and got[901] is None and got[902] is None
    some = {r.doc_id: r.level for r in levels(d, model, 3).collect()}
    assert some == {i: got[i] for i in range(300)}
    ends = [i for i in range(300) if i % 5 in (0, 4)]
    assert sum(got[i] == 1 + i % 5 for i in ends) / len(ends) > 0.9
    assert set(model.report) == {"s0", "s1", "s2"}
    assert word_ranks(d.limit(0), "text") == {}
    none = train(labelled(d, lab.limit(0), "source"), {})
    assert {r.level for r in levels(d, none).collect() if r.level is not None} == {3}
    assert levels(d.limit(0), model).count() == 0


def test_boosting_fits_and_is_deterministic():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + (x[:, 1] > 1)
    a, b = fit(x, y).predict(x), fit(x, y).predict(x)
    assert (a == b).all() and float(np.mean((a - y) ** 2)) < 0.05
    assert list(grade_cuts(np.array([1.0, 2.0, 3.0, 4.0, 5.0]), np.array([1.0, 2, 3, 4, 5]))) == [1.5, 2.5, 3.5, 4.5]


def test_features():
    texts = ["One two three. One, two; (four) 5!", "", "…", "日本語。日本語、です。", "a" * 300, "x.y v1.2 end", "same same. same same"]
    rows = features(texts, Lexicon({"one": 0, "two": 1}))
    assert rows.shape == (len(texts), len(FEATURES)) and not rows[1].any() and not rows[2].any() and np.isfinite(rows).all()
    f = dict(zip(FEATURES, rows[0]))
    assert f["sent_len"] == 3 and f["sent_len_sd"] == 0 and f["clause_len_p90"] == 3 and f["clauses"] == 2 and f["first_variety"] == 0.5
    assert f["top0"] == f["top1"] == 2 / 6 and f["commas"] == f["colons"] == f["numbers"] == 1 / 6 and f["brackets"] == 2 / 6 and f["unranked"] == 2 / 6
    assert f["hapax"] == 2 / 6 and f["overlap_next"] == 2 / 3 and f["word_len_p50"] == 3 and f["type_len"] == 15 / 4
    last = dict(zip(FEATURES, rows[6]))
    assert last["repeated"] == 1 and last["overlap_next"] == 1 and last["hapax"] == 0
    # The same alone as among others, and after numbering has begun anew.
    small = Lexicon({"one": 0, "two": 1})
    small.MOST = 2
    assert all((features([t], small)[0] == r).all() for t, r in zip(texts, rows)) and features([], small).shape == (0, len(FEATURES))

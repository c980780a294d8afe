import itertools
import json
import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.conversations import fold_events, messages, whole_conversations
from tessera.llm.format_copies import canonical_payload, class_counts, class_members
from tessera.llm.grouped_split import contract, deal, origin_key, tied_groups
from tessera.llm.mixture import Quota, draw_mixture, mixture_plan, quotas
from tessera.llm.split_overlap import chunk_overlap, digests, near_links, near_pairs
from tessera.runtime import shared_dir


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for x in list(up):
        out[root(x)].add(x)
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("hot", [200_000, 20])
def test_contraction_equals_union_find(spark, hot):
    rnd = random.Random(hot)
    pairs = [("hub", f"leaf{i}") for i in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    pairs += [(f"r{rnd.randrange(60)}", f"r{rnd.randrange(60)}") for _ in range(40)]
    edges = spark.createDataFrame(pairs + pairs[:5] + [("x", "x"), (None, "x")], "a string, b string")
    for few in (0, 20_000):
        got = defaultdict(set)
        for r in contract(edges, hot_rows=hot, few=few).collect():
            got[r.root] |= {r.root, r.v}
        assert {frozenset(s) for s in got.values()} == {s for s in union_find(pairs) if len(s) > 1}
        assert contract(edges.limit(0), few=few).count() == 0
    # The rounds' tables are deleted; what is left is the labelled forest.
    folder = os.path.join(shared_dir(spark), f"tessera-{spark.sparkContext.applicationId}")
    before = set(os.listdir(folder))
    contract(edges, few=0)
    assert len(set(os.listdir(folder)) - before) == 1


def test_origin_keys(spark):
    ids = ["quac_000012", "QUAC-12.v2", "quac_0/9", "12", "abc", "", "Quac_012#7"]
    got = [r.k for r in spark.createDataFrame([(i,) for i in ids], "id string").select(origin_key().alias("k")).collect()]
    assert got[0] == got[1] == got[6] and got[2] is not None and got[3:6] == [None] * 3 and got[2] != got[0]


@pytest.mark.parametrize("few", [0, 20_000])
def test_tied_groups_and_deal(spark, few):
    rows = [("a1", "x", None), ("a2", "x", "k"), ("b", None, "k"), ("c", None, None), ("d", None, None), (None, "x", None), ("c", None, None)]
    got = {r.id: (r.group_id, r.n) for r in tied_groups(spark.createDataFrame(rows, "id string, t string, n string"), ["t", "n"], few=few).collect()}
    assert got == {"a1": ("a1", 3), "a2": ("a1", 3), "b": ("a1", 3), "c": ("c", 1), "d": ("d", 1)}
    groups = spark.createDataFrame([(f"g{i}", 1 + i % 4) for i in range(2000)] + [("big", 1500)], "group_id string, n bigint")
    dealt = deal(groups, {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()
    share = defaultdict(int)
    for r in dealt:
        share[r.split] += r.n
    total = sum(share.values())
    assert len(dealt) == 2001 and abs(share["train"] / total - 0.7) < 0.01 and abs(share["test"] / total - 0.15) < 0.01
    assert next(r.split for r in dealt if r.group_id == "big") == "train"
    assert deal(groups.limit(0), {"train": 0.7, "test": 0.3}).count() == 0


def key(s):
    return "".join(c for c in (s or "").lower() if c.isalnum())


@pytest.mark.parametrize("hot", [200_000, 3])
def test_copies(spark, hot):
    rnd = random.Random(2)
    base = ["Hello, World", "hello world", "HELLO-WORLD!", "other", "  Other ", "", None, "...", "é", "É", "x" * 20000]
    rows = [(f"k{i:03}", [rnd.choice(base), *rnd.choices(base, k=rnd.randint(0, 2))]) for i in range(200)] + [(None, ["hello"])]
    t = spark.createDataFrame(rows, "id string, raw array<string>").select(F.lit("kb").alias("tbl"), "id", "raw")
    by = defaultdict(list)
    for i, raw in rows:
        if i and key(raw[0]):
            by[(key(raw[0]), *sorted(map(key, raw[1:])))].append(i)
    want = {(min(v), i) for v in by.values() for i in v if i != min(v)}
    assert {(r.first_id, r.other_id) for r in class_members([t], hot).collect()} == want
    assert {(r.first_id, r.copies) for r in class_counts([t]).collect()} == {(min(v), len(v)) for v in by.values()}
    assert class_members([t.limit(0)]).count() == 0


def test_payload_forms():
    same = ['{"a": "X y", "b": [1, {"c": null}]}', '{"b":[1.0,{"c":null}], "a":"x-Y"}', ' {"a":"xy","b":[1,{"c":null}]} ']
    assert len({canonical_payload(p) for p in same}) == 1
    other = ['{"a": "xy", "b": [{"c": null}, 1]}', '{"a": "xy", "b": [1, {}]}', '{"a": "xy", "b": [true, {"c": null}]}', '{"a": "xy", "b": ["1", {"c": null}]}', '{"a": "xy"}', '{"a": "xy", "b": null}']
    assert len({canonical_payload(p) for p in [*same, *other]}) == 1 + len(other)
    assert [canonical_payload(p) for p in (None, "", " ", "[1]", "{", "1", '{"a":}')] == [None] * 7
    assert canonical_payload(json.dumps({"a": "\ud800"})) == canonical_payload('{"a": ""}')


def test_copies_of_payloads(spark):
    rows = [("r1", ['{"a":"X"}']), ("r2", ['{"a": "x!"}']), ("r3", ["{"]), ("r4", [None]), ("r5", ['{"a":"X"}'])]
    t = spark.createDataFrame(rows, "id string, raw array<string>").select(F.lit("raw_records").alias("tbl"), "id", "raw")
    assert {(r.first_id, r.other_id) for r in class_members([t]).collect()} == {("r1", "r2"), ("r1", "r5")}


@pytest.mark.parametrize("hot", [200_000, 1])
def test_conversations(spark, hot):
    t = [("a", "1", 1, "q", "r"), ("a", "2", 2, "q", "r"), ("z", "3", 0, "q", "r"), ("gap", "4", 1, "q", "r"), ("gap", "5", 3, "q", "r"), ("dup", "6", 1, "q", "r"), ("dup", "7", 1, "q", "r"),
         ("blank", "8", 1, "?!", "r"), ("none", "9", 1, "q", None), ("late", "10", 2, "q", "r"), ("nul", "11", None, "q", "r"), (None, "12", 1, "q", "r"), ("nul", "13", 1, "q", "r")]
    df = spark.createDataFrame(t, "dialogue_key string, id string, turn_id int, query string, response string").withColumn("first", F.lit(9))
    got = whole_conversations(df, hot)
    assert sorted((r.dialogue_key, r.turn_pos, r.id) for r in got.collect()) == [("a", 1, "1"), ("a", 2, "2"), ("z", 1, "3")]
    m = sorted((r.dialogue_key, r.message_pos, r.role) for r in messages(got).collect())
    assert m == [("a", 1, "user"), ("a", 2, "assistant"), ("a", 3, "user"), ("a", 4, "assistant"), ("z", 1, "user"), ("z", 2, "assistant")]
    assert whole_conversations(df.limit(0)).count() == 0


def test_events_fold(spark):
    e = [("1", 1, "create", "a"), ("1", 3, "edit", "c"), ("1", 2, "retry", "b"), ("2", 1, "create", "x"), ("2", 2, "Delete", None), ("3", 1, "delete", None), ("3", 2, "create", "y"),
         ("4", None, "create", "n"), ("4", 5, "edit", "m"), (None, 1, "create", "q"), ("5", 7, None, "p"), ("5", 7, None, "p"), ("5", 7, None, "o")]
    df = spark.createDataFrame(e, "id string, v int, op string, text string")
    assert {r.id: r.text for r in fold_events(df, "id", "v", F.col("op"), text=F.col("text")).collect()} == {"1": "c", "3": "y", "4": "m", "5": "p"}
    assert fold_events(df.limit(0), "id", "v", None, text=F.col("text")).count() == 0


def test_quotas():
    cells = [("a", "X", 0.5, 2), ("a", "Y", 0.3, 2), ("b", "X", 0.2, 5)]
    full = {("a", "X"): 100, ("a", "Y"): 100, ("b", "X"): 100}
    assert quotas(cells, full, 50) == [Quota(25, 0, 0, 0), Quota(15, 0, 0, 0), Quota(10, 0, 0, 0)]
    short = quotas(cells, full | {("a", "X"): 10}, 50)
    assert short[0] == Quota(10, 15, 0, 0) and sum(q.quota for q in short) == 50 and short[1].quota > 15 and short[2].quota > 10
    assert quotas(cells, {}, 50) == [Quota(0, 25, 0, 2), Quota(0, 15, 0, 2), Quota(0, 10, 0, 5)]
    assert quotas([], {}, 0) == []
    # Floors beyond the sample: what is missing is shared and told.
    two = quotas([("s", "a", 0.5, 40), ("s", "b", 0.5, 80)], {("s", "a"): 100, ("s", "b"): 100}, 100)
    assert sum(q.quota for q in two) == 100 and sum(q.floor_shortfall for q in two) == 20 and all(q.unavailable == 0 and q.displaced for q in two)
    # What two cells lack is shared by those that have it.
    four = quotas([("a", "x", 0.25, 0), ("a", "y", 0.25, 0), ("b", "x", 0.25, 0), ("b", "y", 0.25, 0)], {("a", "x"): 5, ("a", "y"): 5, ("b", "x"): 999, ("b", "y"): 999}, 100)
    assert [q.quota for q in four] == [5, 5, 45, 45]
    # Targets that aren't whole: the largest fractions are rounded up.
    third = quotas([("a", "x", 0.33, 0), ("a", "y", 0.335, 0), ("b", "x", 0.335, 0)], {("a", "x"): 9, ("a", "y"): 9, ("b", "x"): 9}, 10)
    assert [(q.quota, q.displaced) for q in third] == [(3, 0), (4, 0), (3, 0)] or [(q.quota, q.displaced) for q in third] == [(3, 0), (3, 0), (4, 0)]


def test_quotas_equal_brute_force():
    """Least floors missed, then least targets missed, of all integer quotas of the sample's size."""
    rnd = random.Random(11)
    for _ in range(150):
        names = [(s, a) for s in "pq" for a in "xy"][: rnd.randint(2, 4)]
        n, weight = rnd.randint(0, 12), [rnd.randint(1, 5) for _ in names]
        cells = [(*k, w / sum(weight), rnd.choice([0, 0, 1, 3, 6])) for k, w in zip(names, weight)]
        has = {k: rnd.choice([0, 1, 2, 4, 9]) for k in names}
        got = quotas(cells, has, n)
        need = [max(c[3], math.ceil(c[2] * n)) for c in cells]
        assert [q.unavailable for q in got] == [max(0, m - has[k]) for m, k in zip(need, names)]
        size = min(n, sum(has.values()))

        def missed(q):
            floors = sum(max(0, min(c[3], has[k]) - x) for c, k, x in zip(cells, names, q))
            wholes = sum(max(0, min(max(c[3], math.floor(c[2] * n)), has[k]) - x) for c, k, x in zip(cells, names, q))
            return floors, wholes - floors

        best = min(missed(q) for q in itertools.product(*(range(has[k] + 1) for k in names)) if sum(q) == size)
        quota = [q.quota for q in got]
        assert sum(quota) == size and all(x <= has[k] for x, k in zip(quota, names)) and missed(quota) == best
        assert sum(q.displaced for q in got) == sum(best)


def test_mixture(spark):
    rows = [(f"i{k}", "a" if k % 3 else "b", "X" if k % 2 else "Y") for k in range(600)] + [("n1", None, "X"), ("n2", "a", None), (None, "a", "X")]
    r = spark.createDataFrame(rows, "id string, source string, action string")
    t = spark.createDataFrame([("a", "X", 0.4, 5), ("a", "Y", 0.4, 5), ("b", "X", 0.2, 5), ("c", "X", 0.0, 3)], "source string, action string, target_share double, min_rows int")
    plan = {(p.source, p.action): p for p in mixture_plan(r, t).collect()}
    assert [k for k, p in plan.items() if not p.met] == [("c", "X")]
    got = draw_mixture(r, t, buckets=16).collect()
    count = defaultdict(int)
    for x in got:
        count[(x.source, x.action)] += 1
    assert len({x.id for x in got}) == len(got) == 301 and all(count[k] == p.quota for k, p in plan.items())
    assert draw_mixture(r.limit(0), t).count() == 0 and mixture_plan(r, t.limit(0)).count() == 0


def brute_pairs(rows):
    import re

    sets = [(k, i, s, {w.lower() for w in re.findall(r"[^\W_]+", t or "")}) for k, i, s, t in rows if i and s]
    out = set()
    for k, i, s, a in sets:
        for k2, j, s2, b in sets:
            if k == k2 and s == "train" != s2 and a and b and i != j and 5 * len(a & b) >= 4 * len(a | b):
                out.add((k, min(i, j), max(i, j)))
    return out


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for n, size in enumerate([1, 2, 3, 4, 5, 6, 9, 13, 16, 30, 45, 78, 95, 99, 104, 121, 140, 260] * 4):
        vocab = [f"w{rnd.randrange(400)}" for _ in range(size)] + ["the"]
        for m in range(3):
            w = list(vocab)
            for _ in range(rnd.randint(0, max(1, size // 9))):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(300)}"
            rnd.shuffle(w)
            rows.append((["query", "content"][n % 2], f"id{n:03}_{m}", ["train", "test", "validation"][m], rnd.choice([" ", ", "]).join(w)))
    rows += [("query", "e1", "train", ""), ("query", "e2", "test", None), ("query", None, "train", "a b"), ("query", "e3", None, "a b"), ("query", "e4", "test", "?")]
    df = spark.createDataFrame([(k, i, s, "src", t) for k, i, s, t in rows], "kind string, id string, split string, source string, text string")
    want = brute_pairs(rows)
    assert len(want) > 30
    assert {(r.kind, r.left_id, r.right_id) for r in near_pairs(df).collect()} == want
    assert near_pairs(df.limit(0)).count() == 0
    links = defaultdict(int)
    for k, *ends in want:
        for i in ends:
            links[(k, i)] += 1
    assert {(r.kind, r.id): r.links for r in near_links(df, hot_rows=5).collect() if r.links} == links


def test_similar_records_share_a_digest():
    """Whatever the sizes, and wherever the words that differ stand in the order."""
    rnd = np.random.default_rng(7)
    for n in [*range(80, 130, 3), 150, 233, 400]:
        for _ in range(20):
            most = n // 4  # words that only one of two records has
            every = np.unique(rnd.integers(-(2**62), 2**62, n + most))
            both, others = np.split(rnd.permutation(every), [n])
            order = {w: k for k, w in enumerate(rnd.permutation(every).tolist())}
            a = rnd.integers(0, len(others) + 1)
            x, y = np.concatenate((both, others[:a])), np.concatenate((both, others[a:]))
            rec, sig = digests([np.sort(x), np.sort(y)], order, 2)
            assert set(sig[rec == 0]) & set(sig[rec == 1])


def test_copies_meet_by_class(spark):
    rows = [(f"a{i}", "train", "same words here now") for i in range(20)] + [(f"b{i}", "test", "Same, words: here NOW") for i in range(20)]
    df = spark.createDataFrame([("query", i, s, None, t) for i, s, t in rows], "kind string, id string, split string, source string, text string")
    assert near_pairs(df).count() == 400


def test_chunk_overlap(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("q", "t", "train", None, text), ("q", "same", "test", None, text.upper()), ("q", "half", "test", None, " ".join(text.split()[:30]) + " x" * 30), ("q", "new", "validation", None, "n1 n2 n3"), ("q", "none", "test", None, None)]
    got = {r.id: (r.words, r.shared) for r in chunk_overlap(spark.createDataFrame(rows, "kind string, id string, split string, source string, text string")).collect()}
    assert got["same"] == (60, 60) and 15 <= got["half"][1] <= 32 and got["new"] == (3, 0) and "none" not in got

"""Golden values of rules, and shapes that the tables don't have."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import chunk as C
from tessera.operators import dialogue as H
from tessera.operators import ftset as B
from tessera.operators import gate as D
from tessera.operators import graph as G
from tessera.operators import ingest as I
from tessera.operators import metrics as E
from tessera.operators import providers as L
from tessera.operators import retrieve as R
from tessera.operators import sampling as S
from tessera.sources import tables as T


def val(spark, col):
    return spark.range(1).select(col.alias("r")).collect()[0].r


def arr(*xs, kind="string"):
    return F.array(*map(F.lit, xs)).cast(f"array<{kind}>")


def test_difficulty(spark):
    assert [val(spark, I.difficulty(F.lit(n))) for n in range(6)] == ["easy", "medium", "medium", "hard", "hard", "very_hard"]
    assert val(spark, I.difficulty(F.lit(2), 2, 1)) == "very_hard"
    assert [val(spark, I.completeness(F.lit(a))) for a in ("ANSWER", "ASK", "ABSTAIN", "x")] == ["complete", "partial", "incomplete", "partial"]


def test_dialogues(spark, tmp_path):
    qas = [{"question": "q1", "followup": "y", "yesno": "y", "answers": [{"text": "A"}]}, {"question": "q2", "answers": []}, {"question": "q3", "followup": "n", "answers": [{"text": "B"}, {"text": "C"}]}, {"question": "q4", "followup": "y", "answers": [{"text": "CANNOTANSWER"}]}]
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"data": [{"paragraphs": [{"id": "D1", "context": "ctx", "qas": qas}]}, {"paragraphs": [{"id": "D2", "context": "c2", "qas": qas[:1]}]}]}))
    rows = I.dialogues(T.read_document(spark, str(p), schemas.DIALOGUES)).orderBy("id").collect()
    assert [(r.id, r.action, r.metadata.turn_id) for r in rows] == [("quac_000000", "ASK", 1), ("quac_000001", "ABSTAIN", 2), ("quac_000002", "ANSWER", 3), ("quac_000003", "ABSTAIN", 4), ("quac_000004", "ASK", 1)]
    assert rows[2].response == "B" and rows[1].metadata.yesno == "x" and rows[1].metadata.followup_flag == "n" and rows[0].context.documents[0].doc_id == "D1"
    assert rows[1].state.failure_mode == "INSUFFICIENT_VARIABLES" and rows[2].state.difficulty == "easy"


def test_conditional(spark, tmp_path):
    f = lambda n: [{"follow_up_question": f"f{i}", "follow_up_answer": "Yes"} for i in range(n)]
    base = {"tree_id": "T", "source_url": "u", "snippet": "S", "question": "q", "scenario": " "}
    rows = [{**base, "utterance_id": "1", "answer": "Yes"}, {**base, "utterance_id": "2", "answer": "Follow-on", "evidence": f(2), "history": f(1), "scenario": " sc "}, {**base, "utterance_id": "3", "answer": "Follow-on"}, {**base, "utterance_id": "4", "answer": "Irrelevant", "evidence": f(1)}]
    p = tmp_path / "b.json"
    p.write_text(json.dumps(rows))
    got = I.conditional(T.read_document(spark, str(p), schemas.CONDITIONAL)).orderBy("id").collect()
    assert [r.action for r in got] == ["ANSWER", "ASK", "ASK", "ABSTAIN"]
    assert got[1].state.difficulty == "very_hard" and got[1].metadata.requires_reasoning and got[1].response == "f0" and got[1].metadata.num_missing_variables == 2
    assert got[1].context.documents[0].text == "S\n\nUser Scenario: sc" and got[0].context.documents[0].text == "S" and got[2].metadata.num_missing_variables == 0


def test_multi_hop(spark, tmp_path):
    r = {"question": "q", "answer": "a", "type": "bridge", "level": "odd", "supporting_facts": {"title": ["A", "B", "Z", "A"], "sent_id": [0, 5, 0, 1]}, "context": {"title": ["A", "B", "A"], "sentences": [["x"], ["b0"], ["a0", "a1"]]}}
    p = tmp_path / "c.json"
    p.write_text(json.dumps([r]))
    g = I.multi_hop(T.read_document(spark, str(p), schemas.MULTI_HOP)).collect()[0]
    assert [(d.doc_id, d.text) for d in g.context.documents] == [("A", "a0"), ("A", "a1")]
    assert g.state.difficulty == "medium" and g.metadata.level == "odd" and g.metadata.num_supporting_facts == 4 and g.metadata.requires_reasoning and g.id == "hotpot_000000"


def test_contracts(spark, tmp_path):
    ann = {"l1": {"choice": "Entailment", "spans": [0, 9]}, "l2": {"choice": "NotMentioned", "spans": []}, "l3": {"choice": "Contradiction", "spans": [0, 1]}}
    doc = {"labels": {k: {"hypothesis": f"h{k}", "short_description": f"s{k}"} for k in ann}, "documents": [{"id": "7", "file_name": "f", "text": " abc def ", "spans": [[0, 4], [4, 9]], "annotation_sets": [{"annotations": ann}]}]}
    p = tmp_path / "d.json"
    p.write_text(json.dumps(doc))
    got = {r.metadata.label_id: r for r in I.contracts(T.read_document(spark, str(p), schemas.CONTRACTS)).collect()}
    assert [got[k].action for k in ("l1", "l2", "l3")] == ["ANSWER", "ABSTAIN", "ANSWER"]
    assert got["l1"].context.documents[0].spans == ["abc"] and got["l3"].context.documents[0].spans == ["abc", "def"] and "sl1" in got["l1"].response
    assert got["l2"].state.missing_variables == ["sl2"] and got["l2"].state.difficulty == "medium" and got["l3"].metadata.num_spans == 2
    both = I.merge(*(I.contracts(T.read_document(spark, str(p), schemas.CONTRACTS)) for _ in range(2)))
    assert both.count() == 6


def test_word_chunks(spark):
    n = lambda k: len(val(spark, C.word_chunks(F.lit("w " * k))))
    assert [n(k) for k in (0, 1, 350, 351, 650, 651)] == [1, 1, 1, 2, 2, 3]
    text = "a  b\n" * 10
    assert val(spark, C.word_chunks(F.lit(text)))[0].text == text
    w = [f"w{i}" for i in range(351)]
    c = val(spark, C.word_chunks(F.lit(" ".join(w))))
    assert c[1].text.split() == w[300:351] and c[0].total_chunks == 2
    need = lambda s, k: val(spark, C.needs_chunking(F.lit(s), F.lit(k)))
    assert [need("contract_nli", 300), need("contract_nli", 301), need("quac", 400), need("quac", 401), need("sharc", 9999)] == [False, True, False, True, False]


def test_fusion_and_hops(spark):
    d = spark.createDataFrame([("q", "a", 0.8)], "query_id string, doc_id string, score double")
    s = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 4.0)], "query_id string, doc_id string, score double")
    got = {r.doc_id: round(r.fused_score, 4) for r in R.fuse(d, s, 5).collect()}
    assert got == {"a": 0.65, "b": 0.5}
    hop = lambda t: val(spark, R.is_multihop(F.lit(t)))
    assert [hop("w " * 13), hop("candle price"), hop("who won"), hop(None)] == [True, True, False, False]


def test_dense_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id bigint, v array<double>")
    got = {}
    for r in R.dense_top_k(df, "id", "v", df.filter("id < 7"), "id", "v", 3, exclude_self=True, block=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    for q, hits in got.items():
        s = np.round(v @ v[q], 6)
        s[q] = -9
        assert [d for _, d in sorted(hits)] == [int(i) for i in sorted(range(60), key=lambda i: (-s[i], i))[:3]]
    assert len(got) == 7


def test_gate(spark):
    ev = lambda c, v, n=1: F.struct(F.lit(c).alias("confidence"), F.lit(v).alias("coverage"), F.lit(n).alias("n"))
    g = lambda f, *a: tuple(val(spark, f(a[0], *map(F.lit, a[1:]))))
    assert g(D.gate, ev(0.5, 0.5), 0.2, 0.1, "NOT_ANSWERABLE")[0] == "ANSWER"
    assert g(D.gate_strict, ev(0.5, 0.5), 0.2, 0.1, "NOT_ANSWERABLE")[0] == "ABSTAIN"
    assert g(D.gate, ev(0.5, 0.29), 0.2, 0.1, "ANSWERABLE") == ("ABSTAIN", "low_coverage")
    assert g(D.gate, ev(0.5, 0.29), 0.45, 0.7, "ANSWERABLE")[0] == "ASK"
    assert g(D.gate_strict, ev(0.0, 0.0), 0.0, 0.71, "ANSWERABLE")[0] == "ASK"
    assert g(D.gate, ev(0.0, 0.0, 0), 0.9, 0.9, "ANSWERABLE") == ("ABSTAIN", "no_context_retrieved")


def test_scores(spark):
    assert val(spark, D.ambiguity(F.lit("what is it"))) == 0.44
    assert [round(val(spark, D.unit(F.lit(x))), 4) for x in (2.0, 0.4, -1.0)] == [0.8808, 0.4, 0.2689]
    e = val(spark, D.evidence(F.lit("the Cat sat"), arr(kind="double"), arr()))
    assert (e.confidence, e.coverage, e.gap, e.mean, e.n) == (0, 0, 0, 0, 0)
    e = val(spark, D.evidence(F.lit("the Cat sat"), arr(0.6, 0.2, kind="double"), arr("concatenate", "x")))
    assert (e.confidence, e.coverage, e.gap, e.mean, e.n) == (0.6, 0.5, 0.4, 0.4, 2)
    assert val(spark, D.incompleteness(arr("a"), arr("m", "n"))) == pytest.approx(2 / 3) and val(spark, D.incompleteness(arr(), arr())) == 0
    assert [val(spark, D.as_question(F.lit(t))) for t in ("Which one.\nmore", "Why?", "", None)] == ["Which one?", "Why?", "Could you say more about this?", "Could you say more about this?"]


def test_reinforcement_order(spark):
    e = spark.createDataFrame([("a", "b", 0.8), ("c", "d", 0.7)], "src string, dst string, weight double")
    ev = spark.createDataFrame([("a", "b", "ANSWER", 1), ("a", "b", "ABSTAIN", 2), ("c", "d", "ANSWER", 2), ("c", "d", "ANSWER", 3), ("c", "d", "ABSTAIN", 4)], "src string, dst string, action string, ord bigint")
    got = {r.src: r.weight for r in G.reinforce(e, ev).collect()}
    assert got == {"a": 0.85, "c": 0.85}
    swapped = {r.src: r.weight for r in G.reinforce(e, ev.withColumn("ord", -F.col("ord"))).collect()}
    assert swapped["a"] == 0.9
    assert val(spark, G.final_weight(F.lit(1.0), F.lit(1.0))) == 1.0 and val(spark, G.final_weight(F.lit(1.0), F.lit(1.0), 0.95, 0.95)) == 0.95


def test_placeholders_and_reanchoring(spark):
    asks = spark.createDataFrame([("s1", "q", "a", "k1"), ("s1", "q", "b", "k2")], "sample_id string, query string, anchor string, kb_id string")
    nodes, edges = G.placeholders(asks)
    assert [r.node_id for r in nodes.collect()] == ["?var_s1"] and edges.count() == 2
    bad = spark.createDataFrame([("?var_s1",), ("?var_s2",)], "node string")
    best = spark.createDataFrame([("?var_s1", "z", 0.31), ("?var_s2", "z", 0.29)], "node string, anchor string, sim double")
    kept, removed = G.reanchor(edges, bad, best)
    assert [(r.src, r.dst, r.weight) for r in kept.collect()] == [("z", "?var_s1", 0.8)] and [r.node for r in removed.collect()] == ["?var_s2"]


def test_ft_rules(spark):
    t = arr("a | requires | ?var_x", "b | requires | ?var_y", "c | requires | ?var_x")
    got = val(spark, B.anonymise(t))
    assert [x.split("?")[1] for x in got] == ["unknown_1", "unknown_2", "unknown_1"]
    five = arr(*[f"x{i} | requires | ?unknown_{i}" for i in range(5)], "a | is | b")
    assert val(spark, B.cap_requires(five, F.lit("ANSWER"))) == ["a | is | b"]
    assert val(spark, B.cap_requires(five, F.lit("ASK"))) == ["a | is | b"] + [f"x{i} | requires | ?unknown_{i}" for i in range(3)]
    assert val(spark, B.validity(arr(), arr(), F.lit("ANSWER"), arr())) == "no_graph_answer"
    assert val(spark, B.validity(arr("k"), arr(), F.lit("ANSWER"), arr())) == "answer_empty_graph"
    assert val(spark, B.validity(arr("k"), arr("x | r | y"), F.lit("ANSWER"), arr())) == "answer_graph_irrelevant"
    assert val(spark, B.validity(arr(), arr(), F.lit("ASK"), arr("m"))) == "zero_signal_ask"
    assert val(spark, B.question(arr("details about 'x'"), arr("k"), F.lit("q"))) == "On k: what is x?"
    assert val(spark, B.question(arr(), arr(), F.lit(""))) == "Could you say more about this topic?"
    assert val(spark, B.specific_by(arr(0.4, kind="double"), F.lit("abcd"))) and not val(spark, B.specific_by(arr(0.5, kind="double"), F.lit("abcd")))
    turn = val(spark, B.assistant_turn(F.lit("q"), F.lit("ASK"), arr("k"), arr("m"), arr("a | is | b"), F.lit("COMPLETE")))
    assert "<decision>\nASK\n</decision>" in turn and "<clarification_question>" in turn
    msgs = B.messages("s", B.user_turn(F.lit("q"), arr(), arr(), arr()), F.lit(turn))
    assert val(spark, B.chat_text(msgs, 3)).split() == ["[system]", "s", "[user]"]


# The nine cases: (triples, placeholder, missing) and what the rule planner must decide.
CASES = [("ANSWER", 3, False, 0), ("ANSWER", 3, False, 0), ("ANSWER", 4, False, 0), ("ASK", 3, True, 1), ("ASK", 4, True, 3), ("ASK", 3, True, 2), ("ABSTAIN", 0, False, 0), ("ABSTAIN", 2, False, 1), ("ABSTAIN", 0, False, 0)]


@pytest.mark.parametrize("want,n,placeholder,missing", CASES)
def test_rule_planner(spark, want, n, placeholder, missing):
    from tessera.functions.parse import decision

    t = [f"s{i} | is | o{i}" for i in range(n)]
    if placeholder:
        t[-1] = "s | requires | ?unknown_1"
    assert val(spark, decision(L.rule_planner(arr(*t), arr(*["m"] * missing)))) == want


def test_providers(spark):
    v = val(spark, L.embed(F.lit("a b a")))
    assert len(v) == L.DIM and abs(sum(x * x for x in v) - 1) < 1e-5 and val(spark, L.embed(F.lit(None).cast("string"))) == [0.0] * L.DIM
    assert val(spark, L.overlap_score(F.lit("a b"), F.lit("b c"))) == 0.5
    with pytest.raises(RuntimeError):
        L.Providers().without_planner().plan(F.lit(1), F.lit(2))


def test_dialogue_state(spark):
    rows = [("d", 1, "ASK", ["a"], ["m", "n"]), ("d", 2, "ANSWER", ["b"], []), ("e", None, "ASK", ["z"], ["q"]), ("e", None, "ANSWER", [], None)]
    s = H.running_state(spark.createDataFrame(rows, "dialogue_id string, turn_id int, action string, known array<string>, missing array<string>"))
    got = {(r.dialogue_id, r.turn_id): r for r in s.collect()}
    r = got[("d", 2)]
    assert (r.cum_known, r.cum_resolved, r.still_missing) == (["a", "m"], ["m"], ["n"])
    assert all(r.cum_known == [] for r in s.filter("dialogue_id = 'e'").collect())
    assert [val(spark, H.turn_cap(F.lit(n))) for n in (7, 8, 15, 16, 20, 30, 31, 50, 51)] == [7, 10, 10, 15, 15, 15, 25, 25, 35]


def test_metrics(spark):
    assert val(spark, E.token_f1(F.lit("a b"), F.lit("b c"))) == 0.5 and val(spark, E.token_f1(F.lit(""), F.lit("b"))) == 0
    assert val(spark, E.exact_match(F.lit(" A\n"), F.lit("a"))) == 1
    assert E.lcs("a b c d".split(), "b x d".split()) == 2 and val(spark, E.rouge_l(F.lit("a b c d"), F.lit("b d"))) == pytest.approx(4 / 6)
    df = spark.createDataFrame([("ANSWER", "ANSWER"), ("ASK", "ANSWER"), ("ABSTAIN", "UNKNOWN"), ("ASK", "ASK")], "gt string, pred string")
    r = E.overall(df).collect()[0]
    assert (r.accuracy, r.over_answer, r.unknown_preds, r.macro_f1) == (0.5, 0.25, 1, round((2 / 3 + 2 / 3 + 0) / 3, 4))
    assert E.overall(df.limit(0)).collect()[0].n == 0


def test_splits_and_samples(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 3).alias("c"))
    share = {r.s: r["count"] for r in df.groupBy(S.hash_split(F.col("k")).alias("s")).count().collect()}
    assert abs(share["train"] - 700) < 60
    assert S.stratified(df, ["c"], "k", 5).count() == 15 and S.equal_shares(df, "c", "k", 50, 3).count() == 50
    b = S.batches(df, ["k"], 50).groupBy("batch_no").count().collect()
    assert len(b) == 20 and {r["count"] for r in b} == {50}
    sub = S.subsample(df.select(F.when(F.col("c") > 0, F.substring("k", 1, 3)).alias("g"), "k", F.lit(1).alias("t"), F.when(F.col("c") == 0, "ASK").otherwise("ANSWER").alias("a")), "g", "k", F.col("t"), "a", 200, {"ASK": 0.5, "ANSWER": 0.5})
    assert sub.count() <= 200 and sub.filter("a = 'ASK'").count() == 100


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, source string")
    p = str(tmp_path)
    T.write_lines(df, f"{p}/l")
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n{broken\n{"id":"b"}\n')
    assert T.read_lines(spark, f"{p}/bad.jsonl", "id string", tolerant=True).count() == 2
    with pytest.raises(Exception):
        T.read_lines(spark, f"{p}/bad.jsonl", "id string").collect()
    T.write_by(df, f"{p}/by", "source")
    assert {x.name for x in (tmp_path / "by").iterdir() if x.is_dir()} == {"source=x", "source=y"}
    T.write_array(df.coalesce(1), f"{p}/arr")
    assert json.loads("".join(f.read_text() for f in (tmp_path / "arr").glob("part*")))[0]["id"] in "ab"
    calls = []
    build = lambda: calls.append(1) or df
    assert T.read_or_build(spark, f"{p}/c", build).count() == 2 and T.read_or_build(spark, f"{p}/c", build).count() == 2 and len(calls) == 1
    T.append_new(spark, df.limit(1), "id", f"{p}/app", lambda d: d)
    T.append_new(spark, df, "id", f"{p}/app", lambda d: d)
    assert spark.read.parquet(f"{p}/app").count() == 2
    T.save_graph({"nodes": df, "edges": df}, f"{p}/g", "G1")
    assert set(T.load_graph(spark, f"{p}/g", "G2", "G1")) == {"nodes", "edges"}
    with pytest.raises(FileNotFoundError):
        T.first_of(spark, f"{p}/nope")


def test_streams(spark, tmp_path):
    from tessera.streaming import turns

    rows = [("d", 1, "ASK", ["a"], ["m", "n"]), ("d", 2, "ANSWER", ["b"], [])]
    schema = "dialogue_id string, turn_id int, action string, known array<string>, missing array<string>"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = turns.append_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: d)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    try:
        s = turns.dialogue_state(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("st").outputMode("append").trigger(availableNow=True).start()
    except Exception as e:  # a build of Spark without its protobuf for state servers
        pytest.skip(str(e)[:80])
    s.awaitTermination(90)
    got = {r.turn_id: (r.cum_known, r.still_missing) for r in spark.table("st").collect()}
    assert got == {1: ([], []), 2: (["a", "m"], ["n"])}


def test_lookup_of_hot_keys(spark):
    from tessera.runtime import lookup

    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), ("x", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("h", "H"), ("c", "C")], "k string, v string")
    a, b = (sorted((r.k or "", r.n, r.v or "") for r in lookup(left, "k", right, hot).collect()) for hot in (1000, 10))
    assert a == b and len(a) == 53


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("z1", "z2"), ("z2", "z2")], "src string, dst string")
    got = {r.node: r.component for r in G.components(e).collect()}
    assert {got[f"n{i:02}"] for i in range(21)} == {"n00"} and got["z2"] == "z1"


@pytest.mark.parametrize("block", [7, 64])
def test_cooccurrence_pairs_all_names(spark, block):
    from itertools import combinations

    chunks = {"wide": [f"n{i:03}" for i in range(150)], "some": [f"n{i:03}" for i in range(140, 165)], "one": ["n000"]}
    m = spark.createDataFrame([(k, n, i) for k, names in chunks.items() for i, n in enumerate(names)], "kb_id string, node string, pos int")
    want = {}
    for names in chunks.values():
        for a, b in combinations(names, 2):
            for e in ((a, b), (b, a)):
                want[e] = want.get(e, 0) + 1
    assert {(r.src, r.dst): r.weight for r in G.cooccurrence(m, block=block).collect()} == want


def test_graph_searches_start_at_every_node(spark, tmp_path):
    from tessera.plans.catalog import QUERIES

    pairs = [("Alpha", "Beta"), ("Beta", "Gamma"), ("Gamma", "Kilo"), ("Kilo", "Omega"), ("Delta", "Alpha"), ("Sigma", "Theta")]
    rows = [(f"kb_{i}", f"{a} goes to {b}.", "x") for i, (a, b) in enumerate(pairs)]
    spark.createDataFrame(rows, "kb_id string, text string, source string").write.parquet(f"{tmp_path}/kb.parquet")
    near = {}
    for a, b in [(a.lower(), b.lower()) for a, b in pairs]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    paths = {(s, s): [s] for s in near}
    front = [[s] for s in near]
    for _ in range(3):
        front = sorted([*p, n] for p in front for n in near[p[-1]] if n not in p)
        for p in front:
            paths.setdefault((p[0], p[-1]), p)
    got = QUERIES["kg_paths3"](spark, str(tmp_path)).collect()
    assert {(r.seed, r.node): r.path.split(">") for r in got} == paths and len(got) == len(paths)
    egos = {s: {n for (a, n), p in paths.items() if a == s and len(p) <= 3} for s in near}
    assert {r.seed: (r.nodes, r.first_node, r.last_node) for r in QUERIES["kg_ego2"](spark, str(tmp_path)).collect()} == {s: (len(e), min(e), max(e)) for s, e in egos.items()}
    triples = {s: sorted((f"{a.lower()} | goes | {b.lower()}" for a, b in pairs if {a.lower(), b.lower()} <= e), reverse=True) for s, e in egos.items()}
    out = {}
    for r in sorted(QUERIES["kg_seed_triples"](spark, str(tmp_path)).collect(), key=lambda r: r.rank):
        out.setdefault(r.seed, []).append(r.triple)
    assert out == triples


def test_texts_are_read_to_their_end(spark):
    text = "x " * 3000 + "Omega sees the Theta"
    assert val(spark, G.capitalised(F.lit(text))) == ["Omega", "Theta"]
    assert [(t.s, t.r, t.o) for t in val(spark, L.verb_triples(F.lit(text)))] == [("omega", "sees", "theta")]
    assert val(spark, L.overlap_score(F.lit("theta x"), F.lit(text))) == 1.0


def test_edges_are_scored_by_their_chunks(spark, tmp_path):
    from tessera.plans.catalog import QUERIES

    texts = ["Alpha goes to Beta", "Alpha goes to Gamma " + " ".join(f"w{i}" for i in range(80)), "Alpha goes to Beta " + "more " * 9]
    rows = [(f"kb_{i}", t, "x", ["ANSWER"]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "kb_id string, text string, source string, linked_actions array<string>").write.parquet(f"{tmp_path}/kb.parquet")
    vec = lambda t: np.array(L.hashed_vectors([t])[0], np.float64)
    score = lambda e, at: round(min(1.0, max(vec(e) @ vec(texts[i]) for i in at) + 0.03 * np.log1p(len(at))), 4)
    beta, gamma = score("alpha goes beta", (0, 2)), score("alpha goes gamma", (1,))
    assert gamma < 0.5 < beta
    assert [(r.dst, r.sem_score) for r in QUERIES["kg_validate"](spark, str(tmp_path)).collect()] == [("beta", pytest.approx(beta, abs=1e-4))]
    got = {r.dst: r.final_weight for r in QUERIES["kg_reinforce"](spark, str(tmp_path)).collect()}
    assert got == {"beta": pytest.approx(min(1.0, 0.5 * beta + 0.5 * 0.6), abs=1e-4), "gamma": pytest.approx(0.5 * gamma + 0.5 * 0.3, abs=1e-4)}


def test_gates_see_conflict(spark, tmp_path):
    from tessera.plans.catalog import QUERIES

    docs = [(i, f"it {' '.join(f'{w}{i}' for w in 'abcdefgh')}") for i in range(4)] + [(9, "same words"), (10, "same words")]
    docs += [(20 + i, f"plain filler {i}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "it something", "ASK"), (2, "same words", "ANSWER")]
    spark.createDataFrame(items, "item_id bigint, query string, gt_action string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {r.item_id: r for r in QUERIES["hard_gate_strict"](spark, str(tmp_path)).collect()}
    assert got[1].reason == "context_conflict" and got[2].reason != "context_conflict"
    both = spark.createDataFrame([(1, ["a b", "c d"]), (2, ["a b", "a b"]), (3, ["a"]), (4, [])], "k int, t array<string>")
    assert {r.k: r.con for r in D.text_conflict(both, "k", "t", L.embed).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_turn_cap_keeps_short_dialogues_whole(spark, monkeypatch):
    from tessera.plans import table_queries as Q

    rows = [(f"{d}{t:02}", d, t, True) for d, n in (("a", 5), ("b", 7), ("c", 8), ("d", 20)) for t in range(n)]
    monkeypatch.setattr(Q, "samples", lambda spark, d: spark.createDataFrame(rows, "id string, dialogue_id string, turn_id int, multi_turn boolean"))
    assert {r.dialogue_id: r["count"] for r in Q.turn_cap(spark, "").groupBy("dialogue_id").count().collect()} == {"a": 5, "b": 7, "c": 8, "d": 15}
    other = H.capped(spark.createDataFrame(rows, "id string, dialogue_id string, turn_id int, multi_turn boolean"), cap=lambda n: H.turn_cap(n, ((5, 2), (10, 4)), 2, 8))
    assert {r.dialogue_id: r["count"] for r in other.groupBy("dialogue_id").count().collect()} == {"a": 2, "b": 4, "c": 4, "d": 8}

from pyspark.sql import functions as F

from tessera.functions import parse as P
from tessera.functions import text as X


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(col.alias("r")).collect()[0].r


def test_white_space(spark):
    for t in [" a  b ", "a b", "　x y\n", "", " ", "a\x1cb", None]:
        want = [w for w in __import__("re").split(f"[{X.WS}]+", t or "") if w]
        assert one(spark, X.ws_words("t"), t) == want
        assert one(spark, X.ws_count("t"), t) == len(want)
        assert X.split_words(t or "") == want
    every = "x".join(map(chr, (*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF)))
    want = [w for w in __import__("re").split(f"[{X.WS}]+", every) if w]
    assert one(spark, X.ws_count("t"), every) == len(want) == len(X.split_words(every)) and one(spark, X.ws_words("t"), every) == want
    assert one(spark, X.strip("t"), "\n  a b　") == "a b"
    long = " " * 300_000
    assert one(spark, X.strip("t"), f"{long}a{long}b{long}") == f"a{long}b" and one(spark, X.strip("t"), long) == ""
    assert one(spark, X.squash("t"), " a \n b ") == "a b"


def test_keys_and_labels(spark):
    assert one(spark, X.key("t"), "--A, b!! \u00a0 c--") == "abc" and one(spark, X.alnum_words("t"), "--A, b!! \u00a0 c_d--") == ["a", "b", "c", "d"]
    assert one(spark, X.key("t"), "Contract-NLI \n2²") == "contractnli2²"
    assert one(spark, X.key("t"), None) is None
    assert [one(spark, X.is_blank("t"), t) for t in (None, "", "?!\n", "a")] == [True, True, True, False]
    assert one(spark, X.alnum_words("t"), "It's ÉTÉ_2, ok") == ["it", "s", "été", "2", "ok"]
    assert [one(spark, X.split_label("t"), t) for t in (" Training\n", "DEV", "valid", "test", "x", None)] == ["train", "validation", "validation", "test", None, None]
    assert [one(spark, X.action_label("t"), t) for t in (" ask ", "Answer", "no", None)] == ["ASK", "ANSWER", None, None]
    assert [one(spark, X.lang_label("t"), t) for t in ("en-EN", "FR", "und", None, "", "english")] == ["en", "fr", "unknown", "unknown", "unknown", "unknown"]


def test_ids_and_names(spark):
    assert [spark.range(1).select(P.numbered_id("quac", F.lit(n))).collect()[0][0] for n in (0, 1234567)] == ["quac_000000", "quac_1234567"]
    assert one(spark, P.plain_name("t"), "  The  Big\nCo. ") == "the big co."
    assert one(spark, P.bare_name("t"), "The Big-Co. É") == "the big-co"
    assert [one(spark, P.is_numeric("t"), t) for t in ("1,2 - 3/4", "1a")] == [True, False]
    assert one(spark, P.fingerprint("t"), "abc") == "900150983cd24fb0d6963f7d28e17f72"


def test_sentences(spark):
    assert one(spark, P.sentences("t"), " One. Two!? three") == ["One.", "Two!?", "three"]
    assert one(spark, P.sentences("t"), None) == [] and one(spark, P.sentences("t"), "...") == []


def test_reply_parsers(spark):
    reply = "x<decision>\n ask \n</decision> <decision>ANSWER</decision>"
    assert one(spark, P.decision("t"), reply) == "ASK"
    assert [one(spark, P.decision("t"), t) for t in ("", None, "<decision>maybe</decision>", "<decision>ASK")] == ["UNKNOWN"] * 4
    assert one(spark, P.decision("t", "ABSTAIN"), "") == "ABSTAIN"
    text = "ACTION: ANSWER\nRESPONSE: no\n ACTION: ask it\nRESPONSE:  yes: so "
    assert one(spark, P.reply_action("t"), text) == "ASK" and one(spark, P.key_line("t", "RESPONSE"), text) == "yes: so"
    assert one(spark, P.reply_action("t"), "nothing") == "ABSTAIN"
    assert [one(spark, P.answerability("t"), t) for t in ("LABEL: ANSWERABLE", "NEEDS_CLARIFICATION\nREASON: x", "NOT_ANSWERABLE", "?", None)] == ["ANSWERABLE", "NEEDS_CLARIFICATION", "NOT_ANSWERABLE", "NOT_ANSWERABLE", "NOT_ANSWERABLE"]
    assert one(spark, P.numbered_list("t"), "1. a\n2. b. c\nx\n10. ") == ["a", "b. c"]


def test_variables_reply(spark):
    t = '```json\n{"known_variables": [" a ", "", "b"], "missing_variables": ["m"]}\n```'
    r = one(spark, P.variables_reply("t", F.lit("ASK")), t)
    assert (r.known, r.missing) == (["a", "b"], ["m"])
    assert one(spark, P.variables_reply("t", F.lit("ANSWER")), t).missing == []
    assert one(spark, P.variables_reply("t", F.lit("ASK")), "not json").known == []


def test_triples(spark):
    assert one(spark, P.triple_text(F.lit("a"), F.lit("part_of"), F.lit("b")), "") == "a | part of | b"
    assert one(spark, P.triple_parts(F.col("t")), "a | r | b").o == "b" and one(spark, P.triple_parts(F.col("t")), "a | b") is None

"""Four raw sources, each of another shape, as unified samples.

Every builder is one select over the parsed source: unnesting by posexplode, look-ups inside a row by map, labels by CASE.
Ordinals come from the position in the source, by ranges of it, so ids don't depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.parse import numbered_id
from ..functions.text import strip
from ..runtime import numbered_rows


@dataclass(frozen=True)
class Replies:
    """Wording of responses that a source doesn't give; {0} is the subject."""

    cannot: str = "The material given does not tell."
    more: str = "Which further details can you give?"
    undecided: str = "The rules given do not settle this."
    holds: str = "Yes, the text provides for this: {0}."
    against: str = "No, the text rules this out: {0}."
    silent: str = "The text says nothing about this: {0}."


#: What a dialogue source gives as the answer where there is none. Fixed value.
NO_ANSWER = "CANNOTANSWER"


def difficulty(missing: Column, evidence: Column | int = 0, hops: Column | int = 0) -> Column:
    """easy, medium, hard or very_hard, by missing values, evidence and hops together."""
    score = missing + (F.lit(evidence) if isinstance(evidence, int) else evidence) + (F.lit(hops) if isinstance(hops, int) else hops)
    return F.when(score == 0, "easy").when(score <= 2, "medium").when(score <= 4, "hard").otherwise("very_hard")


def failure_mode(action: Column, missing: Column, multi_hop: Column | None = None) -> Column:
    lacking = F.when((action == "ASK") | (missing > 0), "INSUFFICIENT_VARIABLES").otherwise("COMPLETE")
    return lacking if multi_hop is None else F.when(multi_hop, "MULTI_HOP_REQUIRED").otherwise(lacking)


def completeness(action: Column) -> Column:
    return F.when(action == "ANSWER", "complete").when(action == "ABSTAIN", "incomplete").otherwise("partial")


def label_of_dialogue(answer: Column, followup: Column) -> Column:
    return F.when(answer == NO_ANSWER, "ABSTAIN").when(followup == "y", "ASK").otherwise("ANSWER")


def label_of_conditional(answer: Column) -> Column:
    return F.when(answer.isin("Yes", "No"), "ANSWER").when(answer == "Follow-on", "ASK").otherwise("ABSTAIN")


def label_of_contract(choice: Column) -> Column:
    return F.when(choice.isin("Entailment", "Contradiction"), "ANSWER").otherwise("ABSTAIN")


def spans_of(text: Column, bounds: Column, idx: Column) -> Column:
    """The stripped spans of ``text`` whose numbers are in ``idx``; numbers beyond ``bounds`` are skipped."""
    inside = F.filter(idx, lambda i: (i >= 0) & (i < F.size(bounds)))
    return F.transform(inside, lambda i: strip(F.substring(text, F.get(F.get(bounds, i), F.lit(0)) + 1, F.get(F.get(bounds, i), F.lit(1)) - F.get(F.get(bounds, i), F.lit(0)))))


def supporting(titles: Column, sent_ids: Column, ctx_titles: Column, sents: Column) -> Column:
    """Supporting sentences as documents: by title, of a title given twice the last; absent titles and numbers are skipped."""
    facts = F.arrays_zip(titles.alias("t"), sent_ids.alias("s"))

    def look(f: Column) -> Column:
        at = F.array_max(F.filter(F.transform(ctx_titles, lambda t, i: F.when(t == f["t"], i)), lambda i: i.isNotNull()))
        return F.struct(f["t"].alias("doc_id"), F.get(F.get(sents, at), F.when(f["s"] >= 0, f["s"])).alias("text"))

    return F.filter(F.transform(facts, look), lambda d: d["text"].isNotNull())


def _num(c: Column | int | bool | str | None, kind: str) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(kind)


def _unified(df: DataFrame, prefix: str, ordinal: Column, source: str, *, query: Column, documents: Column, action: Column, response: Column, missing_vars: Column | None = None,
             known_vars: Column | None = None, num_missing: Column, hardness: Column, mode: Column, **meta) -> DataFrame:
    none = F.array().cast("array<string>")
    fields = dict(f.split(":", 1) for f in _top_fields(S.METADATA))
    meta = {"num_missing_variables": num_missing, "variable_types": none, "multi_turn": False, "requires_reasoning": False, "source": source, **meta}
    metadata = F.struct(*(_num(meta.get(n), k).alias(n) for n, k in fields.items()))
    return df.select(
        numbered_id(prefix, ordinal).alias("id"), query.alias("query"),
        F.struct(documents.cast("array<struct<doc_id:string,text:string,url:string,file_name:string,spans:array<string>>>").alias("documents")).alias("context"),
        F.struct((known_vars if known_vars is not None else none).alias("known_variables"), (missing_vars if missing_vars is not None else none).alias("missing_variables"),
                 none.alias("constraints"), mode.alias("failure_mode"), hardness.alias("difficulty"), completeness(action).alias("completeness")).alias("state"),
        action.alias("action"), response.alias("response"), metadata.alias("metadata"),
    )


def _top_fields(struct: str) -> list[str]:
    out, depth, start, body = [], 0, 0, struct[len("struct<") : -1]
    for i, ch in enumerate(body):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


def _document(doc_id: Column, text: Column, url: Column | None = None, file_name: Column | None = None, spans: Column | None = None) -> Column:
    null = lambda c, k: (c if c is not None else F.lit(None)).cast(k)
    return F.struct(doc_id.alias("doc_id"), text.alias("text"), null(url, "string").alias("url"), null(file_name, "string").alias("file_name"), null(spans, "array<string>").alias("spans"))


def dialogues(raw: DataFrame, replies: Replies = Replies()) -> DataFrame:
    """Articles -> paragraphs -> questions, one sample a question. A missing follow-up flag is "n", no answer is NO_ANSWER."""
    q = (
        raw.select(F.posexplode("data").alias("a", "article"))
        .select("a", F.posexplode("article.paragraphs").alias("p", "para"))
        .select("a", "p", F.col("para.context").alias("ctx"), F.coalesce("para.id", F.md5(F.coalesce("para.context", F.lit("")))).alias("did"), F.posexplode("para.qas").alias("k", "qa"))
        .withColumn("answer", F.coalesce(F.get("qa.answers", F.lit(0))["text"], F.lit(NO_ANSWER)))
        .withColumn("followup", F.coalesce("qa.followup", F.lit("n")))
    )
    q = numbered_rows(q, ["a", "p", "k"], "n")
    action = label_of_dialogue(F.col("answer"), F.col("followup"))
    missing = F.when(action == "ANSWER", 0).otherwise(1)
    response = F.when(action == "ABSTAIN", replies.cannot).when(action == "ASK", replies.more).otherwise(F.col("answer"))
    return _unified(
        q, "quac", F.col("n"), "quac", query=F.col("qa.question"), documents=F.array(_document(F.col("did"), F.coalesce("ctx", F.lit("")))), action=action, response=response,
        num_missing=missing, hardness=difficulty(missing), mode=failure_mode(action, missing), multi_turn=True, turn_id=F.col("k") + 1, dialogue_id=F.col("did"),
        yesno=F.coalesce("qa.yesno", F.lit("x")), followup_flag=F.col("followup"),
    )


def conditional(raw: DataFrame, replies: Replies = Replies(), order: str = "utterance_id") -> DataFrame:
    """One sample a row; a non-blank scenario is appended to the snippet; evidence questions are what is missing."""
    none = F.array().cast("array<struct<follow_up_question:string,follow_up_answer:string>>")
    r = raw.withColumns({"ev": F.coalesce("evidence", none), "hi": F.coalesce("history", none), "sc": strip(F.coalesce("scenario", F.lit("")))})
    r = numbered_rows(r, [order], "n")
    action = label_of_conditional(F.col("answer"))
    asked = F.transform("ev", lambda e: e["follow_up_question"])
    missing = F.when(action == "ASK", F.size("ev")).when(action == "ABSTAIN", 1).otherwise(0)
    text = F.concat(F.coalesce("snippet", F.lit("")), F.when(F.col("sc") != "", F.concat(F.lit("\n\nUser Scenario: "), "sc")).otherwise(""))
    response = F.when(action == "ANSWER", F.col("answer")).when(action == "ASK", F.coalesce(F.get(asked, F.lit(0)), F.lit(replies.more))).otherwise(replies.undecided)
    return _unified(
        r, "sharc", F.col("n"), "sharc", query=F.col("question"), documents=F.array(_document(F.col("tree_id"), text, F.coalesce("source_url", F.lit("")))), action=action, response=response,
        missing_vars=asked, num_missing=missing, hardness=difficulty(missing, F.size("ev"), F.size("hi")), mode=failure_mode(action, missing), multi_turn=F.size("hi") > 0,
        dialogue_id=F.col("tree_id"), requires_reasoning=F.size("ev") > 1, utterance_id=F.col("utterance_id"), sharc_answer=F.col("answer"), evidence_depth=F.size("ev"), history_depth=F.size("hi"),
    )


def multi_hop(raw: DataFrame, order: str = "question") -> DataFrame:
    """One ANSWER a row, its documents the supporting sentences; an unknown level is medium."""
    docs = supporting(F.col("supporting_facts.title"), F.col("supporting_facts.sent_id"), F.col("context.title"), F.col("context.sentences"))
    return _unified(
        numbered_rows(raw, [order], "n"), "hotpot", F.col("n"), "hotpotqa", query=F.col("question"), documents=F.transform(docs, lambda d: _document(d["doc_id"], d["text"])),
        action=F.lit("ANSWER"), response=F.col("answer"), num_missing=F.lit(0), hardness=F.when(F.col("level").isin("easy", "medium", "hard"), F.col("level")).otherwise("medium"),
        mode=F.lit("COMPLETE"), requires_reasoning=F.coalesce(F.col("type") == "bridge", F.lit(False)), question_type=F.coalesce("type", F.lit("")),
        level=F.coalesce("level", F.lit("")), num_supporting_facts=F.size("supporting_facts.title"),
    )


def contracts(raw: DataFrame, replies: Replies = Replies()) -> DataFrame:
    """One sample a document, annotation set and label; the label dictionary is looked up inside the row."""
    a = (
        raw.select("labels", F.posexplode("documents").alias("d", "doc"))
        .select("labels", "d", "doc", F.posexplode("doc.annotation_sets").alias("s", "aset"))
        .select("labels", "d", "doc", "s", F.explode("aset.annotations").alias("label_id", "ann"))
        .withColumn("short", F.element_at("labels", F.col("label_id"))["short_description"])
        .withColumn("hyp", F.element_at("labels", F.col("label_id"))["hypothesis"])
    )
    a = numbered_rows(a.drop("labels"), ["d", "s", "label_id"], "n")
    choice = F.col("ann.choice")
    action = label_of_contract(choice)
    missing, hops = F.when(action == "ANSWER", 0).otherwise(1), F.size("ann.spans")
    say = lambda t: F.replace(F.lit(t), F.lit("{0}"), F.col("short"))
    response = F.when(choice == "Entailment", say(replies.holds)).when(choice == "Contradiction", say(replies.against)).otherwise(say(replies.silent))
    return _unified(
        a, "cnli", F.col("n"), "contract_nli", query=F.col("hyp"),
        documents=F.array(_document(F.col("doc.id"), F.col("doc.text"), file_name=F.coalesce("doc.file_name", F.lit("")), spans=spans_of(F.col("doc.text"), F.col("doc.spans"), F.col("ann.spans")))),
        action=action, response=response, known_vars=F.array("short"), missing_vars=F.when(action == "ANSWER", F.array().cast("array<string>")).otherwise(F.array("short")), num_missing=missing,
        hardness=difficulty(missing, 0, hops), mode=failure_mode(action, missing), variable_types=F.array(F.lit("constraint")), requires_reasoning=hops > 1, label_id=F.col("label_id"),
        nli_choice=choice, num_spans=hops,
    )


def merge(*parts: DataFrame) -> DataFrame:
    """All sources, one after the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def context_text(c: str = "context.documents") -> Column:
    """Trimmed non-blank document texts joined by a blank; empty if there are none."""
    docs = F.coalesce(F.transform(c, lambda d: strip(F.coalesce(d["text"], F.lit("")))), F.array().cast("array<string>"))
    return F.array_join(F.filter(docs, lambda t: t != ""), " ")

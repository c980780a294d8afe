"""Problem 7: the same or nearly the same records in different splits.

Two operators. ``chunk_overlap`` is the method by content-defined chunks: normalised records are cut by a rolling hash, chunk
digests are joined across splits, and the lengths of shared chunks add up to a record's overlap. ``near_pairs`` gives all pairs
of a word-set similarity. Chunks alone can't: in a query of 13 words, one word changed in each of two or three places breaks
every chunk (the README has the measured share). So there the records' rarest words are combined into digests of which similar
records surely share one, and pairs that meet are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_words
from ..runtime import cut, lookup

# ---------------------------------------------------------------- content-defined chunks


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def chunk(hashes: np.ndarray, window: int = 2, mean_words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(digests, lengths in words) of the chunks of one record's word hashes: a chunk ends after a word at which the rolling
    hash of the last ``window`` words is divisible by ``mean_words``, and at the end of the record."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = hashes.astype(np.uint64)
    roll = np.zeros(n, np.uint64)
    for j in range(window):
        roll[j:] += h[: n - j] * np.uint64(2 * j + 3)
    ends = np.flatnonzero(_spread(roll) % np.uint64(mean_words) == 0) + 1
    ends = ends if len(ends) and ends[-1] == n else np.append(ends, n)
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(n) - np.repeat(starts, ends - starts)
    return np.add.reduceat(_spread(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts).astype(np.int64), (ends - starts).astype(np.int32)


def chunk_overlap(records: DataFrame, window: int = 2, mean_words: int = 3) -> DataFrame:
    """(kind, id, split, source, words BIGINT, shared BIGINT): of each validation or test record, its words and those in chunks
    that some train record of the same kind has too. Records without words have no row.

    A report of shared passages, not a search for similar records: of the pairs that ``near_pairs`` finds, four fifths of the
    words lie in shared chunks for about 63 % (37 of 59 query pairs, 12 of 19 contents on sf0.01).

    ``records``: kind, id, split, source, text. What crosses the network are digests; train's are deduplicated before they
    are joined, so that no pair of records is ever formed.
    """
    hashed = records.filter(F.col("split").isNotNull()).select("kind", "id", "split", "source", F.transform(alnum_words("text"), lambda w: F.xxhash64(w)).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut_up = [chunk(np.asarray(h), window, mean_words) for h in pdf["h"]]
            out = pdf[["kind", "id", "split", "source"]].loc[pdf.index.repeat([len(d) for d, _ in cut_up])].reset_index(drop=True)
            out["digest"] = np.concatenate([d for d, _ in cut_up]) if cut_up else []
            out["words"] = np.concatenate([n for _, n in cut_up]) if cut_up else []
            yield out

    kinds = dict(records.dtypes)
    chunks = hashed.mapInPandas(run, f"kind string, id {kinds['id']}, split string, source string, digest bigint, words int")
    held = chunks.filter("split <> 'train'")
    seen = chunks.filter("split = 'train'").select("kind", "digest").distinct().withColumn("there", F.lit(1))
    return held.join(seen, ["kind", "digest"], "left").groupBy("kind", "id", "split", "source").agg(
        F.sum("words").alias("words"), F.sum(F.when(F.col("there") == 1, F.col("words")).otherwise(0)).alias("shared")
    )


# ---------------------------------------------------------------- all pairs of a similarity

#: Records of at most LONG words meet by combinations of words, longer ones by pairs of words near each other in the order;
#: records within a fifth of LONG do both, so that no pair falls between.
LONG = 100


@lru_cache(maxsize=512)
def _choices(k: int, size: int) -> np.ndarray:
    """All combinations of ``size`` of the first ``k`` words; for size 0, pairs of at most three places apart."""
    if not size:
        return np.array([(i, j) for i in range(k) for j in range(i + 1, min(k, i + 4))], np.int64).reshape(-1, 2)
    return np.array(list(combinations(range(k), size)), np.int64).reshape(-1, size)


def digests(hashes: list[np.ndarray], common: dict[int, int], size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(record number, digest) such that records with at least 80 % of their joint words in common share a digest, unless
    their word sets are equal.

    A record of n words must share m = ceil(0.8 n) of them. In an order that is the same for all records, rarest first, the
    first n - m + s words of two such records have s words in common; so each combination of s of them is a digest.

    For long records those would be too many. They differ in at most d = n // 4 words, all told. With s = d // 3 + 2 words in
    common there are more than d / 3 steps from one of these to the next, so over one of them lie at most two of the d words,
    and the pair is at most three places apart in both records. So pairs of such places among the first n - m + s words are
    digests: two words each, about nine for ten words of a record, however long it is. ``seed`` keeps kinds apart.
    """
    by: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
    for i, h in enumerate(hashes):
        n = len(h)
        if n < 4:
            continue  # similar sets of three words are equal
        df = np.fromiter((common.get(x, 0) for x in h.tolist()), np.int64, n)
        h = h[np.lexsort((h, df))]
        spare = n - (4 * n + 4) // 5
        for s in ([size] if n <= LONG * 5 // 4 else []) + ([0] if n >= LONG * 4 // 5 else []):
            k = min(n, spare + (s or n // 4 // 3 + 2))
            rec, mat = by.setdefault((s, k), ([], []))
            rec.append(i)
            mat.append(h[:k])
    recs, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (s, k), (rec, mat) in by.items():
        m, c = np.array(mat).astype(np.uint64), _choices(k, s)
        sig = np.full((len(rec), len(c)), seed * 4 + s, np.uint64)
        for j in range(c.shape[1]):
            sig = _spread(sig * np.uint64(0x9E3779B97F4A7C15) + m[:, c[:, j]])
        recs.append(np.repeat(rec, len(c)))
        sigs.append(sig.ravel().astype(np.int64))
    return np.concatenate(recs), np.concatenate(sigs)


def _bitmap(h: np.ndarray) -> int:
    """64 parities; two sets differ in at least as many words as their bitmaps in bits."""
    bits = np.bincount((h.astype(np.uint64) % np.uint64(64)).astype(np.int64), minlength=64) & 1
    return int(np.packbits(bits.astype(np.uint8)).view(">i8")[0])


def _near_classes(records: DataFrame, most_common: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(rows, linked): kind, id, split, source, w, c of every record that takes part, c naming the class of records with the same
    words, and the pairs (kind, ct, ce) of classes of which a train and a validation or test record are similar.

    Only classes are compared, so copies cost no comparisons. The words told apart by frequency are at most ``most_common``,
    whatever the input, as each makes up at least that share of all words; the rest count as rare alike. Candidates are tested
    inside the join by sizes and bitmaps, before a pair of rows is made.
    """
    rows = records.filter(F.col("id").isNotNull() & F.col("split").isNotNull()).withColumn("w", F.array_sort(F.array_distinct(alnum_words("text")))).filter(F.size("w") > 0)
    rows = cut(rows.select("kind", "id", "split", "source", "w", F.sha2(F.concat_ws(" ", "w"), 256).alias("c")))
    is_train = F.col("split") == "train"
    classes = cut(rows.groupBy("kind", "c").agg(F.max("w").alias("w"), F.max(is_train).alias("t"), F.max(~is_train).alias("e")))
    # Digests carry 64 bits of a class. Two classes that share them meet their candidates together; words decide.
    brief = F.xxhash64("kind", "c")
    hashed = classes.select("kind", brief.alias("x"), "t", "e", F.array_sort(F.transform("w", lambda w: F.xxhash64(w))).alias("h"))
    size = {r.kind: (3 if r.n < 24 else 2, r.total) for r in classes.groupBy("kind").agg(F.avg(F.size("w")).alias("n"), F.sum(F.size("w")).alias("total")).collect()}
    total = sum(t for _, t in size.values())
    often = hashed.select(F.explode("h").alias("h")).groupBy("h").count().filter(F.col("count") > max(8, total // most_common))
    sent = records.sparkSession.sparkContext.broadcast({r.h: r["count"] for r in often.collect()})
    sizes = {k: (s, i) for i, (k, (s, _)) in enumerate(sorted(size.items()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, x, h = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2)
            ends, flat = h.offsets.to_numpy(), h.values.to_numpy(zero_copy_only=False)
            sets = [flat[a:z] for a, z in zip(ends[:-1], ends[1:])]
            for kind in set(kinds.tolist()):
                at = np.flatnonzero(kinds == kind)
                for part in np.array_split(at, len(at) // 1000 + 1):
                    own = [sets[i] for i in part]
                    rec, sig = digests(own, sent.value, *sizes[kind])
                    bits, n = np.array([_bitmap(s) for s in own], np.int64), np.array([len(s) for s in own], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (sig, x[part][rec], n[rec], bits[rec])], ["sig", "x", "n", "b"])

    def signed(side: str) -> DataFrame:
        of = hashed.filter(side).select("kind", "x", "h").mapInArrow(run, "sig bigint, x bigint, n int, b bigint")
        return of.select("sig", *(F.col(c).alias(side + c) for c in ("x", "n", "b")))

    apart = F.bit_count(F.col("tb").bitwiseXOR(F.col("eb")))
    close = (F.col("tx") != F.col("ex")) & (9 * apart <= F.col("tn") + F.col("en")) & (5 * F.least("tn", "en") >= 4 * F.greatest("tn", "en"))
    met = cut(signed("t").join(signed("e"), "sig").filter(close).select("tx", "ex").distinct())
    words = lambda side: classes.filter(side).select(*(F.col(c).alias(side + c) for c in ("kind", "c", "w")), brief.alias(side + "x"))
    both = met.join(words("t"), "tx").join(words("e"), "ex").filter((F.col("tkind") == F.col("ekind")) & (F.col("tc") != F.col("ec")))
    shared = F.size(F.array_intersect("tw", "ew"))
    similar = both.filter(5 * shared >= 4 * (F.size("tw") + F.size("ew") - shared)).select(F.col("tkind").alias("kind"), F.col("tc").alias("ct"), F.col("ec").alias("ce"))
    linked = similar.unionByName(classes.filter("t and e").select("kind", F.col("c").alias("ct"), F.col("c").alias("ce")))
    return rows, linked


def near_pairs(records: DataFrame, most_common: int = 100_000) -> DataFrame:
    """(kind, left_id, right_id, left_split, right_split, left_source, right_source) of all pairs of a train record and a
    validation or test record (left and right by id, the smaller first) of the same kind, whose word sets have at least 80 %
    of their union in common. Empty sets never count; rows with an unknown split or without id take no part.

    ``records``: kind, id, split, source, text; one row per id. Members are joined on to similar classes at the end, as this
    result is defined by pairs; ``near_links`` says the same without them.
    """
    rows, linked = _near_classes(records, most_common)
    is_train = F.col("split") == "train"
    end = lambda which, c, p: rows.filter(which).select("kind", F.col("c").alias(c), *(F.col(x).alias(p + x) for x in ("id", "split", "source")))
    out = linked.join(end(is_train, "ct", "t_"), ["kind", "ct"]).join(end(~is_train, "ce", "e_"), ["kind", "ce"]).filter("t_id <> e_id")
    first = F.col("t_id") < F.col("e_id")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return out.select(
        "kind",
        *(pick(f"{a}_{x}", f"{b}_{x}").alias(f"{side}_{x}") for side, a, b in (("left", "t", "e"), ("right", "e", "t")) for x in ("id", "split", "source")),
    )


def near_links(records: DataFrame, most_common: int = 100_000, hot_rows: int = 200_000) -> DataFrame:
    """(kind, id, split, source, class_id, links BIGINT): every record with words, the smallest id of those with the same words,
    and how many records across the train border are similar to it. Sums run over classes; no pair of records is formed."""
    rows, linked = _near_classes(records, most_common)
    is_train = F.col("split") == "train"
    sizes = rows.groupBy("kind", "c").agg(F.min("id").alias("class_id"), F.count_if(is_train).alias("t"), F.count_if(~is_train).alias("e"))
    size = lambda c, n: sizes.select("kind", F.col("c").alias(c), F.col(n).alias("n"))
    of_train = linked.join(size("ce", "e"), ["kind", "ce"]).groupBy("kind", F.col("ct").alias("c")).agg(F.sum("n").alias("t_links"))
    of_held = linked.join(size("ct", "t"), ["kind", "ct"]).groupBy("kind", F.col("ce").alias("c")).agg(F.sum("n").alias("e_links"))
    each = sizes.join(of_train, ["kind", "c"], "left").join(of_held, ["kind", "c"], "left").select(F.concat("kind", F.lit("|"), "c").alias("_k"), "class_id", "t_links", "e_links")
    named = lookup(rows.select("kind", "id", "split", "source", F.concat("kind", F.lit("|"), "c").alias("_k")), "_k", each, hot_rows)
    return named.select("kind", "id", "split", "source", "class_id", F.coalesce(F.when(is_train, F.col("t_links")).otherwise(F.col("e_links")), F.lit(0)).alias("links"))

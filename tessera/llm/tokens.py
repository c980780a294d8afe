"""Problems 3 and 8: token totals, and token ids, under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import cut_encoder, heap_bpe, rank_file


def token_totals(df: DataFrame, text_col: str, groups: list[str], tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(*groups, n_texts BIGINT, n_tokens BIGINT): exact totals per group.

    Null and empty texts count as texts with no token; null group values are a group of their own. Texts are counted whole
    where they lie: a task sends one row per group and Arrow batch to the shuffle, so a hot group costs nothing extra.
    """
    path = rank_file(tokenizer, folder) if folder else rank_file(tokenizer)
    names = [f"g{i}" for i in range(len(groups))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = heap_bpe(path)
        for pdf in batches:
            by = pdf.groupby(names, dropna=False, sort=False)["t"]
            rows = [(*(k if isinstance(k, tuple) else (k,)), len(t), bpe.weigh(t.dropna())) for k, t in by]
            out = pd.DataFrame(rows, columns=[*names, "n_texts", "n_tokens"])
            yield out.astype({n: object for n in names}).where(out.notna(), None)

    picked = df.select(*(F.col(g).cast("string").alias(n) for g, n in zip(groups, names)), F.col(text_col).alias("t"))
    parts = picked.mapInPandas(run, ", ".join([*(f"{n} string" for n in names), "n_texts bigint", "n_tokens bigint"]))
    totals = parts.groupBy(*names).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    return totals.select(*(F.col(n).alias(g) for n, g in zip(names, groups)), "n_texts", "n_tokens")


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None, slice_bytes: int = 4_000_000) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the ids of every text, without special tokens; an empty list for null and empty texts.

    One narrow pass over id and text, no shuffle. Repeated rows stay repeated, a null id stays null. Texts of ``slice_bytes``
    together are cut and encoded at a time, a longer text alone.
    """
    path = rank_file(tokenizer, folder) if folder else rank_file(tokenizer)
    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = dict(source.dtypes)["i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = cut_encoder(path)
        for b in batches:
            texts = b.column(1).fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = memoryview(texts.buffers()[2] or b"")
            row = 0
            while row < len(texts):  # some rows at a time, so that the memory for a batch doesn't depend on its texts
                upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, side="right")) - 1)
                ids, ends = enc.encode_all(bytes(data[offsets[row] : offsets[upto]]), offsets[row + 1 : upto + 1] - offsets[row])
                made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, upto - row), made], ["i", "ids"])
                row = upto

    return source.mapInArrow(run, f"i {kind}, ids array<int>").select(F.col("i").alias(id_col), "ids")

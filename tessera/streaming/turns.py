"""Streaming twins of the incremental parts: resumable fills and dialogue state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_stream(stream: DataFrame, path: str, checkpoint: str, fill: Callable[[DataFrame], DataFrame]):
    """Each micro-batch is filled and appended; the checkpoint remembers what was done, so a restart does only the rest. A
    batch writes its own folder, so that repeating it after a failure replaces it."""

    def sink(df: DataFrame, epoch: int) -> None:
        fill(df).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are left out and windows are closed then."""
    from pyspark.sql import functions as F

    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def _turns(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, missing, resolved = (set(x.split("\x00")) - {""} for x in (state.get if state.exists else ("", "", "")))
    out = []
    for pdf in batches:
        for r in pdf.sort_values("turn_id", kind="stable").itertuples():
            out.append((key[0], r.turn_id, sorted(known), sorted(resolved), sorted(missing - resolved)))
            gaps = [m for m in (r.missing if r.missing is not None else []) if m]
            known |= {k for k in (r.known if r.known is not None else []) if k}
            if r.action == "ASK" and gaps:
                known.add(gaps[0])
                resolved.add(gaps[0])
            missing |= set(gaps)
    state.update(tuple("\x00".join(sorted(s)) for s in (known, missing, resolved)))
    yield pd.DataFrame(out, columns=["dialogue_id", "turn_id", "cum_known", "cum_resolved", "still_missing"])


def dialogue_state(stream: DataFrame) -> DataFrame:
    """The state before each turn of (dialogue_id, turn_id INT, action, known, missing), turns arriving in order within a
    dialogue. State holds three sets a dialogue."""
    return stream.groupBy("dialogue_id").applyInPandasWithState(
        _turns, "dialogue_id string, turn_id int, cum_known array<string>, cum_resolved array<string>, still_missing array<string>",
        "known string, missing string, resolved string", "append", GroupStateTimeout.NoTimeout,
    )

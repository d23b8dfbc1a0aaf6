"""Streaming forms: policy decisions and corrections that arrive one after another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sextant.operators import memory as M
from sextant.operators import policy

AUDIT = "seq long, correction_id string, memory_id string, error string, item_id string, strength double, updated_at timestamp, correction_count int"


def decide_stream(requests: DataFrame, limits: DataFrame, protocol_hash: str = "") -> DataFrame:
    """Decisions on a request stream: stateless, append; equal to the batch form on the same rows."""
    return policy.decide(requests, limits, protocol_hash)


class Corrections(StatefulProcessor):
    """Folds a memory's corrections in arrival order; its state is the current record and the ids used.

    A correction older than the record's last update is rejected: that is the rule for late data.
    Ids are unique inside a memory, looked up one by one in a map that may forget them after
    ``keep_ids_ms``. Where an id may name corrections of several memories, use
    ``corrections.CorrectionLog``, which judges as the batch form does. Corrections of
    unknown memories come out rejected and leave no state.
    """

    def __init__(self, keep_ids_ms: int | None = None):
        self.keep_ids_ms = keep_ids_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", "item_id string, context_vector array<double>, strength double, updated_at timestamp, correction_count int")
        self.used = handle.getMapState("used", "correction_id string", "seq long", self.keep_ids_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        first = batch.iloc[0]
        if not first["known"]:
            batch["memory_id"] = key[0]
            yield batch[["seq", "correction_id", "memory_id", "error"]].assign(item_id=None, strength=None, updated_at=pd.NaT, correction_count=None)
            return
        names = ("item_id", "context_vector", "strength", "updated_at", "correction_count")
        state = dict(zip(names, self.state.get() if self.state.exists() else (first[n] for n in names), strict=True))
        state |= {"context_vector": list(state["context_vector"]), "strength": float(state["strength"]), "updated_at": pd.Timestamp(state["updated_at"]), "correction_count": int(state["correction_count"])}
        out = []
        for r in batch.to_dict("records"):
            error = r["error"] or None
            if error is None and self.used.containsKey((r["correction_id"],)):
                error = "duplicate correction_id"
            elif error is None and r["corrected_at"] < state["updated_at"]:
                error = "before last update"
            if error is None:
                M.apply_to(state, r)
                self.used.updateValue((r["correction_id"],), (int(r["seq"]),))
            out.append((int(r["seq"]), r["correction_id"], key[0], error, state["item_id"], state["strength"], state["updated_at"], state["correction_count"]))
        self.state.update((state["item_id"], list(state["context_vector"]), state["strength"], state["updated_at"].to_pydatetime(), state["correction_count"]))
        yield pd.DataFrame(out, columns=["seq", "correction_id", "memory_id", "error", "item_id", "strength", "updated_at", "correction_count"])

    def close(self) -> None:
        pass


def drop_repeats(corrections: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop corrections whose id was seen within the watermark."""
    return corrections.withWatermark("corrected_at", delay).dropDuplicatesWithinWatermark(["correction_id"])


def correct_stream(corrections: DataFrame, memory: DataFrame, items: DataFrame, dim: int, keep_ids_ms: int | None = None) -> DataFrame:
    """The audit of a correction stream against a static start memory (needs the RocksDB state store).

    ``keep_ids_ms``: how long a memory's used ids are held, so that state doesn't grow without end; for ever if None.
    """
    checked = M.correction_errors(corrections, memory, items, dim).withColumn("error", F.when(F.size("errors") > 0, F.array_join("errors", ", "))).drop("errors")
    start = memory.select("memory_id", "item_id", "context_vector", "updated_at", "strength", "correction_count", F.lit(True).alias("known"))
    both = checked.join(start, "memory_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return both.groupBy("memory_id").transformWithStateInPandas(Corrections(keep_ids_ms), AUDIT, "Append", "None" if keep_ids_ms is None else "ProcessingTime")

"""Repairs that wait for other evidence: each is released once, when the evidence that it failed on has changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col
OUT = "repair_id long, version long, before string, after string, outcome string"


def released_once(evidence: DataFrame) -> DataFrame:
    """(repair_id, version, before, after, outcome) of rows (repair_id, version, evidence_hash), all at once.

    By version: the first hash is what a repair failed on.  The first later row of another hash ends the wait: ``released``, or ``ignored`` where the
    hash is null, since all its sources are gone (a repair whose first hash is null is ignored at once).  Equal hashes change nothing, and nothing
    after the end counts.  Two aggregates, no sort of a repair's rows.
    """
    first = evidence.where("repair_id is not null and version is not null").groupBy("repair_id").agg(F.min(F.struct("version", "evidence_hash")).alias("first"))
    rows = evidence.join(first, "repair_id").where("version is not null")
    gone = c("first.evidence_hash").isNull()
    other = (c("version") > c("first.version")) & ~c("evidence_hash").eqNullSafe(c("first.evidence_hash"))
    ends = rows.where(gone | other).groupBy("repair_id", "first").agg(F.min(F.struct("version", "evidence_hash")).alias("end"))
    return ends.select("repair_id", "end.version", c("first.evidence_hash").alias("before"), c("end.evidence_hash").alias("after"), F.when(c("end.evidence_hash").isNull(), "ignored").otherwise("released").alias("outcome"))


class Waiting(StatefulProcessor):
    """State of a repair: the version and hash it waits on, and whether its wait has ended."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waits = handle.getValueState("waits", "version long, hash string, over boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.waits.get() if self.waits.exists() else None
        out = []
        for version, hash_ in sorted(((int(v), h) for pdf in rows for v, h in zip(pdf["version"], pdf["evidence_hash"], strict=True) if pd.notna(v)), key=lambda x: (x[0], x[1] or "")):
            if state is None:
                state = (version, hash_, hash_ is None)
                if hash_ is None:
                    out.append((key[0], version, None, None, "ignored"))
            elif not state[2] and version > state[0] and hash_ != state[1]:
                out.append((key[0], version, state[1], hash_, "released" if hash_ is not None else "ignored"))
                state = (version, state[1], True)
        if state is not None:
            self.waits.update(state)
        if out:
            yield pd.DataFrame(out, columns=["repair_id", "version", "before", "after", "outcome"])

    def close(self) -> None:
        pass


def released_stream(evidence: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``released_once`` over a stream: every repair ends once, however often and late its evidence comes again.

    Rows of a batch are taken by version; one that comes in a later batch with an earlier version than what is waited on is stale and has no effect.  `ttl_ms`
    bounds how long a repair is remembered.  Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    keyed = evidence.where("repair_id is not null").select("repair_id", "version", "evidence_hash").groupBy("repair_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Waiting(ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")

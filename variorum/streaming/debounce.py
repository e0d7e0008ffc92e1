"""Curation as state and timers: edits of a feature are taken up together once they have paused, and only what they change goes out.

The state of a feature is the newest edit of each of its readings and what was decided last. Every
edit starts the feature's timer anew; when it runs out, the feature is decided again, and rows
go out for what is new, other, or no longer decided. No other feature is looked at, nothing is read again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET = 1.0  # seconds without an edit after which a feature is decided
DECISIONS = "feature string, app_id string, rdg_text string, label_override string, run long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = "\0"  # stands for no feature: such readings decide for themselves


def decided(feature: str, labels: dict[tuple, str]) -> dict[tuple, str]:
    """What the labels of a feature's readings decide: one for the feature (key (None, None)) if all agree, else one for each reading."""
    good = {k: v for k, v in labels.items() if v in ("meaningful", "trivial")}
    if feature != NONE and len(set(good.values())) == 1:
        return {(None, None): next(iter(good.values()))}
    return good


class Curation(StatefulProcessor):
    def __init__(self, quiet: float = QUIET):
        self.quiet = int(quiet * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edits = handle.getMapState("edits", "app_id string, rdg_text string", "label string, edited_at timestamp_ntz, seen long")
        self.last = handle.getMapState("last", "whole boolean, app_id string, rdg_text string", "label string")
        self.seen = handle.getValueState("seen", "n long, runs long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, runs = self.seen.get() if self.seen.exists() else (0, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                k, n = (r.app_id, r.rdg_text), n + 1
                old = self.edits.getValue(k) if self.edits.containsKey(k) else None
                # the newest counts, of equal times the one that came last
                if old is None or pd.Timestamp(old[1]) <= r.edited_at:
                    self.edits.updateValue(k, ((r.label or "").strip().lower(), r.edited_at.to_pydatetime(), n))
        self.seen.update((n, runs))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield pd.DataFrame(columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, runs = self.seen.get()
        new = decided(key[0], {tuple(k): v[0] for k, v in self.edits.iterator()})
        old = {(None, None) if whole else (a, b): v[0] for (whole, a, b), v in self.last.iterator()}
        changed = {k: new.get(k) for k in {*new, *old} if new.get(k) != old.get(k)}
        for k, label in changed.items():
            at = (k == (None, None), *(x or "" for x in k))
            if label is None:
                self.last.removeKey(at)
            else:
                self.last.updateValue(at, (label,))
        self.seen.update((n, runs + 1))
        out = [(None if key[0] == NONE else key[0], *k, label, runs + 1) for k, label in sorted(changed.items(), key=str)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def close(self) -> None:
        pass


def decisions(edits: DataFrame, quiet: float = QUIET) -> DataFrame:
    """A stream of ``feature, app_id, rdg_text, label_override, run`` from one of ``app_id, rdg_text, feature, curator_label, edited_at``.

    A row replaces what was said before of its feature (null app_id and rdg_text) or reading; a null label takes it
    back. All rows together say what :func:`~variorum.operators.curate.consensus` says of the newest edits. ``run``
    counts a feature's decisions: edits less than ``quiet`` seconds apart give one. A reading keeps its feature; readings
    without one decide for themselves; null ids are empty ones. State is kept by RocksDB, by feature.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = edits.select(F.coalesce("feature", F.lit(NONE)).alias("key"), blank("app_id"), blank("rdg_text"), F.col("curator_label").alias("label"), "edited_at").where("edited_at is not null")
    return rows.groupBy("key").transformWithStateInPandas(Curation(quiet), outputStructType=DECISIONS, outputMode="Update", timeMode="ProcessingTime")


def applied(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides by feature and by reading that all decisions so far leave, as ``consensus`` gives them."""
    last = rows.groupBy("feature", "app_id", "rdg_text").agg(F.max_by("label_override", "run").alias("label_override")).where("label_override is not null")
    features = last.where("app_id is null").select("feature", "label_override")
    return features, last.where("app_id is not null").select("app_id", "rdg_text", "label_override")


def start(edits: DataFrame, path: str, checkpoint: str, quiet: float = QUIET, interval: str = "200 milliseconds"):
    """Starts the stream; decisions are appended to the Parquet table ``path``, once each also if a batch is repeated."""

    def append(batch: DataFrame, n: int) -> None:
        batch.persist()
        if not batch.isEmpty():  # most batches only look at the timers
            batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        batch.unpersist()

    return decisions(edits, quiet).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{DECISIONS}, batch long").parquet(path).drop("batch")


def wait(query, batches: int = 2, most: float = 60.0) -> None:
    """Waits until the stream has run so many batches more; timers keep it running, so it never has nothing to do."""
    seen = lambda: (query.lastProgress or {"batchId": -1})["batchId"]
    first, until = seen(), time.monotonic() + most
    while seen() < first + batches and time.monotonic() < until:
        if query.exception():
            raise query.exception()
        time.sleep(0.1)


def settle(query, quiet: float = QUIET) -> None:
    """Waits until what is there now has been taken up and decided."""
    wait(query)
    time.sleep(quiet)
    wait(query)

"""Structured Streaming jobs: page ingest into buckets, first-seen URLs, counters, event order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import blocks, pages, registry
from ..operators.audit import EVENT_ORDER
from ..settings import DEFAULTS, Settings
from ..sources import tables


def ingest_batch(batch: DataFrame, documents: DataFrame, stored_units: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """One batch of pages (page_id, url, html) against the registry: the page changes, the
    plan, the units to write and the rejects.  A bad page is a reject row and stops nothing;
    unchanged pages are not cut into units."""
    fetched = pages.scan_pages(batch, settings)
    body = T.inner_text(F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</\1>", " "))
    gated = pages.page_gate(fetched.withColumn("text", body))
    reason = F.when(F.col("fetch_outcome") != "ok", F.col("fetch_outcome")).otherwise(F.col("reject_reason"))
    gated = gated.withColumn("reason", reason)
    rejects = gated.where("reason IS NOT NULL").select("page_id", "url", "reason")
    kept = gated.where("reason IS NULL").withColumn("fingerprint", T.content_fingerprint("text", settings))
    changes = registry.page_changes(documents, kept.withColumn("source_id", F.lit("stream")))
    moved = changes.where("change = 'supersede'")
    cut, unit_rejects = blocks.units(blocks.heading_paths(pages.flat_blocks(moved)), "page_id", settings)
    new = cut.withColumn("document_id", F.col("page_id").cast("string"))
    plan = registry.supersession_plan(
        stored_units.join(moved.select(F.col("page_id").cast("string").alias("document_id")), "document_id", "left_semi"), new
    )
    return {"changes": changes, "units": new, "plan": plan, "rejects": rejects, "unit_rejects": unit_rejects}


REGISTRY = {
    "documents": "document_id string, source_id string, url string, fingerprint string",
    "units": "document_id string, ordinal int, vector_id string, text string, text_fingerprint string",
}
#: what a table's bucket is chosen by
BUCKET_KEYS = {"documents": ("source_id", "url"), "units": ("document_id",)}


def latest_version(spark: SparkSession, root: str) -> int:
    """The last whole version of a registry, 0 before the first."""
    return tables.read_manifest(spark, root)[0]


def read_snapshot(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    live = tables.read_manifest(spark, root, version)[1] if version else {}
    return tables.read_buckets(spark, root, name, REGISTRY[name], live.get(name, {}))


def _numbers(rows: DataFrame) -> list[int]:
    """Numbers of buckets: of a fixed count."""
    return sorted(r[0] for r in rows.distinct().collect())


def ingest_pages(
    pages_stream: DataFrame, root: str, checkpoint: str, settings: Settings = DEFAULTS, buckets: int = tables.BUCKETS, keep: int = 2
) -> None:
    """Ingest all available pages (page_id, url, html) into the registry below ``root``.

    Documents and units live in buckets of their keys.  A micro-batch reads the buckets that its
    pages fall into and writes those in which something changes, so that its cost follows the batch and not
    the registry: ``changes`` and ``rejects`` of the batch, then the buckets, and last
    a manifest that makes the version whole.  A batch that failed on the way leaves no whole
    version and is written again; one whose pages are known already changes nothing.  Of
    several rows with one url in a batch one counts.  In the end, files that none of
    the last ``keep`` versions uses are removed.
    """
    spark = pages_stream.sparkSession

    def bucket(name: str) -> Column:
        return tables.bucket_of(*BUCKET_KEYS[name], buckets=buckets)

    def apply(batch: DataFrame, epoch: int) -> None:
        before, live = tables.read_manifest(spark, root)
        version = before + 1
        batch = registry.upsert(batch.limit(0), batch.where("url IS NOT NULL"), "url").persist()
        keys = batch.select(F.col("page_id").cast("string").alias("document_id"), F.lit("stream").alias("source_id"), "url")

        def stored(name: str, rows: DataFrame) -> DataFrame:
            return tables.read_buckets(spark, root, name, REGISTRY[name], live.get(name, {}), _numbers(rows.select(bucket(name))))

        out = ingest_batch(batch, stored("documents", keys), stored("units", keys), settings)
        changes = out["changes"].withColumn("document_id", F.col("page_id").cast("string"))
        to = f"{root}/changes/version={version}"
        changes.select("document_id", "source_id", "url", "fingerprint", "change").write.mode("overwrite").parquet(to)
        changes = spark.read.parquet(to)
        out["rejects"].write.mode("overwrite").parquet(f"{root}/rejects/version={version}")
        moved = changes.where("change = 'supersede'")
        names = [f.split()[0] for f in REGISTRY["units"].split(", ")]
        new = {
            "units": out["units"].withColumn("vector_id", T.vector_id("document_id", "ordinal")).select(names),
            "documents": moved.select([f.split()[0] for f in REGISTRY["documents"].split(", ")]),
        }
        manifest = {}
        for name, rows in new.items():
            mine = live.get(name, {})
            touched = _numbers(moved.select(bucket(name)))
            if touched:
                old = tables.read_buckets(spark, root, name, REGISTRY[name], mine, touched)
                key = list(BUCKET_KEYS[name])
                kept = old.join(moved.select(*key).distinct(), key, "left_anti")
                kept = kept.select(rows.columns).unionByName(rows).withColumn("bucket", bucket(name))
                mine = tables.replace_buckets(kept, root, name, version, mine, touched)
            manifest[name] = mine
        tables.commit(spark, root, version, manifest)
        batch.unpersist()

    (
        pages_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    tables.clean(spark, root, keep)


class FirstSeen(StatefulProcessor):
    """Keeps the first time of a url, and tells it when it is new or was earlier than known.
    A timer in event time forgets a url that is not heard of for long."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = [(int(r["us"].min()), int(r["us"].max())) for r in rows]
        low, high = min(a for a, _ in ends), max(b for _, b in ends)
        known = self.times.get() if self.times.exists() else None
        if known is None or low < known[0]:
            yield pd.DataFrame({"url": [key[0]], "us": [low]})
        if known is not None:
            low, high = min(low, known[0]), max(high, known[1])
            self.handle.deleteTimer((known[1] + self.ttl_us) // 1000)
        self.times.update((low, high))
        self.handle.registerTimer((high + self.ttl_us) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_seen_urls(urls: DataFrame, ttl: str = "30 days", late: str = "30 days") -> DataFrame:
    """A stream of (url, ts) to the first time of each url: a row when it is new, and one
    more if an earlier time arrives after it, so that of the rows of a url the last
    counts.  A url that is not heard of for ``ttl`` behind the watermark is forgotten; rows later
    than ``late``, and those without a url or a time, are left out.  Needs the RocksDB
    state store."""
    ttl_us = int(pd.Timedelta(ttl).total_seconds() * 1_000_000)
    rows = urls.where("url IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    seen = rows.select("url", "ts", F.unix_micros("ts").alias("us")).groupBy("url").transformWithStateInPandas(
        statefulProcessor=FirstSeen(ttl_us), outputStructType="url string, us long", outputMode="update", timeMode="eventTime"
    )
    return seen.select("url", F.timestamp_micros("us").alias("ts"))


def running_counters(outcomes: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """A stream of (ts, job_id, outcome): counts per window, job and outcome."""
    return (
        outcomes.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "job_id", "outcome")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "job_id", "outcome", "n")
    )


class EventOrder(StatefulProcessor):
    """Follows one request's events and reports when it ends, well or not.

    The state is the place of the last event.  With a timeout, a timer in event time reports
    a request that has no terminal event for so long after its last one.  Events of one
    batch are taken by sequence number.
    """

    def __init__(self, timeout_ms: int | None = None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "at int, ok boolean, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of an event only its number and place are kept: some ten bytes each
        places = {name: i + 1 for i, name in enumerate(EVENT_ORDER)} | {"error": -1}
        got, newest = [], 0
        for r in rows:
            got.append((r["sequence"].to_numpy(), r["name"].map(places).fillna(0).to_numpy("int8")))
            if self.timeout_ms:
                newest = max(newest, int(r["ms"].max()))
        if key[0] is None:  # a mark of time, no request
            return
        number, where_all = (np.concatenate(x) for x in zip(*got))
        at, ok, over = self.place.get() if self.place.exists() else (0, True, False)
        for where in where_all[np.argsort(number, kind="stable")].tolist():
            if over:
                ok = False
            elif where == -1:
                over = True
            else:
                ok = ok and where > 0 and (where == at + 1 or where == at == 6)
                at, over = where, where == len(EVENT_ORDER)
        if over and not (self.place.exists() and self.place.get()[2]):
            yield pd.DataFrame({"request_id": [key[0]], "ok": [bool(ok)], "ended": [True]})
        if self.timeout_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest + self.timeout_ms)
        self.place.update((int(at), bool(ok), bool(over)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not (self.place.exists() and self.place.get()[2]):
            yield pd.DataFrame({"request_id": [key[0]], "ok": [False], "ended": [False]})
        self.place.clear()

    def close(self) -> None:
        pass


def event_order_stream(events: DataFrame, timeout: str | None = None, late: str = "1 minute") -> DataFrame:
    """A stream of (request_id, sequence, name) to requests that ended, well or not.

    With a ``timeout`` and event times ``ts``, requests whose last event lies so far behind
    the watermark are reported as not ended, and their state goes.  Rows without a request
    only move the watermark; see ``runs.run_closed``.  Needs the RocksDB state store.
    """
    if timeout is None:
        rows = events
    else:
        rows = events.withWatermark("ts", late).select("request_id", "sequence", "name", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=EventOrder(timeout and int(pd.Timedelta(timeout).total_seconds() * 1000)),
        outputStructType="request_id string, ok boolean, ended boolean",
        outputMode="append",
        timeMode="eventTime" if timeout else "none",
    )

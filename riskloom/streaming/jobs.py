"""Structured Streaming jobs: KPI windows, change feed, retry state, alerts, snapshots, stuck jobs and the event sink.

Every job takes a streaming DataFrame and gives one, or a writer to start; cursors and state live in the checkpoint.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..operators import names, tables

#: Seconds until the next try by the number of failures, and the number that ends the tries.
BACKOFF, MAX_RETRIES = (1, 4, 16, 60, 300), 5


def kpi_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Scans, failures, approximate 95th percentile and approximate active organisations of each event-time window."""
    done = F.col("type") == "scan_completed"
    w = F.window("timestamp", length, slide or length)
    return (
        events.filter("not demo")
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", late)
        .groupBy(w)
        .agg(F.count_if(done).alias("scans"), F.count_if(F.col("type") == "scan_failed").alias("failed"), F.expr("approx_percentile(CASE WHEN type = 'scan_completed' THEN duration_ms END, 0.95)").alias("p95"), F.approx_count_distinct("org_id").alias("orgs"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "scans", "failed", "p95", "orgs")
    )


def name_index(popular: DataFrame, known: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """What a changed name is looked up by: key, the popular name behind it in lower case (plow) and a rank.

    Keys are the known imitations, popular names with look-alike letters read as plain ones, popular names with up to two
    letters left out, and names of the other registry.  It is static, and as large as the popular names times the square
    of their length.
    """
    none = F.lit(None).cast("string").alias("plow")
    low = F.lower("name")
    told = known.select(F.concat(F.lit("known:"), low).alias("key"), none, F.lit(4).alias("rank"))
    glyph = popular.select(F.concat(F.lit("glyph:"), S.homoglyph_name(F.col("name"))).alias("key"), low.alias("plow"), F.lit(4).alias("rank"))
    near = popular.select(F.explode(names.deletions(low)).alias("d"), low.alias("plow")).select(F.concat(F.lit("near:"), F.col("d")).alias("key"), "plow", F.lit(0).alias("rank"))
    both = elsewhere.select(F.concat(F.lit("cross:"), S.cross_name(F.col("name"))).alias("key"), none, F.lit(3).alias("rank"))
    return told.unionByName(glyph).unionByName(near).unionByName(both).distinct()


def feed_candidates(changes: DataFrame, analysed: DataFrame, index: DataFrame, least_downloads: int = 0) -> DataFrame:
    """seq, name, version and rank (null, or of a risk of the name): one row at least of each package to be analysed.

    changes has seq, name, version, deleted, downloads and scripts.  Live packages with enough downloads that are native
    or run install scripts and aren't analysed (name, version) yet go on; each is looked up in name_index() by its keys.
    """
    live = changes.filter(~F.coalesce("deleted", F.lit(False)) & F.col("version").isNotNull() & (F.coalesce("downloads", F.lit(0)) >= least_downloads))
    live = live.filter(S.is_native_name(F.col("name")) | S.has_install_script(F.col("scripts")))
    fresh = live.join(analysed.select("name", "version"), ["name", "version"], "left_anti").withColumn("low", F.lower("name"))
    keys = F.concat(
        F.array(F.lit("self:"), F.concat(F.lit("known:"), F.col("low")), F.concat(F.lit("glyph:"), S.homoglyph_name(F.col("name")))),
        F.transform(names.deletions(F.col("low")), lambda d: F.concat(F.lit("near:"), d)),
        F.when(S.cross_listed_risky(F.col("name")), F.array(F.concat(F.lit("cross:"), S.cross_name(F.col("name"))))).otherwise(F.array().cast("array<string>")),
    )
    each = fresh.select("seq", "name", "version", "low", F.explode(keys).alias("key"))
    # the row of the package itself finds one entry
    own = index.sparkSession.range(1).select(F.lit("self:").alias("key"), F.lit(None).cast("string").alias("plow"), F.lit(-1).alias("rank"))
    met = each.join(index.unionByName(own).hint("merge"), "key")
    distance = F.levenshtein("low", "plow", 2)
    near = F.when(distance.between(1, 2) & ~names.legitimate_extension(F.col("low"), F.col("plow")), F.when(distance == 1, 3).otherwise(2))
    rank = F.when(F.col("rank") == 0, near).when(F.startswith("key", F.lit("glyph:")) & (F.col("low") == F.col("plow")), None).when(F.col("rank") > 0, F.col("rank"))
    return met.select("seq", "name", "version", F.col("key"), rank.alias("rank")).filter("rank is not null or key = 'self:'").drop("key")


#: Risk score of an event by the rank of its level.
EVENT_SCORES = {4: 100, 3: 80, 2: 50, 1: 25}
EVENTS = "seq long, name string, version string, event string, risk_level string, risk_score int"


def change_events(changes: DataFrame, analysed: DataFrame, index: DataFrame, least_downloads: int = 0) -> DataFrame:
    """Batch form of change_feed(): of each package version a new_version, and a typosquat_risk if its name is risky."""
    one = feed_candidates(changes, analysed, index, least_downloads).groupBy("name", "version").agg(F.min("seq").cast("long").alias("seq"), F.max("rank").alias("rank"))
    score = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_SCORES.items() for x in kv]), F.col("rank"))
    new = F.struct(F.lit("new_version").alias("event"), F.lit(None).cast("string").alias("risk_level"), F.lit(None).cast("int").alias("risk_score"))
    risk = F.struct(F.lit("typosquat_risk").alias("event"), S.level_of(F.col("rank")).alias("risk_level"), score.alias("risk_score"))
    events = F.when(F.col("rank").isNull(), F.array(new)).otherwise(F.array(risk, new))
    return one.select("seq", "name", "version", F.inline(events))


class FeedProcessor(StatefulProcessor):
    """Events of a package version once, however often the feed or the index brings it; forgotten after KEEP_DAYS."""

    KEEP_DAYS = 7

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long", ttlDurationMs=self.KEEP_DAYS * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seqs, ranks = [], []
        for part in rows:
            seqs += part["seq"].tolist()
            ranks += part["rank"].dropna().tolist()
        if self.seen.exists():
            return
        self.seen.update((int(min(seqs)),))
        out = [(int(min(seqs)), key[0], key[1], "new_version", None, None)]
        if ranks:
            level = int(max(ranks))
            out.insert(0, (int(min(seqs)), key[0], key[1], "typosquat_risk", S.LEVELS[level], EVENT_SCORES[level]))
        yield pd.DataFrame(out, columns=["seq", "name", "version", "event", "risk_level", "risk_score"]).astype({"risk_score": "Int32"})

    def close(self) -> None:
        pass


def change_feed(changes: DataFrame, analysed: DataFrame, index: DataFrame, least_downloads: int = 0) -> DataFrame:
    """The events of change_events() over a stream, one row each; needs the RocksDB state store provider.

    Look-ups are stream-static joins on equal keys, and a version's rows meet at its state.
    """
    found = feed_candidates(changes, analysed, index, least_downloads).select("name", "version", "seq", "rank")
    return found.groupBy("name", "version").transformWithStateInPandas(FeedProcessor(), EVENTS, "Append", "ProcessingTime")


def stuck_jobs(submitted: DataFrame, completed: DataFrame, seconds: int = 60) -> DataFrame:
    """Submitted jobs (job_id, submitted_at) without a completion (job_id, completed_at) within the time, and failed ones."""
    s = submitted.withWatermark("submitted_at", "1 minute")
    c = completed.withWatermark("completed_at", "1 minute").withColumnRenamed("job_id", "done_id")
    on = (F.col("job_id") == F.col("done_id")) & (F.col("completed_at") >= F.col("submitted_at")) & (F.col("completed_at") <= F.col("submitted_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    out = s.join(c, on, "left_outer")
    return out.filter("done_id is null or status = 'failed'").select("job_id", "submitted_at", F.when(F.col("done_id").isNull(), "stuck").otherwise("failed").alias("reason"))


def retry_state(events: DataFrame) -> DataFrame:
    """Batch form of the retry state: events (scan_id, at, ok) folded per scan."""
    last_ok = F.max(F.when(F.col("ok"), F.col("at")))
    per = events.groupBy("scan_id").agg(last_ok.alias("ok_at"), F.count_if(~F.col("ok")).alias("failures"), F.max("at").alias("last_at"))
    wait = F.get(F.array(*[F.lit(b) for b in BACKOFF]), F.least(F.col("failures"), F.lit(len(BACKOFF))).cast("int") - 1)
    state = F.when(F.col("ok_at") == F.col("last_at"), "resolved").when(F.col("failures") >= MAX_RETRIES, "abandoned").otherwise("retrying")
    after = F.when(state == "abandoned", F.col("last_at") + F.expr("INTERVAL 30 DAYS")).when(state == "retrying", F.timestamp_seconds(F.unix_timestamp("last_at") + wait))
    return per.select("scan_id", "failures", state.alias("state"), after.alias("next_retry"))


class RetryProcessor(StatefulProcessor):
    """Failures of each scan; a row for every event with the state after it, and one when an abandoned scan expires.

    A success ends the state; an abandoned scan's goes when event time is EXPIRY_DAYS past its last failure.
    """

    EXPIRY_DAYS = 30
    COLUMNS = ("scan_id", "at", "failures", "state", "next_retry", "audit")
    AUDIT = {"resolved": "retry_succeeded", "abandoned": "retry_abandoned", "retrying": "retry_scheduled", "expired": "retry_expired"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n long, at timestamp")

    def _row(self, key, at, n, state, after) -> tuple:
        return key[0], at, n, state, after, self.AUDIT[state]

    def _forget(self) -> None:
        self.failures.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        out, last = [], None
        for at, ok in sorted((x for part in rows for x in zip(part["at"], part["ok"], strict=True)), key=lambda x: x[0]):
            n, last = n if ok else n + 1, at
            state = "resolved" if ok else "abandoned" if n >= MAX_RETRIES else "retrying"
            wait = None if ok else pd.Timedelta(days=self.EXPIRY_DAYS) if state == "abandoned" else pd.Timedelta(seconds=BACKOFF[n - 1])
            out.append(self._row(key, at, n, state, at + wait if wait is not None else pd.NaT))
        self._forget()
        if out and out[-1][3] != "resolved":
            self.failures.update((n, last.to_pydatetime()))
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.EXPIRY_DAYS * 86_400_000)
        yield pd.DataFrame(out, columns=list(self.COLUMNS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        self.failures.clear()
        yield pd.DataFrame([self._row(key, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), n, "expired", pd.NaT)], columns=list(self.COLUMNS))

    def close(self) -> None:
        pass


def retry_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Needs the RocksDB state store provider; events of a scan that come back after it ended begin anew."""
    return events.withWatermark("at", late).groupBy("scan_id").transformWithStateInPandas(RetryProcessor(), "scan_id long, at timestamp, failures long, state string, next_retry timestamp, audit string", "Append", "EventTime")


def alert_batches(watchlists: DataFrame, entries: DataFrame, dependencies: DataFrame, channels: DataFrame, ledger_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: analyses of a batch to alerts that the ledger lacks, appended under the batch's number.

    A batch that is run again overwrites its own folder only, so a restart sends nothing twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        flagged = batch.withColumn("risk_level", S.risk_level(F.col("risk_score"))).filter(F.col("risk_level").isin("high", "critical"))
        watch = tables.watchlist_matches(flagged, entries).join(watchlists, "watchlist_id")
        levels = flagged.groupBy("package_id").agg(F.max(S.rank_of(F.col("risk_level"))).alias("rank")).select("package_id", S.level_of(F.col("rank")).alias("risk_level"))
        exposure = tables.lockfile_exposure(flagged, dependencies).join(levels, "package_id")
        new = tables.alert_targets(watch, exposure, channels)
        try:
            before = spark.read.parquet(ledger_path).filter(F.col("batch") < number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = new.limit(0)
        sent = tables.ledger_append(before.select(*new.columns), new, new.columns).filter("status = 'sent'")
        sent.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return run


def _file(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _marked(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _file(spark, path)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _mark(spark: SparkSession, path: str) -> None:
    file, fs = _file(spark, path)
    fs.create(file, True).close()


def snapshot(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame | None:
    """The table after a batch (the last one committed, if not given): its latest base and the changes since; None before the first."""
    done = [n for n in _marked(spark, f"{path}/committed") if upto is None or n <= upto]
    bases = [n for n in _marked(spark, f"{path}/compacted") if upto is None or n <= upto]
    parts = [spark.read.parquet(f"{path}/base/{bases[-1]}").withColumn("__n", F.lit(-1))] if bases else []
    log = [n for n in done if not bases or n > bases[-1]]
    parts += [spark.read.parquet(f"{path}/log/{n}").drop("change").withColumn("__n", F.lit(n)) for n in log]
    if not parts:
        return None
    every = functools.reduce(DataFrame.unionByName, parts)
    rest = [c for c in every.columns if c not in keys]
    # a key has one row a batch at most, and few batches are in the log
    latest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__n").alias("r"))
    return latest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "__n"])


def snapshot_batches(path: str, keys: list[str], compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: upserts each batch by keys as a log of what it changed; snapshot() reads the table.

    A batch writes its inserted and updated rows, with `change`, and then its marker, so bytes written grow with the
    batch.  Every compact_every batches the table is written as a new base.  A batch that is run again starts from the
    state before it and overwrites its own folders only; what has no marker isn't read.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, values = batch.sparkSession, [c for c in batch.columns if c not in keys]
        one = tables.first_by(batch, keys, *[F.desc(c) for c in values])
        before = snapshot(spark, path, keys, number - 1)
        if before is None:
            changed = one.withColumn("change", F.lit("inserted"))
        else:
            old = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__old"))
            same = functools.reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), values, F.lit(True))
            change = F.when(F.col("__old").isNull(), "inserted").when(~same, "updated")
            changed = one.join(old, keys, "left").withColumn("change", change).filter("change is not null")
        changed.select(*batch.columns, "change").write.mode("overwrite").parquet(f"{path}/log/{number}")
        _mark(spark, f"{path}/committed/{number}")
        if (number + 1) % compact_every == 0:
            snapshot(spark, path, keys, number).write.mode("overwrite").parquet(f"{path}/base/{number}")
            _mark(spark, f"{path}/compacted/{number}")

    return run


def event_sink(events: DataFrame, path: str, checkpoint: str):
    """A writer of the events as Parquet, in order of arrival, exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def fresh_only(feed: DataFrame, ts: str, as_of, days: int = 30) -> DataFrame:
    """Batch guard against old data; a stream drops it by its watermark."""
    return feed.filter(S.is_fresh(F.col(ts), as_of, days))


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts), *[c for c in df.columns if c not in (key, ts)])
    return df.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")

"""Streaming jobs: versioned snapshots, ledger and quarantine upserts, running coverage, bulletins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators import reconcile, windows

SNAPSHOT = "key string, at timestamp, content string, version long, revision string"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last hash and number of a key; emits the rows whose hash is new, in order of time."""
    last, number, newest = state.get if state.exists else (None, 0, None)
    rows = [r for pdf in batches for r in zip(pdf["at"].tolist(), pdf["content"].tolist(), strict=True)]
    rows.sort(key=lambda r: (pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0].value, pd.isna(r[1]), "" if pd.isna(r[1]) else r[1]))  # by time, then content; nulls last
    out = []
    for at, content in rows:
        if number and content == last:
            continue
        number += 1
        out.append((at, content, number))
        last, newest = content, at.isoformat()
    state.update((last, number, newest))
    if out:  # a frame costs more than the rows of most keys
        ats, contents, numbers = zip(*out, strict=True)
        yield pd.DataFrame({"key": key[0], "at": list(ats), "content": list(contents), "version": list(numbers), "revision": ["first" if n == 1 else "revision" for n in numbers]})


def versioned_snapshots(snapshots: DataFrame) -> DataFrame:
    """Streaming (key, at, content) -> snapshots that changed, numbered by key. Input of a key must come in order of at.

    State is three values for each key. `windows.versions` is the batch twin.
    """
    return snapshots.groupBy("key").applyInPandasWithState(_track, SNAPSHOT, "last string, number long, newest string", "append", GroupStateTimeout.NoTimeout)


class _Ordered(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, then they are compared in order of (us, content).

    State: the rows that wait, the last version, and when the one timer of the key goes off.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, content string")
        self.last = handle.getValueState("last", "content string, number long")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, us: int) -> None:
        """The timer at the first whole millisecond that is not before us, unless one is set before that."""
        ms = -(-us // 1000)
        if self.due.exists():
            (old,) = self.due.get()
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            self.waiting.appendList([(int(u), None if pd.isna(c) else c) for u, c in zip(pdf["us"], pdf["content"], strict=True)])
            first = int(pdf["us"].min()) if first is None else min(first, int(pdf["us"].min()))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for us, content in self.waiting.get():
            (due if us <= passed else later).append((us, content))
        self.due.clear()  # a timer that went off is gone by itself
        if later:
            self.waiting.put(later)
            self._wake(min(us for us, _ in later))
        else:
            self.waiting.clear()
        content, number = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for us, c in sorted(due, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            if number and c == content:
                continue
            content, number = c, number + 1
            out.append((key[0], us, c, number, "first" if number == 1 else "revision"))
        if out:
            self.last.update((content, number))
            yield pd.DataFrame(out, columns=["key", "us", "content", "version", "revision"])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered_snapshots(snapshots: DataFrame, delay: str) -> DataFrame:
    """As `versioned_snapshots` for rows that come in any order, up to `delay` ("30 minutes") behind the newest.

    A row waits in its key's state until the watermark has passed it; then its key's rows are compared in order of
    (at, content; null first), so late rows give the versions that `windows.versions` gives. Rows behind the watermark, and
    those without a time, are left out; a null key is a key. What the watermark has not passed yet is still to come.
    The state needs the RocksDB provider: start the stream through `start_ordered`, or set it.
    """
    rows = snapshots.where("at is not null").withWatermark("at", delay).select("key", "at", F.unix_micros("at").alias("us"), "content")
    out = rows.groupBy("key").transformWithStateInPandas(_Ordered(), "key string, us long, content string, version long, revision string", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("us").alias("at"), "content", "version", "revision")


def start_ordered(snapshots: DataFrame, delay: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the versions of `ordered_snapshots` to Parquet at target, with the state provider that it needs for this stream alone."""
    conf, name = snapshots.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:  # a stream copies its session's settings when it starts
        out = ordered_snapshots(snapshots, delay).writeStream.format("parquet").outputMode("append").option("path", target)
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


BUCKETS, BUCKET = 64, "bucket_of_key"


def upsert_latest(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, bad=None, quarantine: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the latest row of each key at target, failures in a second table; see `fold`."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        fold(df if bad is None else df.where(~bad), target, batch, keys, order, buckets)
        if bad is not None and quarantine:
            fold(df.where(bad), quarantine, batch, keys, order, buckets)
        df.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold(rows: DataFrame, target: str, batch: int, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Folds one batch into the table at target: the latest row of each key, by order.

    The table lies in buckets by a hash of the keys. A batch reads and rewrites only the buckets that it has keys of, in a
    folder of its own number; then a manifest with the folder of every live bucket is put in place by one rename. Readers
    follow the last manifest. A batch that is run again starts from the manifest before it and gives the same table.
    What neither this manifest nor the one before it names is deleted. The number of buckets is fixed by the first batch.
    """
    spark = rows.sparkSession
    old, last = _manifest(spark, target, before=batch)
    if old and old["buckets"] != buckets:
        raise ValueError(f"the table has {old['buckets']} buckets")
    live = dict(old["live"]) if old else {}
    placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())  # as many as there are buckets, at most
    if touched:
        had = [f"{target}/v={live[str(b)]}/{BUCKET}={b}" for b in touched if str(b) in live]
        if had:
            was = spark.read.schema(rows.schema).parquet(*had).select(*rows.columns)
            placed = placed.unionByName(was.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        kept = windows.latest(placed, [BUCKET, *keys], order)
        kept.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/v={batch}")
        live |= {str(b): batch for b in touched}
    _put_manifest(spark, target, batch, {"buckets": buckets, "live": live, "schema": rows.schema.json()})
    _sweep(spark, target, live, old["live"] if old else {}, {batch, last})


def _files(spark: SparkSession, at: str):
    """(file system, path) of a folder or file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _manifest(spark: SparkSession, target: str, before: int | None = None) -> tuple[dict | None, int]:
    """(the last manifest, or the last before a batch; its number): None, -1 if there is none."""
    fs, root = _files(spark, f"{target}/_manifests")
    if not fs.exists(root):
        return None, -1
    found = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.isdigit()]
    found = [n for n in found if before is None or n < before]
    if not found:
        return None, -1
    number = max(found)
    return json.loads("".join(r.value for r in spark.read.text(f"{target}/_manifests/{number}", wholetext=True).collect())), number


def _put_manifest(spark: SparkSession, target: str, batch: int, content: dict) -> None:
    fs, made = _files(spark, f"{target}/_manifests/.{batch}-{uuid.uuid4().hex}")
    _, place = _files(spark, f"{target}/_manifests/{batch}")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(made, place):
        raise OSError(f"cannot put {place}")


def _sweep(spark: SparkSession, target: str, live: dict, before: dict, manifests: set[int]) -> None:
    """Deletes bucket folders and manifests that nothing names any more."""
    named = {(int(v), int(b)) for part in (live, before) for b, v in part.items()}
    fs, root = _files(spark, target)
    for version in [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]:
        v = int(version.getName()[2:])
        folders = [s.getPath() for s in fs.listStatus(version) if s.getPath().getName().startswith(f"{BUCKET}=")]
        gone = [p for p in folders if (v, int(p.getName()[len(BUCKET) + 1 :])) not in named]
        for p in [version] if len(gone) == len(folders) else gone:
            fs.delete(p, True)
    _, root = _files(spark, f"{target}/_manifests")
    for s in fs.listStatus(root):
        n = s.getPath().getName()
        if n.isdigit() and int(n) not in manifests and int(n) < max(manifests):
            fs.delete(s.getPath(), False)


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """The table that `upsert_latest` keeps."""
    now, _ = _manifest(spark, target)
    if now is None:
        raise FileNotFoundError(target)
    schema = T.StructType.fromJson(json.loads(now["schema"]))
    paths = [f"{target}/v={v}/{BUCKET}={b}" for b, v in now["live"].items()]
    return spark.read.schema(schema).parquet(*paths).select(*schema.names) if paths else spark.createDataFrame([], schema)


def running_coverage(ledger: DataFrame, plan: str, status: str) -> DataFrame:
    """Streaming counts by plan and status, for complete or update output."""
    return ledger.groupBy(plan, status).count()


def revisions(versions: DataFrame, key: str, order: str, content: str, source: str, marker: str) -> DataFrame:
    """Batch: each version's class against the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    prev = F.lag(content).over(w)
    kind = reconcile.revision_class(prev, F.col(content), F.col(marker), F.col(source).eqNullSafe(F.lag(source).over(w)), F.lit(True))
    return versions.withColumn("revision", F.when(F.row_number().over(w) == 1, "first").otherwise(kind))


def bulletins(reports: DataFrame, sequence: str, unit: str, value: str, expected: int) -> DataFrame:
    """Totals of each bulletin and the share of expected units that it covers."""
    g = reports.groupBy(sequence).agg(F.countDistinct(unit).alias("units"), F.sum(value).alias("total"))
    return g.withColumn("percent_complete", F.round(100 * F.col("units") / F.lit(expected), 4))

"""A corpus kept up to date by a stream of files, tumbling windows over events, and timers for stale state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import changes


def stream_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", "1000").schema("path string, modificationTime timestamp, length long, content binary").load(root)


class CorpusStore:
    """State of an incremental corpus: digests of the files seen, their rows, and the next id.

    Each batch writes only what it changes, as a version of its own; a marker written last makes it count and holds the counter, so a batch that fails
    leaves the old state, and a batch delivered again finds its files unchanged. Of a file the last version holds. compact() puts the versions
    together and removes them. Files of the same digest are skipped.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "path", digest: str = "digest", id_col: str | None = None, order: tuple[str, ...] = ()):
        """With id_col the rows that process returns are numbered in the given order, going on from the last run."""
        self.spark, self.path, self.key, self.digest, self.id_col, self.order = spark, path.rstrip("/"), key, digest, id_col, list(order)

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _marks(self) -> dict[int, tuple[int, int]]:
        """(first version that counts, next id) by version."""
        fs, at = self._files()
        if not fs.exists(at(self.path)):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(at(self.path))]
        return {int(v): (int(base), int(n)) for v, base, n in (x[5:].split("-") for x in names if x.startswith("done-"))}

    def _mark(self, version: int, base: int, next_id: int) -> None:
        fs, at = self._files()
        fs.create(at(f"{self.path}/done-{version}-{base}-{next_id}"), True).close()

    def version(self) -> int:
        """Number of the last complete version, 0 for none."""
        return max(self._marks(), default=0)

    def next_id(self) -> int:
        marks = self._marks()
        return marks[max(marks)][1] if marks else 1

    def _versions(self) -> list[int]:
        marks = self._marks()
        return [v for v in sorted(marks) if v >= marks[max(marks)][0]] if marks else []

    def _all(self, table: str) -> DataFrame | None:
        out = None
        for v in self._versions():
            part = self.spark.read.parquet(f"{self.path}/v{v}/{table}").withColumn("_v", F.lit(v))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, table: str) -> DataFrame | None:
        """seen (key, digest) or rows, as of the last version."""
        seen = self._all("seen")
        if seen is None:
            return None
        last = seen.groupBy(self.key).agg(F.max(F.struct("_v", self.digest)).alias("_s"))
        if table == "seen":
            return last.select(self.key, F.col(f"_s.{self.digest}").alias(self.digest))
        return self._all(table).join(last.select(self.key, F.col("_s._v").alias("_v")), [self.key, "_v"], "left_semi").drop("_v")

    def apply(self, files: DataFrame, process: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Take in files (key, digest, ...): process the new and changed ones into rows with the key. Returns counts by change.

        Of several states of a file in one batch the newest by modificationTime counts, or the greatest digest where there is no such column.
        """
        v, seen, first = self.version(), self.read("seen"), self.next_id()
        known = seen if seen is not None else files.select(self.key, self.digest).limit(0)
        time = [F.col("modificationTime")] if "modificationTime" in files.columns else []
        newest = files.groupBy(self.key).agg(F.max(F.struct(*time, self.digest)).alias("_n")).select(self.key, F.col(f"_n.{self.digest}").alias(self.digest))
        one = files.join(newest, [self.key, self.digest], "left_semi").dropDuplicates([self.key])
        judged = changes(one, known, self.key, self.digest).persist()
        try:
            counts = {r["change"]: r["count"] for r in judged.groupBy("change").count().collect()}
            if not counts.get("new") and not counts.get("changed"):
                return counts
            todo = judged.filter("change <> 'unchanged'").drop("change")
            fresh, path = process(todo), f"{self.path}/v{v + 1}"
            if self.id_col:
                fresh = next_ids(fresh, self.order or [self.key], first - 1, self.id_col)
            fresh.write.mode("overwrite").parquet(f"{path}/rows")
            todo.select(self.key, self.digest).write.mode("overwrite").parquet(f"{path}/seen")
            given = self.spark.read.parquet(f"{path}/rows").count() if self.id_col else 0
            marks = self._marks()
            self._mark(v + 1, marks[v][0] if v else 1, first + given)
            return counts
        finally:
            judged.unpersist()

    def compact(self) -> None:
        """One version in place of all; the old ones are removed after it counts. Not while a batch runs."""
        old, v = self._versions(), self.version()
        if len(old) < 2:
            return
        for table in ("rows", "seen"):
            self.read(table).write.mode("overwrite").parquet(f"{self.path}/v{v + 1}/{table}")
        marks = self._marks()
        self._mark(v + 1, v + 1, marks[v][1])
        fs, at = self._files()
        for k in old:
            fs.delete(at(f"{self.path}/done-{k}-{marks[k][0]}-{marks[k][1]}"), False)
            fs.delete(at(f"{self.path}/v{k}"), True)

    def run(self, stream: DataFrame, checkpoint: str, process: Callable[[DataFrame], DataFrame]):
        """Take in what a stream of files has now, batch by batch."""
        digested = stream.withColumn(self.digest, F.md5("content"))
        return digested.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: self.apply(batch, process) and None).start()


def next_ids(rows: DataFrame, order: list[str], last: int, name: str = "chunk_id") -> DataFrame:
    """Ids that go on from the last one given, in order."""
    from ..operators.profile import global_rank

    return global_rank(rows, *order, name=name).withColumn(name, F.col(name) + last)


def rate_limited(events: DataFrame, key: str, time: str, most: int, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows in which a key has more than most events; works on a stream (late events dropped) and on a table alike."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    n = e.groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > most).select(F.col("w.start").alias("window_start"), key, "n")


def windowed_latency(events: DataFrame, time: str, value: str, key: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    t = e.groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("worst"))
    return t.select(F.col("w.start").alias("window_start"), key, "n", "mean", "worst")


def stale_keys(events: DataFrame, key: str, time: str, minutes: int = 5):
    """Keys from whose last event some minutes of event time have passed: state per key with a timer, on a stream."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for frame in frames:
            last = max(last, int(frame[time].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    keyed = events.withWatermark(time, "0 seconds").groupBy(key)
    return keyed.applyInPandasWithState(step, f"{key} {kind}, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)

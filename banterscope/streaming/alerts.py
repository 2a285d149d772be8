"""Alerts with a clock for each source, late rows kept, and alerts corrected.

Every micro-batch is one step from a version of the state to the next:

- **Clock.** Each source has its newest event time; the watermark is the least of them, less the delay, and never
  falls. A source that has sent nothing for a while does not hold the others back. An event time beyond the time at
  which the broker took the message, plus a tolerance, moves no clock: such rows, and rows without a time, are set
  aside.
- **Sums.** Scores are summed per user and pane, a pane being what slides and windows have as common measure. A
  user with very many messages sends one row a task and pane. Windows are sums of panes.
- **Alerts.** Windows that the watermark has passed since the last step are closed, and a user's rise is found by
  looking back over them, with the users who are toxic now as what went before.
- **Late rows** missed at least one closed window. They are stored as they came. For their users, the closed windows
  are built anew, and what differs is told: alerts withdrawn, alerts added. Beyond ``correct_seconds`` behind the
  watermark, sums are forgotten; later rows are stored only.

State and outputs are tables named after the batch and written over if the batch is run again, which reads the
version before: a replay changes nothing. Older versions of the state are deleted, outputs stay.

The state is rewritten with each step. It holds the panes that are open or may be corrected, one row for each user
who is toxic, and one for each source; nothing but the two clocks reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banterscope.config import PipelineConfig
from banterscope.functions.probability import is_toxic
from banterscope.operators.ordering import with_previous
from banterscope.sinks.streams import AVAILABLE_NOW

SECOND = 1_000_000
# Stand for the beginning and the end of time, in microseconds.
FIRST, LAST = -(1 << 60), 1 << 60
ROWS = "userid string, source string, event_time long, publish_time long, score double"
ALERTS = "userid string, score double, window_end timestamp"
STATE = {
    "clock": "watermark long, cut long",
    "sources": "source string, high long, seen long",
    "panes": "userid string, pane long, total double, messages long",
    "toxic": "userid string",
    "base": "userid string",
}
LATE = f"{ROWS}, corrected boolean"
CORRECTIONS = f"{ALERTS}, change int"
COUNTS = "source string, late long, on_time long, aside long"
WINDOWS = "userid string, start long, score double, toxic boolean"


@dataclass(frozen=True)
class AlertJob:
    """The steps of one alert stream, under ``root`` on shared storage."""

    cfg: PipelineConfig
    root: str
    keep_versions: int = 10

    # Tables.

    def _state(self, spark: SparkSession, version: int, name: str) -> DataFrame:
        if version < 0:
            return spark.createDataFrame([], STATE[name])
        return spark.read.schema(STATE[name]).parquet(f"{self.root}/state/{version}/{name}")

    def _put(self, frame: DataFrame, batch: int, name: str, kind: str = "outputs") -> None:
        place = f"{self.root}/state/{batch}/{name}" if kind == "state" else f"{self.root}/{name}/batch={batch}"
        frame.write.mode("overwrite").parquet(place)

    def _stored(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """All batches of an output; a batch without rows has no folder."""
        if not self._there(spark, f"{self.root}/{name}"):
            return spark.createDataFrame([], f"{schema}, batch long")
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    @staticmethod
    def _there(spark: SparkSession, folder: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    def alerts(self, spark: SparkSession) -> DataFrame:
        """Alerts as they were raised when their windows closed."""
        return self._stored(spark, "alerts", ALERTS)

    def corrections(self, spark: SparkSession) -> DataFrame:
        """What late rows changed: ``change`` is 1 for an alert added, -1 for one withdrawn."""
        return self._stored(spark, "corrections", CORRECTIONS)

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that missed a window, and whether alerts were corrected for them."""
        return self._stored(spark, "late", LATE)

    def out_of_range(self, spark: SparkSession) -> DataFrame:
        """Rows without a time, or with one that can't be."""
        return self._stored(spark, "out_of_range", ROWS)

    def counts(self, spark: SparkSession) -> DataFrame:
        """``source, on_time, late, aside`` of every batch."""
        return self._stored(spark, "counts", COUNTS)

    def corrected(self, spark: SparkSession) -> DataFrame:
        """``userid, score, window_end``: alerts with all corrections."""
        raised = self.alerts(spark).withColumn("change", F.lit(1))
        every = raised.unionByName(self.corrections(spark))
        # A withdrawal is followed by what takes its place, so the last score that was added counts.
        last = F.max_by("score", F.struct("batch", "change"))
        net = every.groupBy("userid", "window_end").agg(F.sum("change").alias("net"), last.alias("score"))
        return net.where("net > 0").select("userid", "score", "window_end")

    # Windows of panes.

    @property
    def _pane(self) -> int:
        return math.gcd(self.cfg.window_seconds, self.cfg.slide_seconds) * SECOND

    def _window_starts(self, pane: Column) -> tuple[Column, Column]:
        """The first and the last window that a pane is part of."""
        slide = self.cfg.slide_seconds * SECOND
        reach = self.cfg.window_seconds * SECOND - self._pane
        return F.ceil((pane - reach) / F.lit(slide)).cast("long") * slide, F.floor(pane / F.lit(slide)).cast("long") * slide

    def _windows(self, panes: DataFrame, low: int, high: int) -> DataFrame:
        """``userid, start, score, toxic`` of the windows that end after ``low`` and not after ``high``."""
        length, slide = self.cfg.window_seconds * SECOND, self.cfg.slide_seconds * SECOND
        first, last = self._window_starts(F.col("pane"))
        # Panes outside these windows needn't be spread over windows first.
        panes = panes.where((F.col("pane") > low - length) & (F.col("pane") < high))
        spread = panes.select("userid", F.explode(F.sequence(first, last, F.lit(slide))).alias("start"), "total", "messages")
        inside = spread.where((F.col("start") > low - length) & (F.col("start") <= high - length))
        sums = inside.groupBy("userid", "start").agg(F.sum("total").alias("total"), F.sum("messages").alias("messages"))
        score = F.coalesce("total", F.lit(0.0)) / F.col("messages")
        return sums.select("userid", "start", score.alias("score")).withColumn("toxic", is_toxic(F.col("score"), self.cfg.toxic_threshold))

    def _rises(self, windows: DataFrame, before: DataFrame) -> DataFrame:
        """``userid, score, window_end`` where a user turns toxic; ``before`` names who was when the first window began."""
        known = before.select("userid", F.lit(FIRST).alias("start"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("toxic"))
        slice_of = F.floor(F.col("start") / (self.cfg.slice_seconds * SECOND))

        def rises(was_toxic: Column) -> Column:
            return F.col("toxic") & ~F.coalesce(was_toxic, F.lit(False))

        seen = with_previous(windows.unionByName(known), ["userid"], "start", slice_of, F.col("toxic"), "_was", rises)
        found = seen.where(rises(F.col("_was")) & (F.col("start") > FIRST))
        end = F.timestamp_micros(F.col("start") + self.cfg.window_seconds * SECOND)
        return found.select("userid", "score", end.alias("window_end"))

    @staticmethod
    def _last_toxic(windows: DataFrame, before: DataFrame) -> DataFrame:
        """Users who are toxic in their last window, or were before and have none."""
        last = windows.groupBy("userid").agg(F.max_by("toxic", "start").alias("toxic"))
        return last.where("toxic").select("userid").unionByName(before.join(last, "userid", "left_anti"))

    # Steps.

    def _watermark(self, sources: DataFrame, before: int) -> int:
        """The least clock of the sources that were seen lately, less the delay."""
        seen = sources.agg(F.max("seen")).first()[0]
        if seen is None:
            return before
        least = sources.where(F.col("seen") >= seen - self.cfg.idle_seconds * SECOND).agg(F.min("high")).first()[0]
        return max(before, int(least - self.cfg.delay_seconds * SECOND))

    def step(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of ``userid, source, event_time, publish_time, score``, times as timestamps."""
        spark, cfg = rows.sparkSession, self.cfg
        clock = self._state(spark, batch - 1, "clock").first()
        closed, cut = (clock["watermark"], clock["cut"]) if clock else (FIRST, FIRST)

        micros = (F.unix_micros(c).alias(c) for c in ("event_time", "publish_time"))
        plain = rows.select("userid", F.coalesce("source", F.lit("")).alias("source"), *micros, "score")
        sure = F.coalesce(F.col("event_time") <= F.col("publish_time") + cfg.clock_tolerance_seconds * SECOND, F.lit(False))
        pane = F.floor(F.col("event_time") / F.lit(self._pane)).cast("long") * self._pane
        first_end = self._window_starts(F.col("pane"))[0] + cfg.window_seconds * SECOND
        marked = plain.withColumn("sure", sure).withColumn("pane", pane)
        marked = marked.withColumn("late", F.col("sure") & (first_end <= closed)).withColumn("kept", F.col("sure") & (first_end > cut))
        self._put(marked, batch, "rows", "state")
        marked = spark.read.schema(f"{ROWS}, sure boolean, pane long, late boolean, kept boolean").parquet(f"{self.root}/state/{batch}/rows")

        # One pass tells the sources' clocks and what the batch holds.
        newest = [F.max(F.when(F.col("sure"), F.col(c))).alias(to) for c, to in (("event_time", "high"), ("publish_time", "seen"))]
        told = marked.groupBy("source").agg(*newest, F.count_if("late").alias("late"), F.count_if("sure").alias("sure"), F.count("*").alias("rows"))
        self._put(told.select("source", "late", (F.col("sure") - F.col("late")).alias("on_time"), (F.col("rows") - F.col("sure")).alias("aside"), "high", "seen"), batch, "counts")
        counts = spark.read.schema(f"{COUNTS}, high long, seen long").parquet(f"{self.root}/counts/batch={batch}")
        known = self._state(spark, batch - 1, "sources").unionByName(counts.where("high is not null").select("source", "high", "seen"))
        self._put(known.groupBy("source").agg(F.max("high").alias("high"), F.max("seen").alias("seen")), batch, "sources", "state")
        watermark = self._watermark(self._state(spark, batch, "sources"), closed)
        late, aside = counts.agg(F.coalesce(F.sum("late"), F.lit(0)), F.coalesce(F.sum("aside"), F.lit(0))).first()
        names = [c.split()[0] for c in ROWS.split(", ")]
        if aside:
            self._put(marked.where(~F.col("sure")).select(*names), batch, "out_of_range")
        if late:
            self._put(marked.where("late").select(*names, F.col("kept").alias("corrected")), batch, "late")

        old = self._state(spark, batch - 1, "panes")
        sums = marked.where("kept").groupBy("userid", "pane").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("messages"))
        both = old.unionByName(sums).groupBy("userid", "pane").agg(F.sum("total").alias("total"), F.sum("messages").alias("messages"))
        self._put(both, batch, "sums", "state")
        panes = spark.read.schema(STATE["panes"]).parquet(f"{self.root}/state/{batch}/sums")

        base, toxic = self._state(spark, batch - 1, "base"), self._state(spark, batch - 1, "toxic")
        if late:
            touched = marked.where("late and kept").select("userid").distinct()
            of = lambda frame: frame.join(touched, "userid", "left_semi")
            again = self._windows(of(panes), cut, closed)
            self._put(self._changes(self._rises(self._windows(of(old), cut, closed), of(base)), self._rises(again, of(base))), batch, "corrections")
            toxic = toxic.join(touched, "userid", "left_anti").unionByName(self._last_toxic(again, of(base)))

        closing = self._windows(panes, closed, watermark)
        if watermark > closed:
            self._put(closing, batch, "closing", "state")
            closing = spark.read.schema(WINDOWS).parquet(f"{self.root}/state/{batch}/closing")
            self._put(self._rises(closing, toxic), batch, "alerts")
            toxic = self._last_toxic(closing, toxic)
        self._put(toxic, batch, "toxic", "state")
        # What is forgotten leaves behind who was toxic then.
        cut_now = max(cut, watermark - cfg.correct_seconds * SECOND) if cfg.correct_seconds >= 0 and watermark > FIRST else cut
        if cut_now > cut:
            gone = closing.where(F.col("start") + cfg.window_seconds * SECOND <= cut_now)
            gone = gone.unionByName(self._windows(panes, cut, min(closed, cut_now))) if closed > cut else gone
            base = self._last_toxic(gone, base)
        self._put(base, batch, "base", "state")
        needed = F.col("pane") > cut_now - cfg.window_seconds * SECOND - self._pane
        self._put(panes.where(needed), batch, "panes", "state")
        self._put(spark.createDataFrame([(watermark, cut_now)], STATE["clock"]).coalesce(1), batch, "clock", "state")
        self._forget(spark, batch - self.keep_versions)

    @staticmethod
    def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
        """Alerts that are no longer, and alerts that are new; where only the score changed, both."""
        one, two = old.withColumnRenamed("score", "_old"), new.withColumnRenamed("score", "_new")
        both = one.join(two, ["userid", "window_end"], "full")
        both = both.where("_old is null or _new is null or abs(_old - _new) > 1e-9")
        change = F.explode(F.array(F.struct(F.col("_old").alias("score"), F.lit(-1).alias("change")), F.struct(F.col("_new").alias("score"), F.lit(1).alias("change"))))
        told = both.select("userid", "window_end", change.alias("c")).where("c.score is not null")
        return told.select("userid", "c.score", "window_end", "c.change")

    def _forget(self, spark: SparkSession, version: int) -> None:
        """Deletes a version of the state that no replay needs."""
        if version >= 0:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state/{version}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def still_open(self, spark: SparkSession, version: int) -> DataFrame:
        """``userid, score, window_end``: alerts of the windows that are open after a batch, as if the input ended there."""
        clock = self._state(spark, version, "clock").first()
        closed = clock["watermark"] if clock else FIRST
        return self._rises(self._windows(self._state(spark, version, "panes"), closed, LAST), self._state(spark, version, "toxic"))

    def start(self, rows: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Run the steps over a stream of rows."""
        writer = rows.writeStream.foreachBatch(lambda frame, batch: self.step(frame, batch)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or AVAILABLE_NOW)).start()

    def last_version(self, query: StreamingQuery) -> int:
        """The last batch that a stream has run; -1 if none."""
        return max((p["batchId"] for p in query.recentProgress), default=-1)

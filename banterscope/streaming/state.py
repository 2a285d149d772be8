"""Per-user state: who is toxic now."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from banterscope.config import PipelineConfig
from banterscope.functions.probability import is_toxic
from banterscope.schema import FLAG


class ToxicUsers(StatefulProcessor):
    """Lets a window through when its user turns toxic, and remembers only toxic users."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._toxic = handle.getValueState("toxic", "since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The windows of a user that close in one micro-batch: few, as they are already
        # aggregated; they may come in any order.
        windows = pd.concat(list(rows)).sort_values("window_end")
        was_toxic = self._toxic.exists()
        before = windows["toxic"].shift(fill_value=was_toxic).astype(bool)
        rising = windows[windows["toxic"] & ~before]
        stays_toxic = bool(windows["toxic"].iloc[-1])
        if stays_toxic and (not was_toxic or len(rising)):
            since = windows["window_end"].iloc[-1] if rising.empty else rising["window_end"].iloc[-1]
            self._toxic.update((since.to_pydatetime(),))
        elif was_toxic and not stays_toxic:
            self._toxic.clear()
        if len(rising):
            yield rising[["userid", "score", "window_end"]]

    def close(self) -> None:
        pass


def flag_stream(windows: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Closed windows in, alerts out. Needs the RocksDB state store."""
    marked = windows.select(
        "userid", "score", "window_end", is_toxic(F.col("score"), cfg.toxic_threshold).alias("toxic")
    )
    return marked.groupBy("userid").transformWithStateInPandas(
        statefulProcessor=ToxicUsers(),
        outputStructType=FLAG,
        outputMode="append",
        timeMode="none",
    )

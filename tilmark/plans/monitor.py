"""Counts and timings of runs: observed metrics of batches, progress of streams."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


def observed(results: DataFrame, name: str = "results") -> tuple[DataFrame, Observation]:
    """Results whose action also counts rows by status and sums up error rates, without another job."""
    seen = Observation(name)
    count = lambda s: F.count_if(F.col("match_status") == s).alias(s)
    parts = [F.count("*").alias("rows"), *map(count, ("exact", "matched", "not_found", "below_threshold")), F.avg("wer").alias("mean_wer"), F.avg("cer").alias("mean_cer")]
    return results.observe(seen, *parts), seen


class ProgressLog(StreamingQueryListener):
    """Logs each micro-batch: number, rows and seconds, rounded to three places."""

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        log.info("batch %s: %s rows in %s s", p.batchId, p.numInputRows, round(p.batchDuration / 1000, 3))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        log.info("stream %s ended", event.id)

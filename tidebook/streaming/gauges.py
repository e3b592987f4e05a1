"""Counts taken while rows are written, and gauges of running streams: neither costs a job."""

from __future__ import annotations

from collections import defaultdict, deque

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Batches that gauges keep of each stream.
KEPT = 100
#: Fixed value: name of the count that a stream takes of its input.
INPUT = "input"


class Counted:
    """Rows with aggregates that the job which uses them computes on its way."""

    def __init__(self, rows: DataFrame, *aggregates: Column):
        self.plain, self.aggregates = rows, aggregates
        self.seen = Observation()
        self.rows = rows.observe(self.seen, *aggregates)

    def facts(self) -> dict:
        """The aggregates, once that job has succeeded. A job that found nothing to write may have been planned anew
        without them; only then they are computed."""
        try:
            found = self.seen.get
        except Py4JJavaError:
            found = {}
        return dict(found) or self.plain.agg(*self.aggregates).first().asDict()


def counted_input(stream: DataFrame) -> DataFrame:
    return stream.observe(INPUT, F.count(F.lit(1)).alias("rows"))


class Gauges(StreamingQueryListener):
    """The last batches of every stream: rows in, rows counted at the source, rates and duration."""

    def __init__(self, kept: int = KEPT):
        self.batches: dict[str, deque] = defaultdict(lambda: deque(maxlen=kept))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = p.observedMetrics.get(INPUT)
        self.batches[p.name or str(p.id)].append(
            {
                "batch_id": p.batchId,
                "rows": p.numInputRows,
                "counted": observed["rows"] if observed else None,
                "in_per_s": p.inputRowsPerSecond or 0.0,
                "out_per_s": p.processedRowsPerSecond or 0.0,
                "duration_ms": p.durationMs.get("triggerExecution"),
            }
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def last(self, name: str) -> dict | None:
        found = self.batches.get(name)
        return found[-1] if found else None

"""Table functions for SQL over partitioned tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import timezone

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class TraceSteps:
    """``trace_steps(TABLE(t) PARTITION BY (otype, oid) ORDER BY (ts, eid))``: all columns of the table, which has ``activity`` and
    ``ts`` among them, with

    - step: the row's place in its partition, from 0,
    - gap_us: microseconds since the row before that has a time (null: none, or no time),
    - seen: how often the partition has had this activity before; above 0 the row closes a loop.

    Rows are streamed in the order asked for; what is held of a partition is a time and a count for each activity. One
    partition is one task's work: for objects that hold most of the events use `traces.pairs`, which works in spans.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"activity", "ts"} <= set(rows.dataType.names):
            raise ValueError("trace_steps needs a table with the columns activity and ts")
        if taken := {"step", "gap_us", "seen"} & set(rows.dataType.names):
            raise ValueError(f"trace_steps gives {sorted(taken)} itself")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("step", LongType()), StructField("gap_us", LongType()), StructField("seen", LongType())]))

    def __init__(self) -> None:
        self.step, self.last, self.seen = 0, None, Counter()

    def eval(self, row: Row) -> Iterator[tuple]:
        at = row["ts"]
        # As UTC: a zone's clock repeats an hour.
        now = None if at is None else round(at.astimezone(timezone.utc).timestamp() * 1_000_000)
        yield (*row, self.step, None if now is None or self.last is None else now - self.last, self.seen[row["activity"]])
        self.step += 1
        self.seen[row["activity"]] += 1
        self.last = now if now is not None else self.last


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("trace_steps", udtf(TraceSteps))

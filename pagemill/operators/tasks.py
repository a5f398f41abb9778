"""A handler over rows, with attempts counted and errors kept as data.

Lost executors and tasks are Spark's own to repeat; this is for rows whose handler fails by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 5


def handled(rows: DataFrame, column: str, handler: Callable[[object, int], str | None], attempts: int = ATTEMPTS, after: Callable[[object, str | None, str | None, int], str | None] | None = None, on_error: Callable[[str, int, object], str | None] | None = None) -> DataFrame:
    """The rows with result, error and attempts: handler(value, attempt) is called until it does not raise, at most `attempts` times.

    error is the last failure's text, null after success.  after(value, result, error, attempt) follows every attempt,
    on_error(error, attempt, value) every failed one; what they return, but None, is kept in order in the column events.
    """

    def call(value) -> tuple[str | None, str | None, int, list[str]]:
        error, events = None, []
        for attempt in range(1, attempts + 1):
            result, error = None, None
            try:
                result = handler(value, attempt)
            except Exception as e:  # noqa: BLE001  (whatever the handler raises is the row's error)
                error = f"{type(e).__name__}: {e}"
            told = [on_error(error, attempt, value)] if error and on_error else []
            told += [after(value, result, error, attempt)] if after else []
            events += [x for x in told if x is not None]
            if error is None:
                return result, None, attempt, events
        return None, error, attempts, events

    new = ["result", "error", "attempts", "events"]
    keep = [c for c in rows.columns if c not in new]

    def run(batches):
        for batch in batches:
            found = [call(v) for v in batch.column(column).to_pylist()]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
            yield pa.record_batch([*(batch.column(c) for c in keep), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], [*keep, *new])

    rows = rows.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("result string, error string, attempts int, events array<string>").fields]))


def progress(rows: DataFrame) -> DataFrame:
    """Counts by outcome of handled rows: outcome, n."""
    return rows.groupBy(F.when(F.col("error").isNull(), "done").otherwise("failed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))

"""Written tables, and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import shared_dir, written

__all__ = ["shared_dir", "small_batches", "some_rows", "written"]
#: Texts that travel to Python at once; near copies compress so well that a small partition can hold very many.
BATCH_ROWS = 256
_STEPS = 1 << 40


def some_rows(df: DataFrame, n: int, key: F.Column) -> DataFrame:
    """About ``n`` rows (all, if there are fewer), chosen by the hash of a key.

    A filter on the executors: what is sent on doesn't grow with the number of
    partitions, as a top list of each would.
    """
    rows = df.count()
    share = min(_STEPS, -(-n * _STEPS // max(rows, 1)))
    return df.where(F.pmod(F.xxhash64(key), F.lit(_STEPS)) < share)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of texts bounded in rows for the session from now on."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df

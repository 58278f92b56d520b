"""Numbers in a total order without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written


def numbered(df: DataFrame, name: str, *keys: Column | str) -> DataFrame:
    """``df`` with the place of each row in the order of some keys, from 1; rows with equal keys in any order.

    Rows are dealt by ranges, sorted and numbered within each; what comes to the
    driver is one count for each range.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    dealt = written(dealt.withColumns({"range id": F.shiftright(place, 33).cast("int"), "range place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = dict(dealt.groupBy("range id").count().collect())
    ids = sorted(counts)
    starts = dict(zip(ids, accumulate([0, *(counts[k] for k in ids[:-1])]), strict=True)) if ids else {}
    before = dealt.sparkSession.createDataFrame(list(starts.items()), "`range id` int, `range start` long")
    out = dealt.join(F.broadcast(before), "range id", "left")
    return out.withColumn(name, (F.col("range start") + F.col("range place") + 1).cast("long")).drop("range id", "range place", "range start")


def spaced(df: DataFrame, limit: int, *keys: Column | str) -> DataFrame:
    """``limit`` rows (all, if there are fewer) at even distances in the order of some keys."""
    n = F.col("place in order")
    rows = numbered(df, "place in order", *keys)
    whole = max(rows.count(), 1)
    limit = min(limit, whole)
    return rows.where(F.floor(n * limit / whole) != F.floor((n - 1) * limit / whole)).drop("place in order")

"""Window frames and functions that Spark's parser or planner lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = None


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int | None, end: int | None, **aggs: Column) -> DataFrame:
    """Aggregates over a GROUPS frame: offsets count peer groups. A dense rank numbers the groups, and a
    RANGE frame over it holds the same rows."""
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(low, high)
    return ranked.withColumns({name: agg.over(frame) for name, agg in aggs.items()}).drop("_group")


def exclude(df: DataFrame, partition: list[str], order: list[Column], x: str, kind: str, start: int | None, end: int | None, out: dict[str, str]) -> DataFrame:
    """sum, count, avg, min or max of x over ROWS BETWEEN start AND end EXCLUDE kind.

    out: new name to function. kind: current_row, group (the row's peers and itself) or ties (peers
    only). The values of a frame with two bounds are listed with their peer numbers, and those excluded filtered
    out; one without a bound holds the current row and is put together from what lies before and behind what is
    excluded, as running values on the open side, so no list grows with the partition.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    ranked = df.withColumns({"_peer": F.dense_rank().over(w), "_row": F.row_number().over(w)})
    if start is None or end is None:
        return _exclude_open(ranked, partition, x, kind, start, end, out).drop("_peer", "_row")
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    frame = F.collect_list(F.struct("_peer", "_row", F.col(x).alias("_x"))).over(w.rowsBetween(low, high))
    same, mine = (lambda r: r["_peer"] == F.col("_peer")), (lambda r: r["_row"] == F.col("_row"))
    gone = {"current_row": mine, "group": same, "ties": lambda r: same(r) & ~mine(r)}[kind]
    held = ranked.withColumn("_frame", frame).withColumn("_frame", F.filter(F.transform(F.filter("_frame", lambda r: ~gone(r)), lambda r: r["_x"]), lambda v: v.isNotNull()))
    total = F.aggregate("_frame", F.lit(0.0), lambda s, v: s + v)
    n = F.size("_frame")
    known = {"sum": F.when(n > 0, total), "count": n.cast("bigint"), "avg": F.when(n > 0, total / n), "min": F.array_min("_frame"), "max": F.array_max("_frame")}
    return held.withColumns({name: known[f] for name, f in out.items()}).drop("_frame", "_peer", "_row")


def _side(partition: list[str], x: str, key: str, bound: int | None, before: bool) -> dict[str, Column]:
    """Sum, count, min and max of x over the rows on one side whose key differs from the current row's."""
    at = Window.partitionBy(*partition)
    if bound is None:
        rows = at.orderBy(F.col(key) if before else F.col(key).desc()).rangeBetween(Window.unboundedPreceding, -1)
        return {"sum": F.sum(x).over(rows), "count": F.count(x).over(rows), "min": F.min(x).over(rows), "max": F.max(x).over(rows)}
    if bound == 0:
        return {"sum": F.lit(None), "count": F.lit(0), "min": F.lit(None), "max": F.lit(None)}
    rows = at.orderBy("_row").rowsBetween(*((bound, -1) if before else (1, bound)))
    near = F.filter(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).alias("x"))).over(rows), lambda r: (r["k"] != F.col(key)) & r["x"].isNotNull())
    values = F.transform(near, lambda r: r["x"])
    return {"sum": F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v)), "count": F.size(values), "min": F.array_min(values), "max": F.array_max(values)}


def _exclude_open(ranked: DataFrame, partition: list[str], x: str, kind: str, start: int | None, end: int | None, out: dict[str, str]) -> DataFrame:
    if (start or 0) > 0 or (end or 0) < 0:
        raise ValueError("a frame without a bound has to hold the current row")
    key = "_row" if kind == "current_row" else "_peer"
    sides = [_side(partition, x, key, start, True), _side(partition, x, key, end, False)]
    if kind == "ties":
        one = F.col(x)
        sides.append({"sum": one, "count": F.when(one.isNotNull(), 1).otherwise(0), "min": one, "max": one})
    n = reduce(lambda a, b: a + b, [s["count"] for s in sides]).cast("bigint")
    total = F.when(n > 0, reduce(lambda a, b: a + b, [F.coalesce(s["sum"].cast("double"), F.lit(0.0)) for s in sides]))
    known = {"sum": total, "count": n, "avg": total / n, "min": F.least(*[s["min"] for s in sides]), "max": F.greatest(*[s["max"] for s in sides])}
    return ranked.withColumns({name: known[f] for name, f in out.items()})


def exclude_current(agg_sum: Column, agg_count: Column, x: Column) -> tuple[Column, Column]:
    """Sum and count over a frame that holds the current row, without it: no list is built, for frames of any size."""
    one = F.when(x.isNotNull(), 1).otherwise(0)
    n = agg_count - one
    return F.when(n > 0, agg_sum - F.coalesce(x, F.lit(0))), n


def shift(df: DataFrame, partition: list[str], order: list[Column], x: str, offset: Column, out: str, lead: bool = False, default: Column | None = None) -> DataFrame:
    """lag/lead with an offset that differs by row: an equi join on partition and row number."""
    rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    rows = rows.withColumn("_at", F.col("_row") + (offset if lead else -offset))
    other = rows.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_row").alias("_r"), F.col(x).alias("_x"), F.lit(True).alias("_hit"))
    on = [F.col(p).eqNullSafe(F.col(f"_p{i}")) for i, p in enumerate(partition)] + [F.col("_at") == F.col("_r")]
    value = F.when(F.col("_hit"), F.col("_x")).otherwise(default if default is not None else F.lit(None))
    return rows.join(other, on, "left").withColumn(out, value).select(*df.columns, out)


def distinct_over(x: Column, window) -> Column:
    """count(DISTINCT x) OVER window."""
    return F.size(F.collect_set(x).over(window)).cast("bigint")


def filtered_over(agg, x: Column, condition: Column, window) -> Column:
    """agg(x) FILTER (WHERE condition) OVER window."""
    return agg(F.when(condition, x)).over(window)


def top_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int, ties: bool = True) -> DataFrame:
    """Rows of rank at most n in each partition; Spark limits each task's groups before the shuffle."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int, out: str = "session") -> DataFrame:
    """Gaps and islands: rows of a key with less than gap_seconds between them share a number."""
    w = Window.partitionBy(*keys).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.when(seconds - F.lag(seconds).over(w) < gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fresh")

"""Joins that Spark's planner has no operator for: as-of, range, and joins with skewed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False, width: float | None = None) -> DataFrame:
    """For each left row the last right row of the same key at or before its time (ties: any one); null keys and times meet nothing.

    One union, one shuffle on the key and one sort; the running last value fills in. No row pairs are made.
    width: where a key may hold a large part of the rows, the time (seconds, or the number itself) that one task sorts of
    it. Each span then starts from the last right row of the spans before, found over one row a key and span.
    """
    order = F.lit(0 if strict else 1)
    mark = F.struct(*[F.col(c) for c in columns])
    blank = F.lit(None).cast(right.select(mark.alias("x")).schema["x"].dataType)
    right = right.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*by, right_time]]))
    a = left.withColumns({"_time": F.col(left_time), "_side": order, "_from": blank})
    b = right.select(*by, F.col(right_time).alias("_time"), F.lit(1 if strict else 0).alias("_side"), mark.alias("_from"))
    both = a.withColumn("_left", F.lit(True)).unionByName(b, allowMissingColumns=True)
    spans = list(by)
    if width is not None:
        seconds = F.col("_time").cast("timestamp") if "time" in dict(both.dtypes)["_time"] or dict(both.dtypes)["_time"] == "date" else F.col("_time")
        both = both.withColumn("_span", F.floor(seconds.cast("double") / width))
        ends = both.groupBy(*by, "_span").agg(F.max_by("_from", F.when(F.col("_left").isNull(), F.col("_time"))).alias("_end"), F.max("_left").alias("_asked"))
        before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.withColumn("_from", F.last("_end", ignorenulls=True).over(before)).where("_asked AND _from IS NOT NULL")
        both = both.unionByName(starts.select(*by, "_span", F.lit(-1).alias("_side"), "_from"), allowMissingColumns=True)
        spans.append("_span")
    # A row without a time comes first: the start of its span.
    window = Window.partitionBy(*spans).orderBy(F.col("_time").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_from", ignorenulls=True).over(window)).where("_left")
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


#: The class of ranges without an end: all are in one bin.
_ENDLESS = 2000


def _class_of(low: str, high: str, width: float) -> Column:
    """Ranges of up to width are of class 0, of up to twice as much of class 1, and so on."""
    length = F.col(high).cast("double") - F.col(low).cast("double")
    bounded = (F.abs(F.col(low).cast("double")) < 1e300) & (F.abs(F.col(high).cast("double")) < 1e300)
    return F.when(bounded, F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(width)) / width)))).otherwise(_ENDLESS).cast("int")


def _bin(x: Column, cls: Column, width: float) -> Column:
    return F.when(cls == _ENDLESS, F.lit(0).cast("bigint")).otherwise(F.floor(x.cast("double") / (F.lit(width) * F.pow(F.lit(2.0), cls))).cast("bigint"))


def _classes(ranges: DataFrame, low: str, high: str, width: float) -> Column:
    """The classes that occur, a short list: some 1,100 are possible, real data have a few."""
    found = ranges.where(F.col(low) <= F.col(high)).select(_class_of(low, high, width).alias("c")).distinct().collect()
    return F.array(*[F.lit(r["c"]) for r in found]).cast("array<int>")


def point_in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """points JOIN ranges ON point BETWEEN low AND high, by bins as wide as the ranges: a range is in the class
    of the least power of two times `width` that holds it, and meets two bins of that class at most, however
    long it is; a point is copied once for each class that occurs. The bins make it an equi join,
    which Spark shuffles and splits. Exact for every width; choose it near the usual length of a range."""
    cls = _class_of(low, high, width)
    cut = ranges.where(F.col(low) <= F.col(high)).withColumn("_class", cls)
    cut = cut.withColumn("_bin", F.explode(F.sequence(_bin(F.col(low), F.col("_class"), width), _bin(F.col(high), F.col("_class"), width))))
    sent = points.withColumn("_class", F.explode(_classes(ranges, low, high, width)))
    joined = sent.withColumn("_bin", _bin(F.col(point), F.col("_class"), width)).join(cut, ["_class", "_bin"])
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bin", "_class")


def overlapping(left: DataFrame, right: DataFrame, low: tuple[str, str], high: tuple[str, str], width: float) -> DataFrame:
    """left JOIN right ON the ranges overlap (ends included). A range of one side is copied, for each class of
    the other, into the bins of the wider class of both that it meets, two at most; a pair is taken only in the
    bin where the later of both begins, so it comes once."""

    def sent(side: DataFrame, own: int) -> DataFrame:
        other = (right, left)[own]
        rows = side.where(F.col(low[own]) <= F.col(high[own])).withColumn("_own", _class_of(low[own], high[own], width))
        rows = rows.withColumn("_other", F.explode(_classes(other, low[1 - own], high[1 - own], width))).withColumn("_wide", F.greatest("_own", "_other"))
        bins = F.sequence(_bin(F.col(low[own]), F.col("_wide"), width), _bin(F.col(high[own]), F.col("_wide"), width))
        names = {"_own": ("_left", "_right")[own], "_other": ("_right", "_left")[own]}
        return rows.withColumn("_bin", F.explode(bins)).withColumnsRenamed(names)

    joined = sent(left, 0).join(sent(right, 1).drop("_wide"), ["_left", "_right", "_bin"])
    meet = (F.col(low[0]) <= F.col(high[1])) & (F.col(low[1]) <= F.col(high[0]))
    first = F.col("_bin") == _bin(F.greatest(*[F.col(c) for c in low]), F.col("_wide"), width)
    return joined.where(meet & first).drop("_left", "_right", "_bin", "_wide")


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, most_keys: int = 10_000, how: str = "inner") -> DataFrame:
    """An equi join whose frequent left keys are spread over `salts` tasks: their right rows are copied.

    how: inner, left, left_semi or left_anti; with others an unmatched right row's copies would come too.
    Frequent is a key of more than 1 / most_keys of the rows, so there are fewer than most_keys of
    them, which bounds what is broadcast; all other keys are joined as they are. A row's salt is a hash of its
    values, the same in every run of its task. Rows with a null key match nothing and are spread likewise.
    """
    how = {"semi": "left_semi", "anti": "left_anti", "left_outer": "left"}.get(how, how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}: right rows are copied")
    n = left.count()
    hot = F.broadcast(left.groupBy(*on).count().where(F.col("count") > n / most_keys).select(*on, F.lit(True).alias("_hot")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    no_key = F.greatest(*[F.col(k).isNull() for k in on], F.lit(False))
    a = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot") | no_key, spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def bpchar_equal(a: Column, b: Column) -> Column:
    """char(n) equality: trailing blanks do not count."""
    return F.rtrim(a) == F.rtrim(b)

"""Each row beside the next one in descending order of an id, without one task that sees all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Ranges at most, whose bounds (some 80 bytes each) are part of the plan. Beyond MOST_RANGES x rows_per_range rows
#: the ranges grow with the table: 10^10 rows would give 500,000 in each, which a task sorts with spilling.
MOST_RANGES = 20_000
_PER_RANGE = 16
_TIE_BYTES = 32


def _descending(text: str) -> Column:
    """A string that falls where the text rises, from its first bytes: texts that start alike have the same."""
    start = F.hex(F.substring(F.col(text).cast("binary"), 1, _TIE_BYTES))
    return F.rpad(F.translate(start, "0123456789ABCDEF", "FEDCBA9876543210"), 2 * _TIE_BYTES, "G")


def _bounds(rows: DataFrame, pair: Column, ranges: int, n: int) -> list[tuple[int | None, str]]:
    """The ranges' lower bounds (key, tie) in ascending order, nulls first: quantiles of a sample of about
    16 rows a range, chosen by a hash. A key that many rows share is cut into several ranges by its tie."""
    sample = rows.select(pair.alias("p")).where(common.share_below(_PER_RANGE * ranges / max(1, n), F.col("p"))).select("p.*")
    found = sorted((k is not None, k or 0, t) for k, t in zip(*(c.to_pylist() for c in sample.toArrow().columns)))
    picked = sorted({found[i] for i in np.linspace(0, len(found) - 1, ranges + 1).round().astype(int)[1:-1]}) if found else []
    return [(k if known else None, t) for known, k, t in picked]


def _search(size: int, not_above) -> Column:
    """How many of `size` ascending bounds are not above the row's place; not_above tells it of the bound at an index."""
    steps = [1 << b for b in reversed(range(size.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= size) & not_above(at + step - 1), at + step).otherwise(at))


def _range_of(bounds: list[tuple[int | None, str]], key: Column, tie: Column) -> Column:
    """The range of a row. Bounds are constants of the plan (a split text, which the optimizer folds)."""
    nulls, others = [t for k, t in bounds if k is None], [(k, t) for k, t in bounds if k is not None]
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",")
    null_ties, keys, ties = constant(nulls), constant([k for k, _ in others]).cast("array<bigint>") if others else None, constant([t for _, t in others])
    among_nulls = _search(len(nulls), lambda i: F.get(null_ties, i) <= tie)
    among_others = _search(len(others), lambda i: (F.get(keys, i) < key) | (F.get(keys, i) == key) & (F.get(ties, i) <= tie))
    return F.when(key.isNull(), among_nulls).otherwise(F.lit(len(nulls)) + among_others)


def with_next(rows: DataFrame, key: str, tie: str, carry: dict[str, str], rows_per_range: int = 2000) -> tuple[DataFrame, Window]:
    """rows with the columns in carry (new name: column) of the row that follows by descending key, and
    after the last row those of the first; and the window, for more columns of the same neighbour.

    key is a bigint column; a key that is null comes last. tie is a text column without nulls: equal keys are
    ordered by it, ascending. Rows are dealt by ranges of the key and of the text's first 32 bytes, whose bounds come from a
    sample, so neither uneven keys nor one key for a third of the rows leave most rows to one task; only
    rows of one key whose texts start alike stay together. The first rows of each range also go, as ghosts, to the
    range before it, and the very first to the last range. Call drop_ghosts() at the end. One row is its
    own neighbour; an empty table gives no rows.
    """
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // rows_per_range))
    pair = F.struct(F.col(key).alias("k"), _descending(tie).alias("t"))
    place = _range_of(_bounds(rows, pair, ranges, n), F.col(key), _descending(tie)) if ranges > 1 else F.lit(0)
    dealt = rows.withColumn("_range", place.cast("int"))
    heads = dealt.groupBy("_range").agg(F.max(pair).alias("_head"))
    by_range = Window.orderBy(F.col("_range").desc())
    whole = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most MOST_RANGES rows meet here, whatever the size of the table.
    heads = heads.select("_range", "_head", F.coalesce(F.lag("_range").over(by_range), F.min("_range").over(whole)).alias("_to"))
    meet = F.broadcast(heads.select(F.col("_range").alias("_from"), "_head", "_to"))
    ghosts = dealt.join(meet, (F.col("_range") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_head.k")) & (_descending(tie) == F.col("_head.t")))
    ghosts = ghosts.select(*[c for c in dealt.columns if c != "_range"], F.col("_to").alias("_range"), F.lit(True).alias("_ghost"))
    both = dealt.select(*[c for c in dealt.columns if c != "_range"], "_range", F.lit(False).alias("_ghost")).unionByName(ghosts)
    window = Window.partitionBy("_range").orderBy(F.col("_ghost"), F.col(key).desc_nulls_last(), F.col(tie))
    return both.select("*", *[F.lead(c).over(window).alias(new) for new, c in carry.items()]), window


def drop_ghosts(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("_ghost")).drop("_ghost", "_range")

"""Table changes as new DataFrames: insert, upsert, update, delete, merge, with the rows they changed.

Every function returns (table, changed): the table after the statement, and what RETURNING gives:
the key, `action`, and the struct columns old and new. Nothing is collected; one shuffle on the key serves each statement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.checks import ensure

Values = dict[str, Column]


def _struct(alias: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(f"{alias}.{c}").alias(c) for c in columns])


def insert(target: DataFrame, rows: DataFrame, defaults: Values | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... SELECT: missing columns take their default or null."""
    given = rows.select(*[(F.col(c) if c in rows.columns else (defaults or {}).get(c, F.lit(None))).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    new = F.struct(*target.columns)
    return target.unionByName(given), given.select(F.lit("INSERT").alias("action"), F.lit(None).cast(given.select(new.alias("x")).schema["x"].dataType).alias("old"), new.alias("new"))


@dataclass(frozen=True)
class When:
    """A branch of MERGE. kind: matched, not_matched or not_matched_by_source; action: update, delete,
    insert or nothing. set: new values over the aliases t and s; condition: over the same."""

    kind: str
    action: str
    set: Values | None = None
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, on: list[str], branches: list[When], repeats: str = "error", insert_once: str | None = None) -> tuple[DataFrame, DataFrame]:
    """MERGE INTO target t USING source s ON equal keys. The first branch that applies to a pair of rows acts.

    A target row that meets several source rows is changed by the one for which a branch acts, and comes
    once; where several would change it, that is an error (repeats="error") or any one of them does
    ("any"). Only keys that the source repeats pay for this, by a window over their pairs. insert_once: the error
    for source rows of one key without nulls that are not matched.
    """
    cols = target.columns
    often = source.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on)).groupBy(*on).agg(F.count("*").alias("_k")).where("_k > 1")
    repeated = not often.isEmpty()
    t = target.withColumn("_t", F.lit(True)).alias("t")
    marked = source.join(often, on, "left").select(*[source[c] for c in source.columns], "_k") if repeated else source.withColumn("_k", F.lit(None).cast("bigint"))
    s = marked.withColumn("_s", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "full")
    kind = F.when(F.col("_t") & F.col("_s"), "matched").when(F.col("_s"), "not_matched").otherwise("not_matched_by_source")
    both = both.withColumn("_kind", kind)
    branch = F.lit(-1)
    for i in reversed(range(len(branches))):
        b = branches[i]
        hit = F.col("_kind") == b.kind
        branch = F.when(hit & (b.condition if b.condition is not None else F.lit(True)), F.lit(i)).otherwise(branch)
    both = both.withColumn("_branch", branch)
    if repeated:
        both = _once(both, cols, source.columns, [i for i, b in enumerate(branches) if b.kind == "matched" and b.action in ("update", "delete")], repeats)
        if insert_once:
            both = ensure(both, ~((F.col("_kind") == "not_matched") & F.col("_k").isNotNull()), insert_once)
    action = F.lit(None).cast("string")
    new = {c: F.col(f"t.{c}") for c in cols}
    for i, b in enumerate(branches):
        mine = F.col("_branch") == i
        if b.action != "nothing":
            action = F.when(mine, F.lit(b.action.upper())).otherwise(action)
        for c in cols:
            if b.action == "update" and c in (b.set or {}):
                new[c] = F.when(mine, b.set[c].cast(target.schema[c].dataType)).otherwise(new[c])
            elif b.action == "insert":
                new[c] = F.when(mine, (b.set or {}).get(c, F.lit(None)).cast(target.schema[c].dataType)).otherwise(new[c])
    out = both.select(action.alias("action"), F.when(F.col("_t"), _struct("t", cols)).alias("old"), F.struct(*[v.alias(c) for c, v in new.items()]).alias("new"))
    stays = F.when(F.col("action") == "DELETE", False).otherwise(F.col("old").isNotNull() | (F.col("action") == "INSERT"))
    table = out.where(F.coalesce(stays, F.col("old").isNotNull())).select("new.*")
    changed = out.where("action IS NOT NULL").withColumn("new", F.when(F.col("action") != "DELETE", F.col("new")))
    return table, changed


def _once(both: DataFrame, cols: list[str], given: list[str], acts: list[int], repeats: str) -> DataFrame:
    """Pairs of a target row with several source rows, thinned to one a target row: that on which a branch acts.

    Equal target rows have equal pairs, so they share a digest and count as often as their pairs come."""
    digest = lambda alias, names: F.md5(F.to_json(F.struct(*[F.col(f"{alias}.{c}").alias(f"c{i}") for i, c in enumerate(names)]), {"ignoreNullFields": "false"}))
    several = (F.col("_kind") == "matched") & F.col("_k").isNotNull()
    # Other rows get a key of their own kind each, so that they are spread and pass through.
    row = F.when(several, digest("t", cols)).otherwise(F.concat(F.coalesce(digest("s", given), F.lit("")), F.lit("/"), F.coalesce(digest("t", cols), F.lit(""))))
    marked = both.withColumns({"_several": several, "_row": row, "_acts": F.col("_branch").isin(acts) if acts else F.lit(False)})
    w = Window.partitionBy("_several", "_row")
    counted = marked.withColumns({"_pairs": F.count("*").over(w), "_acting": F.count_if("_acts").over(w), "_nth": F.row_number().over(w.orderBy(F.col("_acts").desc(), digest("s", given)))})
    copies = F.col("_pairs") / F.col("_k")
    if repeats == "error":
        counted = ensure(counted, ~(F.col("_several") & (F.col("_acting") > copies)), "MERGE command cannot affect row a second time")
    return counted.where(~F.col("_several") | (F.col("_nth") <= copies))


def upsert(target: DataFrame, rows: DataFrame, on: list[str], update: Callable[[], Values] | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT ... ON CONFLICT (on) DO NOTHING, or DO UPDATE SET update() (aliases t: the row there, s: the one given).

    Keys with a null never conflict, so all such rows are inserted. Of several given rows of one key the
    first is inserted and the others do nothing; with an update that is an error."""
    insert_all = {c: F.col(f"s.{c}") for c in rows.columns}
    insert_row = When("not_matched", "insert", insert_all)
    if update:
        message = "ON CONFLICT DO UPDATE command cannot affect row a second time"
        return merge(target, rows, on, [When("matched", "update", update(), where), insert_row], insert_once=message)
    full = " AND ".join(f"`{k}` IS NOT NULL" for k in on)
    source = rows.where(full).dropDuplicates(on).unionByName(rows.where(f"NOT ({full})"))
    return merge(target, source, on, [When("matched", "nothing"), insert_row])


def update_from(target: DataFrame, source: DataFrame, on: list[str], set_: Values, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE target t SET ... FROM source s WHERE equal keys and where: of several source rows that qualify, any one acts."""
    return merge(target, source, on, [When("matched", "update", set_, where)], repeats="any")


def update(target: DataFrame, where: Column, set_: Values) -> tuple[DataFrame, DataFrame]:
    """UPDATE target SET ... WHERE: a projection; no shuffle."""
    hit = F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, set_[c].cast(target.schema[c].dataType)).otherwise(F.col(c)) if c in set_ else F.col(c) for c in target.columns}
    changed = target.where(where).select(F.lit("UPDATE").alias("action"), F.struct(*target.columns).alias("old"), F.struct(*[v.alias(c) for c, v in new.items()]).alias("new"))
    return target.select(*[v.alias(c) for c, v in new.items()]), changed


def delete_using(target: DataFrame, source: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """DELETE FROM target USING source: an anti join, and the semi join of what went."""
    keys = source.select(*on)
    return target.join(keys, on, "left_anti").select(*target.columns), target.join(keys, on, "left_semi").select(*target.columns)


def delete(target: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    return target.where(~F.coalesce(where, F.lit(False))), target.where(where)

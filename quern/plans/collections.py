"""Arrays, maps, ranges and vectors (blueprint 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays as a
from quern.functions import ranges as r
from quern.functions import vectors as v
from quern.plans.registry import Tables, portable, query

V = "(VALUES (1, [3, 1, NULL, 1]), (2, [5]), (3, []::INT[])) v(id, x)"


def _v(t: Tables):
    return t.spark.createDataFrame([(1, [3, 1, None, 1]), (2, [5]), (3, [])], "id int, x array<int>")


@query(f"SELECT id, unnest(x) AS e FROM {V}")
def arr_unnest(t: Tables):
    return _v(t).select("id", F.explode("x").alias("e"))


@query(f"SELECT id, CASE WHEN len(x) > 0 THEN CAST(len(x) AS INT) END AS n, CASE WHEN len(x) > 0 THEN '[1:' || len(x) || ']' END AS d FROM {V}")
def arr_length_dims(t: Tables):
    return _v(t).select("id", a.length(F.col("x")).alias("n"), a.dims(F.col("x")).alias("d"))


@query(f"SELECT id, list_append(x, 9) AS p, list_prepend(9, x) AS q, list_concat(x, [7, 8]) AS c, list_filter(x, lambda e: e IS NULL OR e <> 1) AS m FROM {V}")
def arr_append_prepend_cat_remove(t: Tables):
    x = F.col("x")
    return _v(t).select("id", F.array_append(x, F.lit(9)).alias("p"), F.array_prepend(x, F.lit(9)).alias("q"), F.concat(x, F.array(F.lit(7), F.lit(8))).alias("c"), F.array_remove(x, 1).alias("m"))


@query("SELECT id, CAST(p AS BIGINT) AS p, q FROM (VALUES (1, 2, [2, 4]), (2, NULL, []::INT[]), (3, NULL, []::INT[])) v(id, p, q)")
def arr_position(t: Tables):
    return _v(t).select("id", a.position(F.col("x"), F.lit(1)).alias("p"), a.positions(F.col("x"), F.lit(1)).alias("q"))


@query("SELECT id, c, o FROM (VALUES (1, true, true), (2, false, false), (3, false, false)) v(id, c, o)")
def arr_contains_overlap(t: Tables):
    return _v(t).select("id", a.contains(F.col("x"), F.array(F.lit(1), F.lit(3))).alias("c"), a.overlap(F.col("x"), F.array(F.lit(1), F.lit(4))).alias("o"))


@query("SELECT id, s, n FROM (VALUES (1, '3-1-1', '3-1-*-1'), (2, '5', '5'), (3, '', '')) v(id, s, n)")
def arr_to_string(t: Tables):
    return _v(t).select("id", a.to_string(F.col("x"), "-").alias("s"), a.to_string(F.col("x"), "-", "*").alias("n"))


@query("SELECT id, y, u FROM (VALUES (1, [3, 8, NULL, 1], [3, 1, NULL, 1]), (2, [5, 8], [5]), (3, [NULL, 8], []::INT[])) v(id, y, u)")
def arr_assign_uniq(t: Tables):
    return _v(t).select("id", a.assign(F.col("x"), 2, F.lit(8)).alias("y"), a.uniq(F.col("x")).alias("u"))


@query(f"SELECT id, list_sort(x) AS s FROM (SELECT id, list_filter(x, lambda e: e IS NOT NULL) AS x FROM {V})")
def arr_sort(t: Tables):
    return _v(t).select("id", F.array_sort(F.array_compact("x")).alias("s"))


portable("arr_comparison", "SELECT a < b AS lt FROM (SELECT array(1, 2) AS a, array(1, 3) AS b) q", "SELECT [1, 2] < [1, 3] AS lt")


@query("SELECT n, g, has_a, c, k FROM (VALUES (1, 'x', true, true, 3), (2, NULL, false, false, 2)) v(n, g, has_a, c, k)")
def map_hstore(t: Tables):
    rows = t.spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"b": None})], "n int, h map<string,string>")
    h, more = F.col("h"), F.create_map(F.lit("b"), F.lit("y"))
    return rows.select("n", a.hstore_get(h, F.lit("a")).alias("g"), a.hstore_has(h, "a").alias("has_a"), a.hstore_contains(h, more).alias("c"), F.size(a.hstore_concat(h, F.create_map(F.lit("z"), F.lit("q"), F.lit("b"), F.lit("w")))).alias("k"))


@query("SELECT p, d, l FROM (VALUES ('a.b.c', true, 3), ('a', false, 1), ('a.bc', false, 2)) v(p, d, l)")
def map_ltree(t: Tables):
    rows = t.spark.createDataFrame([("a.b.c",), ("a",), ("a.bc",)], "p string")
    return rows.select("p", a.ltree_is_descendant(F.col("p"), F.lit("a.b")).alias("d"), a.ltree_level(F.col("p")).alias("l"))


@query("SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O FROM orders GROUP BY 1")
def map_crosstab(t: Tables):
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))


@query("SELECT a, b, c, o, d, x FROM (VALUES ('[1,5)', '[3,8)', false, true, false, '[3,5)'), ('[1,5)', '[5,8)', false, false, true, 'empty'), ('[1,9)', '[3,8)', true, true, false, '[3,8)'), ('(,5)', '[3,4)', true, true, false, '[3,4)')) v(a, b, c, o, d, x)")
def rng_operators(t: Tables):
    rows = t.spark.createDataFrame([(1, 4, 3, 7), (1, 4, 5, 7), (1, 8, 3, 7), (None, 4, 3, 3)], "a int, b int, c int, d int")
    x, y = r.make(F.col("a"), F.col("b"), "[]", True), r.make(F.col("c"), F.col("d"), "[]", True)
    rows = rows.select(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select(r.to_text(x).alias("a"), r.to_text(y).alias("b"), r.contains(x, y).alias("c"), r.overlaps(x, y).alias("o"), r.adjacent(x, y).alias("d"), r.to_text(r.intersect(x, y)).alias("x"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def rng_contains_elem(t: Tables):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.orders.where(r.contains_elem(r.make(at("1996-01-01"), at("1996-07-01")), F.col("o_orderdate"))).agg(F.count("*").alias("n"))


@query("SELECT e, m, u FROM (VALUES (true, '[1,9]', '[1,9]')) v(e, m, u)")
def rng_empty_merge_union(t: Tables):
    one = lambda x, y, b: r.make(F.lit(x), F.lit(y), b)
    return t.spark.range(1).select(r.is_empty(one(3, 3, "[)")).alias("e"), r.to_text(r.merge(one(1, 2, "[]"), one(5, 9, "[]"))).alias("m"), r.to_text(r.union(one(1, 5, "[]"), one(5, 9, "[]"))).alias("u"))


_D = "CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])"


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance({_D}), 6) AS l2, round(list_dot_product({_D}), 6) AS ip, round(list_cosine_distance({_D}), 6) AS cd,
round(list_sum(list_transform(list_zip({_D}), lambda z: abs(z[1] - z[2]))), 6) AS l1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_distances(t: Tables):
    a_ = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b_ = t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a_.join(b_, "a").select("a", "b", F.round(v.l2_distance(x, y), 6).alias("l2"), F.round(v.inner_product(x, y), 6).alias("ip"), F.round(v.cosine_distance(x, y), 6).alias("cd"), F.round(v.l1_distance(x, y), 6).alias("l1"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 3)), 5) AS s FROM embeddings")
def vec_arithmetic(t: Tables):
    x = F.col("embedding").cast("array<double>")
    total = v.add(v.add(x, x), x)
    return t.embeddings.select("vec_id", F.round(F.aggregate(total, F.lit(0.0), lambda s, e: s + e), 5).alias("s"))


@query("SELECT s, q, CAST(h AS INT) AS h FROM (VALUES ('{1:1.5,3:2.0}/4', '1010', 1)) v(s, q, h)")
def vec_sparse_bits(t: Tables):
    x = F.array(*[F.lit(e) for e in (1.5, 0.0, 2.0, 0.0)])
    return t.spark.range(1).select(v.to_sparse(x).alias("s"), v.binary_quantize(x).alias("q"), v.hamming_distance(v.binary_quantize(x), F.lit("1110")).alias("h"))


@query()
def vec_inverted_lists(t: Tables):
    """The 10 nearest rows of each row whose id is divisible by 100, from the 12 of 16 lists around it; every row is in a list."""
    from quern.operators import vectors

    rows = t.embeddings.select("vec_id", "embedding")
    c = vectors.centres(rows, "embedding", 16)
    return vectors.search_many(vectors.assign(rows, "embedding", c), rows.where("vec_id % 100 = 0"), "embedding", c, 10, 12, "vec_id")


@query("SELECT o_custkey, x[2:3] AS s, CAST(coalesce(list_position(x, 3), 0) AS INT) AS p, list_sort(list_distinct(list_filter(x, lambda e: e NOT IN (1, 3)))) AS m FROM (SELECT o_custkey, list(CAST(o_orderkey % 7 AS INT) ORDER BY o_orderkey) AS x FROM orders GROUP BY 1)")
def arr_int_functions(t: Tables):
    """int_array_aggregate by order, subarray, idx and - of intarray."""
    lists = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("e")))), lambda r: r["e"]).alias("x"))
    x = F.col("x")
    return lists.select("o_custkey", a.subarray(x, 2, 2).alias("s"), a.idx(x, F.lit(3)).alias("p"), a.minus(x, F.array(F.lit(1), F.lit(3))).alias("m"))

"""Operators on small tables with nulls, ties, repeats and nothing at all."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import datetimes, numbers, predicates, ranges, strings
from quern.operators import aggregates, checks, dml, joins, recursive, scans, sorting, windows
from quern.plans import catalog
from quern.session import table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_range_joins_match_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-50, 50)) for i in range(60)]
    rgs = [(i, a := rng.uniform(-50, 50), a + rng.uniform(-1, 30)) for i in range(40)]
    p, r = spark.createDataFrame(pts, "p int, x double"), spark.createDataFrame(rgs, "r int, lo double, hi double")
    want = sorted((i, j) for i, x in pts for j, lo, hi in rgs if lo <= x <= hi)
    for width in (0.7, 10.0, 500.0):
        assert rows(joins.point_in_range(p, r, "x", "lo", "hi", width).select("p", "r")) == sorted(want, key=repr)
    fine = [t for t in rgs if t[1] <= t[2]]
    a = spark.createDataFrame(fine, "a int, lo double, hi double")
    b = spark.createDataFrame(fine, "b int, lo2 double, hi2 double")
    both = sorted(((i, j) for i, l1, h1 in fine for j, l2, h2 in fine if l1 <= h2 and l2 <= h1), key=repr)
    for width in (3.0, 100.0):
        assert rows(joins.overlapping(a, b, ("lo", "lo2"), ("hi", "hi2"), width).select("a", "b")) == both


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (3, 1, "c")], "k int, s int, v string")
    assert rows(joins.asof(left, right, ["k"], "t", "s", ["v"])) == sorted([(1, 5, "b"), (1, 1, None), (2, 9, None), (None, 3, None)], key=repr)
    assert ("b" not in [r[2] for r in rows(joins.asof(left, right, ["k"], "t", "s", ["v"], strict=True))]) and joins.asof(left.limit(0), right, ["k"], "t", "s", ["v"]).count() == 0


def test_salted_join_keeps_every_pair(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (950, "c"), (5, "d")], "k bigint, v string")
    assert rows(joins.salted(left, right, ["k"]).select("id", "v")) == rows(left.join(right, "k").select("id", "v"))


def test_merge_and_its_errors(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(2, "x"), (4, "y")], "k int, v string")
    after, changed = dml.merge(t, s, ["k"], [dml.When("matched", "update", {"v": F.col("s.v")}), dml.When("not_matched", "insert", {"k": F.col("s.k"), "v": F.col("s.v")}), dml.When("not_matched_by_source", "delete", condition=F.col("t.v").isNull())])
    assert rows(after) == sorted([(1, "a"), (2, "x"), (4, "y")], key=repr)
    assert sorted(r.action for r in changed.collect()) == ["DELETE", "INSERT", "UPDATE"]
    twice = s.unionAll(spark.createDataFrame([(2, "z")], "k int, v string"))
    with pytest.raises(Exception, match="second time"):
        dml.merge(t, twice, ["k"], [dml.When("matched", "update", {"v": F.col("s.v")})])[0].collect()
    assert rows(dml.upsert(t, twice, ["k"])[0]) == sorted([(1, "a"), (2, "b"), (3, None), (4, "y")], key=repr)
    assert dml.update(t, F.col("v") == "a", {"v": F.lit("q")})[1].count() == 1 and dml.delete(t, F.col("v") == "a")[0].count() == 2


def test_checks(spark):
    t = spark.createDataFrame([(1, 2), (1, None), (None, None)], "a int, b int")
    assert checks.duplicates(t, ["a"]).count() == 1 and checks.orphans(t, t.where("a IS NOT NULL"), [("b", "a")]).count() == 1
    assert checks.ensure(t, F.col("b") > 0, "b").count() == 3
    with pytest.raises(Exception, match="broken"):
        checks.ensure(t, F.col("b") > 5, "broken").collect()
    ids = checks.number_rows(spark.range(1000).select(F.col("id").alias("x")), "n", ["x"]).collect()
    assert all(r.n == r.x + 1 for r in ids)


def test_recursion_ends_and_reports(spark):
    one = spark.range(1, 2).select(F.col("id").alias("n"))
    assert recursive.union_distinct(one, lambda d: d.select((F.col("n") * 2 % 9).alias("n"))).count() == 6
    assert recursive.union_distinct(one.limit(0), lambda d: d).count() == 0
    with pytest.raises(RuntimeError):
        recursive.union_all(one, lambda d: d, max_rounds=3)


def test_sorting(spark):
    t = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "x int")
    assert sorting.fetch_with_ties(t, 2, F.col("x")).count() == 4 and sorting.fetch_with_ties(t, 0, F.col("x")).count() == 0
    assert sorting.fetch_with_ties(t, 99, F.col("x")).count() == 5 and sorting.limit(t, None).count() == 5
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError, match="2201"):
            sorting.limit(t, *bad)


def test_windows_on_nothing(spark):
    t = spark.createDataFrame([], "k int, x double")
    assert windows.groups_frame(t, ["k"], [F.col("x")], -1, 1, n=F.count("*")).count() == 0
    assert windows.exclude(t, ["k"], [F.col("x")], "x", "ties", -1, 1, {"s": "sum"}).count() == 0
    assert windows.shift(t, ["k"], [F.col("x")], "x", F.lit(1), "p").count() == 0


def test_aggregate_rules(spark):
    t = spark.createDataFrame([(1, None), (1, 3), (1, 3), (2, None)], "k int, x int")
    got = {r.k: r for r in t.groupBy("k").agg(aggregates.array_agg(F.col("x"), F.col("x")).alias("a"), aggregates.string_agg(F.col("x").cast("string"), "-").alias("s"), aggregates.mode(F.col("x")).alias("m"), aggregates.hypothetical("rank", F.col("x"), F.lit(3)).alias("r"), aggregates.hypothetical("cume_dist", F.col("x"), F.lit(3)).alias("c")).collect()}
    assert sorted(map(str, got[1].a)) == ["3", "3", "None"] and got[2].a == [None] and got[1].s == "3-3" and got[2].s is None and got[1].m == 3
    assert got[1].r == 1 and got[1].c == 0.75
    islands = aggregates.range_agg(spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 5, 6), (1, 8, 9), (1, 4, 4)], "k int, lo int, hi int"), ["k"], "lo", "hi")
    assert rows(islands.select("lo", "hi")) == [(1, 6), (8, 9)]


def test_scalar_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    s = F.lit("héllo")
    assert value(strings.substr(s, 0, 3)) == "hé" and value(strings.left(s, -9)) == "" and value(strings.right(s, -1)) == "éllo" and value(strings.right(s, 0)) == ""
    assert value(strings.regexp_replace(F.lit("a.b.c"), r"\.", "-")) == "a-b.c" and value(strings.regexp_replace(F.lit("x"), "y", "z")) == "x"
    assert value(strings.quote_literal(F.lit("a'b\\"))) == "E'a''b\\\\'" and value(strings.quote_ident(F.lit("A b"))) == '"A b"'
    assert value(predicates.between_symmetric(F.lit(5), F.lit(9), F.lit(1))) is True and value(predicates.eq_any(F.lit(None).cast("int"), F.array().cast("array<int>"))) is False
    assert value(predicates.similar_to(F.lit("a.c"), "a.c")) is True and value(predicates.similar_to(F.lit("abc"), "a.c")) is False
    assert value(numbers.gcd(F.lit(0), F.lit(0))) == 0 and value(numbers.gcd(F.lit(-12), F.lit(18))) == 6 and value(numbers.lcm(F.lit(4), F.lit(6))) == 12
    r = lambda a, b, k="[)": ranges.make(F.lit(a).cast("int"), F.lit(b).cast("int"), k)
    assert value(ranges.overlaps(r(1, 3), r(3, 5))) is False and value(ranges.adjacent(r(1, 3), r(3, 5))) is True and value(ranges.contains(r(None, None), r(1, 2))) is True
    assert value(ranges.to_text(ranges.intersect(r(1, 5, "[]"), r(5, 9)))) == "[5,5]" and value(ranges.union(r(1, 2), r(5, 6))) is None
    born = F.lit("2000-02-29").cast("timestamp_ntz")
    got = value(datetimes.age(F.lit("2001-02-28 12:00:00").cast("timestamp_ntz"), born))
    assert (got.months, got.days, got.micros) == (11, 28, 43_200_000_000)


def test_scans(spark):
    t = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, a array<int>")
    assert rows(scans.with_ordinality(t, F.col("a"), "x").select("id", "x", "ordinality")) == [(1, 1, 1), (1, 2, 2)]
    assert scans.with_ordinality(t, F.col("a"), "x", outer=True).count() == 4
    n = scans.sample_bernoulli(spark.range(10_000), 10, 1, "id").count()
    assert 800 < n < 1200 and scans.sample_rows(spark.range(50), 99, 1, "id").count() == 50
    assert [r.i for r in scans.generate_series(spark, 5, 1, -2).orderBy("i").collect()] == [1, 3, 5] and scans.generate_series(spark, 1, 0).count() == 0


def test_ivf_recall_and_documents(spark):
    from quern.functions.documents import jsonb_pretty, path_query
    from quern.operators import vectors

    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    c = vectors.centres(df, "embedding", 12)
    index = vectors.assign(df, "embedding", c).cache()
    hits = 0
    rows_ = df.where("vec_id < 10").collect()
    for r in rows_:
        exact = {x.vec_id for x in vectors.search(index, "embedding", c, r.embedding, 10, 12).collect()}
        hits += len(exact & {x.vec_id for x in vectors.search(index, "embedding", c, r.embedding, 10, 8).collect()})
    assert hits >= 0.8 * 10 * len(rows_)
    assert path_query({"a": [{"k": 1}, {"k": 7}, {"k": "x"}]}, "$.a[*] ? (@.k >= 2).k") == [7] and path_query([1, 2], "$[-1]") == [2]
    with pytest.raises(ValueError):
        path_query({}, "a.b")
    got = spark.createDataFrame([('{"bb":1,"a":[]}',), ("no",), (None,)], "d string").select(jsonb_pretty("d").alias("x")).collect()
    assert [r.x for r in got] == ['{\n    "a": [],\n    "bb": 1\n}', None, None]


def test_cursor_explain_and_buckets(spark):
    from quern.operators import session

    cursor = session.Cursor(spark.range(10).orderBy("id"))
    assert [r.id for r in cursor.fetch(3)] == [0, 1, 2] and cursor.move(4) == 4 and [r.id for r in cursor.fetch(9)] == [7, 8, 9] and cursor.fetch() == []
    plan = session.explain(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey > 5").select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan and "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_jdbc_source_pushes_down(spark, tmp_path):
    from quern.sources import files

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id AS k", "id % 3 AS g").write.format("jdbc").option("url", url).option("dbtable", "T").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = files.remote_query(spark, url, 'SELECT "g", count(*) AS "n" FROM T GROUP BY "g"', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 34), (1, 33), (2, 33)]


def test_metaphone_covers_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    names = {r.p_partkey: r.p_name for r in table(spark, sf, "part").collect()}
    got = {r.p_partkey: r.m for r in catalog.queries()["str_metaphone"](spark, sf).collect()}
    keys = strings.metaphone_key.func(pd.Series(names))
    assert len(names) > 50 and got == keys.to_dict()


def test_numbers_are_gapless_on_many_rows(spark):
    many = spark.range(0, 2_000_000, 1, 16).select((F.col("id") * 7919 % 2_000_003).alias("x"), F.md5(F.col("id").cast("string")).alias("extra"), F.lit(1).alias("_part"))
    got = checks.number_rows(many.repartition(16), "n", ["x"], chunk=150_000)
    r = got.agg(F.count("*").alias("rows"), F.count_distinct("n").alias("distinct"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    assert tuple(r) == (2_000_000, 2_000_000, 1, 2_000_000) and got.columns == ["x", "extra", "_part", "n"]
    assert got.select("n").join(many.select("x"), F.col("n") == F.col("x") + 1).count() > 0
    assert checks.number_rows(many.limit(0), "n", ["x"]).count() == 0


def test_merge_of_several_source_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(2, "x"), (2, "y"), (2, "y"), (None, "n"), (None, "n"), (9, "z"), (9, "z")], "k int, v string")
    put = dml.When("not_matched", "insert", {"k": F.col("s.k"), "v": F.col("s.v")})
    table, changed = dml.merge(t, s, ["k"], [dml.When("matched", "nothing")])
    assert rows(table) == rows(t) and changed.count() == 0
    table, changed = dml.merge(t, s, ["k"], [dml.When("matched", "update", {"v": F.col("s.v")}, F.col("s.v") == "x"), put])
    assert rows(table) == sorted([(1, "a"), (2, "x"), (2, "x"), (3, None), (None, "n"), (None, "n"), (9, "z"), (9, "z")], key=repr)
    assert sorted(r.action for r in changed.collect()) == ["INSERT"] * 4 + ["UPDATE"] * 2
    assert rows(dml.merge(t, s, ["k"], [dml.When("matched", "delete", condition=F.col("s.v") == "x")])[0]) == sorted([(1, "a"), (3, None)], key=repr)
    with pytest.raises(Exception, match="second time"):
        dml.merge(t, s, ["k"], [dml.When("matched", "update", {"v": F.col("s.v")}, F.col("s.v") == "y")])[0].collect()


def test_upsert_and_update_from_rules(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    given = spark.createDataFrame([(None, "p"), (None, "p"), (2, "q"), (5, "r"), (5, "s")], "k int, v string")
    table = rows(dml.upsert(t, given, ["k"])[0])
    assert [r[1] for r in table if r[0] is None] == ["c", "p", "p"] and len(table) == 6 and (2, "b") in table
    with pytest.raises(Exception, match="second time"):
        dml.upsert(t, given, ["k"], lambda: {"v": F.col("s.v")})[0].collect()
    once = given.where("v <> 's'")
    assert (2, "q") in rows(dml.upsert(t, once, ["k"], lambda: {"v": F.col("s.v")})[0])
    source = spark.createDataFrame([(2, "x"), (2, "y"), (1, "y")], "k int, v string")
    for which, want in (("x", [(1, "a"), (2, "x"), (None, "c")]), ("y", [(1, "y"), (2, "y"), (None, "c")]), ("z", rows(t))):
        assert rows(dml.update_from(t, source, ["k"], {"v": F.col("s.v")}, F.col("s.v") == which)[0]) == sorted(want, key=repr)
    assert {r[1] for r in rows(dml.update_from(t, source, ["k"], {"v": F.col("s.v")})[0]) if r[0] == 2} <= {"x", "y"}


def test_salted_joins_of_every_kind(spark):
    left = spark.range(600).select(F.when(F.col("id") < 300, 1).when(F.col("id") < 400, None).otherwise(F.col("id")).alias("k"), "id").repartition(5)
    right = spark.createDataFrame([(1, "a"), (1, "b"), (450, "c"), (5, "d"), (None, "e")], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(joins.salted(left, right, ["k"], most_keys=100, how=how)) == rows(left.join(right, "k", how))
    for how in ("full", "right"):
        with pytest.raises(ValueError):
            joins.salted(left, right, ["k"], how=how)


def test_long_and_endless_ranges_have_few_bins(spark):
    p = spark.createDataFrame([(i, float(i)) for i in range(-20, 20)], "p int, x double")
    ranges_ = [(0, -1e15, 1e15), (1, 0.0, float("inf")), (2, float("-inf"), -5.0), (3, 2.0, 2.0), (4, 1.5, 9.25), (5, 7.0, 3.0)]
    r = spark.createDataFrame(ranges_, "r int, lo double, hi double")
    want = sorted(((i, j) for i in range(-20, 20) for j, lo, hi in ranges_ if lo <= i <= hi), key=repr)
    assert rows(joins.point_in_range(p, r, "x", "lo", "hi", 0.5).select("p", "r")) == want
    other = r.select(F.col("r").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = sorted(((a, b) for a, l1, h1 in ranges_ for b, l2, h2 in ranges_ if l1 <= h1 and l2 <= h2 and l1 <= h2 and l2 <= h1), key=repr)
    assert rows(joins.overlapping(r, other, ("lo", "lo2"), ("hi", "hi2"), 0.5).select("r", "q")) == both


def test_inverted_lists_reach_the_true_neighbours(spark):
    """Recall of the registered query's lists against all pairs, its queries against all rows."""
    from quern.operators import vectors
    from quern.plans import catalog

    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    one = vectors.centres(df, "embedding", 1)
    exact = vectors.search_many(vectors.assign(df, "embedding", one), df.where("vec_id % 100 = 0"), "embedding", one, 10, 1, "vec_id")
    got = catalog.queries()["vec_inverted_lists"](spark, sf)
    want = {(r.query_id, r.vec_id) for r in exact.collect()}
    assert want and len(want & {(r.query_id, r.vec_id) for r in got.collect()}) >= 0.9 * len(want)
    brute = {r.vec_id for r in df.crossJoin(df.where("vec_id = 100").select(F.col("embedding").alias("q"))).orderBy(F.expr("aggregate(zip_with(embedding, q, (a, b) -> (double(a) - b) * (double(a) - b)), 0d, (s, x) -> s + x)"), "vec_id").limit(10).collect()}
    assert brute == {v for q, v in want if q == 100}


def test_numbers_and_dates_by_template(spark):
    from quern.functions import templates

    def shown(x, template):
        return spark.createDataFrame([(x,)], "x double").select(templates.number_to_char(F.col("x"), template)).first()[0]

    assert [shown(x, "999,999.99") for x in (12454.8, -485.0, 0.1, 1234567.0, None)] == ["  12,454.80", "    -485.00", "        .10", " ###,###.##", None]
    assert [shown(x, "FM999.99") for x in (148.5, -485.0, 0.0, -0.1)] == ["148.5", "-485.", "0.", "-.1"]
    assert [shown(-12.0, f) for f in ("999MI", "999PR", "0009", "9")] == [" 12-", " <12>", "-0012", "-#"]
    with pytest.raises(ValueError):
        templates.number_to_char(F.lit(1), "9V9")
    bad = spark.range(1).select(templates.to_date(F.lit("2024-13-01"), "YYYY-MM-DD").alias("d"), templates.to_timestamp(F.lit(None).cast("string"), "YYYY").alias("t"))
    assert tuple(bad.first()) == (None, None)


def test_json_edits_by_path(spark):
    from quern.functions import jsons as j

    def done(edit, doc='{"a":1,"b":{"c":[10,20,"x"]}}'):
        return spark.createDataFrame([(doc,)], "d string").select(edit(F.col("d"))).first()[0]

    assert done(lambda d: j.set_path(d, ["b", "c", 1], F.lit('{"z":null}'))) == '{"a":1,"b":{"c":[10,{"z":null},"x"]}}'
    assert done(lambda d: j.set_path(d, ["b", "c", 9], F.lit("5"))) == '{"a":1,"b":{"c":[10,20,"x",5]}}'
    assert done(lambda d: j.set_path(d, ["b", "c", -9], F.lit("5"))) == '{"a":1,"b":{"c":[5,10,20,"x"]}}'
    assert done(lambda d: j.set_path(d, ["q", "c"], F.lit("5"))) == done(lambda d: j.set_path(d, ["q"], F.lit("5"), create=False)) == '{"a":1,"b":{"c":[10,20,"x"]}}'
    assert done(lambda d: j.insert_path(d, ["b", "c", -1], F.lit("7"), after=True)) == '{"a":1,"b":{"c":[10,20,"x",7]}}'
    assert done(lambda d: j.delete_path(d, ["b", "c", -1])) == '{"a":1,"b":{"c":[10,20]}}'
    assert done(lambda d: j.concat_docs(d, F.lit('{"b":2}')), "[1]") == '[1,{"b":2}]'
    assert done(lambda d: j.set_path(d, ["a"], F.lit("1")), None) is None
    with pytest.raises(Exception, match="cannot replace existing key"):
        done(lambda d: j.insert_path(d, ["a"], F.lit("1")))


def test_asof_by_spans_of_time(spark):
    """A hot key in spans, null keys and times, against a plain loop."""
    import random

    deal = random.Random(5)
    given = [(deal.choice([1, 1, 1, 2, None]), deal.choice([None, *range(-50, 150)]), i) for i in range(300)]
    held = [(deal.choice([1, 1, 2, 3, None]), t, t and t * 10) for t in [None, *range(-60, 140, 7)]]
    left, right = spark.createDataFrame(given, "k int, t int, i int"), spark.createDataFrame(held, "k int, s int, v int")
    for strict in (False, True):
        def last(k, t):
            fits = [s for q, s, _ in held if q is not None and q == k and s is not None and t is not None and (s < t or (s == t and not strict))]
            return max(fits) * 10 if fits else None

        want = sorted(((k, t, i, last(k, t)) for k, t, i in given), key=repr)
        for width in (None, 10, 1000, 1):
            assert rows(joins.asof(left, right, ["k"], "t", "s", ["v"], strict, width)) == want
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(c).cast("timestamp_ntz"))
    assert rows(joins.asof(at(left, "t"), at(right, "s"), ["k"], "t", "s", ["v"], width=20.0).select("i", "v")) == rows(joins.asof(left, right, ["k"], "t", "s", ["v"]).select("i", "v"))


def test_word_similarities_of_known_pairs(spark):
    from quern.functions import strings as s

    pairs = spark.createDataFrame([("word", "two words"), ("word", None), ("", "x")], "a string, b string")
    got = pairs.select(F.round(s.word_similarity(F.col("a"), F.col("b")), 6), F.round(s.strict_word_similarity(F.col("a"), F.col("b")), 6)).collect()
    assert [tuple(r) for r in got] == [(0.8, 0.571429), (None, None), (0.0, 0.0)]


def test_exclude_in_open_frames_against_a_loop(spark):
    import random

    deal = random.Random(9)
    given = [(deal.choice(["a", "b"]), deal.randrange(6), i, deal.choice([None, 1.0, 2.5, 4.0])) for i in range(60)]
    t = spark.createDataFrame(given, "k string, o int, i int, x double")
    for kind, start, end in (("group", None, 0), ("ties", None, None), ("group", 0, None), ("current_row", None, 2), ("current_row", -3, None)):
        order = ["i"] if kind == "current_row" else ["o"]
        got = {r.i: (r.s, r.n, r.m, r.g) for r in windows.exclude(t, ["k"], [F.col(c) for c in order], "x", kind, start, end, {"s": "sum", "n": "count", "m": "min", "g": "max"}).collect()}
        for k, o, i, x in given:
            rows_ = sorted((r for r in given if r[0] == k), key=lambda r: r[2] if kind == "current_row" else r[1])
            mine = rows_.index((k, o, i, x))
            held = [r for j, r in enumerate(rows_) if (start is None or j >= mine + start or r[1] == o) and (end is None or j <= mine + end or r[1] == o)] if kind != "current_row" else [r for j, r in enumerate(rows_) if (start is None or j >= mine + start) and (end is None or j <= mine + end)]
            gone = {"group": lambda r: r[1] == o, "ties": lambda r: r[1] == o and r[2] != i, "current_row": lambda r: r[2] == i}[kind]
            values = [r[3] for r in held if not gone(r) and r[3] is not None]
            assert got[i] == ((sum(values), len(values), min(values), max(values)) if values else (None, 0, None, None)), (kind, start, end, i)
    with pytest.raises(ValueError):
        windows.exclude(t, ["k"], [F.col("o")], "x", "group", None, -1, {"s": "sum"})


def test_whole_results_of_streams_stay_in_shared_files(spark, tmp_path):
    """A result that is read from files was not gathered on the driver; a stream of no files has no rows."""
    from quern.streaming import events

    assert catalog.queries()["stream_session_stateful"](spark, "/root/testdata/sf0.001").inputFiles()
    given = [(k, 3600 * h) for k in (1, 2) for h in (0, 1, 2, 9, 10, 30)] + [(None, 5)]
    whole = spark.createDataFrame(given, "k int, s int").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"))
    for name, df in (("some", whole.repartition(5)), ("none", None)):
        path = tmp_path / name
        df.write.parquet(str(path)) if df is not None else path.mkdir()
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        make = lambda x: events.session(x, "t", "3 hours", ["k"], delay="30 days", n=F.count("*"))
        got = events.run_to_files(make(stream), str(tmp_path / f"{name}-out"))
        assert rows(got) == (rows(make(df)) if df is not None else []) and got.columns == ["start", "end", "k", "n"]


def test_epochs_far_from_1970_keep_their_microseconds(spark):
    from quern.functions import templates

    given = [3335981 * 86400.5, -3335981 * 86400.5, 5999999 * 86400.5, 86400.5, -0.25, -0.0, 1.000001, -1.9999996, None]
    want = [3335981 * 86_400_500_000, -3335981 * 86_400_500_000, 5999999 * 86_400_500_000, 86400500000, -250000, 0, 1000001, -2000000, None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x double").select("i", F.unix_micros(templates.from_epoch(F.col("x")).cast("timestamp")).alias("u"))
    assert [r.u for r in df.orderBy("i").collect()] == want
    for odd in ("nan", "inf", "-inf", "1e15"):
        with pytest.raises(Exception, match="OVERFLOW"):
            spark.createDataFrame([(float(odd),)], "x double").select(templates.from_epoch(F.col("x"))).collect()


def test_numbers_by_template_that_round_to_zero(spark, tmp_path):
    """The query against its SQL over numbers around zero, and the sign by type."""
    import duckdb

    from quern.functions import templates

    odd = [-0.29, -0.5, -0.49, -0.01, -0.0, 0.0, 0.01, 0.49, 0.5, -1.5, 2.5, -0.99, -0.004, -999.99, 9999.99, None]
    spark.createDataFrame(list(enumerate(odd)), "c_custkey bigint, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = rows(catalog.queries()["str_to_char_numbers"](spark, str(tmp_path)))
    sql = catalog.oracle_sql()["str_to_char_numbers"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(sql).fetchall(), key=repr)
    small = spark.createDataFrame([(-0.3,)], "x double").select(*[templates.number_to_char(F.col("x").cast(kind), "9MI") for kind in ("double", "float", "decimal(5,2)")])
    assert tuple(small.first()) == ("0-", "0-", "0 ")


def test_exclude_current_row_with_equal_order_keys(spark, tmp_path):
    """From part key 100,000 on the SQL's order repeats: one result however the rows come, that of part keys in order."""
    import duckdb

    parts = [(key + 100_000 * far, "b", 20 - far, float(2**far * (key + 1))) for key in range(8) for far in range(12)]
    sql = catalog.oracle_sql()["win_exclude_current_row"]
    total = sql.replace("p_size * 100000 + p_partkey ROWS", "p_size * 100000 + p_partkey, p_partkey ROWS")
    assert total != sql
    for name, given in (("up", parts), ("down", parts[::-1])):
        spark.createDataFrame(given, "p_partkey bigint, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / name / "part.parquet"))
        got = rows(catalog.queries()["win_exclude_current_row"](spark, str(tmp_path / name)))
        assert got == sorted(duckdb.sql(total.replace("FROM part", f"FROM '{tmp_path}/{name}/part.parquet/*.parquet'")).fetchall(), key=repr)

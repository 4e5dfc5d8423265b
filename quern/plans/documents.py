"""JSON and XML (blueprint 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import jsons as j
from quern.functions import xmls as x
from quern.plans.registry import Tables, query


def _docs(t: Tables):
    return t.spark.createDataFrame([(1, '{"a": 1, "b": {"c": [10, 20]}, "s": "x"}'), (2, '{"s": null}'), (3, "[1, 2, 3]"), (4, "not json")], "id int, d string")


@query("SELECT event_id, json_extract_string(props, '$.page') AS p, CAST(json_extract_string(props, '$.page') AS VARCHAR) || '!' AS q FROM events")
def json_get(t: Tables):
    page = j.get(F.col("props"), "page")
    return t.events.select("event_id", page.alias("p"), F.concat(page, F.lit("!")).alias("q"))


@query("SELECT id, c, k FROM (VALUES (1, '20', true), (2, NULL, false)) v(id, c, k)")
def json_path_keys(t: Tables):
    return _docs(t).where("id < 3").select("id", j.get(F.col("d"), "b", "c", 1).alias("c"), j.has_key(F.col("d"), "a").alias("k"))


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_each(t: Tables):
    return j.each(t.events.select("event_id", "props"), "props").drop("props")


@query("SELECT value, CAST(o AS BIGINT) AS ordinality FROM (VALUES ('1', 1), ('2', 2), ('3', 3)) v(value, o)")
def json_array_elements(t: Tables):
    return j.elements(_docs(t).where("id = 3"), "d", ordinal="ordinality").select("value", "ordinality")


@query("SELECT id, v, o, a FROM (VALUES (1, true, true, false), (2, true, true, false), (3, true, false, true), (4, false, false, false)) v(id, v, o, a)")
def json_is_json(t: Tables):
    d = F.col("d")
    return _docs(t).select("id", j.is_json(d).alias("v"), j.is_json(d, "object").alias("o"), j.is_json(d, "array").alias("a"))


@query("SELECT id, t FROM (VALUES (1, 'object'), (2, 'object'), (3, 'array')) v(id, t)")
def json_typeof(t: Tables):
    return _docs(t).where("id < 4").select("id", j.typeof(F.col("d")).alias("t"))


@query("SELECT id, v, e FROM (VALUES (1, 1, true), (2, -1, false)) v(id, v, e)")
def json_value_exists(t: Tables):
    return _docs(t).where("id < 3").select("id", j.json_value(F.col("d"), "$.a", "int", -1).alias("v"), j.json_exists(F.col("d"), "$.b.c").alias("e"))


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS j FROM nation")
def json_build_object(t: Tables):
    return t.nation.select("n_nationkey", j.build_object(name=F.col("n_name"), region=F.col("n_regionkey")).alias("j"))


@query("SELECT a FROM (VALUES (true)) v(a)")
def json_canonical_equality(t: Tables):
    return t.spark.range(1).select((j.canonical(F.lit('{"b":1, "a": [1,2]}')) == j.canonical(F.lit('{ "a":[1, 2],"b":1}'))).alias("a"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_populate_record(t: Tables):
    return t.events.select("event_id", F.from_json("props", "page string").alias("r")).select("event_id", "r.page")


@query("SELECT n_nationkey, '<nation key=\"' || n_nationkey || '\"><name>' || n_name || '</name></nation>' AS x FROM nation")
def xml_element_attributes(t: Tables):
    return t.nation.select("n_nationkey", x.element("nation", x.forest(name=F.col("n_name")), key=F.col("n_nationkey")).alias("x"))


@query("SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1")
def xml_agg(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(x.agg(x.element("n", F.col("n_name")), F.col("n_nationkey")).alias("x"))


@query("SELECT n_nationkey, [n_name, 'k'] AS v, true AS e FROM nation")
def xml_xpath(t: Tables):
    doc = x.element("r", x.element("a", F.col("n_name")), x.element("a", F.lit("k")))
    rows = t.nation.select("n_nationkey", doc.alias("d"))
    return rows.select("n_nationkey", F.xpath("d", F.lit("/r/a/text()")).alias("v"), x.exists(F.col("d"), "/r/a[2]").alias("e"))


@query("SELECT id, c FROM (VALUES (1, true), (2, false), (3, false)) v(id, c)")
def json_contains(t: Tables):
    from quern.functions.documents import jsonb_contains

    return _docs(t).where("id < 4").select("id", jsonb_contains("d", F.lit('{"b": {"c": [20]}}')).alias("c"))


@query("SELECT id, v FROM (VALUES (1, ['20']), (2, []::VARCHAR[]), (3, []::VARCHAR[])) v(id, v)")
def json_path_query_filter(t: Tables):
    from quern.functions.documents import jsonb_path_query_array

    return _docs(t).where("id < 4").select("id", jsonb_path_query_array("$.b.c[*] ? (@ > 15)")("d").alias("v"))


@query("SELECT n, p FROM (VALUES ('Sch.\"My Tab\".col', ['sch', 'My Tab', 'col']), ('1bad', NULL)) v(n, p)")
def str_parse_ident(t: Tables):
    from quern.functions.documents import parse_ident

    return t.spark.createDataFrame([('Sch."My Tab".col',), ("1bad",)], "n string").select("n", parse_ident("n").alias("p"))


@query("SELECT event_id, json_merge_patch(props, '{\"k\":\"v\"}') AS a, json_merge_patch(props, '{\"z\":[1,2]}') AS b, json_merge_patch(props, '{\"k\":null}') AS c, json_merge_patch(props, '{\"k\":{\"q\":1},\"y\":2}') AS d FROM events")
def json_edit(t: Tables):
    """jsonb_set of an old and a new key, #-, and ||."""
    doc = F.col("props")
    edits = {"a": j.set_path(doc, ["k"], F.lit('"v"')), "b": j.set_path(doc, ["z"], F.lit("[1,2]")), "c": j.delete_path(doc, ["k"]), "d": j.concat_docs(doc, F.lit('{"k":{"q":1},"y":2}'))}
    return t.events.select("event_id", *[e.alias(n) for n, e in edits.items()])


@query("SELECT n_nationkey, CAST(to_json([n_nationkey, 7, n_regionkey]) AS VARCHAR) AS a, CAST(to_json([n_nationkey, n_regionkey, 7]) AS VARCHAR) AS b, CAST(to_json([n_nationkey]) AS VARCHAR) AS c, CAST(to_json(n_name) AS VARCHAR) AS d FROM nation")
def json_insert_scalar(t: Tables):
    """jsonb_insert before and after a position, - position, JSON_SCALAR."""
    doc = F.to_json(F.array(F.col("n_nationkey"), F.col("n_regionkey")))
    edits = {"a": j.insert_path(doc, [1], F.lit("7")), "b": j.insert_path(doc, [1], F.lit("7"), after=True), "c": j.delete_path(doc, [-1]), "d": j.json_scalar(F.col("n_name"))}
    return t.nation.select("n_nationkey", *[e.alias(n) for n, e in edits.items()])


@query("SELECT n_nationkey, '<?xml version=\"1.0\" standalone=\"yes\"?><n>' || n_name || '</n>' AS r, '<?sort ' || n_name || '?>' AS p FROM nation")
def xml_root_pi(t: Tables):
    doc = F.concat(F.lit('<?xml version="1.1"?>'), x.element("n", F.col("n_name")))
    return t.nation.select("n_nationkey", x.root(doc, standalone=True).alias("r"), x.pi("sort", F.col("n_name")).alias("p"))


@query("SELECT o_orderkey AS k, CASE WHEN l_linenumber IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity) END AS place, l_linenumber AS n, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def json_table_nested(t: Tables):
    """JSON_TABLE with a nested path over one document an order; orders without lines keep a row."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")))).alias("items"))
    docs = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.coalesce("items", F.array().cast("array<struct<n:int,q:double>>")).alias("items"))).alias("d"))
    return j.json_table(docs, "d", {"k": ("$.k", "bigint", None)}, nested=("$.items", {"n": ("$.n", "int", None), "q": ("$.q", "double", None)}), nested_ordinality="place").drop("d")


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS a, NULL::VARCHAR AS b, '[' || json_extract_string(props, '$.k') || ']' AS c, '[' || json(props) || ']' AS d, '[0]' AS e FROM events")
def json_query_wrapper(t: Tables):
    doc = F.col("props")
    found = {"a": j.json_query(doc, "$"), "b": j.json_query(doc, "$.k"), "c": j.json_query(doc, "$.k", "conditional"), "d": j.json_query(doc, "$", "unconditional"), "e": j.json_query(doc, "$.none", on_empty="[0]")}
    return t.events.select("event_id", *[c.alias(n) for n, c in found.items()])

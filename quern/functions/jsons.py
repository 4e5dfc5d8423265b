"""JSON functions on text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _read(source: Column, columns: dict[str, tuple[str, str, object]]) -> dict[str, Column]:
    out = {}
    for name, (path, kind, default) in columns.items():
        value = F.get_json_object(source, path).try_cast(kind)
        out[name] = value if default is None else F.coalesce(value, F.lit(default).cast(kind))
    return out


def json_table(
    df: DataFrame, doc: str, columns: dict[str, tuple[str, str, object]], rows: str | None = None, ordinality: str | None = None, nested: tuple[str, dict[str, tuple[str, str, object]]] | None = None, nested_ordinality: str | None = None
) -> DataFrame:
    """JSON_TABLE(doc, rows COLUMNS ...): name to (path, type, default on empty). A value that does not
    fit its type is null (NULL ON ERROR). rows: the path of an array, a row per element; with ordinality from 1.
    nested: NESTED PATH of an array in each row and its columns, a row per element, one row of nulls where it is
    empty or missing; nested_ordinality counts from 1 in each row."""
    source = F.col(doc)
    if rows is not None:
        df = df.select("*", F.posexplode(F.from_json(F.get_json_object(doc, rows), "array<string>")).alias("_pos", "_row"))
        source = F.col("_row")
    out = _read(source, columns)
    if ordinality:
        out[ordinality] = F.col("_pos").cast("bigint") + 1
    if nested is None:
        return df.withColumns(out).drop("_pos", "_row")
    path, inner = nested
    df = df.withColumns(out).select("*", F.posexplode_outer(F.from_json(F.get_json_object(source, path), "array<string>")).alias("_pos2", "_row2"))
    more = _read(F.col("_row2"), inner)
    if nested_ordinality:
        more[nested_ordinality] = F.col("_pos2").cast("bigint") + 1
    return df.withColumns({n: F.when(F.col("_pos2").isNotNull(), c) for n, c in more.items()}).drop("_pos", "_row", "_pos2", "_row2")


def get(doc: Column, *path: str | int) -> Column:
    """doc -> a -> b (and #>, ->>): the value as text; strings without their quotes."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(doc, f"${steps}")


def has_key(doc: Column, key: str) -> Column:
    """doc ? key"""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def each(df: DataFrame, doc: str, key: str = "key", value: str = "value") -> DataFrame:
    """jsonb_each_text: a row per member."""
    return df.select("*", F.explode(F.from_json(doc, "map<string,string>")).alias(key, value))


def elements(df: DataFrame, doc: str, value: str = "value", ordinal: str | None = None) -> DataFrame:
    """jsonb_array_elements_text: a row per element, with its number from 1 if asked for."""
    out = df.select("*", F.posexplode(F.from_json(doc, "array<string>")).alias("_pos", value))
    return (out.withColumn(ordinal, F.col("_pos").cast("bigint") + 1) if ordinal else out).drop("_pos")


def is_json(doc: Column, kind: str = "value") -> Column:
    """doc IS JSON [OBJECT | ARRAY | SCALAR]"""
    valid = F.try_parse_json(doc).isNotNull()
    first = F.substring(F.ltrim(doc), 1, 1)
    return {"value": valid, "object": valid & (first == "{"), "array": valid & (first == "["), "scalar": valid & ~first.isin("{", "[")}[kind]


def typeof(doc: Column) -> Column:
    """jsonb_typeof"""
    first = F.substring(F.ltrim(doc), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def canonical(doc: Column) -> Column:
    """A text that is equal for equal documents: keys in order, no blanks, the last of repeated keys."""
    return F.to_json(F.try_parse_json(doc))


def set_key(doc: Column, key: str, value: Column) -> Column:
    """doc || {key: value} of a flat object of texts."""
    return F.to_json(F.map_concat(F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, _: k != key), F.create_map(F.lit(key), value)))


def _items(doc: Column, key: int) -> tuple[Column, Column, Column]:
    """An array's elements, their number, and the place from 0 that key names (from the end if negative)."""
    items = F.from_json(doc, "array<variant>")
    size = F.size(items)
    return items, size, F.lit(key) if key >= 0 else size + key


def _has(doc: Column, key: str | int) -> Column:
    if isinstance(key, str):
        return has_key(doc, key)
    _, size, at = _items(doc, key)
    return F.coalesce((at >= 0) & (at < size), F.lit(False))


def _member(doc: Column, key: str | int) -> Column:
    """One member or element as JSON text."""
    if isinstance(key, str):
        return F.to_json(F.try_element_at(F.from_json(doc, "map<string,variant>"), F.lit(key)))
    items, _, at = _items(doc, key)
    return F.to_json(F.get(items, at))


def _splice(doc: Column, key: int, new: Column | None, skip: int) -> Column:
    """The array with `skip` elements at the place taken out and the new one put there."""
    items, size, at = _items(doc, key)
    at = F.least(F.greatest(at, F.lit(0)), size)
    tail = F.slice(items, at + 1 + skip, size)
    return F.to_json(F.concat(F.slice(items, F.lit(1), at), tail) if new is None else F.concat(F.slice(items, F.lit(1), at), F.array(F.parse_json(new)), tail))


def _put(doc: Column, key: str | int, new: Column) -> Column:
    if isinstance(key, int):
        return _splice(doc, key, new, 1)
    return concat_docs(doc, F.concat(F.to_json(F.array(F.lit(key))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(key)))) - 2), F.lit(":"), new), wrap=True)


def _edit(doc: Column, path: list[str | int], last) -> Column:
    """last(container, step) applied where the path ends; doc as it is where a step before is missing."""
    head, rest = path[0], path[1:]
    if not rest:
        return last(doc, head)
    return F.when(_has(doc, head), _put(doc, head, _edit(_member(doc, head), rest, last))).otherwise(doc)


def concat_docs(a: Column, b: Column, wrap: bool = False) -> Column:
    """a || b of two objects (b's members win) or two arrays; an object meets an array as an element of it."""
    if wrap:
        b = F.concat(F.lit("{"), b, F.lit("}"))
    one, two = F.from_json(a, "map<string,variant>"), F.from_json(b, "map<string,variant>")
    objects = F.to_json(F.map_concat(F.map_filter(one, lambda k, _: ~F.array_contains(F.map_keys(two), k)), two))
    if wrap:
        return objects
    listed = lambda d: F.when(typeof(d) == "array", F.from_json(d, "array<variant>")).otherwise(F.array(F.parse_json(d)))
    return F.when((typeof(a) == "object") & (typeof(b) == "object"), objects).otherwise(F.to_json(F.concat(listed(a), listed(b))))


def set_path(doc: Column, path: list[str | int], value: Column, create: bool = True) -> Column:
    """jsonb_set(doc, path, value as JSON text, create): create adds a missing last key, and puts a missing position
    at the array's end (or its start, if negative). A null value gives null."""

    def last(d: Column, key: str | int) -> Column:
        missing = d if not create else _put(d, key, value) if isinstance(key, str) else _splice(d, key, value, 0)
        return F.when(_has(d, key), _put(d, key, value)).otherwise(missing)

    return F.when(value.isNotNull(), _edit(doc, path, last))


def insert_path(doc: Column, path: list[str | int], value: Column, after: bool = False) -> Column:
    """jsonb_insert: before (or after) a position of an array; a new key of an object, an error if it is there."""

    def last(d: Column, key: str | int) -> Column:
        if isinstance(key, str):
            return F.when(has_key(d, key), F.raise_error(F.lit(f"cannot replace existing key {key}")).cast("string")).otherwise(_put(d, key, value))
        return F.when(_has(d, key), _splice(d, key + 1 if after and key != -1 else key, value, 0) if not (after and key == -1) else _splice(d, 1 << 30, value, 0)).otherwise(_splice(d, key, value, 0))

    return F.when(value.isNotNull(), _edit(doc, path, last))


def delete_path(doc: Column, path: list[str | int]) -> Column:
    """doc #- path, and doc - key with a path of one step; a missing step leaves doc as it is."""

    def last(d: Column, key: str | int) -> Column:
        if isinstance(key, str):
            gone = F.to_json(F.map_filter(F.from_json(d, "map<string,variant>"), lambda k, _: k != key))
        else:
            gone = _splice(d, key, None, 1)
        return F.when(_has(d, key), gone).otherwise(d)

    return _edit(doc, path, last)


def json_scalar(x: Column) -> Column:
    """JSON_SCALAR(x): a text as a JSON string, numbers and truth values as they are; null stays null."""
    one = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNotNull(), one.substr(F.lit(6), F.length(one) - 6))


def json_value(doc: Column, path: str, kind: str = "string", on_empty=None) -> Column:
    """JSON_VALUE(doc, path RETURNING kind DEFAULT on_empty ON EMPTY NULL ON ERROR)"""
    value = F.get_json_object(doc, path).try_cast(kind)
    return value if on_empty is None else F.coalesce(value, F.lit(on_empty).cast(kind))


def json_query(doc: Column, path: str, wrapper: str = "without", on_empty: str | None = None) -> Column:
    """JSON_QUERY(doc, path ... WRAPPER): the JSON text at the path. wrapper: without (a scalar is an error, so null),
    conditional (scalars become arrays of one) or unconditional. on_empty: JSON text where nothing is there."""
    if wrapper not in ("without", "conditional", "unconditional"):
        raise ValueError(f"wrapper {wrapper}")
    found = F.to_json(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    packed, nested = F.concat(F.lit("["), found, F.lit("]")), F.substring(found, 1, 1).isin("{", "[")
    out = {"without": F.when(nested, found), "conditional": F.when(nested, found).otherwise(packed), "unconditional": packed}[wrapper]
    return out if on_empty is None else F.when(found.isNull() & is_json(doc), F.lit(on_empty)).otherwise(out)


def json_exists(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path).isNotNull()


def build_object(**values: Column) -> Column:
    """json_build_object; nulls are kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})

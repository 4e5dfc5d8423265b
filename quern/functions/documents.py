"""Whole-document functions that need a parser: JSON containment, paths with filters, pretty text, identifiers.

These run as Arrow-batched functions; everything that Spark's own JSON expressions can do is in jsons.py.
"""

from __future__ import annotations

import json
import operator
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType


def contains_value(a, b) -> bool:
    """a @> b: objects by member, arrays by element, scalars by equality; an array contains a scalar of its own at the top."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains_value(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains_value(x, y) and isinstance(x, list) == isinstance(y, list) for x in a) for y in b)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _load(text):
    if text is None:
        return None
    try:
        return (json.loads(text),)
    except ValueError:
        return None


@F.pandas_udf(BooleanType())
def jsonb_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """a @> b of two documents; null where one is null or no JSON."""

    def one(x, y):
        x, y = _load(x), _load(y)
        if x is None or y is None:
            return None
        return contains_value(x[0], y[0]) or (isinstance(x[0], list) and not isinstance(y[0], (list, dict)) and y[0] in x[0])

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


_OPS = {"==": operator.eq, "!=": operator.ne, "<>": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}
_STEP = re.compile(r"""\.(?P<key>\w+)|\."(?P<quoted>[^"]*)"|\[(?P<all>\*)\]|\[(?P<at>-?\d+)\]|\s*\?\s*\(\s*@(?P<sub>[^\s<>=!]*)\s*(?P<op>==|!=|<>|<=|>=|<|>)\s*(?P<value>"[^"]*"|-?[\d.]+|true|false|null)\s*\)""")


def path_query(doc, path: str) -> list:
    """Values at a path of .key, [n], [*] and ? (@.key op literal) steps, in lax mode."""
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    found, at = [doc], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise ValueError(f"not understood in a path: {path[at:]}")
        at = m.end()
        key = m["key"] if m["key"] is not None else m["quoted"]
        if key is not None:
            flat = [y for x in found for y in (x if isinstance(x, list) else [x])]
            found = [x[key] for x in flat if isinstance(x, dict) and key in x]
        elif m["all"]:
            found = [y for x in found for y in (x if isinstance(x, list) else [x])]
        elif m["at"] is not None:
            i = int(m["at"])
            found = [x[i] for x in ((v if isinstance(v, list) else [v]) for v in found) if -len(x) <= i < len(x)]
        else:
            value, kept = json.loads(m["value"]), []
            for x in [y for v in found for y in (v if isinstance(v, list) else [v])]:
                for y in path_query(x, "$" + m["sub"]):
                    same = isinstance(y, str) == isinstance(value, str) and isinstance(y, bool) == isinstance(value, bool) and (y is None) == (value is None) and not isinstance(y, (list, dict))
                    if same and (y is not None or m["op"] in ("==", "!=", "<>")) and _OPS[m["op"]](y, value):
                        kept.append(x)
                        break
            found = kept
    return found


def jsonb_path_query_array(path: str):
    """A function from documents to the texts of the values at path."""

    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if (x := _load(d)) is None else [json.dumps(v) for v in path_query(x[0], path)])

    return F.pandas_udf(run, ArrayType(StringType()))


@F.pandas_udf(StringType())
def jsonb_pretty(docs: pd.Series) -> pd.Series:
    """Four blanks a level; keys by length, then by bytes."""

    def order(v):
        if isinstance(v, dict):
            return {k: order(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
        return [order(x) for x in v] if isinstance(v, list) else v

    return docs.map(lambda d: None if (x := _load(d)) is None else json.dumps(order(x[0]), indent=4, ensure_ascii=False))


@F.pandas_udf(ArrayType(StringType()))
def parse_ident(names: pd.Series) -> pd.Series:
    """The parts of a qualified name; plain ones in lower case. Null for a name that is not well formed."""

    def one(name):
        if name is None or not re.fullmatch(r'\s*(?:"(?:[^"]|"")+"|[A-Za-z_][\w$]*)(?:\s*\.\s*(?:"(?:[^"]|"")+"|[A-Za-z_][\w$]*))*\s*', name):
            return None
        return [p[1:-1].replace('""', '"') if p[0] == '"' else p.lower() for p in re.findall(r'"(?:[^"]|"")+"|[A-Za-z_][\w$]*', name)]

    return names.map(one)

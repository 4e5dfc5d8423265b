"""XML functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def element(name: str, *content: Column, **attributes: Column) -> Column:
    """xmlelement(NAME name, xmlattributes(...), content): content is taken as it is, null as empty; a null attribute is left out."""
    attrs = [F.coalesce(F.concat(F.lit(f' {k}="'), escape(v.cast("string")), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    inside = F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in content]) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), *attrs)
    return F.when(inside == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inside, F.lit(f"</{name}>")))


def forest(**values: Column) -> Column:
    """xmlforest: an element per value that is not null."""
    return F.concat_ws("", *[F.when(v.isNotNull(), F.concat(F.lit(f"<{k}>"), escape(v.cast("string")), F.lit(f"</{k}>"))) for k, v in values.items()])


def comment(s: Column) -> Column:
    return F.concat(F.lit("<!--"), s, F.lit("-->"))


def exists(doc: Column, path: str) -> Column:
    return F.xpath_boolean(doc, F.lit(f"boolean({path})"))


def agg(x: Column, *order: Column) -> Column:
    """xmlagg(x ORDER BY order)"""
    from quern.operators.aggregates import array_agg

    return F.array_join(array_agg(x, *order), "")


def pi(name: str, content: Column | None = None) -> Column:
    """xmlpi(NAME name, content)"""
    return F.lit(f"<?{name}?>") if content is None else F.concat(F.lit(f"<?{name} "), F.ltrim(content), F.lit("?>"))


def root(doc: Column, version: str = "1.0", standalone: bool | None = None) -> Column:
    """xmlroot(doc, VERSION version, STANDALONE yes|no): in place of a declaration that is there."""
    alone = "" if standalone is None else f' standalone="{"yes" if standalone else "no"}"'
    return F.concat(F.lit(f'<?xml version="{version}"{alone}?>'), F.regexp_replace(doc, r"^<\?xml\s[^>]*\?>", ""))

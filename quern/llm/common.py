"""What the operators share: the core's shared folder and lineage cuts, free column names, bounded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import table
from quern.sources.files import cut, shared_folder
from quern.sources.files import new_path as scratch_path

__all__ = ["crc_of", "cut", "free_names", "scratch_path", "share_below", "shared_folder", "table", "text_or_empty"]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of(col: str) -> Column:
    """crc32 of a value as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def share_below(fraction: float, *cols: Column) -> Column:
    """True for about this share of rows, chosen by a hash of the columns: the same rows at every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < F.lit(int(min(1.0, fraction) * (1 << 30)))

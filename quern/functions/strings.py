"""String functions where the reference's semantics and Spark's differ, or Spark has none."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType


def substr(s: Column, start: int, count: int | None = None) -> Column:
    """Positions count from 1 and may lie before the string: substr(s, 0, n) has n - 1 characters."""
    if count is None:
        return F.substring(s, F.lit(max(start, 1)), F.length(s))
    if count < 0:
        raise ValueError("negative substring length not allowed")
    first = max(start, 1)
    return F.substring(s, F.lit(first), F.lit(max(start + count - first, 0)))


def left(s: Column, n: int) -> Column:
    """The first n characters; all but the last -n if n is negative."""
    return F.substring(s, F.lit(1), F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """The last n characters; all but the first -n if n is negative."""
    if n < 0:
        return F.substring(s, F.lit(1 - n), F.length(s))
    return F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), F.lit(n))


def concat(*parts: Column) -> Column:
    """concat(): nulls count as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def format(template: str, *args: Column) -> Column:
    """format(): %s text (null: empty), %I identifier, %L literal, %n$ by position, %% itself."""
    out, at, nth = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            out.append(F.lit("%"))
            continue
        nth = int(m[1]) if m[1] else nth + 1
        x = args[nth - 1].cast("string")
        out.append({"s": F.coalesce(x, F.lit("")), "I": quote_ident(x), "L": F.coalesce(quote_literal(x), F.lit("NULL"))}[m[2]])
    return F.concat(*out, F.lit(template[at:]))


def quote_ident(s: Column) -> Column:
    """Double quotes where a name isn't plain lower case (key words aside)."""
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit("E"), quoted)).otherwise(quoted)


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match only, unless flags has g; i ignores case; \\1 and \\& refer to groups and the match."""
    java = re.sub(r"\\([0-9&])", lambda m: "$" + ("0" if m[1] == "&" else m[1]), replacement.replace("$", "\\$"))
    pattern = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(s, pattern, java)
    groups = re.compile(pattern).groups
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}" if m[1] != "0" else "$2", java)
    return F.regexp_replace(s, f"(?s)\\A(.*?)({pattern})(.*)\\z", f"$1{shifted}${groups + 3}")


def regexp_matches(s: Column, pattern: str) -> Column:
    """Arrays of the groups of each match (of the whole match, if there is no group), as an array."""
    groups = re.compile(pattern).groups
    if groups == 0:
        return F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda m: F.array(m))
    return F.arrays_zip(*[F.regexp_extract_all(s, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(groups)])


def split_literal(s: Column, delimiter: str) -> Column:
    """string_to_array(s, delimiter): an empty text gives an empty array."""
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, re.escape(delimiter), -1))


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """The n-th field, from the end if n is negative; empty where there is none."""
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def ascii(s: Column) -> Column:
    """The code point of the first character, 0 for an empty text."""
    unit = F.hex(F.encode(F.substring(s, 1, 1), "UTF-32"))
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.conv(unit, 16, 10).cast("int"))


def initcap(s: Column) -> Column:
    """Words are runs of letters and digits, whatever is between them."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def trigrams(s: Column) -> Column:
    """The distinct trigrams of each word in lower case, two blanks before it and one after."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    x, y = trigrams(a), trigrams(b)
    return F.when(F.size(F.array_union(x, y)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _ordered_trigrams(word: Column) -> Column:
    """A word's trigrams in their order, two blanks before it and one after."""
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(F.concat(F.lit("  "), word, F.lit(" ")), i, F.lit(3)))


def _best_extent(a: Column, pieces: Column) -> Column:
    """The greatest similarity of a's trigrams to those of any run of neighbours among pieces (arrays of trigrams)."""
    x, n = trigrams(a), F.size(pieces)

    def score(run: Column) -> Column:
        return F.size(F.array_intersect(x, run)) / F.greatest(F.size(F.array_union(x, run)), F.lit(1))

    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_max(F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: score(F.flatten(F.slice(pieces, i, k))))))
    return F.when(a.isNull() | pieces.isNull(), None).when((n == 0) | (F.size(x) == 0), F.lit(0.0)).otherwise(F.array_max(runs))


def _words_of(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_similarity(a: Column, b: Column) -> Column:
    """Similarity of a's trigrams to those of the best run of b's, in their order. Time grows with the cube of b's length: for words and names."""
    singles = F.transform(F.flatten(F.transform(_words_of(b), _ordered_trigrams)), lambda g: F.array(g))
    return _best_extent(a, singles)


def strict_word_similarity(a: Column, b: Column) -> Column:
    """The same over runs of b's whole words."""
    return _best_extent(a, F.transform(_words_of(b), _ordered_trigrams))


def difference(a: Column, b: Column) -> Column:
    """How many of the four places of two soundex codes are equal."""
    return F.size(F.filter(F.zip_with(F.split(F.soundex(a), ""), F.split(F.soundex(b), ""), lambda x, y: x == y), lambda e: e))


#: Letters with marks and what they become.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def unaccent(s: Column) -> Column:
    ligatures = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
    out = F.translate(s, _MARKED, _PLAIN)
    for a, b in ligatures.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def uuid_from_name(namespace: Column, name: Column, version: int = 5) -> Column:
    """uuid_generate_v3 (MD5) or v5 (SHA-1) of a namespace uuid and a name."""
    raw = F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8"))
    h = F.lower(F.md5(raw) if version == 3 else F.sha1(raw))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(str(version)), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid_extract_millis(uuid: Column) -> Column:
    """Milliseconds since 1970 of a version 7 uuid; null for others."""
    h = F.replace(uuid, F.lit("-"), F.lit(""))
    return F.when(F.substring(h, 13, 1) == "7", F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"))


#: Template patterns of to_char and their Spark counterparts.
_TO_CHAR = {"YYYY": "yyyy", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Mon": "MMM", "Month": "MMMM", "Dy": "EEE", "YY": "yy", "Q": "q"}


def date_template(template: str) -> str:
    """A to_char template for dates as a Spark pattern; other text is quoted."""
    out, plain = [], ""
    for part in re.findall("|".join(sorted(_TO_CHAR, key=len, reverse=True)) + "|.", template, re.S):
        if part in _TO_CHAR:
            out.append(("'" + plain.replace("'", "''") + "'" if plain else "") + _TO_CHAR[part])
            plain = ""
        else:
            plain += part
    return "".join(out) + ("'" + plain.replace("'", "''") + "'" if plain else "")


def substring_pattern(s: Column, pattern: str) -> Column:
    """substring(s FROM pattern): the first group of the first match, all of it where there is no group, null without a match."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(F.regexp_like(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def to_char(x: Column, template: str) -> Column:
    return F.date_format(x, date_template(template))


_SUFFIXES = ("ational:ate", "tional:tion", "iveness:ive", "fulness:ful", "ization:ize", "ingly:", "edly:", "ing:", "ed:", "ies:y", "sses:ss", "ly:", "s:")


def stem(word: str) -> str:
    """A light English stemmer: the first suffix that leaves three letters goes."""
    for rule in _SUFFIXES:
        suffix, to = rule.split(":")
        if word.endswith(suffix) and not word.endswith("ss") and len(word) - len(suffix) >= 3:
            return word[: -len(suffix)] + to
    return word


#: English words that a text search vector leaves out.
STOP_WORDS = frozenset("a an and are as at be but by for from had has have he her his i if in into is it its not of on or she so such that the their then there these they this to was we were will with you".split())


@F.pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def to_tsvector(texts: pd.Series) -> pd.Series:
    """Stems of words that are no stop words, with their positions from 1."""

    def one(text):
        if text is None:
            return None
        out: dict[str, list[int]] = {}
        for i, w in enumerate(re.findall(r"\w+", text.lower()), 1):
            if w not in STOP_WORDS:
                out.setdefault(stem(w), []).append(i)
        return out

    return texts.map(one)


def ts_match(vector: Column, *words: str) -> Column:
    """vector @@ 'a & b': all stems occur."""
    return reduce(lambda a, b: a & b, [F.map_contains_key(vector, stem(w.lower())) for w in words])


def ts_rank(vector: Column, *words: str) -> Column:
    """How often the stems occur, by the logarithm of the number of positions."""
    hits = sum((F.coalesce(F.size(F.try_element_at(vector, F.lit(stem(w.lower())))), F.lit(0)) for w in words), F.lit(0))
    total = F.aggregate(F.map_values(vector), F.lit(0), lambda s, p: s + F.size(p))
    return hits / (F.log2(total + 2))


@F.pandas_udf(StringType())
def metaphone_key(words: pd.Series) -> pd.Series:
    """A consonant skeleton in the manner of Metaphone: common digraphs become one sound, vowels stay at the start only."""
    rules = (("^kn|^gn|^pn|^wr", "n"), ("mb$", "m"), ("ph", "f"), ("sch|sh|ti(?=[ao])|ci(?=a)", "x"), ("ch", "x"), ("th", "0"), ("ck", "k"), ("c(?=[iey])", "s"), ("c", "k"), ("dg(?=[iey])", "j"), ("d", "t"), ("gh(?=[^aeiou]|$)", ""), ("g(?=[iey])", "j"), ("g", "k"), ("q", "k"), ("v", "f"), ("x", "ks"), ("z", "s"), ("(?<=[^aeiou])h|w(?![aeiou])|y(?![aeiou])", ""))

    def one(word):
        if word is None:
            return None
        w = re.sub("[^a-z]", "", word.lower())
        for pattern, to in rules:
            w = re.sub(pattern, to, w)
        return (w[:1] + re.sub("[aeiou]", "", re.sub(r"(.)\1", r"\1", w[1:]))).upper()

    return words.map(one)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """hmac(message, key, 'sha256') in hex, by two digests."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda mask: F.lit(bytearray(b ^ mask for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def random_uuid() -> Column:
    """gen_random_uuid()"""
    return F.uuid()

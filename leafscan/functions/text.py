"""Text functions of the scoring suite: normalisation, keys, edit distances."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BRACKETED = re.compile(r"\[.*\]")
EDGE = re.compile(r"^\W+|\W+$")


def normalized(text: str | None, strict: bool = False) -> str | None:
    """Composed, long s levelled, case folded, split at white space; tokens lose punctuation at their edges unless
    strict or wholly in square brackets; empty ones go. Null stays null."""
    if text is None:
        return None
    words = unicodedata.normalize("NFC", text).replace("ſ", "s").casefold().split()
    if not strict:
        words = [w if BRACKETED.fullmatch(w) else EDGE.sub("", w) for w in words]
    return " ".join(w for w in words if w)


@F.pandas_udf(StringType())  # a type string could not be read in a Python worker
def _normalize(text: pd.Series) -> pd.Series:
    return text.map(normalized, na_action="ignore").astype("object")


def normalize(text: Column | str) -> Column:
    """normalized() as a column: texts of plain ASCII stay in the JVM, where case folding is lower case."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(t), r"[\t-\r\x1c-\x20]+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.when(w.rlike(r"^\[.*\]$"), w).otherwise(F.regexp_replace(w, r"^[^a-z0-9_]+|[^a-z0-9_]+$", "")))
    plain = F.array_join(F.filter(bare, lambda w: w != ""), " ")
    far = t.rlike(r"[^\x00-\x7f]")
    return F.when(far, _normalize(F.when(far, t))).otherwise(plain)


def line_key(text: Column) -> Column:
    """Lower case, white space collapsed: for comparing lines."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def word_key(word: Column) -> Column:
    """Lower case without punctuation at the edges: for comparing words."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))


def words_of(text: Column) -> Column:
    """The words of a normalised text; none of an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


#: A word that is in a text so often has its bits kept; those of others are put together when they are met.
OFTEN = 16


def distance_of(a: list[str], b: list[str]) -> int:
    """Edits between two lists, exact at any length. Bit-parallel: a column of the table of distances is two integers, a bit for each
    word of a that tells if the distance goes up, or down, from the word before (Hyyrö 2003)."""
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    kept = {w: sum(1 << i for i in at) for w, at in places.items() if len(at) >= OFTEN}
    every, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for w in b:
        same = kept[w] if w in kept else sum(1 << i for i in places.get(w, ()))
        flat = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(level | up)), up & level
        distance += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(flat | more)) & every, more & flat & every
    return distance


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance_of(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_distance(a: Column, b: Column) -> Column:
    """Edits in words between two arrays of words, exact at any length; null if either is null."""
    return F.when(a == b, F.lit(0)).otherwise(_distance(F.when(a != b, a), F.when(a != b, b)))


def edits_of(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """(distance, substitutions, deletions, insertions); of equal ways the one with a diagonal, then a deletion, last."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        nxt = [(i, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            d, s, x, n = row[j - 1]
            best = (d, s, x, n) if r == h else (d + 1, s + 1, x, n)
            u = row[j]
            if u[0] + 1 < best[0]:
                best = (u[0] + 1, u[1], u[2] + 1, u[3])
            left = nxt[j - 1]
            if left[0] + 1 < best[0]:
                best = (left[0] + 1, left[1], left[2], left[3] + 1)
            nxt.append(best)
        row = nxt
    return row[-1]


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("distance", "sub", "deletions", "ins")]))
def edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edits_of(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)], columns=["distance", "sub", "deletions", "ins"])


def multiset_matches(a: Column, b: Column) -> Column:
    """How many words two arrays share, each as often as it is in both: both are sorted with each word numbered, and intersected."""

    def numbered(words: Column) -> Column:
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("k"), F.array().cast("array<struct<w:string,k:int>>").alias("out"))

        def step(acc: Column, w: Column) -> Column:
            k = F.when((acc["k"] > 0) & (acc["last"] == w), acc["k"] + 1).otherwise(F.lit(1))
            return F.struct(w.alias("last"), k.alias("k"), F.concat(acc["out"], F.array(F.struct(w.alias("w"), k.alias("k")))).alias("out"))

        return F.aggregate(F.array_sort(words), start, step, lambda acc: acc["out"])

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def rate(numerator: Column, denominator: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)

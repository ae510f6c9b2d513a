"""Problem 1: texts that look the same but differ in their characters, brought to one form.

Look-alike signs are mapped one by one; values that the accent-sensitive Unicode collation then holds equal make
one class; a class's canonical member is joined back to its rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafscan.session import table, written

# Letters of other scripts that are drawn as a Latin one.
CYRILLIC = ("аеорсухіѕјһԁԛԝѵӏАВЕКМНОРСТХУІЅЈԌԚԜҮһ", "aeopcyxisjhdqwvlABEKMHOPCTXYISJGQWYh")
GREEK = ("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹͿ", "ovpABEZHIKMNOPTYXcjCJ")
ARMENIAN = ("օհոսՕՍ", "ohnuOU")
LATIN = ("ɑɡ", "ag")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏞᏟᏢᏙᏚᏦᏴ", "DRTAJEWMHGZLCPVSKB")
HYPHENS = "‐‑﹣－⁃˗"
#: Signs of no width that aren't format characters (category Cf) either.
NO_MARK = "͏ᅟᅠㅤ឴឵᠋᠌᠍"


@lru_cache(maxsize=1)
def sign_maps() -> tuple[dict[str, str], dict[str, str], str]:
    """(sign -> one sign, sign -> several, signs that leave no mark), from the lists above and rules over Unicode."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for a, b in (CYRILLIC, GREEK, ARMENIAN, LATIN, CHEROKEE):
        one |= dict(zip(a, b, strict=True))
    none = list(NO_MARK)
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        cat = unicodedata.category(c)
        if cat == "Zs":
            one[c] = " "
        elif cat == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            none.append(c)
        parts = unicodedata.decomposition(c).split()
        kind, to = (parts[0], parts[1:]) if parts and parts[0].startswith("<") else ("", parts)
        if kind in ("<wide>", "<narrow>"):
            one[c] = chr(int(to[0], 16))
        elif kind == "<font>" and len(to) == 1 and cat[0] == "L":  # letters in a style of their own
            base = chr(int(to[0], 16))
            one[c] = one.get(base, base)
        elif kind == "<compat>" and cat == "Nl" and len(to) == 1:  # numerals of one letter
            one[c] = chr(int(to[0], 16))
        elif kind == "<compat>" and len(to) > 1 and unicodedata.name(c, "").startswith("LATIN") and c not in "ŉẚ":
            many[c] = "".join(chr(int(x, 16)) for x in to)  # joined letter forms, one step: the long s stays
    one |= dict.fromkeys(HYPHENS, "-")
    for code in range(0x370, 0x530):  # accented letters of a look-alike base
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in one and len(n := unicodedata.normalize("NFC", one[d[0]] + d[1:])) == 1:
            one[c] = n
    for c in ("K", "Å"):
        one[c] = unicodedata.normalize("NFC", c)
    return one, many, "".join(dict.fromkeys(none))


def mapped(text: Column) -> Column:
    """text with every look-alike sign replaced and every sign without a mark removed; accents stay as they are."""
    one, many, none = sign_maps()
    out = F.translate(text, "".join(one) + none, "".join(one.values()))
    joined = out
    for c, to in many.items():
        joined = F.replace(joined, F.lit(c), F.lit(to))
    out = F.when(text.rlike("[" + "".join(many) + "]"), joined).otherwise(out)
    # Rows in plain ASCII, which are most, skip the mapping.
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def alike(text: Column) -> Column:
    """The value that equals another one exactly if the two look the same: collated, so é equals e with an accent after it."""
    return F.collate(mapped(text), "UNICODE")


def form(text: str) -> str:
    """The same in Python, for tests and for small work inside other operators."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_signs()))


@lru_cache(maxsize=1)
def _signs() -> dict:
    one, many, none = sign_maps()
    return str.maketrans(one | many | dict.fromkeys(none, ""))


def rank(text: Column) -> Column:
    """The order by which a class's canonical member is chosen: no mapped signs, then the shortest, then the smallest."""
    return F.struct((text != mapped(text)).alias("changed"), F.length(text).alias("signs"), text.alias("text"))


#: Hot keys are spread over so many in joins.
SALTS = 16


def salted(many: DataFrame, few: DataFrame, keys: list[str], how: str, by: str) -> DataFrame:
    """many joined with few, which has each key once, where a key may be hot in many: spread by the hash of column by."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    many = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return many.join(few.withColumn("__salt", salts), [*keys, "__salt"], how).drop("__salt")


def canonical(df: DataFrame, text_col: str, out_col: str = "canonical", id_col: str | None = None) -> DataFrame:
    """df with the canonical member (see rank) of each text's class in out_col.

    Texts are grouped by alike(), added up before the shuffle, so however many copies of a text are one row there; the members of
    classes with more than one text, a small part, are joined back, spread by id_col where a text may be hot. A null text has a
    null canonical form, an empty one "". Rows, repeated ones too, are kept as they are; a column that is already called out_col
    is replaced. An empty table gives an empty result.
    """
    df = df.drop(out_col) if out_col in df.columns and out_col != text_col else df
    text = F.col(text_col)
    some = df.where(text.isNotNull() & (text != "")).select(alike(text).alias("__alike"), text.alias("__t"))
    best = some.groupBy("__alike").agg(F.min(rank(F.col("__t"))).getField("text").alias("__best"), F.min("__t").alias("__a"), F.max("__t").alias("__b"))
    best = best.where("__a <> __b").select("__alike", "__best")
    rows = df.withColumn("__alike", F.when(text != "", alike(text)))
    joined = salted(rows, best, ["__alike"], "left", id_col or text_col)
    return joined.select(*df.columns, F.coalesce("__best", text).alias(out_col))


def alike_pairs(left: DataFrame, right: DataFrame, scope: str) -> DataFrame:
    """(left_id, right_id) of rows of one scope value that look the same but differ in their characters.

    left and right have the columns id, scope and text. Both are hashed once on (scope, class), where each row gets the
    canonical member of its class; rows of classes with both sides and more than one text, a small part, are written,
    and the two sides are joined on the canonical member.
    Null and empty texts and null scopes make no pair; repeated rows make one.
    """

    def rows(df: DataFrame, side: int) -> DataFrame:
        ok = F.col("text").isNotNull() & (F.col("text") != "") & F.col(scope).isNotNull()
        return df.where(ok).select(F.lit(side).alias("side"), F.col("id"), F.col(scope).alias("scope"), "text", alike(F.col("text")).alias("alike"), rank(F.col("text")).alias("rank"))

    every = rows(left, 0).unionByName(rows(right, 1))
    one_class = W.partitionBy("scope", "alike")
    classes = every.select(
        "*",
        F.min("rank").over(one_class)["text"].alias("canonical"),
        F.min("text").over(one_class).alias("a"),
        F.max("text").over(one_class).alias("b"),
        F.min("side").over(one_class).alias("s0"),
        F.max("side").over(one_class).alias("s1"),
    )
    held = written(classes.where("s0 = 0 and s1 = 1 and a <> b").select("side", "id", "scope", "canonical", "text"))
    a = held.where("side = 0").select("scope", "canonical", F.col("id").alias("left_id"), F.col("text").alias("left_text"))
    b = held.where("side = 1").select("scope", "canonical", F.col("id").alias("right_id"), F.col("text").alias("right_text"))
    pairs = a.join(b, ["scope", "canonical"]).where("left_text <> right_text")
    return pairs.select("left_id", "right_id").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "transcribed_lines", "line_id", "page_id", "text").withColumnRenamed("line_id", "id")
    boxes = table(spark, sf_dir, "line_boxes", "det_id", "page_id", "text").withColumnRenamed("det_id", "id")
    pairs = alike_pairs(lines, boxes, "page_id")
    return pairs.select(F.col("left_id").alias("line_id"), F.col("right_id").alias("det_id"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and box with its text in one form."""
    lines = table(spark, sf_dir, "transcribed_lines").select(F.lit("line").alias("rec"), F.col("line_id").alias("rec_id"), "text")
    boxes = table(spark, sf_dir, "line_boxes").select(F.lit("box").alias("rec"), F.col("det_id").alias("rec_id"), "text")
    return canonical(lines.unionByName(boxes).dropDuplicates(["rec", "rec_id"]), "text", id_col="rec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLE: dict[str, str] = {}

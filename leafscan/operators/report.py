"""The scoring suite from a manifest to a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions import text as T
from leafscan.sources import formats

#: Difficulties that are scored but kept out of the averages.
CEILING = ("ceiling", "extreme")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def score(items: DataFrame) -> DataFrame:
    """items (id, mode, type, difficulty, era, ref, hyp) with missing, ceiling, and the scores of their route.

    mode spotting is scored by labels regardless of order, any other by edits in words and characters. What lacks its truth or its
    hypothesis is not scored; the truth is named first."""
    missing = F.when(F.col("ref").isNull(), "ground truth").when(F.col("hyp").isNull(), "hypothesis")
    d = items.withColumns({"missing": missing, "ceiling": F.coalesce(F.col("difficulty").isin(*CEILING), F.lit(False)), "spotting": F.coalesce(F.col("mode") == "spotting", F.lit(False))})
    d = d.withColumns({"r": T.normalize("ref"), "h": T.normalize("hyp")}).withColumns({"rw": T.words_of(F.col("r")), "hw": T.words_of(F.col("h"))})
    scored = F.col("missing").isNull()
    seq, spot = scored & ~F.col("spotting"), scored & F.col("spotting")
    d = d.withColumn("matched", F.when(spot, T.multiset_matches(F.col("rw"), F.col("hw"))))
    d = d.withColumn("e", T.edits(F.when(seq, F.col("rw")).otherwise(F.array().cast("array<string>")), F.when(seq, F.col("hw")).otherwise(F.array().cast("array<string>"))))
    d = d.withColumns({
        "n_ref": F.when(scored, F.size("rw")), "n_hyp": F.when(scored, F.size("hw")), "n_chars": F.when(seq, F.length("r")), "word_errors": F.when(seq, F.col("e.distance")),
        "char_errors": F.when(seq, F.levenshtein("r", "h")), "sub": F.when(seq, F.col("e.sub")), "deletions": F.when(seq, F.col("e.deletions")), "ins": F.when(seq, F.col("e.ins")),
    })
    rate = lambda a, b: T.rate(F.col(a), F.col(b))
    d = d.withColumns({"wer": rate("word_errors", "n_ref"), "cer": rate("char_errors", "n_chars"), "precision": rate("matched", "n_hyp"), "recall": rate("matched", "n_ref")})
    d = d.withColumns({"wer": F.when(seq, F.col("wer")), "cer": F.when(seq, F.col("cer")), "precision": F.when(spot, F.col("precision")), "recall": F.when(spot, F.col("recall"))})
    return d.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("r", "h", "rw", "hw", "e", "ref", "hyp")


def corpus(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """Items of a corpus folder: manifest.csv, truths in gt, hypotheses of a tag in cache."""
    truth = formats.read_texts(spark, f"{folder}/gt").withColumnRenamed("text", "ref")
    hyp = formats.read_texts(spark, f"{folder}/cache", tagged=True).where(F.col("tag") == tag).select("id", F.col("text").alias("hyp"))
    return formats.read_manifest(spark, f"{folder}/manifest.csv").join(truth, "id", "left").join(hyp, "id", "left")


def averages(docs: DataFrame) -> DataFrame:
    """Sums and rates of scored items outside the ceiling: overall (level 0) and by type, difficulty and era; labels in a row of their own."""
    own = docs.where("missing is null and not ceiling")
    keys = ("type", "difficulty", "era")
    s = lambda c: F.sum(c).cast("long").alias(c)
    seq = own.where("not spotting").groupingSets([[], [F.col(k) for k in keys]], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("docs"), *map(s, ("word_errors", "n_ref", "char_errors", "n_chars")))
    seq = seq.select(F.when(F.col("g") == 0, "stratum").otherwise("overall").alias("level"), *keys, "docs", "word_errors", "n_ref", "char_errors", "n_chars", F.lit(None).cast("long").alias("n_hyp"), F.lit(None).cast("long").alias("matched"))
    none = F.lit(None).cast("string")
    spot = own.where("spotting").agg(F.count("*").alias("docs"), s("n_ref"), s("n_hyp"), s("matched")).where("docs > 0")
    spot = spot.select(F.lit("spotting").alias("level"), *(none.alias(k) for k in keys), "docs", F.lit(None).cast("long").alias("word_errors"), "n_ref", F.lit(None).cast("long").alias("char_errors"), F.lit(None).cast("long").alias("n_chars"), "n_hyp", "matched")
    rate = lambda a, b: F.when(F.col(a).isNotNull(), T.rate(F.col(a), F.col(b)))
    out = seq.where("docs > 0").unionByName(spot).withColumns({"wer": rate("word_errors", "n_ref"), "cer": rate("char_errors", "n_chars"), "precision": rate("matched", "n_hyp"), "recall": F.when(F.col("level") == "spotting", T.rate(F.col("matched"), F.col("n_ref")))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def doc_json(docs: DataFrame) -> DataFrame:
    """(id, json) of each item; rates to four places; what an item lacks is left out."""
    r = lambda c: F.round(c, 4).alias(c)
    body = F.struct("id", "mode", "type", "difficulty", "era", "missing", r("wer"), r("cer"), F.when(~F.col("spotting"), F.col("n_ref")).alias("n_ref_words"), "sub", "deletions", "ins", r("precision"), r("recall"), r("f1"),
                    F.when(F.col("spotting"), F.col("n_ref")).alias("n_ref"), F.when(F.col("spotting"), F.col("n_hyp")).alias("n_hyp"))
    return docs.select("id", F.to_json(body).alias("json"))


def report_lines(docs: DataFrame) -> DataFrame:
    """(part, key, line) of the text report; ordered by part and key. Parts: 0 counts, 1 overall, 2 strata, 3 labels, 4 and 5 ceiling, 6 skipped."""
    pc = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    a = averages(docs)
    errors = F.concat(F.lit("WER "), pc("wer"), F.lit("  CER "), pc("cer"))
    row = lambda df, part, key, line: df.select(F.lit(part).alias("part"), key.alias("key"), line.alias("line"))
    n = docs.agg(F.count_if(F.col("missing").isNull()).alias("a"), F.count_if(F.col("missing").isNotNull()).alias("b"), F.count_if(F.col("missing").isNull() & F.col("ceiling")).alias("c"))
    none = F.lit("")
    stratum = F.concat_ws("/", *(F.coalesce(k, none) for k in ("type", "difficulty", "era")))
    parts = [
        row(n, 0, none, F.format_string("Transcription accuracy: %d scored, %d skipped", "a", "b")),
        row(a.where("level = 'overall' and n_ref > 0"), 1, none, F.concat(F.lit("  overall: "), errors, F.format_string("  (%d docs, %d words)", "docs", "n_ref"))),
        row(a.where("level = 'stratum'"), 2, stratum, F.concat(F.lit("    "), stratum, F.lit(": "), errors, F.format_string("  (%d docs)", "docs"))),
        row(a.where("level = 'spotting'"), 3, none, F.concat(F.lit("  labels: P "), pc("precision"), F.lit("  R "), pc("recall"), F.lit("  F1 "), pc("f1"), F.format_string("  (%d docs)", "docs"))),
        row(n.where("c > 0"), 4, none, F.format_string("  ceiling, not in the averages: %d", "c")),
        row(docs.where("missing is null and ceiling and not spotting"), 5, F.col("id").cast("string"), F.concat(F.format_string("    %s: ", F.col("id").cast("string")), errors)),
        row(docs.where("missing is not null"), 6, F.col("id").cast("string"), F.concat(F.format_string("  skipped %s: no ", F.col("id").cast("string")), F.col("missing"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Token accounting, tiered cost, pre-flight estimates and batch progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# USD for a million tokens: model, input, output, threshold of tokens a call (0: none), input and output above it.
PRICES = (("scribe-pro", 2.0, 12.0, 200_000, 4.0, 18.0), ("scribe-flash", 1.5, 9.0, 0, 0.0, 0.0), ("scribe-lite", 0.25, 1.5, 0, 0.0, 0.0))
#: Output tokens of a page, low and high, by mode.
OUTPUT_RANGE = {"two_pass": (3000, 9000), "one_pass": (1800, 5400), "text": (0, 0)}


def price_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, price_in double, price_out double, threshold long, high_in double, high_out double")


def counted(calls: DataFrame) -> DataFrame:
    """call_usage with input, output and thinking tokens of each call; a missing output is what the total leaves. Copies count once."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = F.greatest(F.lit(0), F.col("total_token_count") - n("prompt_token_count") - n("thoughts_token_count"))
    out = F.when((n("candidates_token_count") == 0) & F.col("total_token_count").isNotNull(), rest).otherwise(n("candidates_token_count"))
    calls = calls.dropDuplicates(["call_id"])
    return calls.withColumns({"input": n("prompt_token_count"), "output": out, "thinking": n("thoughts_token_count")})


def usage(calls: DataFrame, *by: str) -> DataFrame:
    c = counted(calls)
    sums = [F.sum(k).cast("long").alias(k) for k in ("input", "output", "thinking")]
    return c.groupBy(*by).agg(*sums, F.count("*").cast("long").alias("calls")).withColumn("total", F.col("input") + F.col("output") + F.col("thinking"))


def rates(calls: Column, tokens_in: Column) -> tuple[Column, Column]:
    """(input, output) rates of a row joined with its price: the higher ones hold where a model has a threshold and the mean input
    of a call is above it; null without a price."""
    high = (F.col("threshold") != 0) & (calls != 0) & (tokens_in / calls > F.col("threshold"))
    return F.when(high, F.col("high_in")).otherwise(F.col("price_in")), F.when(high, F.col("high_out")).otherwise(F.col("price_out"))


def value(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    million = F.lit(1e6)
    return F.round(tokens_in / million * rate_in + tokens_out / million * rate_out, 8)


_PRICE = ("price_in", "price_out", "threshold", "high_in", "high_out")


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input, output, thinking, calls) with the rates that hold and the cost; null for a model without a price, or no model."""
    j = usage.join(F.broadcast(prices), "model", "left")  # a catalog of a few literal rows
    rate_in, rate_out = rates(F.col("calls"), F.col("input"))
    whole = value(F.col("input"), F.col("output") + F.col("thinking"), rate_in, rate_out)
    return j.withColumns({"rate_in": F.coalesce(rate_in, F.lit(0.0)), "rate_out": F.coalesce(rate_out, F.lit(0.0)), "cost": whole}).drop(*_PRICE)


def deltas(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Per job and file, in order of files: running totals of tokens, and what each file added; never below 0. A job is one window."""
    per = usage(calls, "file_id").join(files.select("file_id", "job_id").distinct(), "file_id")
    w = W.partitionBy("job_id").orderBy("file_id")
    run = per.withColumn("running", F.sum("total").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.select("job_id", "file_id", F.col("running").cast("long").alias("running"), F.greatest(F.lit(0), F.col("running") - F.coalesce(F.lag("running").over(w), F.lit(0))).cast("long").alias("added"))


def estimate(files: DataFrame, per_page: DataFrame, prices: DataFrame) -> DataFrame:
    """Range of output tokens and cost before a run, for each model and mode.

    files: file_id, model, mode, n_pages; per_page: file_id, tokens of its first page. Pages unknown count as 1, tokens as 0."""
    calls = F.when(F.col("mode") == "two_pass", 2).when(F.col("mode") == "one_pass", 1).otherwise(0)
    f = files.join(per_page, "file_id", "left").withColumns({"n": F.coalesce("n_pages", F.lit(1)), "t": F.coalesce("tokens", F.lit(0)), "c": calls})
    low = F.create_map(*[F.lit(x) for k, v in OUTPUT_RANGE.items() for x in (k, v[0])])[F.col("mode")]
    high = F.create_map(*[F.lit(x) for k, v in OUTPUT_RANGE.items() for x in (k, v[1])])[F.col("mode")]
    s = lambda c: F.sum(c).cast("long")
    g = f.groupBy("model", "mode").agg(
        s("n").alias("pages"), s(F.col("n") * F.col("c")).alias("calls"), s(F.col("n") * F.col("t") * F.col("c")).alias("input"),
        s(F.col("n") * F.coalesce(low, F.lit(0))).alias("output_low"), s(F.col("n") * F.coalesce(high, F.lit(0))).alias("output_high"),
    )
    j = g.join(F.broadcast(prices), "model", "left")  # keeps groups without a model
    rate_in, rate_out = rates(F.col("calls"), F.col("input"))
    priced = lambda out: F.when(F.col("calls") != 0, value(F.col("input"), F.col(out), rate_in, rate_out))
    return j.select(*g.columns, priced("output_low").alias("cost_low"), priced("output_high").alias("cost_high"))


def progress(events: DataFrame) -> DataFrame:
    """Running units of each job (job, seq, pages, budget): after each file at least its budget so far; closed form by windows."""
    w = W.partitionBy("job").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    e = events.withColumns({"p": F.sum("pages").over(w), "b": F.sum("budget").over(w)})
    e = e.withColumn("ahead", F.greatest(F.lit(0), F.max(F.col("b") - F.col("p")).over(w)))
    return e.select("job", "seq", (F.col("p") + F.col("ahead")).cast("long").alias("units_done"), F.sum("budget").over(W.partitionBy("job")).cast("long").alias("units_total"))


def log_tail(events: DataFrame, key: str, order: str, most: int = 500) -> DataFrame:
    """The last lines of each job's log with their absolute index, and how many there are in all: a capped log is the feature."""
    back = W.partitionBy(key).orderBy(F.col(order).desc())
    n = F.count("*").over(W.partitionBy(key))
    e = events.withColumns({"rn": F.row_number().over(back), "total": n})
    return e.where(F.col("rn") <= most).withColumn("at", F.col("total") - F.col("rn")).drop("rn")


def percent(done: Column, total: Column, status: Column | None = None) -> Column:
    """Whole percents, halves up, 0 to 100; 0 of nothing, and 100 once the status is done."""
    share = F.when(total <= 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.floor(done / total * 100 + 0.5)))).cast("int")
    return share if status is None else F.when(status == "done", 100).otherwise(share)


# What a service's message contains if a key is refused, a model is gone, or a call may be tried again; and status codes.
AUTH = ("API_KEY_INVALID", "API KEY NOT VALID", "API KEY EXPIRED", "PERMISSION_DENIED", "UNAUTHENTICATED", "UNAUTHORIZED", "INVALID AUTHENTICATION")
GONE = ("NOT_FOUND", "NO LONGER AVAILABLE", "IS NOT FOUND", "NOT SUPPORTED", "DOES NOT EXIST", "UNKNOWN MODEL", "NOT FOUND FOR API VERSION")
AGAIN = ("UNAVAILABLE", "DEADLINE", "RESOURCE_EXHAUSTED", "INTERNAL", "OVERLOADED", "TIMEOUT", "TIMED OUT", "TEMPORARILY", "CONNECTION", "RESET BY PEER")
AUTH_CODES, GONE_CODES, AGAIN_CODES = (401, 403), (404,), (408, 429, 500, 502, 503, 504)


def error_class(code: Column, message: Column) -> Column:
    """auth, gone, transient or other, in this order."""
    m = F.upper(F.coalesce(message, F.lit("")))
    has = lambda codes, words: F.coalesce(code.isin(*codes), F.lit(False)) | m.rlike("|".join(words))
    return F.when(has(AUTH_CODES, AUTH), "auth").when(has(GONE_CODES, GONE), "gone").when(has(AGAIN_CODES, AGAIN), "transient").otherwise("other")


def short_error(code: Column, message: Column) -> Column:
    """The code and the message up to its first brace, 140 signs at most; "error" if nothing is left."""
    text = F.trim(F.substring_index(F.coalesce(message, F.lit("")), "{", 1))
    both = F.left(F.trim(F.concat_ws(" ", code.cast("string"), text)), F.lit(140))
    return F.when(both == "", "error").otherwise(both)

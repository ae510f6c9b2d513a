"""Every query of the engine's own operators by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafscan.functions import text as T
from leafscan.operators import align, geometry, layout, usage
from leafscan.session import table
from leafscan.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# ---------------------------------------------------------------- views that several queries start from


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcribed_lines", "line_id", "page_id", "line_no", "text", "x0", "y0", "x1", "y1", "confidence", "is_interpolated").distinct()


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_results", "page_id", "file_id", "page_no", "image_name", "width", "height").distinct()


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring items: a transcribed line as reference and the box of the same place as hypothesis, with its strata."""
    # Both sides are partitioned by page once: copies, the join on the line's place and the one on the page need no other shuffle.
    ref = table(spark, sf, "transcribed_lines", "line_id", "page_id", "line_no", "text").repartition("page_id").dropDuplicates(["page_id", "line_id"])
    hyp = table(spark, sf, "line_boxes", "page_id", "det_idx", "det_id", "text").repartition("page_id").groupBy("page_id", "det_idx").agg(F.min_by("text", "det_id").alias("hyp"))
    files = table(spark, sf, "page_results", "page_id", "file_id").distinct().join(table(spark, sf, "file_results", "file_id", "job_id").distinct(), "file_id")
    jobs = table(spark, sf, "job_settings", "job_id", "content_type", "mode", "media_resolution").distinct()
    strata = files.join(jobs, "job_id").select("page_id", "content_type", "mode", "media_resolution")
    joined = ref.join(hyp, (ref.page_id == hyp.page_id) & (ref.line_no == hyp.det_idx), "left").select(ref["*"], "hyp")
    return joined.join(strata, "page_id", "left").select(
        "line_id", "page_id", F.col("text").alias("ref"), "hyp", "content_type", "mode", F.coalesce("media_resolution", F.lit("none")).alias("difficulty")
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Items with both texts: normalised, and the edits in words and characters."""
    i = items(spark, sf).where("ref is not null and hyp is not null").withColumns({"r": T.normalize("ref"), "h": T.normalize("hyp")})
    i = i.withColumns({"rw": T.words_of(F.col("r")), "hw": T.words_of(F.col("h"))})
    return i.withColumns({
        "n_words": F.size("rw"), "word_errors": T.word_distance(F.col("rw"), F.col("hw")),
        "n_chars": F.length("r"), "char_errors": F.levenshtein("r", "h"),
    })


# White space and word signs as Python's str.split and \w have them.
_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    folded = f"replace(replace(replace(lower(replace(nfc_normalize({x}), 'ſ', 's')), 'ß', 'ss'), 'ﬀ', 'ff'), 'ﬁ', 'fi')"
    word = r"CASE WHEN regexp_full_match(w, '\[.*\]') THEN w ELSE regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') END"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({folded}, '{_WS}'), lambda w: {word}), lambda w: w <> ''), ' ')"


_ITEMS = f"""
ref AS (SELECT DISTINCT line_id, page_id, line_no, text FROM transcribed_lines),
hyp AS (SELECT page_id, det_idx, arg_min(coalesce(text, chr(1)), det_id) AS t FROM line_boxes GROUP BY 1, 2),
strata AS (SELECT DISTINCT p.page_id, j.content_type, j.mode, coalesce(j.media_resolution, 'none') AS difficulty
           FROM (SELECT DISTINCT page_id, file_id FROM page_results) p JOIN (SELECT DISTINCT file_id, job_id FROM file_results) f USING (file_id)
           JOIN (SELECT DISTINCT job_id, content_type, mode, media_resolution FROM job_settings) j USING (job_id)),
items AS (SELECT ref.line_id, ref.page_id, ref.text AS ref, nullif(hyp.t, chr(1)) AS hyp, content_type, mode, coalesce(difficulty, 'none') AS difficulty
          FROM ref LEFT JOIN hyp ON ref.page_id = hyp.page_id AND ref.line_no = hyp.det_idx LEFT JOIN strata ON ref.page_id = strata.page_id),
norm AS (SELECT *, {_norm("ref")} AS r, {_norm("hyp")} AS h FROM items WHERE ref IS NOT NULL AND hyp IS NOT NULL)
"""


def _codes(a: str, both: str) -> str:
    return f"array_to_string(list_transform({a}, lambda w: chr(CAST(list_position({both}, w) + 33 AS INTEGER))), '')"


_SCORED = f"""
{_ITEMS},
lists AS (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(h, ' '), lambda w: w <> '') AS hw,
          CASE WHEN r = '' THEN [] ELSE string_split(r, '') END AS rc, CASE WHEN h = '' THEN [] ELSE string_split(h, '') END AS hc FROM norm),
scored AS (SELECT line_id, content_type, mode, difficulty, len(rw) AS n_words, length(r) AS n_chars, rw, hw,
           levenshtein({_codes("rw", "list_distinct(list_concat(rw, hw))")}, {_codes("hw", "list_distinct(list_concat(rw, hw))")}) AS word_errors,
           levenshtein({_codes("rc", "list_distinct(list_concat(rc, hc))")}, {_codes("hc", "list_distinct(list_concat(rc, hc))")}) AS char_errors FROM lists)
"""


@query(f"SELECT line_id, {_norm('text')} AS norm FROM (SELECT DISTINCT line_id, text FROM transcribed_lines) WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcribed_lines", "line_id", "text").where("text is not null").distinct()
    return t.select("line_id", T.normalize("text").alias("norm"))


@query(r"""SELECT line_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS line_key FROM (SELECT DISTINCT line_id, text FROM transcribed_lines)""")
def line_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcribed_lines", "line_id", "text").distinct().select("line_id", T.line_key(F.col("text")).alias("line_key"))


@query(f"WITH {_SCORED} SELECT line_id, CAST(n_words AS INTEGER) AS n_words, CAST(word_errors AS INTEGER) AS word_errors FROM scored")
def wer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("line_id", "n_words", "word_errors")


@query(f"WITH {_SCORED} SELECT line_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(char_errors AS INTEGER) AS char_errors FROM scored")
def cer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("line_id", "n_chars", "char_errors")


@query()
def word_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Substitutions, deletions and insertions of each item; held against word_distance and a brute-force version in the tests."""
    s = scored(spark, sf).withColumn("e", T.edits("rw", "hw"))
    return s.select("line_id", "e.distance", "e.sub", "e.deletions", "e.ins")


@query(f"""WITH {_SCORED}
SELECT coalesce(content_type, 'all') AS content_type, coalesce(mode, 'all') AS mode, coalesce(difficulty, 'all') AS difficulty, count(*) AS items,
       CAST(sum(word_errors) AS BIGINT) AS word_errors, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(char_errors) AS BIGINT) AS char_errors, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       CASE WHEN sum(n_words) = 0 THEN 0.0 ELSE round(CAST(sum(word_errors) AS DOUBLE) / sum(n_words), 6) END AS wer,
       CASE WHEN sum(n_chars) = 0 THEN 0.0 ELSE round(CAST(sum(char_errors) AS DOUBLE) / sum(n_chars), 6) END AS cer
FROM scored WHERE difficulty <> 'ultra' AND content_type IS NOT NULL GROUP BY GROUPING SETS ((content_type, mode, difficulty), ())""")
def strata_micro_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Word and character error rates overall and by stratum, in one pass over the items."""
    s = scored(spark, sf).where("difficulty <> 'ultra' and content_type is not null")
    total = lambda c: F.sum(c).cast("long")
    keys = ("content_type", "mode", "difficulty")
    g = s.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.count("*").alias("items"), total("word_errors").alias("word_errors"), total("n_words").alias("n_words"), total("char_errors").alias("char_errors"), total("n_chars").alias("n_chars")
    )
    g = g.withColumns({k: F.coalesce(k, F.lit("all")) for k in keys})
    return g.withColumns({"wer": F.round(T.rate(F.col("word_errors"), F.col("n_words")), 6), "cer": F.round(T.rate(F.col("char_errors"), F.col("n_chars")), 6)})


@query(f"""WITH {_SCORED}, words AS (SELECT line_id, unnest(rw) AS w, 1 AS a, 0 AS b FROM scored UNION ALL SELECT line_id, unnest(hw), 0, 1 FROM scored),
m AS (SELECT line_id, CAST(sum(least(a, b)) AS BIGINT) AS matched FROM (SELECT line_id, w, sum(a) AS a, sum(b) AS b FROM words GROUP BY 1, 2) GROUP BY 1)
SELECT mode, CAST(sum(len(rw)) AS BIGINT) AS n_ref, CAST(sum(len(hw)) AS BIGINT) AS n_hyp, CAST(sum(coalesce(matched, 0)) AS BIGINT) AS matched,
       round(CAST(sum(coalesce(matched, 0)) AS DOUBLE) / sum(len(hw)), 6) AS spot_precision, round(CAST(sum(coalesce(matched, 0)) AS DOUBLE) / sum(len(rw)), 6) AS spot_recall,
       round(2.0 * CAST(sum(coalesce(matched, 0)) AS DOUBLE) / (sum(len(hw)) + sum(len(rw))), 6) AS spot_f1
FROM scored LEFT JOIN m USING (line_id) WHERE mode IS NOT NULL GROUP BY mode""")
def spotting_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Labels found regardless of order: multiset matches, precision and recall by mode."""
    s = scored(spark, sf).where("mode is not null").withColumn("m", T.multiset_matches(F.col("rw"), F.col("hw")))
    g = s.groupBy("mode").agg(F.sum(F.size("rw")).cast("long").alias("n_ref"), F.sum(F.size("hw")).cast("long").alias("n_hyp"), F.sum("m").cast("long").alias("matched"))
    return g.withColumns({"spot_precision": F.round(T.rate(F.col("matched"), F.col("n_hyp")), 6), "spot_recall": F.round(T.rate(F.col("matched"), F.col("n_ref")), 6), "spot_f1": F.round(T.rate(2.0 * F.col("matched"), F.col("n_hyp") + F.col("n_ref")), 6)})


@query()
def fuzzy_spotting(spark: SparkSession, sf: str) -> DataFrame:
    """Labels found with a ratio of 0.8 or more, each taking its best unused one."""

    @F.pandas_udf("int")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align.fuzzy_matches(list(x), list(y), 0.8) for x, y in zip(a, b, strict=True)])

    return scored(spark, sf).select("line_id", F.size("rw").alias("n_ref"), F.size("hw").alias("n_hyp"), near("rw", "hw").alias("matched"))


@query(f"""WITH {_ITEMS} SELECT CASE WHEN ref IS NULL THEN 'ground truth' WHEN hyp IS NULL THEN 'hypothesis' ELSE 'none' END AS missing, count(*) AS items FROM items GROUP BY 1""")
def missing_items(spark: SparkSession, sf: str) -> DataFrame:
    why = F.when(F.col("ref").isNull(), "ground truth").when(F.col("hyp").isNull(), "hypothesis").otherwise("none")
    return items(spark, sf).groupBy(why.alias("missing")).agg(F.count("*").alias("items"))


# ---------------------------------------------------------------- layout

_BOXES = """boxes AS (SELECT DISTINCT page_id, det_id, det_idx, box_2d[1] AS ymin, box_2d[2] AS xmin, box_2d[3] AS ymax, box_2d[4] AS xmax
  FROM line_boxes WHERE len(box_2d) = 4 AND len(list_filter(box_2d, lambda x: x IS NULL)) = 0)"""
_COLS = f"""{_BOXES}, g AS (SELECT *, CASE WHEN xmin - lag(xmin) OVER (PARTITION BY page_id ORDER BY xmin, det_idx, det_id) > 100 THEN 1 ELSE 0 END AS new FROM boxes),
cols AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY xmin, det_idx, det_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS col FROM g)"""


@query(f"WITH {_COLS} SELECT det_id, page_id, col FROM cols")
def column_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return layout.columns(layout.boxes_of(table(spark, sf, "line_boxes"))).select("det_id", "page_id", "col")


@query(f"""WITH {_COLS} SELECT page_id, col, count(*) AS n, list_sort(list(xmax - xmin))[count(*) // 2 + 1] AS width, list_sort(list(ymax - ymin))[count(*) // 2 + 1] AS height,
 list_sort(list(xmin))[count(*) // 2 + 1] AS xmin, list_sort(list(xmax))[count(*) // 2 + 1] AS xmax FROM cols GROUP BY page_id, col""")
def column_medians(spark: SparkSession, sf: str) -> DataFrame:
    return layout.column_medians(layout.columns(layout.boxes_of(table(spark, sf, "line_boxes"))))


@query(f"""WITH {_BOXES}, p AS (SELECT DISTINCT page_id, width, height FROM page_results), v AS (
 SELECT det_id, greatest(0, least(width, CAST(round_even(xmin / 1000.0::DOUBLE * width, 0) AS INTEGER))) AS a, greatest(0, least(height, CAST(round_even(ymin / 1000.0::DOUBLE * height, 0) AS INTEGER))) AS b,
        greatest(0, least(width, CAST(round_even(xmax / 1000.0::DOUBLE * width, 0) AS INTEGER))) AS c, greatest(0, least(height, CAST(round_even(ymax / 1000.0::DOUBLE * height, 0) AS INTEGER))) AS d
 FROM boxes JOIN p USING (page_id) WHERE width IS NOT NULL AND height IS NOT NULL)
SELECT det_id, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM v""")
def pixel_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "line_boxes", "det_id", "page_id", "box_2d").distinct()
    p = table(spark, sf, "page_results", "page_id", "width", "height").distinct()
    px = b.join(p, "page_id").select("det_id", geometry.to_pixels(F.col("box_2d"), F.col("width"), F.col("height")).alias("b"))
    return px.where("b is not null").select("det_id", "b.x0", "b.y0", "b.x1", "b.y1")


_WORDS = r"""words AS (
 SELECT line_id, x0, x1, y0, y1, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws
 FROM (SELECT DISTINCT line_id, text, x0, x1, y0, y1 FROM transcribed_lines) WHERE text IS NOT NULL AND x0 IS NOT NULL),
cells AS (SELECT line_id, x0, x1, y0, y1, length(array_to_string(ws, ' ')) AS total, unnest(range(len(ws))) AS word_no, ws FROM words),
placed AS (SELECT *, ws[word_no + 1] AS word, coalesce(list_sum(list_transform(ws[1:word_no], lambda w: length(w) + 1)), 0) AS before FROM cells),
word_boxes AS (SELECT line_id, word_no, word, y0, y1,
 x0 + CAST(round_even(CAST(before AS DOUBLE) / total * (x1 - x0), 0) AS INTEGER) AS x0,
 x0 + CAST(round_even(CAST(before + length(word) AS DOUBLE) / total * (x1 - x0), 0) AS INTEGER) AS e FROM placed)"""


@query(f"WITH {_WORDS} SELECT line_id, CAST(word_no AS INTEGER) AS word_no, word, x0, greatest(x0 + 1, e) AS x1 FROM word_boxes")
def word_boxes(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcribed_lines", "line_id", "text", "x0", "x1").where("text is not null and x0 is not null").distinct()
    return t.select("line_id", F.inline(geometry.spread_words(F.col("text"), F.col("x0"), F.col("x1"))))


@query(f"""WITH {_WORDS}, e AS (SELECT line_id, word_no, x0, greatest(x0 + 1, e) AS x1, lag(greatest(x0 + 1, e)) OVER (PARTITION BY line_id ORDER BY word_no) AS px1,
 lag(x0) OVER (PARTITION BY line_id ORDER BY word_no) AS px0 FROM word_boxes)
SELECT line_id, count(*) AS n_words, count_if(x1 - x0 < 2) AS degenerate, count_if(least(x1, px1) - greatest(x0, px0) > 0.5 * least(x1 - x0, px1 - px0)) AS overlapping FROM e GROUP BY line_id""")
def box_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Word boxes thinner than 2 pixels, and ones that share more than half of the smaller with their neighbour."""
    t = table(spark, sf, "transcribed_lines", "line_id", "text", "x0", "x1").where("text is not null and x0 is not null").distinct()
    w = t.withColumn("ws", geometry.spread_words(F.col("text"), F.col("x0"), F.col("x1"))).where("size(ws) > 0")
    width = lambda b: b["x1"] - b["x0"]
    common = F.zip_with("ws", F.slice("ws", F.lit(2), F.size("ws")), lambda a, b: F.coalesce(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) > 0.5 * F.least(width(a), width(b)), F.lit(False)))
    return w.select(
        "line_id", F.size("ws").cast("long").alias("n_words"), F.size(F.filter("ws", lambda b: width(b) < 2)).cast("long").alias("degenerate"), F.size(F.filter(common, lambda x: x)).cast("long").alias("overlapping")
    )


@query(f"""WITH {_BOXES}, p AS (SELECT DISTINCT page_id, width, height FROM page_results), l AS (SELECT DISTINCT line_id, page_id, line_no, x0, y0, x1, y1 FROM transcribed_lines), v AS (
 SELECT l.line_id, l.x0, l.y0, l.x1, l.y1, greatest(0, least(width, CAST(round_even(xmin / 1000.0::DOUBLE * width, 0) AS INTEGER))) AS a, greatest(0, least(height, CAST(round_even(ymin / 1000.0::DOUBLE * height, 0) AS INTEGER))) AS b,
  greatest(0, least(width, CAST(round_even(xmax / 1000.0::DOUBLE * width, 0) AS INTEGER))) AS c, greatest(0, least(height, CAST(round_even(ymax / 1000.0::DOUBLE * height, 0) AS INTEGER))) AS d, det_id
 FROM l JOIN boxes ON l.page_id = boxes.page_id AND l.line_no = boxes.det_idx JOIN p ON l.page_id = p.page_id),
w AS (SELECT line_id, det_id, greatest(0, least(x1, greatest(a, c)) - greatest(x0, least(a, c))) * greatest(0, least(y1, greatest(b, d)) - greatest(y0, least(b, d))) AS i,
 (x1 - x0) * (y1 - y0) + abs(c - a) * abs(d - b) AS s FROM v)
SELECT line_id, det_id, CASE WHEN i <= 0 OR s - i <= 0 THEN 0.0 ELSE round(CAST(i AS DOUBLE) / (s - i), 6) END AS iou FROM w""")
def line_iou(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of each transcribed line with the detected box of the same place."""
    b = table(spark, sf, "line_boxes", "det_id", "page_id", "det_idx", "box_2d").distinct()
    p = table(spark, sf, "page_results", "page_id", "width", "height").distinct()
    b = b.join(p, "page_id").withColumn("b", geometry.to_pixels(F.col("box_2d"), F.col("width"), F.col("height"))).where("b is not null")
    ln = lines(spark, sf).select("line_id", "page_id", F.col("line_no").alias("det_idx"), F.struct("x0", "y0", "x1", "y1").alias("a"))
    return ln.join(b, ["page_id", "det_idx"]).select("line_id", "det_id", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("""WITH l AS (SELECT DISTINCT line_id, page_id, line_no FROM transcribed_lines), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no, line_id) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS c FROM l)
SELECT line_id, CAST(floor(40 + k * (920.0::DOUBLE / c)) AS INTEGER) AS ymin, CAST(floor(40 + (k + 1) * (920.0::DOUBLE / c)) AS INTEGER) - 4 AS ymax FROM n""")
def synthetic_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Where lines would stand if none had been detected."""
    ln = table(spark, sf, "transcribed_lines", "line_id", "page_id", "line_no").distinct()
    k = F.row_number().over(W.partitionBy("page_id").orderBy("line_no", "line_id")) - 1
    step = F.lit(920.0) / F.count("*").over(W.partitionBy("page_id"))
    return ln.select("line_id", F.floor(40 + k * step).cast("int").alias("ymin"), (F.floor(40 + (k + 1) * step) - 4).cast("int").alias("ymax"))


@query("""SELECT p.page_id, coalesce(min(x0), 0) AS x0, coalesce(min(y0), 0) AS y0, coalesce(max(x1), any_value(width)) AS x1, coalesce(max(y1), any_value(height)) AS y1
FROM (SELECT DISTINCT page_id, width, height FROM page_results) p LEFT JOIN (SELECT DISTINCT line_id, page_id, x0, y0, x1, y1 FROM transcribed_lines) l ON p.page_id = l.page_id GROUP BY p.page_id""")
def page_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The box around a page's lines; all of the page where it has none."""
    p = table(spark, sf, "page_results", "page_id", "width", "height").distinct()
    g = lines(spark, sf).groupBy("page_id").agg(*(f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))
    j = p.join(g, "page_id", "left")
    return j.select("page_id", F.coalesce("x0", F.lit(0)).alias("x0"), F.coalesce("y0", F.lit(0)).alias("y0"), F.coalesce("x1", "width").alias("x1"), F.coalesce("y1", "height").alias("y1"))


@query()
def align_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Transcribed lines placed on the detected boxes of their page."""
    ordered = layout.reading_order(layout.boxes_of(table(spark, sf, "line_boxes"))).drop("det_id", "det_idx", "col")
    return align.align_lines(lines(spark, sf).select("page_id", "line_no", "text"), ordered)


@query()
def align_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each line on the words of its box, where they agree; the others in the gaps."""
    i = items(spark, sf).where("ref is not null").select("line_id", "ref", "hyp")
    pos = lines(spark, sf).select("line_id", "x0", "y0", "x1", "y1")
    kind = "array<struct<word:string,x0:int,y0:int,x1:int,y1:int,matched:boolean>>"

    @F.pandas_udf(kind)
    def place(ref: pd.Series, hyp: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        out = []
        for r, h, *b in zip(ref, hyp, x0, y0, x1, y1, strict=True):
            ws = (h or "").split()
            n = max(1, len(ws))
            found = [(w, (int(b[0] + (b[2] - b[0]) * k / n), int(b[1]), int(b[0] + (b[2] - b[0]) * (k + 1) / n), int(b[3]))) for k, w in enumerate(ws)]
            out.append([{"word": w, "x0": q[0], "y0": q[1], "x1": q[2], "y1": q[3], "matched": m} for w, q, m in align.place_words(r, tuple(map(int, b)), found)])
        return pd.Series(out)

    j = i.join(pos, "line_id").where("x0 is not null")
    return j.select("line_id", F.posexplode(place("ref", "hyp", "x0", "y0", "x1", "y1")).alias("word_no", "w")).select("line_id", "word_no", "w.*")


# ---------------------------------------------------------------- formats


@query("SELECT DISTINCT page_id, line_no, x0, y0, x1, y1 FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_no, line_id) - 1 AS INTEGER) AS line_no, x0, y0, x1, y1 FROM (SELECT DISTINCT line_id, page_id, line_no, x0, y0, x1, y1 FROM transcribed_lines))")
def hocr_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Line boxes written as hOCR and read back."""
    ln = lines(spark, sf).withColumn("line_no", (F.row_number().over(W.partitionBy("page_id").orderBy("line_no", "line_id")) - 1).cast("int"))
    ln = ln.withColumn("text", F.coalesce("text", F.lit("")))
    return formats.hocr_lines(formats.hocr_pages(pages(spark, sf), ln))


@query()
def hocr_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file as one hOCR document; parsed and read back in the tests."""
    return formats.hocr_documents(pages(spark, sf), lines(spark, sf))


@query()
def alto_files(spark: SparkSession, sf: str) -> DataFrame:
    return formats.alto_documents(pages(spark, sf), lines(spark, sf))


@query()
def page_word_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Edits in words between the lines of a page and its plain text, over whole texts."""
    p = table(spark, sf, "page_results", "page_id", "plain_text").dropDuplicates(["page_id"]).where("plain_text is not null")
    ln = lines(spark, sf).where("text is not null").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda x: x["text"]), "\n").alias("ref"))  # one page
    w = p.join(ln, "page_id").select("page_id", T.words_of(T.normalize("ref")).alias("a"), T.words_of(T.normalize("plain_text")).alias("b"))
    return w.select("page_id", F.size("a").alias("n_words"), T.word_distance(F.col("a"), F.col("b")).alias("word_errors"))


@query()
def pdf_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """What a searchable page of 72 dots an inch would print over a scan of 300."""
    return formats.overlay(lines(spark, sf).where("text is not null"), 72 / 300, 72 / 300)


@query(r"""WITH p AS (SELECT page_id, any_value(file_id) AS file_id, any_value(page_no) AS page_no, any_value(regexp_replace(coalesce(plain_text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) AS t FROM page_results GROUP BY page_id)
SELECT file_id, string_agg(t, chr(10) || chr(10) ORDER BY page_no, page_id) AS text FROM p GROUP BY file_id""")
def file_texts(spark: SparkSession, sf: str) -> DataFrame:
    return formats.file_text(table(spark, sf, "page_results", "page_id", "file_id", "page_no", "plain_text"))


@query("""SELECT file_id, source_name, lower(regexp_extract(source_name, '\\.([^.]+)$', 1)) IN ('tif','tiff','jpg','jpeg','png','gif','pdf') AS supported FROM (SELECT DISTINCT file_id, source_name FROM file_results)""")
def supported_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "file_results", "file_id", "source_name").distinct()
    return f.select("file_id", "source_name", formats.is_supported(F.col("source_name")).alias("supported"))


@query("""SELECT page_id, line_no // 5 AS block_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(round_even(avg(confidence), 0) AS INTEGER) AS confidence, count(*) AS n
FROM (SELECT DISTINCT line_id, page_id, line_no, text, x0, y0, x1, y1, confidence FROM transcribed_lines) WHERE trim(text) <> '' AND confidence >= 0 GROUP BY 1, 2""")
def ocr_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """OCR elements grouped to lines: here lines stand for words and five of them for a line."""
    w = lines(spark, sf).select(
        "page_id", F.lit(5).alias("level"), F.floor(F.col("line_no") / 5).cast("int").alias("block_num"), F.lit(1).alias("par_num"), F.lit(1).alias("line_num"), F.col("x0").alias("left"), F.col("y0").alias("top"),
        (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), F.col("confidence").cast("string").alias("conf"), "text", F.col("line_no").alias("word_no"),
    )
    g = formats.ocr_lines(w)
    n = w.where("trim(text) <> '' and conf is not null").groupBy("page_id", "block_num").agg(F.count("*").alias("n"))
    return g.select("page_id", "block_num", "x0", "y0", "x1", "y1", "confidence").join(n, ["page_id", "block_num"])


# ---------------------------------------------------------------- usage and progress

_COUNTED = """calls AS (SELECT DISTINCT call_id, page_id, file_id, model, pass_no, prompt_token_count, candidates_token_count, thoughts_token_count, total_token_count FROM call_usage),
counted AS (SELECT *, coalesce(prompt_token_count, 0) AS input, coalesce(thoughts_token_count, 0) AS thinking,
 CASE WHEN coalesce(candidates_token_count, 0) = 0 AND total_token_count IS NOT NULL THEN greatest(0, total_token_count - coalesce(prompt_token_count, 0) - coalesce(thoughts_token_count, 0)) ELSE coalesce(candidates_token_count, 0) END AS output FROM calls)"""
_SUMS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(thinking) AS BIGINT) AS thinking, count(*) AS calls, CAST(sum(input + output + thinking) AS BIGINT) AS total"
_PRICES = "prices(model, price_in, price_out, threshold, high_in, high_out) AS (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {t}, {c}::DOUBLE, {d}::DOUBLE)" for m, a, b, t, c, d in usage.PRICES) + ")"


@query(f"WITH {_COUNTED} SELECT file_id, {_SUMS} FROM counted GROUP BY file_id")
def usage_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return usage.usage(table(spark, sf, "call_usage"), "file_id")


@query(f"""WITH {_COUNTED}, {_PRICES}, u AS (SELECT file_id, model, {_SUMS} FROM counted GROUP BY file_id, model),
r AS (SELECT u.*, CASE WHEN threshold <> 0 AND calls <> 0 AND input / calls > threshold THEN high_in ELSE price_in END AS ri, CASE WHEN threshold <> 0 AND calls <> 0 AND input / calls > threshold THEN high_out ELSE price_out END AS ro
 FROM u LEFT JOIN prices USING (model))
SELECT file_id, model, input, output, thinking, calls, total, coalesce(ri, 0.0) AS rate_in, coalesce(ro, 0.0) AS rate_out, round(input / 1e6 * ri + (output + thinking) / 1e6 * ro, 8) AS cost FROM r""")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    return usage.cost(usage.usage(table(spark, sf, "call_usage"), "file_id", "model"), usage.price_catalog(spark))


@query(f"""WITH {_COUNTED}, u AS (SELECT file_id, sum(input + output + thinking) AS total FROM counted GROUP BY 1),
r AS (SELECT job_id, file_id, CAST(sum(total) OVER (PARTITION BY job_id ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM u JOIN (SELECT DISTINCT file_id, job_id FROM file_results) USING (file_id))
SELECT job_id, file_id, running, CAST(greatest(0, running - coalesce(lag(running) OVER (PARTITION BY job_id ORDER BY file_id), 0)) AS BIGINT) AS added FROM r""")
def usage_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return usage.deltas(table(spark, sf, "call_usage"), table(spark, sf, "file_results", "file_id", "job_id"))


@query(f"""WITH {_PRICES}, f AS (SELECT DISTINCT file_id, job_id, n_pages FROM file_results), j AS (SELECT DISTINCT job_id, transcription_model AS model, CASE WHEN content_type = 'text' THEN 'text' ELSE mode END AS mode FROM job_settings),
t AS (SELECT file_id, min(prompt_token_count) AS tokens FROM call_usage GROUP BY 1),
b AS (SELECT model, mode, coalesce(n_pages, 1) AS n, coalesce(tokens, 0) AS t, CASE mode WHEN 'two_pass' THEN 2 WHEN 'one_pass' THEN 1 ELSE 0 END AS c FROM f JOIN j USING (job_id) LEFT JOIN t USING (file_id)),
g AS (SELECT model, mode, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(n * c) AS BIGINT) AS calls, CAST(sum(n * t * c) AS BIGINT) AS input,
 CAST(sum(n * CASE mode WHEN 'two_pass' THEN 3000 WHEN 'one_pass' THEN 1800 ELSE 0 END) AS BIGINT) AS output_low, CAST(sum(n * CASE mode WHEN 'two_pass' THEN 9000 WHEN 'one_pass' THEN 5400 ELSE 0 END) AS BIGINT) AS output_high FROM b GROUP BY 1, 2),
r AS (SELECT g.*, CASE WHEN threshold <> 0 AND calls <> 0 AND input / calls > threshold THEN high_in ELSE price_in END AS ri, CASE WHEN threshold <> 0 AND calls <> 0 AND input / calls > threshold THEN high_out ELSE price_out END AS ro FROM g LEFT JOIN prices USING (model))
SELECT model, mode, pages, calls, input, output_low, output_high, CASE WHEN calls <> 0 THEN round(input / 1e6 * ri + output_low / 1e6 * ro, 8) END AS cost_low, CASE WHEN calls <> 0 THEN round(input / 1e6 * ri + output_high / 1e6 * ro, 8) END AS cost_high FROM r""")
def estimate_range(spark: SparkSession, sf: str) -> DataFrame:
    """What transcribing every job's files would take, before it is done."""
    jobs = table(spark, sf, "job_settings", "job_id", "transcription_model", "content_type", "mode").distinct()
    jobs = jobs.select("job_id", F.col("transcription_model").alias("model"), F.when(F.col("content_type") == "text", "text").otherwise(F.col("mode")).alias("mode")).distinct()
    files = table(spark, sf, "file_results", "file_id", "job_id", "n_pages").distinct().join(jobs, "job_id")
    first = table(spark, sf, "call_usage", "file_id", "prompt_token_count").groupBy("file_id").agg(F.min("prompt_token_count").alias("tokens"))
    return usage.estimate(files, first, usage.price_catalog(spark))


_EVENTS = """e AS (SELECT DISTINCT job_id AS job, file_id AS seq, CASE WHEN error IS NULL THEN coalesce(n_pages, 0) ELSE 0 END AS pages, coalesce(n_pages, 1) AS budget FROM file_results)"""


@query(f"""WITH {_EVENTS}, w AS (SELECT *, sum(pages) OVER o AS p, sum(budget) OVER o AS b FROM e WINDOW o AS (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT job, seq, CAST(p + greatest(0, max(b - p) OVER (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS units_done, CAST(sum(budget) OVER (PARTITION BY job) AS BIGINT) AS units_total FROM w""")
def progress_units(spark: SparkSession, sf: str) -> DataFrame:
    return usage.progress(file_events(spark, sf))


def file_events(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "file_results", "job_id", "file_id", "n_pages", "error").distinct()
    pages_ = F.when(F.col("error").isNull(), F.coalesce("n_pages", F.lit(0))).otherwise(0)
    return f.select(F.col("job_id").alias("job"), F.col("file_id").alias("seq"), pages_.alias("pages"), F.coalesce("n_pages", F.lit(1)).alias("budget")).distinct()


@query("""WITH c AS (SELECT DISTINCT call_id, file_id FROM call_usage), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY call_id DESC) AS rn, count(*) OVER (PARTITION BY file_id) AS total FROM c)
SELECT call_id, file_id, total, total - rn AS at FROM r WHERE rn <= 500""")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return usage.log_tail(table(spark, sf, "call_usage", "call_id", "file_id").distinct(), "file_id", "call_id")


@query("""SELECT file_id, n_pages, n_lines, list_filter([CASE WHEN txt_name IS NOT NULL THEN 'txt' END, CASE WHEN hocr_name IS NOT NULL THEN 'hocr' END, CASE WHEN alto_name IS NOT NULL THEN 'alto' END, CASE WHEN pdf_name IS NOT NULL THEN 'pdf' END], lambda x: x IS NOT NULL) AS outputs
FROM (SELECT DISTINCT file_id, n_pages, n_lines, txt_name, hocr_name, alto_name, pdf_name FROM file_results)""")
def file_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Which kinds of output each file has."""
    kinds = ("txt", "hocr", "alto", "pdf")
    f = table(spark, sf, "file_results", "file_id", "n_pages", "n_lines", *(f"{k}_name" for k in kinds)).distinct()
    return f.select("file_id", "n_pages", "n_lines", F.array_compact(F.array(*(F.when(F.col(f"{k}_name").isNotNull(), F.lit(k)) for k in kinds))).alias("outputs"))

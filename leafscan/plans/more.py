"""Further queries by name: clean word boxes, scores by item, display texts, job control, and a provider's pages; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions import display
from leafscan.operators import batch, geometry, provider, report, usage
from leafscan.plans.catalog import _BOXES, _COUNTED, _PRICES, _SCORED, _SUMS, items, lines, query
from leafscan.session import table
from leafscan.sources import formats

# ---------------------------------------------------------------- word boxes


def _words_sql(name: str, rows: str) -> str:
    """Words of rows (id, text, x0, x1) spread along their lines and set apart, as clean_<name>(id, word_no, word, x0, x1)."""
    return rf"""
{name}_l AS (SELECT id, x0 AS l0, x1 AS l1, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws FROM ({rows}) WHERE text IS NOT NULL AND x0 IS NOT NULL),
{name}_c AS (SELECT id, l0, l1, greatest(1, length(array_to_string(ws, ' '))) AS total, unnest(range(len(ws))) AS word_no, ws FROM {name}_l),
{name}_b AS (SELECT *, ws[word_no + 1] AS word, coalesce(list_sum(list_transform(ws[1:word_no], lambda w: length(w) + 1)), 0) AS before FROM {name}_c),
{name}_s AS (SELECT id, word_no, word, l0, l1, l0 + CAST(round_even(CAST(before AS DOUBLE) / total * (l1 - l0), 0) AS INTEGER) AS a,
  l0 + CAST(round_even(CAST(before + length(word) AS DOUBLE) / total * (l1 - l0), 0) AS INTEGER) AS e FROM {name}_b),
{name}_p AS (SELECT id, word_no, word, l0, l1, a, greatest(a + 1, e) AS b FROM {name}_s),
{name}_n AS (SELECT *, lag(b) OVER o AS pb, lead(a) OVER o AS na, least(l0, min(a) OVER (PARTITION BY id)) AS lo, greatest(l1, max(b) OVER (PARTITION BY id)) AS hi FROM {name}_p WINDOW o AS (PARTITION BY id ORDER BY word_no)),
{name}_h AS (SELECT id, word_no, word, lo, hi, CASE WHEN pb > a THEN (pb + a) // 2 ELSE a END AS a, CASE WHEN na < b THEN (na + b) // 2 ELSE b END AS b FROM {name}_n),
{name}_r AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY id ORDER BY word_no), hi) AS r FROM {name}_h),
{name}_f(id, word_no, word, x0, x1) AS (
  SELECT id, CAST(-1 AS BIGINT), CAST('' AS VARCHAR), min(lo), min(lo) FROM {name}_r GROUP BY id
  UNION ALL
  SELECT id, word_no, word, a1, CASE WHEN thin AND b1 <= a1 THEN a1 + 1 ELSE b1 END FROM (
    SELECT id, word_no, word, thin, b1, CASE WHEN thin AND b1 - a < 2 THEN greatest(least(a, b1 - 2), left_) ELSE a END AS a1 FROM (
      SELECT r.id, r.word_no, r.word, r.a, f.x1 AS left_, r.b - r.a < 2 AS thin, CASE WHEN r.b - r.a < 2 THEN least(greatest(r.b, r.a + 2), r.r) ELSE r.b END AS b1
      FROM {name}_f f JOIN {name}_r r ON r.id = f.id AND r.word_no = f.word_no + 1))),
clean_{name} AS (SELECT * FROM {name}_f WHERE word_no >= 0)"""


_LINES = "SELECT DISTINCT line_id AS id, text, x0, x1 FROM transcribed_lines"


@query(f"WITH RECURSIVE {_words_sql('l', _LINES)} SELECT id AS line_id, CAST(word_no AS INTEGER) AS word_no, word, x0, x1 FROM clean_l")
def word_boxes_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every line without overlaps or slivers."""
    t = table(spark, sf, "transcribed_lines", "line_id", "text", "x0", "x1").where("text is not null and x0 is not null").distinct()
    ws = geometry.apart(geometry.spread_words(F.col("text"), F.col("x0"), F.col("x1")), F.col("x0"), F.col("x1"))
    return t.select("line_id", F.inline(ws))


def _side(v: str, c: str) -> str:
    return f"greatest(0, least({v}, CAST(round_even({c} / 1000.0::DOUBLE * {v}, 0) AS INTEGER)))"


_TRUTH = f"""p AS (SELECT DISTINCT page_id, width, height FROM page_results), {_BOXES},
px AS (SELECT boxes.page_id, det_idx, boxes.det_id, {_side('width', 'xmin')} AS a, {_side('height', 'ymin')} AS b, {_side('width', 'xmax')} AS c, {_side('height', 'ymax')} AS d FROM boxes JOIN p USING (page_id)),
tx AS (SELECT DISTINCT det_id, text FROM line_boxes),
both_ AS (SELECT l.line_id, l.text, l.x0, l.y0, l.x1, l.y1, px.det_id, tx.text AS t_text, least(a, c) AS tx0, least(b, d) AS ty0, greatest(a, c) AS tx1, greatest(b, d) AS ty1
  FROM (SELECT DISTINCT line_id, page_id, line_no, text, x0, y0, x1, y1 FROM transcribed_lines) l JOIN px ON l.page_id = px.page_id AND l.line_no = px.det_idx JOIN tx USING (det_id)
  WHERE l.text IS NOT NULL AND tx.text IS NOT NULL AND l.x0 IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_TRUTH}, {_words_sql('m', 'SELECT line_id * 100000000 + det_id AS id, text, x0, x1 FROM both_')}, {_words_sql('t', 'SELECT line_id * 100000000 + det_id AS id, t_text AS text, tx0 AS x0, tx1 AS x1 FROM both_')},
k AS (SELECT line_id, det_id, line_id * 100000000 + det_id AS id, x0 AS lx0, y0, x1 AS lx1, y1, ty0, ty1 FROM both_),
w AS (SELECT coalesce(m.id, t.id) AS id, m.word_no AS mk, t.word_no AS tk, greatest(0, least(m.x1, t.x1) - greatest(m.x0, t.x0)) AS ix, m.x1 - m.x0 AS mw, t.x1 - t.x0 AS tw FROM clean_m m FULL JOIN clean_t t ON m.id = t.id AND m.word_no = t.word_no),
v AS (SELECT w.*, k.line_id, ix * greatest(0, least(y1, ty1) - greatest(y0, ty0)) AS i, mw * (y1 - y0) + tw * (ty1 - ty0) AS s FROM w JOIN k USING (id)),
q AS (SELECT z.line_id, z.id, count(tk) AS n_words, count(*) AS pairs, CAST(sum(CAST(round(one * 1000000, 0) AS BIGINT)) AS BIGINT) AS iou, sum(CASE WHEN one >= 0.5 THEN 1 ELSE 0 END) AS good
 FROM (SELECT *, CASE WHEN mk IS NULL OR tk IS NULL OR i <= 0 OR s - i <= 0 THEN 0.0::DOUBLE ELSE round(CAST(i AS DOUBLE) / (s - i), 6) END AS one FROM v) z GROUP BY line_id, id),
g AS (SELECT m.id, count_if(m.x1 - m.x0 < 2 OR k.y1 - k.y0 < 2) AS degenerate, count_if(m.x0 < k.lx0 - 1 OR m.x1 > k.lx1 + 1) AS outside FROM clean_m m JOIN k USING (id) GROUP BY 1)
SELECT line_id, CAST(n_words AS INTEGER) AS n_words, CAST(pairs AS INTEGER) AS pairs, (iou // pairs) / 1000000.0::DOUBLE AS mean_iou, CAST(good AS INTEGER) AS good, CAST(coalesce(degenerate, 0) AS INTEGER) AS degenerate, CAST(coalesce(outside, 0) AS INTEGER) AS outside
FROM q LEFT JOIN g USING (id)""")
def box_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Word boxes of each line beside those of its detected box: mean overlap over words by place (0 for surplus ones), how many share half,
    and defects."""
    p = table(spark, sf, "page_results", "page_id", "width", "height").distinct()
    b = table(spark, sf, "line_boxes", "det_id", "page_id", "det_idx", "text", "box_2d").distinct().join(p, "page_id")
    b = b.withColumn("b", geometry.to_pixels(F.col("box_2d"), F.col("width"), F.col("height"))).where("b is not null and text is not null")
    b = b.select("page_id", F.col("det_idx").alias("line_no"), "det_id", F.col("text").alias("t_text"), "b")
    both = lines(spark, sf).where("text is not null and x0 is not null").join(b, ["page_id", "line_no"])
    cell = lambda text, x0, y0, x1, y1: geometry.line_words(F.col(text), F.col(x0), F.col(y0), F.col(x1), F.col(y1), F.lit(95))
    both = both.withColumns({"m": cell("text", "x0", "y0", "x1", "y1"), "t": cell("t_text", "b.x0", "b.y0", "b.x1", "b.y1")})
    # The shorter side is filled with nulls, so that surplus words count 0.
    ious = F.zip_with("m", "t", lambda a, c: F.coalesce(F.round(geometry.iou(a, c), 6), F.lit(0.0)))
    both = both.withColumns({"ious": ious, "d": geometry.defects(F.col("m"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))}).where("size(ious) > 0")
    total = F.aggregate("ious", F.lit(0).cast("long"), lambda acc, x: acc + F.round(x * 1_000_000, 0).cast("long"))  # in millionths, so that sums are exact
    return both.select("line_id", F.size("t").alias("n_words"), F.size("ious").alias("pairs"), (F.floor(total / F.size("ious")) / 1e6).alias("mean_iou"), F.size(F.filter("ious", lambda x: x >= 0.5)).alias("good"), "d.degenerate", "d.outside")


@query(f"""WITH RECURSIVE {_words_sql('l', _LINES)}, e AS (SELECT id AS line_id, word, x0, x1, word_no FROM clean_l),
k AS (SELECT DISTINCT line_id, page_id, line_no, y0, y1, confidence FROM transcribed_lines WHERE confidence >= 2)
SELECT e.line_id, min(e.x0) AS x0, min(k.y0) AS y0, max(e.x1) AS x1, max(k.y1) AS y1, CAST(round_even(avg(confidence - word_no % 3), 0) AS INTEGER) AS confidence, string_agg(word, ' ' ORDER BY x0, word_no) AS text
FROM e JOIN k USING (line_id) GROUP BY e.line_id""")
def ocr_word_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words as an engine gives them (level 5, with confidences as text) grouped to their lines again."""
    w = word_boxes_clean(spark, sf).join(lines(spark, sf).select("line_id", "line_no", "y0", "y1", "confidence").where("confidence >= 2"), "line_id")
    w = w.select("line_id", F.lit(5).alias("level"), F.col("line_no").alias("block_num"), F.lit(1).alias("par_num"), F.lit(1).alias("line_num"), F.col("x0").alias("left"), F.col("y0").alias("top"),
                 (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), (F.col("confidence") - F.col("word_no") % 3).cast("string").alias("conf"), F.col("word").alias("text"), "word_no")
    return formats.ocr_lines(w, "line_id").select("line_id", "x0", "y0", "x1", "y1", "confidence", "text")


@query("SELECT DISTINCT line_id, CASE WHEN is_interpolated THEN 60 ELSE 95 END AS confidence FROM transcribed_lines")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of each line by where its box comes from."""
    return lines(spark, sf).select("line_id", geometry.confidence(F.col("is_interpolated")).alias("confidence")).distinct()


@query("""SELECT line_id, greatest(0, x0 - 4) AS x0, greatest(0, y0 - 4) AS y0, least(width, x1 + 4) AS x1, least(height, y1 + 4) AS y1
FROM (SELECT DISTINCT line_id, page_id, x0, y0, x1, y1 FROM transcribed_lines) JOIN (SELECT DISTINCT page_id, width, height FROM page_results) USING (page_id)
WHERE least(width, x1 + 4) - greatest(0, x0 - 4) >= 2 AND least(height, y1 + 4) - greatest(0, y0 - 4) >= 2""")
def line_crops(spark: SparkSession, sf: str) -> DataFrame:
    """The part of its page in which each line's words would be looked for."""
    p = table(spark, sf, "page_results", "page_id", "width", "height").distinct()
    c = lines(spark, sf).join(p, "page_id").select("line_id", geometry.crop(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height"))).alias("c"))
    return c.where("c is not null").select("line_id", "c.*")


@query("""SELECT page_id, CASE WHEN greatest(width, height) <= 1200 THEN width ELSE CAST(round_even(width * (1200::DOUBLE / greatest(width, height)), 0) AS INTEGER) END AS width,
CASE WHEN greatest(width, height) <= 1200 THEN height ELSE CAST(round_even(height * (1200::DOUBLE / greatest(width, height)), 0) AS INTEGER) END AS height
FROM (SELECT DISTINCT page_id, width, height FROM page_results)""")
def fitted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page sizes with the longer side brought down to 1200."""
    p = table(spark, sf, "page_results", "page_id", "width", "height").distinct()
    return p.select("page_id", geometry.fitted(F.col("width"), F.col("height"), 1200).alias("s")).select("page_id", "s.*")


_COLS = f"""{_BOXES}, g AS (SELECT *, CASE WHEN xmin - lag(xmin) OVER (PARTITION BY page_id ORDER BY xmin, det_idx, det_id) > 100 THEN 1 ELSE 0 END AS new FROM boxes),
cols AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY xmin, det_idx, det_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS col FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY page_id, col) AS nc FROM cols),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, col ORDER BY (ymax - ymin) * (xmax - xmin) DESC, xmin, det_idx, det_id) AS rn FROM n WHERE nc = 1 OR ymax > ymin),
k(page_id, col, i, kept) AS (
  SELECT DISTINCT page_id, col, CAST(0 AS BIGINT), CAST([] AS STRUCT(a INTEGER, b INTEGER, id BIGINT)[]) FROM o
  UNION ALL
  SELECT k.page_id, k.col, k.i + 1, CASE WHEN len(list_filter(k.kept, lambda x: 2 * (least(x.b, o.ymax) - greatest(x.a, o.ymin)) > least(x.b - x.a, o.ymax - o.ymin))) = 0
    THEN list_append(k.kept, {{'a': o.ymin, 'b': o.ymax, 'id': o.det_id}}) ELSE k.kept END
  FROM k JOIN o ON o.page_id = k.page_id AND o.col = k.col AND o.rn = k.i + 1),
kept AS (SELECT page_id, col, unnest(kept).id AS det_id FROM (SELECT page_id, col, arg_max(kept, i) AS kept FROM k GROUP BY 1, 2)),
b AS (SELECT o.* FROM o JOIN kept USING (page_id, col, det_id)),
m AS (SELECT page_id, col, count(*) AS c, list_sort(list(xmax - xmin))[count(*) // 2 + 1] AS w, list_sort(list(xmin))[count(*) // 2 + 1] AS l, list_sort(list(xmax))[count(*) // 2 + 1] AS x, list_sort(list(ymax - ymin))[count(*) // 2 + 1] AS h FROM b GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_COLS}
SELECT b.page_id, det_id, det_idx, ymin, CASE WHEN c >= 3 AND w > 0 AND x > l AND 2 * (xmax - xmin) < w THEN l ELSE xmin END AS xmin, CASE WHEN c >= 3 AND 10 * (ymax - ymin) > 13 * h THEN ymin + h ELSE ymax END AS ymax,
 CASE WHEN c >= 3 AND w > 0 AND x > l AND 2 * (xmax - xmin) < w THEN x ELSE xmax END AS xmax, b.col, CAST(row_number() OVER (PARTITION BY b.page_id ORDER BY b.col, ymin, rn) - 1 AS INTEGER) AS pos
FROM b JOIN m ON b.page_id = m.page_id AND b.col = m.col""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Detected boxes in reading order, without duplicates and put right."""
    from leafscan.operators import layout

    return layout.reading_order(layout.boxes_of(table(spark, sf, "line_boxes"))).drop("text")


# ---------------------------------------------------------------- scores by item


@query(f"""WITH {_SCORED}, words AS (SELECT line_id, unnest(rw) AS w, 1 AS a, 0 AS b FROM scored UNION ALL SELECT line_id, unnest(hw), 0, 1 FROM scored),
m AS (SELECT line_id, sum(least(a, b)) AS matched FROM (SELECT line_id, w, sum(a) AS a, sum(b) AS b FROM words GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT i.line_id, i.ref IS NULL AS no_ref, i.hyp IS NULL AS no_hyp, i.line_id % 5 = 4 AS spotting, CASE i.line_id % 4 WHEN 3 THEN true ELSE false END AS ceiling, s.n_words, s.n_chars, s.word_errors, s.char_errors, len(s.hw) AS n_hyp, coalesce(m.matched, 0) AS matched
  FROM items i LEFT JOIN scored s USING (line_id) LEFT JOIN m USING (line_id)),
r AS (SELECT *, no_ref OR no_hyp AS missing, CASE WHEN n_hyp = 0 THEN 0.0 ELSE CAST(matched AS DOUBLE) / n_hyp END AS p, CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(matched AS DOUBLE) / n_words END AS rc FROM d)
SELECT line_id, CASE WHEN no_ref THEN 'ground truth' WHEN no_hyp THEN 'hypothesis' END AS missing, spotting, ceiling,
 CASE WHEN NOT missing AND NOT spotting THEN CASE WHEN n_words = 0 THEN 0.0 ELSE round(CAST(word_errors AS DOUBLE) / n_words, 4) END END AS wer, CASE WHEN NOT missing AND NOT spotting THEN CASE WHEN n_chars = 0 THEN 0.0 ELSE round(CAST(char_errors AS DOUBLE) / n_chars, 4) END END AS cer,
 CASE WHEN NOT missing AND spotting THEN round(p, 4) END AS spot_precision, CASE WHEN NOT missing AND spotting THEN round(rc, 4) END AS spot_recall,
 CASE WHEN NOT missing AND spotting THEN CASE WHEN p + rc = 0 THEN 0.0 ELSE round(2 * p * rc / (p + rc), 4) END END AS spot_f1 FROM r""")
def score_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Every item by its route: what is missing, the ceiling, error rates, or precision, recall and F1. A fifth is scored by labels."""
    return _score_docs(spark, sf).select(
        F.col("id").alias("line_id"), "missing", "spotting", "ceiling", F.round("wer", 4).alias("wer"), F.round("cer", 4).alias("cer"), F.round("precision", 4).alias("spot_precision"), F.round("recall", 4).alias("spot_recall"), F.round("f1", 4).alias("spot_f1")
    )


def _score_docs(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf)
    mode = F.when(F.col("line_id") % 5 == 4, "spotting").otherwise("sequential")
    difficulty = F.when(F.col("line_id") % 4 == 3, "ceiling").otherwise("medium")
    return report.score(i.select(F.col("line_id").alias("id"), mode.alias("mode"), F.col("content_type").alias("type"), difficulty.alias("difficulty"), F.col("difficulty").alias("era"), "ref", "hyp"))


@query()
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    """The text report of all items, by part and key; held against its own parts in the tests."""
    return report.report_lines(_score_docs(spark, sf))


@query("""SELECT line_id FROM (SELECT DISTINCT line_id, page_id, line_no FROM transcribed_lines) l WHERE NOT EXISTS (SELECT 1 FROM line_boxes b WHERE b.page_id = l.page_id AND b.det_idx = l.line_no)""")
def refresh_todo(spark: SparkSession, sf: str) -> DataFrame:
    """Items without a hypothesis yet."""
    todo = table(spark, sf, "transcribed_lines", "line_id", "page_id", "line_no").distinct()
    held = table(spark, sf, "line_boxes", "page_id", F.col("det_idx").alias("line_no"))
    return batch.missing_from(todo, held, ["page_id", "line_no"]).select("line_id")


# ---------------------------------------------------------------- texts shown


_BYTES = "SELECT DISTINCT call_id, CAST(coalesce(prompt_token_count, 0) AS BIGINT) * (1 + call_id % 7) * CASE call_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 3000000 END AS n FROM call_usage"


def _size_sql(k: int, js: bool) -> str:
    v, u = f"(n / {1024**k}.0::DOUBLE)", display.UNITS[k]
    if js:
        return f"CASE WHEN {v} < 10 THEN printf('%.1f {u}', floor({v} * 10 + 0.5) / 10.0) ELSE printf('%d {u}', CAST(floor({v} + 0.5) AS BIGINT)) END"
    return f"printf('%.1f {u}', round_even({v} * 10, 0) / 10)"


def _sizes_sql(js: bool) -> str:
    whens = " ".join(f"WHEN n / {1024**k}.0::DOUBLE < 1024 THEN {_size_sql(k, js)}" for k in (1, 2, 3))
    return f"CASE WHEN n < 1024 THEN printf('%d B', n) {whens} ELSE {_size_sql(4, js)} END"


@query(f"SELECT call_id, {_sizes_sql(False)} AS stored, {_sizes_sql(True)} AS sent FROM ({_BYTES})")
def size_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes in bytes as text, as a service and as its page show them."""
    k = F.col("call_id")
    unit = F.when(k % 4 == 0, 1).when(k % 4 == 1, 1024).when(k % 4 == 2, 1048576).otherwise(3000000)
    c = table(spark, sf, "call_usage", "call_id", "prompt_token_count").distinct()
    c = c.select("call_id", (F.coalesce("prompt_token_count", F.lit(0)).cast("long") * (1 + k % 7) * unit).alias("n")).distinct()
    return c.select("call_id", display.byte_size(F.col("n")).alias("stored"), display.upload_size(F.col("n")).alias("sent"))


_COST_TEXT = "CASE WHEN {c} IS NULL THEN '' WHEN {c} < 1 THEN printf('%.1f', floor({c} * 100 * 10 + 0.5) / 10.0) || '¢' ELSE printf('$%.2f', floor({c} * 100 + 0.5) / 100.0) END"
_TIER = "threshold <> 0 AND calls <> 0 AND input / calls > threshold"


@query(f"""WITH {_COUNTED}, {_PRICES}, u AS (SELECT file_id, model, {_SUMS} FROM counted GROUP BY file_id, model),
r AS (SELECT u.*, CASE WHEN {_TIER} THEN high_in ELSE price_in END AS ri, CASE WHEN {_TIER} THEN high_out ELSE price_out END AS ro FROM u LEFT JOIN prices USING (model)),
c AS (SELECT *, round(input / 1e6 * ri + (output + thinking) / 1e6 * ro, 8) AS cost FROM r)
SELECT file_id, model, {_COST_TEXT.format(c='cost')} AS cost, printf('$%.2f/1M input and $%.2f/1M output', coalesce(ri, 0.0), coalesce(ro, 0.0)) AS basis,
 format('{{:,}}', total) || ' tokens · ' || format('{{:,}}', input) || ' in / ' || format('{{:,}}', output) || ' out' || CASE WHEN thinking <> 0 THEN ' (incl. ' || format('{{:,}}', thinking) || ' thinking)' ELSE '' END
 || ' · ' || format('{{:,}}', calls) || CASE WHEN calls = 1 THEN ' API call' ELSE ' API calls' END AS summary FROM c""")
def usage_texts(spark: SparkSession, sf: str) -> DataFrame:
    u = usage.cost(usage.usage(table(spark, sf, "call_usage"), "file_id", "model"), usage.price_catalog(spark))
    c = F.col
    return u.select("file_id", "model", display.cost_text(c("cost")).alias("cost"), display.price_text(c("rate_in"), c("rate_out")).alias("basis"), display.token_summary(c("total"), c("input"), c("output"), c("thinking"), c("calls")).alias("summary"))


@query("""SELECT DISTINCT event_id, CASE WHEN code BETWEEN 200 AND 399 THEN 'ok' WHEN code BETWEEN 400 AND 499 THEN 'warn' WHEN code >= 500 THEN 'err' ELSE '' END AS class FROM (SELECT event_id, 100 + event_id % 500 AS code FROM events)""")
def status_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id").distinct().select("event_id", display.status_class(100 + F.col("event_id") % 500).alias("class"))


@query("""SELECT job_id, CASE WHEN content_type = 'text' THEN 'text' ELSE (CASE WHEN content_type = 'mixed' OR coalesce(content_type, '') = '' THEN 'handwriting' ELSE content_type END) || '/' || mode || CASE WHEN content_type = 'mixed' OR job_id % 3 = 0 THEN '+wordboxes' ELSE '' END END AS label
FROM (SELECT DISTINCT job_id, content_type, mode FROM job_settings)""")
def mode_labels(spark: SparkSession, sf: str) -> DataFrame:
    """How each job reads its pages; a third of the jobs also refine words."""
    j = table(spark, sf, "job_settings", "job_id", "content_type", "mode").distinct()
    return j.select("job_id", display.mode_label(F.col("content_type"), F.col("mode"), F.col("job_id") % 3 == 0).alias("label"))


@query("""SELECT file_id, CASE file_id % 4 WHEN 0 THEN ['txt', 'hocr', 'alto', 'pdf'] WHEN 1 THEN ['txt', 'pdf'] WHEN 2 THEN ['hocr'] ELSE ['txt', 'hocr', 'alto', 'pdf'] END AS kinds FROM (SELECT DISTINCT file_id FROM file_results)""")
def output_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of output a run writes for what is asked: nothing, some, some with others, or only unknown ones."""
    k = F.col("file_id") % 4
    asked = F.when(k == 1, F.array(F.lit("pdf"), F.lit("txt"))).when(k == 2, F.array(F.lit("hocr"), F.lit("png"))).when(k == 3, F.array(F.lit("docx")))
    return table(spark, sf, "file_results", "file_id").distinct().select("file_id", display.wanted_outputs(asked).alias("kinds"))


@query("""WITH {p}, g AS (SELECT DISTINCT file_id, error FROM file_results) SELECT file_id, CASE
 WHEN code IN (401, 403) OR regexp_matches(m, '{auth}') THEN 'auth' WHEN code = 404 OR regexp_matches(m, '{gone}') THEN 'gone' WHEN code IN (408, 429, 500, 502, 503, 504) OR regexp_matches(m, '{again}') THEN 'transient' ELSE 'other' END AS kind,
 CASE WHEN short = '' THEN 'error' ELSE short END AS short
FROM (SELECT *, left(trim(concat_ws(' ', CAST(code AS VARCHAR), trim(split_part(coalesce(error, ''), '{{', 1)))), 140) AS short, upper(coalesce(error, '')) AS m
 FROM (SELECT file_id, error, CASE file_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 501 WHEN 4 THEN 200 END AS code FROM g))""".format(p=_PRICES, auth="|".join(usage.AUTH), gone="|".join(usage.GONE), again="|".join(usage.AGAIN)))
def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of failure a file's error is, with and without a status code, and the error in short."""
    k = F.col("file_id") % 9
    code = F.when(k == 0, 401).when(k == 1, 404).when(k == 2, 503).when(k == 3, 501).when(k == 4, 200)
    f = table(spark, sf, "file_results", "file_id", "error").distinct().withColumn("code", code)
    return f.select("file_id", usage.error_class(F.col("code"), F.col("error")).alias("kind"), usage.short_error(F.col("code"), F.col("error")).alias("short"))


@query(r"""SELECT page_id, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(t, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')) END AS n_lines FROM (SELECT DISTINCT page_id, plain_text AS t FROM page_results) WHERE t IS NOT NULL""")
def text_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "page_results", "page_id", "plain_text").distinct().where("plain_text is not null")
    return p.select("page_id", F.size(formats.text_lines(F.col("plain_text"))).alias("n_lines"))


@query(r"""SELECT file_id, regexp_replace(regexp_extract(source_name, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM (SELECT DISTINCT file_id, source_name FROM file_results)""")
def file_stems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_results", "file_id", "source_name").distinct().select("file_id", formats.stem(F.col("source_name")).alias("stem"))


# ---------------------------------------------------------------- jobs


@query("""WITH f AS (SELECT DISTINCT file_id, job_id, error FROM file_results), g AS (SELECT job_id, count(*) AS files, count_if(error IS NULL) AS completed, count_if(error IS NOT NULL) AS failed FROM f GROUP BY 1),
s AS (SELECT *, CASE WHEN completed = 0 THEN 'error' WHEN job_id % 5 = 0 THEN 'running' WHEN job_id % 7 = 0 THEN 'stopped' WHEN job_id % 3 = 0 THEN 'cancelled' ELSE 'done' END AS status FROM g)
SELECT job_id, files, completed, failed, status, CASE WHEN status = 'done' THEN 100 ELSE CAST(floor(CAST(completed AS DOUBLE) / files * 100 + 0.5) AS INTEGER) END AS done_percent FROM s""")
def job_status(spark: SparkSession, sf: str) -> DataFrame:
    """State of each job and how far it came; some are taken as running, stopped or cancelled."""
    f = table(spark, sf, "file_results", "file_id", "job_id", "error").distinct()
    g = f.groupBy("job_id").agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    j = F.col("job_id")
    g = g.withColumn("status", batch.final_status(j % 7 == 0, j % 3 == 0, F.col("completed") == 0, j % 5 == 0))
    return g.withColumn("done_percent", usage.percent(F.col("completed"), F.col("files"), F.col("status")))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT job_id, file_id, coalesce(n_pages, 0) * 9000000 AS size FROM file_results), o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY file_id) AS rn FROM f),
b(job_id, rn, file_id, batch, n, bytes) AS (SELECT job_id, rn, file_id, 0, 1, CAST(size AS BIGINT) FROM o WHERE rn = 1
 UNION ALL SELECT o.job_id, o.rn, o.file_id, CASE WHEN b.n >= 20 OR b.bytes + o.size > 268435456 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 20 OR b.bytes + o.size > 268435456 THEN 1 ELSE b.n + 1 END,
 CAST(CASE WHEN b.n >= 20 OR b.bytes + o.size > 268435456 THEN o.size ELSE b.bytes + o.size END AS BIGINT) FROM b JOIN o ON o.job_id = b.job_id AND o.rn = b.rn + 1)
SELECT job_id, file_id, batch FROM b""")
def upload_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each job in upload batches, at 9 MB a page."""
    f = table(spark, sf, "file_results", "job_id", "file_id", "n_pages").distinct()
    return batch.upload_batches(f.withColumn("size", F.coalesce("n_pages", F.lit(0)) * 9_000_000), "job_id", "file_id", "size")


@query("""SELECT DISTINCT f.file_id, f.source_name FROM file_results f JOIN (SELECT DISTINCT file_id FROM page_results WHERE page_no > 3) USING (file_id)""")
def asked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are asked for (here those with more than three pages)."""
    asked = table(spark, sf, "page_results", "file_id", "page_no").where("page_no > 3")
    return batch.asked_for(table(spark, sf, "file_results", "file_id", "source_name").distinct(), asked, "file_id")


@query("""WITH c AS (SELECT DISTINCT call_id, file_id FROM call_usage), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY call_id DESC) AS rn, count(*) OVER (PARTITION BY file_id) AS total FROM c)
SELECT call_id, file_id, total - rn AS at FROM r WHERE rn <= 500 AND total - rn >= CASE WHEN total < file_id % 9 THEN 0 ELSE file_id % 9 END""")
def new_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each file's log that a reader who has seen some of them lacks."""
    log = usage.log_tail(table(spark, sf, "call_usage", "call_id", "file_id").distinct(), "file_id", "call_id")
    return batch.new_log_lines(log, "total", "at", F.col("file_id") % 9).select("call_id", "file_id", "at")


@query("""SELECT file_id, page_id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_no, page_id) AS r FROM (SELECT DISTINCT file_id, page_id, page_no FROM page_results)) WHERE r <= 2""")
def first_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first two pages of each file: the operator that limits what is read of a file."""
    p = table(spark, sf, "page_results", "file_id", "page_id", "page_no").distinct()
    key = F.struct("page_no", "page_id")
    return batch.first_pages(p.withColumn("k", key), "file_id", "k", 2).select("file_id", "page_id", "page_no")


@query("""SELECT f.file_id, count(p.page_id) AS pages, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines FROM (SELECT DISTINCT file_id FROM file_results) f
LEFT JOIN (SELECT DISTINCT page_id, file_id FROM page_results) p ON f.file_id = p.file_id LEFT JOIN (SELECT page_id, count(DISTINCT line_id) AS n FROM transcribed_lines GROUP BY 1) l ON p.page_id = l.page_id GROUP BY 1""")
def file_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and lines of each file, counted."""
    n = table(spark, sf, "transcribed_lines", "page_id", "line_id").distinct().groupBy("page_id").agg(F.count("*").alias("n"))
    p = table(spark, sf, "page_results", "page_id", "file_id").distinct().join(n, "page_id", "left")
    p = p.groupBy("file_id").agg(F.count("*").alias("pages"), F.sum("n").alias("lines"))  # added up by file before the files are joined
    f = table(spark, sf, "file_results", "file_id").distinct().join(p, "file_id", "left")
    return f.select("file_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))


@query("""WITH f AS (SELECT DISTINCT file_id, job_id, n_pages, error, txt_name FROM file_results), t AS (SELECT file_id, CAST(sum(length(plain_text)) AS BIGINT) AS size FROM (SELECT DISTINCT page_id, file_id, plain_text FROM page_results) GROUP BY 1)
SELECT job_id, CASE WHEN count_if(n_pages IS NULL) = 0 THEN CAST(sum(n_pages) AS BIGINT) END AS staged_pages, CAST(coalesce(sum(size), 0) AS BIGINT) AS size, CAST(floor(coalesce(sum(size), 0) * 1.02::DOUBLE) AS BIGINT) + 8388608 AS room, bool_or(error IS NOT NULL) AS any_failed
FROM f LEFT JOIN t USING (file_id) GROUP BY job_id""")
def job_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Of each job: its pages if all are known, the size of its texts, the room an archive needs, and whether any file failed."""
    t = table(spark, sf, "page_results", "page_id", "file_id", "plain_text").distinct().groupBy("file_id").agg(F.sum(F.length("plain_text")).alias("size"))
    f = table(spark, sf, "file_results", "file_id", "job_id", "n_pages", "error", "txt_name").distinct().join(t, "file_id", "left")
    size = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    return f.groupBy("job_id").agg(batch.all_known_total(F.col("n_pages")).alias("staged_pages"), size.alias("size"), batch.room_needed(size).alias("room"), F.bool_or(F.col("error").isNotNull()).alias("any_failed"))


@query("""WITH n AS (SELECT DISTINCT file_id, unnest([txt_name, hocr_name, alto_name, pdf_name]) AS name FROM file_results) SELECT file_id, name FROM n WHERE name LIKE '%.hocr' OR name LIKE '%.txt'""")
def download_names(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs that go into an archive of text and hOCR."""
    f = table(spark, sf, "file_results", "file_id", "txt_name", "hocr_name", "alto_name", "pdf_name").distinct()
    return batch.downloads(f.select("file_id", F.explode(F.array("txt_name", "hocr_name", "alto_name", "pdf_name")).alias("name")).distinct(), "name", ("txt", "hocr", "png"))


@query("""SELECT DISTINCT unnest(string_split(tesseract_language, '+')) AS code FROM job_settings WHERE tesseract_language IS NOT NULL ORDER BY 1""")
def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct parts of all jobs' language labels, sorted."""
    j = table(spark, sf, "job_settings", "tesseract_language").where("tesseract_language is not null").distinct()
    return j.select(F.explode(F.split("tesseract_language", r"\+")).alias("code")).distinct().orderBy("code")


@query("""SELECT job_id, CASE WHEN len(live) > 0 THEN live ELSE every_ END AS models FROM (SELECT *, list_filter(every_, lambda m: m <> 'scribe-pro') AS live FROM (
 SELECT job_id, CASE model WHEN 'scribe-pro' THEN ['scribe-pro', 'scribe-flash'] WHEN 'scribe-flash' THEN ['scribe-flash', 'scribe-pro'] ELSE [model, 'scribe-pro', 'scribe-flash'] END AS every_
 FROM (SELECT DISTINCT job_id, coalesce(transcription_model, 'none') AS model FROM job_settings)))""")
def model_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Models to try for each job if one is known to be gone."""
    j = table(spark, sf, "job_settings", "job_id", F.coalesce("transcription_model", F.lit("none")).alias("model")).distinct()
    stable = F.array(*map(F.lit, provider.STABLE))
    return j.select("job_id", display.candidates(F.col("model"), stable, F.array(F.lit("scribe-pro"))).alias("models"))


_MOCK = ", ".join(f"({k}, '{t}', {b[0]}, {b[1]}, {b[2]}, {b[3]})" for k, (t, b) in enumerate(provider.Mock().boxes()))


@query(f"""WITH p AS (SELECT DISTINCT page_id, file_id, width, height FROM page_results), j AS (SELECT DISTINCT f.file_id, CASE WHEN s.content_type = 'text' THEN 'text' ELSE s.mode END AS mode FROM file_results f JOIN job_settings s USING (job_id)),
m(line_no, text, a, b, c, d) AS (VALUES {_MOCK})
SELECT page_id, line_no, text, {_side('width', 'b')} AS x0, {_side('height', 'a')} AS y0, {_side('width', 'd')} AS x1, {_side('height', 'c')} AS y1, 95 AS confidence FROM p JOIN j USING (file_id), m WHERE mode <> 'text'""")
def provider_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every page through the mock provider in its job's mode, with boxes in pixels and confidences."""
    j = table(spark, sf, "job_settings", "job_id", "content_type", "mode", "transcription_model").distinct()
    f = table(spark, sf, "file_results", "file_id", "job_id").distinct().join(j, "job_id").select("file_id", "transcription_model", F.when(F.col("content_type") == "text", "text").otherwise(F.col("mode")).alias("mode"))
    p = table(spark, sf, "page_results", "page_id", "file_id", "width", "height").distinct().join(f, "file_id")
    read = provider.transcribe(p.select("page_id", F.lit(None).cast("binary").alias("image"), F.col("transcription_model").alias("model"), "mode"), provider.Mock()).where("error is null")
    px = read.join(p.select("page_id", "width", "height"), "page_id").withColumn("b", geometry.to_pixels(F.col("box_2d"), F.col("width"), F.col("height")))
    return px.select("page_id", "line_no", "text", "b.*", geometry.confidence(F.col("is_interpolated")).alias("confidence"))

"""Problem 3: texts cut short, by word trigrams that go on inside texts but hardly ever end one.

The statistics are counted over all lines and, apart from these, over all words of the pages' texts. A text is suspected if its last
three words (the last one perhaps only begun; a page's may stand on two lines) go on elsewhere more often than they end there;
suspects are then held against the lines of their own page, exactly and, where none begins like the text, by edit distance.
Where the page has no such line, the trigrams decide alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.lookalike import mapped
from leafscan.llm.noise import skeleton
from leafscan.session import table, written

#: A last trigram is suspect if at most this share of its occurrences ends there.
TERMINAL_SHARE = 0.75

#: A line is a text's own if at most this share of the text's signs differ (none of fewer than five), and a text without its line is a
#: case if its last trigram breaks a word off, never ends and goes on at least so often.
NEAR, BROKEN_TIMES = 0.2, 3

#: Signs that are put where a text was cut. Fixed values.
MARK = r"\\s*(\\x{2026}|\\.\\.\\.|\\[\\.\\.\\.\\]|\\[\\x{2026}\\]|\\(\\.\\.\\.\\)|\\(\\x{2026}\\)|\\x{FFFD}+)\\s*$"

#: What a text with such a sign ends with at least: looked for first, as it is found faster.
MAY_MARK = r"[\\x{2026}.\\])\\x{FFFD}]\\s*$"

#: Signs of a last word by which it is matched with the words it may begin; shorter ones are matched by sums over their beginnings.
HEAD = 3

_COUNT = """
SELECT g.`0` AS w1, g.`1` AS w2, g.`2` AS w3, left(g.`2`, {head}) AS h,
       count_if(NOT page) AS n, count_if(NOT page AND pos = size(p) - 3) AS ended, count_if(page) AS among, count_if(page AND pos = size(p) - 3) AS final
FROM (SELECT page, concat(array('', ''), split(trim(text), '\\\\s+')) AS p FROM {texts} WHERE trim(text) <> '')
LATERAL VIEW posexplode(arrays_zip(slice(p, 1, size(p) - 2), slice(p, 2, size(p) - 2), slice(p, 3, size(p) - 2))) AS pos, g
GROUP BY 1, 2, 3
"""

_FINAL = """
SELECT *, p[size(p) - 3] AS w1, p[size(p) - 2] AS w2, p[size(p) - 1] AS w3
FROM (SELECT *, concat(array('', ''), split(trim({end}), '\\\\s+')) AS p FROM {texts} WHERE trim({end}) <> '')
"""

# n: occurrences of the last words, the last one perhaps only begun; own: with the last one as it stands; ended: of these, at an end.
# among, final: the same as n and ended in the texts of pages.
_MET_LONG = """
SELECT f.w1, f.w2, f.w3, sum(t.n) AS n, sum(if(t.w3 = f.w3, t.n, 0)) AS own, sum(if(t.w3 = f.w3, t.ended, 0)) AS ended,
       sum(t.among) AS among, sum(if(t.w3 = f.w3, t.final, 0)) AS final
FROM {f} f JOIN {counts} t ON f.w1 = t.w1 AND f.w2 = t.w2 AND left(f.w3, {head}) = t.h AND startswith(t.w3, f.w3)
WHERE length(f.w3) >= {head} GROUP BY f.w1, f.w2, f.w3
"""
_MET_SHORT = """
SELECT f.w1, f.w2, f.w3, s.n, s.own, s.ended, s.among, s.final
FROM (SELECT * FROM {f} WHERE length(w3) < {head}) f JOIN (
  SELECT w1, w2, b, sum(n) AS n, sum(if(w3 = b, n, 0)) AS own, sum(if(w3 = b, ended, 0)) AS ended, sum(among) AS among, sum(if(w3 = b, final, 0)) AS final
  FROM (SELECT t.* FROM {counts} t LEFT SEMI JOIN (SELECT DISTINCT w1, w2 FROM {f} WHERE length(w3) < {head}) k ON t.w1 = k.w1 AND t.w2 = k.w2)
  LATERAL VIEW explode(array_distinct(transform(sequence(1, {head} - 1), k -> left(w3, k)))) AS b
  GROUP BY w1, w2, b
) s ON f.w1 = s.w1 AND f.w2 = s.w2 AND f.w3 = s.b
"""


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(w1, w2, w3, h, n, ended, among, final) over column text: how often three words stand together, and how often they end a text;
    n and ended count lines, among and final what has a true column page.

    Two empty words stand before each text, so shorter texts count too. Null and blank texts count nothing.
    """
    texts = texts if "page" in texts.columns else texts.withColumn("page", F.lit(False))
    return texts.sparkSession.sql(_COUNT.replace("{head}", str(HEAD)), texts=texts)


def finals(texts: DataFrame) -> DataFrame:
    """texts with the last three words of column body, or of column tail where there is one, in w1, w2, w3; rows without words are left out.

    Columns that are already called w1, w2, w3 or p are replaced.
    """
    end = "coalesce(tail, body)" if "tail" in texts.columns else "body"
    return texts.sparkSession.sql(_FINAL.replace("{end}", end), texts=texts.drop("w1", "w2", "w3", "p")).drop("p")


def met(last: DataFrame, counts: DataFrame) -> DataFrame:
    """(w1, w2, w3, n, own, ended, among, final) of the last trigrams in last that counts knows, each once. No key is joined on fewer than HEAD signs
    of its last word, so lines' first words, which all have two empty words before them, are no hot key."""
    spark = last.sparkSession
    f = written(last.select("w1", "w2", "w3").distinct())  # narrow, so that Spark sees how small it is
    return spark.sql(_MET_LONG.replace("{head}", str(HEAD)), f=f, counts=counts).unionByName(spark.sql(_MET_SHORT.replace("{head}", str(HEAD)), f=f, counts=counts))


def suspects(texts: DataFrame, counts: DataFrame, share: float = TERMINAL_SHARE) -> DataFrame:
    """Rows of texts (with a column body) whose last trigram goes on in counts but (almost) never ends there.

    Rows with a null or blank body are never suspect; repeated rows and all columns are kept.
    """
    last = finals(texts)
    bad = met(last, counts).where(f"n > ended AND ended <= {float(share)} * n")
    return last.join(bad, ["w1", "w2", "w3"], "left_semi").drop("w1", "w2", "w3")


# The page check: a cut text's own line goes on after it. One join of all texts with the lines of their page;
# grouped by what it is partitioned on, so without another shuffle; sorted and merged at every size, as lines grow with the texts. k is the number of a page's last line.
_GOES_ON = """
SELECT /*+ MERGE(l) */ s.page_id, s.c, s.rec, s.rec_id, s.body, s.tail, s.marked, s.k, s.n_lines,
       coalesce(max(rtrim(l.text) = rtrim(s.body) OR l.text = s.text), false) AS whole,
       max(if(length(rtrim(l.text)) > length(s.body), substr(l.text, length(s.body) + 1), NULL)) AS rest, count(l.text) = 0 AS alone
FROM {texts} s
LEFT JOIN {lines} l ON s.page_id = l.page_id AND s.c = l.c AND startswith(l.text, s.body) AND (s.k IS NULL OR l.line_no = s.k - 1)
GROUP BY s.page_id, s.c, s.rec, s.rec_id, s.body, s.tail, s.marked, s.k, s.n_lines
HAVING s.rec = 'page' AND s.n_lines > s.k OR (trim(rest) <> '' OR marked AND rest IS NULL) AND NOT whole OR alone
"""

# Left, so that a text without any line or other box stays.
_SIDES = """
SELECT /*+ MERGE(l) */ s.rec, s.rec_id, s.body, s.tail, s.marked, l.t, l.other_id IS NULL AS is_line
FROM {texts} s
LEFT JOIN {sides} l ON s.page_id = l.page_id AND if(l.other_id IS NULL, s.k IS NULL OR l.line_no = s.k - 1, s.rec = 'box' AND l.other_id <> s.rec_id)
"""

# Texts that no line begins with, beside the lines of their page (of a page's text, the one at its place) and its other boxes,
# all as skeletons: how far the text is from the line's beginning, from the whole line and from its end; null if too far.
_BESIDE = """
SELECT rec, rec_id, body, tail, marked, if(is_line, substr(t, length(s) + 1), NULL) AS rest, if(is_line, NULL, t) AS other,
       if(is_line, nullif(levenshtein(s, left(t, length(s)), most), -1), NULL) AS begins,
       if(is_line, nullif(levenshtein(s, t, most + 1), -1), NULL) AS whole,
       if(is_line, nullif(levenshtein(s, right(t, length(s)), most), -1), NULL) AS ends
FROM (SELECT *, cast({near} * length(s) AS int) AS most FROM {pairs})
"""

# A text goes on if it is nearest to the beginning of a line of which two more signs follow at least, and these are in no other box.
_NEAREST = """
SELECT rec, rec_id, body, tail, marked, known,
       coalesce(first.d + 1 < whole, first.d IS NOT NULL) AND coalesce(first.d < ends, true) AND length(trim(first.rest)) > 1
       AND NOT exists(others, x -> startswith(trim(first.rest), x) OR levenshtein(trim(first.rest), x, 4) >= 0) AS goes_on
FROM (SELECT rec, rec_id, body, tail, marked, min(if(begins IS NOT NULL, struct(begins AS d, rest), NULL)) AS first, min(whole) AS whole, min(ends) AS ends,
             bool_or(coalesce(begins, whole, ends) IS NOT NULL) AS known, collect_list(nullif(trim(other), '')) AS others
      FROM {beside} GROUP BY rec, rec_id, body, tail, marked)
"""

# A box that ends with a word, whose line's rest is in another box of the page, is half of a line.
_HALVES = """
SELECT DISTINCT c.rec_id
FROM (SELECT *, left(trim(rest), 1) AS next FROM {cut}
      WHERE rec = 'box' AND NOT marked AND NOT endswith(body, ' ')
        AND NOT (rlike(right(body, 1), '[\\\\p{{L}}\\\\p{{N}}]') AND rlike(left(rest, 1), '[\\\\p{{L}}\\\\p{{N}}]'))) c
JOIN {boxes} b ON c.page_id = b.page_id AND c.next = b.c AND b.rec_id <> c.rec_id
WHERE startswith(trim(c.rest), trim(b.body)) OR
      (abs(length(trim(c.rest)) - length(b.text)) <= 3 AND levenshtein(lower(trim(c.rest)), lower(b.text), 4) >= 0)
"""


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, boxes, pages) with look-alike signs mapped and marks of a cut taken off; of a page its last line as body, its last
    three lines, which have its last words, as tail and all of it as said. A mark on a line of its own is no line."""
    same = mapped(F.col("text"))
    first = F.left("text", F.lit(1)).alias("c")
    lines = table(spark, sf_dir, "transcribed_lines", "page_id", "line_no", "text").select("page_id", "line_no", same.alias("text"))
    lines = written(lines.select("*", first))
    unmarked = lambda c: F.expr(f"if(rlike({c}, '{MAY_MARK}'), regexp_replace({c}, '{MARK}', ''), {c})")
    boxes = table(spark, sf_dir, "line_boxes").select(F.col("det_id").alias("rec_id"), "page_id", same.alias("text"))
    boxes = boxes.select(
        F.lit("box").alias("rec"), "rec_id", "page_id", "text", unmarked("text").alias("body"), F.lit(None).cast("string").alias("tail"),
        F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("n_lines"),
    )
    # Lines of a page are near each other in the table, so this aggregate is small before its shuffle.
    seen = lines.groupBy("page_id").agg((F.max("line_no") + 1).alias("seen"))
    pages = table(spark, sf_dir, "page_results", "page_id", "n_lines", "plain_text").dropDuplicates(["page_id"])
    said = F.array_join(F.filter(F.split("plain_text", r"\n"), lambda x: F.trim(x) != ""), "\n")
    pages = pages.join(seen, "page_id", "left").select("page_id", F.greatest("n_lines", "seen").alias("n_lines"), said.alias("said"))
    pages = pages.select("page_id", "n_lines", mapped(F.col("said")).alias("said")).withColumn("ls", F.split("said", r"\n"))
    pages = pages.withColumn("text", F.element_at("ls", -1)).withColumn("body", unmarked("text"))
    pages = pages.selectExpr(
        "page_id", "n_lines", "text", "body", "if(body = '', slice(ls, 1, size(ls) - 1), ls) AS ls",
        "rtrim('\n', left(said, length(said) - length(text) + length(body))) AS said",
    )
    pages = pages.select(
        F.lit("page").alias("rec"), F.col("page_id").alias("rec_id"), "page_id", "text", F.expr("if(body = '', try_element_at(ls, -1), body)").alias("body"),
        F.expr("trim(array_join(concat(slice(ls, greatest(size(ls) - 2, 1), greatest(least(size(ls), 3) - 1, 0)), array(if(body = '', try_element_at(ls, -1), body))), ' '))").alias("tail"),
        F.size("ls").alias("k"), "n_lines", "said", F.expr("body <> text").alias("marked"),
    )

    def full(df: DataFrame) -> DataFrame:
        return written(df.where("body <> '' AND page_id IS NOT NULL AND rec_id IS NOT NULL").withColumn("c", F.left("body", F.lit(1))))

    return lines, full(boxes.withColumn("marked", F.expr("body <> text"))), full(pages)


def beside(texts: DataFrame, lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Texts that no line of their page begins with exactly, held against the page's lines and other boxes by edit distance:
    rec, rec_id, body, marked, known (is any line like it?), goes_on. A text of a page without any line or other box is known by none."""
    spark = texts.sparkSession
    sides = lines.select("page_id", F.rtrim("text").alias("t"), "line_no", F.lit(None).cast("long").alias("other_id")).where("t <> ''")
    sides = sides.unionByName(boxes.select("page_id", F.col("body").alias("t"), F.lit(None).cast("int").alias("line_no"), F.col("rec_id").alias("other_id")))
    texts = texts.select("page_id", "rec", "rec_id", "body", "tail", "marked", "k")
    pairs = spark.sql(_SIDES, texts=texts, sides=sides)
    pairs = pairs.select("rec", "rec_id", "body", "tail", "marked", skeleton(F.col("body")).alias("s"), skeleton(F.col("t")).alias("t"), "is_line")
    held = spark.sql(_BESIDE.replace("{near}", str(NEAR)), pairs=pairs)
    return spark.sql(_NEAREST, beside=held)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, rec_id) of every cut page and box; rows with null ids, null or empty texts are never cut; copies count once.

    A text is a case if its last trigram is suspect and the page check agrees that it goes on. Where no line begins with the text, the
    nearest line tells if it goes on, unless the trigrams know its end as one; where none is like it, a last trigram that breaks a
    word off is a case, and so is a mark of a cut."""
    lines, boxes, pages = _texts(spark, sf_dir)
    checked = written(spark.sql(_GOES_ON, texts=boxes.unionByName(pages.drop("said")), lines=lines))
    cut = checked.where("n_lines > k OR NOT alone OR marked")
    halves = spark.sql(_HALVES, cut=cut, boxes=boxes)
    exact = cut.join(halves.withColumn("rec", F.lit("box")), ["rec", "rec_id"], "left_anti")
    near = beside(checked.where("alone AND coalesce(n_lines <= k, true)"), lines, boxes)
    no = F.lit(None).cast("boolean")
    every = exact.select("rec", "rec_id", "body", "tail", "marked", F.lit(True).alias("exact"), no.alias("known"), no.alias("goes_on"))
    every = written(finals(every.unionByName(near.select("rec", "rec_id", "body", "tail", "marked", F.lit(False).alias("exact"), "known", "goes_on"))))
    counts = trigram_counts(lines.select("text", F.lit(False).alias("page")).unionByName(pages.select(F.col("said").alias("text"), F.lit(True).alias("page"))))
    judged = every.join(met(every, counts), ["w1", "w2", "w3"], "left").fillna(0, ["n", "own", "ended", "among", "final"])
    share = float(TERMINAL_SHARE)
    boxed = f"exact AND rec = 'box' AND n > ended AND ended <= {share} * n"
    paged = f"exact AND rec = 'page' AND final - 1 <= {share} * (n + among - 1)"  # its own end doesn't count
    apart = f"NOT exact AND (goes_on OR NOT known AND (n >= {BROKEN_TIMES} AND own = 0 OR marked)) AND ended <= {share} * n"
    return judged.where(f"{boxed} OR {paged} OR {apart}").select("rec", "rec_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: pages and boxes with text, how many are cut, and the share. A page's null source is its series'."""
    series = table(spark, sf_dir, "archive_series").select("series_id", F.col("source").alias("series_source")).distinct()
    pages = table(spark, sf_dir, "page_results").where("plain_text <> ''").select("page_id", "series_id", "source").distinct()
    pages = pages.join(F.broadcast(series), "series_id", "left")  # archive_series is fixed: 400 rows
    pages = pages.select("page_id", F.coalesce("source", "series_source").alias("source")).distinct()
    boxes = table(spark, sf_dir, "line_boxes").where("text <> ''").select(F.col("det_id").alias("rec_id"), "page_id").distinct()
    boxes = boxes.join(pages, "page_id").select(F.lit("box").alias("rec"), "rec_id", "source")
    every = pages.select(F.lit("page").alias("rec"), F.col("page_id").alias("rec_id"), "source").unionByName(boxes)
    cut = found(spark, sf_dir).withColumn("cut", F.lit(1))
    n_cut = F.sum(F.coalesce("cut", F.lit(0)))
    return (
        every.join(cut, ["rec", "rec_id"], "left")
        .groupBy("source", "rec")
        .agg(F.count("*").alias("texts"), n_cut.alias("cut"), F.round(n_cut / F.count("*"), 6).alias("share"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_rates": p3_rates}
ORACLE: dict[str, str] = {}

"""Readers and writers: manifest and text files, model answers, OCR word tables, hOCR and ALTO, plain text, JSON."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MANIFEST = "id string, image string, type string, subtype string, era string, difficulty string, mode string, source string"
LINE_BOXES = "array<struct<text:string,box_2d:array<int>>>"
#: Supported page image extensions.
EXTENSIONS = ("tif", "tiff", "jpg", "jpeg", "png", "gif", "pdf")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV, all strings; rows with a blank id are dropped; no file gives an empty table."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.csv(path, header=True, schema=MANIFEST).where("trim(id) <> ''")


def read_texts(spark: SparkSession, folder: str, tagged: bool = False) -> DataFrame:
    """(id, text) of <id>.txt files, or (id, tag, text) of <id>.<tag>.txt ones."""
    df = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    if tagged:
        pattern = r"^(.*)\.([^.]*)\.txt$"
        return df.where(F.col("name").rlike(pattern)).select(F.regexp_extract("name", pattern, 1).alias("id"), F.regexp_extract("name", pattern, 2).alias("tag"), "text")
    return df.select(F.regexp_replace("name", r"\.txt$", "").alias("id"), "text")


def unfenced(answer: Column) -> Column:
    """A model's answer without the code fence around it: its first line, and its last one if that is nothing but a fence."""
    t = F.trim(answer)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```[ \t]*$", "")
    return F.when(t.startswith("```"), F.trim(inner)).otherwise(t)


def line_boxes_json(answer: Column) -> Column:
    """Line boxes of a model's answer; items that are no objects are left out, and what can't be read gives an empty array."""
    items = F.from_json(unfenced(answer), "array<string>")  # each item as JSON of its own, whatever it is
    objects = F.filter(items, lambda x: x.startswith("{"))
    none = F.array().cast(LINE_BOXES)
    read = F.filter(F.transform(objects, lambda x: F.from_json(x, "text string, box_2d array<int>")), lambda x: x["text"].isNotNull() | x["box_2d"].isNotNull())
    return F.when(unfenced(answer).startswith("["), F.coalesce(read, none)).otherwise(none)


def is_supported(name: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*EXTENSIONS), F.lit(False))


def ocr_lines(words: DataFrame, key: str = "page_id") -> DataFrame:
    """OCR words (key, level, block_num, par_num, line_num, left, top, width, height, conf, text) grouped to lines.

    Only words (level 5) with text and a confidence of 0 or more count; an unreadable confidence is none. Words from the
    left, ties by input order word_no; the line's confidence is the mean, half to even."""
    conf = F.expr("cast(try_cast(conf AS double) AS int)")
    w = words.withColumn("c", conf).where((F.col("level") == 5) & (F.trim("text") != "") & (F.coalesce("c", F.lit(-1)) >= 0))
    parts = F.array_sort(F.collect_list(F.struct("left", "word_no", F.trim("text").alias("t"))))
    g = w.groupBy(key, "block_num", "par_num", "line_num").agg(
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
        F.rint(F.avg("c")).cast("int").alias("confidence"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
    )
    return g


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in (("'", "&#39;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def bbox(*c: str) -> Column:
    return F.format_string("bbox %d %d %d %d", *c)


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """lines with ln, from 1 on its page, and ws, the words as they are written out."""
    from leafscan.operators.geometry import line_words

    own = F.col("words") if "words" in lines.columns else None
    ws = line_words(F.coalesce("text", F.lit("")), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.coalesce("confidence", F.lit(95)), own)
    ln = F.row_number().over(W.partitionBy("page_id").orderBy("line_no", *(c for c in ("line_id",) if c in lines.columns)))
    return lines.select("page_id", "line_no", "x0", "y0", "x1", "y1", ln.alias("ln"), ws.alias("ws"))


def _whole_pages(pages: DataFrame, lines: DataFrame, html: Column) -> DataFrame:
    """pages with their lines' markup in body and the box around them; all of the page where it has none."""
    l = lines.select("page_id", "x0", "y0", "x1", "y1", F.struct("ln", html.alias("html")).alias("h"))  # noqa: E741
    body = F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: x["html"]), "\n")  # the lines of one page
    g = l.groupBy("page_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), body.alias("body"))
    joined = pages.join(g, "page_id", "left")
    return joined.withColumns({"x0": F.coalesce("x0", F.lit(0)), "y0": F.coalesce("y0", F.lit(0)), "x1": F.coalesce("x1", "width"), "y1": F.coalesce("y1", "height"), "empty": F.col("body").isNull(), "body": F.coalesce("body", F.lit(""))})


def hocr_pages(pages: DataFrame, lines: DataFrame, language: str = "en") -> DataFrame:
    """(page_id, hocr): one ocr_page element a page with its area, paragraph, lines and words.

    pages: page_id, image_name, width, height, page_no; lines: page_id, line_no, text, x0 .. y1, confidence, and words where they are
    known. A page without lines has an area over all of it."""
    lang = F.lit(language)
    depth = F.greatest(F.lit(1), F.floor((F.col("y1") - F.col("y0")) / 5)).cast("int")
    rows = _numbered_lines(lines).join(pages.select("page_id", "page_no"), "page_id")
    words = F.transform(
        "ws",
        lambda w, i: F.format_string(
            '<span class="ocrx_word" id="word_%d_%d_%d" title="bbox %d %d %d %d; x_wconf %d">%s</span>', F.col("page_no"), F.col("ln"), i + 1, w["x0"], w["y0"], w["x1"], w["y1"], w["conf"], escaped(w["word"])
        ),
    )
    line = F.format_string('<span class="ocr_line" id="line_%d_%d" title="%s; baseline 0 -%d; lang %s">%s</span>', "page_no", "ln", bbox("x0", "y0", "x1", "y1"), depth, lang, F.array_join(words, " "))
    p = _whole_pages(pages, rows, line)
    around = bbox("x0", "y0", "x1", "y1")
    html = F.format_string(
        '<div class="ocr_page" id="page_%d" title="image &quot;%s&quot;; bbox 0 0 %d %d; ppageno %d"><div class="ocr_carea" id="block_%d_1" title="%s"><p class="ocr_par" id="par_%d_1" title="%s; lang %s">\n%s\n</p></div></div>',
        "page_no", escaped(F.coalesce("image_name", F.lit(""))), "width", "height", F.col("page_no") - 1, "page_no", around, "page_no", around, lang, "body",
    )
    return p.select("page_id", html.alias("hocr"))


# Heads of the two formats' documents.
HOCR_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n'
    '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{language}"><head><title>hOCR</title><meta http-equiv="Content-Type" content="text/html; charset=utf-8"/>'
    '<meta name="ocr-system" content="{system}"/><meta name="ocr-capabilities" content="ocr_page ocr_carea ocr_par ocr_line ocrx_word"/></head><body>\n'
)
ALTO_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" SCHEMAVERSION="4.2" '
    'xsi:schemaLocation="http://www.loc.gov/standards/alto/ns-v4# http://www.loc.gov/standards/alto/v4/alto-4-2.xsd"><Description><MeasurementUnit>pixel</MeasurementUnit>'
)


def documents_of(pages: DataFrame, fragments: DataFrame, column: str, head: Column, tail: str) -> DataFrame:
    """(file_id, document): the fragments (page_id, column) of a file's pages in order between head, which may use first_image, and tail."""
    rows = pages.select("page_id", "file_id", "page_no", "image_name").join(fragments.select("page_id", column), "page_id")
    parts = F.array_sort(F.collect_list(F.struct("page_no", "page_id", "image_name", column)))  # the pages of one file: a document is one value
    g = rows.groupBy("file_id").agg(parts.alias("ps")).withColumn("first_image", F.col("ps")[0]["image_name"])
    return g.select("file_id", F.concat(head, F.array_join(F.transform("ps", lambda p: p[column]), "\n"), F.lit(tail)).alias("document"))


def hocr_documents(pages: DataFrame, lines: DataFrame, system: str = "leafscan", language: str = "en") -> DataFrame:
    head = F.lit(HOCR_HEAD.format(system=system, language=language))
    return documents_of(pages, hocr_pages(pages, lines, language), "hocr", head, "\n</body></html>\n")


def hocr_lines(hocr: DataFrame) -> DataFrame:
    """(page_id, line_no, x0, y0, x1, y1) read back from hOCR."""
    found = F.regexp_extract_all("hocr", F.lit(r'class="ocr_line"[^>]*? title="bbox (\d+ \d+ \d+ \d+)'), 1)
    rows = hocr.select("page_id", F.posexplode(found).alias("line_no", "b")).withColumn("n", F.split("b", " "))
    return rows.select("page_id", "line_no", *(F.element_at("n", k + 1).cast("int").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))


def hocr_image_lines(documents: DataFrame, image: Column) -> DataFrame:
    """Lines of the page of a document (column document) whose title names the image: line_no, x0 .. y1; the other columns stay."""
    page = F.element_at(F.filter(F.split("document", '(?=<div class="ocr_page")'), lambda p: F.contains(p, F.concat(F.lit("image &quot;"), escaped(image), F.lit("&quot;")))), 1)
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r'class="ocr_line"[^>]*? title="bbox (\d+ \d+ \d+ \d+)'), 1)
    rows = documents.select("*", F.posexplode(found).alias("line_no", "b")).withColumn("n", F.split("b", " ")).drop("b", "document")
    return rows.select("*", *(F.element_at("n", k + 1).cast("int").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1")))).drop("n")


def _geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    side = lambda a, b: F.greatest(F.lit(0), b - a)
    return F.format_string('HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"', x0, y0, side(x0, x1), side(y0, y1))


def alto_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, alto): a Page element with its print space, and one block of lines, Strings and spaces; no block on a page without lines."""
    rows = _numbered_lines(lines).join(pages.select("page_id", "page_no"), "page_id")
    words = F.transform(
        "ws",
        lambda w, i: F.format_string(
            '<String ID="word_%d_%d_%d" %s CONTENT="%s" WC="%.2f"/>', F.col("page_no"), F.col("ln"), i + 1, _geometry(w["x0"], w["y0"], w["x1"], w["y1"]), escaped(w["word"]),
            F.greatest(F.lit(0), F.least(F.lit(100), w["conf"])) / 100.0,
        ),
    )
    around = _geometry(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    line = F.format_string('<TextLine ID="line_%d_%d" %s>%s</TextLine>', "page_no", "ln", around, F.array_join(words, "<SP/>"))
    p = _whole_pages(pages, rows, line)
    block = F.when(F.col("empty"), F.lit("")).otherwise(F.format_string('<TextBlock ID="block_%d_1" %s>%s</TextBlock>', "page_no", around, "body"))
    page = F.format_string('<Page ID="page_%d" PHYSICAL_IMG_NR="%d" WIDTH="%d" HEIGHT="%d"><PrintSpace HPOS="0" VPOS="0" WIDTH="%d" HEIGHT="%d">%s</PrintSpace></Page>', "page_no", "page_no", "width", "height", "width", "height", block)
    return p.select("page_id", page.alias("alto"))


def alto_documents(pages: DataFrame, lines: DataFrame, system: str = "leafscan", language: str = "en") -> DataFrame:
    source = F.concat(F.lit("<sourceImageInformation><fileName>"), escaped(F.coalesce("first_image", F.lit(""))), F.lit("</fileName></sourceImageInformation>"))
    step = f'<OCRProcessing ID="OCR_1"><ocrProcessingStep><processingStepSettings>language:{language}</processingStepSettings><processingSoftware><softwareName>{system}</softwareName></processingSoftware></ocrProcessingStep></OCRProcessing></Description><Layout>\n'
    return documents_of(pages, alto_pages(pages, lines), "alto", F.concat(F.lit(ALTO_HEAD), source, F.lit(step)), "\n</Layout></alto>\n")


def overlay(lines: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """What a searchable page would print: each word's point and font size; empty boxes are left out.

    A line's own words are taken as they are; without any, its text is spread along it."""
    from leafscan.operators.geometry import line_words

    spread = line_words(F.col("text"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(95))
    ws = F.when(F.size("words") > 0, F.col("words")).otherwise(spread) if "words" in lines.columns else spread
    w = lines.select("page_id", "line_no", F.posexplode(ws).alias("word_no", "w")).select("page_id", "line_no", "word_no", "w.*").where("x1 > x0 and y1 > y0")
    size = F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) * scale_y * 0.7)
    return w.select("page_id", "line_no", "word_no", F.concat("word", F.lit(" ")).alias("text"), (F.col("x0") * scale_x).alias("x"), (F.col("y1") * scale_y).alias("y"), size.alias("size"))


def read_word_truth(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, line_no, text, box, words) of labelled word boxes in a JSON file; no file gives an empty table."""
    lines = "array<struct<text:string,box:array<int>,words:array<array<int>>>>"
    schema = f"pages array<struct<lines:{lines}>>"
    df = spark.read.json(path, schema=schema, multiLine=True) if "://" in path or os.path.exists(path) else spark.createDataFrame([], schema)
    p = df.select(F.posexplode("pages").alias("page_no", "p"))
    return p.select("page_no", F.posexplode("p.lines").alias("line_no", "l")).select("page_no", "line_no", "l.text", "l.box", "l.words")


def write_texts(texts: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One partition folder of text for each name, each text whole."""
    texts.select(F.col(name).alias("name"), F.col(text).cast("string").alias("value")).write.partitionBy("name").mode("overwrite").option("lineSep", "\n").text(folder)


def stem(name: Column) -> Column:
    """A file name without folders and its last suffix; a name that begins with its only dot is all stem."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def page_stem(name: Column, page: Column, pages: Column) -> Column:
    """Name of a page's outputs: the stem, numbered from 1 where there is more than one page."""
    return F.when(pages > 1, F.format_string("%s_page_%04d", stem(name), page)).otherwise(stem(name))


def text_lines(text: Column) -> Column:
    """The lines of a text at any line end; a last line end begins no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\R$", ""), r"\R"))


def file_text(pages: DataFrame) -> DataFrame:
    """(file_id, text): the trimmed plain texts of a file's pages, a blank line between them; for write.text."""
    p = pages.select("file_id", "page_no", "page_id", F.regexp_replace(F.coalesce("plain_text", F.lit("")), r"^\s+|\s+$", "").alias("t")).dropDuplicates(["page_id"])
    parts = F.array_sort(F.collect_list(F.struct("page_no", "page_id", "t")))
    return p.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))

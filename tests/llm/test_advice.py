"""Cases that the operators for training text lost before the advice of round 1."""

import os

import pytest
from pyspark.sql import functions as F

from leafscan.llm import languages, lookalike, personal, splitting, tokens, truncation
from leafscan.llm.tokenizer import transducer


# 3
def test_cut_box_beside_a_misread_line(spark, tmp_path):
    said = ["the old house stood near the wooden mill", "a narrow bridge over the river was mended", "her brother wrote a letter to the keeper"]
    lines = [(k, t) for k in range(2, 9) for t in said]
    lines += [(1, "the o1d honse stood near the wooden mill"), (1, said[1])]
    rows = [(k, p, k, t) for k, (p, t) in enumerate(lines)]
    spark.createDataFrame(rows, "line_id long, page_id long, line_no int, text string").write.parquet(f"{tmp_path}/transcribed_lines.parquet")
    boxes = [
        (101, 1, "the old house stood near the woo"),  # its line is misread
        (102, 1, said[0]),  # whole, beside the misread line
        (103, 1, "her brother wrote a letter to the kee"),  # its line is lacking
        (104, 1, said[2]),
        (105, 1, "a narrow bridge over the river was men"),
        (106, 1, None),
    ]
    spark.createDataFrame(boxes, "det_id long, page_id long, text string").write.parquet(f"{tmp_path}/line_boxes.parquet")
    pages = spark.createDataFrame([(1, 2, None)], "page_id long, n_lines int, plain_text string")
    pages.write.parquet(f"{tmp_path}/page_results.parquet")
    got = {(r.rec, r.rec_id) for r in truncation.found(spark, str(tmp_path)).collect()}
    assert got == {("box", 101), ("box", 103), ("box", 105)}


def test_texts_that_only_trigrams_of_whole_pages_tell(spark, tmp_path):
    said = ["the old house stood near the wooden mill", "a narrow bridge over the river was mended", "her brother wrote a letter to the keeper"]
    lines = [(k, j, t) for k in range(2, 9) for j, t in enumerate(said)] + [(1, 0, said[0])]
    rows = [(k, p, j, t) for k, (p, j, t) in enumerate(lines)]
    spark.createDataFrame(rows, "line_id long, page_id long, line_no int, text string").write.parquet(f"{tmp_path}/transcribed_lines.parquet")
    boxes = [
        (101, 20, "her brother wr"),  # a page without lines and other boxes
        (102, 21, said[2]),  # so is this, but it is whole
        (103, 1, "thc o"),  # shorter than eight signs, its line's beginning misread
        (104, 1, "wooden mi1l"),  # a whole half, misread
    ]
    spark.createDataFrame(boxes, "det_id long, page_id long, text string").write.parquet(f"{tmp_path}/line_boxes.parquet")
    pages = [
        (2, 3, "\n".join(said)),
        (3, 3, f"{said[0]}\na narrow bri\n..."),  # the mark is on a line of its own
        (4, 3, f"{said[0]}\na wholly unknown ending"),  # no line has its last words
        (4, 3, f"{said[0]}\na wholly unknown ending"),
        (5, 3, "\n".join([*said[:2], "her"])),
        *((k, 3, t) for k, t in enumerate([None, "", "\n", "..."], 6)),  # nothing that could be cut
        *((k, 4, f"{said[0]}\nfare\nwell") for k in range(30, 40)),  # words of two lines that always end a page
    ]
    spark.createDataFrame(pages, "page_id long, n_lines int, plain_text string").write.parquet(f"{tmp_path}/page_results.parquet")
    got = {(r.rec, r.rec_id) for r in truncation.found(spark, str(tmp_path)).collect()}
    assert got == {("box", 101), ("box", 103), ("page", 3), ("page", 4), ("page", 5)}
    counts = truncation.trigram_counts(spark.createDataFrame([("a b c", False), ("a b cd", True), ("x a b c", True)], "text string, page boolean"))
    last = truncation.finals(spark.createDataFrame([("a b c", None), ("z", "a b c")], "body string, tail string"))
    assert [tuple(r) for r in truncation.met(last, counts).select("n", "own", "ended", "among", "final").collect()] == [(1, 1, 1, 2, 1)]


# 8
@pytest.mark.skipif(not os.path.exists(tokens.vocabulary()), reason="no vocabulary files")
def test_natural_place_before_a_long_run(spark):
    text = "One line of words.\n" + "nospaces" * 300
    pieces = splitting.split(spark.createDataFrame([(1, text)], "doc_id long, text string"), [(1, 60, 3), (2, 60, 59)], tokens.vocabulary())
    first = pieces.where(F.col("limit_id") == 1).orderBy("piece_no").first()
    assert first.cut == "sentence" and first.text.rstrip("\n") == "One line of words."
    n = len(transducer(tokens.vocabulary()).encode(text))
    got = pieces.where(F.col("limit_id") == 2).orderBy("piece_no").collect()
    assert got[-1].end_token == n and all(a.end_token - b.start_token == 59 for a, b in zip(got, got[1:], strict=False))


# 4
def test_surname_seen_once_after_a_title(spark, tmp_path):
    text = "The keeper wrote to Mr. Quillfeather about the house. The doctor. He came later and he left."
    filler = "Mrs. Harrow kept the house and he saw Mr. Harrow there. "
    rows = [(1, 2, text), *((k, 1, filler * 3) for k in range(2, 30))]
    spark.createDataFrame(rows, "page_id long, n_lines int, plain_text string").withColumn("n_lines", F.lit(1)).write.parquet(f"{tmp_path}/page_results.parquet")
    got = {(r.kind, r.value) for r in personal.p4_found(spark, str(tmp_path)).where("page_id = 1").collect()}
    assert got == {("name", "Quillfeather")}


def test_rare_kind_keeps_its_spans(spark, tmp_path, monkeypatch):
    rows = [(k, 1, f"Mrs. Harrow kept the house. Tel. +44 1632 9606{k}.") for k in range(10, 30)] + [(1, 1, "Write to fern@old-maps.test soon, Mrs. Harrow said.")]
    spark.createDataFrame(rows, "page_id long, n_lines int, plain_text string").write.parquet(f"{tmp_path}/page_results.parquet")
    monkeypatch.setattr(personal, "TRAIN_SPANS", 2)
    got = {(r.kind, r.value) for r in personal.p4_found(spark, str(tmp_path)).where("page_id = 1").collect()}
    assert got == {("email", "fern@old-maps.test"), ("name", "Harrow")}


# 5
def test_label_is_checked_by_the_whole_text():
    eng, deu = "The old house stood near the river and the keeper kept the keys. ", "Das alte Haus stand am Fluss und der Diener behielt die Karten. "
    long = deu * 350 + eng * 1000 + "zanzibar zanzibar"
    m = languages.train([(eng, {"eng"})] * 3 + [(deu, {"deu"})] * 3 + [(long, {"eng"})])
    assert len(deu * 350) > 20_000 and "zanzibar" in m.words


def test_no_label_is_left_out(spark):
    docs = spark.range(151_000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.when(F.col("id") % 151 == 0, F.concat(F.lit("en-"), "id")).otherwise(F.concat(F.lit("zz"), "id")).alias("lang")
    )
    got = languages.sample(docs, languages.spellings(), 2_000)
    assert len(got) == 1_000 and all(s == {"eng"} for _, s in got)


# 1
def test_signs_without_a_mark_above_the_basic_plane(spark):
    text = "ho\U000e0020us\U000e0100e\U0001d173"
    got = spark.createDataFrame([(text,)], "t string").select(lookalike.mapped(F.col("t")).alias("m")).first().m
    assert got == lookalike.form(text) == "house"

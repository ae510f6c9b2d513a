"""Golden values of the scoring suite and edge cases of the engine's own operators."""

import random

import pytest
from pyspark.sql import functions as F

from leafscan.functions import text as T
from leafscan.operators import align, geometry, layout, usage
from leafscan.sources import formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalized():
    assert T.normalized("A  ſmall; MILL!\n") == "a small mill"
    assert T.normalized("won't half-way [torn]") == "won't half-way [torn]"
    assert T.normalized("MILL!", strict=True) == "mill!"
    assert T.normalized(None) is None and T.normalized("") == ""


@pytest.mark.parametrize(("ref", "hyp", "words", "chars"), [
    ("they met at the mill", "they net at a mill", 2, 4), ("candle", "candie", 1, 1), ("ledger", "lodgor", 1, 2), ("old mill", "mill old", 2, None), ("", "a b", 2, 3),
])
def test_distances(spark, ref, hyp, words, chars):
    df = spark.createDataFrame([(ref, hyp)], "r string, h string")
    got = df.select(T.word_distance(T.words_of(F.col("r")), T.words_of(F.col("h"))).alias("w"), F.levenshtein("r", "h").alias("c")).first()
    assert got.w == words and (chars is None or got.c == chars)


def brute(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def test_edits_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        dist, sub, dele, ins = T.edits_of(a, b)
        assert dist == brute(a, b) == sub + dele + ins and len(a) - dele + ins == len(b)


def test_pixels(spark):
    df = spark.createDataFrame([([100, 200, 300, 400], 1000, 1000), ([300, 400, 100, 200], 1000, 1000), ([0, 0, 1000, 1000], 800, 600), (None, 1, 1), ([1, 2], 5, 5), ([-5, 0, 2000, 10], 100, 100)], "b array<int>, w int, h int")
    got = [r.p for r in df.select(geometry.to_pixels(F.col("b"), F.col("w"), F.col("h")).alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [(200, 100, 400, 300), (200, 100, 400, 300), (0, 0, 800, 600), None, None, (0, 0, 1, 100)]


def test_words_and_overlap(spark):
    ws = one(spark, geometry.spread_words(F.lit("alpha bb ccccc"), F.lit(100), F.lit(900)))
    assert [w.word for w in ws] == ["alpha", "bb", "ccccc"] and ws[0].x0 == 100 and ws[-1].x1 == 900
    assert one(spark, geometry.spread_words(F.lit("  "), F.lit(1), F.lit(9))) == []
    box = lambda *c: F.struct(*(F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), c, strict=True)))
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, geometry.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    assert one(spark, geometry.sane_words(F.array(box(0, 0, 10, 10), box(12, 0, 20, 10)))) is True
    assert one(spark, geometry.sane_words(F.array(box(0, 0, 10, 10), box(1, 0, 9, 10)))) is False
    w = lambda *xs: F.array(*(F.struct(F.lit(k).alias("word_no"), F.lit("w").alias("word"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for k, (a, b) in enumerate(xs)))
    clean = lambda xs, a, b: [(r.x0, r.x1) for r in one(spark, geometry.apart(w(*xs), F.lit(a), F.lit(b)))]
    assert clean([(10, 60), (50, 90)], 10, 90) == [(10, 55), (55, 90)]
    assert clean([(10, 20), (25, 26), (40, 50)], 10, 50) == [(10, 20), (25, 27), (40, 50)]
    assert clean([(10, 20), (49, 50)], 10, 50) == [(10, 20), (48, 50)]  # no room to the right
    assert clean([(10, 20), (20, 21), (21, 30)], 10, 30) == [(10, 20), (20, 21), (21, 30)]  # none at all
    assert clean([(10, 12)], 10, 50) == [(10, 12)]


def box(i, ymin, xmin, ymax, xmax, page=1):
    return (page, i, i, f"t{i}", ymin, xmin, ymax, xmax)


def test_reading_order(spark):
    schema = "page_id long, det_id long, det_idx int, text string, ymin int, xmin int, ymax int, xmax int"
    rows = [box(0, 10, 600, 30, 900), box(1, 50, 20, 70, 400), box(2, 10, 20, 30, 400), box(3, 12, 30, 22, 60), box(4, 5, 5, 9, 9, page=2)]
    want = {(1, 2): 0, (1, 1): 1, (1, 0): 2, (2, 4): 0}  # box 3 lies on box 2
    for _ in range(3):
        random.shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(3)
        assert {(r.page_id, r.det_id): r.pos for r in layout.reading_order(df).collect()} == want
    assert layout.reading_order(spark.createDataFrame([], schema)).collect() == []


def test_line_alignment():
    found = [("the sun rose", (10, 0, 30, 900)), ("over the hill", (50, 0, 70, 900))]
    got = align.place_lines(["The sun  rose", "a new line", "over the hill"], found)
    assert [(p.text, p.interpolated) for p in got] == [("The sun  rose", False), ("a new line", True), ("over the hill", False)]
    assert align.place_lines([], found)[0].text == "the sun rose"
    assert [p.box for p in align.place_lines(["a", "b"], [])] == [(40, 40, 496, 960), (500, 40, 956, 960)]
    assert align.fuzzy_matches(["riverside"], ["rivreside"], 0.8) == 1
    words = align.place_words("The old house", (0, 0, 100, 10), [("the", (0, 1, 20, 9)), ("house", (60, 1, 100, 9))])
    assert [w[2] for w in words] == [True, False, True] and words[1][1][0] >= 20 and words[1][1][2] <= 60


def test_usage(spark):
    rows = [(1, 1, "scribe-pro", 1000, 200, 50, None), (2, 1, "scribe-pro", 100, 0, 20, 170), (2, 1, "scribe-pro", 100, 0, 20, 170), (3, 2, "none", None, None, None, None)]
    calls = spark.createDataFrame(rows, "call_id long, file_id long, model string, prompt_token_count long, candidates_token_count long, thoughts_token_count long, total_token_count long")
    got = {r.model: r for r in usage.cost(usage.usage(calls, "model"), usage.price_catalog(spark)).collect()}
    assert (got["scribe-pro"].input, got["scribe-pro"].output, got["scribe-pro"].calls) == (1100, 250, 2)
    assert got["none"].cost is None and got["none"].rate_in == 0.0 and got["none"].calls == 1


def test_tiers(spark):
    u = spark.createDataFrame([("scribe-pro", 4000, 0, 0, 2), ("scribe-pro", 500000, 0, 0, 1), ("scribe-pro", 500000, 0, 0, 0)], "model string, input long, output long, thinking long, calls long")
    assert [r.rate_in for r in usage.cost(u, usage.price_catalog(spark)).orderBy("input", "calls").collect()] == [2.0, 2.0, 4.0]


def test_progress_closed_form(spark):
    rng = random.Random(1)
    ev = [(j, s, rng.randint(0, 4), rng.randint(0, 4)) for j in range(4) for s in range(12)]
    got = {(r.job, r.seq): r.units_done for r in usage.progress(spark.createDataFrame(ev, "job long, seq long, pages int, budget int")).collect()}
    for j in range(4):
        done = budget = 0
        for _, s, p, b in [e for e in ev if e[0] == j]:
            budget += b
            done = max(done + p, budget)
            assert got[j, s] == done


def test_formats(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,image,type,subtype,era,difficulty,mode,source\na,x.png,letter,,1900,medium,sequential,s\n ,y,,,,,,\n")
    assert formats.read_manifest(spark, str(tmp_path / "m.csv")).count() == 1
    assert formats.read_manifest(spark, str(tmp_path / "none.csv")).count() == 0
    answers = spark.createDataFrame([('```json\n[{"text":"a","box_2d":[1,2,3,4]}]\n```',), ("oops",), (None,)], "a string")
    assert [len(r.b) for r in answers.select(formats.line_boxes_json(F.col("a")).alias("b")).collect()] == [1, 0, 0]
    odd = spark.createDataFrame([('[{"text":"a","box_2d":[1,2,3,4]}, 5, "x", null, {"text":"b","box_2d":[1]}]',), ('{"text":"a"}',), ("[]",), ("```\n[]\n```",)], "a string")
    assert [[x.text for x in r.b] for r in odd.select(formats.line_boxes_json(F.col("a")).alias("b")).collect()] == [["a", "b"], [], [], []]
    words = spark.createDataFrame([(1, 5, 1, 1, 1, 30, 0, 10, 10, "90", "b", 1), (1, 5, 1, 1, 1, 0, 2, 10, 10, "95.5", "a", 0), (1, 5, 1, 1, 1, 0, 0, 9, 9, "x", "no", 2), (1, 4, 1, 1, 1, 0, 0, 9, 9, "9", "no", 3)],
        "page_id long, level int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf string, text string, word_no int")
    r = formats.ocr_lines(words).first()
    assert (r.text, r.x0, r.y0, r.x1, r.y1, r.confidence) == ("a b", 0, 0, 40, 12, 92)


def test_hocr_round_trip(spark):
    pages = spark.createDataFrame([(1, 'a<b>&".png', 100, 200, 1), (2, "e.png", 10, 20, 2)], "page_id long, image_name string, width int, height int, page_no int")
    lines = spark.createDataFrame([(1, 0, "x < y & z", 5, 6, 50, 16, 80)], "page_id long, line_no int, text string, x0 int, y0 int, x1 int, y1 int, confidence int")
    h = formats.hocr_pages(pages, lines)
    assert [tuple(r) for r in formats.hocr_lines(h).collect()] == [(1, 0, 5, 6, 50, 16)]
    import xml.etree.ElementTree as E

    for r in h.collect():
        E.fromstring(r.hocr)
    assert "line_1_1" in h.where("page_id = 1").first().hocr and "word_1_1_5" in h.where("page_id = 1").first().hocr
    filed = pages.withColumn("file_id", F.lit(7).cast("long"))
    docs = formats.hocr_documents(filed, lines)
    E.fromstring(docs.first().document.split("transitional.dtd\">")[1])
    got = formats.hocr_image_lines(docs.withColumn("image", F.lit('a<b>&".png')), F.col("image")).collect()
    assert [(r.file_id, r.line_no, r.x0, r.y1) for r in got] == [(7, 0, 5, 16)]
    alto = E.fromstring(formats.alto_documents(filed, lines).first().document.encode())
    ns = "{http://www.loc.gov/standards/alto/ns-v4#}"
    assert [len(p.findall(f".//{ns}TextBlock")) for p in alto.iter(f"{ns}Page")] == [1, 0] and len(list(alto.iter(f"{ns}SP"))) == 4
    assert [x.get("CONTENT") for x in alto.iter(f"{ns}String")] == ["x", "<", "y", "&", "z"] and next(alto.iter(f"{ns}String")).get("WC") == "0.80"
    assert "bbox 0 0 10 20" in h.where("page_id = 2").first().hocr


def test_stream_equals_batch(spark, tmp_path):
    from leafscan.streaming.progress import follow

    ev = [(1, 1, False, 2, 2, 2), (1, 2, True, 0, 1, 2), (2, 1, False, 1, 3, 2), (1, 1, False, 2, 2, 2), (3, 1, True, 0, 4, 1)]
    src = spark.createDataFrame(ev, "job long, seq long, failed boolean, pages long, budget long, total long").repartition(3)
    src.write.parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("followed").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("select job, max(files_done) d, max(files_failed) f, max(units_done) u, max_by(status, files_done + files_failed) s from followed group by job").collect()
    assert {(r.job, r.d, r.f, r.u, r.s) for r in last} == {(1, 1, 1, 3, "done"), (2, 1, 0, 3, "running"), (3, 0, 1, 4, "error")}
    batch = usage.progress(spark.createDataFrame([(e[0], e[1], e[3], e[4]) for e in set(ev)], "job long, seq long, pages long, budget long"))
    assert {(r.job, r.u) for r in batch.groupBy("job").agg(F.max("units_done").alias("u")).collect()} == {(r.job, r.u) for r in last}


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "strata_micro_avg" in e.queries()

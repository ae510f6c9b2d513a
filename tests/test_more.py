"""Provider calls, images, reports, batch control and display: cases of our own."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from leafscan.functions import display
from leafscan.functions import text as T
from leafscan.operators import align, batch, geometry, provider, report, usage
from leafscan.sources import images
from tests.test_core import brute, one


def test_word_distance_of_many_words(spark):
    rng = random.Random(9)
    rows = []
    for n in (1, 250, 300, 700, 2000):
        a = [f"w{rng.randint(0, n)}" for _ in range(n)]
        b = [w for w in a if rng.random() > 0.05] + [f"x{k}" for k in range(n // 9)]
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [brute(a, b) for a, b in rows]


def test_word_distance_of_long_texts(spark):
    rng = random.Random(4)
    for k in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90 if k < 40 else 9))]
        b = [w for w in a if rng.random() > 0.2] if k % 2 else [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        assert T.distance_of(a, b) == brute(a, b)
    a = [f"w{k}" for k in range(60_000)]  # by a table of all pairs of words 3,600,000,000 steps
    b = ["x", *a[: 59_000], "y", *a[59_001:]]
    rows = [(a, b, None), (["a"], [], 0), ([], [], 0), (None, ["a"], None), (["a", "b"], ["b"], None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, c int")
    start = time.monotonic()
    assert [r.d for r in df.select(T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 1, 0, None, 1]
    assert time.monotonic() - start < 60


def test_multiset_matches(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 8))], [rng.choice("abcd") for _ in range(rng.randint(0, 8))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.multiset_matches(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in got] == [sum(min(a.count(x), b.count(x)) for x in set(a)) for a, b in rows]


def test_normalize_in_both_ways(spark):
    texts = ["A  Small; Mill!\n", "won't half-way [Torn]", "Straße ſmall É", "", "_x_ --", None, "[a b] c", "été.", "\x1cx\x1fy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(T.normalize("t").alias("n")).collect()] == [T.normalized(t) for t in texts]


def test_alignment_rules():
    found = [("north", (10, 0, 50, 900)), ("south", (60, 0, 80, 900)), ("west", (90, 0, 99, 900))]
    assert [p.text for p in align.place_lines(["all else"], found)] == ["all else"]  # boxes left over in a differing run go
    got = align.place_lines(["north", "new"], found[:1])
    assert got[1].box == (55, 0, 95, 900) and got[1].interpolated  # no step yet: height and 5
    assert [w[1] for w in align.place_words("a bb c", (0, 0, 90, 9), [("a", (0, 1, 40, 9)), ("c", (40, 1, 90, 8))])] == [(0, 1, 40, 9), (40, 1, 41, 9), (40, 1, 90, 8)]
    assert align.fuzzy_matches(["diet"], ["tide"], 0.5) != align.fuzzy_matches(["tide"], ["diet"], 0.5)


def test_effective_words(spark):
    word = "array<struct<word:string,x0:int,y0:int,x1:int,y1:int,conf:int>>"
    rows = [("a b", [("a", 0, 0, 10, 10, 80), ("b", 20, 0, 30, 10, 70)]), ("a b", [("a", 0, 0, 30, 10, 80), ("b", 1, 0, 29, 10, 70)]), ("a b", []), ("a b", None)]
    df = spark.createDataFrame(rows, f"t string, ws {word}")
    got = [r.w for r in df.select(geometry.line_words(F.col("t"), F.lit(0), F.lit(0), F.lit(30), F.lit(10), F.lit(95), F.col("ws")).alias("w")).collect()]
    assert [[w.conf for w in g] for g in got] == [[80, 70], [95, 95], [95, 95], [95, 95]]


class Flaky(provider.Mock):
    """Fails as told: one kind of error for each try, then answers."""

    def __init__(self, *errors):
        self.errors, self.tried = list(errors), []

    def transcribe_text(self, image, model, plain=False):
        self.tried.append((model, plain))
        if self.errors:
            raise self.errors.pop(0)
        return "a line", {"prompt": 100, "candidates": 0, "thoughts": 20, "total": 170}


def test_retries_and_other_models():
    busy, gone, bad = provider.CallError("overloaded", 503), provider.CallError("model NOT_FOUND"), provider.CallError("odd option", 400)
    waits = []
    call = provider.Caller(waits.append)
    p = Flaky(busy, busy)
    assert call(p.transcribe_text, None, "m") == "a line" and waits == [2.0, 4.0] and call.tokens == {"input": 100, "output": 50, "thinking": 20, "calls": 1}
    with pytest.raises(provider.CallError):
        call(Flaky(*[busy] * 4).transcribe_text, None, "m")
    assert waits == [2.0, 4.0, 2.0, 4.0, 8.0] and call.tokens["calls"] == 1
    p = Flaky(gone)
    assert call(p.transcribe_text, None, "old") == "a line" and [m for m, _ in p.tried] == ["old", "scribe-pro"] and call.dead == {"old"}
    p = Flaky(bad)
    assert call(p.transcribe_text, None, "m") == "a line" and p.tried == [("m", False), ("m", True)]
    with pytest.raises(provider.CallError):
        call(Flaky(provider.CallError("UNAUTHENTICATED"), provider.CallError("UNAUTHENTICATED")).transcribe_text, None, "m")


class ByModel(provider.Mock):
    def transcribe_text(self, image, model, plain=False):
        if model == "broken":
            raise provider.CallError("permission_denied {json}", 403)
        return super().transcribe_text(image, model)


def test_provider_pages(spark):
    pages = spark.createDataFrame([(1, None, "m", "two_pass"), (2, None, "m", "one_pass"), (3, None, "m", "text"), (4, None, "broken", "two_pass"), (5, None, None, "two_pass")], "page_id long, image binary, model string, mode string")
    got = provider.transcribe(pages, ByModel()).collect()
    by = {k: [r for r in got if r.page_id == k] for k in range(1, 6)}
    assert [len(by[k]) for k in range(1, 6)] == [4, 4, 0, 1, 4] and by[1][0].box_2d == [120, 80, 230, 920]
    assert (by[4][0].kind, by[4][0].error) == ("auth", "permission_denied") and by[4][0].tokens.count("0") == 4
    assert provider.transcribe(pages.limit(0), ByModel()).count() == 0


def test_error_classes(spark):
    cases = [(None, "model does not exist", "gone"), (None, "Unauthorized", "auth"), (None, "no longer available", "gone"), (None, "RESOURCE_EXHAUSTED", "transient"), (None, "INTERNAL: connection reset", "transient"),
             (None, "No permission to write", "other"), (501, "x", "other"), (504, None, "transient"), (404, "UNAUTHENTICATED", "auth"), (None, None, "other")]
    df = spark.createDataFrame(cases, "code int, m string, want string").withColumn("got", usage.error_class(F.col("code"), F.col("m")))
    assert [r.got for r in df.collect()] == [w for _, _, w in cases]
    assert one(spark, usage.short_error(F.lit(503), F.lit("busy {...}"))) == "503 busy" and one(spark, usage.short_error(F.lit(None).cast("int"), F.lit("{"))) == "error"
    assert one(spark, usage.percent(F.lit(1), F.lit(8))) == 13 and one(spark, usage.percent(F.lit(1), F.lit(8), F.lit("done"))) == 100


def tiff(kinds):
    out, at = b"II*\0" + struct.pack("<I", 8), 8
    for k, kind in enumerate(kinds):
        size = 2 + 12 * 3 + 4
        entries = b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in ((254, kind), (256, 800), (257, 600)))
        out += struct.pack("<H", 3) + entries + struct.pack("<I", at + size if k + 1 < len(kinds) else 0)
        at += size
    return out


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\0\0\0"
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 2 >>\n2 0 obj << /Type /Page >>\n3 0 obj << /Type /Page >>"
    for name, data in (("a.tif", tiff([0, 1, 0])), ("b.TIFF", tiff([1, 4])), ("c.png", png), ("d.pdf", pdf), ("e.jpg", b"junk"), ("f.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    files, others = images.read_files(spark, str(tmp_path))
    got = {r.name: r.n for r in files.select("name", images.content_pages(images.frames_of("content")).alias("n")).collect()}
    assert got == {"a.tif": 2, "b.TIFF": 2, "c.png": 1, "d.pdf": 2, "e.jpg": 1} and others == 1
    pages = images.page_table(files).orderBy("path", "page_no").collect()
    assert [(r.stem, r.frame, r.width) for r in pages if r.name in ("a.tif", "c.png")] == [("a_page_0001", 0, 800), ("a_page_0002", 2, 800), ("c", 0, 640)]
    assert images.page_table(files, 1).count() == 5
    with pytest.raises(FileNotFoundError):
        images.read_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        images.read_files(spark, str(tmp_path / "f.txt"))


def test_report(spark, tmp_path):
    (tmp_path / "gt").mkdir(), (tmp_path / "cache").mkdir()
    texts = {"a": ("we met at the mill today", "we net at the mill"), "b": ("Ash Fenn Moor", "fenn. Ash Bank"), "c": ("hard to read", "x y z"), "d": ("no reading", None), "e": (None, "no truth")}
    head = "id,image,type,subtype,era,difficulty,mode,source\n"
    modes = {"a": ("letter", "medium", ""), "b": ("map", "n/a", "spotting"), "c": ("letter", "ceiling", "sequential"), "d": ("letter", "medium", ""), "e": ("letter", "medium", "")}
    (tmp_path / "manifest.csv").write_text(head + "".join(f"{k},{k}.png,{t},,1900,{d},{m},s\n" for k, (t, d, m) in modes.items()))
    for k, (ref, hyp) in texts.items():
        if ref:
            (tmp_path / "gt" / f"{k}.txt").write_text(ref)
        if hyp:
            (tmp_path / "cache" / f"{k}.one.txt").write_text(hyp)
    docs = report.score(report.corpus(spark, str(tmp_path), "one"))
    by = {r.id: r for r in docs.collect()}
    assert (by["a"].word_errors, by["a"].sub, by["a"].deletions, by["a"].ins, by["a"].n_ref) == (2, 1, 1, 0, 6) and by["b"].matched == 2 and round(by["b"].f1, 4) == 0.6667
    assert by["d"].missing == "hypothesis" and by["e"].missing == "ground truth" and by["c"].ceiling
    lines = [r.line for r in report.report_lines(docs).orderBy("part", "key").collect()]
    assert lines[0] == "Transcription accuracy: 3 scored, 2 skipped" and "WER 33.3%" in lines[1] and "F1 66.7%" in lines[3] and lines[4].endswith(": 1") and lines[-1] == "  skipped e: no ground truth"
    import json

    js = {r.id: json.loads(r.json) for r in report.doc_json(docs).collect()}
    assert js["a"]["wer"] == 0.3333 and "precision" not in js["a"] and js["b"]["precision"] == 0.6667 and "wer" not in js["b"]
    assert report.score(report.corpus(spark, str(tmp_path), "none")).where("missing is null").count() == 0


def test_display_and_batches(spark):
    assert [one(spark, display.upload_size(F.lit(n))) for n in (None, 812, 3 * 1024 + 256, 10240)] == ["0 B", "812 B", "3.3 KB", "10 KB"]
    assert [one(spark, display.byte_size(F.lit(n))) for n in (0, 1023, 1280, 1 << 31)] == ["0 B", "1023 B", "1.2 KB", "2.0 GB"]
    assert [one(spark, display.cost_text(F.lit(c).cast("double"))) for c in (None, 0.123, 1.0)] == ["", "12.3¢", "$1.00"]
    n = [one(spark, display.estimate_text(F.lit(2), F.lit(1200), F.lit(c), F.lit(lo).cast("double"), F.lit(hi).cast("double"), F.lit(5), F.lit(7000))) for c, lo, hi in ((0, None, None), (2, 0.5, 2.0), (2, None, None))]
    assert n == ["No API cost for these 2 file(s).", "Estimated cost 50.0¢ to $2.00 for 1,200 page(s).", "Estimated 5 to 7,000 tokens for 1,200 page(s)."]
    mb = 1 << 20
    files = spark.createDataFrame([(1, k, s) for k, s in enumerate([200 * mb, 100 * mb, 300 * mb, None, *[1] * 21])], "u long, f long, s long")
    got = {r.f: r.batch for r in batch.upload_batches(files, "u", "f", "s").collect()}
    assert [got[k] for k in range(4)] == [0, 1, 2, 3] and got[22] == 3 and got[23] == 4
    with pytest.raises(ValueError):
        batch.downloads(files, "f", ("png",))


def test_estimate_keeps_null_models(spark):
    files = spark.createDataFrame([(1, None, "two_pass", 3), (2, "scribe-lite", None, None)], "file_id long, model string, mode string, n_pages int")
    got = usage.estimate(files, spark.createDataFrame([], "file_id long, tokens long"), usage.price_catalog(spark)).collect()
    assert {(r.model, r.mode, r.pages, r.output_low, r.cost_low) for r in got} == {(None, "two_pass", 3, 9000, None), ("scribe-lite", None, 1, 0, None)}

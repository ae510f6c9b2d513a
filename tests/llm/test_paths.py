"""The ways taken where a dictionary is too large to be sent give the same as sending it; every problem's query end to end."""

import os
import re

import pytest
from pyspark.sql import functions as F

from leafscan import llm
from leafscan.llm import noise, personal, truncation

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")


@needs_data
def test_words_joined_by_page(spark):
    lines = spark.read.parquet(f"{SMALL}/transcribed_lines.parquet").select("page_id", "line_id", "line_no", "text")
    a, b = noise.repaired(spark, SMALL, lines), noise.repaired(spark, SMALL, lines, sent=0)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_names_joined_by_page(spark):
    text = "Mrs. Edith Harrow kept it, and Harrow, Edith wrote on.\n\nMr. Har-\nrow came; E. Harrow saw the house."
    rows = [(k, text, 9) for k in range(4)] + [(9, None, 1), (10, "", 1), (11, "no name here", 1)]
    pages = spark.createDataFrame(rows, "page_id long, plain_text string, n_lines int").where("plain_text <> ''")
    names, hints = personal.learn_names(pages)
    a, b = (personal.candidate_spans(pages, names, hints, sent) for sent in (1000, 0))
    assert a.where("kind = 'name'").count() >= 12 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_masking_by_place():
    text = "The fern and Fern.\n\nMrs.  Fern\nsaid so; fern again."
    paras = personal.paragraphs(text)
    spans = [(0, paras[0].index("Fern."), 4, "[NAME]"), (1, paras[1].index("Fern"), 4, "[NAME]")]
    assert personal.redacted(text, spans) == "The fern and [NAME].\n\nMrs.  [NAME]\nsaid so; fern again."
    long = [(1, paras[1].index("Fern said"), 9, "[X]")]
    assert personal.redacted(text, long) == "The fern and Fern.\n\nMrs.  [X] so; fern again."


def test_a_labeler_that_is_wrong_counts_against(spark):
    rows = [((1, 1, 1, 1, 0), 500), ((1, 1, 1, 0, 0), 100), ((-1, -1, -1, 1, 0), 900), ((-1, -1, -1, 0, 0), 100), ((0, 0, 0, 1, 0), 10), ((0, 0, 0, 0, 0), 10)]
    post, right = personal.reliabilities(rows)
    assert right[3] < 0.5 and post[0, 0, 0, 1, 0] < post[0, 0, 0, 0, 0]


def test_last_trigrams_against_brute_force(spark):
    texts = ["the old house stood", "the old house fell", "a", "ab", "abc d", "the old h", "xy", None, ""]
    counts = truncation.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    ends = ["the old house st", "the old h", "a", "ab", "the old ho", "zz", "the o", "abc"]
    last = truncation.finals(spark.createDataFrame([(t,) for t in ends], "body string"))
    got = {(r.w1, r.w2, r.w3): (r.n, r.own, r.ended) for r in truncation.met(last, counts).collect()}
    tri = [(tuple(w[k : k + 3]), k == len(w) - 3) for w in (["", "", *t.split()] for t in texts if t) for k in range(len(w) - 2)]
    for e in ends:
        a, b, c = (["", "", *e.split()])[-3:]
        hit = [(t, end) for t, end in tri if t[:2] == (a, b) and t[2].startswith(c)]
        want = (len(hit), sum(t[2] == c for t, _ in hit), sum(end for t, end in hit if t[2] == c))
        assert got.get((a, b, c), (0, 0, 0)) == want


@needs_data
@pytest.mark.parametrize("name", sorted(k for k in llm.queries() if re.match(r"p[1-5]_", k)))
def test_queries_end_to_end(spark, name):
    got = llm.queries()[name](spark, SMALL)
    assert got.count() > 0
    if name.endswith("_found"):
        assert got.count() == got.distinct().count() and not got.where(F.greatest(*(F.col(c).isNull().cast("int") for c in got.columns)) > 0).count()

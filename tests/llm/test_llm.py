"""The operators for training text on small cases: nulls, empty, long, repeated and tied rows, clashing columns, empty tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscan.llm import languages, lookalike, noise, packing, personal, splitting, tokens, truncation
from leafscan.llm.tokenizer import transducer, utf8_stream

VOCAB = tokens.vocabulary()
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files")


# 1
def test_alike_forms(spark):
    rows = [(1, "naïve café"), (2, "naïve café"), (3, "nаïve c​afé"), (4, "naive cafe"), (5, None), (6, ""), (7, "x" * 50_000), (1, "naïve café")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("canonical", F.lit("clash"))
    got = {r.id: r.canonical for r in lookalike.canonical(df, "text").collect()}
    assert got[1] == got[2] == got[3] == "naïve café" and got[4] == "naive cafe" and got[5] is None and got[6] == ""
    assert lookalike.canonical(df, "text").count() == len(rows)
    assert lookalike.canonical(df.limit(0), "text").count() == 0


def test_alike_pairs_against_brute_force(spark):
    rng = random.Random(3)
    kinds = ["house", "hоuse", "hou‍se", "House", "houſe", "hοuse", "ﬁeld", "field", "a b", "a b", "a-b", "a‐b", "a¬", "", None]
    left = [(k, rng.randint(1, 3), rng.choice(kinds)) for k in range(60)]
    right = [(1000 + k, rng.randint(1, 3), rng.choice(kinds)) for k in range(60)]
    schema = "id long, page_id long, text string"
    got = {tuple(r) for r in lookalike.alike_pairs(spark.createDataFrame(left + left[:5], schema), spark.createDataFrame(right, schema), "page_id").collect()}
    want = {(a, b) for a, p, x in left for b, q, y in right if p == q and x and y and x != y and lookalike.form(x) == lookalike.form(y)}
    assert got == want and want
    empty = spark.createDataFrame([], schema)
    assert lookalike.alike_pairs(empty, empty, "page_id").count() == 0


# 2
def make_words():
    base = {"the": 500, "house": 300, "schoolmaster": 200, "post-office": 90, "office": 5, "old": 200, "note": 3, "notebook": 80, "kept": 100}
    forms = {noise.skeleton_of(w): (w, n) for w, n in base.items()}
    return noise.Words(base, {("the", "house"): 50, ("old", "house"): 20, ("the", "schoolmaster"): 90}, forms)


def test_noise_of_a_page():
    r = noise.Repair(make_words(), {"themossfordregister"}, {"printed at the mossford steam press"})
    page = ["THE MOSSFORD REGISTER", "the hou5e the scho-", "olmaster kept the note", "book. The post-", "office old h|ouse in l867", "41", "", None, "Printed at the Mossford Steam Press", "— 7 —"]
    got = r.page(page, {})
    assert [k for k, m in enumerate(got) if m[0]] == [0, 8, 9]
    assert [k for k, m in enumerate(got) if m[1]] == [1, 2]
    assert [k for k, m in enumerate(got) if m[2]] == [1, 4]
    assert "house" in got[1][3] and "1867" in got[4][3]


def test_masks():
    assert noise.mask("Page 12 / 30") == "page #/ #" and noise.mask("— 7 —") == noise.mask("— 19 —") and noise.mask("cxii") == "#"
    assert noise.mask("very") == "very"


def test_skeleton_in_sql_and_python(spark):
    ws = ["clerk", "derk", "Modern", "modem", "hou5e", "lib\\rary", "ñu", ""]
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    assert [r.s for r in df.select(noise.skeleton(F.col("w")).alias("s")).collect()] == [noise.skeleton_of(w) for w in ws]


# 3
def test_suspects(spark):
    texts = [("the old house stood near the mill",), ("the old house stood near the mill",), ("a b",), ("",), (None,)]
    counts = truncation.trigram_counts(spark.createDataFrame(texts, "text string"))
    schema = "id long, body string, c string"
    got = truncation.suspects(spark.createDataFrame([(1, "the old hou", "x"), (2, "near the mill", "x"), (3, "the old house", "x"), (4, None, "x"), (5, "", "x"), (6, "zzz", "x"), (7, "the o", "x"), (7, "the o", "x")], schema), counts)
    assert sorted(r.id for r in got.collect()) == [1, 3, 7, 7]


# 4
def test_personal_spans():
    names = personal.Names({"Harrow", "Fontana"}, {"Edith", "Anselmo"})
    text = "Write to m-fern (at) old-maps.test soon. Tel. +44 1632 960\n619 (ask).\n\nMrs. Edith B. Harrow kept it; FONTANA, Anselmo too. Receipt no. 192482. Passport NT\n0649929 was shown. Lodged at 58B Saddlers Court."
    got = {(k, v) for _, k, v, *_ in personal.spans_of(text, names)}
    assert {("email", "m-fern (at) old-maps.test"), ("phone", "+44 1632 960 619"), ("name", "Edith B. Harrow"), ("name", "FONTANA, Anselmo"), ("id", "NT 0649929"), ("address", "58B Saddlers Court")} <= got
    assert not any(k == "phone" and "192482" in v for k, v in got)
    assert personal.spans_of("", names) == [] and personal.spans_of(" \n\n ", names) == []


def test_reliabilities():
    post, right = personal.reliabilities([((1, 1, 0, 0, 0), 80), ((0, 0, -1, -1, 0), 50), ((1, 0, 0, 0, 0), 20), ((0, 0, 0, -1, 0), 5)])
    assert post[1, 1, 0, 0, 0] > 0.9 > 0.1 > post[0, 0, -1, -1, 0] and personal.reliabilities([])[0] == {}


# 5
def test_languages():
    eng = ["The old house stood near the river and the keeper kept the keys of the house."] * 3
    deu = ["Das alte Haus stand am Fluss und der Wärter behielt die Schlüssel des Hauses."] * 3
    m = languages.train([(t, {"eng"}) for t in eng] + [(t, {"deu"}) for t in deu])
    seg = languages.segments("PAGE HEADER\n\nThe keeper stood near the house.\n\nDer Wärter stand am Hause.\n\n12", m)
    assert [s[0] for s in seg] == ["eng", "deu"] and all(s[4] for s in seg)
    known = languages.spellings([("frk", "German in broken type", "deu")])
    assert languages.read_label(" Deu+en-EN ", known) == {"deu", "eng"} and languages.read_label("frk", known) == {"deu"}
    assert languages.read_label(None, known) == languages.read_label("auto", known) == set()


# 6
@needs_vocab
def test_encoding_equals_library(spark):
    import base64

    import tiktoken

    t = transducer(VOCAB)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    pat = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    lib = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "the", " ", "\n", "é", "é", "中", "\U0001f600", "'s", "12", "  ", "ing", "<|endoftext|>", " ", "."]
    for _ in range(400):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert t.encode(s) == lib.encode_ordinary(s) and t.decode(t.encode(s)) == s
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x" * 20_000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = tokens.encode(df).collect()
    assert len(got) == 5 and [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert {r.text for r in tokens.decode(tokens.encode(df)).collect()} == {"a b", "", "x" * 20_000}


def test_utf8_stream():
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        cut = rng.randint(0, len(data))
        assert "".join(utf8_stream([data[:cut], data[cut:]])) == data.decode("utf-8", "replace")


# 7
def test_packing(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 3, 50, 77, 100, 120, 260, None])) for k in range(500)] + [(7, 50), (None, 5)]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.pack(sized, [(1, 100), (2, 128)], shard_items=200).toPandas()
    for limit, cap in ((1, 100), (2, 128)):
        g = got[got.limit_id == limit]
        assert (g.groupby("container_id").n_tokens.sum() <= cap).all() and g.doc_id.nunique() == 500
        whole = g.groupby("doc_id").n_tokens.agg(["sum", "count"])
        assert all(c == 1 for s, c in whole.values if s <= cap)
    assert packing.pack(sized.limit(0), [(1, 10)]).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 11, 200)
    got = packing.sum_of_squares(items, 10)
    room: list[int] = []
    for s, b in zip(items.tolist(), got.tolist(), strict=True):
        def cost(rooms):
            c = np.bincount([r for r in rooms if 0 < r < 10], minlength=11)
            return int((c**2).sum())

        options = [cost([r - s if k == j else r for k, r in enumerate(room)]) for j in range(len(room)) if room[j] >= s] + [cost([*room, 10 - s])]
        if b == len(room):
            room.append(10)
        room[b] -= s
        assert room[b] >= 0 and cost(room) == min(options)


# 8
@needs_vocab
def test_splitting_against_greedy(spark):
    text = ("One sentence here. Another one follows it!\n\n" * 40) + "nospaces" * 300
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "doc_id long, text string").withColumn("ids", F.lit(0))
    pieces = splitting.split(docs, [(1, 60, 7), (2, 40, 0)], VOCAB).toPandas().sort_values(["limit_id", "piece_no"])
    ids = transducer(VOCAB).encode(text)
    for limit, most, overlap in ((1, 60, 7), (2, 40, 0)):
        g = pieces[pieces.limit_id == limit]
        assert set(g.doc_id) == {1} and (g.n_tokens <= most).all()
        kinds = splitting.boundary_kinds(text.encode(), np.concatenate(([0], np.cumsum([len(transducer(VOCAB).tokens[i]) for i in ids]))))
        end, nxt = splitting.successors(splitting.last_places(kinds), most, overlap, np.full(len(kinds), len(ids), np.int32))
        want, at = [], 0
        while at < len(ids):
            want.append((at, int(end[at])))
            at = int(nxt[at])
        assert list(zip(g.start_token, g.end_token, strict=True)) == want
        assert all(list(i) == ids[a:e] for i, a, e in zip(g.ids, g.start_token, g.end_token, strict=True))
    with pytest.raises(ValueError):
        splitting.split(docs, [(1, 5, 5)], VOCAB)


@needs_vocab
def test_pieces_hold_whole_characters(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("中文字汉語\U0001f600\U0001f9ffé a\n。") for _ in range(n)) for n in (30, 400, 900)] + ["word " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = transducer(VOCAB)
    for most, overlap in ((50, 7), (64, 0), (40, 13)):
        got = splitting.split(docs, [(1, most, overlap)], VOCAB).orderBy("doc_id", "piece_no").collect()
        for d, text in enumerate(texts):
            own, ids = [r for r in got if r.doc_id == d], t.encode(text)
            assert bool(own) == (len(ids) > most)
            if own:
                assert own[0].start_token == 0 and own[-1].end_token == len(ids)
                assert all(x.end_token - y.start_token == overlap for x, y in zip(own, own[1:], strict=False))
                assert all(r.ids == ids[r.start_token : r.end_token] and r.n_tokens <= most and "\ufffd" not in r.text and t.decode(r.ids) == r.text for r in own)

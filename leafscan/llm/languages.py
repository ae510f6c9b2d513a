"""Problem 5: the language of each page and of each stretch of it, by words first and shorter and shorter n-grams after.

A word that is known is scored by its log frequency in each language; of an unseen one, the longest n-grams (5 signs down to 1)
that are known are. Frequencies are learnt from documents whose label can be read, in two rounds: the second leaves
out documents whose text disagrees with their label.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.session import table

#: The languages of answers, and other spellings of their names and codes.
LANGUAGES = ("eng", "deu", "fra", "spa", "por", "ita", "nld", "swe", "lat", "rus")
SPELLINGS = {
    "eng": "en english englisch anglais ingles inglese engels engelska",
    "deu": "de ger german deutsch allemand aleman tedesco duits tyska frk",
    "fra": "fr fre french francais franzosisch frances francese frans franska",
    "spa": "es spanish espanol castellano espagnol spanisch spagnolo spaans",
    "por": "pt portuguese portugues portugais portugiesisch portoghese",
    "ita": "it italian italiano italien italienisch italiaans",
    "nld": "nl dut dutch nederlands niederlandisch neerlandais holland hollandais",
    "swe": "sv swedish svenska schwedisch suedois zweeds",
    "lat": "la latin latina latein lateinisch latinum",
    "rus": "ru russian russkij russisch russe russo русский",
}
#: Documents that are learnt from, of each language; the ones with the smallest hash of their id. A bound of the sample, not of the result.
PER_LANGUAGE = 400
#: tess_languages is a fixed table of 16 rows; with more rows than this it is refused.
MAX_CODES = 1_000
MAX_GRAM = 5
WORD = re.compile(r"[^\W\d_]+")
PARAGRAPH = re.compile(r"\n[ \t]*\n")
SENTENCE = re.compile(r"[.!?…](?=\s|$)")
HYPHEN_END = re.compile(r"[-\u2010\u00ad\u00ac\u2e17=] *\n")
#: A stretch with less confidence takes the rest of its page into account.
SURE = 0.95


def plain(text: str) -> str:
    """Lower case without accents, for labels."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def spellings(codes: list[tuple[str, str, str | None]] = ()) -> dict[str, str]:
    """spelling -> language; codes: rows (code, name, names_lang) of tess_languages."""
    out = {s: lang for lang, names in SPELLINGS.items() for s in [lang, *names.split()]}
    for code, name, lang in codes:
        if lang in LANGUAGES:
            out[plain(code)] = out[plain(name)] = lang
    return out


def read_label(label: str | None, known: dict[str, str]) -> set[str]:
    """Languages that a label names: several joined by + or another sign, with a region or script after - or _."""
    out = set()
    for part in re.split(r"[+,;/&|\s]+", plain(label or "")):
        lang = known.get(part) or known.get(re.split(r"[-_.]", part)[0])
        if lang:
            out.add(lang)
    return out


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, texts: dict[str, list[str]]):
        langs = [x for x in LANGUAGES if texts.get(x)]
        self.langs = langs
        words = [Counter(w for t in texts[x] for w in WORD.findall(t.lower())) for x in langs]
        self.words = self._table(words, least=2)
        grams = [Counter() for _ in langs]
        for c, g in zip(words, grams, strict=True):
            for w, k in c.items():
                s = f" {w} "
                for n in range(1, MAX_GRAM + 1):
                    for i in range(len(s) - n + 1):
                        g[s[i : i + n]] += k
        self.grams: list[dict[str, np.ndarray]] = []
        for n in range(1, MAX_GRAM + 1):
            self.grams.append(self._table([Counter({s: k for s, k in g.items() if len(s) == n}) for g in grams], least=2))
        self.cache: dict[str, np.ndarray] = {}

    def _table(self, counts: list[Counter], least: int) -> dict[str, np.ndarray]:
        """item -> its log frequencies, relative to the mean over languages; what a language lacks counts as half."""
        total = [math.log(sum(c.values()) + 1) for c in counts]
        seen: dict[str, int] = defaultdict(int)
        for c in counts:
            for k, n in c.items():
                seen[k] += n
        out = {}
        for k, n in seen.items():
            if n >= least:
                v = np.array([math.log(c.get(k, 0) + 0.5) - t for c, t in zip(counts, total, strict=True)])
                out[k] = (v - v.max()).clip(-7.0)
        return out

    def score(self, word: str) -> np.ndarray:
        """Scores of one lower-case word, backing off to shorter n-grams where it is unknown."""
        v = self.words.get(word)
        if v is None:
            v = self.cache.get(word)
        if v is None:
            s = f" {word} "
            v = np.zeros(len(self.langs))
            for n in range(MAX_GRAM, 0, -1):
                hits = [self.grams[n - 1][s[i : i + n]] for i in range(len(s) - n + 1) if s[i : i + n] in self.grams[n - 1]]
                if hits and (2 * len(hits) >= len(s) - n + 1 or n == 1):  # half of its n-grams are known
                    v = np.mean(hits, axis=0) * 0.7
                    break
            if len(self.cache) < 200_000:
                self.cache[word] = v
        return v

    def probabilities(self, text: str) -> tuple[np.ndarray, int]:
        """(probability of each language, number of words) of a text."""
        words = WORD.findall(text.lower())
        if not words:
            return np.full(len(self.langs), 1 / max(1, len(self.langs))), 0
        total = np.sum([self.score(w) for w in words], axis=0)
        e = np.exp(total - total.max())
        return e / e.sum(), len(words)


def train(rows: list[tuple[str, set[str]]]) -> Model:
    """A model from (text, languages of its label); only texts with one language are learnt from, in two rounds."""
    rows = [(t, next(iter(s))) for t, s in rows if len(s) == 1 and t]
    model = None
    for _ in range(2):
        texts: dict[str, list[str]] = defaultdict(list)
        for t, lang in rows:
            if model is not None:
                p, n = model.probabilities(t)
                if n < 5 or model.langs[int(p.argmax())] != lang:
                    continue
            texts[lang].append(t)
        model = Model(texts)
    return model


def sample(docs: DataFrame, known: dict[str, str], per_language: int = PER_LANGUAGE) -> list[tuple[str, set[str]]]:
    """(text, languages) of per_language documents of each label that names a language; at most that many come to the driver."""
    only = F.udf(lambda x: next(iter(s)) if len(s := read_label(x, known)) == 1 else None, "string", useArrow=True)
    labels = docs.select("lang").where("lang is not null").distinct().withColumn("l", only("lang")).where("l is not null")
    labelled = docs.where(F.length("text") >= 40).select("doc_id", "lang").join(labels, "lang").select("doc_id", "l")
    # Smallest hashes of each language: a bounded top-k, computed partition by partition.
    hashed = labelled.select("l", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id").alias("x"))
    part = hashed.groupBy("l", F.spark_partition_id().alias("p")).agg(F.sort_array(F.collect_set("x")).alias("xs"))
    small = part.select("l", F.slice("xs", 1, per_language).alias("xs"))
    top = small.groupBy("l").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("xs")))), 1, per_language).alias("xs"))
    ids = [x.doc_id for r in top.collect() for x in r.xs]
    rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text", "lang").distinct().collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(r.text, read_label(r.lang, known)) for r in rows]


def body_paragraphs(text: str) -> list[str]:
    """Paragraphs of a page without running headers, footers and page numbers.

    These stand alone at the top or bottom, in one line: without a sentence, in capitals, or with hardly any letters.
    """
    parts = [p.strip() for p in PARAGRAPH.split(text) if p.strip()]

    def furniture(p: str) -> bool:
        if "\n" in p:
            return False
        letters = sum(c.isalpha() for c in p)
        words = [w for w in re.split(r"[^\w]+", p) if w]
        if letters < 5 or p.upper() == p or sum(len(w) == 1 for w in words) >= 0.6 * len(words):  # also letters set apart
            return True
        if not SENTENCE.search(p) and len(words) <= 8:
            return True
        big = sum(w[0].isupper() or w[0].isdigit() for w in words)
        return len(words) <= 9 and big >= 0.75 * len(words)

    for _ in range(2):
        if len(parts) > 1 and furniture(parts[0]):
            parts.pop(0)
        if len(parts) > 1 and furniture(parts[-1]):
            parts.pop()
    return parts


def segments(text: str, model: Model) -> list[tuple[str, float, str, int, bool]]:
    """(language, confidence, text, words, holds a whole sentence) of each stretch, neighbours of one language joined."""
    out: list[list] = []
    parts = []
    for p in body_paragraphs(text):
        joined = HYPHEN_END.sub("", p).replace("\n", " ")
        parts.append((p, joined, *model.probabilities(joined)))
    sure = sum((probs * n for _, _, probs, n in parts if probs.max() >= SURE), np.zeros(len(model.langs)))
    for p, joined, probs, n in parts:
        if probs.max() < SURE and sure.any():  # a few words that fit several languages: the page's main one
            probs = probs * sure / sure.sum() + 1e-6
            probs = probs / probs.sum()
        lang, conf = model.langs[int(probs.argmax())], float(probs.max())
        ends = [m.end() for m in SENTENCE.finditer(joined)]
        starts = [0, *ends]
        whole = any(len(WORD.findall(joined[a:b])) >= 3 and joined[a:b].strip()[:1].isupper() for a, b in zip(starts, ends, strict=False))
        if out and out[-1][0] == lang:
            last = out[-1]
            last[1] = (last[1] * last[3] + conf * n) / max(1, last[3] + n)
            last[2], last[3], last[4] = last[2] + "\n\n" + p, last[3] + n, last[4] or whole
        else:
            out.append([lang, conf, p, n, whole])
    return [tuple(x) for x in out]


SEGMENTS = "page_id long, file_id long, seg_no int, lang string, confidence double, text string, n_words int, whole boolean, words_page int"


def page_segments(pages: DataFrame, model: Model) -> DataFrame:
    """Stretches of plain_text of each page (page_id, file_id), each with a language and a confidence.

    Null, empty and blank texts give no row; copies of a page are kept. No shuffle; the model is sent once to each executor.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # learnt from at most PER_LANGUAGE documents of 10 languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for page_id, file_id, text in zip(b["page_id"], b["file_id"], b["plain_text"], strict=True):
                if text and text.strip() and m.langs:
                    found = segments(text, m)
                    total = sum(s[3] for s in found)
                    rows += [(page_id, file_id, k, *s, total) for k, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return pages.where("page_id is not null").select("page_id", F.coalesce("file_id", F.lit(-1)).cast("long").alias("file_id"), "plain_text").mapInPandas(run, SEGMENTS)


def learnt(spark: SparkSession, sf_dir: str) -> tuple[Model, dict[str, str]]:
    codes = table(spark, sf_dir, "tess_languages", "code", "name", "names_lang").distinct().limit(MAX_CODES + 1).collect()
    if len(codes) > MAX_CODES:
        raise ValueError("tess_languages is meant to be a small table")
    known = spellings([tuple(r) for r in codes])
    return train(sample(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), known)), known


def page_languages(spark: SparkSession, sf_dir: str, text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    model, known = learnt(spark, sf_dir)
    seg = page_segments(table(spark, sf_dir, "page_results", "page_id", "file_id", "plain_text"), model)
    return seg, known


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, known = page_languages(spark, sf_dir)
    langs = seg.groupBy("page_id", "file_id", "lang").agg(
        F.max("whole").alias("whole"), F.sum("n_words").alias("n"), F.max("words_page").alias("total")
    )
    langs = langs.where("whole OR 2 * n > total").select("page_id", "file_id", "lang")
    jobs = table(spark, sf_dir, "job_settings", "job_id", "tesseract_language").distinct()
    labels = F.udf(lambda x: sorted(read_label(x, known)), "array<string>", useArrow=True)
    jobs = jobs.select("job_id", labels("tesseract_language").alias("named"))
    files = table(spark, sf_dir, "file_results", "file_id", "job_id").distinct()
    named = files.join(jobs, "job_id", "left").groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_list("named"))).alias("named"))
    pages = langs.groupBy("page_id", "file_id").agg(F.collect_set("lang").alias("langs"))
    wrong = pages.join(named, "file_id", "left").where(F.size(F.array_except("langs", F.coalesce("named", F.array()))) > 0)
    return wrong.select("page_id", F.explode("langs").alias("lang")).distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every page: its language, confidence, text and number of words."""
    seg, _ = page_languages(spark, sf_dir)
    return seg.select("page_id", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "n_words", "text").distinct()


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main language, with the share of its words and the mean confidence."""
    seg, _ = page_languages(spark, sf_dir)
    by = seg.select("page_id", "seg_no", "lang", "confidence", "n_words", "words_page").distinct()
    by = by.groupBy("page_id", "lang").agg(
        F.sum("n_words").alias("n"), F.max("words_page").alias("total"), F.sum(F.col("confidence") * F.col("n_words")).alias("c")
    )
    best = F.max_by(F.struct("lang", "n", "total", "c"), F.struct(F.col("n"), F.col("lang"))).alias("b")
    return by.groupBy("page_id").agg(best).select(
        "page_id", "b.lang", F.round(F.col("b.n") / F.greatest(F.col("b.total"), F.lit(1)), 6).alias("share"),
        F.round(F.col("b.c") / F.greatest(F.col("b.n"), F.lit(1)), 6).alias("confidence"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_segments": p5_segments, "p5_pages": p5_pages}
ORACLE: dict[str, str] = {}

"""Problem 2: traces of printing and scanning. Running headers and page numbers, words split at line ends, misread words.

Words are grouped by a skeleton in which glyphs that scanners confuse are one; the frequent form of a skeleton replaces
rare ones where its neighbours support it. Headers and footers are found by their text with digits masked. Lines are then
joined into paragraphs by windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafscan.llm.lookalike import form, mapped, salted
from leafscan.session import table, written

# Glyphs that scanners confuse. First one sign drawn as two, then classes of single signs.
PAIRS = (("d", "cl"), ("w", "vv"), ("m", "rn"), ("b", "h"), ("h", "li"))
CLASSES = ("ceé6", "oa0àá", "1ilftI", "nuñ", "s5", "gq9", "нп", "ос")
STRAY = "|^_*~\\"
HYPHEN_MARKS = "-‐‑﹣－­¬⸗="

CLASSES_OF = {x: "".join(c for c in CLASSES if x in c) for x in "".join(CLASSES)}

#: Words and word pairs seen so often are known.
SEEN = 2
#: Words and pairs that an executor is sent at most; with more, each page brings its own ones, by joins.
WORDS_SENT = 2_000_000
#: A form is a misreading of another one of its skeleton that is this many times as frequent.
TIMES = 8
#: A masked edge line found on so many pages is a header or footer.
PAGES = 3


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    a, b = "", ""
    for c in CLASSES:
        a, b = a + c[1:], b + c[0] * (len(c) - 1)
    return a, b


def skeleton(word: Column) -> Column:
    """The word in lower case with confusable glyphs made one and stray signs taken out."""
    out = F.translate(F.lower(word), STRAY, "")
    for one, two in PAIRS:
        out = F.replace(out, F.lit(one), F.lit(two))
    return F.translate(out, *_classes())


def skeleton_of(word: str) -> str:
    out = word.lower()
    for c in STRAY:
        out = out.replace(c, "")
    for one, two in PAIRS:
        out = out.replace(one, two)
    return out.translate(str.maketrans(*_classes()))


EDGES = "^[^\\p{L}\\p{N}|^_*~\\\\]+|[^\\p{L}\\p{N}|^_*~\\\\]+$"


def word_pairs(texts: DataFrame) -> DataFrame:
    """(a, b, n): how often the word b follows a inside a line of column text, in lower case without edge punctuation.

    First and last words of a line, which may be pieces, are left out; a is '' for the first word that counts.
    Null and blank texts count nothing.
    """
    words = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, EDGES, "")), lambda w: w != "")
    inner = texts.select(words.alias("w")).where(F.size("w") > 2)
    inner = inner.select(F.slice("w", F.lit(2), F.size("w") - 2).alias("w"))
    pair = F.arrays_zip(F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.size("w") - 1)).alias("a"), F.col("w").alias("b"))
    rows = inner.select(F.explode(pair).alias("p"))
    names = rows.schema["p"].dataType.names
    rows = rows.select(F.col("p").getField(names[0]).alias("a"), F.col("p").getField(names[1]).alias("b"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


class Words:
    """What the corpus knows: frequent words and pairs, and each skeleton's most frequent form."""

    def __init__(self, known: dict[str, int], pairs: dict[tuple[str, str], int], forms: dict[str, tuple[str, int]]):
        self.known, self.pairs, self.forms = known, pairs, forms
        self.heads: dict[str, int] = {}  # of a compound with hyphens: what stands before each of them
        for w, n in known.items():
            for k, c in enumerate(w):
                if c == "-":
                    self.heads[w[: k + 1]] = max(n, self.heads.get(w[: k + 1], 0))

    @lru_cache(maxsize=200_000)  # noqa: B019
    def right_form(self, word: str) -> str | None:
        """The frequent form that the lower-case word may be a misreading of."""
        best = self.forms.get(skeleton_of(word))
        if best is None or best[0] == word or best[1] < TIMES * self.known.get(word, 0) or len(word) < 3:
            return None
        return best[0]


def words_of(known: list[tuple[str, int]], pairs: list[tuple[str, str, int]]) -> Words:
    """Words from counted words and pairs. The most frequent word of a skeleton is its form, ties by the greater word."""
    forms: dict[str, tuple[str, int]] = {}
    for w, n in known:
        s = skeleton_of(w)
        if len(s) >= 3 and (s not in forms or (n, w) > forms[s][::-1]):
            forms[s] = (w, n)
    return Words(dict(known), {(a, b): n for a, b, n in pairs}, forms)


def learn(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(b, n) of words and (a, b, n) of pairs of the corpus of lines (column text), those seen SEEN times or more at any size of it."""
    pairs = written(word_pairs(lines))
    words = pairs.groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    return written(words), pairs.where(F.col("n") >= SEEN)


# ---------------------------------------------------------------- headers and footers

ROMAN = re.compile(r"\b(?=[ivxlc]+\b)(c{0,3})(x[cl]|l?x{0,3})(i[xv]|v?i{0,3})\b")


def mask(text: str) -> str:
    """An edge line with its numbers masked: digits and roman numerals #, case, spacing and end punctuation levelled."""
    t = re.sub(r"\s+", " ", form(text)).strip().lower()
    if re.fullmatch(r"(?:\w )+(?: ?\w[ .,'-]*)+", t) and sum(len(x) == 1 for x in t.split()) >= 0.7 * len(t.split()):
        t = re.sub(r"\s", "", form(text).lower())  # letters set apart
    t = re.sub(r"[\dlIoOsSB]*\d[\dlIoOsSB]*", "#", t)
    if len(t) < 12 or "#" not in t:
        t = ROMAN.sub("#", t)
    return re.sub(r"(?:# ?)+", "#", t).strip(" .,")


PAGE_NUMBER = re.compile(
    r"[\W_]*#[\W_]*|(?:page|p|pag|pagina|página|seite|s|blz|bladzijde|sid|sida|стр|страница|fol|folio|f|no|nr)[. ]*#( ?[/rv]\.? ?#?)?[\W_]*"
)


def level(title: str) -> str:
    """A title reduced to its letters, for comparing."""
    return re.sub(r"[\W\d_]", "", form(title).lower())


def is_title_like(text: str) -> bool:
    """Looks like a heading rather than a piece of a sentence."""
    t = form(text).strip()
    words = [w for w in re.split(r"[\s]+", t) if any(c.isalpha() for c in w)]
    if not words or len(t) > 80:
        return False
    if t.upper() == t or sum(len(w) == 1 for w in words) >= 0.7 * len(words) > 2:
        return True
    return t[0].isupper() and not re.search(r"[.,;:!?](['\"]?$| )", t) and len(words) <= 9 or t[0].isdigit() and is_title_like(re.sub(r"^\d+\s*", "", t))


EDGES_OUT = "page_id long, file_id long, page_no int, top array<string>, alone boolean, m string, known boolean, last string"
BLANK_LINE = re.compile(r"\n[ \t]*\n")
TOP_ALONE = re.compile(r"\s*[^\n]+\n[ \t]*\n")


def page_edges(pages: DataFrame, titles: set[str]) -> DataFrame:
    """First and last lines of pages (page_id, file_id, page_no, plain_text): top, the first three; alone, is the first one followed by a
    blank line; m, its mask if it looks like a title; known, is it a series' title; last, the mask of a line that stands alone at the
    end. A page counts once."""
    names = [c.split()[0] for c in EDGES_OUT.split(", ")]
    s, i64 = pa.string(), pa.int64()
    types = [i64, i64, pa.int32(), pa.list_(s), pa.bool_(), s, pa.bool_(), s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, file, no, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                lines = [x for x in text.split("\n") if x.strip()]
                blocks = BLANK_LINE.split(text) if lines else []
                end = blocks[-1] if len(blocks) > 1 and "\n" not in blocks[-1] and not blocks[-1][:1].islower() else ""
                title = mask(lines[0]) if lines and is_title_like(lines[0]) else None
                rows.append((page, file, no, lines[:3], TOP_ALONE.match(text) is not None, title, any(level(x) in titles for x in lines[:2]), mask(end) or None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    src = pages.where("page_id is not null").select("page_id", "file_id", F.col("page_no").cast("int").alias("page_no"), "plain_text")
    return src.mapInArrow(run, EDGES_OUT).dropDuplicates(["page_id"])


def footers_of(edges: DataFrame, least: int = PAGES) -> DataFrame:
    """(m, shape) of masks of footers: lines that stand alone at the end of at least so many pages, and mostly more than once in a file."""
    counts = edges.where("last is not null").groupBy("file_id", "last").agg(F.count("*").alias("n"))
    counts = counts.groupBy("last").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"))
    found = counts.where((F.col("n") >= least) & (2 * F.col("again") >= F.col("n")))
    return found.select(F.col("last").alias("m"), F.when(F.length("last") > 12, skeleton(F.col("last"))).alias("shape"))


def feet_of(lines: DataFrame, footers: DataFrame) -> DataFrame:
    """(page_id, foot): JSON of those masks of a page's last two lines (page_id, line_id, line_no, text) that are footers."""
    masked = F.udf(mask, "string", useArrow=True)
    back = W.partitionBy("page_id").orderBy(F.col("line_no").desc(), F.col("line_id").desc())
    rows = lines.where("trim(text) <> ''").dropDuplicates(["page_id", "line_id"]).withColumn("r", F.row_number().over(back)).where("r <= 2")
    feet = rows.select("page_id", masked("text").alias("m")).distinct()
    same = salted(feet, footers.select("m"), ["m"], "inner", "page_id")
    shaped = feet.where("length(m) > 12").withColumn("shape", skeleton(F.col("m")))
    same = same.unionByName(salted(shaped, footers.where("shape is not null").select("shape").distinct(), ["shape"], "inner", "page_id").drop("shape"))
    return same.groupBy("page_id").agg(F.to_json(F.collect_set("m")).alias("foot"))  # at most two of a page


def page_info(edges: DataFrame) -> DataFrame:
    """(page_id, info): what a page's own lines don't tell. JSON of: is its top line repeated on the file's pages, does the file have
    running headers, is it not the file's first page, and the first lines of the next page."""
    repeated = edges.where("m is not null and page_no is not null").groupBy("file_id", "m").agg(F.count("*").alias("n"))
    headed = edges.where("known").select("file_id").unionByName(repeated.where("n > 1").select("file_id")).distinct().withColumn("headed", F.lit(True))
    nxt = edges.select("file_id", (F.col("page_no") - 1).alias("page_no"), F.struct("top", "alone").alias("x")).groupBy("file_id", "page_no").agg(F.min("x").alias("x"))
    out = salted(edges, repeated, ["file_id", "m"], "left", "page_id").drop("m")
    out = salted(out, headed, ["file_id"], "left", "page_id").join(nxt, ["file_id", "page_no"], "left")
    return out.select(
        "page_id",
        F.to_json(
            F.struct((F.col("n") > 1).alias("repeated"), F.coalesce("headed", F.lit(False)).alias("headed"), (F.col("page_no") > 1).alias("later"), "alone", F.col("x.top").alias("next"), F.col("x.alone").alias("next_alone"))
        ).alias("info"),
    )


# ---------------------------------------------------------------- one page

TOKEN = re.compile(r"\S+")
CORE = re.compile(r"^[^\w|^*~\\]+|[^\w|^*~\\]+$")
STRAY_IN = re.compile(r"[^\W\d_][|^_*~\\]|[|^_*~\\][^\W\d_]")
DIGIT_IN = re.compile(r"(?:[^\W\d_]+[015][^\W\d_]*|[015][^\W\d_]{2,})+")
ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|er|re|de|te|ste|e|o|a|s|d|x)?", re.IGNORECASE)
YEAR = re.compile(r"(?=\d*[lIOoSBZ])[1lI][0-9lIOoSBZ]{3}")
END_MARK = re.compile(rf"[{re.escape(HYPHEN_MARKS)}][\s­​-‏⁠-⁤﻿]*$")
TAIL = " \t\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u2002\u2007\u2009\u00a0\u202f"
MARKS = frozenset(HYPHEN_MARKS)
FIX_YEAR = str.maketrans("lIOoSBZ", "1100582")


@lru_cache(maxsize=100_000)
def confusable(word: str, right: str) -> bool:
    """Does word come from right by confusing glyphs, each once, rather than by a chain of confusions?"""
    same = {x: c for c in CLASSES for x in c}
    turned = {(x, y) for one, two in PAIRS for x, y in ((one, two), (two, one))}
    word = re.sub(r"[|^_*~\\]", "", word)
    if len(word) == len(right) and all(x == y or y in CLASSES_OF.get(x, "") or (x, y) in turned for x, y in zip(word, right, strict=True)):
        return True
    for tag, i, j, k, m in SequenceMatcher(None, word, right, False).get_opcodes():
        a, b = word[i:j], right[k:m]
        if tag == "equal" or (a, b) in turned:
            continue
        if len(a) == len(b) and all(same.get(x) is not None and y in CLASSES_OF[x] or (x, y) in turned for x, y in zip(a, b, strict=True)):
            continue
        # A pair beside a like letter is cut differently: look one sign to either side.
        if any((word[max(0, i - x) : j + y], right[max(0, k - x) : m + y]) in turned for x in (0, 1) for y in (0, 1)):
            continue
        return False
    return True


def misread(token: str, before: str, after: str, words: Words, edge: bool) -> str | None:
    """What the token (without edge punctuation) should read; None if it isn't misread. edge: it may be a piece of a word."""
    if "@" in token or "/" in token or len(token) < 2:
        return None
    if YEAR.fullmatch(token):
        return token.translate(FIX_YEAR)
    if token.isdigit():
        return None
    stray = STRAY_IN.search(token)
    if stray and not re.search(r"\d", token):
        return re.sub(r"[|^_*~\\]", "", token)
    low = token.lower()
    if low in words.known and words.known[low] * TIMES > (words.forms.get(skeleton_of(low)) or ("", 0))[1]:
        return None
    best = words.right_form(low)
    digit = DIGIT_IN.fullmatch(token) and not ORDINAL.fullmatch(token) and any(c.islower() for c in token)
    if best is None:
        return token if digit else None
    if not confusable(low, best):
        return None
    b, a = CORE.sub("", before).lower(), CORE.sub("", after).lower()
    supported = b and ((b, best) in words.pairs or (words.right_form(b) or b, best) in words.pairs)
    supported = supported or a and ((best, a) in words.pairs or (best, words.right_form(a) or a) in words.pairs)
    if not (supported or digit) and (edge or (b in words.known and a in words.known)):
        return None
    return best.upper() if token.isupper() else best.capitalize() if token[0].isupper() else best


def split_word(a: str, b: str, marked: bool, words: Words) -> bool:
    """Is ab one word, broken between a line's last token a and the next line's first token b (without edge punctuation)?"""
    if not a or not any(c.isalpha() for c in a):
        return False
    x, y = a.lower(), b.lower()
    one = words.known.get(x + y, 0)
    if not one and (marked or x not in words.known and y not in words.known):
        one = words.known.get(words.right_form(x + y) or "", 0)
    if marked:
        hyphened = max(words.known.get(f"{x}-{y}", 0), words.known.get(f"{x.split('-')[-1]}-{y}", 0))
        if not y or not y[0].isalpha():
            return True
        if not hyphened and not one:  # a piece of a compound with more parts: mother-in- / law
            hyphened = words.heads.get(f"{x}-{y}-", 0)
        return one >= hyphened
    if not y or not y[0].isalpha() or len(x) < 2 and one < 20:
        return False
    apart = min(words.known.get(x, 0), words.known.get(y, 0))
    return one >= 5 and apart * 10 < one and words.pairs.get((x, y), 0) * 10 < one


class Repair:
    """Everything the page repair needs, sent to the executors."""

    def __init__(self, words: Words, titles: set[str], footers: set[str]):
        self.words, self.titles, self.footers = words, titles, footers
        self.footer_forms = {skeleton_of(m) for m in footers if len(m) > 12}
        self.seen: dict[str, tuple[str, bool]] = {}

    def look(self, token: str) -> tuple[str, bool]:
        """(token without edge punctuation, can it be misread at all), remembered."""
        got = self.seen.get(token)
        if got is None:
            core = CORE.sub("", token)
            w, low = self.words, core.lower()
            plain = core.isalpha() and low in w.known and w.known[low] * TIMES > (w.forms.get(skeleton_of(low)) or ("", 0))[1]
            got = core, not (plain or len(core) < 2)
            if len(self.seen) < 300_000:
                self.seen[token] = got
        return got

    def is_footer(self, text: str) -> bool:
        m = mask(text)
        if PAGE_NUMBER.fullmatch(m):
            return len(re.findall(r"\d+", form(text))) <= 2 and not re.fullmatch(r"\s*\d+( \d+)+\s*", text)
        return m in self.footers or skeleton_of(m) in self.footer_forms

    def is_header(self, text: str, info: dict, first: bool) -> bool:
        m = mask(text)
        if PAGE_NUMBER.fullmatch(m):
            return not re.fullmatch(r"\s*\d+( \d+)+\s*", text)
        lev = level(text)
        if lev in self.titles or len(lev) > 12 and skeleton_of(lev) in self.titles:
            return True
        if not is_title_like(text):
            return False
        return bool(first and info.get("alone") and (info.get("repeated") or info.get("headed") and info.get("later"))) or ("#" in m and bool(re.search(r"^#\s*\D|\D {2,}\d+\s*$|\s{3}", text.strip())))

    def furniture(self, texts: list[str], info: dict) -> list[bool]:
        n = len(texts)
        out = [False] * n
        for k in range(min(2, n)):
            if self.is_header(texts[k], info, k == 0 or out[0]):
                out[k] = True
            elif texts[k].strip():
                break
        for k in range(n - 1, max(n - 3, 0), -1):
            if not out[k] and self.is_footer(texts[k]):
                out[k] = True
            elif texts[k].strip():
                break
        return out

    def page(self, texts: list[str], info: dict) -> list[tuple[bool, bool, bool, str]]:
        """(furniture, split at its end, misread, cleaned text) of each line of a page, in reading order."""
        texts = [t or "" for t in texts]
        furniture = self.furniture(texts, info)
        forms = [form(t).rstrip() for t in texts]
        body = [k for k, f in enumerate(furniture) if not f and texts[k].strip()]
        out = [(f, False, False, forms[k]) for k, f in enumerate(furniture)]
        after_page = [t for t in info.get("next") or [] if t]
        if after_page and self.is_header(after_page[0], {"headed": True, "later": True, "alone": info.get("next_alone")}, True):
            after_page = after_page[1:]
            if len(after_page) > 1 and PAGE_NUMBER.fullmatch(mask(after_page[0])):
                after_page = after_page[1:]
        for k, f in enumerate(furniture):
            if f:
                t = TOKEN.findall(forms[k])
                bad = any(misread(CORE.sub("", x), "", "", self.words, False) is not None for x in t)
                out[k] = (True, False, bad, forms[k])
        split_before = False
        for i, k in enumerate(body):
            marked = texts[k].rstrip(TAIL)[-1:] in MARKS and bool(END_MARK.search(texts[k]))
            tokens = form(END_MARK.sub("", texts[k])).split() if marked else forms[k].split()
            follow = forms[body[i + 1]] if i + 1 < len(body) else form(after_page[0]) if after_page else ""
            nxt = (follow.split(None, 1) or [""])[0]
            last = self.look(tokens[-1])[0] if tokens else ""
            ends = bool(tokens) and tokens[-1][-1:] in ".,;:!?)" and not marked
            split = bool(tokens) and not ends and split_word(last, self.look(nxt)[0], marked, self.words)
            bad = False
            clean = list(tokens)
            for j, tok in enumerate(tokens):
                core, doubtful = self.look(tok)
                piece = j == 0 and split_before or j == len(tokens) - 1 and (split or marked)
                if not (doubtful or piece):
                    continue
                before, after = tokens[j - 1] if j else "", tokens[j + 1] if j + 1 < len(tokens) else ""
                if after.lower() in ("[at]", "(at)", "@", "[dot]", "(dot)") or before.lower() in ("[at]", "(at)", "@", "[dot]", "(dot)"):
                    continue
                if piece:
                    wrong = re.sub(r"[|^_*~\\]", "", core) if STRAY_IN.search(core) else None
                    if wrong is None:
                        whole = (core + CORE.sub("", nxt)) if j else (split_before + core if isinstance(split_before, str) else core)
                        if DIGIT_IN.fullmatch(core) and not ORDINAL.fullmatch(core) or self.words.right_form(whole.lower()) and whole.lower() not in self.words.known:
                            # of the two pieces, the one that differs from the right form is misread
                            right = self.words.right_form(whole.lower()) or ""
                            own = right[: len(core)] if j else right[-len(core) :]
                            wrong = core if DIGIT_IN.fullmatch(core) or len(right) == len(whole) and own != core.lower() else None
                else:
                    wrong = misread(core, before, after, self.words, j == 0 or j == len(tokens) - 1)
                if wrong is not None:
                    bad = True
                    if core:
                        clean[j] = tok.replace(core, wrong)
            out[k] = (False, split, bad, " ".join(clean) + ("-" if marked and not split else ""))
            split_before = last if split else False
        return out


#: archive_series is a fixed table; with more rows than this it is refused.
MAX_SERIES = 100_000


def titles_of(spark: SparkSession, sf_dir: str) -> set[str]:
    rows = table(spark, sf_dir, "archive_series", "title").distinct().limit(MAX_SERIES + 1).collect()
    if len(rows) > MAX_SERIES:
        raise ValueError("archive_series is meant to be a small table")
    titles = {level(r.title) for r in rows if r.title}
    return titles | {skeleton_of(t) for t in titles} | {t[3:] for t in titles if t.startswith("the")}


def keys_of(texts: list[str]) -> tuple[set[str], set[tuple[str, str]], set[str]]:
    """(skeletons of words, of pairs of words, beginnings of compounds) that the repair of lines may look up: of the words, of the pieces
    of a word at line ends joined, and of neighbours."""
    words, pairs, heads = set(), set(), set()
    ends: list[set[str]] = []  # of the lines before: between two of the body may stand a footer and a header of two lines each
    for t in texts:
        forms_ = [x.split() for x in {form(t), form(END_MARK.sub("", t))}]
        for whole in forms_:
            w = [x for x in (CORE.sub("", x).lower() for x in whole) if x]
            shapes = [skeleton_of(x) for x in w]
            words.update(shapes)
            pairs.update(zip(shapes, shapes[1:], strict=False))
            y = CORE.sub("", whole[0]).lower() if whole else ""
            for x in set().union(*ends) if y else ():
                words.update((skeleton_of(x + y), skeleton_of(f"{x}-{y}"), skeleton_of(f"{x.split('-')[-1]}-{y}")))
                pairs.add((skeleton_of(x), skeleton_of(y)))
                heads.add(f"{x}-{y}-")
        if any(forms_):
            ends = [*ends[-4:], {CORE.sub("", x[-1]).lower() for x in forms_ if x}]
    return words, pairs, heads


def own_words(texts: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, own): JSON of the known words and pairs that a page (page_id, texts) may look up; all by joins on skeletons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one, two, heads = keys_of([t or "" for t in ts])
                rows += [(page, "w", x, "") for x in one] + [(page, "p", x, y) for x, y in two] + [(page, "h", x, "") for x in heads]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["page_id", "what", "x", "y"])

    keys = written(texts.mapInArrow(run, "page_id long, what string, x string, y string"))
    some = words.select(skeleton(F.col("b")).alias("x"), F.struct(F.lit("").alias("a"), "b", "n").alias("e"))
    compounds = words.where("instr(b, '-') > 0").select(F.explode(F.expr("transform(filter(sequence(1, length(b)), k -> substr(b, k, 1) = '-'), k -> left(b, k))")).alias("x"), F.struct(F.lit("").alias("a"), "b", "n").alias("e"))
    both = pairs.select(skeleton(F.col("a")).alias("x"), skeleton(F.col("b")).alias("y"), F.struct("a", "b", "n").alias("e"))
    got = keys.where("what = 'w'").join(some, "x").select("page_id", F.lit(False).alias("pair"), "e")
    got = got.unionByName(keys.where("what = 'h'").join(compounds, "x").select("page_id", F.lit(False).alias("pair"), "e"))
    got = got.unionByName(keys.where("what = 'p'").join(both, ["x", "y"]).select("page_id", F.lit(True).alias("pair"), "e"))
    # Words of one page: as many as it has, and the forms confusable with them.
    return got.groupBy("page_id").agg(F.to_json(F.collect_set(F.struct("pair", "e.a", "e.b", "e.n"))).alias("own"))


OUT = "page_id long, line_id long, line_no int, furniture boolean, hyphen boolean, misread boolean, clean string"


def repaired(spark: SparkSession, sf_dir: str, lines: DataFrame, sent: int = WORDS_SENT) -> DataFrame:
    """Every line (page_id, line_id, line_no, text) with its marks of noise and its cleaned text.

    What is known is learnt from all transcribed lines and pages. Lines of a page are brought together by one shuffle and read
    in order as a stream; a page is the unit, a copy of a line counts once. Null and empty texts have no noise; lines
    without a page are left out. Known words and pairs are sent to the executors if they are few (counted first), else each
    page is joined with its own.
    """
    titles = titles_of(spark, sf_dir)
    edges = written(page_edges(table(spark, sf_dir, "page_results", "page_id", "file_id", "page_no", "plain_text"), titles))
    info, footers = written(page_info(edges)), written(footers_of(edges))
    words, pairs = learn(table(spark, sf_dir, "transcribed_lines", "text").select(mapped(F.col("text")).alias("text")))
    few = words.count() + pairs.count() + footers.count() <= sent
    if few:
        some = words_of([tuple(r) for r in words.select("b", "n").collect()], [tuple(r) for r in pairs.select("a", "b", "n").collect()])
        shared = spark.sparkContext.broadcast(Repair(some, titles, {r.m for r in footers.select("m").collect()}))
    else:
        shared = spark.sparkContext.broadcast(Repair(words_of([], []), titles, set()))
    mine = lines.where("page_id is not null").select("page_id", "line_id", "line_no", "text")
    at = lambda k, df, c: df.select("page_id", F.lit(k).cast("long").alias("line_id"), F.lit(k).alias("line_no"), F.col(c).alias("text"))
    rows = mine.unionByName(at(-1, info, "info"))
    if not few:
        after = info.select("page_id", F.posexplode(F.from_json("info", "next array<string>")["next"]).alias("line_no", "text"))
        after = after.select("page_id", F.lit(0).cast("long").alias("line_id"), (F.col("line_no") + (1 << 30)).alias("line_no"), "text")
        texts = mine.unionByName(after).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))).alias("t"))  # one page
        own = own_words(texts.select("page_id", F.transform("t", lambda x: x["text"]).alias("texts")), words, pairs)
        rows = rows.unionByName(at(-2, own, "own")).unionByName(at(-3, feet_of(mine, footers), "foot"))
    rows = rows.repartition("page_id").sortWithinPartitions("page_id", "line_no", "line_id")
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        r = shared.value

        def done(page: int, held: list[tuple], info: str | None, own: str | None, foot: str | None) -> Iterable[tuple]:
            if not few:
                r.footers = set(json.loads(foot)) if foot else set()
                known = json.loads(own) if own else []
                r.seen.clear()
                r.words = words_of([(x["b"], x["n"]) for x in known if not x["pair"]], [(x["a"], x["b"], x["n"]) for x in known if x["pair"]])
            marks = r.page([t for _, _, t in held], json.loads(info) if info else {})
            return [(page, i, k, *m) for (i, k, _), m in zip(held, marks, strict=True)]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        page, held, text, own, foot, last = None, [], None, None, None, None
        for b in batches:
            out: list[tuple] = []
            for p, i, k, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if p != page:
                    if held:
                        out += done(page, held, text, own, foot)
                    page, held, text, own, foot, last = p, [], None, None, None, None
                if i == -1:
                    text = t
                elif i == -2:
                    own = t
                elif i == -3:
                    foot = t
                elif i != last:
                    held.append((i, k, t))
                    last = i
            if out:
                yield batch(out)
        if held:
            yield batch(done(page, held, text, own, foot))

    return rows.mapInArrow(run, OUT)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = repaired(spark, sf_dir, table(spark, sf_dir, "transcribed_lines", "page_id", "line_id", "line_no", "text"))
    kinds = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("furniture", "hyphen", "misread"))))
    return marks.select("line_id", F.explode(kinds).alias("kind")).distinct()


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain_text of every page as clean paragraphs: furniture left out, split words joined, misread ones put right."""
    pages = table(spark, sf_dir, "page_results", "page_id", "plain_text").dropDuplicates(["page_id"])
    lines = pages.select("page_id", F.posexplode(F.split("plain_text", r"\n")).alias("line_no", "text"))
    page = W.partitionBy("page_id").orderBy("line_no")
    lines = lines.withColumn("para", F.sum(F.when(F.trim("text") == "", 1).otherwise(0)).over(page)).where("trim(text) <> ''")
    lines = lines.withColumn("line_id", F.col("line_no").cast("long"))
    marks = repaired(spark, sf_dir, lines).where("not furniture").join(lines.select("page_id", "line_id", "para"), ["page_id", "line_id"])
    # A word that is split at the end of a paragraph's last line goes on in the next: what follows belongs to it.
    glue = F.when(F.col("hyphen"), "").otherwise(" ")
    before = F.lag("hyphen").over(page)
    start = F.when(F.coalesce(before, F.lit(False)) | (F.col("para") == F.lag("para").over(page)), 0).otherwise(1)
    marks = marks.withColumn("s", start)
    marks = marks.withColumn("paragraph_no", F.sum("s").over(page) - 1)
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.concat("clean", glue).alias("x"))))
    return marks.groupBy("page_id", "paragraph_no").agg(F.trim(F.array_join(F.transform(parts, lambda x: x["x"]), "")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
ORACLE: dict[str, str] = {}

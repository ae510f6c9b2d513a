"""Problem 4: personal data in pages of text, found by labelers that vote, and replaced by typed placeholders.

Patterns, gazetteers learnt from the corpus and the words around a span each vote on it (+1, -1 or 0). Expectation-maximisation
over the counts of vote patterns of all spans estimates how reliable each labeler is; its posteriors are the labels
from which a final span classifier (votes and context words) is trained.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.noise import skeleton, skeleton_of
from leafscan.session import table, written

KINDS = ("email", "phone", "id", "address", "name")

#: Spans of each kind that the classifier is trained on, about; a bound of the sample, drawn by a hash, not of the result.
TRAIN_SPANS = 5_000
#: Tokens seen as names at least so often, and in at least this share of all occurrences, enter the gazetteers.
NAME_TIMES, NAME_SHARE = 2, 0.1

# Titles and words that stand before a datum of a kind, or before numbers that are none.
TITLES = (
    "mr mrs miss ms dr doctor rev reverend capt captain major colonel sergeant prof professor sir lady m mme mlle monsieur madame docteur herr herrn frau fräulein signor signora dottor dottoressa don doña "
    "señor señora senhor senhora dona doutor mijnheer meneer mevrouw juffrouw heer herr fru fröken doktor dominus domina reverendus magister "
    "господин госпожа доктор"
).split()
PHONE_WORDS = r"tel|tél|tfn|telephone|telefon|ring|call(?:ed)?(?: on)?|appeler(?: le)?|numero|numéro|number|unter|nås på|bellen|telefoon|llamar|ligar|телефон\w*|номер\w*"
ID_WORDS = (
    r"passport|passaporto|pasaporte|passaporte|passeport|paspoort|reisepass|passet|паспорт\w*|ausweis(?:-nr)?|identity(?: card)?|identit\w+|identidad\w*|identidade|"
    r"social security(?: number)?|nat\. ins\. no|codice(?: personale)?|carte d'identité(?: no)?|personnummer|legitimation\w*|cédula|carné|bilhete|удостоверени\w*"
)
ADDRESS_WORDS = (
    r"directed to|lodged at|removed to|lived at|anschrift|adresse|zuletzt|demeurait|porté au|abitava in|indirizzo|vivía en|llevó a|morava n[ao]|"
    r"woonde|adres|gebracht naar|bodde på|adressen|адресу|entregue n[ao]|consegnato in|portato in|bezorgd"
)
NUMBER_WORDS = (
    r"receipt|no|accession|bundle|lots?|box|shelfmark|ms|hs|beleg|band|reçu|recibo|cote|segnatura|signatur\w*|signum|cota|codicem|folio|foglio|fólio|feuillet|blatt|blad|"
    r"reel|frame|page|vol|kvitto\w*|ricevuta|kwitantie|квитанци\w*|шифр|лист|band|deel|tomo"
)

SP = r"[-‐­¬⸗=]? ?"
LABEL = r"[A-Za-z0-9]+(?:-+ ?[A-Za-z0-9]+)*"
EMAIL = re.compile(
    rf"[A-Za-z0-9_][\w.+-]*(?: ?@ ?| ?\[at\] ?| ?\(at\) ?){LABEL}(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?){LABEL})+", re.IGNORECASE
)
PHONE = re.compile(r"(?<![\w./-])(?:\+ ?\d{1,3}[ .-]?)?(?:\(\d{2,5}\) ?)?\d[\d ./-]{4,17}\d(?![\w/]|[-.]\d)")
ID = re.compile(
    r"(?<![\w-])(?:[A-Z]{1,3}[- ]?\d{6,8}|(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{8,10}|[A-Z]{2}[- ]?\d{2}[- ]?\d{2}[- ]?\d{2}[- ]?[A-Z]|\d{3}[- ]?\d{2}[- ]?\d{4}|\d{6}[-+]\d{4})(?![\w-]|\.\d)"
)
STREET = r"Street|Lane|Row|Court|Ave|Avenue|Sq|Square|Road|Terrace|Place|Close|Hill|Walk|Yard|Way|Gardens|Crescent|St|Rd"
CAP = r"[A-ZÀ-ÖØ-ÞА-Я][\w'’]*(?:[-‐­¬⸗=] [a-zß-ÿа-я][\w'’]*)?"
LOW = r"(?:de|du|des|della?|dei|degli|delle|del|da|do|dos|das|la|le|les|los|las|aux|au|à|van|der|den|het|dell['’]\w+|d['’]\w+|l['’]\w+)"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:\d{{1,4}} ?[A-Za-z]? (?:{CAP} ){{1,3}}(?:{STREET})(?!\w)"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|quai|impasse|avenue|place|boulevard|chemin|allée|passage|cours|sentier)(?: (?:{LOW}|{CAP}))+"
    rf"|(?:via|vicolo|piazza|viale|corso|largo|calle|plaza|avenida|paseo|callejón|camino|rua|travessa|praça|beco|улица|переулок|площадь|набережная)(?: (?:{LOW}|{CAP}))+,? \d{{1,4}} ?[a-d]?"
    rf"|(?:(?:Am|An der|An den|Im|Zum|Zur|Alte|Alter|Neue|Neuer|Obere|Untere|Oude|Nieuwe|Lange|Korte|Gamla|Nya|Stora|Lilla) )?"
    rf"[A-ZÄÖÜÅ]\w*(?:[-‐­¬⸗=] \w*)?(?:straße|strasse|gasse|weg|platz|markt|graben|ufer|allee|ring|damm|straat|gracht|plein|steeg|kade|laan|dijk|gatan|gränd|gränden|vägen|torget|stigen|backen)"
    rf",? \d{{1,4}} ?[a-d]?)(?![\w-])"
)
WORD = r"[^\W\d_](?:[\w'’]|[-‐­¬⸗=] ?(?=[^\W\d_A-ZÀ-ÞА-Я]))*"
TOKEN = re.compile(rf"{WORD}")


BREAK = re.compile(r"[-‐­¬⸗=] (?=[a-zß-öø-ÿа-яё])")
BLANK = re.compile(r"\n[ \t\r]*\n")


def paragraph_places(text: str) -> list[tuple[int, int]]:
    """Where the paragraphs stand, in the order of paragraphs()."""
    ends = [m.span() for m in BLANK.finditer(text)]
    return list(zip([0, *(e for _, e in ends)], [*(a for a, _ in ends), len(text)], strict=True))


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, each run of white space in them one space; blank ones are empty strings."""
    out = []
    for p in BLANK.split(text) if "\n " in text or "\t" in text or "\r" in text else text.split("\n\n"):
        p = p.strip().replace("\n", " ")
        out.append(p if "  " not in p and p.isascii() and p.isprintable() else " ".join(p.split()))
    return out


def key(token: str) -> str:
    """A name token without breaks, capitalised."""
    if token.isalpha():
        return token.capitalize()
    return re.sub(r"[-‐­¬⸗=] ?|['’]s$", "", token).capitalize()


class Names:
    """Gazetteers of surnames and given names; hints: words as they stand in texts, with their punctuation, beside which a name may be.

    Without hints every paragraph is looked through."""

    def __init__(self, surnames: set[str], given: set[str], hints: set[str] | None = None):
        self.surnames, self.given, self.hints = surnames, given, hints
        self.shapes = {skeleton_of(s) for s in surnames if len(s) >= 6}
        self.known: dict[str, bool] = {}

    def is_surname(self, token: str) -> bool:
        got = self.known.get(token)
        if got is None:
            k = key(token)
            got = k in self.surnames or (len(k) >= 6 and token[:1].isupper() and skeleton_of(k) in self.shapes)
            if len(self.known) < 300_000:  # a memo, not a bound of the result
                self.known[token] = got
        return got

    def is_given(self, token: str) -> bool:
        return key(token) in self.given

    def may_be_in(self, words: list[str]) -> bool:
        return self.hints is None or not self.hints.isdisjoint(words)


TITLE_SET = frozenset(TITLES)


def capital(t: str) -> bool:
    return t[:1].isupper()


SEEDS = "what string, a string, b string, n long"
EDGE_SIGNS = ".,;:!?()[]{}\"'«»„“”‘’—–-‐­¬⸗=*_|"


def joined_words(text: str) -> list[str]:
    """The words of a text as they stand, pieces of broken ones joined where a mark shows it; ¶ between paragraphs."""
    text = text.replace("\n\n", " ¶ ").replace("\n", " ")
    return (BREAK.sub("", text) if BREAK.search(text) else text).split()


def seeds_of(words: list[str]) -> Iterator[tuple[str, str, str]]:
    """What words say of each other: (s, word, '') after a title or an initial; (g, word, other) that word stands as a given name
    beside other, which counts if other is a surname."""
    caps = [k for k, w in enumerate(words) if w[0].isupper()]
    bare = {k: w if w.isalpha() else w.strip(EDGE_SIGNS) for k, w in ((k, words[k]) for k in caps)}
    for k in caps:
        w = bare[k]
        if len(w) < 3 or k == 0:
            continue
        before = words[k - 1]
        title = before.strip("(.").lower() in TITLE_SET if before[-1] != "," else False
        initial = len(before) == 2 and before[1] == "." and before[0].isupper() and not (k > 1 and words[k - 2][-1] == "." and len(words[k - 2]) > 2)
        if title:
            third = bare.get(k + 1, "") if words[k][-1].isalpha() else ""
            yield "s", key(third if len(third) > 2 else w), ""
        elif initial:
            yield "s", key(w), ""
            if k - 2 in bare and words[k - 2][-1].isalpha() and len(words[k - 2]) > 1:
                yield "g", key(words[k - 2]), key(w)
        elif k - 1 in bare:
            if before[-1].isalpha():
                yield "g", key(before), key(w)
            elif before[-1] == ",":
                yield "g", key(w), key(bare[k - 1])


def name_counts(pages: DataFrame) -> DataFrame:
    """(what, a, b, n) over all pages, in one pass: seeds as in seeds_of, and (w, word, '') for each occurrence of a word as it stands.
    Counted by partition before the shuffle."""

    def rows(words: Counter, seeds: Counter) -> pa.RecordBatch:
        what = ["w"] * len(words) + [x for x, _, _ in seeds]
        a, b = [*words, *(x for _, x, _ in seeds)], [""] * len(words) + [x for _, _, x in seeds]
        s = pa.string()
        return pa.RecordBatch.from_arrays([pa.array(what, s), pa.array(a, s), pa.array(b, s), pa.array([*words.values(), *seeds.values()], pa.int64())], names=["what", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        seeds: Counter = Counter()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                ws = joined_words("\n\n".join(b.column(0).slice(k, 500).to_pylist()))
                words.update(ws)
                seeds.update(seeds_of(ws))
            if len(words) + len(seeds) > 500_000:  # what a task holds at most; the rest is added up after the shuffle
                yield rows(words, seeds)
                words.clear(), seeds.clear()
        yield rows(words, seeds)

    return pages.select("plain_text").mapInArrow(run, SEEDS).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def learn_names(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, kind, times): surnames (s) and given names (g), tokens seen as such in a share of their occurrences and hardly ever
    in lower case; likely ones seen once too. The floor doesn't grow with the corpus. And (word): words beside which a name may be."""
    counts = written(name_counts(pages))
    plain = F.regexp_replace(F.regexp_replace("bare", "['’]s$", ""), "[-‐­¬⸗=]", "")
    words = counts.where("what = 'w'").select("a", "n", F.regexp_replace("a", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "").alias("bare")).where("bare <> ''")
    words = words.select("a", "n", "bare", F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substr(plain, F.lit(2)))).alias("token"))
    cased = words.withColumn("big", F.left("bare", F.lit(1)) != F.lower(F.left("bare", F.lit(1))))
    cased = cased.groupBy("token").agg(F.sum(F.when(F.col("big"), F.col("n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("big"), 0).otherwise(F.col("n"))).alias("l"))

    def likely(seed: DataFrame, share: float) -> DataFrame:
        ok = (F.col("times") >= share * F.col("u")) & (F.col("l") <= 0.01 * F.col("u"))
        return seed.join(cased, "token", "left").fillna(0, ["u", "l"]).where(ok).select("token", "times")

    surnames = written(likely(counts.where("what = 's'").select(F.col("a").alias("token"), F.col("n").alias("times")), NAME_SHARE))
    sure = surnames.where(F.col("times") >= NAME_TIMES)
    beside = counts.where("what = 'g'").join(sure.select(F.col("token").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("times"))
    given = likely(beside, 3 * NAME_SHARE).where(F.col("times") >= NAME_TIMES).join(sure, "token", "left_anti").where(~F.lower("token").isin(*TITLES))
    names = written(surnames.withColumn("kind", F.lit("s")).unionByName(given.withColumn("kind", F.lit("g"))))

    own = names.where(f"kind = 's' and times >= {NAME_TIMES}").select("token")
    big = words.where(F.left("bare", F.lit(1)) != F.lower(F.left("bare", F.lit(1)))).select("a", "token")
    heads = own.select(F.explode(F.expr("transform(sequence(2, greatest(2, length(token) - 1)), k -> left(token, k))")).alias("token")).distinct()
    shapes = own.where("length(token) >= 6").select(skeleton(F.col("token")).alias("shape")).distinct()
    titled = words.where(F.lower("bare").isin(*TITLES) | F.col("a").rlike(r"^\(?\p{Lu}\.$")).select("a")
    met = big.join(own, "token", "left_semi").select("a").unionByName(big.join(heads, "token", "left_semi").select("a"))
    met = met.unionByName(big.where("length(token) >= 6").withColumn("shape", skeleton(F.col("token"))).join(shapes, "shape", "left_semi").select("a"))
    return names, met.unionByName(titled).select(F.col("a").alias("word")).distinct()


# ---------------------------------------------------------------- candidate spans and their votes

DIGIT = re.compile(r"\d")
SHORT = re.compile(r"[\w'’]+")


def near(before: str, words: re.Pattern) -> bool:
    """Do the words stand right before, but for a colon, number sign or short word?"""
    return words.search(BREAK.sub("", before[-60:])) is not None


def _before(words: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{words})[.:]?(?: (?:n[or°º]\.?|nummer|is|au|på|a|o|le|el|il|on))?\W*$", re.IGNORECASE)


PHONE_BEFORE, ID_BEFORE, ADDRESS_BEFORE, NUMBER_BEFORE = map(_before, (PHONE_WORDS, ID_WORDS, ADDRESS_WORDS, NUMBER_WORDS))
SSN = re.compile(r"\d{3}[- ]?\d{2}[- ]?\d{4}")


def spans_of(text: str, names: Names) -> list[tuple[int, str, str, list[int], str, str, bool, int, str | None]]:
    """(paragraph, kind, value, votes, word before, word after, touches the end of the text, place, surname that the gazetteer lacks)
    of each candidate span."""
    out: list[tuple] = []
    paras = paragraphs(text)
    last = max((k for k, p in enumerate(paras) if p), default=-1)
    named, numbered = names.may_be_in(joined_words(text)), DIGIT.search(text) is not None
    for k, t in enumerate(paras):
        if not t:
            continue
        taken: list[tuple[int, int]] = []

        def add(kind: str, a: int, b: int, votes: list[int], token: str | None = None, t: str = t, k: int = k) -> None:
            before = SHORT.findall(t[max(0, a - 40) : a].lower())
            after = SHORT.findall(t[b : b + 40].lower())
            out.append((k, kind, t[a:b], votes, before[-1] if before else "^", after[0] if after else "$", k == last and b >= len(t), a, token))

        if "@" in t or "at)" in t or "at]" in t or "AT)" in t or "AT]" in t:
            for m in EMAIL.finditer(t):
                taken.append(m.span())
                add("email", *m.span(), email_votes(m.group()))
        if numbered and DIGIT.search(t):
            _numbered(t, taken, add)
        if named and names.may_be_in(joined_words(t)):
            _named(t, taken, names, add)
    return out


def email_votes(v: str) -> list[int]:
    """Sign and end of the name; a name of more than a short word; an end that is written as the rest is; no blanks inside."""
    name, _, host = re.split(r"( ?@ ?| ?\[at\] ?| ?\(at\) ?)", v, maxsplit=1, flags=re.IGNORECASE)
    labels = re.split(r"(?:\.| ?\[dot\] ?| ?\(dot\) ?)", host, flags=re.IGNORECASE)
    return [1 if len(labels[-1]) >= 2 and labels[-1].isalpha() else -1, 1 if len(name) >= 3 else -1, 1 if v in (v.lower(), v.upper()) else 0, 0 if " " in v else 1, 1 if len(labels) > 1 and len(labels[0]) > 2 else -1]


def _numbered(t: str, taken: list[tuple[int, int]], add: Callable) -> None:
    """Addresses, identity numbers and phone numbers of a paragraph."""
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    digits = len(DIGIT.findall(t))
    for m in ADDRESS.finditer(t):
        if free(m):
            taken.append(m.span())
            number = re.search(r"\d+", m.group())
            before = t[: m.start()]
            add("address", *m.span(), [1 if near(before, ADDRESS_BEFORE) else 0, 1 if len(number.group()) <= 3 else 0, -1 if near(before, NUMBER_BEFORE) else 0, -1 if near(before, PHONE_BEFORE) else 0, -1 if "." in m.group() else 0])
    coded: list[tuple[int, int]] = []
    for m in ID.finditer(t) if digits >= 3 else ():
        if free(m):
            v, before = m.group(), t[: m.start()]
            letters = any(c.isalpha() for c in v)
            if letters:
                coded.append(m.span())
            own, other = near(before, ID_BEFORE), near(before, NUMBER_BEFORE)
            phone = near(before, PHONE_BEFORE)
            add("id", *m.span(), [1 if letters or not v.isdigit() and SSN.fullmatch(v) else 0, 1 if own else 0, -1 if other and not own else 0, -1 if phone and not own else 0, 0 if SSN.fullmatch(v) or letters else -1])
    for m in PHONE.finditer(t) if digits >= 7 else ():
        v = m.group()
        if free(m) and 7 <= sum(map(str.isdigit, v)) <= 15 and not any(a < m.end() and m.start() < b for a, b in coded):
            before = t[: m.start()]
            own, other = near(before, ID_BEFORE), near(before, NUMBER_BEFORE)
            add("phone", *m.span(), [1 if v[0] in "+(" else 0, 1 if near(before, PHONE_BEFORE) and not own else 0, -1 if other or own else 0, -1 if SSN.fullmatch(v) else 0, -1 if re.fullmatch(r"\d+( \d{1,2})+", v) and v[0] != "0" else 0])


def _named(t: str, taken: list[tuple[int, int]], names: Names, add: Callable) -> None:
    """Names of a paragraph: a surname with the given names, initials and titles beside it."""
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    toks = list(TOKEN.finditer(t))
    i = 0
    while i < len(toks):
        w = toks[i].group()
        if not capital(w):
            i += 1
            continue
        ok = len(w) > 2 and free(toks[i])
        whole = names.is_surname(w)
        joined = i + 1 < len(toks) and t[toks[i].end() : toks[i + 1].start()] == " " and not capital(toks[i + 1].group()) and key(w + toks[i + 1].group()) in names.surnames
        known = whole or joined
        unknown = None
        if ok and not known and i:  # a title or an initial proposes a name too
            p, gap = toks[i - 1].group(), t[toks[i - 1].end() : toks[i].start()]
            if key(p).lower() in TITLE_SET and gap in (" ", ". ") or len(p) == 1 and capital(p) and gap == ". ":
                third = toks[i + 1].group() if i + 1 < len(toks) and t[toks[i].end() : toks[i + 1].start()] == " " else ""
                after_title = len(p) > 1 and capital(third) and len(third) > 2
                unknown = None if names.is_surname(third) and capital(third) else (third if after_title else w)
        if not known and unknown is None:
            i += 1
            continue
        j = i + 1 if joined and not whole or unknown is not None and unknown != w else i
        a, b = toks[i].start(), toks[j].end()
        title = given = initial = inverse = 0
        q = i - 1
        while q >= 0:
            p, gap = toks[q].group(), t[toks[q].end() : a]
            if key(p).lower() in TITLE_SET and gap in (" ", ". "):
                title = 1
                break
            if len(p) == 1 and capital(p) and gap == ". ":
                initial = 1
            elif gap == " " and capital(p) and len(p) > 1 and names.is_given(p):
                given = 1
            elif gap == " " and q and not capital(p) and t[toks[q - 1].end() : toks[q].start()] == " " and names.is_given(toks[q - 1].group() + p) and capital(toks[q - 1].group()):
                given, q = 1, q - 1  # a given name broken without a mark
            else:
                break
            a = toks[q].start()
            q -= 1
        if not (given or initial) and j + 1 < len(toks) and t[b : toks[j + 1].start()] == ", " and names.is_given(toks[j + 1].group()):
            inverse, j = 1, j + 1
            b = toks[j].end()
            while j + 1 < len(toks) and len(toks[j + 1].group()) == 1 and capital(toks[j + 1].group()) and t[b : toks[j + 1].start()] == " " and t[toks[j + 1].end() : toks[j + 1].end() + 1] == ".":
                j += 1
                b = toks[j].end() + 1
        b = a + len(re.sub(r"['’]s?$", "", t[a:b]))
        exact = all(key(x) in names.surnames or key(x) in names.given or len(x) <= 2 for x in re.findall(WORD, t[a:b]))
        goes_on = j + 1 < len(toks) and t[toks[j].end() : toks[j + 1].start()] == " " and len(toks[j + 1].group()) > 1 and capital(toks[j + 1].group())
        add("name", a, b, [1 if known and exact else 0, max(title, initial), max(given, inverse), -1 if goes_on else 0, -1 if re.search(r"\d", t[a:b]) else 0], key(unknown) if unknown is not None else None)
        i = j + 1


SPANS = "page_id long, para int, kind string, value string, votes array<int>, before string, after string, at int, token string"
N_VOTES = 5
#: Names, and words that hint at one, that an executor is sent as sets, at most; with more, each page brings its own words that are names.
NAMES_SENT = 500_000


def own_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """pages with own: those of their capital words (and of such a word with the next piece) that are in the gazetteers, by a join.

    Of surnames also those that a word is confusable with."""
    words = F.expr(r"regexp_extract_all(plain_text, '(?=(\\p{Lu}[\\p{L}\\p{M}\'’‐­¬⸗=-]*(?:[-‐­¬⸗=]?\\s\\p{Ll}[\\p{L}\\p{M}]*)?))\\p{Lu}[\\p{L}\\p{M}]*', 1)")
    rows = pages.select("page_id", F.explode(F.array_distinct(words)).alias("w")).withColumn("w", F.regexp_replace("w", r"[-‐­¬⸗=]\s?", ""))
    rows = rows.select("page_id", F.explode(F.array_distinct(F.array(F.regexp_replace("w", r"\s.*$", ""), F.regexp_replace("w", r"\s", "")))).alias("w"))
    rows = rows.select("page_id", F.initcap(F.regexp_replace("w", r"['’]s$", "")).alias("token"))
    shaped = rows.where("length(token) >= 6").select("page_id", skeleton(F.col("token")).alias("shape"))
    shapes = names.where("kind = 's' and length(token) >= 6").select(skeleton(F.col("token")).alias("shape"), "token", "kind")
    met = rows.join(names.select("token", "kind"), "token").unionByName(shaped.join(shapes, "shape").select("page_id", "token", "kind"))
    own = met.groupBy("page_id").agg(F.collect_set(F.struct("kind", "token")).alias("own"))  # the names of one page
    return pages.join(own, "page_id", "left")


def candidate_spans(pages: DataFrame, names: DataFrame, hints: DataFrame, sent: int = NAMES_SENT) -> DataFrame:
    """Candidate spans of plain_text (page_id, plain_text, n_lines) with the votes of each labeler. Null and empty texts have none.

    A span that touches the end of a text with fewer lines than the page has is left out, as it is cut. The gazetteers
    (token, kind) are sent to the executors if they are small (counted first), else joined with the pages' words.
    """
    spark = pages.sparkSession
    sure = names.where(f"kind = 'g' or times >= {NAME_TIMES}")
    sets = written(sure.select("kind", "token").unionByName(hints.select(F.lit("h").alias("kind"), F.col("word").alias("token"))))
    few = sets.count() <= sent
    if few:
        held: dict[str, set[str]] = {"s": set(), "g": set(), "h": set()}
        for r in sets.collect():
            held[r.kind].add(r.token)
        shared = spark.sparkContext.broadcast((held["s"], held["g"], held["h"]))
    else:
        pages = own_names(pages, sure)
    cols = [c.split()[0] for c in SPANS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Names(*shared.value) if few else None
        for b in batches:
            rows = []
            own = [None] * b.num_rows if few else b.column(3).to_pylist()
            for page_id, text, n, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), own, strict=True):
                if not text:
                    continue
                known = every or Names({x["token"] for x in mine or () if x["kind"] == "s"}, {x["token"] for x in mine or () if x["kind"] == "g"})
                for k, kind, value, votes, before, after, end, at, token in spans_of(text, known):
                    if not (end and is_cut(text, n)):
                        rows.append((page_id, k, kind, value, votes, before, after, at, token))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=cols)

    return pages.where("page_id is not null").select("page_id", "plain_text", "n_lines", *([] if few else ["own"])).mapInArrow(run, SPANS)


def is_cut(text: str, n_lines: int | None) -> bool:
    return n_lines is not None and sum(bool(x.strip()) for x in text.split("\n")) < n_lines or re.search(r"(?:…|\.\.\.\]?|�)\s*$", text) is not None


def likely_spans(spans: DataFrame, names: DataFrame) -> DataFrame:
    """spans without those whose surname is neither in the gazetteer nor in the table of likely surnames."""
    seen = names.where("kind = 's'").select("token", F.lit(True).alias("likely"))
    return spans.join(seen, "token", "left").where("token is null or likely").drop("token", "likely")


# ---------------------------------------------------------------- reliabilities and the final classifier

#: What is expected of a labeler before the data: shares of -1, 0 and +1 votes on true and on false spans, and their weight
#: as a share of the spans. It keeps the two classes from changing places where nearly all spans are true; votes are then worth what is estimated.
EXPECTED = (np.array([0.05, 0.45, 0.50]), np.array([0.50, 0.45, 0.05]))
EXPECTED_SHARE = 0.05


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """(posterior of each vote pattern, how often each labeler's votes are right), by expectation-maximisation.

    patterns: votes (+1, -1, 0) and how many spans have them. It starts from the labelers' majority. A labeler whose votes
    turn out wrong more often than right counts against them.
    """
    if not patterns:
        return {}, np.zeros(0)
    v = np.array([p for p, _ in patterns], int)
    n = np.array([k for _, k in patterns], float)
    post = 1 / (1 + np.exp(-(v.sum(1) + 0.5) * 1.5))
    held = EXPECTED_SHARE * n.sum()
    for _ in range(rounds):
        prior = (post @ n + 0.5 * held) / (n.sum() + held)
        logit = np.full(len(v), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            pos, neg = ((np.bincount(v[:, j] + 1, w * n, 3) + held * e) for w, e in zip((post, 1 - post), EXPECTED, strict=True))
            logit += np.log((pos / pos.sum()) / (neg / neg.sum()))[v[:, j] + 1]
        new = 1 / (1 + np.exp(-np.clip(logit, -20, 20)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    right = np.array([((v[:, j] > 0) * post * n + (v[:, j] < 0) * (1 - post) * n).sum() / max(1.0, ((v[:, j] != 0) * n).sum()) for j in range(v.shape[1])])
    return {tuple(int(x) for x in p): float(q) for (p, _), q in zip(patterns, post, strict=True)}, right


HASHED = 512


def feature_indices(votes: list[int], before: str, after: str) -> list[int]:
    """Places of the ones in a span's features: a constant, each vote for, each vote against, the word before, the word after."""
    import zlib

    own = [1 + j if v > 0 else 1 + N_VOTES + j for j, v in enumerate(votes) if v]
    return [0, *own, *(1 + 2 * N_VOTES + zlib.crc32(s.encode()) % HASHED for s in (f"b:{before}", f"a:{after}"))]


def fit(rows: list, posterior: dict[str, dict[tuple[int, ...], float]], rounds: int = 200) -> dict[str, np.ndarray]:
    """Logistic weights of each kind, from the posteriors as soft labels."""
    out = {}
    for kind in KINDS:
        own = [r for r in rows if r.kind == kind]
        if not own:
            continue
        places = [feature_indices(r.votes, r.before, r.after) for r in own]
        row = np.repeat(np.arange(len(own)), [len(p) for p in places])
        col = np.concatenate(places)
        y = np.array([posterior[kind].get(tuple(r.votes), 0.5) for r in own])
        size = 1 + 2 * N_VOTES + HASHED
        w = np.zeros(size)
        step = 4.0 / (max(map(len, places)) * np.maximum(np.bincount(col, minlength=size), 0.01 * len(own)))  # below the curvature's bound
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.bincount(row, w[col], len(own))))
            w += step * (np.bincount(col, (y - p)[row], size) - 1e-4 * len(own) * w)
        out[kind] = w
    return out


def probability(weights: np.ndarray) -> Column:
    """The logistic of a span's weights, in SQL."""
    w = F.array(*(F.lit(float(x)) for x in weights), F.lit(0.0))  # the last one is that of no vote
    none = F.lit(len(weights))
    voted = F.transform("votes", lambda v, j: F.element_at(w, F.when(v > 0, 1 + j).when(v < 0, 1 + N_VOTES + j).otherwise(none) + 1))

    def word(sign: str, c: str) -> Column:
        place = F.pmod(F.crc32(F.concat(F.lit(sign), F.col(c)).cast("binary")), F.lit(HASHED))
        return F.element_at(w, (place + 2 + 2 * N_VOTES).cast("int"))

    logit = F.aggregate(voted, F.lit(float(weights[0])), lambda acc, x: acc + x) + word("b:", "before") + word("a:", "after")
    return 1 / (1 + F.exp(-logit))


def score(weights: dict[str, np.ndarray], posterior: dict[str, dict[tuple[int, ...], float]]) -> Column:
    """The classifier's probability of a span; a kind without weights has the posterior of its votes."""
    out = F.lit(0.5)
    for kind in KINDS:
        if kind in weights:
            p = probability(weights[kind])
        else:
            p = F.lit(0.5)
            for votes, q in posterior.get(kind, {}).items():
                p = F.when(F.col("votes") == F.array(*map(F.lit, votes)), q).otherwise(p)
        out = F.when(F.col("kind") == kind, p).otherwise(out)
    return out


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_results", "page_id", "plain_text", "n_lines").where("plain_text <> ''")
    return written(pages.dropDuplicates(["page_id"]))


def classified(pages: DataFrame) -> DataFrame:
    """Spans that the final classifier takes, of overlapping ones the likelier: page_id, para, at, kind, value, p."""
    names, hints = learn_names(pages)
    spans = written(likely_spans(candidate_spans(pages, names, hints), names))
    patterns: dict[str, list] = {k: [] for k in KINDS}
    for r in spans.groupBy("kind", "votes").count().collect():  # at most 5 x 3^5 patterns
        patterns[r.kind].append((tuple(r.votes), r["count"]))
    posterior = {k: reliabilities(p)[0] for k, p in patterns.items()}
    part = F.lit(1.0)  # of each kind's spans, so that about TRAIN_SPANS are drawn, by a hash of their place
    for k, p in patterns.items():
        part = F.when(F.col("kind") == k, min(1.0, TRAIN_SPANS / max(1, sum(n for _, n in p)))).otherwise(part)
    drawn = F.pmod(F.xxhash64("page_id", "para", "at", "kind"), F.lit(1_000_000)) < part * 1_000_000
    sample = spans.where(drawn).select("kind", "votes", "before", "after").collect()
    scored = spans.withColumn("p", score(fit(sample, posterior), posterior)).where("p >= 0.5")
    # The same characters may be a span of two kinds: the likelier one stays.
    best = scored.groupBy("page_id", "para", "at").agg(F.max_by(F.struct("kind", "value", "p"), F.struct("p", "kind")).alias("x"))
    return best.select("page_id", "para", "at", "x.kind", "x.value", "x.p")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(pages_of(spark, sf_dir)).select("page_id", "kind", "value").distinct()


def redacted(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """text with spans (paragraph, place in it, length, placeholder) replaced where they stand; what is not in a span stays as it is."""
    by: dict[int, list] = {}
    for k, at, n, tag in spans:
        by.setdefault(k, []).append((at, n, tag))
    out, done = [], 0
    for k, (start, end) in enumerate(paragraph_places(text)):
        if k not in by:
            continue
        places: list[int] = []  # of each sign of the paragraph as paragraphs() gives it
        for m in re.finditer(r"\S+", text[start:end]):
            places += [*range(start + m.start(), start + m.end()), start + m.end()]
        for at, n, tag in sorted(by[k]):
            if places[at] >= done:
                out += [text[done : places[at]], tag]
                done = places[at + n - 1] + 1
    return "".join(out) + text[done:]


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] in place of what was found; the rest stays as it is."""
    spans = F.collect_list(F.struct("para", "at", F.length("value").alias("n"), F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("tag")))
    found = classified(pages_of(spark, sf_dir)).groupBy("page_id").agg(spans.alias("found"))  # the data of one page
    pages = table(spark, sf_dir, "page_results", "page_id", "plain_text").dropDuplicates(["page_id"])

    @F.pandas_udf("string")
    def redact(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else redacted(t, [(s["para"], s["at"], s["n"], s["tag"]) for s in f]) for t, f in zip(text, found, strict=True)], dtype="object")

    with_any = pages.join(found, "page_id", "left")
    text = F.when(F.col("found").isNull(), F.col("plain_text")).otherwise(redact("plain_text", "found"))
    return with_any.select("page_id", text.alias("text"), F.coalesce(F.size("found"), F.lit(0)).alias("n_found"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE: dict[str, str] = {}

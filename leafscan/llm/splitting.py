"""Problem 8: texts above a limit of tokens cut into overlapping pieces at natural places, by pointer doubling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.packing import settings_of
from leafscan.llm.tokenizer import transducer
from leafscan.llm.tokens import TOKENIZERS, vocabulary
from leafscan.session import table

#: Kinds of place, best first: before a paragraph, before a sentence, before a line, before a word, within a word, within a character.
PARAGRAPH, SENTENCE, LINE, WORD, INSIDE, NEVER = 0, 1, 2, 3, 4, 5
NAMES = ["paragraph", "sentence", "line", "word", "token", "byte", "end"]

PIECES = (
    "limit_id int, doc_id long, piece_no int, start_token int, end_token int, n_tokens int, overlap int, cut string, ids array<int>, text string"
)

_TERMINAL = np.zeros(256, bool)
_TERMINAL[list(b".!?")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"'\")]")] = True


def boundary_kinds(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Kind of place before each token (and after the last), which start at these bytes of the UTF-8 text.

    Any place within white space is natural: a paragraph's with two line feeds, a line's with one, a sentence's after its end."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    kind = np.full(n + 1, INSIDE, np.int8)
    kind[:-1][(data & 0xC0) == 0x80] = NEVER
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], space.view(np.int8), [0]))))
    first, after = edges[::2], edges[1::2]  # runs of white space
    if len(first):
        feeds = np.concatenate(([0], np.cumsum(data == 10)))
        lines = feeds[after] - feeds[first]
        returns = np.concatenate(([0], np.cumsum(data == 13)))
        one, two, three = (data[np.maximum(first - k, 0)] for k in (1, 2, 3))
        wide = (three == 0xE2) & (two == 0x80) & (one == 0xA6) | (three == 0xE3) & (two == 0x80) & (one == 0x82)
        ended = (_TERMINAL[one] | _CLOSER[one] & _TERMINAL[two] | wide) & (first > 0)
        of_run = np.full(len(first), WORD, np.int8)
        of_run[(lines > 0) | (returns[after] > returns[first])] = LINE
        of_run[ended] = SENTENCE
        of_run[lines > 1] = PARAGRAPH
        size = after - first + 1
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        kind[at] = np.repeat(of_run, size)
    out = kind[starts]
    out[0] = out[-1] = PARAGRAPH
    return out


def last_places(kinds: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(kind, places) of each kind that occurs, best first: the last place of that kind or a better one up to each place, -1 for none."""
    place = np.arange(len(kinds), dtype=np.int32)
    return [(int(k), np.maximum.accumulate(np.where(kinds <= k, place, np.int32(-1)))) for k in np.flatnonzero(np.bincount(kinds))]


def successors(last: list[tuple[int, np.ndarray]], most: int, overlap: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a piece that starts at each place: where it ends, and where the next one starts. stop: each place's text's last place.

    A piece ends at the farthest place of the best kind there is in the second half of what it may hold, else at the farthest
    natural place in the first half, if that is beyond the overlap, else within a word. The next starts overlap tokens before that.
    """
    place = np.arange(len(stop), dtype=np.int32)
    limit = np.minimum(place + np.int32(most), stop)
    least = np.minimum(place + np.int32(max(overlap + 1, most // 2)), limit)
    end = np.full(len(stop), -1, np.int32)
    natural = last[0][1]
    for kind, places in last:
        found = places[limit]
        if kind <= WORD:
            natural = places
        else:
            early = natural[limit]
            ok = (end < 0) & (early > place + overlap)
            end[ok] = early[ok]
        ok = (end < 0) & (found >= least)
        end[ok] = found[ok]
        if end.min() >= 0:
            break
    whole = place + np.int32(most) >= stop
    end[whole] = stop[whole]
    return end, np.where(end >= stop, stop, end - np.int32(overlap))


def starts_by_doubling(nxt: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Every start that is reached from the places first, by squaring the table of successors: after k rounds 2^k steps are known."""
    reached = np.zeros(len(nxt), bool)
    reached[first] = True
    jump, known = nxt, first
    while True:
        new = np.unique(jump[known])
        new = new[~reached[new]]
        if not len(new):
            break
        reached[new] = True
        known = np.flatnonzero(reached)
        jump = jump[jump]
    reached[stop[first]] = False
    return np.flatnonzero(reached)


def cut(kinds: np.ndarray, first: np.ndarray, most: int, overlap: int, last: list[tuple[int, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of texts whose places stand one after the other, each text's from first on.

    A place from which going back by the overlap would land within a character counts as being within one itself."""
    stop = np.repeat(np.append(first[1:], len(kinds)) - 1, np.diff(np.append(first, len(kinds)))).astype(np.int32)
    if last is None or overlap and (kinds == NEVER).any():
        own = kinds.copy()
        own[overlap:][kinds[: len(kinds) - overlap] == NEVER] = NEVER
        own[first] = own[stop[first]] = PARAGRAPH
        last = last_places(own)
    end, nxt = successors(last, most, overlap, stop)
    starts = starts_by_doubling(nxt, first, stop)
    return starts, end[starts]


#: Texts are cut together until they hold so many tokens.
AT_ONCE = 500_000


def split(
    docs: DataFrame, settings: list[tuple[int, int, int]], path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every text with more than piece_max tokens, for each setting (limit_id, piece_max, piece_overlap).

    Pieces are numbered from 0, hold piece_max tokens or fewer, cover all tokens of the text in order, and share
    exactly piece_overlap tokens with the next. cut says what kind of place a piece ends at ("end" the last).
    Pieces begin and end between characters; only where a limit is too small for that, a character's bytes at the edge
    are left out of a piece's text (not of its ids).
    A text within the limit, an empty or a null one gives no row. Repeated rows give repeated pieces; other columns are
    dropped. No shuffle: texts are cut where they are read, many at once.
    """
    for _, most, overlap in settings:
        if not 0 <= overlap < most:
            raise ValueError("the overlap must be less than the size of a piece")
    smallest = min((most for _, most, _ in settings), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        lengths = np.zeros(max(t.tokens) + 1, np.int64)
        for i, token in t.tokens.items():
            lengths[i] = len(token)
        held: list[tuple[int, bytes, list[int]]] = []
        n = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace") if text else b""
                if len(raw) <= smallest:
                    continue  # no more bytes than a piece may have tokens
                ids = t.encode(text)
                if len(ids) > smallest:
                    held.append((doc_id, raw, ids))
                    n += len(ids)
                if n > AT_ONCE:
                    yield from _pieces(held, settings, lengths)
                    held, n = [], 0
        if held:
            yield from _pieces(held, settings, lengths)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, PIECES).withColumnRenamed("doc_id", id_col)


def _pieces(texts: list[tuple[int, bytes, list[int]]], settings: list[tuple[int, int, int]], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces of texts (id, UTF-8, tokens), those of one setting after those of another. Places: one before each token and one after the last."""
    doc_ids = np.array([d for d, _, _ in texts], np.int64)
    n = np.array([len(ids) for _, _, ids in texts])
    ids = np.fromiter(chain.from_iterable(x for _, _, x in texts), np.int32, int(n.sum()))
    raw = b"\0".join(r for _, r, _ in texts)  # so that white space of two texts doesn't meet
    first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    step = np.ones(len(ids) + len(texts), np.int64)  # bytes from each place to the next; from a text to the next one it is the \0
    step[np.delete(np.arange(len(step)), first + n)] = lengths[ids]
    at = np.concatenate(([0], np.cumsum(step)[:-1]))
    kinds = boundary_kinds(raw, at)
    kinds[first] = kinds[first + n] = PARAGRAPH
    token = np.arange(len(at)) - np.repeat(np.arange(len(texts)), n + 1)  # of each place the token after it, counted through
    data = np.frombuffer(raw + b"\0", np.uint8)
    edge = np.flatnonzero((data & 0xC0) != 0x80)
    last = last_places(kinds)
    for limit_id, most, overlap in settings:
        own = np.flatnonzero(n > most)
        if not len(own):
            continue
        if len(own) == len(texts):
            k, f, at_k = kinds, first, None
            starts, ends = cut(k, f, most, overlap, last)
        else:
            at_k = np.flatnonzero(np.repeat(n > most, n + 1))
            f = np.concatenate(([0], np.cumsum(n[own] + 1)[:-1]))
            starts, ends = cut(kinds[at_k], f, most, overlap)
            starts, ends = at_k[starts], at_k[ends]
        doc = np.searchsorted(first, starts, "right") - 1
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        no = np.arange(len(starts)) - np.repeat(begins, np.diff(np.append(begins, len(starts))))
        size = ends - starts
        kind = np.where(ends == first[doc] + n[doc], 6, kinds[ends])
        x, y = edge[np.searchsorted(edge, at[starts])], edge[np.searchsorted(edge, at[ends], "right") - 1]
        slices = [raw[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        i32, a = pa.int32(), token[starts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(starts), limit_id), i32), pa.array(doc_ids[doc]), pa.array(no, i32), pa.array(starts - first[doc], i32), pa.array(ends - first[doc], i32),
                pa.array(size, i32), pa.array(np.where(no > 0, overlap, 0), i32), pa.DictionaryArray.from_arrays(pa.array(kind, i32), pa.array(NAMES)).cast(pa.string()),
                _lists(np.concatenate([ids[i:j] for i, j in zip(a.tolist(), (a + size).tolist(), strict=True)]), size), _strings(slices),
            ],
            names=["limit_id", "doc_id", "piece_no", "start_token", "end_token", "n_tokens", "overlap", "cut", "ids", "text"],
        )


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def _strings(slices: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in slices]))).astype(np.int32)
    return pa.StringArray.from_buffers(len(slices), pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(slices)))


def p8_pieces(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    by_tokenizer: dict[str, list[tuple[int, int, int]]] = {}
    for r in settings_of(spark, sf_dir):
        by_tokenizer.setdefault(r.tokenizer, []).append((r.limit_id, r.piece_max, r.piece_overlap))
    parts = [split(docs, s, vocabulary(name, folder)) for name, s in sorted(by_tokenizer.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_pieces": p8_pieces}
ORACLE: dict[str, str] = {}

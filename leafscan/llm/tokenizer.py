"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are the encoding
of their own joined bytes. So after each byte of a word there is one last token, and a transducer needs
to remember only the starts from which a longer token may still grow. Its deterministic states are
built when first reached; a token is written as soon as all open paths agree on it, which is after at
most one longest token of lookahead.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex

#: Fixed value: where byte_bpe texts are split before merging. Unicode White_Space is spelled out, as \s differs among engines.
_WS = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)

#: Texts without signs from here on are split by the standard library's engine, with the same classes written out as ranges.
FAR = 0x3000
_FAR = re.compile(f"[^\\x00-\\u{FAR - 1:04x}]")


@lru_cache(maxsize=1)
def near_words() -> re.Pattern:
    """WORDS for texts of signs below FAR only."""

    def ranges(category: str) -> str:
        own = [k for k in range(FAR) if unicodedata.category(chr(k))[0] == category]
        starts = [k for k in own if k - 1 not in held] if (held := set(own)) else []
        ends = [k for k in own if k + 1 not in held]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    letter, number = ranges("L"), ranges("N")
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{_WS}{letter}{number}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class BpeTransducer:
    """Encodes by a vocabulary of merge ranks (bytes -> id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_words: int = 400_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.max_states, self.max_words = max_states, max_words
        self._compatible: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((b"", -1, ()),)
        self._ids = {start: 0}
        self._states = [start]
        self._moves: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; used only on two tokens' bytes to learn whether they may be neighbours."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in self.ranks:
                break
            parts[best : best + 2] = [joined]
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self._compatible.get(key)
        if ok is None:
            ok = self._compatible[key] = self._merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """Determinise one move: (tokens that all open paths share, next state)."""
        unit, open_paths, done = bytes([byte]), [], None
        for pending, last, path in self._states[state]:
            grown = pending + unit
            t = self.ranks.get(grown)
            if t is not None and (last < 0 or self._fits(last, t)):
                done = (b"", t, (*path, t))
            if grown in self.prefixes:
                open_paths.append((grown, last, path))
        if done is None:
            raise ValueError("vocabulary lacks single bytes")
        items = [*open_paths, done]
        shared = 0
        paths = [p for _, _, p in items]
        shortest = min(map(len, paths))
        while shared < shortest and all(p[shared] == paths[0][shared] for p in paths):
            shared += 1
        out = paths[0][:shared]
        nxt = tuple((pending, last, p[shared:]) for pending, last, p in items)
        k = self._ids.get(nxt)
        if k is None:
            k = self._ids[nxt] = len(self._states)
            self._states.append(nxt)
            self._moves.append({})
        move = self._moves[state][byte] = (out, k)
        return move

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        if len(self._states) > self.max_states:
            self._reset()
        state, out, moves = 0, [], self._moves
        for b in data:
            move = moves[state].get(b) or self._step(state, b)
            out.extend(move[0])
            state = move[1]
        return (*out, *self._states[state][-1][2])

    def encode(self, text: str | None) -> list[int]:
        """Ids of text without special tokens; [] of an empty or null text."""
        if not text:
            return []
        words = self._words
        found = (WORDS if _FAR.search(text) else near_words()).findall(text)
        got = list(map(words.get, found))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    w = found[k]
                    ids = got[k] = words.get(w) or self.encode_word(w.encode("utf-8", "replace"))
                    if len(w) <= 64:
                        if len(words) >= self.max_words:
                            words.clear()
                        words[w] = ids
        return list(chain.from_iterable(got))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(utf8_stream(self.tokens[i] for i in ids))


def utf8_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of byte chunks that may end inside a character; ill-formed bytes come out as U+FFFD.

    State: the value so far, how many bytes are awaited, and the range the next one must lie in.
    """
    value = need = 0
    low, high = 0x80, 0xBF
    for chunk in chunks:
        out = []
        for b in chunk:
            if need:
                if low <= b <= high:
                    value, need = value << 6 | b & 0x3F, need - 1
                    low, high = 0x80, 0xBF
                    if not need:
                        out.append(chr(value))
                    continue
                out.append("\ufffd")
                need, low, high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                value, need = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                value, need = b & 0x0F, 2
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                value, need = b & 0x07, 3
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("\ufffd")
        yield "".join(out)
    if need:
        yield "\ufffd"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def transducer(path: str) -> BpeTransducer:
    """The transducer of a vocabulary file, one a Python worker."""
    return BpeTransducer(load_ranks(path))

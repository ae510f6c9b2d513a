"""Pages through a transcription provider: two-pass or one-pass, retries, other models, errors by row.

A provider is any object with the methods of Provider; it is sent to the executors and called there, page by page within a batch, so
it should hold settings only and open its connection on first use. Nothing here calls a network; Mock stands in for tests.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from leafscan.operators import align, usage

#: Seconds before the first retry, which double, and how many there are; models that are tried when one is gone.
FIRST_WAIT, RETRIES = 2.0, 3
STABLE = ("scribe-pro", "scribe-flash")


class CallError(Exception):
    """What a provider raises: a status code where there is one, and a message."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code


class Provider(Protocol):
    """Each call gives (answer, metadata of its tokens or None); lines are (text, [ymin, xmin, ymax, xmax])."""

    def transcribe_text(self, image: bytes | None, model: str, plain: bool = False) -> tuple[str, dict | None]: ...
    def detect_lines(self, image: bytes | None, model: str, plain: bool = False) -> tuple[list[tuple[str, list[int]]], dict | None]: ...
    def transcribe_with_boxes(self, image: bytes | None, model: str, plain: bool = False) -> tuple[list[tuple[str, list[int]]], dict | None]: ...
    def count_input_tokens(self, image: bytes | None, model: str) -> int: ...


class Mock:
    """A fixed answer of four lines; nothing is billed."""

    LINES = ("A mock reading of the page.", "It needs no key and no network.", "Every line has a box of its own.", "A real provider takes its place.")
    TOP, STEP, HEIGHT, LEFT, RIGHT = 120, 180, 110, 80, 920

    def boxes(self) -> list[tuple[str, list[int]]]:
        tops = [self.TOP + k * self.STEP for k in range(len(self.LINES))]
        return [(t, [y, self.LEFT, y + self.HEIGHT, self.RIGHT]) for t, y in zip(self.LINES, tops, strict=True)]

    def transcribe_text(self, image: bytes | None, model: str, plain: bool = False) -> tuple[str, dict | None]:
        return "\n".join(self.LINES), None

    def detect_lines(self, image: bytes | None, model: str, plain: bool = False) -> tuple[list[tuple[str, list[int]]], dict | None]:
        return self.boxes(), None

    transcribe_with_boxes = detect_lines

    def count_input_tokens(self, image: bytes | None, model: str) -> int:
        return 0


def kind_of(e: Exception) -> str:
    """auth, gone, transient or other; the same as usage.error_class."""
    code, m = getattr(e, "code", None), f"{type(e).__name__} {e}".upper()
    for kind, codes, words in (("auth", usage.AUTH_CODES, usage.AUTH), ("gone", usage.GONE_CODES, usage.GONE), ("transient", usage.AGAIN_CODES, usage.AGAIN)):
        if code in codes or any(w in m for w in words):
            return kind
    return "other"


class Caller:
    """Calls with retries and other models. dead remembers models that are gone; tokens adds up what successful calls were billed."""

    def __init__(self, wait: Callable[[float], None] = time.sleep, stable: tuple[str, ...] = STABLE):
        self.wait, self.stable, self.dead = wait, stable, set()
        self.tokens = {"input": 0, "output": 0, "thinking": 0, "calls": 0}

    def bill(self, meta: dict | None) -> None:
        n = {k: v if isinstance(v := (meta or {}).get(k), int) else 0 for k in ("prompt", "candidates", "thoughts")}
        total = (meta or {}).get("total")
        out = n["candidates"] or (max(0, total - n["prompt"] - n["thoughts"]) if isinstance(total, int) else 0)
        for k, v in (("input", n["prompt"]), ("output", out), ("thinking", n["thoughts"]), ("calls", 1)):
            self.tokens[k] += v

    def patiently(self, call: Callable[[], tuple]) -> object:
        for turn in range(RETRIES + 1):
            try:
                answer, meta = call()
            except Exception as e:
                if turn == RETRIES or kind_of(e) != "transient":
                    raise
                self.wait(FIRST_WAIT * 2**turn)
            else:
                self.bill(meta)
                return answer

    def __call__(self, method: Callable, image: bytes | None, model: str) -> object:
        order = list(dict.fromkeys((model, *self.stable)))
        last: Exception | None = None
        for m in [x for x in order if x not in self.dead] or order:
            try:
                try:
                    return self.patiently(lambda m=m: method(image, m))
                except Exception as e:
                    if kind_of(e) in ("gone", "transient"):
                        raise
                    return self.patiently(lambda m=m: method(image, m, plain=True))  # without the options that a model may not know
            except Exception as e:
                if kind_of(e) != "gone":
                    raise
                self.dead.add(m)
                last = e
        raise CallError(f"no model could be reached, tried {', '.join(order)}: {last}", 404)


def read_page(provider: Provider, call: Caller, image: bytes | None, model: str, mode: str) -> list[align.Placed]:
    if mode == "one_pass":
        return [align.Placed(t, tuple(b), False) for t, b in call(provider.transcribe_with_boxes, image, model)]
    text = call(provider.transcribe_text, image, model)
    boxes = call(provider.detect_lines, image, model)
    return align.place_lines(text.splitlines(), [(t, tuple(b)) for t, b in boxes])


READ = "page_id long, line_no int, text string, box_2d array<int>, is_interpolated boolean, error string, kind string, tokens string"


def transcribe(pages: DataFrame, provider: Provider, stable: tuple[str, ...] = STABLE, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Lines of pages (page_id, image, model, mode): one row a line, boxes in thousandths; mode text makes no call and gives no row.

    A page that fails gives one row with its error and its kind; the others go on. A failed try is billed nothing; tokens (JSON), on
    a page's first row, is what its successful calls took. No shuffle. A model that is gone is remembered by task."""
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dead: set[str] = set()
        for b in batches:
            rows: list[tuple] = []
            for page, image, model, mode in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if mode == "text":
                    continue
                call = Caller(wait, stable)
                call.dead = dead
                try:
                    own = [(page, k, p.text, list(p.box), p.interpolated, None, None, None) for k, p in enumerate(read_page(provider, call, image, model or stable[0], mode))]
                except Exception as e:  # noqa: BLE001
                    own = [(page, None, None, None, None, str(e).split("{")[0].strip()[:140] or "error", kind_of(e), None)]
                if own:
                    own[0] = (*own[0][:-1], json.dumps(call.tokens))
                rows += own
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return pages.select("page_id", "image", "model", "mode").mapInArrow(run, READ)

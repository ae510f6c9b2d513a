"""Problem 6: the corpus as token ids; token counts for problems 7 and 8."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.tokenizer import transducer
from leafscan.session import table

#: Folder of the public tokenizers' files; every query takes another one as a parameter.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"


def vocabulary(tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{tokenizer}.tiktoken"


def int_lists(rows: list[list[int]]) -> pa.Array:
    """rows as one Arrow list<int32> column."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) of every row: token ids of the text, without special tokens.

    An empty or null text has an empty list; a null id stays null; repeated rows come out as often as
    they go in; other columns are dropped. No shuffle: one pass over the two columns, batch by batch.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            step = 512
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                ids = int_lists([t.encode(x) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of every row of ids, through the streaming UTF-8 decoder; null ids give a null text."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            texts = [None if x is None else t.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    src = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "id long, text string").select(F.col("id").alias(id_col), "text")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row; an empty or null text has 0."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n = pa.array([len(t.encode(x)) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=["id", "n_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_tokens long").select(F.col("id").alias(id_col), "n_tokens")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, and whether decoding them gives the text back (null counts as empty)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [t.encode(x) for x in texts]
            same = [t.decode(i) == (x or "") for i, x in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "same"]
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, same boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
ORACLE: dict[str, str] = {}

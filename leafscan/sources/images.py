"""Page images: sizes and counts of pages from their headers, without decoding them."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.sources.formats import EXTENSIONS, is_supported, page_stem

FRAMES = "array<struct<width:int,height:int,thumbnail:boolean>>"
#: TIFF tags of a frame's kind, width and height; bits of the kind that mark a thumbnail or a mask.
KIND, WIDTH, HEIGHT, NOT_A_PAGE = 254, 256, 257, 0b101


def tiff_frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(width, height, thumbnail) of each frame; ends where the chain of directories ends or turns back."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at + 2 + 12 * k)
            tags[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
        yield tags.get(WIDTH, 0), tags.get(HEIGHT, 0), bool(tags.get(KIND, 0) & NOT_A_PAGE)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(data):
        mark, size = struct.unpack_from(">xBH", data, at)
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        at += 2 + size
    raise ValueError("no frame header")


def frames(data: bytes | None) -> list[tuple[int, int, bool]] | None:
    """Frames of a TIFF, PNG, JPEG, GIF or PDF file (a PDF's pages have no size here); null if it can't be read."""
    try:
        if data[:2] in (b"II", b"MM"):
            return list(tiff_frames(data))
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return [(*struct.unpack_from(">II", data, 16), False)]
        if data[:2] == b"\xff\xd8":
            return [(*jpeg_size(data), False)]
        if data[:4] == b"GIF8":
            return [(*struct.unpack_from("<HH", data, 6), False)]
        if data[:5] == b"%PDF-":
            n = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
            counts = [int(x) for x in re.findall(rb"/Count\s+(\d+)", data)]
            return [(0, 0, False)] * max([n, *counts])
    except (struct.error, KeyError, ValueError, TypeError, IndexError):
        return None
    return None


def frames_of(content: Column | str) -> Column:
    """frames() of a column of files, each in a batch."""

    def run(files: pd.Series) -> pd.Series:
        return pd.Series([None if (f := frames(c)) is None else [{"width": w, "height": h, "thumbnail": t} for w, h, t in f] for c in files], dtype="object")

    run.__annotations__ = {"files": pd.Series, "return": pd.Series}  # a type string can't be read in a Python worker
    return F.pandas_udf(run, FRAMES)(content)


def content_pages(frames_: Column) -> Column:
    """How many frames are pages: thumbnails aside where there is more than one, all if all are thumbnails; 1 if a file can't be read."""
    pages = F.size(F.filter(frames_, lambda f: ~f["thumbnail"]))
    n = F.size(frames_)
    return F.when(frames_.isNull() | (n == 0), 1).when((n == 1) | (pages == 0), n).otherwise(pages)


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(supported files (path, name, size, content) of a file or a folder, not below it, ordered by path; how many others there are)."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    found = found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), "content")
    ok = is_supported(F.col("name"))
    if not os.path.isdir(path) and not path.lower().endswith(EXTENSIONS):
        raise ValueError("not a supported file")
    return found.where(ok).orderBy("path"), found.select("name").where(~ok).count()


def page_table(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, name, page_no, frame, width, height, stem): one row a page of files (path, name, content), thumbnails left out.

    most: only the first pages of each file. The images themselves stay in the files."""
    f = files.select("path", "name", frames_of("content").alias("frames"))
    f = f.withColumn("frames", F.coalesce("frames", F.array(F.struct(F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(False).alias("thumbnail")))))
    numbered = F.transform("frames", lambda x, i: F.struct(i.alias("frame"), x["width"].alias("width"), x["height"].alias("height"), x["thumbnail"].alias("thumbnail")))
    own = F.filter(numbered, lambda x: ~x["thumbnail"])
    own = F.when(F.size(numbered) == 1, numbered).when(F.size(own) == 0, F.slice(numbered, 1, 1)).otherwise(own)
    f = f.withColumn("ps", own if most is None else F.slice(own, F.lit(1), F.lit(most))).withColumn("n", F.size(own))
    rows = f.select("path", "name", "n", F.posexplode("ps").alias("k", "p"))
    return rows.select("path", "name", (F.col("k") + 1).alias("page_no"), "p.frame", "p.width", "p.height", page_stem(F.col("name"), F.col("k") + 1, F.col("n")).alias("stem"))

"""Jobs over files: selection, upload batches, states and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Files and bytes of one upload batch at most.
BATCH_FILES, BATCH_BYTES = 20, 256 * 1024 * 1024


def upload_batches(files: DataFrame, group: str, order: str, size: str, most_files: int = BATCH_FILES, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """(group, order, batch) of files in order: a batch is closed when one more file would exceed either limit; a larger file is alone.

    The rule depends on all files before, so a group's files (one user's selection) are one array, gone through once."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= most_files) | (acc["bytes"] + x["s"] > most_bytes))
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        n = F.when(full, F.lit(1)).otherwise(acc["n"] + 1)
        held = F.when(full, x["s"]).otherwise(acc["bytes"] + x["s"])
        return F.struct(batch.alias("batch"), n.alias("n"), held.alias("bytes"), F.concat(acc["out"], F.array(batch)).alias("out"))

    g = files.groupBy(group).agg(items.alias("xs"))
    g = g.withColumn("b", F.aggregate("xs", start, add, lambda acc: acc["out"]))
    return g.select(group, F.inline(F.zip_with("xs", "b", lambda x, b: F.struct(x["k"].alias(order), b.alias("batch")))))


def asked_for(files: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """files whose key is asked for; keys that no file has are left out."""
    return files.join(asked.select(key).distinct(), key, "left_semi")


def missing_from(todo: DataFrame, held: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """todo without what is held already; all of it if forced."""
    return todo if force else todo.join(held.select(*keys).distinct(), keys, "left_anti")


def final_status(stopped: Column, cancelled: Column, error: Column, running: Column) -> Column:
    return F.when(error, "error").when(running, "running").when(stopped, "stopped").when(cancelled, "cancelled").otherwise("done")


def new_log_lines(log: DataFrame, total: str, at: str, shown: Column) -> DataFrame:
    """Lines of a capped log (absolute index at of total) that a reader who has seen shown lines lacks; one who has seen more than there
    are begins anew."""
    seen = F.when(F.col(total) < shown, 0).otherwise(shown)
    return log.where(F.col(at) >= seen)


def first_pages(pages: DataFrame, file: str, page: str, most: int) -> DataFrame:
    """The first pages of each file: a limit by file, which is what this does."""
    return pages.withColumn("__r", F.row_number().over(W.partitionBy(file).orderBy(page))).where(F.col("__r") <= most).drop("__r")


def all_known_total(value: Column) -> Column:
    """The sum, but null while any value is unknown."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value).cast("long"))


#: Endings of each kind of output.
ENDINGS = {"txt": (".txt",), "hocr": (".hocr",), "alto": (".alto.xml",), "pdf": (".pdf",)}
ROOM, SPARE = 1.02, 8 * 1024 * 1024


def downloads(names: DataFrame, name: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """names that belong in an archive of the kinds asked for (all if None), never page images; unknown kinds alone are an error."""
    own = tuple(k for k in (kinds or ENDINGS) if k in ENDINGS)
    if not own:
        raise ValueError("no known kind of output was asked for")
    ends = [e for k in own for e in ENDINGS[k]]
    ok = F.lit(False)
    for e in ends:
        ok = ok | F.coalesce(F.col(name).endswith(e), F.lit(False))
    return names.where(ok)


def room_needed(size: Column) -> Column:
    """Bytes that must be free to build an archive of files of this size in all."""
    return F.floor(size * ROOM).cast("long") + SPARE

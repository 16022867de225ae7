"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a word: space and the control characters 0x09 to 0x0D. bytes.split() without
#: arguments cuts at exactly these six bytes, so UTF-8 words need no regular expression.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: A key with more than one in so many rows is hot; there are fewer such keys than this, whatever the input.
HOT_KEYS = 10_000

_MADE: list[str] = []
#: Where a run of its own notes what its operators leave in the shared folder; threads have scopes of their own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths that operators called within it make, in order; scopes don't see each other's."""
    own: list[str] = []
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, a new folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tonearm-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return path


#: Seconds between two clearings of the driver, at least.
CLEARED_EVERY = 15
_CLEARED = [0.0]


def clear_driver(spark: SparkSession) -> None:
    """Lets the driver's heap shrink to what is still used: plans that no frame refers to any longer, and their broadcasts.

    The heap of a driver that runs many small jobs grows to its limit before it is collected.
    """
    if time.monotonic() - _CLEARED[0] >= CLEARED_EVERY:
        gc.collect()  # frames hold their plans until Python gives them up
        spark._jvm.java.lang.System.gc()
        give_back()
        _CLEARED[0] = time.monotonic()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: cuts lineage, survives the loss of any executor."""
    if _SCOPE.get() is not None:  # a run of several stages
        clear_driver(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(path: str) -> None:
    """Removes a folder of the shared folder, if it is there."""
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)
    if path in _MADE:
        _MADE.remove(path)


def made() -> tuple[str, ...]:
    """The tables, blocks and packs that operators of this process have left in the shared folder so far."""
    return tuple(_MADE)


def give_back() -> None:
    """Returns what this process has freed to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over a partition's batches that gives freed memory back at its end: a worker outlives its tasks and stands idle beside later stages."""

    @wraps(work)
    def tidied(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return tidied


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, from one pruned scan; partition counts follow it."""
    total = df.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0]
    return int(total or 0)


def parts_for(total: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-total // per_part))


def joined_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """The inner join of left with right, which has one narrow row a key, without a hot key in one task.

    counts: key and count, the rows of left by key. Keys with more than a ten-thousandth of the rows are
    at most HOT_KEYS, so their rows of right are broadcast; the others are joined by a shuffle.
    """
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = written(right.join(counts.where(F.col("count") * HOT_KEYS > F.lit(total) + 100 * HOT_KEYS), key, "left_semi"), "hot")
    names = F.broadcast(hot.select(key))  # fewer rows than HOT_KEYS
    light = left.join(names, key, "left_anti").join(right.join(names, key, "left_anti").hint("merge"), key)
    return left.join(F.broadcast(hot), key).unionByName(light)

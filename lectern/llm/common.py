"""Helpers shared by the corpus operators: tables, word rules, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z become a-z; every byte that cannot be in a word becomes a space. Bytes over 0x7F are parts of words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in _LOWER
)
#: Java regular expression of the characters between two words of lower-cased text.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The product of a shingle operator's defaults: words in a shingle and the least similarity.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(WORD_TABLE).split()


def split_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the words of a text as an array, by DataFrame functions; none for null. Letters beyond A-Z come in lower
    case too; that moves no word's bounds and makes none of them an ASCII word but those with the Kelvin sign."""
    df = df.withColumn(out, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_GAP))
    ws, size = F.col(out), F.size(out)
    head = F.when(F.get(ws, F.lit(0)) == "", 1).otherwise(0)  # split leaves empty words at the ends
    tail = F.when((F.get(ws, size - 1) == "") & (size > 1), 1).otherwise(0)
    return df.withColumn(out, F.slice(ws, head + 1, F.greatest(size - head - tail, F.lit(0))))


def lower_ascii(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one if all run on this machine;
    on a cluster that is an error, for executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that cut has written so far; DataFrames that read them are of no use after that."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be closing; what is left is a temporary table
            sweep(spark)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/lectern-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add; its own values replace theirs."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def map_chunks(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 1 << 21
) -> DataFrame:
    """mapInArrow with batches cut to about `most` bytes, so that long texts do not pile up in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most):
                out = fn(part)
                if out is not None:
                    yield out
        relax()

    return df.mapInArrow(run, schema)


def relax() -> None:
    """Gives freed memory back at a task's end: an executor's workers live on, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes)) or 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)

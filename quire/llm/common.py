"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in the contracts on plain words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's checkpoint folder and read back, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Only where driver and executors are one process may it be unset; a temporary folder
    stands in there, and anywhere else, where executors could not see that one, it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quire-")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """`folder`, on whatever file system it is, with all that it holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no column of `taken` has it (in any case of letters)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def unit_hash(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the md5 of the joined parts: 52 bits, so exact as a double, and the same in any SQL engine."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


@cache
def _trim() -> Callable[[int], int]:
    """The C library's way to give free memory back; nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """What a Python worker holds but no longer uses goes back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and BATCH_BYTES bytes (or one row), so that what a Python function turns into
    objects at once is bounded, whatever the session's batches are. What earlier batches and tasks left unused is given back."""
    for b in batches:
        give_back()
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > BATCH_BYTES:
                n //= 2
            yield b.slice(at, n)
            at += n


@contextmanager
def small_batches(spark: SparkSession, rows: int = 10_000, size: int = BATCH_BYTES):
    """Holds the session's Arrow batches to `size` bytes and `rows` while jobs run inside; what they were before is put back."""
    most = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.execution.arrow.maxRecordsPerBatch": rows}
    before = {k: spark.conf.get(k) for k in most}
    for k, n in most.items():
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def reduced_groups(batches: Iterable[pa.RecordBatch], reduce: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The columns, sorted by the first, as arrays that hold whole groups of it, each group reduced. `reduce` keeps some rows of
    each group, and the same of what it kept before and of what follows, so a group of any size takes the memory of what it keeps."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if held is not None:
            new = [np.concatenate(x) for x in zip(held, new, strict=True)]
        new = reduce(new)
        at = int(np.searchsorted(new[0], new[0][-1]))
        if at:
            yield [x[:at] for x in new]
        held = [x[at:] for x in new]
    if held is not None:
        yield held


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns, sorted by the first, as lists of arrays that hold whole groups of it; for groups whose size is bounded."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        at = int(np.searchsorted(new[0], new[0][-1]))
        if held and (at or new[0][0] != held[-1][0][-1]):  # the held group has ended
            yield [np.concatenate(x) for x in zip(*held, [c[:at] for c in new], strict=True)]
            held = []
        elif at:
            yield [x[:at] for x in new]
        held.append([x[at:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


SMALL_ROWS = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """A table of a few numbers for each key, written once, and marked for broadcast if it has at most SMALL_ROWS rows (some ten
    megabytes); a larger one is joined by shuffling."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df

"""What the first level of one suffix array over all bytes would take: not a test, but the run that README's figures for operator 7 are
from. `python /opt/check/check.py` runs it where `query` stands in for the operator's in a copy of the registry.

The level is that of the distributed difference-cover algorithm: triples at two thirds of all places are sorted over all tasks and
named by their ranks. The next one would do the same with two thirds as many places, until names stand for 100 bytes: five levels,
then as many merges of the remaining suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, pieces


def _triples(batches):
    for b in pieces(batches, 64):
        for r, t in zip(b.column("r").to_pylist(), b.column("text").to_pylist(), strict=True):
            s = np.concatenate([np.frombuffer((t or "").encode(), np.uint8).astype(np.int32) + 2, [1, 0, 0]]).astype(np.int32)
            at = np.arange(len(s) - 2)
            at = at[at % 3 > 0]
            for i in range(0, len(at), 100_000):
                k = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(s[k] << 18 | s[k + 1] << 9 | s[k + 2]), pa.array((r << 32) + k)], names=["triple", "i"])


def _named(batches):
    last, name = None, -1
    for b in batches:
        t = b.column("triple").to_numpy()
        if len(t):
            new = np.append(last is None or t[0] != last, t[1:] != t[:-1])
            names = name + np.cumsum(new)
            last, name = t[-1], int(names[-1])
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(names)], names=["i", "name"])


def query(spark, sf_dir: str) -> DataFrame:
    """The number of names of the first level in each part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("r"), "text")
    triples = docs.mapInArrow(_triples, "triple int, i long").repartitionByRange("triple").sortWithinPartitions("triple")
    named = cut(triples.mapInArrow(_named, "i long, name long"))
    return named.groupBy(F.spark_partition_id().alias("part")).agg((F.max("name") + 1).alias("names"))

"""Running Python rules over DataFrames: row by row without a shuffle, or over the ordered rows of a key as a stream."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as parse

#: Rows handed to Python at once; texts make rows large.
SLICE = 256


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def flat_map(df: DataFrame, function: Callable[..., Iterable[tuple]], schema: str, once: Callable[[], object] | None = None, ahead: Callable[[list], list] | None = None) -> DataFrame:
    """`function(*row)` yields result rows, for each row of `df`; nothing is shuffled. With `once`, what it makes in each task (a
    client, say) is the function's first argument. `ahead` makes a slice's values of the last column new, all together."""
    kind = parse(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, made = _arrow(kind), (once(),) if once else ()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = [c.to_pylist() for c in b.slice(at, SLICE).columns]
                if ahead:
                    part[-1] = ahead(part[-1])
                yield _batch([out for row in zip(*part, strict=True) for out in function(*made, *row)], arrow)

    return df.mapInArrow(run, kind)


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder of the session (`spark.checkpoint.dir`) and read back: for what costs more to make than
    to write, and is read several times. Only where driver and executors are one process may that be unset; a temporary folder
    stands in there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """As many partitions as a shuffle has. Given as a number it holds: small shuffles are otherwise joined to one or two tasks, also
    where rules cost far more than moving the rows."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(df: DataFrame, key: list[str], order: list[str], function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """`function(rows)` yields result rows for each key's rows in order. Rows stream past in sorted partitions, so a key of any
    size takes only the memory of the function's own, bounded, state."""
    kind, names = parse(schema), df.columns
    at = [names.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(kind)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(0, b.num_rows, SLICE):
                    yield from zip(*(c.to_pylist() for c in b.slice(i, SLICE).columns), strict=True)

        held: list[tuple] = []
        for _, own in groupby(rows(), key=lambda r: tuple(r[i] for i in at)):
            for out in function(own):
                held.append(out)
                if len(held) >= SLICE:
                    yield _batch(held, arrow)
                    held = []
        yield _batch(held, arrow)

    return df.repartition(partitions(df), *key).sortWithinPartitions(*key, *order).mapInArrow(run, kind)

"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + phase) / source size,
where the phase, a hash of the source in [0, 1), keeps sources of equal size from falling into step.
All rows sorted by fractional rank interleave the sources in proportion, so any stretch of that order, and hence every shard
cut from it, has the mixture of the whole to within a row or so for each source. Cuts fall so that row counts differ by one
at most (law `rows`).

Ranks come without a task that holds a whole source or the whole table: rows are counted by hash bucket, bucket counts are
summed up in order, and rows are ranked within their bucket only, which holds about `per_bucket` rows however large a source is.

Defined results: a null text has size 16 and crc 0; a null source is a source of its own; a null doc_id counts as empty. Rows
that share a doc_id, or have none, are told apart by their texts' crc in the shuffle; rows that are equal in everything are
ordered arbitrarily among themselves, which gives the same result. A very long text is one row. An empty table gives an empty
result. Columns beyond doc_id, text and source are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import buckets_for, ranked
from .common import cut, unit_hash

SHARDS, SEED = 40, "shard-1"
ROW_OVERHEAD = 16


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, per_bucket: int = 20_000) -> DataFrame:
    """doc_id, source, size, text_crc32, frac, pos (place in the interleaved order), shard, slot for every row of `docs`."""
    slim = cut(
        docs.select(
            "doc_id", "source",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        ).withColumn("_u", unit_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.col("text_crc32")))
    )
    sizes = slim.groupBy("source").agg(F.count("*").alias("_n")).select(F.col("source").alias("_s"), "_n")
    total = slim.count()
    n = buckets_for(total, per_bucket)
    tie = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    within = ranked(slim, ["source"], F.col("_u"), [F.col("_u"), *tie], n, "_rank")
    within = within.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).withColumn("frac", (F.col("_rank") + unit_hash(seed, "phase", F.coalesce("source", F.lit("")))) / F.col("_n")).drop("_s", "_n")
    ordered = ranked(within.withColumn("_all", F.lit(0)), ["_all"], F.col("frac"), [F.col("frac"), F.col("source"), F.col("_rank"), *tie], n, "pos")
    # shard s takes the places from ceil(s * total / shards) on
    ordered = ordered.withColumn("shard", F.expr(f"cast(pos * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ordered.withColumn("slot", F.col("pos") - first).select("doc_id", "source", "size", "text_crc32", "frac", "pos", "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op8 over all documents: law `rows`, 40 shards."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def oracle() -> str:
    """The same rows in DuckDB; its crc32 is folded byte by byte over the table that the polynomial gives."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, i: {step}) ORDER BY n) AS t FROM (SELECT unnest(range(0, 256)) AS n)),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, source, (length(x) // 2 + {ROW_OVERHEAD})::BIGINT AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))::BIGINT AS text_crc32 FROM d, tab),
e AS (SELECT *, ('0x' || md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), text_crc32::VARCHAR))[1:13])::BIGINT AS u FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY source) AS n FROM e),
o AS (SELECT *, row_number() OVER (ORDER BY (rk + ('0x' || md5(concat_ws(':', '{SEED}', 'phase', coalesce(source, '')))[1:13])::BIGINT / {float(2**52)!r}::DOUBLE) / n, source, rk) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, (pos * {SHARDS} // total)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""

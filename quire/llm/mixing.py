"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n rows and target weight w has the mean repetition rate  rate = w * output rows / n.  Each row's number of
copies is the inverse of the Poisson distribution of that rate at a number in [0, 1) hashed from the seed and the row, so it
depends on nothing but the row and the rate, and a source's expected share of the output is its weight. Rows are then
exploded by their counts and put in one global random order by a hash of seed, row and copy.

Only the table of sources, one small row each, is joined to the documents: broadcast after a check of its size, so a hot
source's rows stay where they are; beyond that size by a shuffle join, which splits skewed partitions.

Defined results: a null source is a source of its own. A source that `weights` omits, or whose weight is 0, gets no copies.
Rows with the same doc_id get the same count; rows without one are told apart by their texts (a null text counts as empty). Ties
in the order are broken by doc_id and copy. An empty table gives an empty result. The text, however long, is carried (and hashed
where there is no doc_id). Extra columns are carried along; `mix` gives those named `replica`, `n_copies` or `mix_key` new values,
the stage leaves them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, if_small, unit_hash

SEED = "mix-1"
#: Default weights: in proportion to rows ** POWER, which lifts small sources.
POWER = 0.7


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, output_rows: int | None = None, power: float = POWER) -> DataFrame:
    """source, rows, weight (sums to 1) and rate (mean copies of a row) for every source."""
    by = docs.select("source").groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        by = by.withColumn("_w", F.pow(F.col("rows").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, _w double")
        by = by.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["_w"])
    all_ = by.agg(F.sum("_w").alias("_sum"), F.sum("rows").alias("_rows"))
    by = by.join(F.broadcast(all_))  # one row
    out = F.lit(output_rows) if output_rows is not None else F.col("_rows")
    weight = F.col("_w") / F.when(F.col("_sum") > 0, F.col("_sum"))
    by = by.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    return by.select("source", "rows", "weight", (F.col("weight") * out / F.col("rows")).alias("rate"))


def _copies(u, rate):
    """The least k with P(Poisson(rate) <= k) > u. The rate is cut into pieces of at most 32, a piece for each its own hash,
    since sums of Poisson numbers are Poisson numbers, so exp(-rate) never underflows."""
    top = 160  # P(Poisson(32) > 160) < 1e-52, far below the hash's step of 2^-52
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(s, _):
        p = s["p"] * rate / (s["k"] + 1)
        return F.when(u < s["c"], s).otherwise(F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["c"] + p).alias("c")))

    most = F.least(F.lit(top), F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)["k"]


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, output_rows: int | None = None, seed: str = SEED, power: float = POWER) -> DataFrame:
    """`docs` with each row repeated `n_copies` times (`replica` from 0), in the global random order of `mix_key`."""
    return _mixed(docs.drop("replica", "n_copies", "mix_key"), weights, output_rows, seed, power, "n_copies", "replica", "mix_key")


def _mixed(docs: DataFrame, weights, output_rows, seed: str, power: float, copies: str, replica: str, order: str) -> DataFrame:
    """`docs` and the three columns named, whose names `docs` lacks."""
    name, rate, parts, part = (fresh(x, docs.columns) for x in ("_mix_source", "_mix_rate", "_mix_parts", "_mix_part"))
    r = if_small(rates(docs, weights, output_rows, power).select(F.col("source").alias(name), F.col("rate").alias(rate)))
    d = docs.join(r, F.col("source").eqNullSafe(F.col(name))).drop(name)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    d = d.withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col(rate) / 32).cast("int"))).withColumn(part, F.col(rate) / F.col(parts))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: _copies(unit_hash(seed, "count", key, i), F.col(part))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn(copies, count).filter(F.col(copies) > 0).drop(rate, parts, part)
    d = d.withColumn(replica, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    return d.withColumn(order, unit_hash(seed, "order", key, F.col(replica))).orderBy(order, "doc_id", replica)


def query(spark, sf_dir: str) -> DataFrame:
    """op6 over all documents: doc_id, source, n_copies, replica, mix_key and the whole text's length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "n_copies", "replica", F.round("mix_key", 12).alias("mix_key"), "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: mixed documents, with the columns of `docs`."""
    return _mixed(docs, None, None, SEED, POWER, *(fresh(x, docs.columns) for x in ("_mix_copies", "_mix_replica", "_mix_order"))).select(*docs.columns)


def oracle() -> str:
    """The same rows in DuckDB, the inversion as a sum over the first terms of the series."""
    u = lambda what, more="": f"('0x' || md5(concat_ws(':', '{SEED}', '{what}', coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))){more}))[1:13])::BIGINT / {float(2**52)!r}::DOUBLE"
    return f"""
WITH s AS (SELECT source, count(*) AS rows, pow(count(*)::DOUBLE, {POWER}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(rows) FROM s) / rows AS rate FROM s),
terms AS (SELECT source, k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS c FROM r, (SELECT unnest(range(0, 60)) AS k)),
d AS (SELECT doc_id, source, text, {u("count", ", 1")} AS u FROM documents),
n AS (SELECT doc_id, source, text, (SELECT count(*) FROM terms WHERE terms.source IS NOT DISTINCT FROM d.source AND c <= u)::INTEGER AS n_copies FROM d)
SELECT doc_id, source, n_copies, replica::INTEGER AS replica, round({u("order", ", replica::VARCHAR")}, 12) AS mix_key, text
FROM (SELECT *, unnest(range(0, n_copies)) AS replica FROM n)"""



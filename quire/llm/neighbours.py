"""Approximate nearest neighbours by NN-descent and greedy graph search.

The neighbour graph starts from random-projection leaves and is improved by iterative Spark joins: every node gathers its
neighbours and reverse neighbours with their vectors, compares them with each other, and offers each its best new partners;
each node keeps its `K` best. A query is answered by greedy search on the finished graph: all queries advance together, each
round expanding every query's best unexpanded nodes by a join with the graph, until a query's `BEAM` best are all expanded.
Every similarity is worked out in double precision from the original vectors, for edges and search as for the answers, and is
held as half the squared distance of unit vectors, negative: a 32-bit number keeps the order of near copies, whose cosines
differ by less than it can tell. All of a beam is scored for the answer.

A node is a different vector, however many rows have it, so a very common vector is one node too; a node stands for its smallest
ids, as many as an answer can hold. Nodes are numbered in the order of their smallest ids, so ties inside go the way of the answer's.
The graph holds a node's neighbours with their vectors, in a table bucketed by node (under `spark.checkpoint.dir`, removed in the
end), so a search round moves only the frontier. All groups are processed as sorted streams of arrays, and what a hub gathers is
kept to its `K` best as it streams. The search ends when every query's beam is expanded; each round expands some of it.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do rows without an id
or vectors whose length is not the commonest one (ties: the longest). Rows that repeat an id with equal vectors count once; an id
with several vectors is one item, as near to another as the nearest of their vectors, and stands in an answer once. With at most
`K` other nodes all candidates are found. An empty table gives an empty result. Columns beyond vec_id and embedding are not
read; the table has no texts.

Recall against brute force: see README; random vectors of 64 dimensions, which have no structure to find, are the hard case
that `BEAM` is set for."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, cut, pieces, reduced_groups, remove_folder, shared_folder, small_batches, whole_groups

K, ITERATIONS, OFFERS = 24, 5, 6
LEAF, TREES, PART_NODES = 256, 3, 8000
BEAM, STEP = 400, 128
ANSWERS, SEED = 5, 11
NONE = -3.0  # below any similarity


def best(key: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best different `other` of each key, by key, best first, ties to the smaller `other`."""
    order = np.lexsort((other, key))
    order = order[np.append(True, (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]))] if len(order) else order
    order = order[np.lexsort((other[order], -score[order], key[order]))]
    sorted_key = key[order]
    start = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _streamed(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(function, schema)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _unit(packed) -> np.ndarray:
    """Unit vectors, in double precision, from an array of packed 32-bit vectors."""
    v = np.frombuffer(b"".join(packed), "<f4").reshape(len(packed), -1).astype(np.float64)
    v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return v


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, v: packed 32-bit vector) for each different vector that takes part, and (node, vec_id) for its smallest ids."""
    ok = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: F.abs(x) > 0)
    ).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    size = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()

    def run(batches):
        for b in pieces(batches):
            e = b.column("embedding")
            flat = e.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(e), -1)
            flat = flat + np.float32(0)  # no negative zeros, so equal vectors have equal bytes
            yield _batch("vec_id v", b.column("vec_id"), pa.array([x.tobytes() for x in flat], pa.binary()))

    packed = ok.filter(F.size("embedding") == (size["d"] if size else 0)).mapInArrow(run, "vec_id long, v binary").distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    near = cut(packed.withColumn("r", first).filter(F.col("r") <= 2 * ANSWERS + 2))
    # Written once, so the numbers stay; then made dense, which small numbers of partitions do.
    numbered = cut(near.filter("r = 1").orderBy("vec_id", "v").select(F.monotonically_increasing_id().alias("n"), "v"))
    part, within = F.shiftright("n", 33).cast("int"), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["count"] for r in numbered.groupBy(part.alias("p")).count().collect()}
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0)))])
    numbered = numbered.select((F.get(F.array(*[F.lit(int(x)) for x in before]), part) + within).cast("long").alias("node"), "v")
    return numbered, near.join(numbered, "v").select("node", "vec_id")


class Tables:
    """Tables bucketed by a key, as joins want them, so they aren't shuffled again; under the shared folder, and removed in the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.folder = f"{shared_folder(spark)}/neighbours-{uuid.uuid4().hex}"

    def add(self, df: DataFrame, key: str) -> DataFrame:
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"quire_{uuid.uuid4().hex}"
        self.names.append(name)
        df.repartition(n, key).write.bucketBy(n, key).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, self.folder)


def leaves(points: DataFrame, parts: int) -> DataFrame:
    """(u, w, s): for each node its K best partners in its leaf of each of TREES random-projection trees. A tree's first split is
    the sort over all tasks, by projection on its direction; the others are made within a partition."""

    def project(batches):
        for b in pieces(batches):
            unit = _unit(b.column("v").to_pylist())
            for t in range(TREES):
                direction = np.random.default_rng(SEED + 10 * t).normal(size=unit.shape[1])
                yield _batch("t p node v", np.full(b.num_rows, t, np.int32), unit @ direction, b.column("node"), b.column("v"))

    def split(batches):
        held = [[c.to_pylist() if n == "v" else c.to_numpy() for n, c in zip(b.schema.names, b.columns, strict=True)] for b in batches if b.num_rows]
        if not held:
            return
        tree, node = (np.concatenate([h[k] for h in held]) for k in (0, 2))
        x = _unit([v for h in held for v in h[3]])
        rng, todo = np.random.default_rng(SEED + 1), [np.flatnonzero(tree == t) for t in range(TREES)]
        while todo:
            i = todo.pop()
            if len(i) > LEAF:
                two = x[rng.choice(i, 2, replace=False)]
                i = i[np.argsort(x[i] @ (two[0] - two[1]), kind="stable")]
                todo += [i[: len(i) // 2], i[len(i) // 2 :]]
            elif len(i) > 1:
                s = (x[i] @ x[i].T - 1).astype(np.float32)
                np.fill_diagonal(s, NONE)
                k = min(K, len(i) - 1)
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield _batch("u w s", np.repeat(node[i], k), node[i][near].ravel(), np.take_along_axis(s, near, 1).ravel())

    points = points.select("node", "v").mapInArrow(project, "t int, p double, node long, v binary")
    return points.repartitionByRange(TREES * parts, "t", "p", "node").sortWithinPartitions("t", "p", "node").mapInArrow(split, "u long, w long, s float")


GRAPH = "u long, w long, s float, least float"


def _kept(batches):
    """The K best edges of each node, with the worst similarity it keeps (NONE while it has room)."""

    def reduce(rows):
        i = best(*rows, K)
        return [x[i] for x in rows]

    for u, w, s in reduced_groups(batches, reduce):
        start = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        size = np.diff(np.append(start, len(u)))
        yield _batch("u w s least", u, w, s, np.repeat(np.where(size >= K, np.minimum.reduceat(s, start), np.float32(NONE)), size))


def kept(edges: DataFrame) -> DataFrame:
    """The K best edges of each node u."""
    return _streamed(edges.select("u", "w", "s"), "u", _kept, GRAPH)


def _members(batches):
    """Of each node, its neighbours and its K nearest reverse neighbours, each once; `least` is a member's worst kept similarity,
    where its own row has told it."""

    def reduce(rows):
        v, m, s, _, reverse = rows
        back = np.flatnonzero(reverse == 1)
        i = np.concatenate([back[best(v[back], m[back], s[back], K)], np.flatnonzero(reverse == 0)])
        i = i[np.argsort(v[i], kind="stable")]
        return [x[i] for x in rows]

    for v, m, _, least, _ in reduced_groups(batches, reduce):
        order = np.lexsort((-least, m, v))
        first = np.append(True, (v[order][1:] != v[order][:-1]) | (m[order][1:] != m[order][:-1]))
        i = order[first]
        yield _batch("v m least", v[i], m[i], least[i])


def _around(graph: DataFrame, points: DataFrame) -> DataFrame:
    """(v, m, x, least): each node's surroundings with their vectors."""
    there = graph.select(F.col("u").alias("v"), F.col("w").alias("m"), "s", F.lit(NONE).cast("float").alias("least"), F.lit(0).alias("reverse"))
    back = graph.select(F.col("w").alias("v"), F.col("u").alias("m"), "s", "least", F.lit(1).alias("reverse"))
    members = _streamed(there.union(back), "v", _members, "v long, m long, least float")
    return members.join(points.select(F.col("node").alias("m"), F.col("v").alias("x")), "m").select("v", "m", "x", "least")


def _offers(batches):
    """In each node's surroundings, for each member its best partners there that beat the worst it has."""
    for v, m, x, least in whole_groups(batches):
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        size = np.diff(np.append(start, len(v)))
        vectors = _unit(x)
        for i in range(0, len(start), 128):
            begin, n = start[i : i + 128], size[i : i + 128]
            at = begin[:, None] + np.arange(n.max())
            real = np.arange(n.max()) < n[:, None]
            at = np.where(real, at, begin[:, None])
            a = vectors[at]
            s = (a @ a.transpose(0, 2, 1) - 1).astype(np.float32)
            s[~(real[:, None, :] & real[:, :, None])] = NONE
            s[:, np.arange(s.shape[1]), np.arange(s.shape[1])] = NONE
            k = min(OFFERS, s.shape[1])
            near = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            score = np.take_along_axis(s, near, 2)
            g, r, c = np.nonzero((score > np.where(real, least[at], 2)[:, :, None]) & (score > NONE))
            yield _batch("u w s", m[at[g, r]], m[at[g, near[g, r, c]]], score[g, r, c])


def descend(points: DataFrame, near: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(u, w, s, least): the neighbour graph of `points` (node, v); `near`: the same, by node."""
    parts = max(1, -(-points.count() // PART_NODES))
    graph = cut(kept(leaves(points, parts)))
    for _ in range(iterations):
        offers = _streamed(_around(graph, near), "v", _offers, "u long, w long, s float")
        graph = cut(kept(graph.select("u", "w", "s").union(offers)))
    return graph


def _index(graph: DataFrame, points: DataFrame, tables: Tables) -> DataFrame:
    """A table bucketed by v: ids and vectors of the surroundings of v."""

    def run(batches):
        for v, m, x, _ in whole_groups(batches):
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            ends = np.append(start[1:], len(v))
            ids = [m[a:b].tobytes() for a, b in zip(start, ends, strict=True)]
            vs = [b"".join(x[a:b]) for a, b in zip(start, ends, strict=True)]
            yield _batch("v ids xs", v[start], pa.array(ids, pa.binary()), pa.array(vs, pa.binary()))

    return tables.add(_around(graph, points).repartition("v").sortWithinPartitions("v").mapInArrow(run, "v long, ids binary, xs binary"), "v")


STATE = "q long, node long, s float, done int, least float, qx binary"


def _expand(batches):
    """Similarities of a query with the surroundings of each node it expands, if they beat its worst."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            ids = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("ids")]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            q = _unit(b.column("qx").to_pylist())
            x = np.frombuffer(b"".join(b.column("xs").to_pylist()), "<f4").reshape(-1, q.shape[1]).astype(np.float64)
            dot = np.concatenate([x[a:z] @ y for y, a, z in zip(q, np.cumsum(size) - size, np.cumsum(size), strict=True)])
            s = (dot / np.sqrt(np.einsum("ij,ij->i", x, x)) - 1).astype(np.float32)
            key, node = np.repeat(b.column("q").to_numpy(), size), np.concatenate(ids)
            ok = s > np.repeat(b.column("least").to_numpy(), size)
            i = best(key[ok], node[ok], s[ok], BEAM)
            n = len(i)
            yield _batch("q node s done least qx", key[ok][i], node[ok][i], s[ok][i], np.zeros(n, np.int32), np.zeros(n, np.float32), pa.nulls(n, pa.binary()))


def _beam(batches):
    """Each query's BEAM best nodes. Of those that aren't expanded (done 0) the STEP best are next (done 1, then 2); with its
    vector and its worst similarity, each can be expanded without another join."""
    for q, node, s, done, _, qx in whole_groups(batches):
        order = np.lexsort((-done, node, q))  # an expanded one stands before its like
        i = order[best(q[order], node[order], s[order], BEAM)]
        have = [k for k, x in enumerate(qx) if x is not None]
        vector = {int(q[k]): qx[k] for k in have}
        q, node, s, done = q[i], node[i], s[i], np.where(done[i] > 0, 2, 0).astype(np.int32)
        todo = np.flatnonzero(done == 0)
        done[todo[best(q[todo], node[todo], s[todo], STEP)]] = 1
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        size = np.diff(np.append(start, len(q)))
        least = np.repeat(np.where(size >= BEAM, np.minimum.reduceat(s, start), np.float32(NONE)), size)
        yield _batch("q node s done least qx", q, node, s, done, least, pa.array([vector[int(k)] for k in q], pa.binary()))


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, tables: Tables) -> DataFrame:
    """(q, node, s): the BEAM best nodes found for each query node of `queries` (q), itself among them."""
    index = _index(graph, points, tables)
    start = queries.join(points.select(F.col("node").alias("q"), F.col("v").alias("qx")), "q")
    state = cut(start.select("q", F.col("q").alias("node"), F.lit(0.0).cast("float").alias("s"), F.lit(1).alias("done"), F.lit(NONE).cast("float").alias("least"), "qx"))
    while not (front := state.filter("done = 1")).isEmpty():
        asked = front.join(index, F.col("node") == F.col("v")).select("q", "least", "qx", "ids", "xs")
        state = cut(_streamed(state.union(asked.mapInArrow(_expand, STATE)), "q", _beam, STATE))
    return state.select("q", "node", "s")


def _exact(batches):
    """Cosines in double precision of the original vectors; of equal ones exactly 1."""
    for b in pieces(batches):
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<f4").reshape(b.num_rows, -1).astype(np.float64) for c in ("v", "qv"))
        s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        yield _batch("q node score", b.column("q"), b.column("node"), np.where((x == y).all(1), 1.0, s))


def nearest(vectors: DataFrame, every: int = 50, answers: int = ANSWERS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for each row whose vec_id is divisible by `every`."""
    points, ids = nodes(vectors)
    own = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")

    def pack_(batches):
        for b in pieces(batches):
            rows = [(i, (np.array(e, "<f4") + np.float32(0)).tobytes()) for i, e in zip(b.column("query_id").to_pylist(), b.column("embedding").to_pylist(), strict=True) if e and None not in e]
            yield _batch("query_id v", pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()))

    asked = cut(own.mapInArrow(pack_, "query_id long, v binary").distinct().join(points.select("v", "node"), "v").select("query_id", F.col("node").alias("q")))
    with small_batches(vectors.sparkSession, BATCH_ROWS), Tables(vectors.sparkSession) as tables:
        near = tables.add(points, "node")
        found = search(descend(points, near), near, asked.select("q").distinct(), tables)
    v = points.select("node", "v")
    both = found.join(v, "node").join(v.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
    scored = both.select("q", "node", "v", "qv").mapInArrow(_exact, "q long, node long, score double")
    rows = asked.join(scored, "q").join(ids, "node").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= answers).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9 over all embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

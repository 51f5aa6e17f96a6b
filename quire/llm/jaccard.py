"""Near-duplicate documents by an exact n-gram Jaccard join.

The join is the sparse product of the document by n-gram incidence matrix with its transpose, done in blocks of n-grams:
documents that share an n-gram column meet, overlap counts add up for each pair, and pairs whose count stays below a bound
that follows from the two set sizes are discarded. Columns are ordered by a sketch of how many documents have them, rarest
first, and only a document's leading columns (its prefix, a fifth) enter the product: sets of Jaccard 0.8 that overlap in o
columns of leading parts fitted to the pair's sizes overlap in at most o plus the columns behind those parts, so o must reach
a bound of up to a fiftieth of the size, and a column behind the fitted part of either set counts for nothing.
For the pairs that remain, overlap is counted over the whole sets, so the result is exact.

Hot groups: documents with equal sets become one class before the join, so copies cost nothing. In a column, a class first
meets only the few classes of the least rank (a star). Rank is the number of a class's rare columns, the same wherever the
class stands, so the text that a group of near copies is closest to meets all of them, which joins up the group in about as
many pairs as it has members. A last product then takes all remaining pairs, but only between classes not yet connected. So no group's pairs are all
emitted, and no link between different components is lost. A passage shared by many documents lies in their common
columns, which come last and hence stay out of prefixes.

What is broadcast: the sketch (`SKETCH_BITS`) and a Bloom filter of at most `BLOOM_MOST` bits. n-grams are compared as
64-bit hashes, within two documents' sets; classes by 64 bits of a hash of the set and its size.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. Repeated rows and
ids get a row each, and rows without an id are linked like others; a component's id is its smallest non-null doc_id, null if it
has none. A very long text is one set, in one row. Equal counts and ranks are ordered by hash, which changes no result. An empty
table gives an empty result. Columns beyond doc_id and text are not read; the stage carries them along, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut, fresh, give_back, if_small, pieces, small_batches, whole_groups
from .graph import components

WORDS = 5
#: Jaccard of at least NUM / DEN.
NUM, DEN = 4, 5
SKETCH_BITS = 20
SLICE = 1 << 12
BLOOM_MOST = 1 << 28
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str | None, known: Words) -> np.ndarray:
    """The hashes of a text's n-grams of words, in place; of all its words as one where they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix(np.array([sum(int(x) * int(m) for x, m in zip(h, MULTIPLIERS, strict=False)) + len(h) & (1 << 64) - 1], np.uint64))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i, m in enumerate(MULTIPLIERS):
        total += h[i : i + n] * m
    return _mix(total)


def shingles(text: str | None, known: Words) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams."""
    h = ngrams(text, known)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def prefix_size(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def needed(a, b):
    """The least overlap of sets of sizes a and b that reach the threshold."""
    return -(-(a + b) * NUM // (NUM + DEN))


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _added(rows: DataFrame, kind: str, combine) -> np.ndarray:
    """Slices (i, part) of arrays, one of each from any task, combined into one array of fixed size."""

    def one(table: pa.Table) -> pa.Table:
        total = None
        for part in table.column("part"):
            x = np.frombuffer(part.as_py(), kind)
            total = x.copy() if total is None else combine(total, x)
        return pa.table({"i": table.column("i").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    got = {r["i"]: np.frombuffer(r["part"], kind) for r in rows.groupBy("i").applyInArrow(one, "i int, part binary").collect()}
    return got


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of n-grams by the leading bits of their hashes: 2^SKETCH_BITS numbers, whatever the input."""

    def run(batches):
        known, total = Words(), np.zeros(1 << SKETCH_BITS, np.int32)
        for b in pieces(batches):
            for at in range(0, b.num_rows, 4096):
                sets = [ngrams(t, known) for t in b.column("text").slice(at, 4096).to_pylist()]
                total += np.bincount(_slot(np.concatenate(sets)), minlength=len(total)).astype(np.int32)
        used = [i for i in range(len(total) // SLICE) if total[i * SLICE : (i + 1) * SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in used], pa.binary())], names=["i", "part"])

    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for i, part in _added(docs.select("text").mapInArrow(run, "i int, part binary"), "<i4", lambda a, b: a + b).items():
        out[i * SLICE : (i + 1) * SLICE] = part
    return out


def postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """h, np (rank and set size, 32 bits each), c, at (place of h in the set, rarest first) for the prefix columns of each class, at least once for each class; and for
    each row of `docs` (doc_id, text, k) one with h = k, np = -1 - set size, its class c (null for an empty set) and its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        known, seen = Words(), set()
        rare = 2 * int(shared.value.mean()) + 8
        for b in pieces(batches):
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                sets = [shingles(t, known) for t in some.column("text").to_pylist()]
                classes = [_class_of(s) if len(s) else None for s in sets]
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                columns = [(some.column("k"), pa.array(-1 - size), pa.array(classes, pa.int64()), pa.nulls(len(sets), pa.int32()), some.column("doc_id"))]
                lead, rank, own, place = [], [], [], []
                for s, c in zip(sets, classes, strict=True):
                    if c is None or c in seen:
                        continue
                    if len(seen) < 500_000:  # only spares copies within a task
                        seen.add(c)
                    p = prefix_size(len(s))
                    often = shared.value[_slot(s)]
                    lead.append(s[np.lexsort((s, often))[:p]].view(np.int64))
                    rank.append(np.full(p, (int(np.count_nonzero(often <= rare)) << 32) + len(s), np.int64))
                    own.append(np.full(p, c, np.int64))
                    place.append(np.arange(p, dtype=np.int32))
                if lead:
                    columns.append((*(pa.array(np.concatenate(x)) for x in (lead, rank, own, place)), pa.nulls(sum(map(len, lead)), pa.int64())))
                for c in columns:
                    yield pa.RecordBatch.from_arrays(list(c), names=["h", "np", "c", "at", "doc_id"])

    return docs.mapInArrow(run, "h long, np long, c long, at int, doc_id long")


SIZE = np.int64(0xFFFFFFFF)


def _sizes_match(a, b):
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def _meeting(n, at, i, j):
    """Of places i and j, in one column each, those where pairs of sets of sizes n may count the column, which stands at `at` in
    each; and how many columns the pair must have in common then.

    For a pair that needs overlap o, leading parts of n - o + l columns must have l in common, for any l for which these
    parts lie within the prefixes."""
    a, b = n[i], n[j]
    o = needed(a, b)
    most = o + 1 - np.maximum(-(-a * NUM // DEN), -(-b * NUM // DEN))
    least = np.maximum(1, np.minimum(1 + np.minimum(a, b) // 50, most))
    ok = (at[i] < a - o + least) & (at[j] < b - o + least)
    return i[ok], j[ok], least[ok]


def _batch(cols, names):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _shared_columns(batches):
    """The rows, each class once, of columns that more than one class has; a column's rows need not fit in memory. Rows of
    documents (np below 0) pass through."""
    waiting, given = None, False
    name = ["h", "np", "c", "at"]
    for b in batches:
        h, p = b.column("h").to_numpy(), b.column("np").to_numpy()
        document = p < 0
        if document.any():
            yield b.filter(pa.array(document))
        b = b.filter(pa.array(~document)).select(name)
        if not b.num_rows:
            continue
        rows = [x.to_numpy() for x in b.columns]
        if waiting is not None:  # the last row stands in front, to see whether its column goes on
            rows = [np.concatenate(x) for x in zip(waiting, rows, strict=True)]
        h, _, c, _ = rows
        new_class = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        rows = [x[new_class] for x in rows]
        h = rows[0]
        same = h[1:] == h[:-1]
        many = np.append(False, same) | np.append(same, False)
        waiting = [x[-1:] for x in rows]
        last = bool(many[-1])
        if given:
            many[0] = False
        given = last or (given and len(h) == 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[many]) for x in rows), pa.nulls(int(many.sum()), pa.int64())], names=[*name, "doc_id"])


#: Rounds of stars, by the number of classes of least rank that the others in a column meet.
HEADS = (2, 8)


#: Pairs counted at a time; the counts are added up by Spark, so it changes no result.
PAIRS = 1 << 17


def _counted(parts):
    """(a, b, need, n): how often each pair came, in about PAIRS at a time."""

    def one(held):
        pairs = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.lexsort(pairs[::-1])
        pairs = [x[order] for x in pairs]
        at = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in pairs])))
        return _batch((*(x[at] for x in pairs), np.diff(at, append=len(order))), ["a", "b", "need", "n"])

    give_back()
    held, size = [], 0
    for a, b, need in parts:
        if len(a):
            held.append((np.minimum(a, b), np.maximum(a, b), need))
            size += len(a)
        if size > PAIRS:
            yield one(held)
            held, size = [], 0
    if held:
        yield one(held)


def _stars(heads: int):
    """In each column, pairs of the classes of least rank with the others, where their labels differ. Columns stream past; what is
    held of one are its first `heads` classes."""

    def pairs(batches):
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            rows, old = [x.to_numpy() for x in b.columns], 0
            if carried is not None and carried[0][0] == rows[0][0]:  # the column goes on; its first classes stand in front again
                rows, old = [np.concatenate(x) for x in zip(carried, rows, strict=True)], len(carried[0])
            h, p, c, at_, label = rows
            n = p & SIZE
            start = np.append(True, h[1:] != h[:-1])
            head, group = np.flatnonzero(start), np.cumsum(start) - 1
            place = np.arange(len(h))
            for k in range(heads):
                at = head[group] + k
                ok = (at < place) & (place >= old) & (h[np.minimum(at, len(h) - 1)] == h)
                at, i = at[ok], place[ok]
                ok = (label[at] != label[i]) & _sizes_match(n[at], n[i])
                at, i, least = _meeting(n, at_, at[ok], i[ok])
                yield c[at], c[i], least
            carried = [x[head[-1] : head[-1] + heads] for x in rows]

    return lambda batches: _counted(pairs(batches))


def _crossing(batches):
    """In each column, all pairs of fitting sizes whose classes have different labels."""

    def pairs():
        for h, p, c, at, label in whole_groups(batches):
            start = np.append(True, h[1:] != h[:-1])
            mixed = np.minimum.reduceat(label, np.flatnonzero(start)) != np.maximum.reduceat(label, np.flatnonzero(start))
            keep = np.flatnonzero(mixed[np.cumsum(start) - 1])
            keep = keep[np.lexsort((p[keep] & SIZE, h[keep]))]
            h, n, c, at, label = h[keep], p[keep] & SIZE, c[keep], at[keep], label[keep]
            i, d = np.arange(len(h)), 1
            while len(i := i[i + d < len(h)]) and len(i := i[(h[i] == h[i + d]) & _sizes_match(n[i], n[i + d])]):
                x = i[label[i] != label[i + d]]
                x, y, least = _meeting(n, at, x, x + d)
                yield c[x], c[y], least
                d += 1

    yield from _counted(pairs())


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of doc_id."""

    def run(batches):
        total = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column("doc_id").to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(total, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        used = [i for i in range(max(1, len(total) // SLICE)) if total[i * SLICE : (i + 1) * SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in used], pa.binary())], names=["i", "part"])

    out = np.zeros(bits // 8, np.uint8)
    for i, part in _added(keys.mapInArrow(run, "i int, part binary"), "u1", lambda a, b: a | b).items():
        out[i * SLICE : (i + 1) * SLICE] = part
    return out


def _places(doc_id: np.ndarray, bits: int):
    h = _mix(doc_id.astype(np.int64).view(np.uint64))
    return [(h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)]


def _needed_sets(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """c, s of the documents `ids` (doc_id), and of the few others that a Bloom filter lets through; the rest aren't even split.
    Where a class that is asked for has no id (null), rows without one are all let through. Then, and where rows are `repeated`
    with id and text, a class is taken once."""
    bits = 1 << 15
    n, without_id = ids.count(), not ids.filter("doc_id IS NULL").isEmpty()
    ids = ids.filter("doc_id IS NOT NULL")
    while bits < min(16 * n, BLOOM_MOST):
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(ids, bits))

    def run(batches):
        known, seen, t = Words(), set(), shared.value
        for b in pieces(batches):
            doc_id = b.column("doc_id")
            x, y = _places(doc_id.fill_null(0).to_numpy(), bits)
            some = (t[x >> 3] >> (x & 7) & t[y >> 3] >> (y & 7) & 1).astype(bool)
            no_id = doc_id.is_null().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(np.where(no_id, without_id, some)))
            for at in range(0, b.num_rows, 512):
                found = {}
                for s in (shingles(t_, known) for t_ in b.column("text").slice(at, 512).to_pylist()):
                    if len(s) and (c := _class_of(s)) not in seen:
                        found[c] = s.tobytes()
                if len(seen) < 500_000:  # only spares copies within a task
                    seen.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["c", "s"])

    sets = docs.select("doc_id", "text").mapInArrow(run, "c long, s binary")
    return sets.groupBy("c").agg(F.first("s").alias("s")) if repeated or without_id else sets


def _linked(docs: DataFrame, one: DataFrame, counted: DataFrame, repeated: bool) -> DataFrame:
    """Links (u, v) among pairs counted by column: bound by prefix overlap, then by the whole sets."""
    pairs = cut(counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b"))
    ids = cut(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().join(one, "c").select("first.doc_id"))
    return cut(_links(pairs, _needed_sets(docs, ids, repeated)))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose whole sets reach the threshold, as (u, v)."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                overlap = np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)
                keep.append(overlap >= needed(len(x), len(y)))
            t = pa.table({"u": b.column("a"), "v": b.column("b")}).filter(pa.array(keep, pa.bool_()))
            yield from t.combine_chunks().to_batches()

    full = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long")


def _clustered(docs: DataFrame) -> DataFrame:
    """doc_id, k (a hash of id and text), n, c (class), rep (struct of doc_id and k: the component's first row, its own if that is
    null) for each row of `docs`."""
    with small_batches(docs.sparkSession, size=4 << 20):  # sets are large
        return _classes_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.xxhash64("doc_id", "text")))


def _classes_of(docs: DataFrame) -> DataFrame:
    met = cut(postings(docs, sketch(docs)).repartition("h").sortWithinPartitions("h", "np", "c").mapInArrow(_shared_columns, "h long, np long, c long, at int, doc_id long"))
    rows = met.filter("np < 0").select("doc_id", F.col("h").alias("k"), (-1 - F.col("np")).alias("n"), "c")
    columns = met.filter("np >= 0").select("h", "np", "c", "at")
    # The first row of a class, ids before none: copies are counted in each task before they are shuffled.
    one = cut(rows.filter("c IS NOT NULL").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k")).alias("first"), F.count("*").alias("rows")))
    repeated = not rows.groupBy("doc_id", "k").count().filter("count > 1").isEmpty()
    counts = "a long, b long, need long, n long"
    labels = links = None
    for meet in (*map(_stars, HEADS), _crossing):
        if labels is None:
            met_by_column = columns.withColumn("label", F.col("c"))
        else:  # labels are joined on by class, then rows meet by column again
            labelled = columns.join(labels.select(F.col("u").alias("c"), "label"), "c", "left").select("h", "np", "c", "at", F.coalesce("label", "c").alias("label"))
            met_by_column = labelled.repartition("h").sortWithinPartitions("h", "np", "c")
        more = _linked(docs, one, met_by_column.mapInArrow(meet, counts), repeated)
        if labels is None or not more.isEmpty():
            links = more if links is None else links.union(more)
            labels = components(links)
    named = one.join(labels.select(F.col("u").alias("c"), "label"), "c", "left").filter("label IS NOT NULL OR rows > 1").withColumn("label", F.coalesce("label", "c"))
    reps = if_small(named.groupBy("label").agg(F.min("first").alias("rep")))
    return _joined_to_classes(rows, named.join(reps, "label").select("c", "rep"))


def _joined_to_classes(rows: DataFrame, classes: DataFrame, salts: int = 16) -> DataFrame:
    """`rows` with `rep` of their class, where `classes` (c, rep) has it. A class may hold a third of all rows: unless the table of
    classes is small, its rows are dealt over `salts` tasks, and the class goes to each of them."""
    classes = if_small(classes)
    if classes.count() > SMALL_ROWS:
        rows = rows.withColumn("salt", F.pmod("k", F.lit(salts)).cast("int"))
        classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.join(classes, ["c", "salt"], "left").drop("salt")
    return rows.join(classes, "c", "left")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    component = F.when(F.col("rep").isNotNull(), F.col("rep.doc_id")).otherwise(F.col("doc_id"))
    return _clustered(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2 over all documents."""
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each component one document stays, the first row with the smallest id (of those without an id, if
    none has one). Documents without words all stay. A row is known by its id and a hash of both id and text, so of rows that
    share an id and differ in text each is judged alone."""
    found = cut(_clustered(docs).withColumn("kept", F.col("rep").isNull() | (F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.k") == F.col("k")))))
    key, i, k = (fresh(x, docs.columns) for x in ("_key", "_i", "_k"))
    same = lambda: F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k))
    named = lambda x: if_small(x.select(F.col("doc_id").alias(i), F.col("k").alias(k)))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    gone = named(found.filter("NOT kept").select("doc_id", "k").distinct())
    again = named(found.filter("kept AND c IS NOT NULL").groupBy("doc_id", "k").count().filter("count > 1"))
    stays = keyed.join(gone, same(), "left_anti")
    if not again.isEmpty():  # rows equal in id and text are one document
        stays = stays.join(again, same(), "left_anti").union(stays.join(again, same(), "left_semi").dropDuplicates(["doc_id", "text"]))
    return stays.select(*docs.columns)


def oracle() -> str:
    """The same rows in DuckDB: all pairs by shared n-grams, components by a recursive walk."""
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON a = na.r JOIN n nb ON b = nb.r WHERE {DEN} * c >= {NUM} * (na.n + nb.n - c)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(o.doc_id) AS component_id FROM reach JOIN w o ON reach.b = o.r GROUP BY 1) m USING (r)"""

"""Removal of repeated strings of 100 bytes.

A byte goes if a 100-byte string that covers it also starts earlier (in a smaller doc_id, or earlier in the same text).
Suffixes are sorted by the difference-cover algorithm, distributed over buckets that hold all that can be equal:

1. Every 100-byte window picks the least of its k-grams' hashes (winnowing), so equal windows pick the same k-gram at the same
   place. Consecutive windows that pick the same k-gram place form a block, about 35 windows; blocks are keyed by the k-gram and
   by a hash of all their bytes. Blocks whose k-gram stands nowhere else can't repeat, and go no further. Of blocks that are
   equal all but the first are removed as a whole.
2. The first of each of several different blocks that share their k-gram, such as those around the edges of a shared passage
   or of an edit, are read again and meet by k-gram with their bytes. Their suffixes are sorted (`suffixes.suffix_array`:
   sampled triples are sorted and named, names sorted by recursion, the remaining suffixes merged), and of neighbours whose
   prefixes of 100 bytes are equal all but the first are removed. Where more than `GROUP_MOST` different blocks share a
   k-gram, they don't meet: their windows are sorted by two 64-bit hashes over all tasks instead.

One suffix array over all bytes would sort them all several times over; see README for figures. Equal blocks are told by two
64-bit hashes, that of their k-gram and that of the whole. Groups are sorted streams with a state of one row, or of a bounded
group, so a passage that a third of all documents share needs no memory; its copies within a task's texts are told there, before
the shuffle, and go to any task.

Defined results: a null or empty text has no bytes; texts under 100 bytes lose nothing. Rows that repeat an id count in the
order of the input. Rows without an id come last. A very long text is worked on in pieces that overlap. Of equal strings the
first stays, so there are no ties. An empty table gives an empty result. Columns beyond doc_id and text are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, whole_groups
from .suffixes import suffix_array

LENGTH, GRAM = 100, 32
WINDOWS = LENGTH - GRAM + 1  # k-grams in a window
PIECE = 60_000  # windows worked on at once; places within a piece fit in 16 bits
BLOCK_BITS = 20
BLOOM_MOST = 1 << 29
GROUP_MOST = 50_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + 2 * LENGTH, B, np.uint64)]).astype(np.uint64), dtype=np.uint64)
    INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + 2 * LENGTH, np.uint64(pow(int(B), -1, 1 << 64)), np.uint64)]).astype(np.uint64), dtype=np.uint64)
#: A random number for each byte, so that sums of powers don't inherit the bytes' regularities.
BYTE = np.random.default_rng(100).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * INVERSE[start] + (end - start).astype(np.uint64))


def blocks(text: bytes):
    """(f, c, lo, n) of all blocks: k-gram hash, hash of all bytes and of the k-gram's place, first window, number of windows."""
    if len(text) < LENGTH:
        return None
    out = []
    for base in range(0, len(text) - LENGTH + 1, PIECE):
        part = BYTE[np.frombuffer(text[base : base + PIECE + LENGTH - 1], np.uint8)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * POWERS[: len(part)], dtype=np.uint64)])
        at = np.arange(len(part) - GRAM + 1)
        gram = _range_hash(sums, at, at + GRAM)
        # Ties, the same k-gram twice in a window, go to the first.
        pick = _least((gram & ~np.uint64(0xFFFF)) | at.astype(np.uint64), WINDOWS)
        place = (pick & np.uint64(0xFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = np.diff(np.append(lo, len(place)))
        anchor = place[lo]
        c = mix(_range_hash(sums, lo, lo + n + (LENGTH - 1)) ^ ((anchor - lo).astype(np.uint64) << np.uint64(32)))
        out.append((gram[anchor], c, lo + base, n))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def window_hashes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of each piece, and its piece; pieces of blocks, a few hundred at a time."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    part = BYTE[np.frombuffer(b"".join(pieces), np.uint8)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(part * POWERS[: len(part)], dtype=np.uint64)])
    owner = np.repeat(np.arange(len(pieces)), size - (LENGTH - 1))
    begin = np.cumsum(size) - size
    first = np.cumsum(size - (LENGTH - 1)) - (size - (LENGTH - 1))
    at = np.arange(len(owner)) - first[owner] + begin[owner]
    h = np.zeros(len(at), np.uint64)
    for i in range(0, LENGTH, 25):  # another hash, of four parts
        h = mix(h * A + (sums[at + i + 25] - sums[at + i]) * INVERSE[at + i])
    return _range_hash(sums, at, at + LENGTH), h, owner


def repeated_windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of each window that is equal to an earlier one of the pieces, by sorting all suffixes."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(size)
    symbols[ends - 1] = 1  # no byte
    piece = np.repeat(np.arange(len(pieces)), size)
    order = suffix_array(symbols)
    order = order[ends[piece[order]] - 1 - order >= LENGTH]  # windows lie within their piece
    if not len(order):
        return order, order
    rows = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint16), LENGTH)
    new = np.append(True, np.concatenate([(rows[order[i + 1 : i + 4097]] != rows[order[i : i + 4096][: len(order) - i - 1]]).any(1) for i in range(0, len(order), 4096)]))
    first = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    again = np.sort(order[order != first])
    return piece[again], again - (ends - size)[piece[again]]


def _by_group(f: np.ndarray, pieces: np.ndarray, most: int = 300_000):
    """Ranges of whole groups of f that hold about `most` bytes, or one group."""
    total = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
    start = 0
    for g in np.flatnonzero(np.append(f[1:] != f[:-1], True)) + 1:
        if total[g] - total[start] >= most:
            yield start, int(g)
            start = int(g)
    if start < len(f):
        yield start, len(f)


def _few(pieces: list[bytes]):
    """Slices of `pieces` of at most PIECE bytes, or of one."""
    start = size = 0
    for i, x in enumerate(pieces):
        if size and size + len(x) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(x)
    if pieces:
        yield start, len(pieces)


def _texts(b: pa.RecordBatch):
    """(row number, doc_id, bytes) of a batch's rows, a few at a time."""
    for at in range(0, b.num_rows, 64):
        part = b.slice(at, 64)
        for r, d, t in zip(part.column("r").to_pylist(), part.column("d").to_pylist(), part.column("text").to_pylist(), strict=True):
            yield r, d, (t or "").encode("utf-8", "surrogatepass")


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _copies_apart(f, c, d, r, at):
    """The rows, with those that equal another one here, earlier in the order (d, r, at), as copies: dealt anywhere (f is a hash of
    their place) and with at = -1 - at. So a block that a text or a task's texts repeat without end is shuffled once by its key."""
    order = np.argsort(c, kind="stable")
    same = (c[order][1:] == c[order][:-1]) & (f[order][1:] == f[order][:-1])
    rows = order[np.append(same, False) | np.append(False, same)]
    if len(rows):
        rows = rows[np.lexsort((at[rows], r[rows], d[rows], f[rows], c[rows]))]
        copy = rows[1:][(c[rows][1:] == c[rows][:-1]) & (f[rows][1:] == f[rows][:-1])]
        f, at = f.copy(), at.copy()
        f[copy] = mix((r[copy].view(np.uint64) * A) ^ at[copy].view(np.uint64)).view(np.int64)
        at[copy] = -1 - at[copy]
    return f, c, d, r, at


def _blocks(batches):
    held, size = [], 0

    def flush():
        return _batch("f c d r at", *_copies_apart(*(np.concatenate(x) for x in zip(*held, strict=True))))

    for b in batches:
        for r, d, text in _texts(b):
            found = blocks(text)
            if found is None:
                continue
            f, c, lo, n = found
            held.append((f.view(np.int64), c.view(np.int64), np.full(len(f), d), np.full(len(f), r), (lo << BLOCK_BITS) + n))
            size += len(f)
            if size > 200_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _equal_blocks(batches):
    """f, r, lo, hi, kind: of equal blocks, sorted by (f, c, place), the bytes of all but the first (kind 0); and the first of each of
    several that share f only (kind 1). What a batch needs from before is its last row and the first row of its f."""
    last_f = last_c = None
    first = None  # the first row (r, at) of the current f, until it is known to be one of several
    several = False
    for b in batches:
        f, c, r, at = (b.column(x).to_numpy() for x in ("f", "c", "r", "at"))
        if (at < 0).any():  # copies that their task has found
            f_, r_, at_ = f[at < 0], r[at < 0], -1 - at[at < 0]
            lo = at_ >> BLOCK_BITS
            yield _batch("f r lo hi kind", f_, r_, lo, lo + (at_ & ((1 << BLOCK_BITS) - 1)) + LENGTH - 1, np.zeros(len(lo), np.int64))
            f, c, r, at = (x[at >= 0] for x in (f, c, r, at))
        if not len(f):
            continue
        same_f = np.append(last_f is not None and f[0] == last_f, f[1:] == f[:-1])
        same_c = same_f & np.append(last_c is not None and c[0] == last_c, c[1:] == c[:-1])
        copy = np.flatnonzero(same_c)
        lead = np.flatnonzero(~same_c)  # first rows of their (f, c)
        out = [(f[copy], r[copy], at[copy], np.zeros(len(copy), np.int64))]
        if len(lead):
            follows = same_f[lead]  # an f with an earlier c
            leads = np.append(follows[1:], False)  # the next lead has the same f
            if follows[0] and not several and first is not None:
                out.append((f[lead[:1]], np.array([first[0]]), np.array([first[1]]), np.ones(1, np.int64)))
            several_here = follows | leads
            pick = lead[several_here]
            out.append((f[pick], r[pick], at[pick], np.ones(len(pick), np.int64)))
            several = bool(several_here[-1])
            first = None if several else (r[lead[-1]], at[lead[-1]])
        last_f, last_c = f[-1], c[-1]
        f_, r_, at_, kind = (np.concatenate(x) for x in zip(*out, strict=True))
        lo, n = at_ >> BLOCK_BITS, at_ & ((1 << BLOCK_BITS) - 1)
        yield _batch("f r lo hi kind", f_, r_, lo, np.where(kind == 0, lo + n + LENGTH - 1, lo + n), kind)


def _equal_windows(batches):
    """r, lo, hi: of equal windows, sorted by (a, b, place), all but the first."""
    last = None
    for batch in batches:
        a, b, r, p = (batch.column(x).to_numpy() for x in ("a", "b", "r", "p"))
        if not len(a):
            continue
        same = np.append(last is not None and (a[0], b[0]) == last, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
        last = (a[-1], b[-1])
        yield _batch("r lo hi", r[same], p[same], p[same] + LENGTH)


def _merged(batches):
    """r, spans: the union of each row's intervals, sorted by (r, lo), as packed pairs. A row's intervals merge as they stream."""
    row, spans = None, []
    done: list = []

    def batch():
        return _batch("r spans", pa.array([x for x, _ in done], pa.int64()), pa.array([np.array(s, "<i8").tobytes() for _, s in done], pa.binary()))

    for b in batches:
        for r, lo, hi in zip(*(b.column(x).to_pylist() for x in ("r", "lo", "hi")), strict=True):
            if r != row:
                if row is not None:
                    done.append((row, spans))
                row, spans = r, []
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        if len(done) > 1000:
            yield batch()
            done.clear()
    if row is not None:
        done.append((row, spans))
    yield batch()


def _merge_early(batches):
    """Intervals of neighbouring rows of the same r joined where they touch; less to shuffle, the same union."""
    for b in batches:
        r, lo, hi = (b.column(x).to_numpy() for x in ("r", "lo", "hi"))
        if not len(r):
            continue
        order = np.lexsort((lo, r))
        r, lo, hi = r[order], lo[order], hi[order]
        new = np.append(True, (r[1:] != r[:-1]) | (lo[1:] > hi[:-1]))
        start = np.flatnonzero(new)
        yield _batch("r lo hi", r[start], lo[start], np.maximum.reduceat(hi, start))


def _places(r: np.ndarray, lo: np.ndarray, bits: int):
    h = mix(r.astype(np.int64).view(np.uint64) * A ^ mix(lo.astype(np.int64).view(np.uint64)))
    return [(h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)]


SLICE = 1 << 14


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column("r").to_numpy(), b.column("lo").to_numpy(), bits):
                np.bitwise_or.at(total, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        used = [i for i in range(max(1, len(total) // SLICE)) if total[i * SLICE : (i + 1) * SLICE].any()]
        yield _batch("i part", pa.array(used, pa.int32()), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in used], pa.binary()))

    def one(table: pa.Table) -> pa.Table:
        total = np.frombuffer(table.column("part")[0].as_py(), np.uint8).copy()
        for x in table.column("part")[1:]:
            total |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"i": table.column("i").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.mapInArrow(run, "i int, part binary").groupBy("i").applyInArrow(one, "i int, part binary").toLocalIterator():
        out[row["i"] * SLICE : row["i"] * SLICE + len(row["part"])] = np.frombuffer(row["part"], np.uint8)
    return out


def _chosen(docs: DataFrame, bloom: np.ndarray, hot: np.ndarray, of_hot: bool):
    """For each document its blocks (f, lo, n) that the Bloom filter lets through (the few wrong ones change no result) and whose
    k-gram is one of the hot ones, or isn't."""
    shared = docs.sparkSession.sparkContext.broadcast((bloom, hot))

    def of(batches):
        t, hot = shared.value
        for b in batches:
            for r, d, text in _texts(b):
                found = blocks(text)
                if found is None:
                    continue
                f, _, lo, n = found
                x, y = _places(np.full(len(lo), r), lo, len(t) * 8)
                ok = (t[x >> 3] >> (x & 7).astype(np.uint8) & t[y >> 3] >> (y & 7).astype(np.uint8) & 1).astype(bool)
                ok &= np.isin(f.view(np.int64), hot) == of_hot
                if ok.any():
                    yield r, d, text, f[ok].view(np.int64), lo[ok], n[ok]

    return of


def _met(docs: DataFrame, bloom: np.ndarray, hot: np.ndarray) -> DataFrame:
    """r, lo, hi of windows that repeat, from blocks that meet by k-gram with their bytes."""
    chosen = _chosen(docs, bloom, hot, False)

    def read(batches):
        rows: list[tuple] = []
        for r, d, text, f, lo, n in chosen(batches):
            rows += [(a, d, r, b, text[b : b + c + LENGTH - 1]) for a, b, c in zip(f.tolist(), lo.tolist(), n.tolist(), strict=True)]
            if len(rows) > 5000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return _batch("f d r lo bytes", *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()))

    def resolve(batches):
        for f, r, lo, pieces in whole_groups(batches):
            for s, e in _by_group(f, pieces):
                owner, offset = repeated_windows(pieces[s:e].tolist())
                p = lo[s + owner] + offset
                yield _batch("r lo hi", r[s + owner], p, p + LENGTH)

    rows = docs.mapInArrow(read, "f long, d long, r long, lo long, bytes binary").repartition("f").sortWithinPartitions("f", "d", "r", "lo")
    return rows.select("f", "r", "lo", "bytes").mapInArrow(resolve, "r long, lo long, hi long")


def _sorted_windows(docs: DataFrame, bloom: np.ndarray, hot: np.ndarray) -> DataFrame:
    """The same from the blocks of hot k-grams, each window a row."""
    chosen = _chosen(docs, bloom, hot, True)

    def read(batches):
        for r, d, text, _, lo, n in chosen(batches):
            pieces = [text[a : a + c + LENGTH - 1] for a, c in zip(lo.tolist(), n.tolist(), strict=True)]
            for s, e in _few(pieces):
                x, y, owner = window_hashes(pieces[s:e])
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                p = lo[s + owner] + np.arange(len(owner)) - first[owner]
                yield _batch("a b d r p", x.view(np.int64), y.view(np.int64), np.full(len(p), d), np.full(len(p), r), p)

    rows = docs.mapInArrow(read, "a long, b long, d long, r long, p long").repartition("a").sortWithinPartitions("a", "b", "d", "r", "p")
    return rows.select("a", "b", "r", "p").mapInArrow(_equal_windows, "r long, lo long, hi long")


def removed(docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`."""
    with small_batches(docs.sparkSession):
        return _removed(_numbered(docs), group_most)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, d (the order of texts), r (a number for each row), text. Where ids tell rows apart they are the numbers; else the
    table is written once, so that numbers by place in the input stay the same however often it is read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if own.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return own.select("doc_id", F.col("doc_id").alias("d"), F.col("doc_id").alias("r"), "text")
    own = cut(own.withColumn("r", F.monotonically_increasing_id()))
    return own.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "r", "text")


def _removed(own: DataFrame, group_most: int) -> DataFrame:
    sliced = own.select("r", "d", "text")
    found = sliced.mapInArrow(_blocks, "f long, c long, d long, r long, at long").repartition("f").sortWithinPartitions("f", "c", "d", "r", "at")
    marked = cut(found.select("f", "c", "r", "at").mapInArrow(_equal_blocks, "f long, r long, lo long, hi long, kind long"))
    unresolved = marked.filter("kind = 1")
    # At most one for each group_most unresolved blocks
    hot = np.array([x["f"] for x in unresolved.groupBy("f").count().filter(F.col("count") > group_most).select("f").collect()], np.int64)
    n, bits = unresolved.count(), 1 << 17
    while bits < min(16 * n, BLOOM_MOST):
        bits *= 2
    bloom = _bloom(unresolved.select("r", "lo"), bits)
    loose = _met(sliced, bloom, hot)
    if len(hot):
        loose = loose.union(_sorted_windows(sliced, bloom, hot))
    intervals = marked.filter("kind = 0").select("r", "lo", "hi").union(loose).mapInArrow(_merge_early, "r long, lo long, hi long")
    spans = cut(intervals.repartition("r").sortWithinPartitions("r", "lo").mapInArrow(_merged, "r long, spans binary"))

    def finish(batches):
        for b in batches:
            rows = []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = (t or "").encode("utf-8", "surrogatepass")
                cuts = np.frombuffer(s or b"", "<i8").reshape(-1, 2).tolist()
                h, at = hashlib.sha256(), 0
                for lo, hi in cuts:
                    h.update(text[at:lo])
                    at = hi
                h.update(text[at:])
                rows.append((len(text), sum(y - x for x, y in cuts), len(cuts), h.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield _batch("doc_id n_bytes n_removed n_spans kept_sha256", b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()))

    return own.select("r", "doc_id", "text").join(spans, "r", "left").select("doc_id", "text", "spans").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Lexical retrieval packing.

Texts become token ids. Whole windows of a document are sequences of their own, finished where they are read; what remains of
each document, less than a window, is dealt into shards of bounded size. Each shard builds a BM25 inverted index of its
remainders, with document frequencies and lengths counted over the whole corpus. The longest unused remainder seeds a sequence;
its unused neighbours in the index, best first, fill the window: of the NEIGHBOURS best those that fit whole, then the best other
one, cut to what is missing, then the others down the ranking. Every sequence but a shard's last is full, and each id lies in
exactly one piece.

Documents are dealt by what they are about: each is put in order by its lead terms, drawn by weighted min-hashing of its BM25
weights with the same clocks everywhere, so documents that share heavy terms come to stand side by side, and consecutive ones
make a shard. A seed meets only its own shard; README has the share of true neighbours that it meets there. A group of copies of
any size is cut into as many shards as it fills.

Defined results: a null or empty text is its final id alone. Repeated rows and ids, and rows without an id, are packed one by
one. Ties of scores go to the earlier document of the shard's order. A very long text is whole windows and one remainder. An
empty table gives an empty result. Columns beyond doc_id and text are not read. The vocabulary file's path is a parameter;
tokens are those of the file's tokenizer."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, Table
from .common import cut, pieces

WINDOW, FINAL_ID = 2048, 1
SHARD_DOCS, SHARDS_IN_PART = 1500, 2
LEADS, SEED, DENSE = 3, 5, 25
NEIGHBOURS = 64
K1, B = 1.2, 0.75
TABLE_BITS, MOST_UNITS = 21, 1_000_000  # some 60 MB; beyond it, a task starts anew with an empty table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task is the unit of parallel work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Kinds of bytes: white space, letters (of ASCII, and those that UTF-8 writes with 0xC3), digits, other marks.
SPACE, LETTER, DIGIT, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(97, 123), *range(128, 192), 0xC3]] = LETTER
KIND[48:58] = DIGIT
#: Bytes beyond that alphabet, and the apostrophe, whose part of a text is left to the tokenizer.
ODD = np.zeros(256, bool)
ODD[[39, *range(192, 256)]] = True
ODD[0xC3] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Units up to this length are compared by a hash of 8 bytes at a time.
UNIT = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _after(x: np.ndarray) -> np.ndarray:
    """What stands behind each place; False behind the last."""
    return np.append(x[1:], False)


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, odd) of the stretches of a text that are encoded by themselves: runs of letters, single
    digits, runs of marks; or, odd, whole parts between white space, where they hold anything but plain letters and marks."""
    low = LOWER[raw]
    wide = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = raw[wide]
    low[wide[(second < 0x9F) & (second != 0x97)]] += 32
    kind = KIND[low]
    full = kind != SPACE
    before = np.append(False, full[:-1])
    start = full & (np.append(True, kind[1:] != kind[:-1]) | (kind == DIGIT))
    strange = np.concatenate([np.flatnonzero(ODD[raw]), wide[(second == 0x97) | (second == 0xB7)], np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))])
    first = np.empty(0, np.int64)
    if len(strange):
        part, end = np.flatnonzero(full & ~before), np.flatnonzero(full & ~_after(full)) + 1
        which = np.unique(np.searchsorted(part, strange, "right") - 1)
        first = part[which]
        starts = np.flatnonzero(start)
        a, z = np.searchsorted(starts, first) + 1, np.searchsorted(starts, end[which])
        inside = np.arange((z - a).sum()) + np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a)
        start[starts[inside]] = False
    last = full & (~_after(full) | _after(start))
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    odd = np.zeros(len(starts), bool)
    odd[np.searchsorted(starts, first)] = True
    return low, starts, ends, odd


def keys_of(bytes_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the stretches."""
    size = ends - starts
    padded = np.concatenate([bytes_, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(bytes_) + 1,), (1,))
    h = _mix(size.astype(np.uint64) + np.uint64(1))
    rows = np.arange(len(starts))
    for k in range(0, UNIT, 8):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        left = np.minimum(size[rows] - k, 8)
        x = eight[starts[rows] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        h[rows] = _mix(h[rows] ^ x) * np.uint64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(size > UNIT):
        h[i] = xxhash.xxh64_intdigest(bytes_[starts[i] : ends[i]].tobytes())
    return h | np.uint64(1)


class Ids:
    """Token ids, little-endian and 16-bit where the vocabulary allows it.

    No token crosses white space or the bounds of letters, digits and marks, so texts are cut there, equal stretches (told by a
    64-bit hash) are encoded once, and their ids are kept in a table of bounded size. The tokenizer itself encodes what isn't plain,
    and everything if its vocabulary or its rules are of another kind."""

    def __init__(self, path: str):
        self.tokenizer, self.bpe = _tokenizer(path), Bpe(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.clear()
        self.fast = self.bpe.whole and self.kind == "<u2"
        sample = ["ABC'S don't x1½2² l'été ÆØßÀÞ ¿Qué? a_b--c#d 'tis ÿŒŵĿȺɏ ª3º 12,5% <|endoftext|> <|x İ \x1c\x85.", "".join(map(chr, range(33, 0x250))), *map(chr, range(0x250))]
        self.fast = self.fast and all(x.tobytes() == self._whole(t) for x, t in zip(self.of(sample), sample, strict=True))
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = Table(TABLE_BITS), 0, 0
        self.at, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint16)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _keep(self, places: np.ndarray, ids: np.ndarray, size: np.ndarray | int) -> None:
        """`ids`, one behind the other, as those of the units at `places`."""
        size = np.broadcast_to(size, len(places))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.at[places], self.size[places] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, raw: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray, keys: np.ndarray) -> None:
        """Ids of new units."""
        while self.n + len(keys) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        places, size = self.n + np.arange(len(keys)), ends - starts
        self.n += len(keys)
        self.table.add(keys, places.astype(np.int32))
        here = np.flatnonzero(~odd & (size <= UNIT))
        for n in np.unique(size[here]).tolist():
            rows = here[size[here] == n]
            for k, ids in self.bpe.encode(low[starts[rows][:, None] + np.arange(n)]):
                self._keep(places[rows[k]], ids.ravel(), ids.shape[1])
        there = np.flatnonzero(odd | (size > UNIT))
        for at in range(0, len(there), 1000):
            some = there[at : at + 1000]
            texts = [raw[starts[i] : ends[i]].tobytes().decode("utf-8", "surrogatepass") for i in some]
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            self._keep(places[some], np.array([i for f in found for i in f], np.uint16), np.fromiter(map(len, found), np.int64, len(found)))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.fast:
            return [np.frombuffer(self._whole(t) if t else b"", self.kind) for t in texts]
        if self.n > MOST_UNITS or self.used > 16 * MOST_UNITS:
            self.clear()
        whole = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(whole) + b"\n", np.uint8)
        low, starts, ends, odd = units(raw)
        keys = keys_of(low, starts, ends)
        if odd.any():  # the tokenizer's own marks depend on the case of letters
            keys[odd] = keys_of(raw, starts[odd], ends[odd])
        places = self.table.find(keys)
        new = np.flatnonzero(places < 0)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                self._learn(raw, low, starts[some], ends[some], odd[some], keys[some])
            places = self.table.find(keys)
        size = self.size[places]
        total = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(self.at[places] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        edges = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in whole]))  # units before each text's end
        cuts = np.append(0, total)[edges]
        return [ids[a:z] for a, z in zip(np.append(0, cuts[:-1]), cuts, strict=True)]


@cache
def ids_by(path: str) -> Ids:
    """One cache for all tasks of a worker process."""
    return Ids(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _partition() -> int:
    from pyspark import TaskContext

    c = TaskContext.get()
    return c.partitionId() if c else 0


def _pieces_schema():
    return [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _rows(names: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, names, strict=True)], names=[x for x, _ in names])


def split_windows(path: str):
    """Whole windows as finished pieces, each a sequence with an odd number (ids null), and remainders with their ids. A task's last row (doc_tokens
    null) holds its document frequencies of every token, with the number of its rows and the length of its remainders."""

    def run(batches):
        ids_of, part, n, rest, sequence = ids_by(path), _partition(), 0, 0, 0
        df = np.zeros(max(_tokenizer(path).get_vocab_size(), FINAL_ID + 1), np.int64)
        kinds = [*_pieces_schema(), ("ids", pa.binary())]
        for b in pieces(batches):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), ids_of.of(b.column("text").to_pylist()), strict=True):
                df[np.unique(ids)] += 1
                ids = np.append(ids, ids.dtype.type(FINAL_ID))
                total, whole = len(ids), len(ids) // WINDOW * WINDOW
                n, rest = n + 1, rest + total - whole
                for s in range(0, whole, WINDOW):
                    rows.append((doc_id, s, WINDOW, _crc(ids[s : s + WINDOW]), total, 2 * ((part << 36) + sequence) + 1, 0, None))
                    sequence += 1
                if whole < total:
                    rows.append((doc_id, whole, total - whole, None, total, None, None, ids[whole:].tobytes()))
            yield _rows(kinds, rows)
        yield _rows(kinds, [(None, n, rest, None, None, None, None, df.astype("<i8").tobytes())])

    return run


class Weights:
    """BM25 weights of a document's terms by corpus-wide document frequencies, and the terms that it is dealt by."""

    def __init__(self, idf: np.ndarray, mean_length: float):
        self.idf, self.mean = idf, mean_length
        self.clocks = np.random.default_rng(SEED).exponential(size=len(idf))

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, tf = np.unique(ids, return_counts=True)
        return t, self.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))

    def leads(self, ids: np.ndarray) -> list[int]:
        """The LEADS terms whose clocks, as fast as the squares of their weights, ring first: two documents have the first in common
        with a probability that grows with the weight of the terms they share."""
        t, w = self.of(ids)
        rings = self.clocks[t] / np.maximum(w, 1e-9) ** 2
        soon = np.argpartition(rings, LEADS - 1)[:LEADS] if len(t) > LEADS else np.arange(len(t))
        first = t[soon[np.argsort(rings[soon], kind="stable")]].tolist()
        return first + [-1] * (LEADS - len(first))


class Bm25:
    """An inverted index of one shard's remainders. A term's postings are a list of owners and weights; those of a term that more
    than one in DENSE documents has are a row with a weight for each document, which adds up faster."""

    def __init__(self, docs: list[np.ndarray], weights: Weights):
        found = [weights.of(d) for d in docs]
        self.size, size = len(docs), np.fromiter((len(t) for t, _ in found), np.int64, len(found))
        t = np.concatenate([t for t, _ in found])
        order = np.argsort(t, kind="stable")
        t, owners = t[order], np.repeat(np.arange(len(docs)), size)[order]
        values = np.concatenate([w for _, w in found])[order].astype(np.float32)
        begin = np.searchsorted(t, np.arange(len(weights.idf) + 1))
        often = np.flatnonzero(np.diff(begin) * DENSE > self.size)
        row = np.full(len(weights.idf), -1)
        row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.size), np.float32)
        many = row[t] >= 0
        self.rows[row[t[many]], owners[many]] = values[many]
        self.owners, self.weights = owners[~many], values[~many]
        self.begin = np.searchsorted(t[~many], np.arange(len(weights.idf) + 1))
        self.dense = [row[t][row[t] >= 0] for t, _ in found]
        self.sparse = [t[row[t] < 0] for t, _ in found]

    def scores(self, i: int) -> np.ndarray:
        """BM25 scores of all documents for document i's terms."""
        total = self.rows[self.dense[i]].sum(0, dtype=np.float64)
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in self.sparse[i]]
        if spans:
            total += np.bincount(np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size)
        return total


def fill(docs: list[np.ndarray], weights: Weights, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start within it, length), each document covered once."""
    if not docs:
        return []
    index = Bm25(docs, weights)
    begin = np.zeros(len(docs), np.int64)
    left = np.fromiter(map(len, docs), np.int64, len(docs))
    out = []
    order = np.argsort(-left, kind="stable")
    for seed in order:
        while left[seed]:
            take = min(window, int(left[seed]))
            sequence, room = [(int(seed), int(begin[seed]), take)], window - take
            begin[seed] += take
            left[seed] -= take
            if room:
                score = np.where(left > 0, index.scores(seed), -1.0)
                n = min(NEIGHBOURS, len(docs))
                near = np.argpartition(-score, n - 1)[:n]
                near = near[np.lexsort((near, -score[near]))]
                near = near[score[near] > 0]
                if not len(near):
                    near = np.flatnonzero(left > 0)[:NEIGHBOURS]
                for cut in (False, True):  # those that fit whole, then whatever fills the rest
                    for j in near:
                        if room and left[j] and (cut or left[j] <= room):
                            take = min(room, int(left[j]))
                            sequence.append((int(j), int(begin[j]), take))
                            begin[j] += take
                            left[j] -= take
                            room -= take
                if room:  # the nearest are used up: on down the ranking
                    rest = np.flatnonzero(left > 0)
                    for j in rest[np.argsort(-score[rest], kind="stable")]:
                        take = min(room, int(left[j]))
                        sequence.append((int(j), int(begin[j]), take))
                        begin[j] += take
                        left[j] -= take
                        room -= take
                        if not room:
                            break
            out.append(sequence)
    return out


def document_frequencies(dealt: DataFrame) -> tuple[np.ndarray, float]:
    """idf by token and mean remainder length; counts over every whole text, at most one row for each token."""

    def run(batches):
        for b in batches:
            for n, rest, df in zip(b.column("start").to_pylist(), b.column("length").to_pylist(), b.column("ids"), strict=True):
                df = np.frombuffer(df.as_buffer(), "<i8")
                seen = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), -1, -2, -3], pa.int32()), pa.array([*df[seen].tolist(), n, rest, 0], pa.int64())], names=["token", "n"])

    rows_of_counts = dealt.filter("doc_tokens IS NULL").select("start", "length", "ids")
    counts = {r["token"]: r["n"] for r in rows_of_counts.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    rows, rest, _ = (counts.pop(k, 0) for k in (-1, -2, -3))
    df = np.zeros(1 + max([FINAL_ID, *counts]), np.int64)
    for k, v in counts.items():
        df[k] = v
    return np.log(1 + (rows - df + 0.5) / (df + 0.5)), max(1.0, rest / max(rows, 1))


def pack(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_vocabulary()
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split_windows(path), f"{columns}, ids binary"))
    kind = "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(Weights(*document_frequencies(dealt)))  # two numbers for each token of the vocabulary

    def lead(batches):
        for b in pieces(batches):
            ids = [np.frombuffer(x.as_buffer(), kind) for x in b.column("ids")]
            leads = np.array([shared.value.leads(x) for x in ids], np.int32).reshape(-1, LEADS)
            crc = pa.array([_crc(x) for x in ids], pa.int64())
            names = [f"lead{i}" for i in range(LEADS)]
            yield pa.RecordBatch.from_arrays([*(pa.array(leads[:, i]) for i in range(LEADS)), crc, *b.columns], names=[*names, "crc", *b.schema.names])

    def fill_shards(batches):
        part, sequence, held = _partition() << 36, 0, []

        def shard(n):
            nonlocal sequence
            out, own = [], [np.frombuffer(h[3], kind) for h in held[:n]]
            for s in fill(own, shared.value):
                offset = 0
                for j, begin, size in s:
                    out.append((held[j][0], held[j][1] + begin, size, _crc(own[j][begin : begin + size]), held[j][2], 2 * (part + sequence), offset))
                    offset += size
                sequence += 1
            del held[:n]
            return _rows(_pieces_schema(), out)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                held.append(row)
                if len(held) == shard_docs + shard_docs // 2:  # the last one is not too small
                    yield shard(shard_docs)
        yield shard(len(held))

    rest = dealt.filter("ids IS NOT NULL AND doc_tokens IS NOT NULL").select("doc_id", "start", "doc_tokens", "ids")
    leads = ", ".join(f"lead{i} int" for i in range(LEADS))
    order = [*(f"lead{i}" for i in range(LEADS)), "crc", "doc_id"]
    known = cut(rest.mapInArrow(lead, f"{leads}, crc long, doc_id long, start long, doc_tokens long, ids binary"))
    parts = max(1, -(-known.count() // (SHARDS_IN_PART * shard_docs)))
    filled = known.repartitionByRange(parts, *order).sortWithinPartitions(*order, "start").mapInArrow(fill_shards, columns)
    return dealt.filter("ids IS NULL").select(filled.columns).union(filled)


def query(spark, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of all documents that came so far."""
    return pack(docs)

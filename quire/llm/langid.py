"""Language identification by averaged hashed subword embeddings and a linear softmax.

A document is the average of the embeddings of its words' character n-grams (with word edges), hashed into a fixed number of
buckets; a linear layer and a softmax give the languages. Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows (`SAMPLE_ROWS` over all languages, drawn by hash). A temperature and a threshold are then
calibrated on held-back rows of that sample, so that what is accepted is right with the stated precision; the rest is rejected.

Since averaging is linear, prediction only needs each bucket's product with the linear layer; a word's sum of those is kept
in a cache of bounded size, and every word of every whole text counts.

Defined results: `und` with score 0, rejected, for a null text, a text without a letter, or when nothing could be learned.
Repeated rows and ids are treated one by one; a null doc_id stays null (and its fold is unknown, so it teaches nothing); an
empty table gives an empty result. A very long text counts whole, in one row. Ties go to the language that sorts first. Where
there are more than `MOST_LANGUAGES` languages, the commonest are learned (ties: first in order). Columns beyond doc_id, text and
(for learning) lang are not read; the stage carries them along, whatever their names."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, pieces

FOLDS = 5
SAMPLE_ROWS, LEAST_PER_LANGUAGE, MOST_LANGUAGES = 2000, 40, 200  # so at most 8,000 rows, and as many languages in the model
BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 7
CALIBRATION_PART, PRECISION = 5, 0.99  # one row in five calibrates
LEAST_THRESHOLD = 0.5  # below it, a calibrated prediction is more likely wrong than right
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
NEW_WORDS = 5000  # summed at a time
WORD = re.compile(r"[^\W\d_]+")
EDGE = 2  # a code point that no text's letter has


class Model(NamedTuple):
    langs: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: embedding times linear layer
    bias: np.ndarray
    temperature: float
    threshold: float


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of `words`, each with edges, and for each the index of its word; by vector operations."""
    flat = np.frombuffer(("\2" + "\2\2".join(words) + "\2").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)[owner]  # the end of each place's word
    place = np.arange(len(flat))
    h = np.full(len(flat), 14695981039346656037, np.uint64)
    buckets, owners = [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ flat[n - 1 :]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            ok = place[:m] + n <= ends[:m]
            if n == 1:
                ok &= flat[:m] != EDGE
            buckets.append((((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def _features(batches):
    """Sparse counts of buckets; at most BUCKETS entries a row, however long its text."""
    for b in pieces(batches):
        rows = []
        for i, lang, t in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = WORD.findall((t or "").lower())
            if words:
                idx, n = np.unique(ngrams(words)[0], return_counts=True)
                rows.append((i, lang, idx.astype("<i4").tobytes(), n.astype("<f4").tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "lang", "idx", "n"])


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Sparse features of about `rows` labelled rows outside the held-out fold, about as many for each language."""
    known = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    shares = counts.select(F.col("lang").alias("_l"), (F.greatest(F.lit(LEAST_PER_LANGUAGE), F.lit(rows) / F.lit(max(counts.count(), 1))) / F.col("count")).alias("_share"))
    u = (F.xxhash64(F.lit(SEED), "doc_id", "text") % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    picked = known.join(if_small(shares), F.col("lang") == F.col("_l")).filter(u < F.col("_share")).select("doc_id", "lang", "text")
    return picked.mapInArrow(_features, "doc_id long, lang string, idx binary, n binary")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, str, bytes, bytes]]) -> Model | None:
    """Stochastic gradient descent over `rows` (doc_id, lang, buckets, counts), then calibration; None without rows."""
    if not rows:
        return None
    rows = sorted(rows)
    langs = tuple(sorted({r[1] for r in rows}))
    y = np.array([langs.index(r[1]) for r in rows])
    x = [(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<f4")) for r in rows]
    rng = np.random.default_rng(SEED)
    held = np.zeros(len(rows), bool)
    held[rng.permutation(len(rows))[: len(rows) // CALIBRATION_PART]] = len(rows) >= 10 * CALIBRATION_PART
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    own = np.flatnonzero(~held)
    steps, done = EPOCHS * len(own), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(own):
            idx, n = x[i]
            if rng.random() < 0.5 and len(idx) > 16:  # also learn from few n-grams, as short texts have
                part = rng.integers(0, len(idx), rng.integers(8, min(len(idx), 200)))
                idx, n = idx[part], n[part]
            w = (n / n.sum())[:, None]
            h = (table[idx] * w).sum(0)
            g = _softmax(h @ layer + bias)
            g[y[i]] -= 1
            rate = RATE * (1 - done / steps)
            back = layer @ g
            layer -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            np.subtract.at(table, idx, (rate * 20) * w * back)
            done += 1
    logits = table @ layer
    temperature, threshold = 1.0, LEAST_THRESHOLD
    if held.any():
        z = np.array([(logits[x[i][0]] * (x[i][1] / x[i][1].sum())[:, None]).sum(0) + bias for i in np.flatnonzero(held)])
        t = y[held]
        temperature = min((-np.log(_softmax(z / s)[np.arange(len(t)), t] + 1e-12).mean(), s) for s in (0.1, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0))[1]
        p = _softmax(z / temperature)
        top, right = p.max(1), p.argmax(1) == t
        # the least threshold that keeps the stated precision
        for threshold in [LEAST_THRESHOLD, *np.sort(top[top >= LEAST_THRESHOLD])]:
            if right[top >= threshold].mean() >= PRECISION:
                break
    return Model(langs, logits.astype(np.float32), bias, float(temperature), float(threshold))


class Scorer:
    """Sums of the table over words, with a bounded cache of words."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.langs) + 1
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1024, self.width))

    def _sums(self, words: list[str]) -> np.ndarray:
        buckets, owner = ngrams(words)
        out = np.empty((len(words), self.width))
        for j in range(self.width - 1):
            out[:, j] = np.bincount(owner, self.model.table[buckets, j], len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.clear()
        index = self.index
        new = [w for w in {w for ws in found for w in ws} if w not in index]
        first = len(index)
        for i in range(0, len(new), NEW_WORDS):
            part = new[i : i + NEW_WORDS]
            part_sums = self._sums(part)
            while len(self.sums) < first + i + len(part):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sums[first + i : first + i + len(part)] = part_sums
        for i, w in enumerate(new):
            index[w] = first + i
        langs, scores, rejected = [], [], []
        for ws in found:
            if not any(c.isalpha() for w in ws for c in w):  # the first character tells, but for numerals such as superscripts
                langs.append("und"), scores.append(0.0), rejected.append(True)
                continue
            s = self.sums[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
            p = _softmax((s[:-1] / s[-1] + self.model.bias) / self.model.temperature)
            k = int(p.argmax())
            langs.append(self.model.langs[k]), scores.append(round(float(p[k]), 6)), rejected.append(bool(p[k] < self.model.threshold))
        if any(len(w) > CACHE_LENGTH for w in new):  # long words aren't kept, so the cache stays small
            self.clear()
        return langs, scores, rejected


def _scored(shared):
    """Slices of batches with what the model, broadcast (BUCKETS x at most MOST_LANGUAGES numbers), says of their texts."""

    def run(batches, at):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            yield b, scorer.score(texts) if scorer else (["und"] * len(texts), [0.0] * len(texts), [True] * len(texts))

    return run


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    return train([tuple(r) for r in sample(docs, rows).collect()])  # about `rows` rows, LEAST_PER_LANGUAGE * MOST_LANGUAGES at most, of at most BUCKETS entries


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of `docs`."""
    scored = _scored(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for b, (langs, scores, rejected) in scored(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose language is not rejected."""
    at, scored = docs.columns.index("text"), _scored(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for b, (_, _, rejected) in scored(batches, at):
            yield b.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents whose language is rejected go, the rest stay as they are."""
    return accepted(docs, learn(docs))

"""Each operator on small tables against brute force, and on awkward ones: nulls, empty and very long texts, ties and repeated
rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import graph, jaccard, langid, licenses, mixing, neighbours, packing, pii, quality, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "the", "of", "und", "le", "zeta", "eta", "theta", "iota"]
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = prose(rng, 120, vocabulary)
    near = [" ".join(w if rng.random() > 0.01 else "edit" for w in base.split()) for _ in range(25)]
    passage = prose(rng, 60, vocabulary)
    texts = [base] * 12 + near + [prose(rng, 30, vocabulary) + " " + passage + " " + prose(rng, 30, vocabulary) for _ in range(15)]
    texts += [prose(rng, n, vocabulary) for n in (0, 1, 2, 3, 4, 5, 6, 7, 300)] + ["", " \n\t ", None, None, "a b c", "A B C", "a  b\nc", "x" * 30_000, "é " * 3000, "!!!"]
    return [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated rows and ids, null ids, and extra columns whose names the operators use inside."""
    rows = corpus()[:40] + [(7, "other text of an id that repeats", "en", "s0", 3), (None, "no id", None, None, None), (None, "no id", None, None, None)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("h", "c", "np", "label", "r", "d", "shard", "rate", "n_words", "score", "replica", "_n", "component_id", "u", "v"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "quality": quality.score, "jaccard": jaccard.clusters, "packing": packing.pack, "pii": pii.find, "langid": lambda d: langid.predict(d, langid.learn(d)),
    "mixing": mixing.mix, "substrings": substrings.removed, "sharding": sharding.assign, "licenses": licenses.scan_all,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(name, awkward, empty):
    got = OPERATORS[name](awkward).collect()
    if name == "packing":
        pieces = Counter()
        for r in got:
            pieces[r["doc_id"]] += r["length"]
        total = Counter()
        ids = packing.Ids(packing.default_vocabulary())
        rows = awkward.select("doc_id", "text").collect()
        for r, x in zip(rows, ids.of([r["text"] for r in rows]), strict=True):
            total[r["doc_id"]] += len(x) + 1
        assert pieces == total
    elif name != "mixing":
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in awkward.select("doc_id").collect())
    assert OPERATORS[name](empty).collect() == []


def brute_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_jaccard_equals_all_pairs(docs):
    sets = brute_sets(corpus())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.clusters(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    assert {r["u"]: r["label"] for r in graph.components(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_jaccard_links_rows_without_ids(spark):
    """A text without an id links to others, and may be the only bridge between two that have one."""
    w = [f"w{i}" for i in range(200)]
    texts = {1: w, 2: [*w[:-8], "x1"], None: [*w[:-16], "y1"], 3: [*w[:-26], "z1"], 4: ["other"] * 3}
    sets = {k: set(zip(*(v[i:] for i in range(5)), strict=False)) for k, v in texts.items()}
    ok = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert ok(1, 2) and ok(2, None) and ok(None, 3)
    rows = [(k, " ".join(v)) for k, v in texts.items()]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[None] == 1 and got[4] == 4 and got[3] == (1 if ok(None, 3) else 3)
    lonely = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [(r["n_shingles"], r["component_id"]) for r in jaccard.clusters(lonely).collect()] == [(2, None)] * 2


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, tmp_path):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, text, "a"), (2, text, "b"), (2, other, "c"), (None, text, "d"), (5, other, "e"), (5, other, "f"), (6, None, "g"), (7, "", "h"), (8, "", "i"), (1, text, "j"), (None, "alone here", "k"), (None, "alone here", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c string")
    for name in ("k", "label", "rep", "_key", "h"):
        df = df.withColumn(name, F.lit(name))
    got = jaccard.stage(spark, df, "")
    assert got.columns == df.columns
    kept = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, text), (2, other), (6, None), (7, ""), (8, ""), (None, "alone here")])
    assert all(r[n] == n for r in kept for n in ("k", "label", "rep", "_key", "h"))


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_awkward_tables(name, spark, awkward, empty):
    """Nulls, repeated rows and ids, columns with the names that stages use inside, empty tables."""
    df = awkward
    for c in ("lang_pred", "rejected", "n_copies", "mix_key", "_mix_source", "_mix_copies", "_mix_replica", "_mix_order", "k", "rep", "_key", "weight"):
        df = df.withColumn(c, F.lit("mine"))
    got = STAGES[name](spark, df, "")
    assert got.columns == df.columns
    rows, own = [r.asDict() for r in got.collect()], {(r["doc_id"], r["source"]) for r in df.collect()}
    assert rows and all((r["doc_id"], r["source"]) in own and r["replica"] == r["score"] == "x" and r["rejected"] == r["_mix_source"] == "mine" for r in rows)
    if name == "personal_data":
        assert len(rows) == df.count()
    blank = STAGES[name](spark, empty, "")
    assert blank.collect() == [] and blank.columns == empty.columns


def test_mixing_tells_rows_without_ids_apart(spark):
    df = spark.createDataFrame([(None, f"text {i}", "s") for i in range(300)] + [(i, "t", "t") for i in range(300)], "doc_id long, text string, source string")
    n = Counter(r["text"] for r in mixing.mix(df, output_rows=600).collect() if r["source"] == "s")
    assert 100 < len(n) < 280 and len(set(n.values())) > 1


def test_sharding_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, f"text {i}", "s") for i in range(400)] + [(7, f"other {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    rows = sharding.assign(df, per_bucket=50).collect()
    assert Counter(r["shard"] for r in rows) == Counter({s: 20 for s in range(40)})
    assert max(sum(r["doc_id"] is None for r in rows if r["shard"] == s) for s in range(40)) < 20


def test_substrings_equal_brute_force(docs):
    seen, want = set(), {}
    for i, t, *_ in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    for most in (substrings.GROUP_MOST, 2):  # with the second, groups go by sorted windows
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.removed(docs, most).collect()}
        assert got == want


def test_blocks_partition_all_windows():
    text = random.Random(5).randbytes(70_000) + b"ab" * 40_000
    _, _, lo, n = substrings.blocks(text)
    assert lo[0] == 0 and (lo[1:] == (lo + n)[:-1]).all() and lo[-1] + n[-1] == len(text) - 99
    assert substrings.blocks(b"x" * 99) is None


@pytest.mark.parametrize("shard_docs", [packing.SHARD_DOCS, 7])
def test_packing_is_whole(docs, shard_docs):
    ids = packing.Ids(packing.default_vocabulary())
    tokens = {i: [*x.tolist(), 1] for (i, *_), x in zip(corpus(), ids.of([t for _, t, *_ in corpus()]), strict=True)}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, shard_docs=shard_docs).collect():
        own = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(tokens[r["doc_id"]])
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(len(v))) for k, v in tokens.items()}
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= (1 if shard_docs > 1000 else 2 * len(corpus()) // shard_docs)


def test_sharding_law_and_mixture(spark):
    df = spark.createDataFrame([(i, f"t{i}", "big" if i % 3 else f"s{i % 30}") for i in range(2000)], "doc_id long, text string, source string")
    rows = sharding.assign(df, per_bucket=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 40 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    shares = [sum(r["source"] == "big" for r in v) / len(v) for v in by.values()]
    assert max(shares) - min(shares) <= 0.1  # of 50 rows
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(df.repartition(7), per_bucket=300).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_mixing_meets_the_weights(spark):
    df = spark.createDataFrame([(i, "t", "big" if i % 10 else "small", "x") for i in range(4000)], "doc_id long, text string, source string, rate string")
    mixed = mixing.mix(df, {"big": 1.0, "small": 1.0, "none": 1.0}, output_rows=6000)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["big"] - 3000) < 200 and abs(n["small"] - 3000) < 200
    assert mixed.filter("replica >= n_copies").count() == 0 and mixed.select("doc_id", "replica").distinct().count() == mixed.count()
    keys = [r["mix_key"] for r in mixed.select("mix_key").collect()]
    assert keys == sorted(keys)
    high = mixing.mix(df.filter("source = 'small'").limit(20), output_rows=2000).count()
    assert abs(high - 2000) < 200  # rates beyond 32 are added up from parts


def test_quality_learns_without_labels(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    good = [(i, ". ".join(prose(rng, 12, words) for _ in range(8))) for i in range(180)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(rng, 80, words).split())) for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.score(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_language_held_out_accuracy(spark):
    rng = random.Random(11)
    tongues = {"en": ["the", "and", "thing", "with", "where"], "de": ["der", "und", "schön", "nicht", "über"], "fr": ["le", "été", "avec", "où", "chez"]}
    rows = [(i, prose(rng, rng.randrange(5, 60), tongues[g]), g) for i in range(600) for g in [rng.choice(list(tongues))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.learn(df)).join(df, "doc_id").filter(langid.fold(F.col("doc_id")) == 0).collect()
    assert len(got) > 80 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    unlabelled = langid.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled is None and {r["lang_pred"] for r in langid.predict(df.limit(3), unlabelled).collect()} == {"und"}


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[100:160] = x[100]  # a very common vector
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, 2.0]), (704, [None] * 16), (50, rows_50(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    found = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -s.round(12)))[:5]
        assert len(got[q]) == 5
        found += len({v for v, _ in got[q]} & set(best.tolist()))
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert found >= 0.95 * 60
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    assert neighbours.nearest(df.filter("vec_id < 3")).count() == 2 and neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_of_near_copies(spark):
    rng = np.random.default_rng(3)
    groups = [c + noise * rng.normal(size=(1000, 64)) for c, noise in zip(rng.normal(size=(2, 64)), (1e-2, 1e-4), strict=True)]
    x = np.concatenate([*groups, rng.normal(size=(200, 64))]).astype("f4")
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    for first in (0, 1000):
        found = 0
        for q in range(first, first + 1000, 50):
            s = unit @ unit[q]
            s[q] = -9
            found += len(got[q] & set(np.argsort(-s)[:5].tolist()))
        assert found >= 0.9 * 100


def test_neighbours_of_ids_that_repeat(spark):
    """An id with several vectors is as near as the nearest of them; one repeated often does not hide its equals."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 12)).astype("f4")
    rows = [(i, x[i]) for i in range(60)] + [(60, x[50])] * 14 + [(61, x[50]), (5, x[70]), (5, x[71]), (50, x[72]), (0, x[73]), (62, 2 * x[50])]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in rows], "vec_id long, embedding array<float>")
    before = {t.name for t in spark.catalog.listTables()}
    got = defaultdict(list)
    for r in neighbours.nearest(df, every=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    own = defaultdict(list)
    for i, v in rows:
        own[i].append(v.astype("f8") / np.linalg.norm(v.astype("f8")))
    for q in [i for i in own if i % 5 == 0]:
        near = sorted((-round(max(float(a @ b) for a in own[q] for b in own[i]), 9), i) for i in own if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in near], q
    assert {t.name for t in spark.catalog.listTables()} == before


def rows_50(x):
    return [float(y) for y in x[50]]  # an id that repeats with its own vector


def test_pipeline_stages_on_small_tables(spark, docs, tmp_path):
    d = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = d.count()
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert d.columns == docs.columns
        if k == 2:
            assert d.count() == before
    assert d.agg(F.sum("length")).first()[0] > 0
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    again = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    assert {tuple(r) for r in again.drop("sequence_id", "offset").collect()} == {tuple(r) for r in d.drop("sequence_id", "offset").collect()}

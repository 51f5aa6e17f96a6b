"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Documents with the same votes are counted together, so
expectation-maximisation of the rules' accuracies and of the share of good documents runs over at most 3^rules patterns,
inside one row, however many documents there are. The posterior probability of "good" then replaces an all-must-pass filter.

Defined results: a null or empty text has no words, hence every count 0, `base_failed` true and `kept` false. Repeated rows
and repeated ids are scored one by one. An empty table gives an empty result. Other columns of the input are not read.
Windows of eight words are compared by a 64-bit hash within their own document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
ITERATIONS = 20
#: A rule has two accuracies: on good documents and on bad ones. Rules are written to spare good documents, while each sees
#: one kind of fault only; the ranges say so and keep the two classes from changing places.
START_GOOD, START = 0.8, (0.98, 0.5)
RANGES = ((0.98, 0.999), (0.15, 0.995))
PSEUDO = 1.0

#: name, when the rule says good, when it says bad; otherwise it abstains. Plain arithmetic on counts, valid in any SQL dialect.
RULES = (
    ("length", "n_words >= 40", "n_words < 20"),
    ("repeats", "n_words >= 20 AND 100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    ("lines", "n_lines >= 2 AND 100 * n_dup_lines <= 5 * n_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("symbols", "n_words > 0 AND 100 * n_symbols <= 1 * word_chars", "100 * n_symbols > 6 * word_chars"),
    ("symbol_words", "n_words > 0 AND 100 * n_symbols <= 5 * n_words", "100 * n_symbols > 40 * n_words"),
    ("capitals", "n_words > 0 AND 100 * n_capitals <= 15 * word_chars", "100 * n_capitals > 50 * word_chars"),
    ("shouts", "n_words > 0 AND 100 * n_shouts <= 2 * n_words", "100 * n_shouts > 30 * n_words"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words AND n_words > 0", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
)


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, one row for each row of `docs`."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select("doc_id", "_t", words_of(F.col("_t")).alias("_w"))
    windows = F.when(
        F.size("_w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        _count(F.col("_t"), "[A-Z]+").alias("n_capitals"),
        _count(F.col("_t"), "!+").alias("n_shouts"),
        lines.alias("_lines"),
        windows.alias("_h"),
    )
    # Only documents with a repeated hash are sorted: equal hashes come to stand side by side, with their places.
    d = d.select(
        "*",
        F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    ).drop("_h")
    twin = lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"])
    d = d.select("*", F.array_sort(F.transform(F.filter("_s", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"])).alias("_p")).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.get("_p", i + 1) - x)), F.lit(0), lambda a, x: a + x
    )
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_capitals", "n_shouts",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def vote(counts: DataFrame) -> DataFrame:
    """`counts` with an array `votes`, in the order of RULES."""
    return counts.withColumn("votes", F.array(*[F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END") for _, good, bad in RULES]))


def _log_odds(votes: Column, state: Column) -> Column:
    def one(v: Column, j: Column) -> Column:
        a, b = F.get(state["on_good"], j), F.get(state["on_bad"], j)
        return F.when(v < 0, F.lit(0.0)).when(v == 1, F.log(a / (1 - b))).otherwise(F.log((1 - a) / b))

    return F.aggregate(F.transform(votes, one), F.log(state["good"] / (1 - state["good"])), lambda s, x: s + x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _accuracy(seen: Column, j: int, good: bool) -> Column:
    """Rule j's accuracy on good (or on bad) documents, its votes weighted by the documents' probabilities, kept in range."""
    at = lambda x: F.get(x["v"], F.lit(j))
    mass = lambda x: x["n"] * x["q"] if good else x["n"] * (1 - x["q"])
    right = _sum(F.transform(seen, lambda x: F.when(at(x) == (1 if good else 0), mass(x)).otherwise(0.0)))
    cast = _sum(F.transform(seen, lambda x: F.when(at(x) >= 0, mass(x)).otherwise(0.0)))
    start, (low, high) = (START[0], RANGES[0]) if good else (START[1], RANGES[1])
    return F.least(F.lit(high), F.greatest(F.lit(low), (right + start * PSEUDO) / (cast + PSEUDO)))


def fit(voted: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """One row: good (share of good documents), on_good and on_bad (accuracies of each rule), by expectation-maximisation."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    k = len(RULES)
    start = F.struct(F.lit(START_GOOD).alias("good"), F.array(*[F.lit(START[0])] * k).alias("on_good"), F.array(*[F.lit(START[1])] * k).alias("on_bad"), F.col("p").alias("p"))

    def step(state: Column, _: Column) -> Column:
        seen = F.transform(state["p"], lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), (1 / (1 + F.exp(-_log_odds(x["votes"], state)))).alias("q")))
        return F.aggregate(F.array(seen), state, lambda _s, s: _update(s, state))

    def _update(s: Column, state: Column) -> Column:
        total = _sum(F.transform(s, lambda x: x["n"]))
        good = (_sum(F.transform(s, lambda x: x["n"] * x["q"])) + PSEUDO) / (total + 2 * PSEUDO)
        on_good, on_bad = ([_accuracy(s, j, side) for j in range(k)] for side in (True, False))
        return F.struct(good.alias("good"), F.array(*on_good).alias("on_good"), F.array(*on_bad).alias("on_bad"), state["p"].alias("p"))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)
    return one.select(fitted.alias("f")).select("f.good", "f.on_good", "f.on_bad")


def score(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior and verdict of every row of `docs`.

    The counts, a few dozen bytes a row, are written once; the texts are read once."""
    counts = cut(measure(docs))
    voted = vote(counts)
    model = fit(voted).first()  # one share and two accuracies for each rule
    state = F.struct(F.lit(model["good"]).alias("good"), *[F.array(*[F.lit(a) for a in model[c]]).alias(c) for c in ("on_good", "on_bad")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        voted.withColumn("posterior", F.round(1 / (1 + F.exp(-_log_odds(F.col("votes"), state))), 4))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior", F.array_join(F.transform("votes", lambda v: v.cast("string")), ",").alias("votes"),
    )


def oracle() -> str:
    """The same rows in DuckDB: windows by self-grouping, expectation-maximisation unrolled into one step per iteration."""
    k = len(RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS v{j}" for j, (_, good, bad) in enumerate(RULES))
    vs = ", ".join(f"v{j}" for j in range(k))

    def odds(alias: str) -> str:
        return f"ln({alias}.good / (1 - {alias}.good))" + "".join(f" + CASE WHEN v{j} < 0 THEN 0 WHEN v{j} = 1 THEN ln({alias}.a{j} / (1 - {alias}.b{j})) ELSE ln((1 - {alias}.a{j}) / {alias}.b{j}) END" for j in range(k))

    steps = [f"m0 AS (SELECT {START_GOOD}::DOUBLE AS good, " + ", ".join(f"{START[0]}::DOUBLE AS a{j}, {START[1]}::DOUBLE AS b{j}" for j in range(k)) + ")"]
    for i in range(ITERATIONS):
        q = f"(1 / (1 + exp(-({odds(f'm{i}')}))))"
        acc = ", ".join(
            f"least({high}, greatest({low}, (coalesce(sum(CASE WHEN v{j} = {v} THEN n * {m} END), 0) + {start * PSEUDO}) / (coalesce(sum(CASE WHEN v{j} >= 0 THEN n * {m} END), 0) + {PSEUDO}))) AS {name}{j}"
            for j in range(k)
            for name, v, m, start, (low, high) in (("a", 1, "q", START[0], RANGES[0]), ("b", 0, "(1 - q)", START[1], RANGES[1]))
        )
        steps.append(f"q{i} AS MATERIALIZED (SELECT patterns.*, {q} AS q FROM patterns, m{i})")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT (sum(n * q) + {PSEUDO}) / (sum(n) + {2 * PSEUDO}) AS good, {acc} FROM q{i})")
    final = f"m{ITERATIONS}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW})))::BIGINT AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM p) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counts AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')))::BIGINT AS n_capitals,
  (length(t) - length(regexp_replace(t, '!+', '', 'g')))::BIGINT AS n_shouts,
  len(l.l)::BIGINT AS n_lines, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
voted AS MATERIALIZED (SELECT *, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM voted GROUP BY {vs}),
{", ".join(steps)},
scored AS (SELECT voted.*, round(1 / (1 + exp(-({odds(final)}))), 4) AS posterior,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM voted, {final})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND posterior >= 0.5 AS kept, posterior, concat_ws(',', {vs}) AS votes FROM scored"""

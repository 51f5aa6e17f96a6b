"""Proofreading records and their change table; snapshots; speed statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as T
from .rows import flat_map, fold

RECORD = "i string, total int, status string, reason string, orig string, fixed string, changed boolean"


def proofread(texts: DataFrame, client: Callable[[], Callable[[str], str | None]], most: int = 700) -> DataFrame:
    """Records of every chunk of every text (book_id, text). `client` makes a corrector in each task."""

    def run(correct, book, text):
        for r in folds.proofread(text or "", correct, most):
            yield (book, *r.values())

    return flat_map(texts.select("book_id", "text"), run, f"book_id string, {RECORD}", client)


def chunk_texts(texts: DataFrame, rule: Callable[[str, int], list[str]] = folds.chunks, most: int = 700) -> DataFrame:
    return flat_map(texts.select("book_id", "text"), lambda b, t: [(b, i, c) for i, c in enumerate(rule(t, most), 1)], "book_id string, i int, chunk string")


def guarded(pairs: DataFrame) -> DataFrame:
    """`pairs` (id, original, fixed) with ok and reason. Lengths are judged in the JVM; only pairs that pass them and are long
    enough to compare go to Python."""
    p = pairs.withColumn("length", T.length_guard(F.col("original"), F.col("fixed")))
    short = p.filter("length <> 'ok'").select("id", F.lit(False).alias("ok"), F.col("length").alias("reason"))
    rest = flat_map(p.filter("length = 'ok'").select("id", "original", "fixed"), lambda i, a, b: [(i, *folds.guard(a or "", b or ""))], "id long, ok boolean, reason string")
    return short.union(rest)


def changes(records: DataFrame) -> DataFrame:
    """book_id, old, new, count, label, level, ctx, chunks: edits of accepted records, counted; the risky ones sort first."""
    return summarise(edits(records))


def edits(records: DataFrame) -> DataFrame:
    """book_id, i, n, old, new, ctx: the edits of accepted records, n counting within a record. A record shows its first 500 edits,
    as the change table's contract has it."""
    ok = records.filter("status = 'ok'").select("book_id", "i", "orig", "fixed")
    return flat_map(
        ok, lambda b, i, o, f: [(b, i, n, old, new, folds.context(o or "", old)) for n, (old, new) in enumerate(folds.change_pairs(o or "", f or ""))],
        "book_id string, i string, n int, old string, new string, ctx string",
    )


def summarise(pairs: DataFrame) -> DataFrame:
    """The change table of pairs (book_id, i, n, old, new, ctx): where `i` is "3" or "3.1" and n counts within it. `chunks` is the
    number of chunks that hold the edit; which they are, `edit_chunks` has a row for each."""
    p = pairs.filter((T.strip(F.col("old")) != "") | (T.strip(F.col("new")) != ""))
    at = F.struct(F.transform(F.split("i", r"\."), lambda x: x.cast("int")).alias("i"), F.col("n"))
    per_chunk = p.groupBy("book_id", "old", "new", "i").agg(F.count("*").alias("c"), F.min(at).alias("at"), F.min_by("ctx", at).alias("ctx"))
    g = per_chunk.groupBy("book_id", "old", "new").agg(F.sum("c").alias("count"), F.min_by("ctx", "at").alias("ctx"), F.min("at").alias("first"), F.count("*").alias("chunks"))
    kind = T.classify_change(F.col("old"), F.col("new"))
    return g.select("book_id", "old", "new", "count", kind["label"].alias("label"), kind["level"].alias("level"), "ctx", "chunks", "first")


def edit_chunks(pairs: DataFrame) -> DataFrame:
    """book_id, old, new, i: the chunks that hold each edit, a row for each, so that a common edit's fill no row."""
    return pairs.select("book_id", "old", "new", "i").distinct()


def with_chunk_lists(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """A change table with the list of chunks in place of their number, as a book's report shows it; for books, which are bounded."""
    at = F.transform(F.split("i", r"\."), lambda x: x.cast("int"))
    own = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "i"))), lambda x: x["i"])
    return table.drop("chunks").join(edit_chunks(pairs).groupBy("book_id", "old", "new").agg(own.alias("chunks")), ["book_id", "old", "new"])


def proof_summary(records: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c).alias
    return records.groupBy("book_id").agg(F.count("*").alias("blocks"), n(F.col("status") == "ok")("ok"), n(F.col("status") != "ok")("fallback"), n(F.col("changed"))("changed"))


def newest(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key by `order`; Spark limits each task's rows before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def restore(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """name, action: what restoring a snapshot's files (name) does to the current ones: put back or remove."""
    return snapshot.select("name", F.lit("restore").alias("action")).union(current.join(snapshot, "name", "left_anti").select("name", F.lit("remove").alias("action")))


def todo(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages without a successful result in `cache` (book_id, page_no, status): failures are tried again."""
    return pages.join(cache.filter("status = 'ok'"), ["book_id", "page_no"], "left_anti")


def speeds(samples: DataFrame) -> DataFrame:
    """key, pages, total_sec from samples (key, at, pages, seconds) in order, the past halved beyond 2000 pages."""

    def run(rows):
        key, total = None, (0, 0.0)
        for key, _, pages, seconds in rows:
            if pages > 0 and seconds > 0:
                if total[0] > 2000:
                    total = (1000, total[1] / 2)
                total = (total[0] + pages, total[1] + seconds)
        yield key, *total

    return fold(samples.select("key", "at", "pages", "seconds"), ["key"], ["at"], run, "key string, pages long, total_sec double")


def estimate(speed: DataFrame, pages: int, concurrency: int = 1) -> DataFrame:
    """key, seconds: expected time for `pages` pages; null with less than five pages of experience."""
    return speed.select("key", F.when(F.col("pages") >= 5, F.col("total_sec") / F.col("pages") * pages / max(1, concurrency)).alias("seconds"))

"""Pages of books: running heads and feet, joining, classification, chapters. `pages` has book_id, page_no, text and, where
pictures matter, illustration."""

from __future__ import annotations

from itertools import tee

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as T
from .rows import flat_map, fold

#: Ids that make a book of each source; a book is joined in one row, so it must stay bounded.
BOOK_IDS = 5000


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """The driver's documents as pages: a book for each source and each stretch of BOOK_IDS ids, a page's number its place there. So
    books stay bounded however large a source is, and nothing is shuffled."""
    book = F.concat_ws("-", "source", F.floor(F.col("doc_id") / BOOK_IDS).cast("string"))
    return docs.select(book.alias("book_id"), (F.pmod("doc_id", F.lit(BOOK_IDS)) + 1).cast("int").alias("page_no"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def running_lines(pages: DataFrame, min_ratio: float = 0.35, longest: int = 60, min_count: int = 1) -> DataFrame:
    """book_id, line: first lines, or last lines, of at least `min_ratio` of a book's pages, blank pages included.

    Lines are counted before they are shuffled, so a large book sends a row for each task and line."""
    own = pages.select("book_id", T.stripped_lines(F.col("text")).alias("l"))
    n = pages.groupBy("book_id").agg(F.count("*").alias("pages"))
    ends = own.select("book_id", F.explode(F.array(F.struct(F.lit("head").alias("end"), F.try_element_at("l", F.lit(1)).alias("line")), F.struct(F.lit("foot").alias("end"), F.try_element_at("l", F.lit(-1)).alias("line")))).alias("e"))
    counts = ends.select("book_id", "e.end", "e.line").filter(F.length("line").between(1, longest)).groupBy("book_id", "end", "line").agg(F.count("*").alias("c"))
    return counts.join(n, "book_id").filter((F.col("c") >= F.lit(min_ratio) * F.col("pages")) & (F.col("c") >= min_count)).select("book_id", "line").distinct()


def drop_running_lines(pages: DataFrame, junk: DataFrame) -> DataFrame:
    """`pages` without the junk lines of their book, wherever these stand. A book's set is at most a few dozen lines (two for each
    1 / min_ratio), so it travels as one array."""
    sets = junk.groupBy("book_id").agg(F.collect_set("line").alias("junk"))
    kept = F.array_join(F.filter(T.lines(F.col("text")), lambda x: ~F.array_contains(F.coalesce("junk", F.array().cast("array<string>")), T.strip(x))), "\n")
    return pages.join(sets, "book_id", "left").withColumn("text", kept).drop("junk")


def joined_pages(pages: DataFrame) -> DataFrame:
    """book_id, body: the non-blank pages in order; a blank line stands around pictures and before headings and images."""
    p = pages.withColumn("text", T.strip(T.text("text"))).filter("text <> ''")
    first = T.strip(F.element_at(T.lines(F.col("text")), 1))
    before = F.lag("illustration").over(Window.partitionBy("book_id").orderBy("page_no"))
    gap = F.when(F.coalesce(before, F.lit(False)) | F.col("illustration") | T.is_chapter_line(first) | first.rlike(T.IMAGE_LINE), "\n\n").otherwise("\n")
    p = p.withColumn("part", F.concat(gap, "text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "part"))), lambda x: x["part"]), "")
    return p.groupBy("book_id").agg(T.strip(body).alias("body"))


def toc_hits(pages: DataFrame) -> DataFrame:
    """`pages` with `toc_lines`, the number of contents entries on each."""
    return pages.withColumn("toc_lines", F.size(T.toc_entries(T.text("text"))))


def classify_pages(pages: DataFrame) -> DataFrame:
    """book_id, page_no, kind: cover, back_cover, title_page, copyright, toc, or null. Needs toc_lines; pictures and blank pages
    are left out and don't count as positions."""
    p = pages.filter(~F.coalesce(F.col("illustration"), F.lit(False)) & (T.strip(F.col("text")) != ""))
    book = Window.partitionBy("book_id")
    t, own = T.strip(F.col("text")), T.stripped_lines(F.col("text"))
    p = p.select("book_id", "page_no", "toc_lines", t.alias("t"), own.alias("l"), T.char_count(t).alias("n"), (F.row_number().over(book.orderBy("page_no")) - 1).alias("pos"), F.count("*").over(book).alias("total"))
    sentence = F.exists("l", lambda x: x.rlike("[。！？；]$") & (F.length(x) > 8))
    heading = F.exists(F.slice("l", 1, 3), T.is_chapter_line)
    return p.select(
        "book_id", "page_no",
        F.when(F.element_at("l", 1).rlike("(?i)" + T.TOC_HEADING) | (F.col("toc_lines") >= 4), "toc")
        .when(F.col("t").rlike(T.COPYRIGHT_WORDS), "copyright")
        .when((F.col("pos") == 0) & (F.col("page_no") <= 2) & (F.col("n") <= 60), "cover")
        .when((F.col("pos") == F.col("total") - 1) & (F.col("n") <= 60), "back_cover")
        .when((F.col("pos") < 6) & (F.col("page_no") <= 8) & (F.col("n") <= 120) & (F.size("l") <= 6) & ~sentence & ~heading, "title_page")
        .alias("kind"),
    )


def kind_summary(classified: DataFrame) -> DataFrame:
    """book_id, kind, first, last, pages: where a book's structural pages are."""
    return classified.filter("kind IS NOT NULL").groupBy("book_id", "kind").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.countDistinct("page_no").alias("pages"))


def outline_chapters(outline: DataFrame, totals: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """book_id, title, start_page, end_page from bookmarks (book_id, ord, level, title, page): those of level 1, or of the least
    level there is; each ends before the next one starts. `totals`: book_id, total."""
    ok = outline.filter("level >= 1 AND page >= 1")
    level = ok.groupBy("book_id").agg(F.min("level").alias("chapter_level"))
    at = outline.join(level, "book_id").filter("level = chapter_level").join(totals, "book_id").filter("page BETWEEN 1 AND total")
    at = at.withColumn("title", T.normalise_title(F.col("title"))).filter("title <> ''")
    at = at.groupBy("book_id", "title", "page", "total").agg(F.min("ord").alias("ord"))
    following = F.lead("page").over(Window.partitionBy("book_id").orderBy("page", "ord"))
    end = F.least(F.col("total"), F.coalesce(following, F.col("total") + 1) - 1)
    low, high = F.lit(max(1, first)), F.least(F.col("total"), F.lit(last if last is not None else 2**31 - 1))
    at = at.withColumn("e", end).filter((F.col("e") >= low) & (F.col("page") <= high) & (low <= high))
    return at.select("book_id", "title", F.greatest(low, F.col("page")).cast("int").alias("start_page"), F.least(high, F.col("e")).cast("int").alias("end_page"))


def next_body_page(entries: DataFrame, body: DataFrame) -> DataFrame:
    """`entries` (book_id, ord, printed) with `actual`: the body page of the printed number, else the first one at or after the
    number counted from the first body page; null outside the body. `body`: book_id, page_no."""
    ends = body.groupBy("book_id").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    exact = body.select("book_id", F.col("page_no").alias("printed"), F.lit(True).alias("same"))
    e = entries.join(ends, "book_id", "left").join(exact, ["book_id", "printed"], "left").withColumn("want", F.col("lo") + F.col("printed") - 1)
    # As-of by a union, from the last page back: each wanted page, once however many entries want it, sees the body page met last.
    both = e.select("book_id", F.col("want").alias("page"), F.lit(None).cast("int").alias("real")).filter("page IS NOT NULL").distinct().union(body.select("book_id", "page_no", "page_no"))
    back = Window.partitionBy("book_id").orderBy(F.desc("page"), F.desc_nulls_last("real")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("next", F.last("real", ignorenulls=True).over(back)).filter("real IS NULL").select("book_id", F.col("page").alias("want"), "next")
    inside = F.col("want").between(F.col("lo"), F.col("hi")) & (F.col("printed") > 0)
    return e.join(found, ["book_id", "want"], "left").select("book_id", "ord", "printed", F.when(F.col("same") & (F.col("printed") > 0), F.col("printed")).when(inside, F.col("next")).alias("actual"))


def accept_rising(mapped: DataFrame) -> DataFrame:
    """Entries (book_id, ord, actual) whose page is beyond all before: a running maximum, since what is refused never exceeds
    what was accepted. With end_page: the page before the next one's; null for the last."""
    before = F.max("actual").over(Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    kept = mapped.withColumn("before", F.coalesce(before, F.lit(0))).filter("actual > before").drop("before")
    return kept.withColumn("end_page", F.lead("actual").over(Window.partitionBy("book_id").orderBy("ord")) - 1)


def pages_in_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """`pages` (book_id, page_no) with `chapter`: the first, by start, of the intervals (book_id, ord, start_page, end_page) that
    cover it, and `run`, which numbers stretches of pages of the same chapter or of none."""
    c = chapters.select("book_id", F.col("start_page").alias("s"), F.col("end_page").alias("e"), "ord")
    hit = pages.join(c, (pages["book_id"] == c["book_id"]) & F.col("page_no").between(F.col("s"), F.col("e")), "left").select(pages["book_id"], "page_no", "s", "ord")
    one = hit.groupBy("book_id", "page_no").agg(F.min(F.struct("s", "ord")).alias("m")).select("book_id", "page_no", F.col("m.ord").alias("chapter"))
    order = Window.partitionBy("book_id").orderBy("page_no")
    new = ~F.lag("chapter").over(order).eqNullSafe(F.col("chapter")) | (F.row_number().over(order) == 1)
    return one.withColumn("run", F.sum(new.cast("int")).over(order))


def chapters_by_heading(books: DataFrame, default: str = "正文", most: int = 30_000, part: int = 12_000) -> DataFrame:
    """book_id, ord, title, body: a heading starts a chapter, one without a body goes; a single long chapter is cut into parts.

    Each body is cut in its own row, so no line is shuffled."""
    marked = F.transform(T.lines(F.col("body")), lambda x: F.when(T.is_chapter_line(x), F.concat(F.lit("\x01"), T.strip(F.regexp_replace(T.strip(x), "^#+", "")), F.lit("\x02"))).otherwise(x))
    pieces = F.split(F.array_join(marked, "\n"), "\x01", -1)
    split = F.transform(pieces, lambda x: F.struct(F.when(x.contains("\x02"), F.substring_index(x, "\x02", 1)).otherwise(default).alias("title"), T.strip(F.when(x.contains("\x02"), F.substring_index(x, "\x02", -1)).otherwise(x)).alias("body")))
    b = books.select("book_id", split.alias("all")).select("book_id", "all", F.filter("all", lambda c: c["body"] != "").alias("c"))
    last = F.element_at("all", -1)
    b = b.select("book_id", F.when(F.size("c") > 0, F.col("c")).otherwise(F.array(last)).alias("c"))
    body = F.get("c", 0)["body"]
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(body) / part).cast("int") - 1), lambda i: F.struct(F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 部分")).alias("title"), F.substring(body, i * part + 1, F.lit(part)).alias("body")))
    b = b.select("book_id", F.when((F.size("c") == 1) & (F.length(body) > most), parts).otherwise(F.col("c")).alias("c"))
    return b.select("book_id", F.posexplode("c").alias("ord", "x")).select("book_id", "ord", "x.title", "x.body")


def page_chunks(pages: DataFrame, size: int = 20, extra: int = 6) -> DataFrame:
    """book_id, chapter, first, last: chapters of about `size` pages that end at a clean page or before a heading. All rows of a page
    are one page: its first one (text before picture) tells how it begins, its last one how it ends. Pages stream past; no more
    than a chapter's flags are held."""
    size = max(1, size)
    picture = F.coalesce(F.col("illustration"), F.lit(False)) if "illustration" in pages.columns else F.lit(False)
    own = pages.filter(T.strip(F.col("text")) != "").withColumn("place", F.struct(picture.alias("p"), F.xxhash64("text").alias("t")))
    heading, clean = T.is_chapter_line(F.element_at(T.lines(T.strip(F.col("text"))), 1)), T.ends_cleanly(F.col("text"))
    flags = own.groupBy("book_id", "page_no").agg(F.min_by(heading, "place").alias("heading"), F.max_by(clean, "place").alias("clean"))

    def cut(rows):
        chapter, held = 1, []
        for book, page, heading, clean in rows:
            if len(held) >= size and (heading or held[-1][1] or len(held) >= size + extra):
                yield book, chapter, held[0][0], held[-1][0]
                chapter, held = chapter + 1, []
            held.append((page, clean))
        if held:
            yield book, chapter, held[0][0], held[-1][0]

    return fold(flags, ["book_id"], ["page_no"], cut, "book_id string, chapter int, first int, last int")


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """book_id, page_no, repeats: whether a page's text repeats one of the last four kept ones of its book."""

    def mark(rows):
        from collections import deque

        recent = deque(maxlen=4)
        for book, page, text in rows:
            norm = folds.key(text)
            repeats = folds.page_repeats(norm, recent)
            if not repeats:
                recent.append(norm)
            yield book, page, repeats

    return fold(pages.select("book_id", "page_no", "text"), ["book_id"], ["page_no"], mark, "book_id string, page_no int, repeats boolean")


def strip_headers(pages: DataFrame) -> DataFrame:
    """The batch cleaner's header rule over each book: pages without lines that resemble the last three pages' ends."""

    def clean(rows):
        one, other = tee(rows)  # read together, so nothing is held but the page at hand
        for (book, page, _), (t, _) in zip(one, folds.without_headers(r[2] for r in other), strict=True):
            yield book, page, t

    return fold(pages.select("book_id", "page_no", "text"), ["book_id"], ["page_no"], clean, "book_id string, page_no int, text string")


def on_pages(pages: DataFrame, rule) -> DataFrame:
    """`pages` with `rule(texts)` in place of the texts, a list of them at a time, without a shuffle."""
    return flat_map(pages.select("book_id", "page_no", "text"), lambda *row: [row], "book_id string, page_no int, text string", ahead=rule)


def contents_spans(contents: DataFrame, body: DataFrame) -> DataFrame:
    """book_id, ord, title, start_page, end_page of the chapters that contents pages (book_id, page_no, text) list: printed numbers
    become pages of the body (book_id, page_no), only such as rise, and each chapter ends before the next one or with the body."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    whole = contents.groupBy("book_id").agg(F.array_join(own, "\n").alias("text"))
    entries = whole.select("book_id", F.posexplode(T.toc_entries(F.col("text"))).alias("ord", "e")).select("book_id", "ord", "e.title", "e.printed")
    numbers = body.select("book_id", "page_no").distinct()
    last = numbers.groupBy("book_id").agg(F.max("page_no").alias("hi"))
    mapped = accept_rising(next_body_page(entries.select("book_id", "ord", "printed"), numbers).filter("actual IS NOT NULL").select("book_id", "ord", "actual"))
    return mapped.join(entries.select("book_id", "ord", "title"), ["book_id", "ord"]).join(last, "book_id").select("book_id", "ord", "title", F.col("actual").alias("start_page"), F.coalesce("end_page", "hi").alias("end_page"))


def extract_notes(pages: DataFrame) -> DataFrame:
    """book_id, page_no, body, notes: each page's footnotes with ids from 1 within the page."""
    return flat_map(
        pages.select("book_id", "page_no", "text"),
        lambda b, n, t: [(b, n, body, [{"note_id": i, "label": label, "text": x} for i, label, x in notes]) for body, notes in [folds.extract_notes(t)]],
        "book_id string, page_no int, body string, notes array<struct<note_id:int,label:string,text:string>>",
    )


def number_notes(extracted: DataFrame) -> DataFrame:
    """`extracted` with ids that run through each book: the page's own ids plus the number of notes before it."""
    before = F.coalesce(F.sum(F.size("notes")).over(Window.partitionBy("book_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    e = extracted.withColumn("k", before)
    shift = F.transform("notes", lambda n: n.withField("note_id", (n["note_id"] + F.col("k")).cast("int")))
    # References hold page-wise ids; each is rewritten by its own number.
    body = F.aggregate(F.col("notes"), F.col("body"), lambda t, n: F.replace(t, F.concat(F.lit("[[NOTE_REF:"), n["note_id"].cast("string"), F.lit("|")), F.concat(F.lit("[[NOTE_REF:+"), (n["note_id"] + F.col("k")).cast("string"), F.lit("|"))))
    return e.withColumn("body", F.replace(body, F.lit("[[NOTE_REF:+"), F.lit("[[NOTE_REF:"))).withColumn("notes", shift).drop("k")


def chapter_notes(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """book_id, ord, note_id, label, text, number: the notes each chapter refers to, once, numbered by first reference."""
    refs = chapters.select("book_id", "ord", F.posexplode(T.note_refs(F.col("body"))).alias("at", "r")).groupBy("book_id", "ord", F.col("r.id").alias("note_id")).agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("book_id", "ord").orderBy("at"))
    return refs.join(notes, ["book_id", "note_id"]).select("book_id", "ord", "note_id", "label", "text", n.alias("number"))


def notes_appendix(notes: DataFrame) -> DataFrame:
    line = T.strip(F.concat_ws(" ", "label", "text"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("note_id", line.alias("t")))), lambda x: x["t"])
    return notes.groupBy("book_id").agg(F.concat(F.lit("# 注释\n\n"), F.array_join(own, "\n\n")).alias("appendix"))


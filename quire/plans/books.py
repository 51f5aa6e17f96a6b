"""Whole plans: the cleaner without a model, and books from pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as T
from ..operators import books
from ..operators.rows import flat_map, partitions, written


# Names that a stored configuration has for some settings.
NAMES = {
    "prefix_dedupe_min_shared": "prefix_shared", "proof_chunk_chars": "chunk_chars", "proof_len_ratio_low": "length_low", "proof_len_ratio_high": "length_high", "proof_similarity_min": "similar",
    "proof_retry_split_on_fail": "retry", "proof_retry_min_chars": "retry_least", "chapter_target_pages": "chapter_pages", "auto_page_classify": "classify", "dedupe_similarity": "page_similar",
}
MOST_CLIENTS, TEST_PAGES = 4, (1, 10)


@dataclass(frozen=True)
class Settings:
    """Recommended values; a setting that is None or empty falls back to its default, one that was given stands."""

    dpi: int = 200
    concurrency: int = 1  # clients at work at once, at most MOST_CLIENTS
    backend: str = "stub"
    mode: str = "full"  # "test" takes TEST_PAGES
    page_range: tuple[int, int] | None = None
    force_reocr: bool = False  # pages in the cache are read again
    classify: bool = True  # structural pages that aren't given are looked for
    running_ratio: float = 0.35
    prefix_shared: int = 5
    page_similar: float = 0.90  # kept for stored configurations; whole pages are compared by their own threshold
    chapter_method: str = "toc"
    chapter_pages: int = 20
    proofread: bool = False
    proof_model: str = ""
    chunk_chars: int = 700
    length_low: float = 0.95
    length_high: float = 1.05
    similar: float = 0.90
    retry: bool = True
    retry_least: int = 240
    title: str = ""
    author: str = ""
    language: str = "zh-CN"

    @classmethod
    def of(cls, given: dict) -> Settings:
        named = {NAMES.get(k, k): v for k, v in given.items() if v not in (None, "")}
        known = {k: v for k, v in named.items() if k in cls.__dataclass_fields__}
        if "concurrency" in known:
            known["concurrency"] = min(MOST_CLIENTS, max(1, int(known["concurrency"])))
        if known.get("mode") == "test":
            known["page_range"] = TEST_PAGES
        return cls(**known)

    def within(self, pages: DataFrame) -> DataFrame:
        """The pages (page_no) of the range that is set."""
        return pages if self.page_range is None else pages.filter(F.col("page_no").between(*self.page_range))


def clean_books(pages: DataFrame, settings: Settings = Settings(), min_count: int = 1) -> DataFrame:
    """book_id, chars, body: pages cleaned, without running heads, re-flowed and joined. Page rules run once, in each page's row: the
    cleaned pages are written, since they are read for their end lines and again without them; what is shuffled are counts of end
    lines and, once, the cleaned pages."""
    cleaned = written(pages.withColumn("text", T.collapse_full_repeat(T.collapse_punctuation(T.text("text")))))
    kept = books.drop_running_lines(cleaned, books.running_lines(cleaned, settings.running_ratio, min_count=min_count))
    flowed = kept.select("book_id", "page_no", F.lit(False).alias("illustration"), T.merge_wrapped(F.col("text")).alias("text"))
    body = books.joined_pages(flowed)
    return body.select("book_id", F.length("body").cast("long").alias("chars"), "body")


def processed_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """book_id, page_no, illustration, text, notes: the conversion's page steps up to chaptering, in their order: clean, running
    lines, notes, noise, merge, collapse, repeated pages, shared prefixes. What is read twice is written once."""
    is_picture = F.col("text").startswith("![")
    cleaned = written(pages.withColumn("text", T.clean_page(T.text("text"))))
    kept = books.drop_running_lines(cleaned, books.running_lines(cleaned, settings.running_ratio))
    pictures = kept.filter(is_picture).select("book_id", "page_no", F.lit(True).alias("illustration"), "text")
    noted = books.number_notes(books.extract_notes(kept.filter(~is_picture)))
    noted = written(noted.repartition(partitions(noted)))
    flowed = noted.select("book_id", "page_no", T.merge_wrapped(T.drop_noise_lines(F.col("body"))).alias("text"), "notes")
    collapsed = written(books.on_pages(flowed, folds.collapse_pages))
    fresh = collapsed.join(books.duplicate_pages(collapsed).filter("NOT repeats").select("book_id", "page_no"), ["book_id", "page_no"], "left_semi")
    trimmed = books.on_pages(fresh, partial(_without_prefixes, least=settings.prefix_shared)).filter("text <> ''")
    own = trimmed.withColumn("illustration", F.lit(False)).select("book_id", "page_no", "illustration", "text").unionByName(pictures)
    return own.join(noted.select("book_id", "page_no", "notes"), ["book_id", "page_no"], "left")


def _without_prefixes(texts: list[str], least: int) -> list[str]:
    return ["\n\n".join(folds.dedupe_prefixes(folds.split_paragraphs(t), least)[0]) for t in texts]


def _by_spans(processed: DataFrame, outline: DataFrame) -> DataFrame:
    """book_id, ord, title, body: pages by the spans (book_id, ord, title, start_page, end_page) that cover them; what stands
    before, between and behind them is a chapter of its own."""
    placed = books.pages_in_chapters(processed.select("book_id", "page_no"), outline)
    at = processed.join(placed, ["book_id", "page_no"])
    runs = at.select(F.concat_ws("\x00", "book_id", F.col("run").cast("string")).alias("book_id"), "page_no", "illustration", "text")
    joined = books.joined_pages(runs).select(F.substring_index("book_id", "\x00", 1).alias("book_id"), F.substring_index("book_id", "\x00", -1).cast("int").alias("run"), "body")
    names = placed.groupBy("book_id", "run").agg(F.first("chapter").alias("chapter")).join(outline.select("book_id", F.col("ord").alias("chapter"), "title"), ["book_id", "chapter"], "left")
    spans = outline.select("book_id", F.lit(True).alias("has")).distinct()
    title = F.coalesce("title", F.when((F.col("run") == 1) & F.coalesce("has", F.lit(False)), "前言").otherwise("正文"))
    own = joined.join(names, ["book_id", "run"]).join(spans, "book_id", "left")
    return own.select("book_id", (F.row_number().over(Window.partitionBy("book_id").orderBy("run")) - 1).alias("ord"), title.alias("title"), "body")


def finished(chapters_: DataFrame) -> DataFrame:
    """Chapters (book_id, ord, title, body) with lines re-flowed over page breaks, and without the paragraphs that these repeat."""
    flowed = chapters_.select("book_id", "ord", "title", T.merge_wrapped(F.col("body")).alias("body"))
    return flat_map(flowed, lambda *row: [row], "book_id string, ord int, title string, body string", ahead=folds.collapse_pages)


def chapters(processed: DataFrame, outline: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """book_id, ord, title, body: by outline (book_id, ord, title, start_page, end_page) where a book has one, else by headings."""
    bodies = books.chapters_by_heading(books.joined_pages(processed.select("book_id", "page_no", "illustration", "text")))
    if outline is None:
        return finished(bodies)
    marked = outline.select("book_id").distinct()
    return finished(_by_spans(processed.join(marked, "book_id", "left_semi"), outline).union(bodies.join(marked, "book_id", "left_anti")))


#: Sections before the body: setting, title, kind of page that stands in where the setting is empty; spans take a range of pages.
SECTIONS = (("cover_page", "封面", "cover"), ("back_cover_page", "封底", "back_cover"), ("title_page", "扉页", "title_page"), ("copyright_page", "版权页", "copyright"))
SPANS = (("toc_page_range", "目录", "toc"), ("preface_page_range", "序言", None))


def assign_sections(pages: list[int], kinds: dict[str, list[int]], given: dict) -> list[tuple[int, str, int]]:
    """(page, title, place of the section) of a book's structural pages: what was given goes before what was found, and a page
    belongs to the first section that takes it."""
    taken: dict[int, tuple[int, str, int]] = {}
    for place, (key, title, kind) in enumerate((*SECTIONS, *SPANS)):
        found = sorted(kinds.get(kind) or []) if kind else []
        value = given.get(key)
        if (key, title, kind) in SECTIONS:
            chosen = [value or next(iter(found), None)]
        else:
            low, high = (min(value), max(value)) if value and all(value) else (min(found), max(found)) if found else (1, 0)
            chosen = [p for p in pages if low <= p <= high]
        for p in chosen:
            if p in pages and p not in taken:
                taken[p] = (p, title, place)
    return list(taken.values())


def structured_chapters(processed: DataFrame, given: dict | None = None, outline: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """book_id, ord, title, body: structural pages as sections of their own, then the body by its contents pages, by the outline
    where these say nothing, or, with chapter_method "pages", by page counts. `given` holds the settings of SECTIONS and SPANS,
    chapter_method and chapter_target_pages. What is gathered for a book are its page numbers, not its texts."""
    given = given or {}
    settings = Settings.of(given | {"chapter_method": given.get("chapter_method") or settings.chapter_method, "chapter_pages": given.get("chapter_target_pages") or settings.chapter_pages})
    p = processed.select("book_id", "page_no", "illustration", "text").filter("page_no > 0")
    kinds = books.classify_pages(books.toc_hits(p))
    kinds = kinds if settings.classify else kinds.filter(F.lit(False))
    index = p.select("book_id", "page_no").distinct().join(kinds, ["book_id", "page_no"], "left").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "kind"))).alias("pages"))

    def assign(book, rows):
        found: dict[str, list[int]] = {}
        for r in rows:
            if r["kind"]:
                found.setdefault(r["kind"], []).append(r["page_no"])
        for page, title, place in assign_sections([r["page_no"] for r in rows], found, given):
            yield book, page, title, place

    sections = flat_map(index, assign, "book_id string, page_no int, section string, place int")
    front = p.join(sections, ["book_id", "page_no"])
    keyed = front.select(F.concat_ws("\x00", "book_id", F.col("place").cast("string"), "section").alias("book_id"), "page_no", "illustration", "text")
    part = F.split("book_id", "\x00")
    fronts = books.joined_pages(keyed).filter("body <> ''").select(part[0].alias("book_id"), part[1].cast("int").alias("ord"), part[2].alias("title"), "body")
    body = p.join(sections, ["book_id", "page_no"], "left_anti")
    if settings.chapter_method == "pages":
        cut = books.page_chunks(body, settings.chapter_pages)
        spans = cut.select("book_id", F.col("chapter").alias("ord"), F.concat(F.lit("第"), F.col("chapter").cast("string"), F.lit("章")).alias("title"), F.col("first").alias("start_page"), F.col("last").alias("end_page"))
    else:
        spans = books.contents_spans(front.filter("section = '目录'").select("book_id", "page_no", "text"), body)
        if outline is not None:
            last = body.groupBy("book_id").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
            trimmed = outline.join(last, "book_id").select("book_id", F.col("ord").cast("int").alias("ord"), "title", F.greatest("lo", "start_page").alias("start_page"), F.least("hi", "end_page").alias("end_page")).filter("end_page >= start_page")
            spans = spans.union(trimmed.join(spans.select("book_id").distinct(), "book_id", "left_anti"))
    rest = _by_spans(body, spans).withColumn("ord", F.col("ord") + len(SECTIONS) + len(SPANS))
    return finished(fronts.union(rest)).withColumn("ord", (F.row_number().over(Window.partitionBy("book_id").orderBy("ord")) - 1).cast("int"))

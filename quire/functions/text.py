"""Text rules as Column expressions: they stay in the JVM and move no rows.

Patterns avoid `\\w` and `\\d`, whose meaning differs between engines: letters and numbers are `\\p{L}\\p{N}_`, digits `\\p{Nd}`.
Null texts count as empty unless a rule says otherwise."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats

# Character classes, marks and words that results depend on.
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}"
PUNCTUATION_RUNS = "。，、；：！？…．,.;:!?"
TERMINAL_MARKS = "。！？；：”』」》…!?;:."
CLEAN_END_MARKS = "。！？；：”』」》…!?;:）)"
DANGLING = r"[·、，：；/\\—–－]\s*$"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
SHORT_LINE = 30
CHAPTER_LINES = (
    r"^#+\s+.*$",
    r"^第\s*[0-9一二三四五六七八九十百千零〇]+\s*[章节篇回卷部集]\s*.*$",
    r"^(?:CHAPTER|Chapter)\s+[0-9IVXLC]+\s*.*$",
    r"^(?:序(?:言|章)?|前言|后记|附录|引子|楔子|尾声)$",
)
NUMERIC_CHAPTER_WORDS = "章|回|篇|卷|部|集|讲|幕|序|引子|楔子|尾声|附录"
COPYRIGHT_WORDS = r"版权所有|著作权|ISBN|书\s*号|出版发行|版\s*次|印\s*次|印\s*张|开\s*本|责任编辑|装帧设计|封面设计|定\s*价|新华书店|排版印制|出版社"
TOC_HEADING = r"^\s*(?:目\s*录|目\s*次|contents?)\s*$"
NO_TEXT = "[NO_TEXT]"
NOTE_REF = r"\[\[NOTE_REF:([0-9]+)\|(.+?)\]\]"
IMAGE_LINE = r"^!\[(.*?)\]\((.*?)\)$"

#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOC_LINE = r"^(.{2,}?)(?:\s*[·•●‧・._…⋯][\s·•●‧・._…⋯]*\s*|\s+)([0-9]{1,4})\s*$"
TOC_TITLE = r"^(?:目\s*录|contents?)$"


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it (as the element of a one-element array)."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def stripped_lines(c: Column) -> Column:
    """Lines without white space around them, empty ones left out."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(c, separator, -1), strip), lambda x: x != "")


def char_count(c: Column) -> Column:
    """Letters and digits of ASCII and the characters of Chinese and Japanese."""
    return F.length(F.regexp_replace(c, f"[^A-Za-z0-9{CJK}]+", ""))


def dedup_key(c: Column) -> Column:
    """The text's letters, numbers and underscores."""
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{CJK}]+", "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def drop_fences(c: Column) -> Column:
    paired = F.regexp_replace(c, r"(?m)^\s*```[a-zA-Z0-9]*\s*$\n[\s\S]*?^\s*```\s*$", "")
    return F.regexp_replace(paired, r"(?m)^\s*```[a-zA-Z0-9]*\s*$", "")


def circled_numbers(c: Column) -> Column:
    r"""`\textcircled{n}` as ① to ⑳, others as (n)."""
    number = lambda n: rf"\$?\s*\\textcircled\s*\{{\s*{n}\s*\}}\s*\$?"
    for i, mark in enumerate(CIRCLED, 1):
        c = F.regexp_replace(c, number(f"0?{i}" if i < 10 else str(i)), mark)
    return F.regexp_replace(c, number("0?([0-9]{1,2})"), "($1)")


def drop_orphan_latex(c: Column) -> Column:
    return F.regexp_replace(c, r"\$\s*\\[a-zA-Z]+\s*\{?[0-9]*\}?\s*\$", "")


def collapse_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, rf"([{PUNCTUATION_RUNS}])\1+", "$1")


def collapse_tokens(c: Column) -> Column:
    """A word that stands four times or more in a row stands once."""
    word = r"[\p{L}\p{N}_]"
    return F.regexp_replace(c, rf"(?<!{word})([A-Za-z\x{{4e00}}-\x{{9fff}}]{{2,}})(?!{word})(?:\s*\1(?!{word})){{3,}}", "$1")


def collapse_fragments(c: Column, least: int = 4, most: int = 200) -> Column:
    """struct<text, n>: a fragment that stands three times or more in a row stands once, and how many did. Python, in Arrow batches:
    what the pattern tries 200 lengths for at each place, vector operations tell. Not for use inside `let`."""
    kind = repeats.Stutter(least, most, 3, ascii_only=True, across=True)

    def collapse(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        done = iter(repeats.collapsed([x for x in own if x is not None], kind))
        pairs = [(None, None) if x is None else next(done) for x in own]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32())], ["text", "n"])

    return F.arrow_udf(collapse, "text string, n int")(c)


def collapse_full_repeat(c: Column) -> Column:
    """A text that is its own beginning, repeated, becomes that beginning, the shortest one; from eight characters on."""
    return let(c, _shortest_period)


def _shortest_period(c: Column) -> Column:
    n = F.length(c)
    # Only lengths that divide the whole can do: those up to its root, and what these leave, each tried by one comparison.
    small = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n)).cast("int")), lambda k: n % k == 0)
    divisors = F.array_sort(F.array_distinct(F.concat(small, F.transform(small, lambda k: (n / k).cast("int")))))
    period = F.get(F.filter(divisors, lambda k: (k < n) & (F.substring(c, k + 1, n - k) == F.left(c, n - k))), 0)
    return F.when(n >= 8, F.coalesce(F.left(c, period), c)).otherwise(c)


def drop_broken_lines(c: Column) -> Column:
    """Short lines that end in a mark after which something must follow."""
    broken = lambda x: F.length(strip(x)).between(1, SHORT_LINE) & strip(x).rlike(DANGLING)
    return F.array_join(F.filter(lines(c), lambda x: ~broken(x)), "\n")


def drop_figure_index(c: Column) -> Column:
    """A page that is mostly a list of figure numbers loses those lines: eight of them or more, half the lines or more, from at
    most 5 up to at least 12, nearly in order."""
    # Nearly all pages have no such line, and are done with one search.
    return F.when(c.rlike(r"(?m)^\s*图\s*[0-9]{1,4}\s*$"), let(stripped_lines(c), lambda own: _without_figures(c, own))).otherwise(c)


def _without_figures(c: Column, own: Column) -> Column:
    pattern = r"^图\s*[0-9]{1,4}$"
    numbers = F.transform(F.filter(own, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, "([0-9]+)$", 1).cast("int"))
    rising = F.size(F.filter(F.arrays_zip(F.slice(numbers, 1, F.size(numbers) - 1).alias("a"), F.slice(numbers, 2, F.size(numbers) - 1).alias("b")), lambda p: p["b"] >= p["a"]))
    is_list = (F.size(numbers) >= 8) & (F.size(numbers) * 2 >= F.size(own)) & (F.get(numbers, 0) <= 5) & (F.array_max(numbers) >= 12)
    listed = F.when(is_list, rising >= F.greatest(F.lit(1), F.size(numbers) - 2)).otherwise(False)
    return F.when(listed, F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike(pattern)), "\n")).otherwise(c)


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_page(c: Column) -> Column:
    """The page rules, in their order; an empty text stays as it is."""
    out = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    for rule in (drop_fences, circled_numbers, drop_orphan_latex, collapse_punctuation, collapse_tokens):
        out = let(out, rule)
    out = collapse_fragments(out)["text"]
    for rule in (collapse_full_repeat, drop_figure_index, drop_broken_lines, squeeze_blank_lines, strip):
        out = let(out, rule)
    return F.when(c == "", c).otherwise(out)


def is_noise_line(line: Column, compact: Column) -> Column:
    """Page numbers, rules and leaders, marks alone, hardly any letters, stuttering; for a stripped line, and the same without
    white space. What is cheap to tell stands first."""
    return (
        line.rlike("^[0-9ivxlcdmIVXLCDM]{1,8}$")
        | line.rlike(r"^(?U)[·•\-.。…_=\s]{4,}$")
        | (compact.rlike(r"^[^\p{L}\p{N}]+$") & (F.length(compact) >= 2))
        | ((F.length(compact) >= 8) & (char_count(line) < F.lit(0.22) * F.length(compact)))
        | compact.rlike(r"(.{1,8})\1{3,}")
    )


def drop_noise_lines(c: Column) -> Column:
    """Empty lines stay, as empty ones."""
    own = F.transform(lines(c), lambda x: F.struct(x.alias("t"), strip(x).alias("s")))
    own = F.transform(own, lambda x: F.struct(F.when(x["s"] == "", "").otherwise(x["t"]).alias("t"), x["s"].alias("s"), without_space(x["s"]).alias("k")))
    kept = F.filter(own, lambda x: (x["s"] == "") | ~is_noise_line(x["s"], x["k"]))
    return strip(F.array_join(F.transform(kept, lambda x: x["t"]), "\n"))


def is_suspicious(c: Column) -> Column:
    """Recognised text that is empty, or leaders or stutter for the most part."""
    s = strip(c)
    few = char_count(s)
    return (
        (s == "") | (s == NO_TEXT)
        | s.rlike(r"^(?U)[\s.。·•…—\-_=~]+$")
        | (s.rlike(r"[.。·•…]{6,}") & (few < F.greatest(F.lit(80), F.floor(F.length(s) / 2))))
        | (s.rlike(r"(?d)(.)\1{15,}") & (few < 60))
    )


def is_numeric_chapter(line: Column) -> Column:
    pattern = r"(?d)^([0-9]{1,3})\s*[、.．]\s*(\S.*)$"
    tail = strip(F.regexp_extract(line, pattern, 2))
    fits = F.length(tail).between(2, 24) & ~tail.rlike("[，。！？；：,:;!?]") & (F.regexp_count(tail, F.lit(r"(?U)\s")) <= 2)
    return line.rlike(pattern) & fits & (tail.rlike("[A-Za-z]") | tail.rlike(NUMERIC_CHAPTER_WORDS))


def is_chapter_line(line: Column) -> Column:
    s = strip(line)
    listed = s.rlike("(?d)" + CHAPTER_LINES[0])
    for p in CHAPTER_LINES[1:]:
        listed = listed | s.rlike("(?d)" + p)
    return (s != "") & (s.rlike(r"^#+\s+\S") | is_numeric_chapter(s) | ((F.length(s) <= 60) & listed))


def ends_cleanly(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Whether a page's last paragraph ends a sentence, is an image, or there is none."""
    last = F.try_element_at(paragraphs(c, separator), F.lit(-1))
    return F.coalesce(last.rlike(IMAGE_LINE) | F.right(last, F.lit(1)).rlike(f"[{CLEAN_END_MARKS}]"), F.lit(True))


def stands_alone(line: Column) -> Column:
    """Headings, list items, table rows, quotes, images: lines that never join their neighbours."""
    return line.rlike(r"^(?:[#>\-*|`]|\p{Nd})") | is_chapter_line(line) | line.rlike(IMAGE_LINE)


def merge_wrapped(c: Column) -> Column:
    """Lines that a break in the middle of a sentence has split, joined again.

    A line joins the one before it if both are plain text and that one doesn't end a sentence; this looks back one line only,
    so a page is rewritten in its own row, without a shuffle."""
    return let(F.transform(lines(c), strip), _joined)


def _joined(own: Column) -> Column:
    marked = F.transform(own, lambda x: F.struct(x.alias("t"), ((x != "") & ~stands_alone(x)).alias("plain"), x.rlike(f"[{TERMINAL_MARKS}]$").alias("ends")))

    def join(m: Column) -> Column:
        return F.array_join(
            F.transform(m, lambda x, i: F.concat(F.when(i == 0, "").when(x["plain"] & F.get(m, i - 1)["plain"] & ~F.get(m, i - 1)["ends"], "").otherwise("\n"), x["t"])), ""
        )

    return let(marked, join)


def normalise_title(c: Column) -> Column:
    t = strip(F.regexp_replace(text(c), r"(?U)\s+", " "))
    t = strip(F.regexp_replace(t, "^#+", ""))
    return strip(F.regexp_replace(t, r"(?U)^[\-*.\s、\p{Nd}]+", ""))


def slug(c: Column, longest: int = 60) -> Column:
    s = strip(F.regexp_replace(text(c), r'[\\/:*?"<>|\r\n\t]+', ""))
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", "-"), r"^[.\-]+|[.\-]+$", "")
    return F.left(F.when(s == "", "book").otherwise(s), F.lit(longest))


def asset_name(c: Column) -> Column:
    base = F.element_at(F.split(c, "/"), -1)
    safe = F.regexp_replace(F.regexp_replace(base, r'(?U)[\x00-\x1f/\\:*?"<>|\s]+', "-"), r"^[. \-]+|[. \-]+$", "")
    return F.when(safe == "", "asset.bin").otherwise(safe)


def image_marker(name: Column, label: str = "插图") -> Column:
    return F.concat(F.lit(f"![{label}](images/"), asset_name(name), F.lit(")"))


def is_skipped_asset(name: Column) -> Column:
    return name.rlike(r"\.r\p{Nd}{3,4}\.|_crop\.|\.crop\.|\.tmp\.")


def notes_to_paragraphs(c: Column) -> Column:
    """A line that starts with a circled number starts a paragraph."""
    return F.regexp_replace(c, r"\n(\s*[\x{2460}-\x{2473}])", "\n\n$1")


def toc_entries(c: Column) -> Column:
    """(title, printed) of each contents line of a text, in order: one aggregation over its lines, whose state is the beginning of
    a title that waits for its page (a short line without one) and what was found."""
    own = F.filter(F.transform(lines(c), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    none = F.array().cast("array<struct<title:string,printed:int>>")

    def judged(state: Column, line: Column) -> Column:
        def judge(whole: Column) -> Column:
            title = normalise_title(F.regexp_extract(whole, TOC_LINE, 1))
            entry = F.struct(title.alias("title"), F.regexp_extract(whole, TOC_LINE, 2).cast("int").alias("printed"))
            found = let(entry, lambda e: F.when((e["title"] != "") & (e["printed"] > 0), F.array_append(state["out"], e)).otherwise(state["out"]))
            waits = F.when((F.length(line) <= 40) & ~line.rlike("[。！？；]$"), line).otherwise("")
            return (
                F.when(line.rlike("(?i)" + TOC_TITLE), F.struct(F.lit("").alias("waits"), state["out"].alias("out")))
                .when(whole.rlike(TOC_LINE), F.struct(F.lit("").alias("waits"), found.alias("out")))
                .otherwise(F.struct(waits.alias("waits"), state["out"].alias("out")))
            )

        return let(F.when(state["waits"] != "", F.concat(state["waits"], F.lit(" "), line)).otherwise(line), judge)

    # Nearly all pages have no line that ends in a digit, and are done with one search.
    return F.when(c.rlike(r"(?m)[0-9]\s*$"), F.aggregate(own, F.struct(F.lit("").alias("waits"), none.alias("out")), judged)["out"]).otherwise(none)


def note_refs(c: Column) -> Column:
    """The references in a text, in order, as structs of id and label."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(NOTE_REF), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, NOTE_REF, 1).cast("long").alias("id"), F.regexp_extract(m, NOTE_REF, 2).alias("label")))


def note_refs_as_text(c: Column) -> Column:
    return F.regexp_replace(text(c), NOTE_REF, "$2")


def protect_notes(c: Column) -> Column:
    """References as private-use placeholders, which a model carries along."""
    return F.regexp_replace(text(c), NOTE_REF, "\ue000$1\ue001")


def html_to_markdown(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?s)<\?xml.*?\?>", "")
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n\n## $1\n\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p>|</div>|</h[1-6]>", "\n\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for entity, mark in ENTITIES:
        out = F.replace(out, F.lit(f"&{entity};"), F.lit(mark))
    return strip(squeeze_blank_lines(F.regexp_replace(out, r"[ \t]+\n", "\n")))


#: Entities by name, the ampersand last; others stay as they are (see `folds.unescape` for all of them).
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\xa0"), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("amp", "&"))


def classify_change(old: Column, new: Column) -> Column:
    """label and level of an edit: no change, blank, added, deleted, punctuation, wrong character, rewritten, wording."""
    o, n = strip(old), strip(new)
    marks = r"^[^\p{L}\p{N}\x{3400}-\x{9fff}]+$"
    han = r"^[\x{3400}-\x{9fff}]{1,3}$"
    kind = lambda label, level: F.struct(F.lit(label).alias("label"), F.lit(level).alias("level"))
    return (
        F.when(old == new, kind("无变化", "safe"))
        .when((o == "") & (n == ""), kind("空白", "safe"))
        .when(o == "", kind("增补", "warn"))
        .when(n == "", kind("删除", "warn"))
        .when(old.rlike(marks) & new.rlike(marks), kind("标点", "safe"))
        .when(old.rlike(han) & new.rlike(han), kind("错字", "safe"))
        .when((F.length(old) > 6) | (F.length(new) > 6), kind("大段改写", "warn"))
        .otherwise(kind("词句调整", "safe"))
    )


def length_guard(original: Column, fixed: Column, low: float = 0.95, high: float = 1.05) -> Column:
    """The part of the proofreading guard that needs no similarity: empty, short, long or ok."""
    a, b = F.length(without_space(text(original))), F.length(without_space(text(fixed)))
    return F.when(b == 0, "empty").when(a == 0, "ok").when(b < low * a, "short").when(b > high * a, "long").otherwise("ok")


def parse_bool(c: Column, default: bool = False) -> Column:
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin("1", "true", "yes", "on", "y"), True).when(s.isin("0", "false", "no", "off", "n"), False).otherwise(default)


def page_value(c: Column) -> Column:
    n = strip(c.cast("string")).try_cast("int")
    return F.when(n > 0, n)


def page_span(a: Column, b: Column) -> Column:
    """(least, greatest) of two page values; null unless both are pages."""
    x, y = page_value(a), page_value(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.least(x, y).alias("first"), F.greatest(x, y).alias("last")))


# The batch cleaner's variants, each with the number of its hits.


def normalise(c: Column) -> Column:
    out = F.regexp_replace(text(c), "^\ufeff+", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), " *\n *", "\n")


def drop_short_broken_lines(c: Column) -> Column:
    """Broken lines and lines of a single particle."""
    broken = lambda s: (s != "") & ((s.rlike(DANGLING) & (F.length(s) <= SHORT_LINE)) | s.rlike("^[的和与或了着吗呢而]$"))
    return F.array_join(F.filter(lines(c), lambda x: ~broken(strip(x))), "\n")


def clean_by_rules(df: DataFrame) -> DataFrame:
    """`df` with the chain's `text` and its counts: fence, latex, punct, inline_dup, broken."""
    pair = r"(?m)^\s*```[a-zA-Z0-9]*\s*$\n[\s\S]*?^\s*```\s*$"
    count = lambda x, p: F.regexp_count(x, F.lit(p))

    def marks(fence, latex):
        return lambda x: F.struct(collapse_tokens(collapse_punctuation(x)).alias("x"), fence.alias("fence"), latex.alias("latex"), count(x, rf"([{PUNCTUATION_RUNS}])\1+").alias("punct"))

    def numbers(fence):
        return lambda x: let(drop_orphan_latex(circled_numbers(x)), marks(fence, count(x, r"\\textcircled\s*\{\s*[0-9]{1,2}\s*\}")))

    def fences(x):
        return let(drop_fences(x), numbers(count(x, pair) + count(F.regexp_replace(x, pair, ""), r"(?m)^\s*```[a-zA-Z0-9]*\s*$")))

    own = [c for c in df.columns if c != "text"]
    marked = df.select(*own, let(normalise(F.col("text")), fences).alias("m"))
    done = marked.select(*own, "m", collapse_fragments(F.col("m.x"), 8, 400).alias("r"))
    done = done.select(*own, "m", F.col("r.n").alias("inline_dup"), let(F.col("r.text"), lambda x: F.struct(x.alias("x"), drop_short_broken_lines(x).alias("k"))).alias("b"))
    broken = F.size(lines(F.col("b.x"))) - F.size(lines(F.col("b.k")))
    return done.select(*own, strip(squeeze_blank_lines(F.col("b.k"))).alias("text"), "m.fence", "m.latex", "m.punct", "inline_dup", broken.alias("broken"))


def is_blank_page(c: Column, least: int = 50) -> Column:
    return F.length(strip(text(c))) < least


def repeater(c: Column, median: Column, factor: float = 2.0) -> Column:
    """Why a page counts as stuck in a loop: line_repeat, char_repeat; else length_warn or length_ok."""
    own, key = stripped_lines(c), dedup_key(c)
    chars = F.split(key, "")
    return (
        F.when((median <= 0) | (F.length(c) <= F.greatest(median * factor, F.lit(1200.0))), "length_ok")
        .when((F.size(own) >= 4) & (F.size(F.array_distinct(own)) < 0.6 * F.size(own)), "line_repeat")
        .when((key != "") & (F.size(F.array_distinct(chars)) < 0.06 * F.length(key)), "char_repeat")
        .otherwise("length_warn")
    )

"""Every query of the curation engine with, where SQL can say it, the SQL.

On the driver's tables a book is a `source` and a stretch of ids, its pages are its documents in order of doc_id, and a paragraph
is a line (no document holds a blank line). Tables that the driver lacks (bookmarks, contents, boxes, edits, snapshots) are derived
from the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import folds
from .functions import text as T
from .operators import books, layout, review
from .operators.ranking import buckets_for, ranked
from .operators.rows import flat_map, written
from .plans import books as plans
from .sources import books as sinks
from .sources import pages as sources
from .streaming import pages as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WS = r"[\s\p{Z}]"
STRIP = rf"^{WS}+|{WS}+$"
PUNCT = T.PUNCTUATION_RUNS
CHAPTER_SQL = r"""(regexp_matches({0}, '^#+\s+\S') OR ({num}) OR (length({0}) <= 60 AND (regexp_matches({0}, '^#+\s+.*$')
  OR regexp_matches({0}, '^第\s*[0-9一二三四五六七八九十百千零〇]+\s*[章节篇回卷部集]\s*.*$') OR regexp_matches({0}, '^(?:CHAPTER|Chapter)\s+[0-9IVXLC]+\s*.*$')
  OR regexp_matches({0}, '^(?:序(?:言|章)?|前言|后记|附录|引子|楔子|尾声)$'))))"""
NUMERIC_SQL = r"""(regexp_matches({0}, '^([0-9]{{1,3}})\s*[、.．]\s*(\S.*)$')
  AND length(trim(regexp_extract({0}, '^([0-9]{{1,3}})\s*[、.．]\s*(\S.*)$', 2))) BETWEEN 2 AND 24
  AND NOT regexp_matches(regexp_extract({0}, '^([0-9]{{1,3}})\s*[、.．]\s*(\S.*)$', 2), '[，。！？；：,:;!?]')
  AND len(regexp_extract_all(trim(regexp_extract({0}, '^([0-9]{{1,3}})\s*[、.．]\s*(\S.*)$', 2)), '\s')) <= 2
  AND regexp_matches(regexp_extract({0}, '^([0-9]{{1,3}})\s*[、.．]\s*(\S.*)$', 2), '[A-Za-z]|章|回|篇|卷|部|集|讲|幕|序|引子|楔子|尾声|附录'))"""


def chapter_sql(x: str) -> str:
    return CHAPTER_SQL.format(x, num=NUMERIC_SQL.format(x))


PAGES_SQL = f"p AS (SELECT concat_ws('-', source, (doc_id // {books.BOOK_IDS})::VARCHAR) AS book_id, (doc_id % {books.BOOK_IDS} + 1)::INTEGER AS page_no, doc_id, coalesce(text, '') AS text FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("text", T.text("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return books.documents_as_pages(table(spark, d, "documents"))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where rules cost far more than moving the rows and a small table is one file."""
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism))


def per_document(name: str, out: Callable[[], dict], sql: dict[str, str] | None = None) -> None:
    """A rule on each document's text, as columns beside doc_id."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return docs(spark, d).select("doc_id", *[c.alias(k) for k, c in out().items()])

    query(name, "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + " FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)" if sql else None)(run)


t = lambda: F.col("text")
collapse_sql = "text"
for _c in PUNCT:
    collapse_sql = f"regexp_replace({collapse_sql}, '[{_c}]{{2,}}', '{_c}', 'g')"

# --- projections (P) -------------------------------------------------------------------------------------------------
per_document("punct_run_collapse", lambda: {"text": T.collapse_punctuation(t())}, {"text": collapse_sql})
_REP = "CASE doc_id % 3 WHEN 0 THEN repeat(text, 2) WHEN 1 THEN repeat(text, 3) ELSE text END"
query("full_repeat_collapse", f"""WITH x AS (SELECT doc_id, {_REP} AS x FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
k AS (SELECT doc_id, x, list_filter(range(1, sqrt(length(x))::BIGINT + 2), lambda k: length(x) % k = 0) AS k FROM x)
SELECT doc_id, CASE WHEN length(x) >= 8 THEN coalesce(x[1:list_min(list_filter(list_concat(k, list_transform(k, lambda k: length(x) // k)), lambda k: k < length(x) AND x[k + 1:] = x[1:length(x) - k]))], x) ELSE x END AS text FROM k""")(
    lambda spark, d: docs(spark, d).select("doc_id", T.collapse_full_repeat(F.when(F.col("doc_id") % 3 == 0, F.repeat(t(), F.lit(2))).when(F.col("doc_id") % 3 == 1, F.repeat(t(), F.lit(3))).otherwise(t())).alias("text")))
per_document("fence_removal", lambda: {"text": T.drop_fences(F.concat(F.lit("```py\nx\n```\n"), t(), F.lit("\n```")))}, {
    "text": r"regexp_replace(regexp_replace('```py' || chr(10) || 'x' || chr(10) || '```' || chr(10) || text || chr(10) || '```', '(?m)^\s*```[a-zA-Z0-9]*\s*$\n[\s\S]*?^\s*```\s*$', '', 'g'), '(?m)^\s*```[a-zA-Z0-9]*\s*$', '', 'g')"})
_NUMBER = lambda: F.col("doc_id") % 33 + 1
query("latex_circled", r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a ' ELSE 'a' END || CASE WHEN doc_id % 33 < 20 THEN chr((9312 + doc_id % 33)::INTEGER) ELSE '(' || (doc_id % 33 + 1) || ')' END || CASE WHEN doc_id % 2 = 0 THEN ' b' ELSE 'b' END || coalesce(text, '') AS text FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", T.circled_numbers(F.concat(F.lit(r"a "), F.when(F.col("doc_id") % 2 == 0, "$").otherwise(""), F.lit(r"\textcircled{"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(""), _NUMBER().cast("string"), F.lit("}"), F.when(F.col("doc_id") % 2 == 0, "$").otherwise(""), F.lit(" b"), t())).alias("text")))
query("orphan_latex_removal", r"SELECT doc_id, regexp_replace('x $\' || ['alpha', 'beta', 'q1', 'GAMMA'][(doc_id % 4 + 1)::INTEGER] || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '{' || doc_id || '}' END || '$ ' || coalesce(text, ''), '\$\s*\\[a-zA-Z]+\s*\{?[0-9]*\}?\s*\$', '', 'g') AS text FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", T.drop_orphan_latex(F.concat(F.lit("x $\\"), F.element_at(F.array(*map(F.lit, ("alpha", "beta", "q1", "GAMMA"))), (F.col("doc_id") % 4 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("{"), F.col("doc_id").cast("string"), F.lit("}"))), F.lit("$ "), t())).alias("text")))
_TOKEN = r"[\p{L}\p{N}_]"
query("token_repeat_collapse", rf"""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), ' (of|de|und) ', ' \1 \1 \1  \1 ', 'g') AS x FROM documents),
k AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS k FROM (SELECT doc_id, regexp_extract_all(x, '{_TOKEN}+|[^\p{{L}}\p{{N}}_]+') AS l FROM x)),
w AS (SELECT *, regexp_matches(k, '^{_TOKEN}') AS is_word, lag(k) OVER d AS gap, lag(k, 2) OVER d AS before FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, CASE WHEN is_word AND coalesce(k = before AND regexp_full_match(gap, '[ \t\n\x0B\f\r]+') AND regexp_full_match(k, '[A-Za-z\x{{4e00}}-\x{{9fff}}]{{2,}}'), false) THEN 0 ELSE 1 END AS begins FROM w),
g AS (SELECT *, sum(CASE WHEN is_word THEN begins ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
s AS (SELECT *, count(*) FILTER (WHERE is_word) OVER (PARTITION BY doc_id, g) AS words, min(CASE WHEN is_word THEN i END) OVER (PARTITION BY doc_id, g) AS head, max(CASE WHEN is_word THEN i END) OVER (PARTITION BY doc_id, g) AS tail FROM g)
SELECT x.doc_id, coalesce(string_agg(k, '' ORDER BY i) FILTER (WHERE words < 4 OR i <= head OR i > tail), '') AS text FROM x LEFT JOIN s USING (doc_id) GROUP BY x.doc_id""")(
    lambda spark, d: docs(spark, d).select("doc_id", T.collapse_tokens(F.regexp_replace(t(), " (of|de|und) ", " $1 $1 $1  $1 ")).alias("text")))
_FIGURED = lambda: F.array_join(F.transform(T.lines(t()), lambda x, i: F.when((i + F.col("doc_id")) % 3 < 2, F.concat(F.when(i % 7 == 3, F.lit(" 图 ")).otherwise(F.lit("图")), (i + F.col("doc_id") % 9 + 1 - F.when(i % 11 == 5, 3).otherwise(0)).cast("string"))).otherwise(x)), "\n")
query("figure_index_removal", rf"""WITH x AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, k: CASE WHEN (k - 1 + doc_id) % 3 < 2 THEN CASE WHEN (k - 1) % 7 = 3 THEN ' 图 ' ELSE '图' END || (k - 1 + doc_id % 9 + 1 - CASE WHEN (k - 1) % 11 = 5 THEN 3 ELSE 0 END) ELSE x END) AS l FROM documents),
f AS (SELECT doc_id, l, list_filter(list_transform(l, lambda x: regexp_replace(x, '{STRIP}', '', 'g')), lambda x: x <> '') AS own FROM x),
n AS (SELECT *, list_transform(list_filter(own, lambda x: regexp_full_match(x, '图\s*[0-9]{{1,4}}')), lambda x: regexp_extract(x, '([0-9]+)$', 1)::INTEGER) AS n FROM f),
r AS (SELECT *, len(list_filter(range(1, len(n)), lambda k: n[k + 1] >= n[k])) AS rising FROM n)
SELECT doc_id, array_to_string(CASE WHEN len(n) >= 8 AND 2 * len(n) >= len(own) AND n[1] <= 5 AND list_max(n) >= 12 AND rising >= greatest(1, len(n) - 2) THEN list_filter(l, lambda x: NOT regexp_full_match(regexp_replace(x, '{STRIP}', '', 'g'), '图\s*[0-9]{{1,4}}')) ELSE l END, chr(10)) AS text FROM r""")(
    lambda spark, d: docs(spark, d).select("doc_id", T.drop_figure_index(_FIGURED()).alias("text")))
query("clean_page_text")(lambda spark, d: spread(docs(spark, d)).select("doc_id", T.clean_page(t()).alias("text")))
_COUNT = r"length(regexp_replace({0}, '[^A-Za-z0-9\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]+', '', 'g'))"
query("noise_line_filter", rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents),
s AS (SELECT *, regexp_replace(t, '{STRIP}', '', 'g') AS s FROM l), k AS (SELECT *, regexp_replace(s, '{WS}+', '', 'g') AS k FROM s),
n AS (SELECT *, regexp_full_match(s, '[0-9ivxlcdmIVXLCDM]{{1,8}}') OR regexp_full_match(s, '(?:[·•\-.。…_=]|{WS}){{4,}}') OR (length(k) >= 2 AND regexp_full_match(k, '[^\p{{L}}\p{{N}}]+'))
  OR (length(k) >= 8 AND {_COUNT.format('s')} < 0.22::DOUBLE * length(k)) OR len(list_filter(range(1, 9), lambda u: contains(array_to_string(list_transform(range(1, len(c) - u + 1), lambda j: CASE WHEN c[j] = c[j + u] THEN '1' ELSE '0' END), ''), repeat('1', 3 * u)))) > 0 AS noise FROM (SELECT *, string_split(k, '') AS c FROM k))
SELECT doc_id, regexp_replace(coalesce(string_agg(CASE WHEN s = '' THEN '' ELSE t END, chr(10) ORDER BY i) FILTER (WHERE s = '' OR NOT noise), ''), '{STRIP}', '', 'g') AS text FROM n GROUP BY doc_id""")(
    lambda spark, d: spread(docs(spark, d)).select("doc_id", T.drop_noise_lines(t()).alias("text")))
per_document("char_count", lambda: {"chars": T.char_count(t())}, {"chars": r"length(regexp_replace(text, '[^A-Za-z0-9\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]+', '', 'g'))::INTEGER"})
per_document("norm_dedup_key", lambda: {"key": T.dedup_key(t())}, {"key": r"regexp_replace(text, '[^\p{L}\p{N}_\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]+', '', 'g')"})
per_document("proof_norm", lambda: {"norm": T.without_space(t())}, {"norm": rf"regexp_replace(text, '{WS}+', '', 'g')"})
per_document("normalise_title", lambda: {"title": T.normalise_title(F.concat(F.lit("# 1. "), t()))}, {
    "title": rf"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace('# 1. ' || text, '{WS}+', ' ', 'g')), '^#+', '')), '^[-*.\s、\p{{Nd}}]+', ''))"})
_SLUG = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\/:*?"<>|\r\n\t]+', '', 'g'), '{STRIP}', '', 'g'), '{WS}+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g')"""
per_document("slug", lambda: {"slug": T.slug(t())}, {"slug": f"(CASE WHEN {_SLUG} = '' THEN 'book' ELSE {_SLUG} END)[1:60]"})
_ENDINGS = (".r1200.jpg", "_crop.png", ".jpg", ".tmp.x", ".r12.png", ".crop.jpg")
per_document("image_marker", lambda: {"marker": T.image_marker(F.concat(F.lit("/a/"), F.regexp_replace(t(), "/", ""), F.lit(".jpg"))), "skipped": T.is_skipped_asset(F.concat(F.regexp_replace(T.lines(t())[0], "[._]", ""), F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 6 + 1).cast("int"))))}, {
    "marker": rf"""'![插图](images/' || regexp_replace(regexp_replace(replace(text, '/', '') || '.jpg', '[\x00-\x1f/\\:*?"<>|\s\p{{Z}}]+', '-', 'g'), '^[. -]+|[. -]+$', '', 'g') || ')'""", "skipped": "doc_id % 6 IN (0, 1, 3, 5)"})
per_document("notes_to_paragraphs", lambda: {"text": T.notes_to_paragraphs(F.regexp_replace(t(), "\nThe", "\n①The"))}, {"text": r"regexp_replace(regexp_replace(text, '\nThe', chr(10) || '①The', 'g'), '\n(\s*[\x{2460}-\x{2473}])', chr(10) || chr(10) || '\1', 'g')"})
_noted = lambda: F.regexp_replace(t(), " the ", " [[NOTE_REF:7|③]] ")
_NOTED = "replace(text, ' the ', ' [[NOTE_REF:7|③]] ')"
per_document("note_refs_as_text", lambda: {"text": T.note_refs_as_text(_noted()), "refs": F.size(T.note_refs(_noted()))}, {
    "text": rf"regexp_replace({_NOTED}, '\[\[NOTE_REF:([0-9]+)\|(.+?)\]\]', '\2', 'g')", "refs": rf"len(regexp_extract_all({_NOTED}, '\[\[NOTE_REF:([0-9]+)\|(.+?)\]\]'))::INTEGER"})
per_document("protect_note_refs", lambda: {"text": T.protect_notes(_noted())}, {"text": rf"regexp_replace({_NOTED}, '\[\[NOTE_REF:([0-9]+)\|(.+?)\]\]', chr(57344) || '\1' || chr(57345), 'g')"})
per_document("batch_normalise", lambda: {"text": T.normalise(t())}, {"text": r"regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')"})


@query("batch_clean_by_rules")
def _by_rules(spark, d):
    return T.clean_by_rules(spread(docs(spark, d)).select("doc_id", "text"))


_LINES = "string_split(text, chr(10))"
per_document("broken_line_filter", lambda: {"text": T.drop_broken_lines(t())}, {
    "text": rf"array_to_string(list_filter({_LINES}, lambda x: NOT (length(regexp_replace(x, '{STRIP}', '', 'g')) BETWEEN 1 AND 30 AND regexp_matches(regexp_replace(x, '{STRIP}', '', 'g'), '[·、，：；/\\—–－]\s*$'))), chr(10))"})
per_document("batch_broken_lines", lambda: {"text": T.drop_short_broken_lines(t())}, {
    "text": rf"array_to_string(list_filter({_LINES}, lambda x: NOT (length(regexp_replace(x, '{STRIP}', '', 'g')) > 0 AND ((length(regexp_replace(x, '{STRIP}', '', 'g')) <= 30 AND regexp_matches(regexp_replace(x, '{STRIP}', '', 'g'), '[·、，：；/\\—–－]\s*$')) OR regexp_matches(regexp_replace(x, '{STRIP}', '', 'g'), '^[的和与或了着吗呢而]$')))), chr(10))"})

# --- predicates (F) --------------------------------------------------------------------------------------------------
_SUSPECT = lambda: F.when(F.col("doc_id") % 5 == 0, F.concat(F.left(t(), F.lit(30)), F.repeat(F.right(t(), F.lit(1)), F.lit(16)))).when(F.col("doc_id") % 7 == 0, F.concat(F.left(t(), F.col("doc_id").cast("int") % 200), F.lit("…......"))).otherwise(t())
query("suspicious_text", rf"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text[1:30] || repeat(right(text, 1), 16) WHEN doc_id % 7 = 0 THEN left(text, doc_id % 200) || '…......' ELSE text END AS x FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
s AS (SELECT doc_id, regexp_replace(x, '{STRIP}', '', 'g') AS s FROM x), n AS (SELECT *, {_COUNT.format('s')} AS few FROM s)
SELECT doc_id, s IN ('', '{T.NO_TEXT}') OR regexp_full_match(s, '(?:[.。·•…—\-_=~]|{WS})+') OR (regexp_matches(s, '[.。·•…]{{6,}}') AND few < greatest(80, length(s) // 2))
 OR (few < 60 AND len(list_filter(range(1, CASE WHEN few < 60 THEN length(s) - 14 ELSE 1 END), lambda k: s[k] <> chr(10) AND s[k:k + 15] = repeat(s[k], 16))) > 0) AS suspicious FROM n""")(
    lambda spark, d: docs(spark, d).select("doc_id", T.is_suspicious(_SUSPECT()).alias("suspicious")))
per_document("page_ends_cleanly", lambda: {"clean": T.ends_cleanly(t(), "\n")}, {
    "clean": rf"coalesce(regexp_matches(list_extract(list_filter(list_transform({_LINES}, lambda x: regexp_replace(x, '{STRIP}', '', 'g')), lambda x: x <> ''), -1), '[。！？；：”』」》…!?;:）)]$|^!\[(.*?)\]\((.*?)\)$'), true)"})
per_document("blank_pages", lambda: {"blank": T.is_blank_page(t())}, {"blank": rf"length(regexp_replace(text, '{STRIP}', '', 'g')) < 50"})
query("numeric_chapter_line", f"SELECT doc_id, (count(*) FILTER (WHERE {NUMERIC_SQL.format('l')}))::BIGINT AS headings FROM (SELECT doc_id, '12. ' || unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) GROUP BY doc_id")(
    lambda spark, d: docs(spark, d).select("doc_id", F.size(F.filter(F.transform(T.lines(t()), lambda x: F.concat(F.lit("12. "), x)), T.is_numeric_chapter)).cast("long").alias("headings")))
per_document("lenient_parsers", lambda: {"flag": T.parse_bool(F.element_at(F.array(*map(F.lit, ("1", "Yes", "off", "maybe", " true "))), (F.col("doc_id") % 5 + 1).cast("int"))), "page": T.page_value(F.left(F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, ("", "x"))), (F.col("doc_id") % 2 + 1).cast("int"))), F.lit(8))), "span": T.page_span(F.col("doc_id") % 7, F.col("doc_id") % 5).cast("string")}, {
    "flag": "doc_id % 5 IN (0, 1, 4)", "page": "CASE WHEN doc_id % 2 = 0 AND doc_id > 0 THEN doc_id::INTEGER END", "span": "CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 THEN '{' || least(doc_id % 7, doc_id % 5) || ', ' || greatest(doc_id % 7, doc_id % 5) || '}' END"})
_fixed = lambda: F.regexp_replace(t(), "the ", "")
per_document("length_guard", lambda: {"verdict": T.length_guard(t(), _fixed())}, {
    "verdict": rf"CASE WHEN length(regexp_replace(replace(text, 'the ', ''), '{WS}+', '', 'g')) = 0 THEN 'empty' WHEN length(regexp_replace(text, '{WS}+', '', 'g')) = 0 THEN 'ok' WHEN length(regexp_replace(replace(text, 'the ', ''), '{WS}+', '', 'g')) < 0.95::DOUBLE * length(regexp_replace(text, '{WS}+', '', 'g')) THEN 'short' WHEN length(regexp_replace(replace(text, 'the ', ''), '{WS}+', '', 'g')) > 1.05::DOUBLE * length(regexp_replace(text, '{WS}+', '', 'g')) THEN 'long' ELSE 'ok' END"})


@query("chapter_line_flags", f"SELECT doc_id, count(*) FILTER (WHERE {chapter_sql('l')})::BIGINT AS headings, count(*)::BIGINT AS lines FROM (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '{STRIP}', '', 'g') AS l FROM documents) GROUP BY doc_id")
def _chapter_lines(spark, d):
    own = F.transform(T.lines(t()), T.strip)
    return docs(spark, d).select("doc_id", F.size(F.filter(own, T.is_chapter_line)).cast("long").alias("headings"), F.size(own).cast("long").alias("lines"))


@query("repeater_pages", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT median(length(t)) AS m FROM d),
x AS (SELECT doc_id, t, m, list_filter(list_transform(string_split(t, chr(10)), lambda y: regexp_replace(y, '{STRIP}', '', 'g')), lambda y: y <> '') AS l, regexp_replace(t, '[^\p{{L}}\p{{N}}_\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]+', '', 'g') AS k FROM d, m)
SELECT doc_id, CASE WHEN m <= 0 OR length(t) <= greatest(m * 2, 1200) THEN 'length_ok' WHEN len(l) >= 4 AND len(list_distinct(l)) < 0.6::DOUBLE * len(l) THEN 'line_repeat'
 WHEN k <> '' AND len(list_distinct(string_split(k, ''))) < 0.06::DOUBLE * length(k) THEN 'char_repeat' ELSE 'length_warn' END AS verdict FROM x""")
def _repeaters(spark, d):
    own = docs(spark, d)
    median = own.agg(F.median(F.length("text")).alias("m"))  # one row
    return own.join(F.broadcast(median)).select("doc_id", T.repeater(t(), F.col("m")).alias("verdict"))


@query("change_classify", r"""WITH x AS (SELECT l_orderkey, l_linenumber, [ '', ' ', '巳', ',', 'ab', 'long wording' ][(l_orderkey % 6 + 1)::INTEGER] AS o, ['', '已', '。', 'abc', 'other long words', ' '][(l_partkey % 6 + 1)::INTEGER] AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN o = n THEN '无变化' WHEN trim(o) = '' AND trim(n) = '' THEN '空白' WHEN trim(o) = '' THEN '增补' WHEN trim(n) = '' THEN '删除'
 WHEN regexp_matches(o, '^[^\p{L}\p{N}]+$') AND regexp_matches(n, '^[^\p{L}\p{N}]+$') THEN '标点' WHEN regexp_matches(o, '^[\x{3400}-\x{9fff}]{1,3}$') AND regexp_matches(n, '^[\x{3400}-\x{9fff}]{1,3}$') THEN '错字'
 WHEN length(o) > 6 OR length(n) > 6 THEN '大段改写' ELSE '词句调整' END AS label,
 CASE WHEN o <> n AND NOT (trim(o) = '' AND trim(n) = '') AND (trim(o) = '' OR trim(n) = '' OR ((length(o) > 6 OR length(n) > 6) AND NOT (regexp_matches(o, '^[^\p{L}\p{N}]+$') AND regexp_matches(n, '^[^\p{L}\p{N}]+$')))) THEN 'warn' ELSE 'safe' END AS level FROM x""")
def _classify(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % 6 + 1).cast("int"))
    o, n = pick(("", " ", "巳", ",", "ab", "long wording"), "l_orderkey"), pick(("", "已", "。", "abc", "other long words", " "), "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.classify_change(o, n).alias("k")).select("l_orderkey", "l_linenumber", "k.label", "k.level")


# --- sources (S) -----------------------------------------------------------------------------------------------------
_html = "html"
for _a, _b in ((r"(?s)<\?xml.*?\?>", "''"), (r"(?is)<script[^>]*>.*?</script>", "''"), (r"(?is)<style[^>]*>.*?</style>", "''"), *[(rf"(?is)<h{i}[^>]*>\s*(.*?)\s*</h{i}>", r"chr(10) || chr(10) || '## \1' || chr(10) || chr(10)") for i in range(1, 7)], (r"(?i)<br\s*/?>", "chr(10)"), ("(?i)</p>|</div>|</h[1-6]>", "chr(10) || chr(10)"), ("<[^>]+>", "''")):
    _html = f"regexp_replace({_html}, '{_a}', {_b}, 'g')"
for _a, _b in T.ENTITIES:
    _html = f"replace({_html}, '&{_a};', '{_b.replace(chr(39), chr(39) * 2)}')"


@query("html_to_md", rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_html}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '{STRIP}', '', 'g') AS text FROM pages")
def _html_to_md(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("text"))


@query("stub_source", "SELECT page_id, '[stub] ' || url AS text FROM pages")
def _stub(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("[stub] "), "url").alias("text"))


@query("recognised_pages", "SELECT 'web' AS book_id, page_id::INTEGER AS page_no, url AS text, 'ok' AS status FROM pages WHERE length(trim(url)) > 0")
def _recognised(spark, d):
    images = table(spark, d, "pages").select(F.lit("web").alias("book_id"), F.col("page_id").cast("int").alias("page_no"), F.encode("url", "utf-8").alias("image"))
    return sources.recognised(images)


@query("source_precedence", """WITH c AS (SELECT (o_custkey % 50)::VARCHAR AS book_id, ['tagged', 'flat', 'epub'][(o_orderkey % 3 + 1)::INTEGER] AS kind, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority || o_orderkey END AS text FROM orders),
f AS (SELECT book_id, kind, max(text) AS text FROM c GROUP BY ALL) SELECT book_id, kind, text FROM f WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY list_position(['tagged', 'flat', 'epub'], kind)) = 1""")
def _precedence(spark, d):
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("tagged", "flat", "epub"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    c = o.select((F.col("o_custkey") % 50).cast("string").alias("book_id"), kind.alias("kind"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("text"))
    return sources.preferred(c.groupBy("book_id", "kind").agg(F.max("text").alias("text")))


@query("largest_file", "SELECT book_id, arg_max(path, struct_pack(s := size, p := path)) AS path FROM (SELECT (l_orderkey % 97)::VARCHAR AS book_id, l_orderkey || '-' || l_linenumber AS path, l_quantity AS size FROM lineitem) GROUP BY book_id")
def _largest(spark, d):
    return sources.largest(table(spark, d, "lineitem").select((F.col("l_orderkey") % 97).cast("string").alias("book_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_quantity").alias("size")))


@query("tolerant_json", "SELECT event_id, json_extract_string(CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END, '$.page') AS page, event_id % 10 = 0 AS broken FROM events")
def _json(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{oops "), "props")).otherwise(F.col("props"))
    parsed = F.from_json(raw, "page string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return table(spark, d, "events").select("event_id", parsed.alias("j")).select("event_id", "j.page", F.col("j.broken").isNotNull().alias("broken"))


_OUTLINE = "o AS (SELECT (o_custkey % 200)::VARCHAR AS book_id, o_orderkey AS ord, (1 + o_orderkey % 2)::INTEGER AS level, '# ' || o_orderpriority AS title, (1 + o_orderkey % 97)::INTEGER AS page FROM orders)"


def outline(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 200).cast("string").alias("book_id"), F.col("o_orderkey").alias("ord"), (1 + F.col("o_orderkey") % 2).cast("int").alias("level"), F.concat(F.lit("# "), "o_orderpriority").alias("title"), (1 + F.col("o_orderkey") % 97).cast("int").alias("page"))


@query("outline_chapters", rf"""WITH {_OUTLINE}, l AS (SELECT book_id, min(level) AS cl FROM o GROUP BY 1),
s AS (SELECT book_id, trim(regexp_replace(trim(regexp_replace(trim(title), '^#+', '')), '^[-*.\s、0-9]+', '')) AS title, page, min(ord) AS ord FROM o JOIN l USING (book_id) WHERE level = cl AND page BETWEEN 1 AND 90 GROUP BY ALL),
e AS (SELECT *, least(90, coalesce(lead(page) OVER (PARTITION BY book_id ORDER BY page, ord), 91) - 1) AS e FROM s WHERE title <> '')
SELECT book_id, title, greatest(5, page)::INTEGER AS start_page, least(80, e)::INTEGER AS end_page FROM e WHERE e >= 5 AND page <= 80""")
def _outline(spark, d):
    o = outline(spark, d)
    return books.outline_chapters(o, o.select("book_id").distinct().withColumn("total", F.lit(90)), 5, 80)


@query("lead_end_page", f"WITH {_OUTLINE}, s AS (SELECT book_id, page, min(ord) AS ord FROM o GROUP BY ALL) SELECT book_id, ord, page AS start_page, (lead(page) OVER (PARTITION BY book_id ORDER BY page) - 1)::INTEGER AS end_page FROM s")
def _lead(spark, d):
    s = outline(spark, d).groupBy("book_id", "page").agg(F.min("ord").alias("ord"))
    return s.select("book_id", "ord", F.col("page").alias("start_page"), (F.lead("page").over(Window.partitionBy("book_id").orderBy("page")) - 1).cast("int").alias("end_page"))


@query("running_max_accept", f"WITH {_OUTLINE}, b AS (SELECT *, max(page) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o), k AS (SELECT * FROM b WHERE page > coalesce(m, 0)) SELECT book_id, ord, page AS actual, (lead(page) OVER (PARTITION BY book_id ORDER BY ord) - 1)::INTEGER AS end_page FROM k")
def _rising(spark, d):
    return books.accept_rising(outline(spark, d).select("book_id", "ord", F.col("page").alias("actual"))).select("book_id", "ord", "actual", F.col("end_page").cast("int").alias("end_page"))


_BODY = "body AS (SELECT DISTINCT (o_custkey % 200)::VARCHAR AS book_id, (10 + 3 * (o_orderkey % 40))::INTEGER AS page_no FROM orders)"


def body_pages(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 200).cast("string").alias("book_id"), (10 + 3 * (F.col("o_orderkey") % 40)).cast("int").alias("page_no")).distinct()


@query("asof_next_page", f"""WITH {_OUTLINE}, {_BODY}, e AS (SELECT book_id, min(page_no) AS lo, max(page_no) AS hi FROM body GROUP BY 1)
SELECT o.book_id, o.ord, o.page AS printed, CASE WHEN x.page_no IS NOT NULL THEN o.page WHEN lo + o.page - 1 BETWEEN lo AND hi THEN (SELECT min(page_no) FROM body b WHERE b.book_id = o.book_id AND b.page_no >= lo + o.page - 1) END AS actual
FROM o LEFT JOIN e USING (book_id) LEFT JOIN body x ON x.book_id = o.book_id AND x.page_no = o.page""")
def _asof(spark, d):
    return books.next_body_page(outline(spark, d).select("book_id", "ord", F.col("page").alias("printed")), body_pages(spark, d))


_SPANS = "c AS (SELECT book_id, ord, page AS s, page + 4 AS e FROM (SELECT book_id, page, min(ord) AS ord FROM o WHERE level = 1 GROUP BY ALL))"


@query("interval_chapters", f"""WITH {_OUTLINE}, {_BODY}, {_SPANS}, h AS (SELECT b.book_id, b.page_no, arg_min(c.ord, c.s) AS chapter FROM body b LEFT JOIN c ON c.book_id = b.book_id AND b.page_no BETWEEN s AND e GROUP BY ALL),
n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(chapter) OVER w IS DISTINCT FROM chapter THEN 1 ELSE 0 END AS n FROM h WINDOW w AS (PARTITION BY book_id ORDER BY page_no))
SELECT book_id, page_no, chapter, (sum(n) OVER (PARTITION BY book_id ORDER BY page_no))::BIGINT AS run FROM n""")
def _intervals(spark, d):
    c = outline(spark, d).filter("level = 1").groupBy("book_id", "page").agg(F.min("ord").alias("ord")).select("book_id", "ord", F.col("page").alias("start_page"), (F.col("page") + 4).alias("end_page"))
    return books.pages_in_chapters(body_pages(spark, d), c)


@query("trim_chapters_to_body", f"WITH {_OUTLINE}, {_BODY}, e AS (SELECT book_id, min(page_no) AS lo, max(page_no) AS hi FROM body GROUP BY 1) SELECT book_id, ord, title, greatest(lo, page)::INTEGER AS start_page, least(hi, page + 9)::INTEGER AS end_page FROM o JOIN e USING (book_id) WHERE least(hi, page + 9) >= greatest(lo, page)")
def _trim(spark, d):
    e = body_pages(spark, d).groupBy("book_id").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    x = outline(spark, d).join(e, "book_id").select("book_id", "ord", "title", F.greatest("lo", "page").alias("start_page"), F.least(F.col("hi"), F.col("page") + 9).alias("end_page"))
    return x.filter("end_page >= start_page")


# --- pages of books (G1, J, P3, P17, W, L, F5, F6) -------------------------------------------------------------------
_RUNNING = rf"""l AS (SELECT book_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{STRIP}', '', 'g')), lambda x: x <> '') AS l FROM p),
e AS (SELECT book_id, 'head' AS e, l[1] AS line FROM l UNION ALL SELECT book_id, 'foot', l[-1] FROM l),
k AS (SELECT book_id, e, line, count(*) AS c FROM e WHERE length(line) BETWEEN 1 AND 60 GROUP BY ALL),
junk AS (SELECT DISTINCT book_id, line FROM k JOIN (SELECT book_id, count(*) AS n FROM p GROUP BY 1) USING (book_id) WHERE c >= 0.02::DOUBLE * n AND c >= 2)"""


@query("running_lines", f"WITH {PAGES_SQL}, {_RUNNING} SELECT book_id, line FROM junk")
def _running(spark, d):
    return books.running_lines(pages(spark, d), 0.02, min_count=2)


_STRIPPED = rf"s AS (SELECT book_id, page_no, (SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i) WHERE NOT EXISTS (SELECT 1 FROM junk WHERE junk.book_id = p.book_id AND junk.line = regexp_replace(x, '{STRIP}', '', 'g'))) AS text FROM p)"


@query("strip_running_lines", f"WITH {PAGES_SQL}, {_RUNNING}, {_STRIPPED} SELECT book_id, page_no, coalesce(text, '') AS text FROM s")
def _strip_running(spark, d):
    p = pages(spark, d)
    return books.drop_running_lines(p, books.running_lines(p, 0.02, min_count=2)).select("book_id", "page_no", "text")


def merged_sql(source: str) -> str:
    """Wrapped lines merged by gaps and islands: doc_id, text."""
    return rf"""ml AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, regexp_replace(unnest(string_split(text, chr(10))), '{STRIP}', '', 'g') AS l FROM {source}),
mf AS (SELECT *, l <> '' AND NOT regexp_matches(l, '^(?:[#>\-*|`]|\p{{Nd}})') AND NOT {chapter_sql('l')} AND NOT regexp_matches(l, '^!\[(.*?)\]\((.*?)\)$') AS plain, regexp_matches(l, '[。！？；：”』」》…!?;:.]$') AS ends FROM ml),
mg AS (SELECT *, CASE WHEN plain AND coalesce(lag(plain AND NOT ends) OVER w, false) THEN 0 ELSE 1 END AS n FROM mf WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
mi AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mg), mj AS (SELECT doc_id, g, string_agg(l, '' ORDER BY i) AS l FROM mi GROUP BY ALL),
merged AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY g) AS text FROM mj GROUP BY doc_id)"""


query("merge_wrapped", f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {merged_sql('d')} SELECT doc_id, text FROM merged")(lambda spark, d: docs(spark, d).select("doc_id", T.merge_wrapped(t()).alias("text")))


def pictured(spark, d):
    return pages(spark, d).withColumn("illustration", F.col("doc_id") % 11 == 0)


_JOINED = rf"""q AS (SELECT *, doc_id % 11 = 0 AS pic, regexp_replace(text, '{STRIP}', '', 'g') AS b FROM p), r AS (SELECT *, regexp_replace(string_split(b, chr(10))[1], '{STRIP}', '', 'g') AS f, lag(pic) OVER (PARTITION BY book_id ORDER BY page_no) AS pp FROM q WHERE b <> ''),
j AS (SELECT book_id, page_no, CASE WHEN pic OR coalesce(pp, false) OR {chapter_sql('f')} OR regexp_matches(f, '^!\[(.*?)\]\((.*?)\)$') THEN chr(10) || chr(10) ELSE chr(10) END || b AS part FROM r),
joined AS (SELECT book_id, regexp_replace(string_agg(part, '' ORDER BY page_no), '{STRIP}', '', 'g') AS body FROM j GROUP BY book_id)"""


@query("join_pages", f"WITH {PAGES_SQL}, {_JOINED} SELECT book_id, body FROM joined")
def _join(spark, d):
    return books.joined_pages(pictured(spark, d))


@query("page_position", f"WITH {PAGES_SQL} SELECT book_id, page_no, (row_number() OVER (PARTITION BY book_id ORDER BY page_no) - 1)::INTEGER AS pos, (count(*) OVER (PARTITION BY book_id))::BIGINT AS total FROM p WHERE doc_id % 11 <> 0 AND regexp_replace(text, '{STRIP}', '', 'g') <> ''")
def _position(spark, d):
    w = Window.partitionBy("book_id")
    return pictured(spark, d).filter(~F.col("illustration") & (T.strip(t()) != "")).select("book_id", "page_no", (F.row_number().over(w.orderBy("page_no")) - 1).alias("pos"), F.count("*").over(w).alias("total"))


def toc_sql(source: str) -> str:
    """Contents entries of `source` (id, text): toc (id, line, title, printed). Whether a line waits for its page follows from the line
    alone, unless only the line before makes an entry of it; a walk goes along stretches of such lines."""
    return rf"""tl AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS i, l FROM (SELECT id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(regexp_replace(unnest(string_split(text, chr(10))), '{WS}+', ' ', 'g')) AS l FROM {source} WHERE regexp_matches(text, '(?m)[0-9]\s*$')) WHERE l <> ''),
tm AS MATERIALIZED (SELECT *, m0 OR regexp_matches(pair, '{T.TOC_LINE}') AS m1, NOT m0 AND NOT regexp_matches(l, '(?i){T.TOC_TITLE}') AND length(l) <= 40 AND NOT regexp_matches(l, '[。！？；]$') AS short FROM (SELECT *, regexp_matches(l, '{T.TOC_LINE}') AS m0, coalesce(lag(l) OVER (PARTITION BY id ORDER BY i) || ' ', '') || l AS pair FROM tl)),
tr AS (SELECT id, i, short AS waits FROM tm WHERE i = 1 OR m0 OR NOT m1 UNION ALL SELECT tm.id, tm.i, short AND NOT tr.waits FROM tr JOIN tm ON tm.id = tr.id AND tm.i = tr.i + 1 AND NOT m0 AND m1),
tp AS (SELECT tm.*, coalesce(tr.waits, false) AS waits FROM tm LEFT JOIN tr ON tr.id = tm.id AND tr.i = tm.i - 1),
te AS (SELECT id, i, CASE WHEN waits THEN pair ELSE l END AS probe FROM tp WHERE m0 OR (waits AND m1)),
toc AS (SELECT * FROM (SELECT id, i AS line, trim(regexp_replace(trim(regexp_replace(trim(regexp_extract(probe, '{T.TOC_LINE}', 1)), '^#+', '')), '^[-*.\s、\p{{Nd}}]+', '')) AS title, regexp_extract(probe, '{T.TOC_LINE}', 2)::INTEGER AS printed FROM te) WHERE title <> '' AND printed > 0)"""


# Small books, ten documents each, some cut short or marked, and the books of contents.
_BOUND_SQL = f"""{PAGES_SQL}, bound AS (SELECT 'd' || doc_id // 10 AS book_id, (doc_id % 10 + 1)::INTEGER AS page_no, doc_id, CASE WHEN doc_id % 3 = 0 THEN text[1:30] WHEN doc_id % 7 = 1 THEN 'ISBN 978' || text ELSE text END AS text FROM p)"""


def bound(spark, d):
    short = F.when(F.col("doc_id") % 3 == 0, F.left(t(), F.lit(30))).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("ISBN 978"), t())).otherwise(t())
    own = docs(spark, d).select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 10).cast("string")).alias("book_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("page_no"), (F.col("doc_id") % 11 == 0).alias("illustration"), short.alias("text"))
    return own.unionByName(contents(spark, d).withColumn("illustration", F.lit(False)))


# A book of contents: four hundred orders are its entries, dealt over four contents pages; its body has pages 5 to 204.
_CONTENTS_SQL = """e AS (SELECT (o_orderkey // 400)::VARCHAR AS book_id, (1 + o_orderkey % 400 // 100)::INTEGER AS page_no, o_orderkey, '第' || (o_orderkey % 90 + 1) || '章' || CASE WHEN o_orderkey % 4 = 3 THEN chr(10) ELSE ' ' END || o_orderpriority || [' …… ', ' · · ', ' ', '  '][(o_orderkey % 4 + 1)::INTEGER] || (1 + o_orderkey % 400 // 2 + o_custkey % 7) AS line FROM orders),
contents AS (SELECT book_id, page_no, '目录' || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey) AS text FROM e GROUP BY ALL)"""


def contents(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    line = F.concat(F.lit("第"), (key % 90 + 1).cast("string"), F.lit("章"), F.when(key % 4 == 3, "\n").otherwise(" "), "o_orderpriority", F.element_at(F.array(*map(F.lit, (" …… ", " · · ", " ", "  "))), (key % 4 + 1).cast("int")), (1 + F.floor(key % 400 / 2) + F.col("o_custkey") % 7).cast("string"))
    e = o.select(F.floor(key / 400).cast("string").alias("book_id"), (1 + F.floor(key % 400 / 100)).cast("int").alias("page_no"), F.struct("o_orderkey", line.alias("line")).alias("e"))
    own = F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"])
    return e.groupBy("book_id", "page_no").agg(F.concat(F.lit("目录\n"), F.array_join(own, "\n")).alias("text"))


_KINDS = rf"""{_BOUND_SQL}, {_CONTENTS_SQL}, pg AS (SELECT book_id, page_no, doc_id % 11 = 0 AS pic, text FROM bound UNION ALL SELECT book_id, page_no, false, text FROM contents),
tx AS (SELECT book_id || ' ' || page_no AS id, text FROM pg WHERE NOT pic), {toc_sql("tx")}, th AS (SELECT id, count(*) AS n FROM toc GROUP BY id),
c AS (SELECT book_id, page_no, coalesce(n, 0) AS toc, regexp_replace(text, '{STRIP}', '', 'g') AS t FROM pg LEFT JOIN th ON id = book_id || ' ' || page_no WHERE NOT pic AND regexp_replace(text, '{STRIP}', '', 'g') <> ''),
o AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{STRIP}', '', 'g')), lambda x: x <> '') AS l, {_COUNT.format('t')} AS n, row_number() OVER (PARTITION BY book_id ORDER BY page_no) - 1 AS pos, count(*) OVER (PARTITION BY book_id) AS total FROM c),
kinds AS (SELECT book_id, page_no, CASE WHEN regexp_matches(l[1], '(?i){T.TOC_HEADING}') OR toc >= 4 THEN 'toc' WHEN regexp_matches(t, '{T.COPYRIGHT_WORDS}') THEN 'copyright' WHEN pos = 0 AND page_no <= 2 AND n <= 60 THEN 'cover' WHEN pos = total - 1 AND n <= 60 THEN 'back_cover'
  WHEN pos < 6 AND page_no <= 8 AND n <= 120 AND len(l) <= 6 AND len(list_filter(l, lambda x: length(x) > 8 AND regexp_matches(x, '[。！？；]$'))) = 0 AND len(list_filter(l[1:3], lambda x: {chapter_sql('x')})) = 0 THEN 'title_page' END AS kind FROM o)"""


@query("classify_pages", f"WITH RECURSIVE {_KINDS} SELECT book_id, page_no, kind FROM kinds")
def _kinds(spark, d):
    return books.classify_pages(books.toc_hits(bound(spark, d)))


@query("page_kind_summary", f"WITH RECURSIVE {_KINDS} SELECT book_id, kind, min(page_no) AS first, max(page_no) AS last, count(DISTINCT page_no)::BIGINT AS pages FROM kinds WHERE kind IS NOT NULL GROUP BY ALL")
def _kind_summary(spark, d):
    return books.kind_summary(books.classify_pages(books.toc_hits(bound(spark, d))))


@query("toc_entries", f"WITH RECURSIVE {PAGES_SQL}, {_CONTENTS_SQL}, tx AS (SELECT book_id || ' ' || page_no AS id, text FROM (SELECT book_id, page_no, text FROM p UNION ALL SELECT book_id, page_no, text FROM contents)), {toc_sql('tx')} SELECT string_split(id, ' ')[1] AS book_id, string_split(id, ' ')[2]::INTEGER AS page_no, (row_number() OVER (PARTITION BY id ORDER BY line) - 1)::INTEGER AS ord, title, printed FROM toc")
def _toc(spark, d):
    both = pages(spark, d).select("book_id", "page_no", "text").union(contents(spark, d))
    return both.select("book_id", "page_no", F.posexplode(T.toc_entries(t())).alias("ord", "e")).select("book_id", "page_no", "ord", "e.title", "e.printed")


@query("contents_chapters", f"""WITH RECURSIVE {_CONTENTS_SQL}, tx AS (SELECT book_id AS id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM contents GROUP BY 1), {toc_sql('tx')},
x AS (SELECT id, title, line, CASE WHEN printed BETWEEN 5 AND 204 THEN CASE WHEN printed % 3 > 0 THEN printed ELSE (SELECT min(b) FROM (SELECT unnest(range(5, 205)) AS b) WHERE b % 3 > 0 AND b >= 5 + printed - 1) END WHEN 5 + printed - 1 BETWEEN 5 AND 203 THEN (SELECT min(b) FROM (SELECT unnest(range(5, 205)) AS b) WHERE b % 3 > 0 AND b >= 5 + printed - 1) END AS actual FROM toc),
y AS (SELECT *, max(actual) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x WHERE actual IS NOT NULL),
z AS (SELECT id, line, title, actual FROM y WHERE actual > coalesce(before, 0))
SELECT id AS book_id, title, actual::INTEGER AS start_page, coalesce(lead(actual) OVER (PARTITION BY id ORDER BY line) - 1, 203)::INTEGER AS end_page FROM z""")
def _contents_chapters(spark, d):
    c = contents(spark, d)
    body = c.select("book_id").distinct().select("book_id", F.explode(F.sequence(F.lit(5), F.lit(204))).alias("page_no")).filter("page_no % 3 > 0")
    return books.contents_spans(c, body).select("book_id", "title", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"))


_TITLED = rf"hl AS (SELECT book_id, generate_subscripts(string_split(body, chr(10)), 1) AS i, unnest(string_split(body, chr(10))) AS l FROM b), hs AS (SELECT *, regexp_replace(l, '{STRIP}', '', 'g') AS s FROM hl), hf AS (SELECT *, s <> '' AND {chapter_sql('s')} AS h FROM hs), hg AS (SELECT *, sum(h::INTEGER) OVER (PARTITION BY book_id ORDER BY i) AS g FROM hf)"


@query("split_chapters", rf"""WITH {PAGES_SQL}, b AS (SELECT book_id, string_agg(CASE WHEN page_no % 5 = 0 THEN 'Chapter ' || page_no || chr(10) || text ELSE text END, chr(10) ORDER BY page_no) AS body FROM p GROUP BY 1), {_TITLED},
c AS (SELECT book_id, g, coalesce(max(CASE WHEN h THEN s END), '正文') AS title, regexp_replace(coalesce(string_agg(CASE WHEN h THEN NULL ELSE l END, chr(10) ORDER BY i), ''), '{STRIP}', '', 'g') AS body FROM hg GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY book_id) = 1 AND length(body) > 30000 AS long FROM c WHERE body <> ''),
u AS (SELECT book_id, g, title, body, 0 AS k FROM w WHERE NOT long UNION ALL SELECT book_id, g, '第 ' || (k + 1) || ' 部分', body[k * 12000 + 1:(k + 1) * 12000], k FROM (SELECT *, unnest(range(0, (length(body) + 11999) // 12000)) AS k FROM w WHERE long))
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY g, k) - 1)::INTEGER AS ord, title, body FROM u""")
def _split(spark, d):
    headed = pages(spark, d).withColumn("text", F.when(F.col("page_no") % 5 == 0, F.concat(F.lit("Chapter "), F.col("page_no").cast("string"), F.lit("\n"), "text")).otherwise(t()))
    own = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return books.chapters_by_heading(headed.groupBy("book_id").agg(F.array_join(own, "\n").alias("body")))


@query("fixed_page_chunks", rf"""WITH RECURSIVE {PAGES_SQL}, q AS (SELECT book_id, page_no, regexp_replace(text, '{STRIP}', '', 'g') AS t FROM p WHERE regexp_replace(text, '{STRIP}', '', 'g') <> ''),
l AS (SELECT *, regexp_replace(string_split(t, chr(10))[1], '{STRIP}', '', 'g') AS h, regexp_replace(string_split_regex(t, '\n\s*\n')[-1], '{STRIP}', '', 'g') AS e, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS k FROM q),
f AS (SELECT book_id, page_no, k, {chapter_sql('h')} AS heading, regexp_matches(e, '[。！？；：”』」》…!?;:）)]$|^!\[(.*?)\]\((.*?)\)$') AS clean FROM l),
r AS (SELECT book_id, k, page_no, 1 AS chapter, 1 AS n, clean FROM f WHERE k = 1 UNION ALL SELECT f.book_id, f.k, f.page_no, CASE WHEN r.n >= 20 AND (heading OR r.clean OR r.n >= 26) THEN chapter + 1 ELSE chapter END, CASE WHEN r.n >= 20 AND (heading OR r.clean OR r.n >= 26) THEN 1 ELSE r.n + 1 END, f.clean FROM r JOIN f ON f.book_id = r.book_id AND f.k = r.k + 1)
SELECT book_id, chapter::INTEGER AS chapter, min(page_no) AS first, max(page_no) AS last FROM r GROUP BY ALL""")
def _page_chunks(spark, d):
    return books.page_chunks(pages(spark, d))


@query("duplicate_pages")
def _duplicate_pages(spark, d):
    return books.duplicate_pages(pages(spark, d))


@query("exact_dup_groups", r"SELECT key, count(*)::BIGINT AS pages, min(doc_id) AS first FROM (SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]+', '', 'g')) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def _groups(spark, d):
    return docs(spark, d).groupBy(F.md5(T.dedup_key(t())).alias("key")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first")).filter("pages > 1")


def on_lines(name: str, rule, ahead=lambda pages: pages) -> None:
    query(name)(lambda spark, d: flat_map(docs(spark, d).select("doc_id", "text"), lambda i, x: [(i, *rule(x))], "doc_id long, text string, gone int", ahead=lambda xs: ahead([(x or "").split("\n") for x in xs])))


on_lines("collapse_paragraphs", lambda ps: (lambda kept, gone: ("\n".join(kept), gone))(*folds.dedupe_plain(ps, 0.88)), folds.without_stutter)
on_lines("prefix_dedup", lambda ps: (lambda kept, trimmed, removed: ("\n".join(kept), trimmed + removed))(*folds.dedupe_prefixes(ps)))
on_lines("batch_paragraph_dedup", lambda ps: (lambda kept, gone: ("\n".join(kept), gone))(*folds.batch_dedupe(ps)))


@query("batch_header_removal")
def _headers(spark, d):
    return books.strip_headers(pages(spark, d))


@query("layout_part_dedup")
def _parts(spark, d):
    return flat_map(docs(spark, d).select("doc_id", "text"), lambda i, x: [(i, n, p[2]) for n, p in enumerate(folds.dedupe_layout([(y, 0, line) for y, line in enumerate((x or "").split("\n"))]))], "doc_id long, ord int, content string")


# --- notes (P12, P13, P14, J1, J2, J3, K7, W13) ----------------------------------------------------------------------
def noted(spark, d):
    marked = F.concat(F.regexp_replace(F.regexp_replace(t(), "\n", "\n\n"), r"^(\S+) ", "$1[1] "), F.lit("\n\n[1] a note"))
    return pages(spark, d).withColumn("text", marked)


@query("extract_footnotes")
def _footnotes(spark, d):
    return books.number_notes(books.extract_notes(noted(spark, d)))


_NOTES = "r AS (SELECT (l_orderkey % 50)::VARCHAR AS book_id, (l_orderkey % 9)::INTEGER AS ord, l_linenumber + l_orderkey % 13 AS note_id, min(l_orderkey) AS pos FROM lineitem GROUP BY ALL), n AS (SELECT DISTINCT (l_orderkey % 50)::VARCHAR AS book_id, l_linenumber + l_orderkey % 13 AS note_id, ((l_linenumber + l_orderkey % 13) % 5)::VARCHAR AS label, 'note ' || (l_linenumber + l_orderkey % 13) AS text FROM lineitem WHERE l_orderkey % 3 > 0)"


def notes_tables(spark, d):
    li = table(spark, d, "lineitem")
    note = F.col("l_linenumber") + F.col("l_orderkey") % 13
    refs = li.select((F.col("l_orderkey") % 50).cast("string").alias("book_id"), (F.col("l_orderkey") % 9).cast("int").alias("ord"), note.alias("note_id"), "l_orderkey").groupBy("book_id", "ord", "note_id").agg(F.min("l_orderkey").alias("at"))
    chapters = refs.groupBy("book_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note_id"))), lambda x: F.concat(F.lit("x [[NOTE_REF:"), x["note_id"].cast("string"), F.lit("|q]] "))), "").alias("body"))
    notes = li.filter("l_orderkey % 3 > 0").select((F.col("l_orderkey") % 50).cast("string").alias("book_id"), note.alias("note_id"), (note % 5).cast("string").alias("label"), F.concat(F.lit("note "), note.cast("string")).alias("text")).distinct()
    return chapters, notes


@query("chapter_notes", f"WITH {_NOTES} SELECT book_id, ord, note_id, label, text, (row_number() OVER (PARTITION BY book_id, ord ORDER BY pos, note_id))::INTEGER AS number FROM r JOIN n USING (book_id, note_id)")
def _chapter_notes(spark, d):
    return books.chapter_notes(*notes_tables(spark, d))


@query("notes_appendix", f"WITH {_NOTES} SELECT book_id, '# 注释' || chr(10) || chr(10) || string_agg(label || ' ' || text, chr(10) || chr(10) ORDER BY note_id) AS appendix FROM n GROUP BY book_id")
def _appendix(spark, d):
    return books.notes_appendix(notes_tables(spark, d)[1])


@query("relabel_note_refs", f"WITH {_NOTES}, k AS (SELECT book_id, ord, note_id, pos, coalesce(label, 'q') AS label FROM r LEFT JOIN n USING (book_id, note_id)) SELECT book_id, ord, string_agg('x [[NOTE_REF:' || note_id || '|' || label || ']] ', '' ORDER BY pos, note_id) AS body FROM k GROUP BY ALL")
def _relabel(spark, d):
    chapters, notes = notes_tables(spark, d)
    labels = notes.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("note_id").cast("string"), "label"))).alias("labels"))
    pieces = F.split("body", r"\[\[NOTE_REF:", -1)
    put = lambda x: F.concat(F.lit("[[NOTE_REF:"), F.substring_index(x, "|", 1), F.lit("|"), F.coalesce(F.try_element_at("labels", F.substring_index(x, "|", 1)), F.regexp_extract(x, r"\|(.+?)\]\]", 1)), F.lit("]]"), F.regexp_extract(x, r"(?s)\]\](.*)$", 1))
    return chapters.join(labels, "book_id", "left").select("book_id", "ord", F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), put), "")).alias("body"))


# --- boxes (S8, J6, F10, F11, O1) ------------------------------------------------------------------------------------
_BOXES = "b AS (SELECT l_orderkey AS page_id, l_linenumber AS box_id, ['text', 'figure', 'table', 'header', 'doc_title'][(l_partkey % 5 + 1)::INTEGER] AS label, (l_discount * 10)::DOUBLE AS score, (l_quantity * 4)::BIGINT AS x1, (l_suppkey % 60 * 5)::BIGINT AS y1, (l_quantity * 4)::BIGINT + 40 + l_partkey % 200 AS x2, (l_suppkey % 60 * 5)::BIGINT + 40 + l_partkey % 150 AS y2 FROM lineitem)"


def boxes(spark, d):
    x1, y1 = F.rint(F.col("l_quantity") * 4).cast("long"), (F.col("l_suppkey") % 60 * 5).cast("long")
    label = F.try_element_at(F.array(*map(F.lit, ("text", "figure", "table", "header", "doc_title"))), F.nullif((F.col("l_partkey") % 5 + 1).cast("int"), F.lit(0)))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("box_id"), label.alias("label"), (F.col("l_discount") * 10).alias("score"), x1.alias("x1"), y1.alias("y1"), (x1 + 40 + F.col("l_partkey") % 200).alias("x2"), (y1 + 40 + F.col("l_partkey") % 150).alias("y2"))


_KIND = "CASE WHEN {0} IN ('figure', 'chart', 'image', 'picture', 'img', 'photo', 'table', 'formula', 'equation') THEN 'visual' WHEN {0} IN ('header', 'footer', 'page_number', 'seal') THEN 'drop' ELSE 'text' END"


@query("box_kinds", f"WITH {_BOXES} SELECT page_id, box_id, {_KIND.format('label')} AS kind, CASE {_KIND.format('label')} WHEN 'visual' THEN 3 WHEN 'text' THEN 2 ELSE 1 END AS priority FROM b")
def _box_kinds(spark, d):
    return boxes(spark, d).select("page_id", "box_id", layout.kind(F.col("label")).alias("kind"), layout.priority(F.col("label")).alias("priority"))


@query("visual_box_filter", f"WITH {_BOXES} SELECT page_id, box_id FROM b WHERE {_KIND.format('label')} = 'visual' AND score >= CASE WHEN label IN ('figure', 'chart', 'image', 'picture', 'img', 'photo') THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END AND x2 - x1 >= 48 AND y2 - y1 >= 48 AND NOT ((x2 - x1) * (y2 - y1) < 0.008::DOUBLE * 1600 * 1200 AND greatest(x2 - x1, y2 - y1) < 180)")
def _visual(spark, d):
    c = F.col
    return boxes(spark, d).filter((layout.kind(c("label")) == "visual") & layout.keep_visual(c("label"), c("score"), c("x1"), c("y1"), c("x2"), c("y2"), F.lit(1600), F.lit(1200))).select("page_id", "box_id")


@query("box_iou_pairs", f"""WITH {_BOXES}, q AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b, a.label AS la, b.label AS lb, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS common, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM b a JOIN b ON a.page_id = b.page_id AND a.box_id < b.box_id)
SELECT page_id, a, b, round(common::DOUBLE / (aa + ab - common), 6) AS iou, round(common::DOUBLE / least(aa, ab), 6) AS cover FROM q WHERE common > 0 AND (({_KIND.format('la')}) = 'visual') = (({_KIND.format('lb')}) = 'visual') AND (common::DOUBLE / (aa + ab - common) >= 0.5 OR common::DOUBLE / least(aa, ab) >= 0.85)""")
def _iou(spark, d):
    return layout.overlaps(boxes(spark, d))


_OVERLAP = "(greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1)))::DOUBLE"


@query("box_suppression", f"""WITH RECURSIVE {_BOXES}, r AS (SELECT *, CASE {_KIND.format('label')} WHEN 'visual' THEN 3 WHEN 'text' THEN 2 ELSE 1 END AS pr, ((x2 - x1) * (y2 - y1))::DOUBLE AS area FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pr = 3 DESC, area DESC, box_id) AS k FROM r),
s AS (SELECT page_id, k, true AS stays, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, pr := pr, area := area)] AS kept FROM q WHERE k = 1 UNION ALL
 SELECT b.page_id, b.k, hits = 0, CASE WHEN hits = 0 THEN list_append(kept, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, pr := pr, area := area)) ELSE kept END
 FROM (SELECT b.*, s.kept, len(list_filter(s.kept, lambda o: (o.pr = 3) = (b.pr = 3) AND o.pr >= b.pr AND ((({_OVERLAP}) > 0 AND ({_OVERLAP}) / (o.area + b.area - ({_OVERLAP})) >= 0.5::DOUBLE) OR (b.area > 0 AND ({_OVERLAP}) / b.area >= 0.85::DOUBLE)))) AS hits FROM s JOIN q b ON b.page_id = s.page_id AND b.k = s.k + 1) b)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, k) - 1)::INTEGER AS place, label, score, x1, y1, x2, y2 FROM q JOIN s USING (page_id, k) WHERE stays""")
def _suppress(spark, d):
    box = F.struct("label", "score", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"))
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col("box_id").isNull().alias("last"), "box_id", box.alias("b")))), lambda x: x["b"])
    kept = layout.suppressed(boxes(spark, d).filter("page_id IS NOT NULL").groupBy("page_id").agg(own.alias("boxes")))  # as the SQL, whose join knows no null page
    return kept.select("page_id", F.posexplode("boxes").alias("place", "b")).select("page_id", "place", "b.label", "b.score", *[F.get("b.bbox", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("normalise_boxes", f"WITH {_BOXES} SELECT page_id, lower(label) AS label, score, [x1::DOUBLE, y1::DOUBLE, x2::DOUBLE, y2::DOUBLE] AS bbox FROM b WHERE page_id % 3 > 0")
def _normalise_boxes(spark, d):
    corners = F.when(F.col("page_id") % 3 > 0, F.array(*[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])).otherwise(F.array(F.lit("1"), F.lit("x")))
    raw = boxes(spark, d).select("page_id", F.struct(F.concat(F.lit(" "), F.upper("label")).alias("label"), F.col("score").cast("string").alias("score"), corners.alias("bbox")).alias("box"))
    return layout.normalised(raw)


@query("detected_boxes", f"WITH {_BOXES} SELECT page_id, lower(label) AS label, score, [x1::DOUBLE, y1::DOUBLE, x2::DOUBLE, y2::DOUBLE] AS bbox FROM b WHERE page_id % 10 > 0")
def _detected(spark, d):
    box = F.struct(F.upper("label").alias("label"), "score", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    answer = F.to_json(F.array_sort(F.collect_list(box)))
    images = boxes(spark, d).groupBy("page_id").agg(F.encode(F.when(F.col("page_id") % 10 == 0, "no boxes {").otherwise(answer), "utf-8").alias("image"))
    return layout.detected(images)


@query("layout_reading_order", f"WITH {_BOXES} SELECT page_id, string_agg(label || '-' || box_id, chr(10) || chr(10) ORDER BY y1, x1, label || '-' || box_id) AS text FROM b GROUP BY page_id")
def _reading(spark, d):
    return layout.reading_order(boxes(spark, d).withColumn("content", F.concat_ws("-", "label", F.col("box_id").cast("string"))))


@query("layout_parts", rf"""WITH {_BOXES}, g AS (SELECT l_suppkey AS page_id, l_orderkey * 8 + l_linenumber AS box_id, label, score, greatest(0, least(x1, 599)) AS x1, greatest(0, least(y1, 399)) AS y1, greatest(0, least(x2, 600)) AS x2, greatest(0, least(y2, 400)) AS y2 FROM b JOIN lineitem ON page_id = l_orderkey AND box_id = l_linenumber),
k AS (SELECT *, {_KIND.format('label')} AS kind FROM g WHERE x2 - x1 >= 16 AND y2 - y1 >= 16),
v AS (SELECT * FROM k WHERE kind = 'text' OR (kind = 'visual' AND score >= CASE WHEN label IN ('figure', 'chart', 'image', 'picture', 'img', 'photo') THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END AND x2 - x1 >= 48 AND y2 - y1 >= 48 AND NOT ((x2 - x1) * (y2 - y1) < 0.008::DOUBLE * 600 * 400 AND greatest(x2 - x1, y2 - y1) < 180)))
SELECT page_id, box_id, kind, x1::INTEGER AS x1, y1::INTEGER AS y1, x2::INTEGER AS x2, y2::INTEGER AS y2 FROM v QUALIFY kind = 'text' OR row_number() OVER (PARTITION BY page_id, kind ORDER BY y1, x1, box_id) <= 24""")
def _layout_parts(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("box_id"), F.col("l_suppkey").alias("s"))
    many = boxes(spark, d).join(own, ["page_id", "box_id"]).withColumn("box_id", F.col("page_id") * 8 + F.col("box_id")).withColumn("page_id", F.col("s")).drop("s")
    return layout.page_parts(many, 600, 400)


@query("full_page_picture", "SELECT l_orderkey, l_linenumber, l_discount * 10 <= 0.76::DOUBLE AND l_tax * 10 >= 0.08::DOUBLE AND l_quantity / 50 >= 0.72::DOUBLE AS full_page FROM lineitem")
def _full_page(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.is_full_page(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50).alias("full_page"))


# --- review, snapshots, statistics (G, W12, K8 to K10, J7, J12, O) ---------------------------------------------------
@query("todo_antijoin", f"WITH {PAGES_SQL} SELECT book_id, page_no, doc_id FROM p WHERE doc_id % 4 = 0 OR doc_id % 7 = 0")
def _todo(spark, d):
    p = pages(spark, d).select("book_id", "page_no", "doc_id")
    return review.todo(p, p.filter("doc_id % 4 > 0").select("book_id", "page_no", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ok").alias("status")))


@query("toc_pages_semijoin", f"WITH RECURSIVE {_CONTENTS_SQL}, tx AS (SELECT book_id || ' ' || page_no AS id, text FROM contents), {toc_sql('tx')} SELECT book_id, page_no FROM contents WHERE book_id || ' ' || page_no IN (SELECT id FROM toc WHERE printed > 150)")
def _semi(spark, d):
    c = contents(spark, d)
    late = c.select("book_id", "page_no", F.explode(T.toc_entries(t())).alias("e")).filter("e.printed > 150")
    return c.join(late, ["book_id", "page_no"], "left_semi").select("book_id", "page_no")


@query("body_pages_antijoin", f"WITH {PAGES_SQL} SELECT book_id, page_no FROM p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id)")
def _anti(spark, d):
    return pages(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("book_id", "page_no")


@query("change_summary", """WITH p AS (SELECT (l_orderkey % 20)::VARCHAR AS book_id, l_orderkey::VARCHAR AS i, l_linenumber AS n, ['巳', ',', 'ab', ''][(l_partkey % 4 + 1)::INTEGER] AS old, ['已', '。', 'long rewritten'][(l_suppkey % 3 + 1)::INTEGER] AS new FROM lineitem)
SELECT book_id, old, new, count(*)::BIGINT AS count, arg_min('c' || i || '.' || n, struct_pack(i := i::INTEGER, n := n)) AS ctx, count(DISTINCT i)::BIGINT AS chunks, CASE WHEN old = '' OR new = 'long rewritten' THEN 'warn' ELSE 'safe' END AS level FROM p GROUP BY ALL""")
def _changes(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).cast("string").alias("book_id"), F.col("l_orderkey").cast("string").alias("i"), F.col("l_linenumber").alias("n"), pick(("巳", ",", "ab", ""), "l_partkey").alias("old"), pick(("已", "。", "long rewritten"), "l_suppkey").alias("new"))
    return review.summarise(li.withColumn("ctx", F.concat(F.lit("c"), "i", F.lit("."), F.col("n").cast("string")))).select("book_id", "old", "new", "count", "ctx", "chunks", "level")


SENTENCES = ("。！？；!?;", "。！？；.!?;")


def chunk_sql(source: str, most: int, batch: bool = False) -> str:
    """Chunks of `source` (id, text): ch (id, i, total, chunk). Paragraphs, sentences and cuts are numbered pieces; a walk over them
    carries the length of the chunk at hand."""
    marks = SENTENCES[batch]
    own = rf"regexp_replace(p, '{STRIP}', '', 'g')" if batch else "p"
    if batch:
        parts = f"CASE WHEN length(s) > {most} THEN list_transform(regexp_extract_all(s, '[^，,、]*[，,、]|[^，,、]+'), lambda x, k: CASE WHEN k > 1 THEN regexp_replace(x, '^{WS}+', '') ELSE x END) ELSE [s] END"
    else:
        parts = f"list_transform(range(0, (length(s) + {most} - 1) // {most}), lambda k: s[(k * {most} + 1)::BIGINT:((k + 1) * {most})::BIGINT])"
    begins = "CASE WHEN c = 1 AND (j = 1 OR cut_before) AND (long OR long_before OR cut_before) THEN 1 ELSE 0 END" if batch else f"CASE WHEN (j = 1 AND c = 1 AND (long OR long_before)) OR length(s) > {most} THEN 1 ELSE 0 END"
    return rf"""cp AS (SELECT id, pi, {own} AS p FROM (SELECT id, generate_subscripts(string_split_regex(text, '\n{WS}*\n'), 1) AS pi, unnest(string_split_regex(text, '\n{WS}*\n')) AS p FROM {source}) WHERE regexp_replace(p, '{STRIP}', '', 'g') <> ''),
cl AS (SELECT *, length(p) > {most} AS long, coalesce(lag(length(p) > {most}) OVER (PARTITION BY id ORDER BY pi), false) AS long_before FROM cp),
cs AS (SELECT id, pi, long, long_before, generate_subscripts(l, 1) AS j, unnest(l) AS s FROM (SELECT *, CASE WHEN long THEN list_filter(list_transform(regexp_extract_all(p, '[^{marks}]*[{marks}]|[^{marks}]+'), lambda x, k: CASE WHEN k > 1 THEN regexp_replace(x, '^{WS}+', '') ELSE x END), lambda x: x <> '') ELSE [p] END AS l FROM cl)),
cb AS (SELECT *, coalesce(lag(length(s) > {most}) OVER (PARTITION BY id, pi ORDER BY j), false) AS cut_before FROM cs),
cc AS (SELECT * REPLACE (generate_subscripts(l, 1) AS l), unnest(l) AS t FROM (SELECT *, CASE WHEN long THEN list_filter({parts}, lambda x: x <> '') ELSE [s] END AS l FROM cb)),
cn AS (SELECT id, t, length(t) AS n, CASE WHEN long THEN '' ELSE chr(10) || chr(10) END AS joint, {begins} AS b, row_number() OVER (PARTITION BY id ORDER BY pi, j, c) AS k FROM (SELECT *, l AS c FROM cc)),
cr AS (SELECT id, k, 1 AS chunk, n AS held, true AS first FROM cn WHERE k = 1 UNION ALL SELECT id, k, CASE WHEN x THEN chunk + 1 ELSE chunk END, CASE WHEN x THEN n ELSE held + length(joint) + n END, x FROM (SELECT cn.id, cn.k, cr.chunk, cr.held, cn.n, cn.joint, cn.b = 1 OR cr.held + length(cn.joint) + cn.n > {most} AS x FROM cr JOIN cn ON cn.id = cr.id AND cn.k = cr.k + 1)),
cg AS (SELECT id, chunk AS g, {"regexp_replace(" if batch else ""}string_agg(CASE WHEN first THEN t ELSE joint || t END, '' ORDER BY k){f", '{STRIP}', '', 'g')" if batch else ""} AS chunk FROM cr JOIN cn USING (id, k) GROUP BY id, cr.chunk),
ch AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY g))::INTEGER AS i, (count(*) OVER (PARTITION BY id))::INTEGER AS total, chunk FROM cg WHERE regexp_replace(chunk, '{STRIP}', '', 'g') <> '')"""


_LINED = "tx AS (SELECT doc_id AS id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents)"
_RECORDS_SQL = rf"""tx AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {chunk_sql("tx", 700)},
rec AS (SELECT id::VARCHAR AS book_id, i::VARCHAR AS i, total, 'ok' AS status, '' AS reason, chunk AS orig, regexp_replace(replace(replace(chunk, 'teh', 'the'), '  ', ' '), '{STRIP}', '', 'g') AS fixed FROM ch)"""


def _records(spark, d):
    return review.proofread(docs(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), "text"), lambda: lambda x: x.replace("teh", "the").replace("  ", " "))


query("proofread_records", f"WITH RECURSIVE {_RECORDS_SQL} SELECT *, fixed <> orig AS changed FROM rec")(_records)
query("proofread_summary", f"WITH RECURSIVE {_RECORDS_SQL} SELECT book_id, count(*)::BIGINT AS blocks, count(*)::BIGINT AS ok, 0::BIGINT AS fallback, (count(*) FILTER (WHERE fixed <> orig))::BIGINT AS changed FROM rec GROUP BY book_id")(lambda spark, d: review.proof_summary(_records(spark, d)))
query("change_table")(lambda spark, d: review.changes(_records(spark, d)).drop("first"))
query("proofread_chunks", f"WITH RECURSIVE {_LINED}, {chunk_sql('tx', 700)} SELECT id::VARCHAR AS book_id, i, chunk FROM ch")(lambda spark, d: review.chunk_texts(docs(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))))
query("batch_smart_chunks", f"WITH RECURSIVE {_LINED}, {chunk_sql('tx', 800, True)} SELECT id::VARCHAR AS book_id, i, chunk FROM ch")(lambda spark, d: review.chunk_texts(docs(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), F.regexp_replace("text", "\n", "\n\n").alias("text")), folds.sentence_chunks, 800))
query("proofread_guard")(lambda spark, d: review.guarded(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("original"), F.regexp_replace("text", "of ", "").alias("fixed"))))
query("batch_output_guard")(lambda spark, d: flat_map(spread(docs(spark, d).select("doc_id", "text")), lambda i, x: [(i, n, *folds.batch_guard(c, c.replace("e", ""))) for n, c in enumerate(folds.sentence_chunks(x) or [""])], "doc_id long, chunk int, ok boolean, reason string"))
query("split_failed_chunk", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), e AS (SELECT doc_id, 1 AS o, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(x, '(?s).*?\n{WS}*\n+') AS l FROM d))
 UNION ALL SELECT doc_id, 2, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k) FROM (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(x, '[^。！？；!?;]*[。！？；!?;]{WS}*') AS l FROM d))),
m AS (SELECT doc_id, arg_min(e, struct_pack(a := abs(e - length(x) // 2), o := o, e := e)) AS middle FROM e JOIN d USING (doc_id) WHERE e < length(x) GROUP BY doc_id),
h AS (SELECT doc_id, x, coalesce(middle, length(x) // 2)::BIGINT AS middle FROM d LEFT JOIN m USING (doc_id)), k AS (SELECT *, length(x) >= 240 AND regexp_replace(x[1:middle], '{STRIP}', '', 'g') <> '' AND regexp_replace(x[middle + 1:], '{STRIP}', '', 'g') <> '' AS ok FROM h)
SELECT doc_id, CASE WHEN ok THEN x[1:middle] END AS left, CASE WHEN ok THEN x[middle + 1:] END AS right FROM k""")(lambda spark, d: flat_map(docs(spark, d).select("doc_id", "text"), lambda i, x: [(i, *(folds.halves(x) or (None, None)))], "doc_id long, left string, right string"))
query("html_diff")(lambda spark, d: flat_map(spread(docs(spark, d).select("doc_id", "text")), lambda i, x: [(i, n, *sinks.html_diff(c, c.replace("the", "teh"))) for n, c in enumerate(folds.chunks(x) or [""])], "doc_id long, chunk int, left string, right string"))
query("markdown_to_xhtml")(lambda spark, d: flat_map(docs(spark, d).select("doc_id", "text"), lambda i, x: [(i, folds.to_xhtml("# " + x))], "doc_id long, xhtml string"))


def epubs(spark, d):
    chapters = _QUERIES["split_chapters"](spark, d).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "body"))), lambda c: F.struct(c["title"].alias("title"), c["body"].alias("body"), F.array().cast("array<struct<note_id:int,label:string,text:string>>").alias("notes"))).alias("chapters"))
    return sinks.epubs(chapters.select("book_id", F.col("book_id").alias("title"), F.lit("").alias("author"), F.lit(False).alias("test"), "chapters"))


@query("epub_files")
def _epubs(spark, d):
    made = written(epubs(spark, d))
    return made.select("book_id", "name", F.length("content").alias("bytes")).join(sinks.epub_texts(made).select("book_id", F.length("text").alias("chars")), "book_id")


@query("review_reports")
def _reports(spark, d):
    records = written(review.proofread(pages(spark, d).select("book_id", "text"), lambda: lambda x: x.replace("the", "teh").replace("  ", " ")))
    pairs = written(review.edits(records))
    return sinks.reports(records, review.with_chunk_lists(review.summarise(pairs), pairs))


@query("batch_refine")
def _refine(spark, d):
    return flat_map(spread(docs(spark, d).select("doc_id", "text")), lambda i, x: [(i, *folds.batch_refine(x, lambda c: "校对后：" + c.replace("  ", " ")))], "doc_id long, text string, chunks int, accepted int, fallbacks int")


@query("last_n_log", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 120")
def _log(spark, d):
    return review.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 120).drop("ts")


@query("newest3_snapshots", "SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def _snapshots(spark, d):
    return review.newest(table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 3)


@query("snapshot_restore", "SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'remove' ELSE 'restore' END AS action FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0")
def _restore(spark, d):
    files = table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), "p_partkey")
    return review.restore(files.filter("p_partkey % 2 = 0").select("name"), files.filter("p_partkey % 3 > 0").select("name"))


@query("jobs_newest_first", "SELECT o_orderkey, o_orderdate, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey))::BIGINT AS place, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _jobs(spark, d):
    """All jobs, ranked by buckets of their date, so no task holds them all."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey", F.lit(0).alias("all"))
    low, high, n = o.agg(F.min("o_orderdate"), F.max("o_orderdate"), F.count("*")).first()
    span = (high - low).total_seconds() + 1 if n else 1.0
    old = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.lit(high)) / F.lit(span) if n else F.lit(0.0)
    placed = ranked(o, ["all"], old, [F.desc("o_orderdate"), F.col("o_orderkey")], buckets_for(n), "place")
    return placed.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "o_orderdate", (F.col("place") + 1).alias("place"), "c_name")


@query("rolling_speed", """WITH RECURSIVE e AS (SELECT event_type AS key, (event_id % 40)::BIGINT AS n, value AS s, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id % 40 > 0 AND value > 0),
r AS (SELECT key, k, n AS pages, s AS total FROM e WHERE k = 1 UNION ALL SELECT e.key, e.k, CASE WHEN pages > 2000 THEN 1000 ELSE pages END + n, CASE WHEN pages > 2000 THEN total / 2 ELSE total END + s FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, arg_max(pages, k) AS pages, round(arg_max(total, k), 6) AS total_sec FROM r GROUP BY key""")
def _speed(spark, d):
    return review.speeds(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("at"), (F.col("event_id") % 40).alias("pages"), F.col("value").alias("seconds"))).withColumn("total_sec", F.round("total_sec", 6))


@query("eta_estimate", "SELECT event_type AS key, CASE WHEN sum(event_id % 40)::BIGINT >= 5 THEN round(sum(value) / sum(event_id % 40)::BIGINT * 300 / 2, 3) END AS seconds FROM events GROUP BY 1")
def _eta(spark, d):
    total = table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.sum(F.col("event_id") % 40).alias("pages"), F.sum("value").alias("total_sec"))
    return review.estimate(total, 300, 2).select("key", F.round("seconds", 3).alias("seconds"))


@query("length_stats", "SELECT source, median(length(text)) AS median, min(length(text))::INTEGER AS least, max(length(text))::INTEGER AS most, sum(length(text))::BIGINT AS total, bool_or(length(text) < 50) AS any_blank, bool_and(length(text) > 0) AS all_filled FROM documents GROUP BY source")
def _lengths(spark, d):
    n = F.length("text")
    return docs(spark, d).groupBy("source").agg(F.median(n).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.bool_or(n < 50).alias("any_blank"), F.bool_and(n > 0).alias("all_filled"))


@query("unique_line_ratio", rf"SELECT doc_id, len(l)::INTEGER AS lines, len(list_distinct(l))::INTEGER AS uniq FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_replace(y, '{STRIP}', '', 'g')), lambda y: y <> '') AS l FROM documents)")
def _unique(spark, d):
    own = T.stripped_lines(t())
    return docs(spark, d).select("doc_id", F.size(own).alias("lines"), F.size(F.array_distinct(own)).alias("uniq"))


@query("sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS end, count(*)::BIGINT AS events FROM g GROUP BY user_id, g")
def _sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("ordered_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _ordered(spark, d):
    own = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(own, "\n").alias("text"))


@query("processed_pages")
def _processed(spark, d):
    return plans.processed_pages(spread(pages(spark, d))).drop("notes")


@query("book_chapters")
def _chapters(spark, d):
    p = pictured(spark, d).select("book_id", "page_no", "illustration", "text")
    marks = outline(spark, d).groupBy("page").agg(F.min("ord").alias("ord"), F.min("title").alias("title"))  # at most 97 rows
    totals = p.groupBy("book_id").agg(F.max("page_no").alias("total"))
    o = books.outline_chapters(totals.select("book_id").crossJoin(F.broadcast(marks)).withColumn("level", F.lit(1)), totals)
    o = o.withColumn("ord", F.col("start_page"))
    return plans.chapters(p, o)


@query("structured_chapters")
def _structured(spark, d):
    p = pictured(spark, d).select("book_id", "page_no", "illustration", "text")
    return plans.structured_chapters(p, {"cover_page": 1, "preface_page_range": [2, 3], "chapter_method": "pages"})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return plans.clean_books(pages(spark, d), plans.Settings(running_ratio=0.02), min_count=2)


query("clean_books", rf"""WITH {PAGES_SQL.replace("coalesce(text, '')", collapse_sql)}, {_RUNNING}, {_STRIPPED}, sd AS (SELECT book_id || ':' || page_no AS doc_id, coalesce(text, '') AS text FROM s), {merged_sql('sd')},
q AS (SELECT string_split(doc_id, ':')[1] AS book_id, string_split(doc_id, ':')[2]::INTEGER AS page_no, regexp_replace(text, '{STRIP}', '', 'g') AS b FROM merged), r AS (SELECT *, regexp_replace(string_split(b, chr(10))[1], '{STRIP}', '', 'g') AS f FROM q WHERE b <> ''),
j AS (SELECT book_id, page_no, CASE WHEN {chapter_sql('f')} OR regexp_matches(f, '^!\[(.*?)\]\((.*?)\)$') THEN chr(10) || chr(10) ELSE chr(10) END || b AS part FROM r), b AS (SELECT book_id, regexp_replace(string_agg(part, '' ORDER BY page_no), '{STRIP}', '', 'g') AS body FROM j GROUP BY 1)
SELECT book_id, length(body)::BIGINT AS chars, body FROM b""")(flagship)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_SQL)

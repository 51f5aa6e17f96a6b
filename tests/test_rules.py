"""Golden cases of the text rules, page rules and folds."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.functions import folds
from quire.functions import text as T
from quire.operators import books, layout, review
from quire.plans import books as plans
from quire.sources import books as sinks
from quire.sources import pages as sources


def column(spark, rule, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(rule(F.col("t"))).collect()]


def test_text_rules(spark):
    assert column(spark, T.collapse_punctuation, "好。。。是,,", "？！") == ["好。是,", "？！"]
    assert column(spark, T.collapse_full_repeat, "abcabcabc", "aaaa", "abcdabcx") == ["abc", "aaaa", "abcdabcx"]
    assert column(spark, T.circled_numbers, r"a$\textcircled{3}$b\textcircled { 21 }") == ["a③b(21)"]
    assert column(spark, T.collapse_tokens, "word word word word x", "ab ab ab") == ["word x", "ab ab ab"]
    assert column(spark, T.drop_broken_lines, "塞缪尔·\n正文。\n短，") == ["正文。"]
    assert column(spark, T.drop_fences, "```py\nx\n```\ny\n```") == ["\ny\n"]
    figures = "\n".join(f"图 {i}" for i in range(1, 14))
    assert column(spark, T.drop_figure_index, figures + "\n正文", "图 1\n正文") == ["正文", "图 1\n正文"]
    assert column(spark, T.is_suspicious, "", None, "......", "正常文字", "a" * 20) == [True, None, True, False, True]
    assert column(spark, T.drop_noise_lines, "xii\n正文在此\n--__--\n\n####") == ["正文在此"]
    assert column(spark, T.slug, " a b/c: ", "???") == ["a-bc", "book"]
    assert column(spark, T.clean_page, "", None, "一。。\r\n\n\n\n二") == ["", None, "一。\n\n二"]


def test_chapter_lines(spark):
    got = column(spark, T.is_chapter_line, "1. 研究背景", "1. Chapter One", "第三章 起始", "# x", "序言", "plain", "CHAPTER IV Title", "")
    assert got == [False, True, True, True, True, False, True, False]


def test_merge_across_pages(spark):
    pages = spark.createDataFrame([("b", 1, "这一段跨页未完", False), ("b", 2, "下一页接着写完。\n\n新一段。", False)], "book_id string, page_no int, text string, illustration boolean")
    body = books.joined_pages(pages).select(T.merge_wrapped(F.col("body"))).first()[0]
    assert body.split("\n") == ["这一段跨页未完下一页接着写完。", "", "新一段。"]


def test_prefixes():
    assert folds.shared_prefix("正文重复开头ABCDE", "正文重复开头XYZ") == 6
    assert folds.dedupe_prefixes(["同一段话在此。", "同一段话在此。"])[1:] == (0, 1)
    assert folds.dedupe_prefixes(["第一章开篇。", "第一章正文从这里开始。"])[0] == ["第一章开篇。", "第一章正文从这里开始。"]
    assert folds.dedupe_prefixes([]) == ([], 0, 0)


def test_paragraph_history():
    long = "这是一个足够长的段落，用来检查重复的判断是否成立，共有三十多个字。"
    assert folds.dedupe_paragraphs([long, "其他内容在这里", long])[1] == 1
    assert folds.dedupe_paragraphs(["序", "序", "xii"])[0] == ["序"]
    assert folds.batch_dedupe([long, long + "！"])[1] == 1


def test_headers(spark):
    body = lambda k: "\n".join(f"第{k}页的第{i}行正文" + "甲乙丙丁戊己庚辛"[k + i] * 9 for i in range(7))
    pages = ["这是一本书的书名页眉\n这是章名也很长的\n" + body(k) for k in (0, 1)]
    kept = list(folds.without_headers(pages))
    assert kept[0] == (pages[0], 0) and kept[1][1] == 2 and not kept[1][0].startswith("这是一本书")
    assert list(folds.without_headers([])) == []
    df = spark.createDataFrame([("b", n, t) for n, t in enumerate(pages, 1)], "book_id string, page_no int, text string")
    assert [r["text"] for r in books.strip_headers(df).orderBy("page_no").collect()] == [t for t, _ in kept]
    twice = spark.createDataFrame([("b", n, t) for n, t in enumerate(["x" * 130, "y" * 130, "x" * 130], 1)], "book_id string, page_no int, text string")
    assert [r["repeats"] for r in books.duplicate_pages(twice).orderBy("page_no").collect()] == [False, False, True]


def test_notes(spark):
    body, notes = folds.extract_notes("第一章 起始[1]\n\n正文。\n\n[1] 这是注释内容。")
    assert body.startswith("第一章 起始[[NOTE_REF:1|[1]]]") and notes == [(1, "[1]", "这是注释内容。")]
    safe, saved = folds.protect("甲[[NOTE_REF:7|③]]乙")
    assert folds.restore(safe, saved) == ("甲[[NOTE_REF:7|③]]乙", 1, 1)
    assert folds.restore("甲乙", saved)[1:] == (1, 0)
    pages = spark.createDataFrame([("b", n, "头[1]\n\n中。\n\n[1] 注。") for n in (1, 2)], "book_id string, page_no int, text string")
    got = books.number_notes(books.extract_notes(pages)).orderBy("page_no").collect()
    assert [r["notes"][0]["note_id"] for r in got] == [1, 2] and "NOTE_REF:2|" in got[1]["body"]


def test_chunks_and_guard():
    text = "句子一句。" * 200
    parts = folds.chunks(text, 200)
    assert len(parts) > 1 and max(map(len, parts)) <= 200 and "".join(parts) == text
    assert folds.chunks("") == [] and folds.sentence_chunks("甲。" * 500, 800)[0].endswith("。")
    assert folds.guard("原文内容在这里一共十几个字", "原文内容在这里一共十几个子")[0]
    assert [folds.guard("原文内容" * 9, x)[1] for x in ("原文", "原文内容" * 12, "", "另外写的" * 9)] == ["short", "long", "empty", "rewritten"]
    assert folds.guard("a b", " a\nb ") == (True, "")
    left, right = folds.halves("前半句子。" * 60)
    assert left + right == "前半句子。" * 60 and abs(len(left) - len(right)) <= 10
    assert folds.halves("short") is None


def test_proofread_policies(spark):
    assert folds.proofread("巳经。", lambda x: x.replace("巳", "已"))[0]["changed"]
    assert folds.proofread("正文。", lambda x: 1 / 0)[0]["status"] == "fallback"
    assert [r["i"] for r in folds.proofread("正文一句。" * 100, lambda x: "")] == ["1.1", "1.2"]
    texts = spark.createDataFrame([("b", "巳经做了。"), ("c", None)], "book_id string, text string")
    records = review.proofread(texts, lambda: lambda x: x.replace("巳", "已"))
    rows = review.changes(records).collect()
    assert [(r["old"], r["new"], r["count"], r["label"], r["level"], r["chunks"]) for r in rows] == [("巳", "已", 1, "错字", "safe", 1)]
    pairs = review.edits(records)
    assert [r["chunks"] for r in review.with_chunk_lists(review.summarise(pairs), pairs).collect()] == [["1"]]


def test_proofread_measures_whole_chunks():
    few, correct = "enteheitach " * 20 + "das " * 60, lambda x: x.replace("teh", "the")
    assert folds.guard(few, correct(few)) == (False, "rewritten")  # as difflib's heuristic has it, which counts rare characters only
    assert [(r["i"], r["status"], r["fixed"]) for r in folds.proofread(few, correct)] == [("1", "ok", correct(few).strip())]
    same = "一二三四" * 100
    assert [(r["i"], r["status"], r["changed"]) for r in folds.proofread(same, lambda x: x)] == [("1", "ok", False)]
    new = "".join(chr(20000 + i) for i in range(300))
    assert {r["reason"] for r in folds.proofread(new, lambda x: x[::-1])} == {"rewritten"}


def test_proofread_summary_counts_whole_chunks(spark, tmp_path):
    rows = [(1, "enteheitach " * 20 + "das " * 60), (2, "one two"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["proofread_summary"](spark, str(tmp_path)).orderBy("book_id").collect()
    assert [tuple(r) for r in got] == [("1", 1, 1, 0, 1), ("2", 1, 1, 0, 0)]


@pytest.mark.parametrize("old, new, label, level", [("巳", "已", "错字", "safe"), ("", "文", "增补", "warn"), ("，", "。", "标点", "safe"), ("很长的一段旧文字", "很长的一段新文字", "大段改写", "warn"), ("a", "", "删除", "warn")])
def test_change_labels(spark, old, new, label, level):
    assert tuple(spark.createDataFrame([(old, new)], "o string, n string").select(T.classify_change(F.col("o"), F.col("n"))).first()[0]) == (label, level)


def test_toc_and_structure(spark):
    entries, none = column(spark, T.toc_entries, "目录\n第一章 起始 …… 1\n第二章\n很远 52\n这是一句正文。\n3. 收束 130", "no page")
    assert [e["printed"] for e in entries] == [1, 52, 130] and entries[1]["title"] == "第二章 很远" and none == []
    pages = [("b", 1, "书名"), ("b", 2, "ISBN 978"), ("b", 3, "目录\n一 1"), ("b", 4, "正文的一页，写得很长。" * 20), ("b", 5, "完")]
    df = spark.createDataFrame([(*p, False) for p in pages], "book_id string, page_no int, text string, illustration boolean")
    kinds = {r["page_no"]: r["kind"] for r in books.classify_pages(books.toc_hits(df)).collect()}
    assert kinds == {1: "cover", 2: "copyright", 3: "toc", 4: None, 5: "back_cover"}
    streamed = books.page_chunks(spark.createDataFrame([("b", i, "text") for i in range(1, 6)], "book_id string, page_no int, text string"), 2, 1)
    assert [(r["first"], r["last"]) for r in streamed.orderBy("chapter").collect()] == [(1, 3), (4, 5)]
    both = spark.createDataFrame([("b", i // 2, "text", i % 2 == 1) for i in range(2, 12)], "book_id string, page_no int, text string, illustration boolean")
    assert [(r["first"], r["last"]) for r in books.page_chunks(both, 2, 1).orderBy("chapter").collect()] == [(1, 3), (4, 5)]  # a page's rows are one page


def test_boxes(spark):
    boxes = [("text", 0.9, (0, 0, 100, 100)), ("doc_title", 0.9, (0, 0, 100, 95)), ("figure", 0.9, (0, 0, 100, 100)), ("text", 0.9, (0, 200, 50, 250))]
    assert [b[0] for b in folds.suppress_boxes(boxes)] == ["figure", "text", "text"]
    assert folds.suppress_boxes([]) == []
    one = spark.createDataFrame([("figure", 0.3, 0, 0, 300, 300), ("figure", 0.3, 0, 0, 20, 300)], "l string, s double, a int, b int, c int, d int")
    keep = layout.keep_visual(*[F.col(c) for c in "lsabcd"], F.lit(1000), F.lit(1000))
    assert [r[0] for r in one.select(keep).collect()] == [True, False]
    marker = "![插图](images/a.jpg)"
    assert [p[2] for p in folds.dedupe_layout([(2, 0, marker), (1, 0, "正文"), (3, 0, marker)])] == ["正文", marker]


def test_suppression_of_odd_boxes(spark, tmp_path):
    rows = [(1, 7, 3, None, 11.0, 0.05), (1, 7, 3, 1, 10.0, 0.05), (2, None, 3, 1, 10.0, 0.05), (2, 7, 3, 2, 10.4, 0.05), (2, -1, 3, 3, 10.0, 0.05), (2, 7, None, 4, 10.0, 0.05), (3, 9, 3, 1, None, None), (None, 7, 3, 1, 10.0, 0.05)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["box_suppression"](spark, str(tmp_path)).orderBy("page_id", "place").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "table", 0.5, 40, 15, 87, 62), (2, 0, None, 0.5, 40, 15, 79, 54), (2, 1, None, 0.5, 40, 15, None, None), (2, 2, "table", 0.5, 42, 15, 89, 62),
        (2, 3, "table", 0.5, 40, None, 87, None), (3, 0, "doc_title", None, None, 15, None, 64),
    ]


def test_suppression_of_boxes_inside_out():
    inverted, whole = ("text", 0.9, (0, 0, -100, -50)), ("text", 0.9, (0, 0, 40, 40))
    assert folds.suppress_boxes([whole, inverted]) == [inverted, whole]


def test_markdown_and_epub(spark):
    assert folds.to_xhtml("# T\n- a\n- b\n\n> q\n\n**x** *y*") == "<h1>T</h1>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<blockquote>\n<p>q</p>\n</blockquote>\n<p><strong>x</strong> <em>y</em></p>"
    content = sinks.epub("书", "人", [{"title": "一", "body": "正文[[NOTE_REF:7|③]]。", "notes": [{"note_id": 7, "label": "③", "text": "注"}]}])
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert 'href="#note-7"' in z.read("OEBPS/chapter-1.xhtml").decode() and "[1]" in z.read("OEBPS/chapter-1.xhtml").decode()
    files = spark.createDataFrame([("b", content)], "book_id string, content binary")
    assert "## 一\n\n正文[1]。" in sinks.epub_texts(files).first()["text"]
    assert sinks.html_diff("a<b", "a<c") == ("a&lt;<del>b</del>", "a&lt;<ins>c</ins>") and sinks.html_diff("", None) == ("", "")


def test_review_reports(spark):
    texts = spark.createDataFrame([("b", "巳经做了。"), ("c", "一样。")], "book_id string, text string")
    records = review.proofread(texts, lambda: lambda x: x.replace("巳", "已") if "巳" in x else 1 / 0)
    pairs = review.edits(records)
    got = {(r["book_id"], r["kind"]): r["content"] for r in sinks.reports(records, review.with_chunk_lists(review.summarise(pairs), pairs), meta={"model": "m"}).collect()}
    assert len(got) == 6
    md = got["b", "md"].split("\n")
    assert "- 校对模型：m" in md and "- 结果：1 块通过 · 0 块回退原文 · 1 块有改动" in md and "| 1 | 巳 | 已 | 错字 | 1 | 1 | 巳经做了。 |" in md
    assert "### 块 1/1 —— 已采纳" in md and "- `巳` → `已`" in md
    assert "回退原文（failed: ZeroDivisionError）" in got["c", "md"] and "<del>巳</del>" in got["b", "html"] and "<ins>已</ins>" in got["b", "html"]
    assert json.loads(got["b", "json"])["records"][0]["fixed"] == "已经做了。"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "backup")
    assert sinks.list_snapshots(spark, path).collect() == []
    files = lambda v: spark.createDataFrame([("b", n, f"{n}{v}".encode()) for n in ("book.md", "notes.json")], "book_id string, name string, content binary")
    for n in range(5):
        sinks.write_snapshot(files(n), path, f"2024-01-0{n + 1}", note=f"n{n}")
    kept = sinks.list_snapshots(spark, path).collect()
    assert [(r["tag"], r["note"], r["files"]) for r in kept] == [(f"2024-01-0{n}", f"n{n - 1}", ["book.md", "notes.json"]) for n in (5, 4, 3)]
    now = files(9).union(spark.createDataFrame([("b", "new.epub", b"x"), ("other", "book.md", b"y")], "book_id string, name string, content binary"))
    back = {(r["book_id"], r["name"]): bytes(r["content"]) for r in sinks.restored(now, path, "2024-01-03").collect()}
    assert back == {("b", "book.md"): b"book.md2", ("b", "notes.json"): b"notes.json2", ("other", "book.md"): b"y"}


def test_batch_refine():
    text = "正文一句，写得足够长，超过十个字。" * 3
    assert folds.batch_refine(text, lambda c: "好的，以下是修正后的结果：\n" + c) == (text, 1, 1, 0)
    assert folds.batch_refine(text, lambda c: "短") == (text, 1, 0, 1) and folds.batch_refine(text, lambda c: None)[3] == 1 and folds.batch_refine("", lambda c: c) == ("", 0, 0, 0)


@pytest.fixture
def backends(monkeypatch):
    def flaky():
        return lambda image, profile: {b"first": "正常的文字。", b"last": "......" if profile != sources.PROFILES[-1] else "正常的文字。"}.get(image, "完整的半页文字。" if image in (b"up", b"low") else "")

    monkeypatch.setitem(sources.BACKENDS, "flaky", flaky)


def test_recognition_by_attempts_halves_and_pictures(spark, backends):
    images = spark.createDataFrame([("b", n, i) for n, i in enumerate([b"first", b"last", b"split", b"never", b"picture"], 1)], "book_id string, page_no int, image binary")
    got = {r["page_no"]: (r["text"], r["status"]) for r in sources.recognised(images, "flaky", halves=lambda i: [b"up", b"low"] if i == b"split" else [i], picture=lambda i: i == b"picture").collect()}
    assert got[1] == got[2] == ("正常的文字。", "ok") and got[3] == ("完整的半页文字。\n完整的半页文字。", "ok")
    assert got[4] == (None, "failed: suspicious; suspicious; suspicious") and got[5] == ("![整页插图](images/page_0005.jpg)", "ok")


def test_stub_answers_lose_no_line(spark, tmp_path):
    urls = ["http://a.example.com/es/4444.html", "http://a.example.com/es/4321.html"]  # the first one stutters
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["recognised_pages"](spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r["text"], r["status"]) for r in got] == [(u, "ok") for u in urls]


def test_next_body_page_of_many_entries(spark):
    schema = "book_id string, ord long, printed int"
    entries = spark.createDataFrame([("b", 1, 4), ("b", 2, 2), ("b", 2, 3), ("b", 3, 40), ("b", 4, 0), ("c", 1, 1)], schema)  # two entries of one place
    body = spark.createDataFrame([("b", n) for n in (3, 4, 8)], "book_id string, page_no int")
    got = [(r["book_id"], r["ord"], r["printed"], r["actual"]) for r in books.next_body_page(entries, body).orderBy("book_id", "ord", "printed").collect()]
    assert got == [("b", 1, 4, 4), ("b", 2, 2, 4), ("b", 2, 3, 3), ("b", 3, 40, None), ("b", 4, 0, None), ("c", 1, 1, None)]


def test_pages_are_rendered_within_bounds():
    assert sources.zoom(595, 842, 72) == 1.0 and abs(sources.zoom(595, 842, 300) * 842 - 1600) < 1e-9


def test_detected_boxes(spark, monkeypatch):
    images = spark.createDataFrame([(1, b'[{"label": " Text", "score": 0.5, "bbox": [1, 2, 3, 4]}, {"label": "x", "bbox": [1]}]'), (2, b"nothing {"), (3, b"")], "page_id long, image binary")
    assert [(r["page_id"], r["label"], r["score"], r["bbox"]) for r in layout.detected(images).collect()] == [(1, "text", 0.5, [1.0, 2.0, 3.0, 4.0])]
    monkeypatch.setitem(layout.DETECTORS, "broken", lambda: lambda image: 1 / 0)
    assert layout.detected(images, "broken").collect() == []


def test_layout_parts_are_bounded(spark):
    rows = [(1, n, "figure", 0.9, 0.0, float(n), 300.0, n + 300.0) for n in range(30)] + [(1, 50, "text", 0.1, -5.0, 0.0, 700.4, 900.0), (1, 51, "text", 0.9, 0.0, 0.0, 15.0, 90.0), (1, 52, "header", 0.9, 0.0, 0.0, 90.0, 90.0)]
    df = spark.createDataFrame(rows, "page_id long, box_id long, label string, score double, x1 double, y1 double, x2 double, y2 double")
    got = layout.page_parts(df, 600, 800).collect()
    assert sorted(r["box_id"] for r in got) == [*range(24), 50] and [(r["x1"], r["x2"], r["y2"]) for r in got if r["box_id"] == 50] == [(0, 600, 800)]


def test_speed_and_estimate(spark):
    assert folds.decayed_speed([(2001, 10.0), (10, 1.0)]) == (1010, 6.0)
    speed = spark.createDataFrame([("k", 10, 100.0), ("few", 4, 1.0)], "key string, pages long, total_sec double")
    assert {r["key"]: r["seconds"] for r in review.estimate(speed, 12, 2).collect()} == {"k": 60.0, "few": None}


def test_settings_fall_back():
    assert plans.Settings.of({"dpi": None, "chunk_chars": 500}) == plans.Settings(chunk_chars=500)
    stored = plans.Settings.of({"proof_model": "", "proof_retry_min_chars": 100, "concurrency": 8, "mode": "test", "unknown": 1, "proof_similarity_min": 0.8})
    assert stored == plans.Settings(retry_least=100, concurrency=4, mode="test", page_range=(1, 10), similar=0.8)


def test_page_range_and_cache(spark, tmp_path):
    pages = spark.createDataFrame([(b, n, f"{b}{n}") for b in "ab" for n in range(1, 13)], "book_id string, page_no int, text string")
    assert plans.Settings.of({"mode": "test"}).within(pages).count() == 20 and plans.Settings().within(pages).count() == 24
    cache = str(tmp_path / "cache")
    sinks.write_pages(pages, cache)
    sinks.write_pages(pages.filter("book_id = 'a' AND page_no = 1").withColumn("text", F.lit("new")), cache)  # one book's pages are replaced, the other's stay
    assert {(r["book_id"], r["text"]) for r in spark.read.parquet(cache).filter("page_no = 1").collect()} == {("a", "new"), ("b", "b1")}
    notes = spark.createDataFrame([("a", 1, "①", "注")], "book_id string, note_id int, label string, text string")
    sinks.write_notes(notes, str(tmp_path / "notes"))
    assert spark.read.json(str(tmp_path / "notes")).first()["text"] == "注"


def test_speed_state(spark, tmp_path):
    from quire.streaming import pages as streams

    src, schema = str(tmp_path / "in"), "key string, pages long, seconds double"
    spark.createDataFrame([("k", 2001, 10.0), ("j", 1, 1.0), ("j", 0, 5.0)], schema).coalesce(1).write.parquet(src)
    states = streams.speed_state(spark.readStream.schema(schema).parquet(src))
    states.writeStream.format("memory").queryName("speeds").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(90)
    assert {r["key"]: (r["pages"], r["total_sec"]) for r in spark.table("speeds").collect()} == {"k": (2001, 10.0), "j": (1, 1.0)}


def test_streaming_resumes(spark, tmp_path):
    from quire.streaming import pages as streams

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n in (1, 2):
        spark.createDataFrame([("b", n, "一。。")], streams.PAGES).write.mode("append").parquet(src)
        streams.cleaned_pages(spark, src, out, state).awaitTermination(60)
        assert spark.read.parquet(out).count() == n
    assert {r["text"] for r in spark.read.parquet(out).collect()} == {"一。"}


def test_structured_chapters(spark):
    texts = ["书名", "目录\n第一章 起始 …… 1\n第二章 收束 …… 4", *(f"正文第{i}页，写得很长很长，不是扉页。" * 9 for i in range(1, 5)), "完"]
    df = spark.createDataFrame([("b", n, False, t) for n, t in enumerate(texts, 1)], "book_id string, page_no int, illustration boolean, text string")
    got = [(r["title"], r["body"][:5]) for r in plans.structured_chapters(df).orderBy("ord").collect()]
    assert [t for t, _ in got] == ["封面", "封底", "目录", "第一章 起始", "第二章 收束"] and got[3][1] == "正文第1页" and got[4][1] == "正文第2页"
    by_pages = plans.structured_chapters(df, {"chapter_method": "pages", "chapter_target_pages": 2, "cover_page": 3})
    assert [r["title"] for r in by_pages.orderBy("ord").collect()][0] == "封面"
    assert plans.assign_sections([1, 2, 3], {"cover": [1], "toc": [2, 3]}, {"cover_page": 2}) == [(2, "封面", 0), (3, "目录", 4)]


def test_diff_and_guard_take_whole_texts(spark, tmp_path):
    text = "A line of plain words. " * 200 + "At last the end."
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    diffs = catalog.queries()["html_diff"](spark, str(tmp_path)).orderBy("doc_id", "chunk").collect()
    for side, want in (("left", text), ("right", text.replace("the", "teh"))):
        plain = [re.sub("</?(?:del|ins)>", "", r[side]) for r in diffs if r["doc_id"] == 1]
        assert re.sub(r"\s", "", "".join(plain)) == re.sub(r"\s", "", want)
    assert any("<del>" in r["left"] and "<ins>" in r["right"] for r in diffs)
    guarded = catalog.queries()["batch_output_guard"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in guarded} == {1, 2} and sum(r["doc_id"] == 1 for r in guarded) == len(folds.sentence_chunks(text)) > 5


def test_every_source_has_an_outline(spark, tmp_path):
    rows = [(i, f"Page {i} of plain words, long enough to be one.", ("one", "two")[i % 2]) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(97 * 3 + 1, 5, "1-URGENT"), (97 * 2 + 3, 6, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["book_chapters"](spark, str(tmp_path)).orderBy("book_id", "ord").collect()
    assert [(r["book_id"], r["title"]) for r in got] == [("one-0", "前言"), ("one-0", "URGENT"), ("one-0", "HIGH"), ("two-0", "URGENT"), ("two-0", "HIGH")]  # the second book begins with the first mark
    assert all(f"Page {i} of" in "".join(r["body"] for r in got) for i in range(12))

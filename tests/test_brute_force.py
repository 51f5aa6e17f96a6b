"""Queries that SQL cannot express, against plain Python on a small fixture: regular expressions with back-references, similarity,
and rules that depend on what earlier lines decided, each written out step by step."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from quire import catalog
from quire.functions import text as T

SPACE = "[ \\t\\n\\x0b\\f\\r]"
UNITS = ["word", "the", "alpha beta", "ab", "x", "。。", "!!", "...", "图 1", "第一章", "甲乙丙丁", "$\\\\textcircled{3}$", "$\\\\alpha{2}$", "```py", "```", "abcabcabcabc", "12", "---", "\n", "\n", "\n\n", " ", " ", "，", "thing, of", "of it"]


def texts():
    rng = random.Random(17)
    own = ["".join(rng.choice(UNITS) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(60))) for _ in range(150)]
    line = "a line of plain prose, long enough to be compared, number "
    own += [(line + "one\n") * 3 + line + "two\nshort\nshort\nxii\n" + line + "one" for _ in range(3)]
    own += ["Chapter 1 of many\nChapter 1 of few\nother", "abcabc" * 20, "", " \n ", "\n".join(f"图 {i}" for i in range(1, 15)) + "\nend.", "long prose " * 90 + "end", None, "same page of prose, " * 20, "same page of prose, " * 20, "same page of prose; " * 20]
    return own


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, x, f"s{i % 2}") for i, x in enumerate(texts())]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path, {i: x or "" for i, x, _ in rows}


def ran(spark, tables, name):
    return catalog.queries()[name](spark, tables[0]).collect()


def similar(a, b):
    return SequenceMatcher(None, a, b).ratio()


def key(x):
    return re.sub(r"[^\w一-鿿぀-ヿ]+", "", x)


# --- chains of rules -------------------------------------------------------------------------------------------------


def fences(x):
    x = re.sub(rf"(?m)^{SPACE}*```[a-zA-Z0-9]*{SPACE}*$\n[\s\S]*?^{SPACE}*```{SPACE}*$", "", x)
    return re.sub(rf"(?m)^{SPACE}*```[a-zA-Z0-9]*{SPACE}*$", "", x)


def marks(x):
    x = re.sub(rf"\$?{SPACE}*\\textcircled{SPACE}*\{{{SPACE}*0?([0-9]{{1,2}}){SPACE}*\}}{SPACE}*\$?", lambda m: chr(9311 + int(m[1])) if 1 <= int(m[1]) <= 20 else f"({m[1]})", x)
    return re.sub(rf"\${SPACE}*\\[a-zA-Z]+{SPACE}*\{{?[0-9]*\}}?{SPACE}*\$", "", x)


def doubled(x):
    return re.sub(rf"([{T.PUNCTUATION_RUNS}])\1+", r"\1", x)


def tokens(x):
    return re.sub(rf"(?<!\w)([A-Za-z一-鿿]{{2,}})(?!\w)(?:{SPACE}*\1(?!\w)){{3,}}", r"\1", x)


def fragments(x, low, high):
    return re.sub(rf"(?s)(.{{{low},{high}}}?)(?:{SPACE}*\1){{2,}}", r"\1", x)


def period(x):
    return next((x[:k] for k in range(1, len(x)) if len(x) % k == 0 and x[:k] * (len(x) // k) == x), x) if len(x) >= 8 else x


def figures(x):
    own = [y.strip() for y in x.split("\n") if y.strip()]
    n = [int(re.search("[0-9]+$", y)[0]) for y in own if re.fullmatch(rf"图{SPACE}*[0-9]{{1,4}}", y)]
    if len(n) >= 8 and 2 * len(n) >= len(own) and n[0] <= 5 and max(n) >= 12 and sum(b >= a for a, b in zip(n, n[1:], strict=False)) >= max(1, len(n) - 2):
        return "\n".join(y for y in x.split("\n") if not re.fullmatch(rf"图{SPACE}*[0-9]{{1,4}}", y.strip()))
    return x


def dangling(y):
    return bool(re.search(rf"[·、，：；/\\—–－]{SPACE}*$", y))


def test_clean_page_text(spark, tables):
    for r in ran(spark, tables, "clean_page_text"):
        x = tables[1][r["doc_id"]]
        want = figures(period(fragments(tokens(doubled(marks(fences(x.replace("\r\n", "\n"))))), 4, 200)))
        want = "\n".join(y for y in want.split("\n") if not (1 <= len(y.strip()) <= 30 and dangling(y.strip())))
        assert r["text"] == re.sub(r"\n{3,}", "\n\n", want).strip(), repr(x)


def test_batch_clean_by_rules(spark, tables):
    for r in ran(spark, tables, "batch_clean_by_rules"):
        x = re.sub(" *\n *", "\n", re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "", tables[1][r["doc_id"]])))
        done = fragments(tokens(doubled(marks(fences(x)))), 8, 400)
        gone = [y for y in done.split("\n") if y.strip() and ((dangling(y.strip()) and len(y.strip()) <= 30) or re.fullmatch("[的和与或了着吗呢而]", y.strip()))]
        kept = "\n".join(y for y in done.split("\n") if y not in gone)
        assert (r["text"], r["broken"]) == (re.sub(r"\n{3,}", "\n\n", kept).strip(), len(gone)), repr(x)


# --- rules that look back --------------------------------------------------------------------------------------------


def repeats(own, old, threshold, contain, least):
    short = min(len(own), len(old))
    return bool(old) and (own == old or (short >= contain and (own in old or old in own)) or (short >= least and similar(old, own) >= threshold))


def test_collapse_paragraphs(spark, tables):
    for r in ran(spark, tables, "collapse_paragraphs"):
        kept, keys, gone = [], [], 0
        for p in (re.sub(r"(.{12,260}?)(?:\s*\1){1,}", r"\1", y.strip()) for y in tables[1][r["doc_id"]].split("\n")):
            if not p:
                continue
            own = key(p)
            if len(own) < 6:
                again = not own or own in keys[-12:] or bool(re.fullmatch("[0-9ivxlcdmIVXLCDM]+", own))
            else:
                again = any(repeats(own, k, 0.88, 20, 20) for k in keys[-12:])
            last = kept[-1] if kept else ""
            again = again or (bool(last) and ((min(len(last), len(p)) >= 40 and (last in p or p in last)) or (min(len(last), len(p)) >= 20 and similar(last, p) >= 0.88)))
            if again:
                gone += 1
            else:
                kept.append(p)
                keys.append(own)
        assert (r["text"], r["gone"]) == ("\n".join(kept), gone)


def test_batch_paragraph_dedup(spark, tables):
    for r in ran(spark, tables, "batch_paragraph_dedup"):
        kept, keys = [], []
        own = [y.strip() for y in tables[1][r["doc_id"]].split("\n") if y.strip()]
        for p in own:
            k = re.sub(r"[^\w一-鿿]+", "", p)
            again = (not k or k in keys[-8:] or bool(re.fullmatch("[0-9ivxlcdmIVXLCDM]+", p))) if len(k) < 6 else any(repeats(k, o, 0.9, 20, 0) for o in keys[-8:])
            if not again:
                kept.append(p)
                keys.append(k)
        assert (r["text"], r["gone"]) == ("\n".join(kept), len(own) - len(kept))


def test_prefix_dedup(spark, tables):
    for r in ran(spark, tables, "prefix_dedup"):
        work, count = [y.strip() for y in tables[1][r["doc_id"]].split("\n") if y.strip()], 0
        for _ in range(8):
            done, changed = [], 0
            for p in work:
                for q in done:
                    n = 0
                    while n < min(len(p), len(q)) and p[n] == q[n]:
                        n += 1
                    if n >= 5:
                        p, changed = p[n:].strip(), changed + 1
                        break
                done += [p] * bool(p)
            work, count = done, count + changed
            if not changed:
                break
        assert (r["text"], r["gone"]) == ("\n".join(work), count)


def test_layout_part_dedup(spark, tables):
    got = {}
    for r in ran(spark, tables, "layout_part_dedup"):
        got.setdefault(r["doc_id"], []).append((r["ord"], r["content"]))
    for i, x in tables[1].items():
        kept, keys = [], []
        for p in (y.strip() for y in x.split("\n")):
            own = key(p)
            if own and not any(o == own or (min(len(o), len(own)) >= 30 and similar(o, own) >= 0.985) for o in keys[-8:]):
                kept.append(p)
                keys.append(own)
        assert [c for _, c in sorted(got.get(i, []))] == kept


def test_duplicate_pages(spark, tables):
    got = {(r["book_id"], r["page_no"]): r["repeats"] for r in ran(spark, tables, "duplicate_pages")}
    found = 0
    for source in (0, 1):
        recent = []
        for i in sorted(k for k in tables[1] if k % 2 == source):
            own = key(tables[1][i])
            again = len(own) >= 120 and any(repeats(own, o, 0.99, 120, 0) for o in recent[-4:])
            recent += [] if again else [own]
            assert got[f"s{source}-0", i + 1] == again
            found += again
    assert found


# --- guards, edits, files --------------------------------------------------------------------------------------------


def test_proofread_guard(spark, tables):
    for r in ran(spark, tables, "proofread_guard"):
        x = tables[1][r["id"]]
        a, b = ("".join(y.split()) for y in (x, x.replace("of ", "")))
        reason = "empty" if not b else "" if not a else "short" if len(b) < 0.95 * len(a) else "long" if len(b) > 1.05 * len(a) else "rewritten" if len(a) > 12 and similar(a, b) < 0.9 else ""
        assert (r["ok"], r["reason"]) == (reason == "", reason)


def test_change_table_counts_every_edit(spark, tables):
    want = Counter()
    for i, x in tables[1].items():
        records = [r for r in ran_records(spark, tables) if r["book_id"] == str(i) and r["status"] == "ok"]
        for r in records:
            for tag, a, b, c, d in SequenceMatcher(None, r["orig"], r["fixed"], autojunk=False).get_opcodes():
                if tag != "equal" and (r["orig"][a:b].strip() or r["fixed"][c:d].strip()):
                    want[str(i), r["orig"][a:b], r["fixed"][c:d]] += 1
    assert {(r["book_id"], r["old"], r["new"]): r["count"] for r in ran(spark, tables, "change_table")} == dict(want)


CACHE = {}


def ran_records(spark, tables):
    if "records" not in CACHE:
        CACHE["records"] = ran(spark, tables, "proofread_records")
    return CACHE["records"]


def test_html_diff_holds_both_texts(spark, tables):
    sides = {}
    for r in ran(spark, tables, "html_diff"):
        left, right = (re.sub("</?(?:del|ins)>", "", r[s]) for s in ("left", "right"))
        assert re.sub("<del>.*?</del>", "", r["left"], flags=re.S) == re.sub("<ins>.*?</ins>", "", r["right"], flags=re.S)
        sides.setdefault(r["doc_id"], []).append((r["chunk"], left, right))
    for i, x in tables[1].items():
        for side, want in ((1, x), (2, x.replace("the", "teh"))):
            assert "".join("".join(c[side] for c in sorted(sides[i])).split()) == "".join(want.split())


def test_epubs_round_trip(spark, tables):
    from quire.sources import books as sinks

    made = catalog.epubs(spark, tables[0])
    back = {r["book_id"]: "".join(re.sub("[#*`｜|>-]", "", r["text"]).split()) for r in sinks.epub_texts(made).collect()}
    bodies = {}
    for r in ran(spark, tables, "split_chapters"):
        bodies.setdefault(r["book_id"], []).append((r["ord"], r["title"] + "\n" + r["body"]))
    assert set(back) == set(bodies) and len(back) == 2
    for b, parts in bodies.items():
        whole = "".join("".join(x for _, x in sorted(parts)).split())
        assert [back[b].count(w) for w in ("plainprose", "longprose")] == [whole.count(w) for w in ("plainprose", "longprose")]


def test_batch_refine_keeps_texts(spark, tables):
    for r in ran(spark, tables, "batch_refine"):
        assert r["chunks"] == r["accepted"] + r["fallbacks"]
        assert "".join(r["text"].split()) == "".join(tables[1][r["doc_id"]].split())

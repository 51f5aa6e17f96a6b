"""License scans by ordered signature rules.

A few hundred regular expressions are built from two tables: licences (label, keyword, name) and phrasings (how a text cites
a licence), plus short forms, passages of the licences' own texts and notices of their own. Identifiers in an SPDX line, alone or
in an expression, are looked up in a table. Any run of separators may stand between words. An Aho-Corasick pass over the whole text finds keywords; only rules whose keyword
occurs run. Detections are then resolved in order of priority: one that lies within a detection of higher priority, or of
the same priority and greater length, is suppressed.

Base phrases are found by words (runs of ASCII letters and digits and of anything beyond ASCII) that stand consecutively.

Defined results: a null or empty text has no words, no labels (an empty string) and score 0; first_word and last_word are
null without a base phrase. A null doc_id stays null. Repeated rows and ids are treated one by one; an empty table gives an
empty result; columns beyond doc_id and text are not read. A very long text is scanned whole, in one row. Of detections with
the same place and priority all labels count."""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

#: Base phrases and labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: label, keyword that must occur, name as a regular expression (a blank stands for any run of separators, with a question mark for
#: none as well). Keywords are single words, so a line break in a name hides none.
LICENCES = (
    ("gpl-1.0", "gnu", r"gnu general public licen[sc]e(?: version)? v?1(?:\.0)?"),
    ("gpl-2.0", "gnu", r"gnu general public licen[sc]e(?: version)? v?2(?:\.0)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[sc]e(?: version)? v?3(?:\.0)?"),
    ("gpl", "gnu", r"gnu general public licen[sc]e"),
    ("gpl-2.0", "gpl", r"gpl v?2(?:\.0)?"),
    ("gpl-3.0", "gpl", r"gpl v?3(?:\.0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e(?: version)? v?2\.1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[sc]e(?: version)? v?3(?:\.0)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e"),
    ("lgpl", "lgpl", r"lgpl(?: v?[23](?:\.[01])?)?"),
    ("lgpl-2.0", "library", r"gnu library general public licen[sc]e"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[sc]e(?: version)? v?3(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", r"agpl(?: v?3(?:\.0)?)?"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e(?: version 1\.[123])?"),
    ("apache-2.0", "apache", r"apache licen[sc]e(?: version)? v?2(?:\.0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1\.1"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", r"(?:the )?mit licen[sc]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified) bsd licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|revised|modified) bsd licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|four clause|original) bsd licen[sc]e"),
    ("bsd", "bsd", r"bsd licen[sc]e"),
    ("0bsd", "zero", r"(?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version)? 1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version)? v?2(?:\.0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version)? v?1(?:\.0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version)? v?2(?:\.0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("cddl", "distribution", r"common development and distribution licen[sc]e"),
    ("cpl", "common", r"common public licen[sc]e"),
    ("eupl", "european", r"european union public licen[sc]e(?: version)?(?: v?1\.[012])?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2(?:\.0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("boost", "boost", r"boost software licen[sc]e(?: version 1\.0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("python", "python", r"python software foundation licen[sc]e"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e(?: version 1\.1)?"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e"),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("afl", "academic", r"academic free licen[sc]e"),
    ("osl", "software", r"open software licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("busl", "business", r"business source licen[sc]e(?: 1\.1)?"),
    ("sspl", "server", r"server side public licen[sc]e"),
    ("elastic", "elastic", r"elastic licen[sc]e(?: 2\.0)?"),
    ("ogl", "government", r"open government licen[sc]e"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?"),
    *[
        (f"cc-{'-'.join(c)}", key, r" ".join((lead, *(words if lead != "cc" else c))) + r"(?: (?:licen[sc]e|international|[1234]\.[05])){0,3}")
        for c, words in (
            (("by",), ("attribution",)),
            (("by", "sa"), ("attribution", "share ?alike")),
            (("by", "nd"), ("attribution", "no ?deriv(?:ative)?s?")),
            (("by", "nc"), ("attribution", "non ?commercial")),
            (("by", "nc", "sa"), ("attribution", "non ?commercial", "share ?alike")),
            (("by", "nc", "nd"), ("attribution", "non ?commercial", "no ?deriv(?:ative)?s?")),
        )
        for lead, key in (("cc", "cc"), ("creative commons", "creative"))
    ],
)

#: SPDX identifiers that are not their own label: identifier, label.
_VERSIONS = {"gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "apache": "1.0 1.1 2.0", "mpl": "1.0 1.1 2.0", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "cddl": "1.0 1.1", "artistic": "1.0 2.0", "afl": "3.0", "osl": "3.0"}
SPDX = {f"{family}-{v}": f"{family}-{v}" for family, versions in _VERSIONS.items() for v in versions.split()}
SPDX |= {x: x for x in ("mit", "mit-0", "x11", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "zlib", "wtfpl", "unlicense", "ms-pl", "ms-rl", "ncsa", "postgresql")}
SPDX |= {"bsl-1.0": "boost", "psf-2.0": "python", "python-2.0": "python", "ofl-1.0": "ofl", "ofl-1.1": "ofl", "odbl-1.0": "odbl", "odc-by-1.0": "odc-by", "pddl-1.0": "pddl", "cc0-1.0": "cc0", "cpl-1.0": "cpl", "busl-1.1": "busl", "sspl-1.0": "sspl", "elastic-2.0": "elastic"}
SPDX |= {f"cc-{c}-{v}": f"cc-{c}" for c in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}

#: Short forms in running text: label, keyword, pattern, priority, confidence.
SHORT = (
    *[
        (f"{family}-{v}", family, rf"(?:gnu )?{family} ?(?:v(?:ersion)? ?)?{v[0]}(?: {v[2]}){'?' if v[2] == '0' else ''}(?: only| or later)?", 3, 0.9)
        for family in ("gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "eupl", "cddl") for v in _VERSIONS[family].split()
    ],
    *[(f"bsd-{n}-clause", "bsd", rf"bsd (?:{n}|{word}) clause|(?:{n}|{word}) clause bsd", 3, 0.9) for n, word in ((2, "two"), (3, "three"), (4, "four"))],
    *[(x, x, rf"(?:(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?|licen[sc]e(?: is| type)? ){x}", 3, 0.9) for x in ("mit", "isc", "zlib", "x11")],
)

_MODIFY = "redistribute it and or modify it under the terms of the gnu {}general public licen[sc]e"
_FSF = "(?: version [0-9](?: [0-9])?)? as published by the free software foundation(?: either)? version {}"
_ENDORSE = "be used to endorse or promote products derived from this software"
#: Passages of the licences' own texts: label, keyword, pattern, priority, confidence.
BODIES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction", 1, 0.98),
    ("mit-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 1, 0.98),
    ("isc", "hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 1, 0.98),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1, 0.98),
    ("boost", "hereby", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 1, 0.98),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 2, 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 2, 0.9),
    ("bsd-3-clause", "endorse", rf"(?:neither the names? of[\x00-\xff]{{0,300}}? may|the names? of[\x00-\xff]{{0,200}}? may not) {_ENDORSE}", 1, 0.95),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.95),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 0.98),
    *[(label, "redistribute", _MODIFY.format(kind), 1, 0.98) for label, kind in (("gpl", ""), ("lgpl", "(?:lesser|library) "), ("agpl", "affero "))],
    *[(f"{label}-{v}", "redistribute", _MODIFY.format(kind) + _FSF.format(v[0] + ("(?: 0)?" if v[2] == "0" else f" {v[2]}")), 1, 0.98) for label, kind in (("gpl", ""), ("lgpl", "(?:lesser|library) "), ("agpl", "affero ")) for v in _VERSIONS[label].split()],
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0", 1, 0.98),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1, 0.98),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 1, 0.98),
)

#: phrasing with {} for the name, priority (0 first), confidence.
PHRASINGS = (
    (r"spdx licen[sc]e identifier {}", 1, 1.0),
    (r"(?:is |are )?(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}", 1, 0.98),
    (r"under (?:the )?terms (?:and conditions )?of (?:the )?{}", 2, 0.95),
    (r"(?:licen[sc]e|licen[sc]ing) (?:is |type )?{}", 3, 0.9),
    (r"{}", 4, 0.85),
)

#: Notices: label, keyword, pattern, priority, confidence.
NOTICES = (
    ("all-rights-reserved", "reserved", r"(?:copyright[^\n]{0,80}?)?all rights reserved", 2, 0.9),
    ("all-rights-reserved", "vorbehalten", r"alle rechte vorbehalten", 2, 0.9),
    ("all-rights-reserved", "serv", r"tous droits r..?serv..?s", 2, 0.9),
    ("all-rights-reserved", "derechos", r"todos los derechos reservados", 2, 0.9),
    ("public-domain", "domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", 2, 0.9),
    ("public-domain", "domain", r"public domain (?:work|mark|dedication)", 3, 0.8),
    ("proprietary", "proprietary", r"proprietary and confidential", 3, 0.8),
    ("proprietary", "redistribut", r"(?:may not|do not|no part[^\n]{0,40}may) be? ?(?:copied|reproduced|redistributed)", 4, 0.6),
    ("copyright", "copyright", r"copyright (?:c |©)?(?:19|20)[0-9]{2}", 5, 0.5),
)

SEP = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]"
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TYPED = "(?:[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]|\\xc2[\\xa0\\xa9]|\\xe2\\x80[\\x90-\\xbf])"  # and typographic quotes, dashes and blanks
EDGE, END = "(?<![0-9a-z\\x80-\\xff])", "(?![0-9a-z\\x80-\\xff])"


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority. Patterns work on lower-cased UTF-8 read as Latin-1."""
    out = []
    for label, keyword, name in LICENCES:
        for phrasing, priority, confidence in PHRASINGS:
            out.append((label, keyword, phrasing.replace("{}", name), priority, confidence))
    out = [(*x, SEP) for x in (*out, *SHORT, *NOTICES)] + [(*x, TYPED) for x in BODIES]
    made = [Rule(label, keyword, re.compile(f"{EDGE}(?:{p.replace(' ?', f'{sep}*').replace(' ', f'{sep}+')}){END}"), priority, c) for label, keyword, p, priority, c, sep in out]
    return tuple(sorted(made, key=lambda r: r.priority))


SPDX_LINE = re.compile(f"{EDGE}spdx{SEP}+licen[sc]e{SEP}+identifier[ \\t]*:[ \\t]*([^\\r\\n]*)")
SPDX_ID = re.compile(r"[0-9a-z][0-9a-z.-]*[0-9a-z]")


@cache
def spdx_rules() -> dict[str, Rule]:
    return {x: Rule(label, "spdx", SPDX_ID, 0, 1.0) for x, label in SPDX.items()}


def spdx(low: str) -> list[tuple[int, int, Rule]]:
    """Identifiers in SPDX lines; a detection starts where the one before it in its line ends."""
    found, known = [], spdx_rules()
    for line in SPDX_LINE.finditer(low):
        start = line.start()
        for m in SPDX_ID.finditer(low, line.start(1), line.end(1)):
            name = m.group().removesuffix("-only").removesuffix("-or-later")
            if name in known:
                found.append((start, m.end(), known[name]))
                start = m.end()
    return found


@cache
def base_patterns() -> tuple[tuple[tuple[bytes, ...], re.Pattern, str], ...]:
    return tuple((tuple(w.encode() for w in p.split()), re.compile((EDGE + p.replace(" ", f"{SEP}+") + END).encode("latin-1")), label) for p, label in BASE)


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in {"spdx", *(r.keyword for r in rules())}:
        a.add_word(k, k)
    a.make_automaton()
    return a


def detect(low: str) -> list[tuple[int, int, Rule]]:
    """Detections that remain after suppression, by start. `low`: the text's lower-cased UTF-8 as Latin-1."""
    keys = {k for _, k in automaton().iter(low)}
    found = [(m.start(), m.end(), r) for r in rules() if r.keyword in keys for m in r.pattern.finditer(low)] if keys else []
    found += spdx(low) if "spdx" in keys else []
    # By start, longest first: what starts earlier (or there, and is longer) contains whatever does not end after it.
    # Containment and priority are transitive, so it suffices to hold the furthest end seen for each priority.
    kept, furthest = [], [-1] * (1 + max(r.priority for r in rules()))
    for s, e, r in sorted(found, key=lambda x: (x[0], -x[1], x[2].priority, x[2].label)):
        if max(furthest[: r.priority + 1]) < e:
            kept.append((s, e, r))
        furthest[r.priority] = max(furthest[r.priority], e)
    return kept


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    if not text:
        return 0, 0, None, None, "", "", 0.0
    low = text.encode("utf-8", "surrogatepass").translate(LOWER)
    is_word = WORD_BYTE[np.frombuffer(low, np.uint8)]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    places, base = [], set()
    for words, pattern, label in base_patterns():
        if all(w in low for w in words):
            for m in pattern.finditer(low):
                places.append(m.start())
                base.add(label)
    found = detect(low.decode("latin-1"))
    score = max([0.9 if base else 0.0, *(r.confidence for _, _, r in found)])
    word_at = lambda p: int(np.count_nonzero(starts[:p]))
    labels = sorted(base | {r.label for _, _, r in found})
    return int(np.count_nonzero(starts)), len(places), word_at(min(places)) if places else None, word_at(max(places)) if places else None, ",".join(sorted(base)), ",".join(labels), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in pieces(batches):
        cols = list(zip(*(scan(t.as_py()) for t in b.column("text")), strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)


def scan_all(docs: DataFrame) -> DataFrame:
    """A row of counts, places, labels and score for each row of `docs`."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    return scan_all(spark.read.parquet(f"{sf_dir}/documents.parquet"))

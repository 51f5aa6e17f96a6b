"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over each whole text and finds anchors: at-signs, plus signs, digits, URL schemes and
the words that introduce identifiers. Local parsers then expand each anchor to its boundaries and validate what they find;
text without anchors costs no more than that pass. Parsers resume where their last match ended, so their matches are the
leftmost non-overlapping ones of the stated patterns, failing matches included. No character is looked at more than a bounded
number of times: runs between anchors don't overlap, what may be repeated freely in a pattern is bounded, and a run of
characters that a secret may have is measured once for all cues inside it. So the work is linear in the text.

Base kinds: email, ip, card, phone. The method adds: account (a stand-alone number of card length that fails the card check),
iban (valid by remainder 97), secret (the value after a token, key or password cue, or a cloud key id) and login (user and
password inside a URL).

Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows and ids are treated one by one; an
empty table gives an empty result; columns beyond doc_id and text are not read, and `redacted` carries them along, whatever their
names. A very long text is scanned whole, in one row. Spans of different kinds may overlap; of one kind they don't, and those
with the same start are listed by kind, then end. Offsets count code points, ends are exclusive."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "secret", "login")
SCHEMES = ("http://", "https://", "ftp://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://", "ssh://")
SECRET_CUES = ("token", "secret", "api_key", "api-key", "apikey", "api key", "access_key", "access-key", "private_key", "password", "passwd", "pwd", "bearer")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET_START = re.compile(r"[\"']?[ \t]{0,8}[:= ][ \t]{0,8}[\"']?(?=[A-Za-z0-9+/_.=-])")
SECRET_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
SECRET_LEAST = 16
CLOUD_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
IBAN = re.compile(r"[ \t:#.]{0,8}(?:number|no\.?|nr\.?)?[ \t:#]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])", re.I | re.A)
LOGIN = re.compile(r"([^\s/@:\"'<>]+:[^\s/@\"'<>]+)@")

_automaton = None


def automaton():
    """Anchor -> kind of anchor; built once in a process."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for kind, cues in (("scheme", SCHEMES), ("secret", SECRET_CUES), ("iban", ("iban",))):
            for cue in cues:
                for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                    a.add_word(form, (kind, len(form)))
        a.add_word("AKIA", ("cloud", 4))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for p in ats:
        i = p
        while i > end and text[i - 1] in LOCAL:
            i -= 1
        if i < p and (m := DOMAIN.match(text, p + 1)):
            end = m.end()
            yield i, end


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of neighbouring places, as (start, end)."""
    runs: list[tuple[int, int]] = []
    start = last = -2
    for p in places:
        if p != last + 1:
            if start >= 0:
                runs.append((start, last + 1))
            start = p
        last = p
    if start >= 0:
        runs.append((start, last + 1))
    return runs


def _chains(text: str, runs: list[tuple[int, int]], joints: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of digits that one character of `joints` joins."""
    chain: list[tuple[int, int]] = []
    for r in runs:
        if chain and r[0] == chain[-1][1] + 1 and text[chain[-1][1]] in joints:
            chain.append(r)
        else:
            if chain:
                yield chain
            chain = [r]
    if chain:
        yield chain


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in _chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            parts = [text[s:e].lstrip("0") for s, e in chain[k : k + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield chain[k][0], chain[k + 3][1]


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in _chains(text, runs, " -"):
        if 12 <= sum(e - s for s, e in chain) <= 19 and luhn("".join(text[s:e] for s, e in chain)):
            yield chain[0][0], chain[-1][1]


def _phones(text: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for p in pluses:
        if p >= end and (m := PHONE.match(text, p)):
            end = m.end()
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                yield p, end


def _accounts(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for s, e in runs:
        alone = (s == 0 or not (text[s - 1].isalnum() or text[s - 1] in "._-+/=")) and (e == len(text) or not (text[e].isalnum() or text[e] in "_-+/="))
        if 12 <= e - s <= 19 and alone and not luhn(text[s:e]):
            yield s, e


def _iban_valid(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _outside(places: list[int], spans: list[tuple[int, int]]) -> Iterator[int]:
    """Those of `places` that lie in none of `spans`; both in order."""
    k = 0
    for p in places:
        while k < len(spans) and spans[k][1] <= p:
            k += 1
        if k == len(spans) or p < spans[k][0]:
            yield p


def _secrets(text: str, cues: list[int]) -> Iterator[tuple[int, int]]:
    """Values behind cues (places of their ends): long enough, with letters and digits. Runs of value characters are measured
    once: any value in a run ends where the run does, and holds the run's last letter or digit if that stands behind its start."""
    end = low = high = letter = digit = 0
    for p in cues:
        if p < end or not (m := SECRET_START.match(text, p)):
            continue
        start = m.end()
        if not low <= start < high:
            low, high = start, SECRET_RUN.match(text, start).end()
            letter = max((i for i in range(low, high) if text[i].isalpha()), default=-1)
            digit = max((i for i in range(low, high) if text[i].isdigit()), default=-1)
        if high - start >= SECRET_LEAST and letter >= start and digit >= start:
            end = high
            yield start, end


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by start, then kind as in KINDS."""
    if not text:
        return []
    at: dict[str, list] = {"digit": [], "at": [], "plus": [], "scheme": [], "secret": [], "iban": [], "cloud": []}
    for last, (kind, size) in automaton().iter(text):
        at[kind].append(last + 1 if kind in ("scheme", "secret", "iban") else last - size + 1)
    runs = _runs(at["digit"])
    out = [("email", *x) for x in _emails(text, at["at"])]
    out += [("ip", *x) for x in _ips(text, runs)]
    out += [("card", *x) for x in _cards(text, runs)]
    out += [("phone", *x) for x in _phones(text, at["plus"])]
    taken = {s for k, s, _ in out if k == "card"}
    out += [("secret", *x) for x in _secrets(text, sorted(set(at["secret"])))]
    out += [("secret", p, m.end()) for p in _outside(at["cloud"], [x[1:] for x in out if x[0] == "secret"]) if (m := CLOUD_KEY.match(text, p))]
    out += [("iban", m.start(1), m.end(1)) for p in at["iban"] if (m := IBAN.match(text, p)) and _iban_valid(m[1])]
    out += [("account", s, e) for s, e in _accounts(text, runs) if s not in taken]
    out += [("login", m.start(1), m.end(1)) for p in at["scheme"] if (m := LOGIN.match(text, p))]
    rank = KINDS.index
    return sorted(set(out), key=lambda x: (x[1], rank(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """`text` with every span replaced by its kind in angle brackets; overlapping spans merge under the first one's kind."""
    spans = spans_of(text) if spans is None else spans
    if not spans:
        return text
    out, last = [], 0
    k0, s0, e0 = spans[0]
    for k, s, e in [*spans[1:], ("", len(text) + 1, 0)]:
        if s < e0:
            e0 = max(e0, e)
            continue
        out += [text[last:s0], f"<{k0.upper()}>"]
        last, k0, s0, e0 = e0, k, s, e
    return "".join([*out, text[last:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(batches):
    for b in pieces(batches):
        rows = []
        for t in b.column("text"):
            spans = spans_of(t.as_py())
            base = [x for x in spans if x[0] in BASE_KINDS]
            rows.append((*(sum(x[0] == k for x in base) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, for each row of `docs`."""
    return docs.select("doc_id", "text").mapInArrow(_find, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with spans in `text` replaced and `n_chars`, where there is one, counted anew. All rows stay."""
    at, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in pieces(batches):
            texts = [redact(t.as_py()) for t in b.column(at)]
            arrays = [b.column(i) for i in range(b.num_columns)]
            arrays[at] = pa.array(texts, b.column(at).type)
            if length is not None:
                arrays[length] = pa.array([None if t is None else len(t) for t in texts], b.column(length).type)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: every document stays, its personal data masked."""
    return redacted(docs)

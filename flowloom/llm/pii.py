"""Personal data: base patterns on whole texts, and offset-preserving deobfuscation.

Method: a chain of transducers rewrites disguises: look-alike letters and digits, hidden
characters, spelled digits, and "at"/"dot" in place of the signs.  Each keeps a map from
the places of its output to those of its input.  The same detectors run on the rewritten
text, and their spans are mapped back to source characters.  Base spans always stay; a
span that overlaps one is dropped unless it is a longer one of the same kind around it.

Defined results: null and empty texts have no spans; digests are those of the empty list;
repeated rows get equal results.  All detectors are linear in the length of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns.  Possessive repeats and the look-behinds only keep the
# search linear: a match can never begin inside the run that an earlier try has read.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Goes from sign to sign: the local part is the whole run before it, as the leftmost match has it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL_CHARS:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            yield "email", first, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    found = [*(emails(text) if "@" in text else ()), *ips(text), *cards(text), *(phones(text) if "+" in text else ())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Look-alikes of ASCII letters and digits (Cyrillic, Greek), signs, hidden characters.
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "aeopcyxijsdhqwABEKMHOPCTXIJSABEZHIKMNOPTYXovi", strict=True))
_LOOKS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}  # full width
_LOOKS |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
_LOOKS |= {" ": " ", " ": " ", " ": " "}
_HIDDEN = frozenset("­​‌‍⁠﻿")
_DISGUISED = re.compile("[" + "".join(map(re.escape, [*_LOOKS, *_HIDDEN])) + "]")
# Spelled digits in the languages of the corpus.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: Five spelled digits or more in a row; fewer are ordinary prose.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[ -])?(?:{_NUMBER})(?:[ ,.-]{{1,2}}(?:{_NUMBER}|dot|point)(?!\w)){{4,}}", re.I)
_SPELLED_PART = re.compile(rf"(?:{_NUMBER}|dot|point|plus)|[ ,.-]+", re.I)
_BRACKETED = re.compile(r"\s?[\[({<]\s?(at|dot|punkt|punto|point)\s?[\])}>]\s?", re.I)
# Last labels that make a worded address credible.
_ENDINGS = "com|org|net|edu|gov|info|biz|io|dev|co|uk|us|ca|eu|de|fr|es|it|nl|be|ch|at|pt|pl|se|br|in|jp|ru"
_END = re.compile(rf"(?:{_ENDINGS})\Z", re.I)
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
#: Each sign in any form: in brackets, as a word, or itself.
_AT = re.compile(rf"(?P<hidden>{_OPEN}at{_CLOSE})|(?P<word> at )|@", re.I)
_DOT = re.compile(rf"(?P<hidden>{_OPEN}(?:dot|punkt|punto|point){_CLOSE})|(?P<word> dot )|\.", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
#: The local part read backwards from the sign; its dots may be disguised as well.
_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]++(?:(?:\s?[\])}>]\s?(?:tod|tknup|otnup|tniop)\s?[\[({<]\s?| tod )[A-Za-z0-9._%+-]++)*+", re.I)


class Rewritten:
    """Text with a map to its source: output pieces, where each begins, where its source begins and ends."""

    def __init__(self, source: str) -> None:
        self.text, self.starts, self.sources, self.exact = source, [0], [(0, len(source))], [True]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of the characters [start, end)."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a = self.sources[first][0] + (start - self.starts[first] if self.exact[first] else 0)
        b = self.sources[last][0] + end - self.starts[last] if self.exact[last] else self.sources[last][1]
        return a, b

    def then(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replaces [start, end) by a string, for edits in order; places still lead to the first source."""
        if not edits:
            return self
        out = Rewritten("")
        out.starts, out.sources, out.exact = [], [], []
        parts: list[str] = []
        size = at = 0

        def add(text: str, source: tuple[int, int], exact: bool) -> None:
            nonlocal size
            if text:
                out.starts.append(size)
                out.sources.append(source)
                out.exact.append(exact)
                parts.append(text)
                size += len(text)

        def copy(a: int, b: int) -> None:
            while a < b:
                piece = bisect_right(self.starts, a) - 1
                stop = min(b, self.starts[piece + 1] if piece + 1 < len(self.starts) else len(self.text))
                add(self.text[a:stop], self.back(a, stop), self.exact[piece])
                a = stop

        for a, b, put in edits:
            copy(at, a)
            add(put, self.back(a, b), len(put) == 1 == b - a)
            at = b
        copy(at, len(self.text))
        out.text = "".join(parts)
        return out


def fold_looks(given: Rewritten) -> Rewritten:
    if given.text.isascii():
        return given
    return given.then([(m.start(), m.end(), _LOOKS.get(m.group(), "")) for m in _DISGUISED.finditer(given.text)])


def write_digits(given: Rewritten) -> Rewritten:
    """Runs of spelled digits become digits, one edit for each word and each gap."""
    edits = []
    for run in _SPELLED_RUN.finditer(given.text):
        for m in _SPELLED_PART.finditer(given.text, run.start(), run.end()):
            word = m.group().lower()
            edits.append((m.start(), m.end(), _SPELLED.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word, "")))
    return given.then(edits)


def _domain(text: str, at: re.Match) -> tuple[int, list[tuple[int, int, str]]] | None:
    """End and edits of the longest credible domain behind a sign.

    A worded at needs a disguised dot, and it or a worded last dot needs a known last label.
    """
    label = _LABEL.match(text, at.end())
    edits: list[tuple[int, int, str]] = []
    best = None  # end, and how many edits lead there
    while label and (dot := _DOT.match(text, label.end())) and (label := _LABEL.match(text, dot.end())):
        if dot.lastgroup:
            edits.append((dot.start(), dot.end(), "."))
        worded = at.lastgroup == "word"
        whole = not text[label.end() : label.end() + 1].isalnum() and text[label.end() : label.end() + 1] != "_"
        known = whole and _END.match(label[0])
        if (edits or not worded) and (known or not (worded or dot.lastgroup == "word")):
            best = label.end(), len(edits)
    return (best[0], edits[: best[1]]) if best else None


def write_signs(given: Rewritten) -> Rewritten:
    """Signs of addresses in any mixture of forms, and all other signs in brackets."""
    text = given.text
    edits: list[tuple[int, int, str]] = []
    last = 0
    for at in _AT.finditer(text):
        before, last = last, at.end()
        domain = _domain(text, at)
        local = _BACKWARDS.match(text[before : at.start()][::-1]) if domain else None
        if not local:
            continue
        first = at.start() - local.end()
        edits += [(m.start(), m.end(), ".") for m in _DOT.finditer(text, first, at.start()) if m.lastgroup]
        edits += [(at.start(), at.end(), "@")] * bool(at.lastgroup) + domain[1]
        last = domain[0]
    taken = {a for a, _, _ in edits}
    edits += [(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _BRACKETED.finditer(text) if m.start() not in taken]
    return given.then(sorted(edits))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those found behind disguises."""
    base = base_spans(text)
    plain = Rewritten(text)
    seen = write_signs(write_digits(fold_looks(plain)))
    if seen is plain:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends: list[int] = []
    for _, b in taken:
        ends.append(max(b, ends[-1] if ends else b))
    own = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    more = []
    for kind, a, b in base_spans(seen.text):
        a, b = seen.back(a, b)
        before = bisect_right(starts, b - 1)
        within = bisect_left(own[kind], (a, 0))
        longer = within < len(own[kind]) and own[kind][within][1] <= b and own[kind][within] != (a, b)
        if longer or not before or ends[before - 1] <= a:
            more.append((kind, a, b))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Every span becomes its kind in brackets; overlapping spans become the first of them."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def _search() -> Callable[[pa.RecordBatch], list]:
    def work(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            base, every = find(text)
            kinds = [k for k, _, _ in base]
            row = [*map(kinds.count, KINDS), sha256(listed(base).encode()).hexdigest(), listed(every)]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return [batch.column(0), *out]

    return work


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(slim, _FOUND, _search)


def clean(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; found spans are replaced by their kind, n_chars follows the text."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else redact(t, find(t)[1]))

    masked = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return masked.select(*docs.columns)

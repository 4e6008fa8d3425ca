"""Personal data: plain patterns, and identifiers behind disguises, with spans in the source text.

A chain of transducers rewrites the whole text and keeps, for every part that it writes anew, the span
of source characters that it comes from: look-alike characters become ASCII, spelled digits become
digits, and written-out at and dot signs become signs. Identifiers are then detected in the rewritten
text, and their spans are mapped back. Each transducer is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .tlds import TLDS

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- plain patterns

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Each at sign with a local part before it, from its first character on, and a domain after it; in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def ips(text: str) -> list[Span]:
    """Each four numbers in a row parted by dots, of at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        run = m[0]
        if run.count(".") < 3:
            continue
        at, parts = m.start(), run.split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


DIGIT = re.compile(r"[0-9]")


def plain(text: str) -> dict[str, list[Span]]:
    """Spans (code points, end exclusive) of each kind, leftmost and not overlapping."""
    digit = DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if digit and "." in text else [], "card": cards(text) if digit else [], "phone": phones(text) if digit and "+" in text else []}


# ---- transducers

#: Look-alikes of ASCII characters that compatibility normalisation leaves as they are.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "։": ":", "∙": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "⁺": "+", "＠": "@", "﹫": "@", "。": ".", "․": ".",
}
#: Characters that show nothing.
INVISIBLE = frozenset(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
#: Number words of the corpus's languages.
NUMBER_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"at": "@", "arroba": "@", "arobase": "@", "dot": ".", "punkt": ".", "point": ".", "punto": ".", "plus": "+"}


class Tape:
    """A text with the source span of each part that was written anew; the characters between stand for themselves."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, source: list[Span] | None = None) -> None:
        self.text, self.starts, self.ends, self.sources = text, starts or [], ends or [], source or []

    def _span(self, at: int) -> Span:
        """The source span of one character."""
        i = bisect_right(self.starts, at) - 1
        if i < 0:
            return at, at + 1
        if at < self.ends[i]:
            return self.sources[i]
        there = at - self.ends[i] + self.sources[i][1]
        return there, there + 1

    def source(self, start: int, end: int) -> Span:
        return self._span(start)[0], self._span(end - 1)[1]

    def is_new(self, at: int) -> bool:
        """Whether a character stands for several of the source."""
        a, b = self._span(at)
        return b - a > 1

    def rewrite(self, found: Iterable[tuple[int, int, str]]) -> Tape:
        """Each found part (start, end, what to write; in order) is replaced; what is written comes from the whole part."""
        chars, starts, ends, sources, at, shift, k = [], [], [], [], 0, 0, 0
        for start, end, new in found:
            while k < len(self.starts) and self.starts[k] < start:  # parts before this one
                starts.append(self.starts[k] + shift)
                ends.append(self.ends[k] + shift)
                sources.append(self.sources[k])
                k += 1
            span = self.source(start, end)
            while k < len(self.starts) and self.starts[k] < end:
                k += 1
            chars += (self.text[at:start], new)
            starts.append(start + shift)
            ends.append(start + shift + len(new))
            sources.append(span)
            shift += len(new) - (end - start)
            at = end
        if not chars:
            return self
        starts += [x + shift for x in self.starts[k:]]
        ends += [x + shift for x in self.ends[k:]]
        return Tape("".join([*chars, self.text[at:]]), starts, ends, sources + self.sources[k:])


def lower(text: str) -> str:
    """Lower case, character by character: one whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def folded(c: str) -> str | None:
    """What a character that is not ASCII is folded to; None if it stays."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (n := unicodedata.normalize("NFKC", c)) != c and n.isascii() and n.strip():
        return n
    if c.isspace():
        return " "
    return str(unicodedata.decimal(c)) if c.isdecimal() else None


FOLDED = {c: n for c in map(chr, range(0x80, 0x110000)) if (n := folded(c)) is not None}


def fold_lookalikes(tape: Tape) -> Tape:
    if tape.text.isascii() or FOLDED.keys().isdisjoint(tape.text):
        return tape
    return tape.rewrite((i, i + 1, FOLDED[c]) for i, c in enumerate(tape.text) if c in FOLDED)


_NUMBER = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_DOT = "dot|punkt|point|punto"
_AT = "at|arroba|arobase"
SPELLED = re.compile(rf"(?<![^\W_])(?:plus\s|\+)?(?:{_NUMBER}|[0-9]+)(?:[\s,-]{{1,2}}(?:{_NUMBER}|[0-9]+|double|triple|{_DOT}))+(?![^\W_])")
ONE = re.compile(rf"(?<![^\W_])(?:{_NUMBER})(?![^\W_])")
TOKEN = re.compile(r"[^\W_]+")
#: A number word next to another one or to a digit: without one, no run of spelled digits is rewritten.
_GAP = rf"[^\w]+(?:(?:{_DOT}|double|triple)[^\w]+)*"
TWO = re.compile(rf"\b(?:{_NUMBER}){_GAP}(?:[0-9]|(?:{_NUMBER})\b)|[0-9]{_GAP}(?:{_NUMBER})\b")


def spelled_runs(low: str, short: bool) -> Iterator[tuple[int, int, str]]:
    """Runs of number words and digits, and the digits that they spell: those of four number words or more, or the others."""
    for m in SPELLED.finditer(low):
        tokens = [(t.start() + m.start(), t.end() + m.start(), t[0]) for t in TOKEN.finditer(m[0])]
        n = sum(t[2] in NUMBER_WORDS for t in tokens)
        if n == 0 or (n < 4) != short:
            continue
        out, times = [], 1
        for _, _, word in tokens:
            if word in ("double", "triple"):
                times = 2 + (word == "triple")
                continue
            out.append((NUMBER_WORDS | SIGN_WORDS).get(word, word) * times)
            times = 1
        yield tokens[0][0], tokens[-1][1], "".join(out)


def fold_digits(tape: Tape) -> Tape:
    """Runs of four or more spelled digits (single digits may stand between) become digits; dots between them stay dots.

    Shorter runs do if, with the digits around them, they make a card, ip or phone that does not read as one without them.
    """
    low = lower(tape.text)
    if not TWO.search(low):
        return tape
    tape = tape.rewrite(spelled_runs(low, False))
    low = lower(tape.text)
    runs = [*spelled_runs(low, True)]
    ends = [r[1] for r in runs]
    alone = [(m.start(), m.end(), NUMBER_WORDS[m[0]]) for m in ONE.finditer(low)]
    runs = sorted(runs + [a for a in alone if (k := bisect_right(ends, a[0])) == len(runs) or runs[k][0] > a[0]])
    if not runs:
        return tape
    trial, have = tape.rewrite(runs), plain(tape.text)
    made: list[Span] = []
    for kind, spans in plain(trial.text).items():
        if kind != "email":
            had = [tape.source(*s) for s in have[kind]]
            made += [s for s in (trial.source(*s) for s in spans) if not _meets(had, s)]
    made.sort()
    return tape.rewrite(r for r in runs if _meets(made, tape.source(r[0], r[1])))


def _meets(spans: list[Span], span: Span) -> bool:
    """Whether a span overlaps one of some sorted spans, of which those of one kind do not overlap each other."""
    i = bisect_right(spans, (span[1] - 1, 1 << 62))
    return any(s[1] > span[0] for s in spans[max(0, i - 3) : i])


BRACKETED = re.compile(rf"\s?[\[({{<]\s?({_AT}|{_DOT}|@|\.)\s?[\])}}>]\s?")
AT_SIGN = re.compile(rf"(?<=\s)(?:{_AT})(?=\s)|@")
LABEL = re.compile(rf"(\s(?:{_DOT})\s|\s?\.\s?)([a-z0-9-]+)")
NAME = re.compile(r"[a-z0-9-]+")
DOT_WORD = re.compile(rf"\s(?:{_DOT})\s")
DOT_BEFORE = re.compile(rf"\s(?:{_DOT})\s\Z")
LOCAL_PART = LOCAL - {"."}


def local_start(low: str, end: int, least: int) -> int:
    """Where the local part that ends at end starts: names joined by dots or by dot words. end if there is none."""
    start = end
    while True:
        at = start
        if start < end:  # a joint before the names found so far
            if at > least and low[at - 1] == ".":
                at -= 1
            elif m := DOT_BEFORE.search(low, max(least, at - 8), at):
                at = m.start()
            else:
                return start
        name = at
        while name > least and low[name - 1] in LOCAL_PART:
            name -= 1
        if name == at:
            return start
        start = name


def addresses(tape: Tape, low: str) -> Iterator[list[tuple[int, int, str]]]:
    """The signs of each address with a written or spaced sign, as parts to rewrite.

    The domain ends with its last label that is a top-level domain. With a real or a bracketed sign any other label will do
    as well, unless it comes after a real dot with a space at it or after a whole address. A sentence that ends ends the address.
    """
    n, done = len(low), 0
    for m in AT_SIGN.finditer(low):
        (left, right), word = m.span(), m[0] != "@"
        if left < done:
            continue
        left -= left > done and low[left - 1].isspace()
        right += right < n and low[right].isspace()
        name = NAME.match(low, right)
        label = LABEL.match(low, name.end()) if name else None
        start = local_start(low, left, done) if label else left
        if start == left:
            continue
        strong = not word or any(low[i] == "." and tape.is_new(i) for i in range(start, left))
        signs, upto, whole, end = [(left, right, "@")], 0, False, None
        while label:
            sign = label[1].strip()
            joined, spaced = label[1] == ".", sign == "." and label[1] != "."
            strong = strong or (joined and tape.is_new(label.start()))
            if spaced and (not strong or (whole and label[1][0] == ".")):
                break
            signs.append((*label.span(1), "."))
            known = label[2] in TLDS
            if known or (strong and (joined or not (spaced or whole))):
                end, upto = label.end(), len(signs)
            whole = whole or joined or known
            label = LABEL.match(low, label.end())
        if end is not None:
            done = end
            yield [(start + d.start(), start + d.end(), ".") for d in DOT_WORD.finditer(low[start:left])] + signs[:upto]


def fold_signs(tape: Tape) -> Tape:
    """Bracketed at and dot become signs anywhere, others in an address."""
    if any(b in tape.text for b in "[({<"):
        tape = tape.rewrite((m.start(), m.end(), SIGN_WORDS.get(m[1], m[1])) for m in BRACKETED.finditer(lower(tape.text)))
    return tape.rewrite(s for signs in addresses(tape, lower(tape.text)) for s in signs if tape.text[s[0] : s[1]] != s[2])


TRANSDUCERS = (fold_lookalikes, fold_digits, fold_signs)

# ---- both together


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows: those that lie in no plain span of their kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    tape = Tape(text)
    for fold in TRANSDUCERS:
        tape = fold(tape)
    if tape.text == text:
        return out
    for kind, spans in plain(tape.text).items():
        for s in spans:
            start, end = tape.source(*s)
            if text[start:end] != tape.text[s[0] : s[1]] and not _within(base[kind], start, end):
                out[kind].append((start, end))
    return out


def _within(spans: list[Span], start: int, end: int) -> bool:
    i = bisect_right(spans, (start, 1 << 62))
    return i > 0 and spans[i - 1][1] >= end


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and all spans in order of their start, of each kind."""
    text = text or ""
    base = plain(text)
    more = disguised(text, base)
    return base, {k: sorted(base[k] + more[k]) if more[k] else base[k] for k in KINDS}


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (plain spans), spans (all), n_spans of every row of docs (doc_id, text).

    Counts by kind are of plain spans; n_spans is of all. Other columns are not read. A null or empty text has no spans, whole
    texts of any length are read in linear time, repeated rows give repeated results, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find(text)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), sum(map(len, spans.values()))))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.int64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")

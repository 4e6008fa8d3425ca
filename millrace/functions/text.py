"""Text functions: normal forms, canonical JSON, match ranges and snippets and n-grams (vectorized)."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType

MAX_RANGES, SNIPPET_CHARS = 20, 240


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def canonical_body(text: pd.Series) -> pd.Series:
    """CRLF to LF, then normal form C."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n")))


def _canonical(value):
    if isinstance(value, str):
        return unicodedata.normalize("NFKC", value)
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, dict):
        return {_canonical(k): _canonical(v) for k, v in value.items()}
    return value


def canonical_json_text(text: str | None) -> str | None:
    """Keys sorted, strings in normal form KC, no white space; null for what is not JSON."""
    try:
        return None if text is None else json.dumps(_canonical(json.loads(text)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(canonical_json_text)


def canonical_array(values: Column) -> Column:
    """JSON text of an array of strings, sorted and without repeats."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def split_terms(pattern: str) -> list[str]:
    """One term is the whole pattern as it stands; terms are parted by space, tab and ideographic space."""
    terms = [t for t in re.split("[ \t　]", pattern) if t]
    return terms if len(terms) > 1 else [pattern]


#: POSIX classes, and what they are in Java's and in Python's extended dialect.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t\\x20", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": "\\x20-~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r\\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_ESCAPE = re.compile(r"\\(?:[pP](?:\{\^?[\w=:. -]+\}|[A-Za-z])|x(?:[0-9A-Fa-f]{2}|\{[0-9A-Fa-f]+\})|u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\})|U(?:[0-9A-Fa-f]{8}|\{[0-9A-Fa-f]+\})|[dDsSwWbBAzntrafv]|[^0-9A-Za-z<>])", re.S)
_GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([imsxu-]*)([:)]))")
_REPEAT = re.compile(r"(?:[*+?]|\{\d*(?:,\d*)?\})\??")


def _escape(token: str, java: bool) -> str:
    kind = token[1]
    if kind in "xuU" and len(token) > 2:
        code = int(token[2:].strip("{}"), 16)
        return f"\\x{{{code:x}}}" if java else re.escape(chr(code))
    return {"v": r"\x0B", "a": r"\x07", "z": r"\z" if java else r"\Z"}.get(kind, token)


def translate(pattern: str, java: bool = True) -> str:
    """A pattern in the syntax that searches take (linear-time: no look-around, back-references, atomic groups or possessive
    repeats; POSIX classes in brackets), in Java's dialect or in that of Python's regex module; a ValueError for any other."""
    bad = ValueError(f"not a valid pattern: {pattern}")
    out, i, depth, names, lines = [], 0, 0, {}, re.search(r"\(\?[a-z]*m", pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            m = _ESCAPE.match(pattern, i)
            if not m or depth and m[0][1] in "bBAz":
                raise bad
            out.append(_escape(m[0], java))
            i = m.end()
        elif depth and pattern.startswith("[:", i) and (m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)) and m[2] in POSIX:
            out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
            i = m.end()
        elif c == "[":
            depth += 1
            m = re.compile(r"\[\^?\]?").match(pattern, i)
            out.append(m[0].replace("]", r"\]"))
            i = m.end()
        elif depth:
            depth -= c == "]"
            out.append(c if c != "^" or out[-1].endswith("[") else r"\^")
            i += 1
        elif c == "(" and pattern.startswith("(?", i):
            m = _GROUP.match(pattern, i)
            if not m:
                raise bad
            if m[1]:
                names.setdefault(m[1], f"n{len(names)}")
                out.append(f"(?<{names[m[1]]}>")
            else:
                flags = m[2].replace("u", "") if m[2] != "-" else ""
                out.append(f"(?{flags}{m[3]}" if flags or m[3] == ":" else "")
            i = m.end()
        elif c == "$":
            out.append("$" if lines else r"\z" if java else r"\Z")
            i += 1
        elif m := _REPEAT.match(pattern, i):
            if i == 0 or _REPEAT.match(pattern, m.end()):  # nothing to repeat, or possessive
                raise bad
            out.append(m[0])
            i = m.end()
        else:
            out.append(c)
            i += 1
    if depth:
        raise bad
    return "".join(out)


def is_portable(pattern: str) -> bool:
    """Whether a pattern is one that searches take."""
    import regex

    try:
        regex.compile(translate(pattern, java=False), regex.V1)
    except (ValueError, regex.error):
        return False
    return True


def java_pattern(pattern: str) -> str:
    """For rlike: classes and boundaries of all scripts, and lines that end at \\n alone, where the pattern has any."""
    return ("(?Ud)" if re.search(r"\\[dwsbDWSB]|\(\?[a-z]*[ims]", pattern) else "(?d)" if re.search(r"[.^$]", pattern) else "") + translate(pattern)


def term_matches(text: Column, term: str, several: bool) -> Column:
    """A regular expression, or, among several terms, the literal text of one that is not valid."""
    if is_portable(term):
        return text.rlike(java_pattern(term))
    if several:
        return text.contains(term)
    raise ValueError(f"not a valid pattern: {term}")


def matches(text: Column, pattern: str) -> Column:
    terms = split_terms(pattern)
    found = term_matches(text, terms[0], len(terms) > 1)
    for t in terms[1:]:
        found = found & term_matches(text, t, True)
    return found


def _compiled(pattern: str) -> list:
    import regex

    terms = split_terms(pattern)
    return [regex.compile(translate(t, java=False) if is_portable(t) else regex.escape(t), regex.V1) for t in terms]


def char_ranges(text: str, patterns: list) -> list[tuple[int, int]]:
    """All matches, sorted by start and end, each once."""
    return sorted({m.span() for p in patterns for m in p.finditer(text)})


def snippet_of(raw: str, hit: int, size: int = SNIPPET_CHARS) -> str:
    """size characters with the hit in the middle, as far as the text goes; ... stands for what is cut off and counts in the size."""
    n, one, two = len(raw), size - 3, size - 6  # what is left beside one mark, and beside two
    if n <= size:
        return raw
    hit = min(hit, n - 1)
    if hit <= one // 2:
        return raw[:one] + "..."
    if hit - one // 2 + one >= n:
        return "..." + raw[n - one :]
    start = hit - two // 2
    return f"...{raw[start : start + two]}..."


MATCHED = "ranges array<struct<start: int, end: int>>, snippet string"


def matched(pattern: str, raw: int, searched: int, size: int = SNIPPET_CHARS):
    """A function over Arrow batches that adds ranges and snippet (MATCHED) to rows, in one search of each; raw and searched are places of text columns.

    ranges are the first MAX_RANGES matches as UTF-8 byte ranges of the searched text; the snippet is a piece of the raw
    text around the first match. Null where the text is null.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _compiled(pattern)
        for batch in batches:
            ranges, snippets = [], []
            for r, s in zip(batch.column(raw).to_pylist(), batch.column(searched).to_pylist(), strict=True):
                spans = [] if s is None else char_ranges(s, patterns)[:MAX_RANGES]
                places = spans if s is None or s.isascii() else [(len(s[:a].encode()), len(s[:b].encode())) for a, b in spans]
                ranges.append(None if s is None else [{"start": a, "end": b} for a, b in places])
                snippets.append(None if r is None else snippet_of(r, spans[0][0] if spans else 0, size))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges, kind), pa.array(snippets, pa.string())], [*batch.schema.names, "ranges", "snippet"])

    return found


NGRAM_CHARS = 1 << 19  # characters of texts whose n-grams are Python strings at a time


@arrow_udf(ArrayType(StringType()))
def _ngrams(text: pa.Array, width: pa.Array) -> pa.Array:
    """Strings of a few texts at a time are made and given to Arrow, so that a batch's n-grams are never all Python objects."""
    kind = pa.list_(pa.string())
    done, some, held = [], [], 0
    for value, n in zip(text, width, strict=True):
        t, n = value.as_py(), n.as_py()
        some.append(None if t is None else sorted({t[i : i + n] for i in range(len(t) - n + 1)}))
        held += len(t or "")
        if held >= NGRAM_CHARS:
            done.append(pa.array(some, kind))
            some, held = [], 0
    return pa.concat_arrays([*done, pa.array(some, kind)])


def ngrams(text: Column, least: int = 1, most: int = 3) -> Column:
    """Distinct n-grams of least to most characters, in linear time (built-in substring would scan from the start for each)."""
    return F.flatten(F.array(*[_ngrams(text, F.lit(n)) for n in range(least, most + 1)]))


def literal_ngrams(term: str, width: int = 3) -> list[str]:
    """n-grams that every match of a term holds; none if it has a metacharacter."""
    if not term or re.search(r"[\\.+*?()|\[\]{}^$]", term):
        return []
    n = min(width, len(term))
    return sorted({term[i : i + n] for i in range(len(term) - n + 1)})

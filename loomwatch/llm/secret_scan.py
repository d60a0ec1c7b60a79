"""Secret scans: named patterns, and sliding-window entropy over candidate strings.

Three named kinds are found by pattern. All strings of token characters, those in named spans too, are read through
a window of ``WINDOW`` characters; the window's Shannon entropy follows from counts that change by
one character in and one out, and the windows over the threshold of the string's character class
(hex, alphanumeric or base64) form the span. Strings on the allow-list are left out. A named span
that entropy confirms is told twice, under both kinds. One row in, one row out, in time linear in the text; nothing is shuffled.

Letters alone are allowed where they read as words: in one case, capitalised, or joined words of
that kind of four letters a word on average. Letters of mixed case that don't are candidates.

Defined cases: a null or empty text has no spans; positions count code points, ends exclusive;
repeated rows come back alike; an empty table stays empty; an input column named like the added one
is replaced, all others are returned as they are.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.names import col

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character in a window of 20, by character class.
THRESHOLDS = {"hex": 3.1, "alnum": 3.75, "base64": 3.85}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/=_-]+")))
#: Allow-list: whole strings that look random and are no secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9+/=_-]+"),  # numbers, dates, rules
    re.compile(r"[a-z+/=_-]+|[A-Z+/=_-]+"),  # words and paths of one case
    re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/](?:[A-Za-z]+|[0-9]+))+"),  # slugs
    re.compile(r".*(?:EXAMPLE|example|XXXX|xxxx).*"),  # placeholders
)
_LETTERS = re.compile(r"[A-Za-z+/=_-]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def allowed(candidate: str) -> bool:
    """Whether a candidate stands on the allow-list."""
    if any(p.fullmatch(candidate) for p in ALLOWED):
        return True
    if not _LETTERS.fullmatch(candidate):
        return False
    words = _WORD.findall(candidate)  # camel case and capitalised words
    return sum(map(len, words)) >= 4 * len(words)


_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_spans(text: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """The unions of the windows whose entropy reaches ``threshold`` bits a character."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    log_window = _TERM[window] / window
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
        if i >= window - 1 and log_window - total / window >= threshold:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then by the order of KINDS."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        word = m[0]
        if allowed(word):
            continue
        kind = next(k for k, p in _CLASSES if p.fullmatch(word))
        for start, end in entropy_spans(word, THRESHOLDS[kind]):
            found.append(("entropy", start + m.start(), end + m.start()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``spans_col``, array<struct<kind, start, end>>."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, kind)

    return docs.withColumn(spans_col, scan(col(text_col)))

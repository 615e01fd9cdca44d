"""Secret scan: pattern spans plus assignment-aware lexing of source and configuration syntax.

The lexer reads ``name op value`` pairs (``=``, ``:``, ``=>``, ``:=``), where a value is a chain of
string literals, bare literals and names joined by ``+``. Constants are propagated through a symbol
table in reading order, so ``a = "..."`` followed by ``db_password = a`` reports the literal that was
assigned to ``a``. A literal is scored by how sensitive its target's name is and by how random it
looks; spans that reach the threshold have kind ``literal``.

A constant holds the literals of its own line and points to the constants it was made from, and each is
visited once for a weight, so long chains of constants cost no more than their lines. An escaped quote outside of
a string begins none, so that a line of many is still read once.

Defined cases: null or empty text gives no spans; repeated rows give repeated results; positions
count code points; whole texts are read, however long; a text's result does not depend on its neighbours;
a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents_only, map_texts, raw_bytes, table

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

#: How sensitive a target's name part is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.8, "auth": 0.7, "access": 0.6, "key": 0.5, "bearer": 0.9, "signature": 0.6, "salt": 0.5, "cookie": 0.5, "session": 0.4,
}
THRESHOLD = 1.0
#: Shortest literal, and shortest of letters alone.
MIN_LITERAL, MIN_WORD = 8, 16

TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<op>:=|=>|==|!=|<=|>=|=|:)
      |(?P<plus>\+)
      |(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)
      |(?P<bare>[A-Za-z0-9+/_=.-]+)
      |(?P<eol>[\n;,{}()])
      |(?P<other>\\.|[^\s])""",
    re.VERBOSE,
)
UNQUOTED = re.compile(r"[A-Za-z0-9+/_=.-]+")
#: Only lines with an assignment sign can hold a pair.
PAIR_SIGN = re.compile(r"[:=]")
ASSIGNING = {"=", ":", "=>", ":="}


def sensitivity(name: str) -> float:
    """The weight of the most sensitive part of a name (``dbPassword`` and ``db.password`` alike)."""
    parts = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    joined = ["_".join(p) for p in zip(parts, parts[1:], strict=False)] + ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def randomness(value: str) -> float:
    """Shannon entropy in bits a character over 4, plus credit for mixed digits and letters: 0 to about 1.5."""
    if not value:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return entropy / 4 + 0.25 * mixed


class Constant:
    """What a name was given: literals (start, end) of its own, and other constants; with the largest weight reported."""

    def __init__(self):
        self.literals: list[tuple[int, int]] = []
        self.uses: list[Constant] = []
        self.told = 0.0

    def report(self, text: str, weight: float, found: set) -> None:
        """Adds the literals that reach the threshold under a target of this weight."""
        open_ones = [self]
        while open_ones:
            one = open_ones.pop()
            if one.told >= weight:
                continue
            one.told = weight
            open_ones.extend(one.uses)
            for a, b in one.literals:
                if b - a >= MIN_LITERAL and (a, b) not in found:
                    value = text[a:b]
                    if len(value) >= (MIN_WORD if value.isalpha() else MIN_LITERAL) and weight + randomness(value) - 0.5 >= THRESHOLD:
                        found.add((a, b))


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Spans of the literals that reach a sensitive target, directly or through constants."""
    found: set[tuple[int, int]] = set()
    constants: dict[str, Constant] = {}
    at = 0
    while (sign := PAIR_SIGN.search(text, at)) is not None:
        start = text.rfind("\n", 0, sign.start()) + 1
        start = max(start, at)
        end = text.find("\n", sign.start())
        end = len(text) if end < 0 else end
        _read_line(text, start, end, constants, found)
        at = end + 1
    return found


def _read_line(text: str, start: int, end: int, constants: dict, found: set) -> None:
    target, op, value, wanted, skip = None, False, Constant(), False, start

    def close() -> None:
        if target and op and (value.literals or value.uses):
            constants[target] = value
            value.report(text, sensitivity(target), found)

    for m in TOKEN.finditer(text, start, end):
        if m.start() < skip:
            continue
        kind, word = m.lastgroup, m.group()
        if kind == "op" and word in ASSIGNING:
            close()
            op, value, wanted = target is not None, Constant(), target is not None
        elif kind == "plus":
            wanted = op
        elif kind in ("string", "bare", "name") and wanted:
            wanted = False
            if kind == "string":
                value.literals.append((m.start() + 1, m.end() - 1))
            elif word in constants:
                value.uses.append(constants[word])
            else:
                skip = UNQUOTED.match(text, m.start(), end).end()
                value.literals.append((m.start(), skip))
        elif kind in ("string", "bare", "name"):
            close()
            target, op, value = (word.strip("\"'") if kind != "bare" else None), False, Constant()
        elif kind == "eol":
            close()
            target, op, value, wanted = None, False, Constant(), False
        elif not op:
            target = None
    close()


def scan(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind."""
    out = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGNED],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m.group()) >= MIN_ACCESS],
        "hex": [m.span() for m in HEX.finditer(text)],
    }
    out["literal"] = sorted(literal_spans(text))
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    rows = sorted((a, k, b) for k, kind in enumerate(kinds) for a, b in spans[kind])
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in rows)


_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def _promising(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a span at all: an assignment sign, AKIA or 16 hexadecimal digits in a row."""
    n = len(offsets) - 1
    hit = np.zeros(n, bool)
    if not len(data):
        return hit
    for at in (np.flatnonzero((data == 58) | (data == 61)), _access(data)):
        hit[np.searchsorted(offsets, at, side="right") - 1] = True
    # a gap behind each row, so that no run of digits goes on into the next
    apart = np.zeros(len(data) + n, bool)
    apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _HEX[data]
    hit[np.searchsorted(offsets + np.arange(n + 1), _runs(apart, 16), side="right") - 1] = True
    return hit


def _access(data: np.ndarray) -> np.ndarray:
    """Places where AKIA begins."""
    hit = np.flatnonzero(data[:-3] == 65) if len(data) > 3 else np.zeros(0, np.int64)
    for k, byte in enumerate(b"KIA", 1):
        hit = hit[data[hit + k] == byte]
    return hit


def _runs(flags: np.ndarray, least: int) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts[ends - starts >= least]


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans and all spans as text."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = raw_bytes(part.column("text"))
            rows = []
            empty = hashlib.sha256(b"").hexdigest()
            for i, maybe in enumerate(_promising(data, offsets)):
                if not maybe:
                    rows.append((0, 0, 0, 0, empty, ""))
                    continue
                spans = scan(part.column("text")[i].as_py())
                base = joined(spans, KINDS[:3])
                rows.append((*(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans, KINDS)))
            cols = list(zip(*rows, strict=True))
            arrays = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

        return work

    return map_texts(documents_only(docs), RESULT, build)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))

"""Secret scans: a keyword automaton, anchored patterns near its hits, checksums inside the matches.

Rules.  Null text counts as empty, an empty text has no spans, whole texts are
read whatever their length, repeated rows are scanned each on its own, an empty
table gives an empty table, a null id is carried as it is.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import slices, text_column

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "registry", "card", "iban")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_FORGE = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_REGISTRY = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_CARD = re.compile(r"card[^0-9\n]{0,24}?((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I | re.A)
_IBAN = re.compile(r"(?i:iban)[^A-Z0-9\n]{0,8}?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])", re.A)
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True


def checksum_matches(body: str, tail: str) -> bool:
    """The last six characters are the base-62 CRC-32 of the ones before."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(6, "0") == tail


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0


def mod97(account: str) -> bool:
    s = account.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        a.add_word(word, ("assign", len(word)))
    for word, kind in (("akia", "access"), ("npm_", "registry"), ("card", "card"), ("iban", "iban")):
        a.add_word(word, (kind, len(word)))
    for c in "pousr":
        a.add_word(f"gh{c}_", ("forge", 4))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()
_FREE = 1 << 62


def _fold(text: str) -> str:
    """A-Z lowered and nothing else, so that positions stay."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def scan(text: str, may_have_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of every secret, in order."""
    found: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _AUTOMATON.iter(_fold(text)))
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign" and (m := _ASSIGN.match(text, at)):
            free[kind] = m.end()
            if len(m[1]) >= 6:
                found.append((at, 0, m.end()))
        elif kind == "access" and (m := _ACCESS.match(text, at)):
            free[kind] = m.end()
            if m.end() - at >= 20:
                found.append((at, 1, m.end()))
        elif kind in ("forge", "registry") and (m := (_FORGE if kind == "forge" else _REGISTRY).match(text, at)) and checksum_matches(m[1], m[2]):
            free[kind] = m.end()
            found.append((at, KINDS.index(kind), m.end()))
        elif kind == "card" and (m := _CARD.match(text, at)) and luhn(m[1]) or kind == "iban" and (m := _IBAN.match(text, at)) and mod97(m[1]):
            free[kind] = m.end(1)
            found.append((m.start(1), KINDS.index(kind), m.end(1)))
    if may_have_hex:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _hex_runs(piece) -> set[int]:
    """Documents of a slice with 24 hexadecimal digits in a row (bytes of neighbours may join; the pattern decides)."""
    edge = np.diff(np.concatenate([[0], _IS_HEX[piece.data].astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = start[end - start >= 24], end[end - start >= 24]
    docs: set[int] = set()
    for s, e in zip(*long):
        docs.update(range(int(np.searchsorted(piece.bounds, s, "right")) - 1, int(np.searchsorted(piece.bounds, e - 1, "right"))))
    return docs


def scan_column(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    column = text_column(column)
    out: list[list[tuple[int, int, int]]] = []
    for piece in slices(column):
        hexes = _hex_runs(piece)
        out += [scan(t, i in hexes) for i, t in enumerate(column.slice(piece.first, len(piece)).to_pylist())]
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, secrets): every span of every whole text.  Other columns of docs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in scan_column(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[id_col, "secrets"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.dtypes[0][1]}, secrets {SPANS}")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[{kind}]", length_col: str | None = None) -> DataFrame:
    """docs with every secret replaced by its kind's mark; overlapping spans are replaced as one, by the first kind.

    Rows without a secret, null texts included, stay as they are.  length_col, if
    given, gets the new code point count of the texts that changed.
    """
    columns = docs.columns
    at, to = columns.index(text_col), None if length_col is None else columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = scan_column(b.column(at))
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                texts = b.column(at).to_pylist()
                for i in hit:
                    texts[i] = _redacted(texts[i], spans[i], mark)
                arrays = list(b.columns)
                arrays[at] = pa.array(texts, b.column(at).type)
                if to is not None:
                    lengths = b.column(to).to_pylist()
                    for i in hit:
                        lengths[i] = len(texts[i])
                    arrays[to] = pa.array(lengths, b.column(to).type)
                b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], mark.format(kind=KINDS[k])]
        done = max(done, e)
    return "".join([*out, text[done:]])

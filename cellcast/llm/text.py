"""Texts inside a task: bounded groups of texts, and the words of a group as 64-bit hashes.

``hashed_words`` works on the UTF-8 bytes of a whole group at once: a word's hash is a difference of
prefix sums, so no word becomes a Python object. Memory follows the group, not the batch or the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters worked on at once: arrays over them stay in the cache, and workers small.
GROUP_CHARS = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.arange(256)
# Classes of bytes; a word is a run of one class other than 0. LETTERED: ASCII letters, digits and any
# other script. RUNS: the same, and runs of signs between them as words of their own.
_BLANK = (_BYTES <= 0x20) | (_BYTES == 0x7F)
LETTERED = (((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
            | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)).astype(np.int8)
RUNS = np.where(_BLANK, 0, np.where(LETTERED == 1, 1, 2)).astype(np.int8)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def row_key(*columns: str) -> Column:
    """64-bit key of a row; rows that agree in ``columns`` (nulls included) share it."""
    marks = [F.col(c).isNull() for c in columns]
    return F.xxhash64(*columns, *marks)


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def remainder_of_id(column: str, divisor: int) -> Column:
    """``crc32`` of the id as text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def groups(texts: Iterable[str | None], limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts (null as empty) of at most ``limit`` characters together, or one longer text."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, np.uint64(base), dtype=np.uint64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        if size > 1 << 22:
            return tables[0], tables[1]
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def _hash_bytes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(np.diff(inside))
    word = inside[edges[:-1] + 1] != 0 if len(edges) else np.zeros(0, dtype=bool)
    starts, ends = edges[:-1][word], edges[1:][word]
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts


def pieces(text: str, limit: int = GROUP_CHARS) -> Iterator[str]:
    """``text`` cut at white space into pieces of about ``limit`` characters; no word is cut."""
    start = 0
    while len(text) - start > limit:
        cut = min((i for c in " \n\t" if (i := text.find(c, start + limit)) >= 0), default=-1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def hashed_words(texts: list[str], table: np.ndarray = LETTERED, lower: bool = True
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one more entry
    marks the end). Texts without a word have an empty range."""
    if len(texts) == 1 and len(texts[0]) > 2 * GROUP_CHARS:
        parts = [hashed_words([p], table, lower)[0] for p in pieces(texts[0])]
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts)
    data = np.frombuffer((joined.lower() if lower else joined).encode("utf-8", "surrogatepass"),
                         dtype=np.uint8)
    hashes, starts = _hash_bytes(data, table)
    bounds = np.searchsorted(starts, np.flatnonzero(data == 0))
    return hashes, np.concatenate(([0], bounds, [len(hashes)])).astype(np.int64)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores put before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base

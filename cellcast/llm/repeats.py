"""Repeated byte strings by longest-previous-factor arrays over a suffix order dealt out by content.

A *start* is a place in a text at which a whole string of ``length`` bytes begins. Starts are dealt out by the
smallest hash of the shorter strings inside their own string, so equal strings meet whatever text they are in.
Consecutive starts with one such key are a *run*: one row, not ``n``. Equal runs are counted, not compared. Only
runs that share a key and differ, or hold it twice, are brought together: their suffixes (cut at ``length``, beyond which nothing
changes) are sorted, and previous and next smaller places in that order give each start's earlier match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.text import free_name, mixed, power_tables, row_key
from cellcast.shared import checkpointed, small

LENGTH = 200
# Starts of one key that a task sorts together, at most; a larger group is dealt again by longer keys.
GROUP_STARTS = 1 << 17
# Starts hashed at once inside a task, and starts of one run at most.
PART_STARTS, RUN_STARTS = 1 << 17, 1 << 12

_PLACES = "key long, seg long, row long, start long, n int, looped boolean, copies long"
_RANGES = "row long, low long, n int"


def key_lengths(length: int) -> list[int]:
    """Bytes of the strings that deal out the starts, shortest first. The last is the whole string: a
    group under it holds equal strings only, however many they are, and those are counted."""
    return sorted({max(1, length * part // 100) for part in (32, 75, 95)} | {length})


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values: block minima from the left and from the right."""
    if width == 1:
        return values
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(right[:count], left[width - 1:width - 1 + count])


def _looped(own: np.ndarray, least: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray,
            width: int) -> np.ndarray:
    """Runs whose key stands at two places of their own, without which no string of theirs repeats inside."""
    around = np.zeros(width - 1, dtype=np.uint64)
    most = ~_least_of(~np.concatenate((around, least, around)), width)
    at = np.flatnonzero(most == own)
    values, of = np.unique(own[at], return_inverse=True)
    places = np.sort(of * len(own) + at)
    base = np.searchsorted(values, keys) * len(own)
    return np.searchsorted(places, base + high, side="right") - np.searchsorted(places, base + low) > 1


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, key_bytes: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, name, first start, number of starts of every run of the texts ``data[begin:end]``, and whether
    its key stands in it twice."""
    count = len(data) - length + 1
    if count <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none.astype(bool)
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    own = mixed((sums[key_bytes:] - sums[:-key_bytes]) * inverse[:len(data) - key_bytes + 1])
    least = _least_of(own, length - key_bytes + 1)
    inside = np.zeros(count + 1, dtype=np.int32)
    whole = ends - begins >= length
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    inside = np.cumsum(inside[:count]) > 0
    edge = np.ones(count, dtype=bool)
    edge[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    edge[begins[whole]] = True
    first = np.flatnonzero(edge & inside)
    stops = np.append(np.flatnonzero(edge | ~inside), count)
    n = stops[np.searchsorted(stops, first, side="right")] - first
    if len(n) and n.max() > RUN_STARTS:
        pieces = -(-n // RUN_STARTS)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, n = np.repeat(first, pieces) + step * RUN_STARTS, np.repeat(n, pieces) - step * RUN_STARTS
        n = np.minimum(n, RUN_STARTS)
    last = first + n + length - 1
    name = mixed((sums[last] - sums[first]) * inverse[first] + mixed(n.astype(np.uint64)))
    twice = _looped(own, least, least[first], first, last - key_bytes, length - key_bytes + 1)
    return least[first], name, first, n, twice


def _parts(texts: pd.Series, length: int, limit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts and pieces of long ones as (row, offset, bytes), grouped to about ``limit`` bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, limit):
            piece = text[offset:offset + limit + length - 1]
            if held and size + len(piece) > limit:
                yield held
                held, size = [], 0
            held.append((row, offset, piece))
            size += len(piece)
    if held:
        yield held


def _places(units: DataFrame, length: int, key_bytes: int, limit: int) -> DataFrame:
    """The runs of all units (``row``, ``copies``, ``bytes``)."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, copies = batch["row"].to_numpy(), batch["copies"].to_numpy()
            for part in _parts(batch["bytes"], length, limit):
                sizes = np.array([len(piece) for _, _, piece in part])
                ends = np.cumsum(sizes)
                data = np.frombuffer(b"".join(piece for _, _, piece in part), dtype=np.uint8)
                key, name, first, n, twice = runs(data, ends - sizes, ends, length, key_bytes)
                at = np.searchsorted(ends, first, side="right")
                of = np.array([row for row, _, _ in part])[at]
                start = first - (ends - sizes)[at] + np.array([offset for _, offset, _ in part])[at]
                yield pd.DataFrame({"key": key.view(np.int64), "seg": name.view(np.int64), "row": rows[of],
                                    "start": start, "n": n.astype(np.int32), "looped": twice, "copies": copies[of]})
    return units.where(F.octet_length("bytes") >= length).select(
        "row", "copies", "bytes").mapInPandas(find, _PLACES)


def _nearest_smaller(at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the nearest one before it that is smaller (-1: none), and the least of ``shared``
    between. All elements jump together: what a larger neighbour skipped, one may skip as well."""
    to, least = np.arange(-1, len(at) - 1), shared.copy()
    value = np.append(at, -1)
    open_ = np.flatnonzero(value[to] > at)
    while len(open_):
        over = to[open_]
        least[open_] = np.minimum(least[open_], least[over])
        to[open_] = to[over]
        open_ = open_[value[to[open_]] > at[open_]]
    return to, least


def previous_factors(suffixes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest match with an earlier row of the same group, and that row (-1: none).

    ``suffixes`` holds one suffix a row, cut to equal length, in the order of their places.
    """
    count, width = suffixes.shape
    keyed = np.empty((count, width + 8), dtype=np.uint8)
    keyed[:, :8] = group.astype(">u8").view(np.uint8).reshape(count, 8)
    keyed[:, 8:] = suffixes
    order = np.argsort(keyed.view(f"S{width + 8}").ravel(), kind="stable")
    keyed = keyed[order]
    shared = np.zeros(count, dtype=np.int64)
    if count > 1:
        differ = keyed[1:] != keyed[:-1]
        shared[1:] = np.where(differ.any(axis=1), np.maximum(differ.argmax(axis=1) - 8, 0), width)
    before, left = _nearest_smaller(order, shared)
    after, right = _nearest_smaller(order[::-1], np.append(shared[1:], 0)[::-1])
    after, right = np.where(after < 0, -1, count - 1 - after)[::-1], right[::-1]
    left, right = np.where(before < 0, 0, left), np.where(after < 0, 0, right)
    longest, source = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
    longest[order] = np.maximum(left, right)
    chosen = np.where(left >= right, before, after)
    source[order] = np.where(np.maximum(left, right) > 0, order[chosen], -1)
    return longest, source


def _matches(length: int, keep_first: bool, limit: int):
    def matched(rows: pd.DataFrame) -> pd.DataFrame:
        """Ranges of starts of whole groups that have an earlier match, or without ``keep_first`` any."""
        n = rows["n"].to_numpy(np.int64)
        size = n + length - 1
        data = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
        of = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[(np.cumsum(size) - size)[of] + offset]
        group = np.unique(rows["key"].to_numpy(), return_inverse=True)[1]
        longest, source = previous_factors(suffixes, group[of])
        hit = longest >= length
        if not keep_first:
            hit[source[hit]] = True
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        cut = np.zeros(len(of) + 1, dtype=bool)
        cut[np.cumsum(n)[:-1]] = True
        both = np.flatnonzero(cut[1:-1] & hit[1:] & hit[:-1]) + 1 if len(of) > 1 else np.zeros(0, dtype=np.int64)
        low = np.sort(np.concatenate((np.flatnonzero(edge == 1), both)))
        high = np.sort(np.concatenate((np.flatnonzero(edge == -1), both)))
        return pd.DataFrame({"row": rows["row"].to_numpy()[of[low]],
                             "low": rows["start"].to_numpy()[of[low]] + offset[low],
                             "n": (high - low).astype(np.int32)})

    def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups of rows sorted by key, about ``limit`` starts at once."""
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch["key"].to_numpy())) + 1
            weight = np.cumsum(batch["n"].to_numpy(np.int64))
            begin = 0
            for end in [*edges, len(batch)]:
                # The rows from ``begin`` on are looked at again once their group may be complete.
                new_group = end < len(batch)
                if new_group and size + weight[end - 1] - (weight[begin - 1] if begin else 0) > limit:
                    yield matched(pd.concat([*held, batch.iloc[begin:end]], ignore_index=True))
                    held, size, begin = [], 0, end
            if begin < len(batch):
                rest = batch.iloc[begin:]
                if held and size > limit and held[-1]["key"].iloc[-1] != rest["key"].iloc[0]:
                    yield matched(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                held.append(rest)
                size += int(rest["n"].sum())
        if held:
            yield matched(pd.concat(held, ignore_index=True))
    return of_groups


def _repeated(units: DataFrame, order: DataFrame | None, length: int, keys: list[int], keep_first: bool,
              group_starts: int, part_starts: int) -> DataFrame:
    """Ranges (``row``, ``low``, ``n``) of the starts of ``units`` that have another, or an earlier, match.

    ``order`` gives each unit's place (``row``, ``at``) where the first match is to be kept.
    """
    places = _places(units, length, keys[0], part_starts)
    known = checkpointed(places.groupBy("key").agg(
        F.sum("copies").alias("_c"), F.min("seg").alias("_low"), F.max("seg").alias("_high"),
        F.max("looped").alias("_twice")).where("_c > 1 OR _twice").select(
        "key", (F.col("_twice") | (F.col("_low") != F.col("_high"))).alias("mixed")))
    found = places.drop("looped").join(known, "key")
    place: list[Column] = [F.col("row"), F.col("start")]
    if order is not None:
        found, place = found.join(order, "row"), [F.col("at"), *place]
    found = checkpointed(found)
    segs = found if keep_first else found.where("mixed")
    segs = checkpointed(segs.groupBy("key", "seg").agg(
        F.min(F.struct(*place)).alias("first"), F.first("n").alias("n"), F.sum("copies").alias("copies"),
        F.first("mixed").alias("mixed")).select(
        "key", "seg", "first", F.col("first.row").alias("row"), F.col("first.start").alias("start"), "n",
        "copies", "mixed"))
    own = segs.select("key", "seg", F.col("row").alias("_row"), F.col("start").alias("_start"), "copies")
    if keep_first:
        later = found.drop("copies").join(own, ["key", "seg"]).where(
            (F.col("row") != F.col("_row")) | (F.col("start") != F.col("_start")))
        ranges = later.select("row", F.col("start").alias("low"), "n")
    else:
        often = found.where("mixed").drop("copies").join(own.where("copies > 1"), ["key", "seg"], "left_semi")
        ranges = found.where("NOT mixed").select("row", F.col("start").alias("low"), "n").unionByName(
            often.select("row", F.col("start").alias("low"), "n"))

    contested = segs.where("mixed")
    hot = checkpointed(contested.groupBy("key").agg(F.sum("n").alias("starts")).where(
        F.col("starts") > group_starts).select("key"))
    any_hot = len(keys) > 1 and hot.limit(1).count() > 0
    strings = units.select("row", "bytes").join(contested, "row").withColumn(
        "bytes", F.substring("bytes", F.col("start").cast("int") + 1, F.col("n") + (length - 1)))
    if keep_first:
        strings = strings.dropDuplicates(["key", "seg"])
    if any_hot:
        strings = checkpointed(strings)
    cold = strings.join(small(hot), "key", "left_anti") if any_hot else strings
    ranges = ranges.unionByName(cold.select("key", "first", "row", "start", "n", "bytes").repartition(
        "key").sortWithinPartitions("key", "first").drop("first").mapInPandas(_matches(length, keep_first, part_starts), _RANGES))
    if any_hot:
        inner = strings.join(small(hot), "key", "left_semi").select(
            F.xxhash64("key", "seg").alias("unit"), "row", "start", "first", "copies", "bytes")
        again = _repeated(inner.select(F.col("unit").alias("row"), "copies", "bytes"),
                          inner.select(F.col("unit").alias("row"), F.col("first").alias("at"))
                          if keep_first else None, length, keys[1:], keep_first, group_starts,
                          part_starts)
        ranges = ranges.unionByName(again.withColumnRenamed("row", "unit").join(
            inner.select("unit", "row", "start"), "unit").select(
            "row", (F.col("start") + F.col("low")).alias("low"), "n"))
    return ranges


def _cut(length: int):
    @F.pandas_udf("begins array<long>, ends array<long>, kept binary")
    def cut(texts: pd.Series, codes: pd.Series) -> pd.DataFrame:
        """Maximal runs of bytes below the ranges of starts, and the bytes that are left."""
        begins, ends, kept = [], [], []
        for text, ranges in zip(texts, codes):
            if ranges is None:
                begins.append(None)
                ends.append(None)
                kept.append(None)
                continue
            ranges = np.unique(np.asarray(ranges, dtype=np.int64))
            low = ranges // (2 * RUN_STARTS)
            high = np.maximum.accumulate(low + ranges % (2 * RUN_STARTS) + length)
            fresh = np.concatenate(([True], low[1:] > high[:-1]))
            begin, end = low[fresh], high[np.append(fresh[1:], True)]
            begins.append(begin)
            ends.append(end)
            kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)])))
        return pd.DataFrame({"begins": begins, "ends": ends, "kept": kept})
    return cut


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   length: int = LENGTH, keep_first: bool = True,
                   group_starts: int = GROUP_STARTS, part_starts: int = PART_STARTS) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (array of ``begin``, ``end``, in bytes of the UTF-8 text) and
    ``kept`` (the bytes that are left; a cut may lie inside a character).

    Every byte goes that a string of ``length`` bytes covers which also starts elsewhere, in the same text
    or another, overlaps included; with ``keep_first`` only the later ones go (texts in the order of their
    ids, nulls first, then of a hash). Strings are judged on the input, not on what is left.

    A null text counts as empty; texts shorter than ``length`` stay whole. Rows that agree in id and text are
    two texts (each repeats the other), but with ``keep_first`` they are one place and fare alike.
    The three columns take free names if ``docs`` has such columns (an underscore before).

    Shuffled: 5 numbers a run of starts (about one a ``length`` // 3 bytes) twice, the strings of runs that
    share a key and differ, and the texts twice. A key may have any number of equal runs (they are
    combined map-side); differing runs of one key are sorted in one task up to ``group_starts`` starts, larger
    groups are dealt again by longer keys. Equal runs are told by 128 bits of hash, strings by their bytes.
    """
    row, codes, out = (free_name(docs, name) for name in ("row", "codes", "cut"))
    texts = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    named = row_key(id_column, text_column)
    units = docs.select(named.alias("row"), F.lit(1).cast("long").alias("copies"), texts.alias("bytes"))
    order = docs.select(named.alias("row"), F.col(id_column).alias("at")).dropDuplicates(
        ["row"]) if keep_first else None
    ranges = _repeated(units, order, length, key_lengths(length), keep_first, group_starts, part_starts)
    by_row = ranges.groupBy(F.col("row").alias(row)).agg(F.collect_list(
        F.col("low") * (2 * RUN_STARTS) + F.col("n") - 1).alias(codes))
    joined = docs.withColumn(row, named).join(by_row, row, "left")
    cut = joined.withColumn(out, _cut(length)(F.when(F.col(codes).isNotNull(), texts), F.col(codes)))
    spans = F.arrays_zip(F.col(f"{out}.begins").alias("begin"), F.col(f"{out}.ends").alias("end"))
    return cut.select(
        *docs.columns, F.octet_length(texts).cast("long").alias(free_name(docs, "n_bytes")),
        F.coalesce(spans, F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias(
            free_name(docs, "removed")),
        F.coalesce(F.col(f"{out}.kept"), texts).alias(free_name(docs, "kept")))

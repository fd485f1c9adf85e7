"""Benchmark decontamination by spaced seeds: masked hashes meet in a join, overlaps are verified."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StructField, StructType)

from cellcast.llm.text import free_name, groups, hashed_words, mixed, row_key
from cellcast.shared import checkpointed

# Token places a seed reads. Together the masks hit every stretch of 13 tokens with two substitutions,
# of 15 with three and of 20 with four, wherever these fall (a test goes through all of them).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 1, 6, 7, 9, 10), (0, 1, 2, 4, 5, 6))
SPAN = 1 + max(m[-1] for m in MASKS)
# Tokens from which a shorter item is told by every second of its tokens; of fewer, masks would read common pairs.
SPACED = 8
SIMILARITY = 0.8
MIN_TOKENS = 13
# Hits are worked on by windows of so many tokens, with so many more on either side.
WINDOW, REACH = 512, 64
_MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _seeds(tokens: np.ndarray, offsets: np.ndarray, mask: Sequence[int]
           ) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one mask, where the whole mask lies in one text."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    code = np.full(n, mixed(np.array([sum(1 << p for p in mask)], dtype=np.uint64))[0])
    for k, place in enumerate(mask):
        code += tokens[place:place + n] * _MULTIPLIERS[k]
    inside = np.arange(n) + mask[-1] < np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(inside)
    return at, mixed(code[at])


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item shorter than ``SPAN``: every second token of one with at least ``SPACED`` tokens, from
    the first and from the second one, so that one substitution leaves a mask whole; else all tokens."""
    return [tuple(range(n))] if n < SPACED else [tuple(range(k, n, 2)) for k in (0, 1)]


_ITEM = "item long, tokens array<long>"
_SEED = "item long, hash long, item_at int"


def _item_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        start = 0
        for group in groups(batch["text"]):
            hashes, offsets = hashed_words(group)
            rows = [hashes[a:b].view(np.int64) for a, b in zip(offsets, offsets[1:])]
            yield pd.DataFrame({"item": batch["item"].to_numpy()[start:start + len(group)],
                                "tokens": rows})
            start += len(group)


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for item, row in zip(batch["item"], batch["tokens"]):
            tokens = np.asarray(row, dtype=np.int64).view(np.uint64)
            ends = np.array([0, len(tokens)])
            for mask in MASKS if len(tokens) >= SPAN else _short_masks(len(tokens)):
                at, hashes = _seeds(tokens, ends, mask)
                yield pd.DataFrame({"item": item, "hash": hashes.view(np.int64),
                                    "item_at": at.astype(np.int32)})


def _sieve_places(bits: int) -> tuple[int, int, int]:
    """Where in a hash the three places of the bit table are read."""
    return 64 - bits, (64 - bits) // 2, 0


def _sieve(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of the benchmark's hashes (three bits each), 256 bits per hash, at most 16 MB.

    It only spares the join positions that cannot match. A larger benchmark makes it denser, never
    lossy.
    """
    count = seeds.count()
    bits = min(27, max(16, (256 * count).bit_length()))
    low = F.lit((1 << bits) - 1)
    place = F.explode(F.array(*[F.shiftrightunsigned("hash", k).bitwiseAND(low)
                                for k in _sieve_places(bits)]))
    words = (seeds.select(place.alias("p")).groupBy(F.shiftrightunsigned("p", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))).toPandas()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table, bits


def _in_sieve(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    def bit(p: np.ndarray) -> np.ndarray:
        return (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)

    low = np.uint64((1 << bits) - 1)
    hit = np.arange(len(hashes))
    for k in _sieve_places(bits):
        hit = hit[np.flatnonzero(bit((hashes[hit] >> np.uint64(k)) & low))]
    return hit


def _regions(batches: Iterator[pd.DataFrame], sieve, masks: Sequence[Sequence[int]]
             ) -> Iterator[pd.DataFrame]:
    """For every window of a text with possible hits: the tokens around them, and the hits' hashes."""
    table, bits = sieve.value
    for batch in batches:
        keys, row = batch["key"].to_numpy(), 0
        out: dict[str, list] = {n: [] for n in ("key", "start", "tokens", "hit_at", "hit_hash")}
        for group in groups(batch["text"]):
            tokens, offsets = hashed_words(group)
            at, hashes = [], []
            for mask in masks:
                a, h = _seeds(tokens, offsets, mask)
                hit = _in_sieve(h, table, bits)
                at.append(a[hit])
                hashes.append(h[hit])
            at, hashes = np.concatenate(at), np.concatenate(hashes)
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
            text = np.searchsorted(offsets, at, side="right") - 1
            window = (at - offsets[text]) // WINDOW
            new = np.flatnonzero((np.diff(window, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
            for i, j in zip(new, np.append(new[1:], len(at))):
                t = text[i]
                first = max(offsets[t], at[i] - REACH)
                last = min(offsets[t + 1], at[j - 1] + SPAN + REACH)
                out["key"].append(keys[row + t])
                out["start"].append(first - offsets[t])
                out["tokens"].append(tokens[first:last].view(np.int64))
                out["hit_at"].append((at[i:j] - offsets[t]).astype(np.int32))
                out["hit_hash"].append(hashes[i:j].view(np.int64))
            row += len(group)
        if out["key"]:
            yield pd.DataFrame(out).astype({"key": "int64", "start": "int32"})


def longest_overlap(same: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The longest stretch of aligned tokens of which at least ``similarity`` agree, as [a, b); its
    ends agree. (0, 0) if nothing agrees."""
    if not same.any():
        return 0, 0
    sums = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0 - similarity, -similarity))))
    low = np.minimum.accumulate(np.where(same, sums[:-1], np.inf))
    ends = np.flatnonzero(same) + 1
    starts = np.searchsorted(-low, -(sums[ends] + 1e-9), side="left")
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


_OVERLAP = "key long, item long, start int, length int, matches int"


def _verify(batches: Iterator[pd.DataFrame], similarity: float, min_tokens: int
            ) -> Iterator[pd.DataFrame]:
    """The best overlap of each (window, item) over all diagonals that a hit lies on, if long enough."""
    for batch in batches:
        rows = []
        for key, item, start, diagonals, tokens, wanted in batch[
                ["key", "item", "start", "diagonals", "tokens", "item_tokens"]].itertuples(index=False):
            best = (0, 0, 0)
            for shift in np.unique(diagonals) - start:
                a, b = max(0, shift), min(len(tokens), shift + len(wanted))
                same = tokens[a:b] == wanted[a - shift:b - shift]
                i, j = longest_overlap(same, similarity)
                if len(same) == len(wanted) <= min_tokens and same.mean() >= similarity:
                    # The whole of a short item counts, changed first and last tokens too.
                    i, j = 0, len(wanted)
                if j - i >= max(1, min(min_tokens, len(wanted))):
                    best = max(best, (int(same[i:j].sum()), j - i, -(start + a + i)))
            if best[0]:
                rows.append((key, item, -best[2], best[1], best[0]))
        yield pd.DataFrame(rows, columns=["key", "item", "start", "length", "matches"]).astype(
            {"key": "int64", "item": "int64", "start": "int32", "length": "int32", "matches": "int32"})


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
             min_tokens: int = MIN_TOKENS, id_column: str = "doc_id", text_column: str = "text",
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items found in documents: one row per (document row key, item) with the best overlap.

    Columns: ``key``, the document's id, the item's id, ``start`` (token of the document), ``length``,
    ``matches``, ``similarity``. Tokens are runs of letters and digits, lower-cased. Every token
    position of every text is hashed under each mask; hashes of documents and items meet in an
    equi-join; around each hit the aligned tokens are compared, and the longest stretch with at least
    ``similarity`` agreeing counts if it has ``min_tokens`` tokens, or the whole of a shorter item.
    The first and last token of a stretch agree, but for whole items of at most ``min_tokens``. Items of 8 to 10
    tokens are found with one substitution, shorter ones must occur as they are. Texts are worked on by windows of 512 tokens
    and 64 more on either side: every window is searched, and a longer overlap is reported by its best
    window.

    Only windows with possible hits are shuffled, once each, with the seeds' hits; a window is at most
    651 tokens and is compared once per item, however often a passage repeats. A passage that
    many documents hold is one key of the join: its document side is split by the adaptive skew join,
    its benchmark side has one row per item that holds it. Null and empty texts have no overlap;
    repeated rows are one document; equal items each count.
    """
    spark = docs.sparkSession
    items = benchmark.select(row_key(item_id, item_text).alias("item"), F.col(item_id),
                             F.col(item_text).alias("text")).dropDuplicates(["item"])
    tokens = checkpointed(items.select("item", "text").mapInPandas(_item_tokens, _ITEM)
                          .where(F.size("tokens") > 0))
    seeds = checkpointed(tokens.mapInPandas(_item_seeds, _SEED))
    short = [r[0] for r in tokens.select(F.size("tokens")).where(F.size("tokens") < SPAN)
             .distinct().collect()]
    masks = [*MASKS, *sorted({mask for n in short for mask in _short_masks(n)})]
    sieve = spark.sparkContext.broadcast(_sieve(seeds))
    key = row_key(id_column, text_column).alias("key")
    region = StructType([StructField("key", LongType()), StructField("start", IntegerType()),
                         StructField("tokens", ArrayType(LongType())),
                         StructField("hit_at", ArrayType(IntegerType())),
                         StructField("hit_hash", ArrayType(LongType()))])
    regions = checkpointed(docs.select(key, F.col(text_column).alias("text")).mapInPandas(
        lambda b: _regions(b, sieve, masks), region).dropDuplicates(["key", "start"]))
    hits = regions.select("key", "start", F.explode(F.arrays_zip("hit_at", "hit_hash")).alias("h"))
    found = hits.select("key", "start", F.col("h.hit_at").alias("at"), F.col("h.hit_hash").alias("hash")
                        ).join(seeds, "hash").groupBy(
        "key", "start", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    aligned = found.join(regions.select("key", "start", "tokens"), ["key", "start"]).join(
        tokens.withColumnRenamed("tokens", "item_tokens"), "item")
    kept = aligned.select("key", "item", "start", "diagonals", "tokens", "item_tokens").mapInPandas(
        lambda b: _verify(b, similarity, min_tokens), _OVERLAP)
    best = kept.groupBy("key", "item").agg(F.max(F.struct(
        "matches", "length", (-F.col("start")).alias("back"))).alias("o"))
    ids = docs.select(key, F.col(id_column)).join(
        best.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    return best.join(ids, "key").join(items.select("item", item_id), "item").select(
        "key", id_column, item_id, (-F.col("o.back")).alias("start"), F.col("o.length").alias("length"),
        F.col("o.matches").alias("matches"),
        (F.col("o.matches") / F.col("o.length")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
                      text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found. Options as for ``overlaps``.

    Rows with null or empty texts stay; of repeated rows all stay or all go; other columns are left as they are.
    """
    key = free_name(docs, "doc_key")
    found = overlaps(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    bad = checkpointed(found.select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, row_key(id_column, text_column)).join(bad, key, "left_anti").drop(key)

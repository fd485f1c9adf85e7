"""Near copies by the Jaccard similarity of word shingles: MinHash bands, candidates compared exactly.

Of each group of near copies, by that similarity or by SimHash fingerprints, one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cellcast.llm.components import components
from cellcast.llm.simhash import first_of_components, linked_rows, with_components
from cellcast.llm.text import groups, hashed_words, mixed, row_key
from cellcast.shared import checkpointed

WIDTH = 5
THRESHOLD = 0.8
# Two texts of similarity s meet in a band with odds 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
# A bucket of up to one more is compared whole. Sizes of one class differ by this factor at most.
REACH, CLASS = 32, 1.05

# Bytes of a word (all but ASCII white space and the mark between texts); hash functions.
WORDS = np.array([b > 0 and b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)], dtype=np.int8)
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; fewer words than ``width`` make one
    shingle; no words make none."""
    words, offsets = hashed_words(texts, WORDS)
    sets = []
    for a, b in zip(offsets, offsets[1:]):
        own = words[a:b]
        if len(own):
            n, k = max(1, len(own) - width + 1), min(width, len(own))
            own = np.unique(mixed(sum(own[i:i + n] * np.uint64(2 * i + 3) for i in range(k))))
        sets.append(own)
    return sets


def _summaries(width: int):
    @F.pandas_udf(ArrayType(LongType()))
    def of(texts: pd.Series) -> pd.Series:
        """A hash of the text's set, its size, and the hash of each band; no bands for an empty set."""
        out = []
        for group in groups(texts):
            for own in shingle_sets(group, width):
                head = np.array([mixed(own * np.uint64(5)).sum(dtype=np.uint64), len(own)], dtype=np.uint64)
                if len(own):
                    least = np.array([(own * f + t).min() for f, t in zip(_FACTORS, _TERMS)])
                    band = np.zeros(BANDS, dtype=np.uint64)
                    for row in least.reshape(BANDS, ROWS).T:
                        band = mixed((band + row) * np.uint64(0x9E3779B97F4A7C15))
                    head = np.concatenate((head, mixed(band + np.arange(BANDS, dtype=np.uint64))))
                out.append(head.view(np.int64))
        return pd.Series(out, dtype="object")
    return of


def _sets(width: int):
    @F.pandas_udf(ArrayType(LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([own.view(np.int64) for group in groups(texts)
                          for own in shingle_sets(group, width)], dtype="object")
    return of


def _crossing(threshold: float):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All pairs of one bucket of at most ``REACH + 1`` whose roots differ, of sorted rows; sizes too far
        apart cannot match."""
        held = np.zeros((4, 0), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate((held, batch[["bucket", "sign", "root", "n"]].to_numpy(np.int64).T), axis=1)
            fresh = np.arange(held.shape[1], rows.shape[1])
            for step in range(1, REACH + 1):
                at = fresh[fresh >= step]
                (bucket, sign, root, n), (bucket_, sign_, root_, n_) = rows[:, at], rows[:, at - step]
                met = (bucket == bucket_) & (root != root_) & (
                    np.minimum(n, n_) >= threshold * np.maximum(n, n_))
                if met.any():
                    yield pd.DataFrame({"a": sign_[met], "b": sign[met]})
            held = rows[:, -REACH:]
    return pairs


def _prefixes(threshold: float):
    share = threshold / (1 + threshold)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each class of sizes a set can match with, the shingles one of which it shares with any match.

        Two sets of sizes n and m match only if they share ``share * (n + m)`` shingles, and then their first
        ``n - shared + 1`` and ``m - shared + 1``, in one order of all shingles, have one in common.
        """
        for batch in batches:
            out = {name: [] for name in ("low", "high", "shingle", "sign", "root", "side")}
            for sign, root, own in zip(batch["sign"], batch["root"], batch["ordered"]):
                n = len(own)
                mine = int(np.log(n) / np.log(CLASS))
                reach = int(np.log(1 / threshold) / np.log(CLASS)) + 1
                for other in range(max(0, mine - reach), mine + reach + 1):
                    least = max(CLASS ** other * (1 - 1e-9), threshold * n * (1 - 1e-9), 1.0)
                    taken = n - int(np.ceil(share * (n + least) - 1e-6)) + 1
                    if taken > 0:
                        out["shingle"].append(np.asarray(own[:taken]))
                        for name, value in (("low", min(mine, other)), ("high", max(mine, other)),
                                            ("sign", sign), ("root", root), ("side", int(np.sign(mine - other)))):
                            out[name].append(np.full(min(taken, n), value))
            if out["sign"]:
                yield pd.DataFrame({name: np.concatenate(parts) for name, parts in out.items()})
    return keys


def _rare_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``members`` (``sign``, ``root``) of differing roots that can reach the threshold, without loss.

    Shingles are ordered by the number of these sets that hold them, rarest first, and sets meet on those that
    come first in them: what many texts share is no key. Lists whose members already have one root are dropped.
    """
    held = checkpointed(members.join(sets, "sign"))
    each = held.select("sign", F.explode("own").alias("shingle"))
    rank = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ordered = each.join(rank, "shingle").groupBy("sign").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("often", "shingle"))), lambda x: x["shingle"]).alias("ordered"))
    keys = checkpointed(members.join(ordered, "sign").select("sign", "root", "ordered").mapInPandas(
        _prefixes(threshold), "low long, high long, shingle long, sign long, root long, side long"))
    lists = keys.groupBy("low", "high", "shingle").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where(
        "_a <> _b").select("low", "high", "shingle")
    open_ = checkpointed(keys.join(lists, ["low", "high", "shingle"]))
    other = open_.select("low", "high", "shingle", F.col("sign").alias("b"), F.col("root").alias("root_b"),
                         F.col("side").alias("side_b"))
    # Of two classes the lower is on side -1; within one class both are on side 0.
    met = open_.where("side <= 0").join(other, ["low", "high", "shingle"]).where(
        (F.col("root") != F.col("root_b")) & (F.col("side") == -F.col("side_b"))
        & ((F.col("side") < 0) | (F.col("sign") < F.col("b"))))
    return met.select(F.col("sign").alias("a"), "b").distinct()


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of at least the threshold, compared by their whole sets."""
    both = pairs.join(sets.select(F.col("sign").alias("a"), F.col("own").alias("x")), "a").join(
        sets.select(F.col("sign").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return checkpointed(both.where(
        shared / (F.size("x") + F.size("y") - shared) >= F.lit(threshold)).select("a", "b"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``row`` (key of id and text), ``sign`` (hash of the text's set of
    shingles) and ``component_id``, the smallest id reachable over pairs of at least ``threshold``.

    Words lie between ASCII white space, without case. Texts with equal sets are merged first; texts
    without a word are alike. Texts that agree in a band share a bucket. Its members are compared with the one
    that shares buckets with most others: at most one comparison a member and band. What has several roots then is compared whole in a bucket of up to 33, and in a larger
    one over the shingles that are rare there (``_rare_pairs``), without loss. All comparisons are of whole sets.
    """
    return with_components(*_linked_sets(docs, id_column, text_column, width, threshold), "sign", id_column)


def _linked_sets(docs: DataFrame, id_column: str, text_column: str, width: int,
                 threshold: float) -> tuple[DataFrame, DataFrame]:
    """Id, ``row`` and ``sign`` of every row, and the links ``a``, ``b`` between sets; see ``near_copies``."""
    rows = checkpointed(docs.select(
        F.col(id_column), row_key(id_column, text_column).alias("row"),
        _summaries(width)(F.col(text_column)).alias("_s")).select(
        id_column, "row", F.get("_s", F.lit(0)).alias("sign"), F.get("_s", F.lit(1)).alias("n"),
        F.slice("_s", 3, BANDS).alias("bands")))
    distinct = rows.groupBy("sign").agg(F.min("row").alias("row"), F.first("n").alias("n"),
                                        F.first("bands").alias("bands"))
    each = distinct.select("sign", "n", F.explode("bands").alias("bucket"))
    sizes = checkpointed(each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    met = checkpointed(each.join(sizes, "bucket"))
    members = checkpointed(met.join(met.groupBy("sign").agg(F.sum("size").alias("weight")), "sign"))
    wanted = members.select("sign").distinct().join(distinct.select("sign", "row"), "sign")
    texts = docs.select(row_key(id_column, text_column).alias("row"), F.col(text_column).alias("_t"))
    sets = checkpointed(texts.join(wanted, "row").dropDuplicates(["row"]).select(
        "sign", _sets(width)(F.col("_t")).alias("own")))

    # A text that shares its buckets with many is likely to be near the middle of its group.
    centres = checkpointed(members.groupBy("bucket").agg(F.max(F.struct("weight", "sign", "n")).alias("centre")))
    fits = F.least("n", "centre.n") >= F.lit(threshold) * F.greatest("n", "centre.n")
    tried = members.join(centres, "bucket").where(fits & (F.col("sign") != F.col("centre.sign"))).select(
        F.least("sign", "centre.sign").alias("a"), F.greatest("sign", "centre.sign").alias("b")).distinct()
    links = _links(tried, sets, threshold)
    rooted = checkpointed(members.join(components(links), F.col("sign") == F.col("node"), "left").select(
        "bucket", "sign", "n", "size", F.coalesce("root", "sign").alias("root")))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where(
        "_low <> _high").select("bucket")
    open_ = checkpointed(rooted.join(checkpointed(several), "bucket"))
    few = open_.where(F.col("size") <= REACH + 1).repartition("bucket").sortWithinPartitions(
        "bucket", "sign").mapInPandas(_crossing(threshold), "a long, b long")
    many = _rare_pairs(open_.where(F.col("size") > REACH + 1).select("sign", "root").distinct(), sets, threshold)
    links = links.unionByName(_links(few.unionByName(many).distinct(), sets, threshold))
    return rows.drop("n", "bands"), links


def _links_of_fingerprints(rows: DataFrame, printed: DataFrame, fp_links: DataFrame) -> DataFrame:
    """Links between the sets of ``rows`` that have rows in one component of fingerprints: all to its smallest.

    Equal sets may have several fingerprints (these count repeats), so a set may link components.
    """
    held = rows.select("row", "sign").join(printed.select("row", "fp"), "row").select("sign", "fp").distinct()
    rooted = checkpointed(held.join(components(fp_links), F.col("fp") == F.col("node"), "left").select(
        "sign", F.coalesce("root", "fp").alias("root")).distinct())
    least = rooted.groupBy("root").agg(F.min("sign").alias("a"))
    return rooted.join(least, "root").where("a <> sign").select("a", F.col("sign").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component, whole, chosen as by ``simhash.drop_near_duplicates``.

    Rows are linked as by ``simhash.near_duplicates`` (fingerprints, through the anchors) and as by
    ``near_copies`` (shingles); components run over the links of both.
    """
    printed, fp_links = linked_rows(docs, id_column, text_column)
    rows, links = _linked_sets(docs, id_column, text_column, width, threshold)
    links = links.unionByName(_links_of_fingerprints(rows, printed, fp_links))
    found = with_components(rows, links, "sign", id_column)
    return first_of_components(docs, found, "sign", id_column, text_column)

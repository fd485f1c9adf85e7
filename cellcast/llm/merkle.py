"""A dataset manifest as a content-addressed tree of digests, and proofs by descending from its root.

Rows are leaves; runs of ``FAN_OUT`` digests become the digest of their hex texts, first within each source, then
over the sources. The tree is stored as *packs*: the digest-to-children records of ``PACK_LEVELS`` levels below
one digest. A request descends by the digits of its rank and collects the children it does not take; requests with
equal upper digits share that part of the way, so no upper record is asked for once per leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellcast.llm.text import free_name
from cellcast.shared import checkpointed, small

FAN_OUT = 3
# Levels of one pack: 3 ** 7 leaves are one group.
PACK_LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_DIGEST = 32
_RECORD = _DIGEST * (FAN_OUT + 1) + 1
_TREE = "grp string, rank long, digest string, total long, levels int, records binary"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: tuple[str | Column, ...] = COLUMNS) -> Column:
    """sha256 of the columns' values as text, each with its number of UTF-8 bytes before it; null is ``-``."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(
        F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def levels_above(total: int) -> int:
    """Levels between ``total`` nodes and a single one."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN_OUT), levels + 1
    return levels


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the rows of each group within the partition, from 0."""
    last, seen = None, 0
    for batch in batches:
        if not len(batch):
            continue
        groups = batch["grp"].to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        place = np.arange(len(batch)) - np.repeat(begins, np.diff(np.append(begins, len(batch))))
        if groups[0] == last:
            place[:begins[1] if len(begins) > 1 else len(batch)] += seen
        last, seen = groups[-1], int(place[-1]) + 1
        yield batch.assign(place=place)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` (from 0) of each row within ``grp`` by ``order``, and the group's ``total``.

    Rows are sorted over range partitions, numbered inside each, and shifted by the counts of the partitions
    before: at most one count per group and partition, so a hot group is as parallel as any.
    """
    placed = rows.repartitionByRange(F.col("grp"), *order).sortWithinPartitions(F.col("grp"), *order)
    placed = placed.withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{n} {t}" for n, t in placed.dtypes)
    placed = checkpointed(placed.mapInPandas(_places, f"{fields}, place long"))
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("grp", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
                           F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    return placed.join(small(checkpointed(shifts)), ["grp", "part"]).withColumn(
        "rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _packed(pack_levels: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The digest above one block of nodes, and the records of all digests down to them."""
        rows = rows.sort_values("rank")
        total = int(rows["total"].iloc[0])
        nodes, records, levels = list(rows["digest"]), [], min(pack_levels, levels_above(total))
        for _ in range(levels):
            above = []
            for at in range(0, len(nodes), FAN_OUT):
                run = nodes[at:at + FAN_OUT]
                above.append(_hash("".join(run)))
                records.append(bytes([len(run)]) + bytes.fromhex(above[-1] + "".join(run)).ljust(
                    _RECORD - 1, b"\0"))
            nodes = above
        return pd.DataFrame({"grp": [key[0]], "rank": [key[1]], "digest": nodes,
                             "total": [-(-total // FAN_OUT ** levels)], "levels": [levels],
                             "records": [b"".join(records)]})
    return pack


def _children(records: bytes) -> dict[str, list[str]]:
    """Digest to children, of one pack."""
    found = {}
    for at in range(0, len(records), _RECORD):
        count, text = records[at], records[at + 1:at + _RECORD].hex()
        step = 2 * _DIGEST
        found[text[:step]] = [text[k * step:(k + 1) * step] for k in range(1, count + 1)]
    return found


@dataclass(frozen=True)
class Tree:
    """``nodes`` (grp, rank, digest, total, and what they carry), and the packs above them, lowest first:
    a pack's ``rank`` is its digest's place one stride up."""

    nodes: DataFrame
    packs: list[DataFrame]
    pack_levels: int

    @property
    def roots(self) -> DataFrame:
        """``grp`` and ``digest`` of each group's single top."""
        return self.packs[-1].select("grp", "digest")


def grown(nodes: DataFrame, pack_levels: int) -> Tree:
    """Packs are made stride by stride until each group is one digest; a group that is, stays."""
    nodes = checkpointed(nodes)
    most = nodes.agg(F.max("total")).first()[0] or 1
    packs, below = [], nodes
    for _ in range(max(1, -(-levels_above(most) // pack_levels))):
        block = F.floor(F.col("rank") / F.lit(FAN_OUT ** pack_levels)).cast("long")
        made = below.select("grp", block.alias("block"), "rank", "digest", "total").groupBy(
            "grp", "block").applyInPandas(_packed(pack_levels), _TREE)
        packs.append(checkpointed(made))
        below = packs[-1]
    return Tree(nodes, packs, pack_levels)


def _descended(carried: list[str], pack_levels: int):
    def descend(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Goes from the pack's digest to each asked rank; the way is extended by the unselected children."""
        if not len(asked) or not len(held):
            return pd.DataFrame({c: [] for c in ("grp", "rank", "digest", "way", "root", *carried)})
        top = held.iloc[0]
        children = _children(top["records"])
        levels, digests, ways = int(top["levels"]), [], []
        for rank in asked["rank"].to_numpy() % FAN_OUT ** pack_levels:
            node, steps = top["digest"], []
            for level in range(levels - 1, -1, -1):
                run, digit = children[node], int(rank) // FAN_OUT ** level % FAN_OUT
                steps.append(f"{''.join(run[:digit])}|{''.join(run[digit + 1:])}")
                node = run[digit]
            digests.append(node)
            ways.append(",".join([*steps[::-1], *([top["way"]] if top["way"] else [])]))
        return pd.DataFrame({"grp": key[0], "rank": asked["rank"], "digest": digests, "way": ways,
                             "root": top["root"], **{c: asked[c] for c in carried}})
    return descend


def descended(tree: Tree, starts: DataFrame, carried: dict[str, str]) -> DataFrame:
    """For every node of ``tree``: ``digest``, ``way`` (lowest level first) and ``root``, by descending from
    ``starts`` (grp, digest, way above it, root); ``carried`` are columns of the nodes that are string."""
    held = starts.withColumn("block", F.lit(0).cast("long"))
    block = F.floor(F.col("rank") / F.lit(FAN_OUT ** tree.pack_levels)).cast("long")
    for stride in range(len(tree.packs) - 1, -1, -1):
        lower = tree.packs[stride - 1] if stride else tree.nodes
        extra = carried if stride == 0 else {}
        store = tree.packs[stride].select("digest", "levels", "records").dropDuplicates(["digest"])
        found = held.join(store, "digest")
        schema = "grp string, rank long, digest string, way string, root string" + "".join(
            f", {name} {kind}" for name, kind in extra.items())
        held = lower.select("grp", "rank", block.alias("block"), *extra).groupBy("grp", "block").cogroup(
            found.groupBy("grp", "block")).applyInPandas(_descended(list(extra), tree.pack_levels), schema)
        if stride:
            held = checkpointed(held.withColumn("block", F.col("rank")).drop("rank"))
    return held


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_column: str = "doc_id",
             source_column: str = "source", carry: dict[str, Column] | None = None,
             pack_levels: int = PACK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, source, ``leaf`` (its digest), ``subroot`` (its source's), ``root``, and
    ``way``: from the leaf up, for each level the digests before and after its own in the run, as
    ``before|after``, levels joined by commas. ``carry`` adds string columns made of ``docs``.

    Leaves of a source ascend by id (nulls first), then by digest; a null source is the first of the sources,
    which go on bytewise. Equal rows are leaves of their own. A lone leaf is its source's subroot, a lone
    subroot the root; then the way is empty. Nulls in any column are told from empty texts. An empty table gives no
    rows. More columns, of any name, are not looked at.

    Shuffled: the digests, never a text; once by rank, once to build and once to descend, in groups of
    at most 3 ** 7 leaves. What travels down is one way per pack, not per leaf.
    """
    carry = carry or {}
    names = {name: free_name(docs.select(id_column, source_column), f"carried_{name}") for name in carry}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("n")).alias("grp"),
        F.col(id_column).alias("id"), leaf_digest(columns).alias("digest"),
        *[c.cast("string").alias(names[n]) for n, c in carry.items()])
    kinds = {"id": "string", **{n: "string" for n in names.values()}}
    id_type = docs.schema[id_column].dataType
    ranked = numbered(leaves, [F.col("id"), F.col("digest"), F.monotonically_increasing_id()])
    tree = grown(ranked.withColumn("id", F.col("id").cast("string")), pack_levels)
    tops = grown(numbered(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"),
                          [F.col("name")]), pack_levels)
    start = tops.roots.select("grp", "digest", F.lit("").alias("way"), F.col("digest").alias("root"))
    upper = descended(tops, start, {"name": "string"})
    starts = checkpointed(upper.select(F.col("name").alias("grp"), "digest", "way", "root"))
    found = descended(tree, starts, kinds).join(
        small(tree.roots.select("grp", F.col("digest").alias("subroot"))), "grp")
    source = F.when(F.col("grp") != "n", F.substring("grp", 2, 1 << 30))
    return found.select(F.col("id").cast(id_type).alias(id_column), source.alias(source_column),
                        F.col("digest").alias("leaf"), "subroot", "root", "way",
                        *[F.col(names[n]).alias(n) for n in carry])


def way_digest(way: Column | str = "way") -> Column:
    """sha256 of the siblings of a way, from the leaf's level up, left to right."""
    return F.sha2(F.translate(way, "|,", ""), 256)


@F.pandas_udf(StringType())
def folded(leaf: pd.Series, way: pd.Series) -> pd.Series:
    """The root that a leaf's digest and a way give."""
    roots = []
    for node, steps in zip(leaf, way):
        for step in steps.split(",") if steps else ():
            before, after = step.split("|")
            node = _hash(f"{before}{node}{after}")
        roots.append(node)
    return pd.Series(roots, dtype="object")

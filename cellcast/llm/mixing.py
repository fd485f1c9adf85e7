"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.text import free_name, row_key, word_count
from cellcast.shared import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
# Sizes at which a tier ends: large documents are rounded first, small ones take up what is left over.
TIERS = (4096, 512, 64, 1)
# Documents of a first block, and residuals that meet in a block of the next level.
BLOCK = 4096
FAN_IN = 256
# Keys that the rows of one source are spread over in a join by source.
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share the sum of all
    sizes. A target stops at ``max_copies`` times its source's size; the excess is reshared by weight
    until none is above. That is the level ``f`` with ``sum(min(cap, f * weight)) = total``, found from
    running sums over the sources ordered by cap per weight: windows over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size").cast("double") * max_copies)
    rank = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ranked.select("*", (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after)).alias("level"))
    level = level.withColumn("open", F.col("cap") / F.col("weight") >= F.col("level") * (1 - 1e-12))
    chosen = F.min(F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything)
    share = F.min(F.when(F.col("cap") / F.col("weight") == chosen, F.col("level"))).over(everything)
    return level.select("source", "source_size", F.least(
        F.col("cap"), F.coalesce(share * F.col("weight"), F.col("cap"))).alias("target"))


def _pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds probabilities pair by pair until at most one is left between 0 and 1.

    A pair moves words from one document to the other, up or down, by as much as makes one of them
    integral; the odds of the two moves leave both expectations as they were, and the sum of
    ``size * p`` never changes. ``size`` is positive.
    """
    p = p.copy()
    coins = rng.random(len(p))
    held = -1
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        if held < 0:
            held = k
            continue
        ratio = size[k] / size[held]
        up = min(1.0 - p[held], p[k] * ratio)
        down = min(p[held], (1.0 - p[k]) * ratio)
        step = up if coins[k] * (up + down) < down else -down
        a, b = p[held] + step, p[k] - step / ratio
        p[held], p[k] = (min(1.0, max(0.0, round(x, 12))) for x in (a, b))
        if not 0.0 < p[held] < 1.0:
            held = k if 0.0 < p[k] < 1.0 else -1
    return p


_ROUNDED = "source string, key long, size long, block long, p double"


def _rounder(seed: int, level: int):
    def round_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        name = f"{seed}/{level}/{key[0]}/{key[1]}/{rows['size'].iat[0]}"
        rng = np.random.default_rng(zlib.crc32(name.encode("utf-8", "surrogatepass")))
        rows["p"] = _pivot(rows["size"].to_numpy(dtype=np.float64), rows["p"].to_numpy(), rng)
        rows["block"] = rows["block"] // FAN_IN
        return rows[["source", "key", "size", "block", "p"]]
    return round_block


def _reduced(rows: DataFrame, blocks: int, seed: int) -> list[DataFrame]:
    """The reduction tree of one tier: blocks are rounded, then their residuals, block by block."""
    done, level = [], 0
    while True:
        rows = checkpointed(rows.groupBy("source", "block").applyInPandas(
            _rounder(seed, level), _ROUNDED))
        if blocks <= 1:
            return [*done, rows]
        is_whole = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        done.append(rows.where(is_whole))
        rows, blocks, level = rows.where(~is_whole), -(-blocks // FAN_IN), level + 1


def _uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from a row's columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """``rows`` (with ``key`` and ``source``) with the columns of ``by_source``, one row per source.

    Rows of a source go to ``SALTS`` keys by their own key, so that the source of a third of all rows
    is no single task; the other side has that many rows per source.
    """
    copies = by_source.withColumnRenamed("source", "_s").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_own", F.pmod(F.col("key"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, (F.col("_own") == F.col("_salt")) & F.col("source").eqNullSafe(
        F.col("_s"))).drop("_s", "_salt", "_own")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES,
        seed: int = 42, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", size: Column | None = None) -> DataFrame:
    """How often the mix takes each document: one row per distinct row of ``docs``.

    Columns: ``key`` (of id, text and source), the id, ``source``, ``size``, ``source_size``,
    ``target``, ``n`` (rows of ``docs`` that are this row) and ``copies`` (taken by them together, at
    most ``n * max_copies``). A document's expected copies are ``target / source_size``: the whole part
    is taken as it is, the fraction is rounded with all others of its source.

    Rounding goes by tiers of size. A tier is cut into blocks by a hash of the key (also where one
    source holds most rows); in a block pairs of fractions pass mass until one is integral, and the
    one left over goes up a tree, ``FAN_IN`` blocks at a time. The last one of a source is drawn, and
    the words it misses or has too many change the fractions of the next tier of smaller documents.
    So a source ends within about one small document of its target. Draws depend on keys and ``seed``
    only: reruns agree.

    Null texts have size 0; null sources are one source; documents of size 0 are taken as drawn and
    count nothing. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_column), F.col(source_column).cast("string").alias("source"),
        (word_count(text_column) if size is None else size).alias("size"),
        row_key(id_column, text_column, source_column).alias("key"))
    units = checkpointed(rows.groupBy("key").agg(
        F.first(id_column).alias(id_column), F.first("source").alias("source"),
        F.first("size").alias("size"), F.count("*").alias("n")))
    targets = checkpointed(source_targets(
        units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_copies))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(
        F.least(F.lit(1.0), F.lit(float(max_copies))))
    tier = F.lit(len(TIERS))
    for k in reversed(range(len(TIERS))):
        tier = F.when(F.col("size") >= TIERS[k], k).otherwise(tier)
    exact = F.col("n") * F.least(rate, F.lit(float(max_copies)))
    planned = _with_source(units, targets).withColumns(
        {"tier": tier, "whole": F.floor(exact + 1e-12)}).withColumn(
        "part", F.greatest(F.lit(0.0), F.round(exact - F.col("whole"), 12)))
    planned = checkpointed(planned)
    tiers = planned.where((F.col("part") > 0) & (F.col("tier") < len(TIERS))).groupBy(
        "tier", "source").agg(F.count("*").alias("rows"), F.sum(F.col("size")).alias("words"))
    tiers = checkpointed(tiers)
    most = {r["tier"]: r["rows"] for r in tiers.groupBy("tier").agg(F.max("rows").alias("rows"))
            .collect()}
    carried = targets.select("source", F.lit(0.0).alias("left"))
    found: list[DataFrame] = []
    for k in sorted(most):
        here = tiers.where(F.col("tier") == k).drop("tier")
        plan = here.join(carried.withColumnRenamed("source", "_s"),
                         F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rows = planned.where((F.col("tier") == k) & (F.col("part") > 0)).select(
            "key", "source", "size", "part")
        rows = _with_source(rows, plan)
        shift = F.col("part") + F.col("left") / F.col("words")
        rows = rows.withColumn("p", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shift)), 12))
        block = F.pmod(F.xxhash64(F.lit(seed), "key"),
                       F.ceil(F.col("rows") / F.lit(BLOCK))).alias("block")
        wanted = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("part")).alias("want"))
        parts = _reduced(rows.select("source", "key", "size", block, "p"),
                         -(-most[k] // BLOCK), seed + k)
        drawn = F.when(F.col("p") > _uniform(seed, "key"), 1).otherwise(0)
        tier_done = parts[-1].withColumn("taken", drawn)
        for part in parts[:-1]:
            tier_done = tier_done.unionByName(part.withColumn("taken", F.col("p").cast("int")))
        tier_done = checkpointed(tier_done.select("source", "key", "size", "taken"))
        found.append(tier_done.select("key", "taken"))
        got = tier_done.groupBy("source").agg(F.sum(F.col("size") * F.col("taken")).alias("got"))
        sums = wanted.join(got.withColumnRenamed("source", "_s"),
                           F.col("source").eqNullSafe(F.col("_s"))).select(
            "source", (F.col("want") - F.col("got")).alias("gap"))
        carried = checkpointed(carried.join(sums.withColumnRenamed("source", "_s"),
                                            F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", (F.col("left") + F.coalesce("gap", F.lit(0.0))).alias("left")))
    empty = planned.where((F.col("part") > 0) & (F.col("tier") == len(TIERS))).select(
        "key", F.when(F.col("part") > _uniform(seed, "key"), 1).otherwise(0).alias("taken"))
    for part in found:
        empty = empty.unionByName(part)
    return planned.join(empty, "key", "left").select(
        "key", id_column, "source", "size", "source_size", "target", "n",
        (F.col("whole") + F.coalesce("taken", F.lit(0))).cast("long").alias("copies"))


def copies_of_row(n: Column, copies: Column, place: Column) -> Column:
    """Copies of the row at ``place`` (from 1) among ``n`` equal rows that get ``copies`` together."""
    return F.floor(copies / n) + F.when(place <= copies % n, 1).otherwise(0)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it. Options as for ``mix``.

    Rows meet their number of copies by key: one shuffle of the texts.
    """
    ids = {k: options.get(k, k.removesuffix("_column").replace("id", "doc_id"))
           for k in ("id_column", "text_column", "source_column")}
    taken = mix(docs, **options).select("key", "n", "copies")
    key, n, copies, place = (free_name(docs, x) for x in ("mix_key", "mix_n", "mix_copies", "mix_place"))
    taken = taken.toDF(key, n, copies)
    keyed = docs.withColumn(key, row_key(*ids.values()))
    rows = keyed.join(taken, key)
    at = F.row_number().over(Window.partitionBy(key).orderBy(key))
    # Equal rows are numbered in one task per key; copies of a text differ in their id
    rows = rows.withColumn(place, at).where(copies_of_row(F.col(n), F.col(copies), F.col(place)) > 0)
    times = copies_of_row(F.col(n), F.col(copies), F.col(place)).cast("int")
    return rows.withColumn(place, F.explode(F.array_repeat(F.lit(1), times))).drop(key, n, copies, place)

"""SimHash near-duplicates, linked through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cellcast.llm.components import components
from cellcast.llm.text import free_name, row_key
from cellcast.shared import checkpointed

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
# Shingle hashes held at once while a text's bits are summed.
_PART = 1 << 16
# Parity checks of the Hamming code of 63 bits: check k reads the bits whose place (from 1) has bit k.
_CHECKS = [sum(1 << (place - 1) for place in range(1, 64) if place >> k & 1) for k in range(6)]
_LOW_63 = (1 << 63) - 1


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half the hashes of the word shingles.

    A-Z is lower-cased; words lie between ASCII white space; shingles count with repeats; fewer words
    than ``width`` make one shingle; no words (null and empty texts too) give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, _PART):
        hashes = np.array([digest(joined[i:j], HASH_SEED) for i, j in
                           zip(starts[k:k + _PART].tolist(), last[k:k + _PART].tolist())],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * votes > n, bitorder="little")
    return int(packed.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def anchors(column: str) -> Column:
    """The anchors a fingerprint is sent to, as an array.

    The anchors are the code words of the perfect Hamming code on the low 63 bits: covering radius 1,
    any two at least 3 apart, so no table of them is needed. Two fingerprints at most 2 bits apart
    have a middle point at most 1 bit from both, and the anchor of that middle point lies at most 2
    bits from either. So each fingerprint goes to every anchor within the covering radius plus half
    the threshold: the one at 1 bit and the 31 at 2 bits (or to itself alone, if it is an anchor). An
    anchor's ball holds at most 2,017 values of the 63 bits, so no anchor can become a hot group.
    """
    syndrome = " + ".join(f"(bit_count({column} & {mask}L) % 2) * {1 << k}"
                          for k, mask in enumerate(_CHECKS))
    low = f"({column} & {_LOW_63}L)"
    bit = "shiftleft(1L, CAST({} - 1 AS INT))".format
    return F.expr(f"""transform(array(CAST({syndrome} AS INT)), s -> IF(s = 0, array({low}), concat(
        array({low} ^ {bit('s')}),
        transform(filter(sequence(1, 63), i -> i < (i ^ s)),
                  i -> {low} ^ {bit('i')} ^ {bit('(i ^ s)')}))))[0]""")


def _local_links(anchor: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """Each fingerprint of an anchor with the smallest one it is linked to there; rows are sorted."""
    at = np.arange(len(anchor))
    left, right, step = [], [], 1
    while len(at := at[at + step < len(anchor)]):
        at = at[anchor[at] == anchor[at + step]]
        near = at[np.bitwise_count(value[at] ^ value[at + step]) <= MAX_BITS]
        left.append(near)
        right.append(near + step)
        step += 1
    p, q = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    root = np.arange(len(anchor))
    while len(p):
        low = np.minimum(root[p], root[q])
        if (low == root[p]).all() and (low == root[q]).all():
            break
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        root = root[root]
    member = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": value[member].view(np.int64), "b": value[root[member]].view(np.int64)})


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of sorted (anchor, fingerprint) rows; an anchor that spans batches is carried over."""
    anchor = value = np.zeros(0, dtype=np.int64)
    for batch in batches:
        anchor = np.concatenate((anchor, batch["anchor"].to_numpy()))
        value = np.concatenate((value, batch["fp"].to_numpy()))
        if not len(anchor):
            continue
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield _local_links(anchor[:cut], value[:cut].view(np.uint64))
            anchor, value = anchor[cut:], value[cut:]
    yield _local_links(anchor, value.view(np.uint64))


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) at most 2 bits apart.

    Each anchor reports one link per fingerprint, to the smallest it is joined with there, not all
    pairs: the components stay the same.
    """
    sent = distinct.select("fp", F.explode(anchors("fp")).alias("anchor"))
    sent = sent.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return sent.mapInPandas(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
                    ) -> DataFrame:
    """One row per row of ``docs``: id, ``row`` (key of id and text), ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links. Copies share a fingerprint and are
    merged before anything is linked. Null and empty texts have fingerprint 0; a null id never is a
    component's smallest id unless all its ids are null (then the component is null). Repeated rows
    stay repeated; other columns are not read.
    """
    return with_components(*linked_rows(docs, id_column, text_column), "fp", id_column)


def linked_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
                ) -> tuple[DataFrame, DataFrame]:
    """Id, ``row`` and ``fp`` of every row, and the links ``a``, ``b`` between fingerprints."""
    rows = checkpointed(docs.select(
        F.col(id_column), row_key(id_column, text_column).alias("row"),
        _fingerprints(F.col(text_column)).alias("fp")))
    return rows, checkpointed(link_fingerprints(rows.select("fp").distinct()))


def with_components(rows: DataFrame, links: DataFrame, value: str, id_column: str = "doc_id") -> DataFrame:
    """``rows`` with ``component_id``, the smallest id of all rows whose ``value`` is linked to theirs."""
    distinct = rows.groupBy(value).agg(F.min(id_column).alias("least"))
    linked = components(links)
    rooted = distinct.join(linked, distinct[value] == linked["node"], "left").select(
        value, "least", F.coalesce("root", value).alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_value = rooted.join(least, "root").select(value, "component_id")
    return rows.join(by_value, value)


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
                         ) -> DataFrame:
    """One row of each component, whole: the one with the smallest id (null last), then smallest key.

    Repeated rows are one document. Rows without an id that are linked to no id are grouped by equal
    fingerprints. The texts are shuffled once, by their key.
    """
    return first_of_components(docs, near_duplicates(docs, id_column, text_column), "fp", id_column,
                               text_column)


def first_of_components(docs: DataFrame, found: DataFrame, value: str, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """The row of ``docs`` that stays of each component in ``found``; see ``drop_near_duplicates``."""
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), F.col(value)))
    key = free_name(docs, "row")
    stay = found.groupBy(group.alias("group")).agg(
        F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                       F.col("row"))).alias("first")).select(F.col("first.row").alias(key))
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    return keyed.join(stay.distinct(), key).dropDuplicates([key]).drop(key)

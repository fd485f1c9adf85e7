"""Sharding by proportional stratified interleaving. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.text import free_name, row_key
from cellcast.shared import checkpointed

SHARDS = 24
LAW = "rows"
# Rows a window ranks at once, on average.
BUCKET_ROWS = 4096
# Fixed bytes a row takes besides its text.
ROW_BYTES = 8


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text (none for null) plus ``ROW_BYTES``."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def text_crc32(text: str | Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; 0, that of no bytes, for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.crc32(column.cast("binary")), F.lit(0).cast("long"))


def _unit(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def _offsets(rows: DataFrame, stratum: str, bucket: str) -> DataFrame:
    """Rows in earlier buckets of the same stratum, for each (stratum, bucket); and the stratum's rows."""
    counts = rows.groupBy(stratum, bucket).agg(F.count("*").alias("in_bucket"))
    whole = Window.partitionBy(stratum)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(stratum).alias("at_stratum"), F.col(bucket).alias("at_bucket"),
                         F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"),
                         F.sum("in_bucket").over(whole).alias("in_stratum"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42, id_column: str = "doc_id",
                  text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``key`` (of id, text and source), the id, ``source``, ``size``,
    ``text_crc32``, ``shard`` and ``slot``.

    Within each source the rows are shuffled by a seeded hash of their key and ranked; ordered by
    fractional rank, the sources interleave in proportion, and equal cuts of that order are the
    shards. So row counts differ by one at most (law ``rows``), and in any run of rows each source
    holds its share to within one row. ``slot`` is the place in the shard.

    No window holds a source: rows are ranked in buckets of their shuffle hash, about ``BUCKET_ROWS``
    each, and a bucket starts at the number of rows in the buckets before it; the order of fractional
    ranks is cut the same way. Ties go by source, then by key, then are equal rows. Null texts, ids
    and sources take part; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_column), F.col(source_column).cast("string").alias("source"),
        text_bytes(text_column).alias("size"), text_crc32(text_column).alias("text_crc32"),
        row_key(id_column, text_column, source_column).alias("key"))
    rows = checkpointed(rows.withColumn("stratum", F.coalesce(
        F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("u", _unit(F.xxhash64(
            F.lit(seed), "key"))))
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    bucketed = rows.withColumn("bucket", F.floor(F.col("u") * buckets))
    starts = _offsets(bucketed, "stratum", "bucket")
    local = Window.partitionBy("stratum", "bucket").orderBy("u", "key")
    placed = bucketed.withColumn("place", F.row_number().over(local)).join(
        starts, (F.col("stratum") == F.col("at_stratum")) & (F.col("bucket") == F.col("at_bucket")))
    ranked = checkpointed(placed.select(
        "key", id_column, "source", "size", "text_crc32", "stratum",
        ((F.col("before") + F.col("place") - F.lit(0.5)) / F.col("in_stratum")).alias("rank"))
        .withColumns({"slice": F.floor(F.col("rank") * buckets), "all": F.lit(0)}))
    cuts = _offsets(ranked, "all", "slice").select(F.col("at_bucket"), "before")
    order = Window.partitionBy("slice").orderBy("rank", "stratum", "key")
    at = ranked.withColumn("place", F.row_number().over(order)).join(
        cuts, F.col("slice") == F.col("at_bucket"))
    position = F.col("before") + F.col("place") - 1
    shard = F.floor(position * shards / F.lit(total)) if total else F.lit(0)
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards))
    return at.select("key", id_column, "source", "size", "text_crc32", position.alias("position"),
                     shard.cast("int").alias("shard")).withColumn(
        "slot", (F.col("position") - first).cast("long")).drop("position")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 42,
                      id_column: str = "doc_id", text_column: str = "text",
                      source_column: str = "source") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (replacing columns of that name), for writing out.

    Rows and places meet by key, one shuffle of the texts; equal rows are numbered to take different
    places. Rows of a shard are not moved together here: write with ``partitionBy("shard")``.
    """
    ids = (id_column, text_column, source_column)
    places = assign_shards(docs, shards, seed, *ids).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    key, place, number = (free_name(docs, x) for x in ("shard_key", "shard_place", "shard_number"))
    numbered = docs.withColumn(key, row_key(*ids)).withColumn(
        number, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    joined = numbered.join(places.toDF(key, place), key)
    own = F.element_at(F.col(place), F.col(number))
    return joined.withColumns({"shard": own["shard"], "slot": own["slot"]}).drop(key, place, number)

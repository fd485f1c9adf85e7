"""One query per operator, over its whole table, and the pipeline; with SQL where SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import (decontaminate, language, merkle, mixing, negatives, neighbours, pages, quality,
                          repeats, samples, sharding, simhash, toxicity, urls)
from cellcast.llm.text import remainder_of_id

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(divisor: int, remainder: int) -> Column:
    """Rows that teach nothing; a null id is not held out."""
    return F.coalesce(remainder_of_id("doc_id", divisor) == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sample = samples.labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", ~held_out(3, 1))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit_toxicity(sample))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"),
                                  read(spark, sf_dir, "benchmark")).drop("key")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix(read(spark, sf_dir, "documents"))
    rows = units.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("place"))
    copies = mixing.copies_of_row(F.col("n"), F.col("copies"), F.col("place"))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("size") * copies).cast("long").alias("taken"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(neighbours.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    model = language.fit_languages(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sample = samples.labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", ~held_out(3, 1))
    model = quality.fit_quality(sample, quality.fit_vectors(docs))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampers = F.coalesce(remainder_of_id("doc_id", 2) == 0, F.lit(False))
    tampered = merkle.leaf_digest(tuple(
        F.translate("text", "\n", "") if c == "text" else c for c in merkle.COLUMNS))
    found = merkle.manifest(read(spark, sf_dir, "documents"), carry={"other": F.when(tampers, tampered)})
    root = merkle.folded(F.coalesce("other", "leaf"), F.col("way"))
    return found.withColumn("folded_root", root).select(
        "doc_id", "leaf", "subroot", "root", merkle.way_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    def whole(x: Column) -> Column:
        y = x.cast("double") * 256
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), F.transform("embedding", whole).alias("embedding"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity, op2_decontaminate, op3_mix, op4_neighbours, op5_shard, op6_simhash, op7_language,
    op8_pages, op9_urls, op10_quality, op11_repeats, op12_manifest,
    op13_negatives)}

REPEATS_SQL = """
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT k, i, sha256(b[i:i + 199]) AS s
  FROM (SELECT k, b, unnest(generate_series(1, octet_length(b) - 199)) AS i FROM texts)),
often AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
hits AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM starts SEMI JOIN often USING (s)),
spans AS (SELECT k, min(i) AS low, max(i) + 200 AS high
  FROM (SELECT *, sum(CASE WHEN before + 200 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS g
        FROM hits) GROUP BY k, g),
cuts AS (SELECT k, low, coalesce(lag(high) OVER (PARTITION BY k ORDER BY low), 1) AS after, high,
  lead(low) OVER (PARTITION BY k ORDER BY low) AS next FROM spans),
kept AS (SELECT k, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans,
  string_agg(hex(b[after:low - 1]) || CASE WHEN next IS NULL THEN hex(b[high:]) ELSE '' END, '' ORDER BY low) AS h
  FROM cuts JOIN texts USING (k) GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM texts LEFT JOIN kept USING (k)"""

MANIFEST_SQL = """
WITH RECURSIVE parts AS (SELECT row_number() OVER () AS k, doc_id, source,
  coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head, text,
  CASE WHEN list_reduce([4294967295::UBIGINT] || [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
    LAMBDA crc, byte: list_reduce([xor(crc, byte)] || [0::UBIGINT FOR _ IN range(8)],
      LAMBDA x, _: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) % 2 = 1
    THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
leaves AS (SELECT k, doc_id, source,
  sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS other FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (SELECT source, 0 AS level, i, n, leaf AS h FROM ranked
  UNION ALL SELECT source, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i,
  count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY level, i // 3),
own AS (SELECT k, doc_id, leaf, other, r.source, r.i, subroot, s.i AS at
  FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT k, t.level, t.h, t.i, o.i // (3 ** t.level)::BIGINT AS me
  FROM own o JOIN tree t ON o.source IS NOT DISTINCT FROM t.source AND t.n > 1
    AND t.i // 3 = o.i // (3 ** (t.level + 1))::BIGINT
  UNION ALL SELECT k, 1000 + t.level, t.h, t.i, o.at // (3 ** t.level)::BIGINT
  FROM own o JOIN top t ON t.n > 1 AND t.i // 3 = o.at // (3 ** (t.level + 1))::BIGINT),
steps AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY level) AS step,
  coalesce(string_agg(h, '' ORDER BY i) FILTER (i < me), '') AS before,
  coalesce(string_agg(h, '' ORDER BY i) FILTER (i > me), '') AS after FROM pieces GROUP BY k, level),
fold AS (SELECT k, 0 AS step, other AS h FROM own
  UNION ALL SELECT k, s.step, sha256(before || h || after)
  FROM fold JOIN steps s USING (k) WHERE s.step = fold.step + 1),
proofs AS (SELECT k, sha256(string_agg(before || after, '' ORDER BY step)) AS p FROM steps GROUP BY k),
ends AS (SELECT k, arg_max(h, step) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM own JOIN ends USING (k) LEFT JOIN proofs USING (k), (SELECT h AS root FROM top WHERE n = 1)"""

NEGATIVES_SQL = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.vec_id = b.vec_id AS own,
  list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND NOT own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""

ORACLE_SQL: dict[str, str] = {"op11_repeats": REPEATS_SQL, "op12_manifest": MANIFEST_SQL,
                              "op13_negatives": NEGATIVES_SQL}

import zlib

from pyspark.sql import functions as F

from cellcast.llm import sharding


def check(rows, shards):
    sizes = rows.groupby("shard")["slot"]
    counts = rows["shard"].value_counts().reindex(range(shards), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(slots) == list(range(len(slots))) for _, slots in sizes)


def test_every_shard_matches_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    rows = sharding.assign_shards(docs).toPandas()
    assert len(rows) == 3000
    check(rows, 24)
    share = rows.groupby(["shard", "source"]).size().unstack(fill_value=0)
    want = rows["source"].value_counts() / 24
    assert ((share - want[share.columns]).abs() <= 2).all().all()
    again = sharding.assign_shards(docs.repartition(5)).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    other = sharding.assign_shards(docs, seed=7).toPandas()
    both = rows.merge(other, on="doc_id")
    assert (both["shard_x"] != both["shard_y"]).mean() > 0.8


def test_odd_documents(spark, odd_documents, clashing):
    docs = clashing(odd_documents)
    rows = sharding.assign_shards(docs, shards=5).toPandas()
    assert len(rows) == odd_documents.count()
    check(rows, 5)
    by_id = rows.set_index("doc_id")
    assert by_id.loc[1, "size"] == 8 and by_id.loc[1, "text_crc32"] == 0
    assert by_id.loc[10, "text_crc32"] == zlib.crc32("Ünïcödé ÉÈ 漢字".encode())
    full = sharding.sharded_documents(docs, shards=5)
    assert full.count() == len(rows)
    check(full.select("shard", "slot").toPandas(), 5)
    assert set(full.columns) == set(docs.columns) | {"slot"}
    assert sharding.assign_shards(odd_documents.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, odd_documents):
    plan = sharding.assign_shards(odd_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

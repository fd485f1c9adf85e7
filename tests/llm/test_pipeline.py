import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F


def test_stages_on_the_small_tables(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, small_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.count() <= rows
        rows = docs.count()
    assert rows > 150
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0


def test_run_gives_every_row_a_place(spark, small_dir):
    rows = corpus_pipeline.run(spark, small_dir).select("doc_id", "shard", "slot").toPandas()
    counts = rows["shard"].value_counts()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    assert not rows.duplicated(["shard", "slot"]).any()


def test_registered(spark, small_dir):
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for name in ("op3_mix", "op5_shard", "op6_simhash", "op7_language"):
        got = entry.queries()[name](spark, small_dir)
        assert got.agg(F.count("*")).first()[0] == docs.count(), name

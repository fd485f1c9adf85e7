import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.llm import quality, samples, toxicity
from cellcast.llm.queries import held_out


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return (spark.read.parquet(f"{folder}/documents.parquet"),
            spark.read.parquet(f"{folder}/labels.parquet"))


def auc(scores, labels):
    order = scores.rank()
    ones = labels == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (order[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_sample_is_bounded_and_thins_copies(spark, documents):
    copies = [(k, "the same long text about nothing at all really " * 3) for k in range(50)]
    docs = documents(copies + [(100 + k, f"text number {k} is about item {k} and no other") for k in range(50)])
    labels = spark.createDataFrame([(k, int(k < 50)) for k in [*range(50), *range(100, 150)]]
                                   + [(None, 1), (7, 0), (999, 1)], "doc_id long, toxic int")
    sample = samples.labelled_sample(docs, labels, "toxic", F.lit(True), per_class=20)
    assert sample.totals == (50, 51)
    counts = {r["label"]: r["count"] for r in sample.rows.groupBy("label").count().collect()}
    assert counts[1] == 1 and 10 <= counts[0] <= 20


def test_grammar_reads_clauses():
    symbols = toxicity._Symbols(toxicity.Lexicon({"zorp": 3.0}, {"blug": 2.0}))

    def read(text):
        sums = toxicity.matches(text, symbols)[:-1]
        return {toxicity.CATEGORIES[k]: float(sums[k]) for k in np.flatnonzero(sums)}

    w = toxicity.SEED_WEIGHT
    assert read("A fine day. Nothing here!") == {}
    assert read("what a moron") == {(0, 0, 0, 0): w}
    assert read("You are a moron") == {(0, 0, 1, 0): w}
    assert read("You are not a moron") == {(0, 1, 1, 0): w}
    assert read("not now, what a moron") == {(0, 0, 0, 0): w}
    assert read("not one two three four moron") == {(0, 0, 0, 0): w}
    assert read("He said you are a moron") == {(0, 0, 1, 1): w}
    assert read("I will kill you") == {(1, 0, 1, 0): w}
    assert read("to kill time") == {(2, 0, 0, 0): w}
    assert read("zorp and blugging; blug") == {(0, 0, 0, 0): 5.0}
    assert read(None) == {} and read("") == {}


def test_words_of_another_language_and_learned_weights():
    symbols = toxicity._Symbols(toxicity.Lexicon({"you": 5.0, "not": 5.0, "kill": 5.0}, {"will": 5.0}))
    assert symbols["you"][0] == toxicity.TARGET and symbols["not"][0] == toxicity.NEGATION
    assert symbols["kill"] == (toxicity.THREAT, 5.0)
    for text in ("er sieht die Katze und sie auch", "ella va con ellos"):
        assert not toxicity.matches(text, symbols)[:-1].any()
    assert toxicity.matches("you should die", symbols)[:-1].any()
    assert toxicity.matches("quel con", symbols)[:-1].any()


def test_composition_is_the_product():
    table, states = toxicity.composed()
    for at, parts in enumerate(states):
        for symbol in range(8):
            assert states[table[at][symbol]] == tuple(
                m.step(s, symbol) for m, s in zip(toxicity.MACHINES, parts))


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_held_out_ranking(labelled, label):
    docs, labels = labelled
    sample = samples.labelled_sample(docs, labels, label, ~held_out(3, 1))
    if label == "toxic":
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(sample))
    else:
        scored = quality.score_quality(docs, quality.fit_quality(sample, quality.fit_vectors(docs)))
    rows = scored.where(held_out(3, 1)).join(labels, "doc_id").select("score", label).toPandas()
    assert rows["score"].between(0, 1).all() and auc(rows["score"], rows[label]) > 0.85


def test_context_sums_are_those_of_a_loop():
    rng = np.random.default_rng(0)
    index = quality.index_vectors()
    bucket = rng.integers(0, 30, 200).astype(np.uint16)
    offsets = np.array([0, 0, 1, 3, 120, 200])
    want = {}
    for a, b in zip(offsets, offsets[1:]):
        for i in range(a, b):
            total = want.setdefault(int(bucket[i]), np.zeros(quality.DIMENSIONS))
            for j in range(max(a, i - quality.WINDOW), min(b, i + quality.WINDOW + 1)):
                if j != i:
                    total += index[bucket[j]]
    present, sums = quality.context_sums(bucket, offsets, index)
    assert sorted(want) == present.tolist()
    assert all((want[int(k)] == s).all() for k, s in zip(present, sums))


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1.5, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 3.3 < quality._temperature(4 * z, y, np.ones(4000)) < 4.8


def test_odd_documents(spark, odd_documents, clashing):
    docs = clashing(odd_documents)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (10, 0, 1), (None, 1, 1), (5, None, None)],
                                 "doc_id long, toxic int, quality int")
    for labels in (none, some):
        sample = samples.labelled_sample(docs, labels, "toxic", F.lit(True))
        rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(sample)).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
        assert set(rows[0].asDict()) == {*docs.columns, "score"}
        sample = samples.labelled_sample(docs, labels, "quality", F.lit(True))
        rows = quality.score_quality(docs, quality.fit_quality(sample, quality.fit_vectors(docs))).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
        empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}
        assert max(empty) - min(empty) < 1e-9
    assert quality.fit_vectors(docs.limit(0)).matrix.any() == False  # noqa: E712


def test_long_text_pools_like_short_ones():
    vectors = quality.WordVectors(np.random.default_rng(0).normal(
        size=(1 << quality.BUCKET_BITS, quality.DIMENSIONS)).astype(np.float32))
    short, long_text = vectors.pooled(["a b c d "]), vectors.pooled(["a b c d " * 400_000])
    assert np.allclose(short[0, :-1], long_text[0, :-1], atol=1e-4)

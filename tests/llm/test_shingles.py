import random

from pyspark.sql import functions as F

import corpus_pipeline
from cellcast.llm import shingles, simhash


def jaccard(x, y):
    x, y = ({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_are_those_of_all_pairs(spark, documents):
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = "changed"
            texts.append("  ".join(copy).upper())
    pairs = [(a, b) for a in range(150) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    root = list(range(150))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert 60 < len(pairs) and 30 < len(set(root)) < 90
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    assert [got[k] for k in range(150)] == root
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect())
    assert kept == sorted(set(root))


def test_crowded_buckets_lose_no_link(spark, documents):
    """Texts around one template, 0.77 alike, and among them pairs of over 0.8."""
    rng = random.Random(8)
    template = [f"t{k}" for k in range(204)]
    texts = []
    for k in range(500):
        own = [f"o{rng.randrange(10**9)}" for _ in range(30)]
        texts.append(" ".join(template[:100] + own + template[100:]))
    planted = []
    for k in range(0, 60):
        words = texts[k].split()
        at = rng.randrange(len(words) - 6)
        words[at] = f"n{k}"
        planted.append((k, len(texts)))
        texts.append(" ".join(words))
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in planted)
    assert jaccard(texts[100], texts[101]) < 0.8
    found = {r.doc_id: r.component_id for r in shingles.near_copies(documents(list(enumerate(texts)))).collect()}
    assert [found[b] for _, b in planted] == [a for a, _ in planted]
    assert [found[k] for k in range(500)] == list(range(500))


def test_stage_drops_what_either_links(spark, documents):
    """A passage repeated often fixes the fingerprint, whatever few words of their own the texts have."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(21))
    own = [[f"o{rng.randrange(10**9)}" for _ in range(40)] for _ in range(2)]
    first, second = (" ".join([passage] * 200 + words) for words in own)
    words = second.split()
    third = " ".join(words[:-1])
    again = [f"w{k}" for k in range(150)]
    texts = [third, first, second, " ".join(again), " ".join([*again, "x"]), "a text of its own with six words"]
    apart = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)) % 2**64 for a, b in ((first, second), (second, third))]
    assert apart[0].bit_count() <= 2 and jaccard(first, second) < 0.8 and jaccard(first, third) < 0.8
    assert jaccard(second, third) >= 0.8 and jaccard(texts[3], texts[4]) >= 0.8
    docs = documents(list(enumerate(texts)))
    op6 = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert op6[1] == op6[2]
    copies = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    assert copies[1] != copies[2] == copies[0]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 5]


def test_odd_documents(spark, odd_documents, clashing):
    rows = shingles.near_copies(clashing(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = shingles.drop_near_copies(clashing(odd_documents))
    assert kept.columns == clashing(odd_documents).columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 4, 6, 7, 8, 9, 10]
    assert kept.where(F.col("doc_id").isNull() & F.col("text").isNotNull()).count() == 1
    assert shingles.near_copies(odd_documents.limit(0)).count() == 0

import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cellcast.llm import simhash
from cellcast.llm.components import components


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_definition():
    for text in (None, "", "  ", "One", "one TWO", "a b c", "É È ß a a a a a", "x\x1cy z\x0bw q\r\n r"):
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_every_pair_within_two_bits_meets_at_an_anchor(spark):
    rng = random.Random(1)
    values = []
    for _ in range(20):
        base = rng.getrandbits(64)
        values += [base] + [base ^ (1 << i) ^ (1 << j) for i, j in
                            rng.sample(list(itertools.combinations(range(64), 2)), 12)]
        values += [base ^ (1 << rng.randrange(64)) for _ in range(4)]
    values = [int(np.uint64(v).view(np.int64)) for v in set(values)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    sent = df.select("fp", simhash.anchors("fp").alias("a")).collect()
    assert max(len(r.a) for r in sent) <= 32
    at = {r.fp: set(r.a) for r in sent}
    near = [(x, y) for x, y in itertools.combinations(values, 2) if ((x ^ y) % 2**64).bit_count() <= 2]
    assert len(near) > 200 and all(at[x] & at[y] for x, y in near)
    links = [(r.a, r.b) for r in simhash.link_fingerprints(df).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 4 for a, b in links)
    assert joined(links, values) == joined(near, values)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == joined(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd_documents, clashing):
    rows = simhash.near_duplicates(clashing(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    empty = {r.component_id for r in rows if r.doc_id in (1, 2, 3)}
    assert empty == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = simhash.drop_near_duplicates(clashing(odd_documents))
    assert kept.columns == clashing(odd_documents).columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 4, 6, 7, 8, 9, 10]
    assert kept.where(F.col("doc_id").isNull() & F.col("text").isNotNull()).count() == 1
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0

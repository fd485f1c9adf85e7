import itertools
import random

import numpy as np
import pytest

from cellcast.llm import decontaminate


@pytest.mark.parametrize("tokens,changed", [(13, 2), (15, 3), (20, 4)])
def test_masks_hit_every_pattern(tokens, changed):
    windows = [{s + p for p in m} for m in decontaminate.MASKS for s in range(tokens - m[-1])]
    for pattern in itertools.combinations(range(tokens), changed):
        assert any(not w.intersection(pattern) for w in windows)


def test_longest_overlap_is_the_longest():
    rng = random.Random(2)
    for _ in range(300):
        same = np.array([rng.random() < rng.choice([.3, .8, .95]) for _ in range(rng.randint(1, 40))])
        best = 0
        for a, b in itertools.combinations(range(len(same) + 1), 2):
            if same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * (b - a) - 1e-9:
                best = max(best, b - a)
        a, b = decontaminate.longest_overlap(same)
        assert b - a == best


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, documents):
    rng = random.Random(5)
    items = [words(rng, n) for n in (15, 30, 59, 200)]
    items.append(["short", "item", "of", "six", "words", "here"])
    rows, want = [], {}
    for doc in range(120):
        text, k = words(rng, rng.randrange(5, 400)), doc % 8
        if k < 5:
            own = list(items[k])
            if k < 4:
                for at in rng.sample(range(len(own)), len(own) // 5):
                    own[at] = f"changed{at}"
            cut = rng.randrange(len(text))
            text = text[:cut] + own + text[cut:]
            want[doc] = k
        rows.append((doc, " ".join(w.upper() + "," if rng.random() < .1 else w for w in text)))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)],
                                  "item_id long, text string")
    return documents(rows), bench, want


def test_substituted_passages_are_found_and_clean_documents_kept(planted):
    docs, bench, want = planted
    found = decontaminate.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(want.items())
    assert all(0.8 <= r.similarity <= 1 and r.matches <= r.length for r in found)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(120)) - set(want)


@pytest.mark.parametrize("tokens,changed", [(8, 1), (9, 1), (10, 1), (12, 2), (13, 2)])
def test_short_items_with_any_token_changed(spark, documents, tokens, changed):
    rng = random.Random(tokens)
    item = words(rng, tokens)
    rows, clean = [], []
    for at in range(tokens):
        own, more = list(item), list(item)
        own[at] = "changed"
        rows.append((at, " ".join(words(rng, 20) + own + words(rng, 20))))
        for k in range(changed + 1):
            more[(at + k * 3) % tokens] = f"changed{k}"
        clean.append((1000 + at, " ".join(words(rng, 20) + more[:tokens] + words(rng, 20))))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontaminate.overlaps(documents(rows + clean), bench).collect()
    found = {r.doc_id: r for r in found}
    assert set(range(tokens)) <= set(found)
    assert all(r.length >= tokens - 1 and r.matches == tokens - 1 for k, r in found.items() if k < tokens)
    assert all(r.similarity >= 0.8 for r in found.values())
    if (tokens - changed - 1) / tokens < 0.8:
        assert set(found) == set(range(tokens))


def test_odd_documents(spark, odd_documents, clashing, documents):
    bench = spark.createDataFrame([
        (1, None), (None, "a text without an id but with words"), (3, ""), (4, "one two"), (4, "one two"),
        (5, "lorem ipsum dolor sit amet " * 3)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(clashing(odd_documents), bench).collect()}
    assert found == {(None, None), (4, 4), (5, 4), (7, 5)}
    kept = decontaminate.drop_contaminated(clashing(odd_documents), bench)
    assert kept.columns == clashing(odd_documents).columns and kept.count() == odd_documents.count() - 5
    for d, b in ((odd_documents.limit(0), bench), (odd_documents, bench.limit(0))):
        assert decontaminate.overlaps(d, b).count() == 0
        assert decontaminate.drop_contaminated(d, b).count() == d.count()

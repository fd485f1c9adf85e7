import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cellcast.llm import language
from cellcast.llm.text import mixed, remainder_of_id


def test_held_out_accuracy(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    held = F.coalesce(remainder_of_id("doc_id", 4) == 2, F.lit(False))
    model = language.fit_languages(docs.where(~held))
    seen = language.identify(docs.where(held), model)
    row = seen.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"),
                   F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] <= row[2] <= 1


def test_counts_are_those_of_a_plain_loop(spark, documents):
    docs = documents([(1, "ab ab", "s", "x"), (2, "b", "s", "y")])
    model = language.fit_languages(docs)
    assert model.languages == ("x", "y")
    points, bounds = language._letters(["ab ab", "b"])
    grams = sum(len(language._ngrams(points, bounds, o, 15)[0]) for o in (1, 2, 3))
    # unigrams 4+1; bigrams ab, b_, _a, ab; trigrams ab_, _ab ("b_a" starts and ends with a letter)
    assert grams == 5 + 4 + 3


def plain_grams(text):
    """Buckets of the n-grams of one text, one at a time."""
    points = [c if 97 <= c <= 122 or c >= 0xAA else 32 for c in map(ord, text.lower())]
    out = []
    for order in (1, 2, 3):
        for k in range(len(points) - order + 1):
            gram = points[k:k + order]
            if gram[0] == 32 and gram[-1] == 32:
                continue
            code = order
            for point in gram:
                code = (code * 0x100000001B3 + point) % 2 ** 64
            out.append(int(mixed(np.array([code], dtype=np.uint64))[0]) >> (64 - language.BUCKET_BITS))
    return out


def test_predictions_are_those_of_plain_naive_bayes(spark, documents):
    rng = random.Random(3)
    letters = {"p": "aeinrst ", "q": "aeioknm ", "r": "äuißcht "}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.choice((5, 30, 400)))), "s", lang)
            for k, lang in enumerate(rng.choices("pqr", weights=(20, 5, 1), k=60))]
    learned, asked = rows[:40], rows[40:] + [(99, "aei " * 3, "s", "p"), (100, "aei" * 500, "s", "q")]
    counts = {lang: Counter() for lang in {r[3] for r in learned}}
    for _, text, _, lang in learned:
        counts[lang].update(plain_grams(text))
    size = 2 ** language.BUCKET_BITS
    want = {}
    for k, text, _, _ in asked:
        grams = plain_grams(text)
        logs = {}
        for lang, seen in counts.items():
            total = sum(seen.values()) + language.SMOOTHING * size
            logs[lang] = math.log(sum(r[3] == lang for r in learned) / len(learned)) + sum(
                math.log((seen[g] + language.SMOOTHING) / total) for g in grams)
        temper = min(1.0, language.EVIDENCE / max(1, len(grams)))
        odds = {lang: math.exp(temper * (x - max(logs.values()))) for lang, x in logs.items()}
        want[k] = (max(sorted(logs), key=logs.get), max(odds.values()) / sum(odds.values())) if grams else ("und", 0.0)
    got = language.identify(documents(asked), language.fit_languages(documents(learned))).collect()
    for row in got:
        assert row.lang_pred == want[row.doc_id][0], row
        assert abs(row.score - want[row.doc_id][1]) < 1e-3


def test_odd_documents(spark, odd_documents, clashing):
    model = language.fit_languages(odd_documents)
    rows = language.identify(clashing(odd_documents), model).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    for k in (1, 2, 3, 6):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    assert by_id[7].lang_pred == "la" and by_id[10].lang_pred in model.languages
    kept = language.keep_identified(clashing(odd_documents), model, least=0.0)
    assert kept.columns == clashing(odd_documents).columns and kept.count() == rows.__len__() - 5
    nothing = language.fit_languages(odd_documents.limit(0))
    assert {r.lang_pred for r in language.identify(odd_documents, nothing).collect()} == {"und"}


def test_long_texts_are_read_whole(spark, documents):
    model = language.fit_languages(documents([(1, "aaaa " * 9, "s", "a"), (2, "bbbb " * 9, "s", "b")]))
    mostly_b = "aaaa " * 100_000 + "bbbb " * 400_000
    row = language.identify(documents([(3, mostly_b)]), model).first()
    assert row.lang_pred == "b"

import random

import numpy as np
import pytest

from cellcast.llm import repeats


def brute(rows, length, keep_first):
    """Rows of (id, text); removed spans and kept bytes of each."""
    texts = [(text or "").encode() for _, text in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    places = {}
    for k in order:
        for i in range(len(texts[k]) - length + 1):
            places.setdefault(texts[k][i:i + length], []).append((k, i))
    out = []
    for k, text in enumerate(texts):
        gone = np.zeros(len(text) + 2, dtype=bool)
        for i in range(len(text) - length + 1):
            own = places[text[i:i + length]]
            if len(own) > 1 and not (keep_first and own[0] == (k, i)):
                gone[i + 1:i + 1 + length] = True
        edge = np.diff(gone.astype(int))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((rows[k][0], len(text), spans, bytes(b for b, g in zip(text, gone[1:-1]) if not g)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**5)}" for _ in range(4000)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(3, 30))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        rows.append((k, "é ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 300), (103, "ab" * 150 + "c"), (104, "short"),
             (105, ""), (106, None), (None, rows[5][1]), (107, "x" * 29), (108, "y" * 30 + "z"), (109, rows[7][1])]
    return rows


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.removed], bytes(r.kept))
                   for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group_starts", [1 << 17, 8])
def test_against_all_strings(documents, keep_first, group_starts):
    rows = corpus(1)
    found = got(repeats.remove_repeats(documents(rows), length=30, keep_first=keep_first,
                                       group_starts=group_starts, part_starts=group_starts * 8))
    want = sorted(brute(rows, 30, keep_first), key=lambda r: (r[0] is not None, r[0] or 0))
    assert found == want
    assert 0 < sum(bool(spans) for _, _, spans, _ in want) < len(want)


def test_a_shared_opening_meets_in_parts(documents):
    """A string shorter than the length in every text: one key, many differing runs, no match."""
    rng = random.Random(3)
    stem = "".join(rng.choices("abcdefgh", k=28))
    rows = [(k, f"{rng.random()}{stem}{rng.random()}") for k in range(200)] + [(200, f"0.11111{stem}{5}"),
                                                                             (201, f"0.11111{stem}{5}7")]
    found = repeats.remove_repeats(documents(rows), length=32, keep_first=False, group_starts=64)
    assert got(found) == brute(rows, 32, False)


def test_previous_factors():
    text = np.frombuffer(b"abaababaabaab" + b"\0" * 12, dtype=np.uint8)
    longest, source = repeats.previous_factors(
        np.lib.stride_tricks.sliding_window_view(text, 13)[:13].copy(), np.zeros(13, dtype=np.int64))
    plain = text.tobytes()[:13]
    for i in range(13):
        want = max([0] + [next((k for k in range(13 - i) if plain[i + k] != plain[j + k]), 13 - i)
                          for j in range(i)])
        assert longest[i] == want
        assert want == 0 or plain[source[i]:source[i] + want] == plain[i:i + want] and source[i] < i


def test_odd_documents(odd_documents, clashing):
    df = clashing(odd_documents).selectExpr("*", "'own' AS removed", "'own' AS kept", "'own' AS codes")
    rows = repeats.remove_repeats(df, keep_first=False).collect()
    assert len(rows) == odd_documents.count() and {r.removed for r in rows} == {"own"}
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert by_id[1].n_bytes == 0 and by_id[1]._removed == [] and bytes(by_id[1]._kept) == b""
    assert bytes(by_id[7]._kept) == b"" and [tuple(s) for s in by_id[7]._removed] == [(0, by_id[7].n_bytes)]
    assert [tuple(s) for s in by_id[8]._removed] == [(0, 50_000)]
    assert by_id[10]._removed == []
    assert repeats.remove_repeats(df.limit(0)).count() == 0

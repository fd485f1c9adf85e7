import hashlib

import pytest
from pyspark.sql import functions as F

from cellcast.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def way(tree, rank):
    steps = []
    for nodes in tree[:-1]:
        run = nodes[rank // 3 * 3:rank // 3 * 3 + 3]
        steps.append("".join(run[:rank % 3]) + "|" + "".join(run[rank % 3 + 1:]))
        rank //= 3
    return steps


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, way)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = own, levels([leaf(r) for r in own])
    top = levels([trees[name][1][-1][0] for name in names])
    return sorted(((row[0], leaf(row), tree[-1][0], top[-1][0], ",".join(way(tree, k) + way(top, names.index(name))))
                   for name, (own, tree) in trees.items() for k, row in enumerate(own)), key=str)


def got(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.way) for r in frame.collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("pack", [7, 1, 2])
def test_against_whole_lists(documents, pack):
    df = documents([(k * 7 % 101, f"text {k}\n", None if k % 17 == 0 else f"s{k % 5 if k % 3 else 0}", "en")
                    for k in range(101)] + [(500, "alone", "é"), (501, "alone", "z")])
    assert got(merkle.manifest(df, pack_levels=pack)) == brute(rows_of(df))


def test_folding_tells_tampering(documents):
    df = documents([(k, f"a\nb{k}" if k % 2 else "ab", "s") for k in range(40)])
    tampered = merkle.leaf_digest(tuple(
        F.translate("text", "\n", "") if c == "text" else c for c in merkle.COLUMNS))
    found = merkle.manifest(df, carry={"leaf2": tampered}).withColumn(
        "again", merkle.folded(F.col("leaf"), F.col("way"))).withColumn(
        "other", merkle.folded(F.col("leaf2"), F.col("way"))).withColumn("p", merkle.way_digest()).collect()
    for r in found:
        assert r.again == r.root and (r.other == r.root) == (r.doc_id % 2 == 0)
        assert r.p == h(r.way.replace("|", "").replace(",", ""))


def test_odd_documents(odd_documents, clashing, documents):
    df = clashing(odd_documents).selectExpr("*", "'own' AS way", "'own' AS digest", "'own' AS grp")
    found = merkle.manifest(df)
    assert got(found) == brute(rows_of(odd_documents))
    assert {r.source for r in found.collect()} == {None, "s", "t"}
    assert merkle.manifest(df.limit(0)).count() == 0
    lone = documents([(1, "x", "s")])
    assert got(merkle.manifest(lone)) == [(1, (d := leaf((1, "s", None, 1, "x"))), d, d, "")]

"""The Merkle manifest against a plain tree, level by level."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, leaf string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(tree, i):
    """(sibling or None, whether it stands left) from the leaf up."""
    out = []
    for nodes in tree[:-1]:
        out.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i % 2 == 1))
        i //= 2
    return out


def plain(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        bad = n_chars if n_chars is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 else n_chars + 1
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), leaf_of(doc_id, source, lang, bad, text)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(v)]) for k, v in by.items()}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for at, k in enumerate(names):
        for i, (known, doc_id, leaf, bad) in enumerate(sorted(by[k])):
            path, folded = path_of(trees[k], i) + path_of(top, at), bad
            for beside, left in path:
                folded = h(folded) if beside is None else h(beside, folded) if left else h(folded, beside)
            out.append((doc_id if known else None, leaf, trees[k][-1][0], top[-1][0], h(*(b for b, _ in path if b)), folded, folded == top[-1][0]))
    return out


def rows(n):
    out = [(i, f"text {i}", ("en", "de", None, "", "é")[min(i % 9, 4)], "s", 7 + i) for i in range(n)]
    out += [(None, "x", "en", "s", 1), (3, None, None, None, None), (4, "again", "en", "s", 5), (4, "again", "en", "s", 5), (n + 7, "", "one", "s", 0), (n + 8, "y" * 100_000, "zh", "s", 100_000)]
    return out


@pytest.mark.parametrize("height", (1, 2, 5, 10))
@pytest.mark.parametrize("n", (0, 150))
def test_every_leaf_and_path_matches_a_plain_tree(spark, height, n):
    given = rows(n)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in given], SCHEMA).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.verify(merkle.leaves_of(docs, tampered={"n_chars": F.col("n_chars") + 1}, where=hit), height=height).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(given), key=repr)
    assert n == 0 or 0 < sum(not r.verified for r in got) < len(got) / 3


def test_one_leaf_and_no_leaf(spark):
    one = merkle.verify(merkle.leaves_of(spark.createDataFrame([(1, "a", None, "s", 1, "x", 1, "y")], SCHEMA))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == h() and one.verified
    assert merkle.verify(merkle.leaves_of(spark.createDataFrame([], SCHEMA))).count() == 0


def test_equal_rows_are_spread_and_counted(spark):
    docs = spark.createDataFrame([(1, "same", "en", "s", 4, "x", 1, "y")] * 3000 + [(2, "b", "de", "s", 1, "x", 1, "y")], SCHEMA).repartition(8)
    got = merkle.verify(merkle.leaves_of(docs), height=4).collect()
    assert len(got) == 3001 and all(r.verified for r in got) and len({r.leaf for r in got}) == 2
    assert {r.subroot for r in got} == {levels([leaf_of(1, "s", "en", 4, "same")] * 3000)[-1][0], leaf_of(2, "s", "de", 1, "b")}


def test_layout_keeps_every_subtree_together():
    assert merkle.addresses(3).tolist() == [0, 1, 4, 2, 3, 5, 6]
    for n in range(1, 12):
        at = merkle.addresses(n)
        assert sorted(at) == list(range((1 << n) - 1))
        upper = n // 2
        if upper:  # each subtree of the lower half is one run
            for root in range((1 << upper) - 1, (1 << (upper + 1)) - 1):
                nodes = [root]
                for x in nodes:
                    nodes += [c for c in (2 * x + 1, 2 * x + 2) if c < len(at)]
                assert sorted(at[nodes]) == list(range(at[root], at[root] + len(nodes)))


def test_paths_fold_to_the_block_root():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 9, 31):
        leaves, height = rng.integers(0, 256, (n, 32), dtype=np.uint8), merkle.block_height(0, n, 10)
        nodes = merkle.build(leaves, height)
        assert all(merkle.fold(x.tobytes(), p.tobytes()) == nodes[0].tobytes() for x, p in zip(leaves, merkle.local_paths(nodes, n, height)))

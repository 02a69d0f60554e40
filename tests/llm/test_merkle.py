"""Proofs of the dataset manifest against trees built plainly."""

import hashlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from cadencekit.llm import merkle
from cadencekit.llm.queries import ORACLE_SQL, QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """The root and each leaf's siblings, level by level."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            if place ^ 1 < len(digests):
                ways[i].append(digests[place ^ 1])
        at = [place // 2 for place in at]
        digests = [h(*digests[i:i + 2]) for i in range(0, len(digests), 2)]
    return digests[0], ways


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree([digest for _, digest in groups[name]]))
    root, upper = tree([t[0] for t in trees])
    return sorted(((doc_id, digest, sub, root, h(*way, *above)) for name, (sub, ways), above in zip(names, trees, upper)
                   for (doc_id, digest), way in zip(groups[name], ways)), key=repr)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({name: F.lit("x") for name in ("grp", "key", "leaf", "index", "n", "tree", "proof", "payload")})
    return merkle.manifest(docs, F.col("lang"), F.col("doc_id"), merkle.leaf(*map(F.col, FIELDS)), more)


def shown(proofs):
    hexed = lambda c: F.lower(F.hex(c))
    return sorted((tuple(r) for r in proofs.select("key", hexed("leaf"), hexed("subroot"), hexed("root"),
                                                   F.sha2(hexed("proof").cast("binary"), 256)).collect()), key=repr)


ODD = [(5, "s", "en", 3, "abc"), (1, None, None, None, None), (None, "s", "en", 0, ""), (2, "é🙂", "é", 2, "é🙂"), (7, "s", "en", 1, "a"),
       (7, "s", "en", 1, "a"), (7, "t", "en", 1, "b"), (3, "", "", 4, "x" * 300_000), (4, "s", "en", -1, "\n"), (9, "s", "zz", 1, "1:a")]


@pytest.mark.parametrize("count", [0, 1, 2, 3, 6, 10])
def test_odd_rows(spark, count):
    assert shown(run(spark, ODD[:count])) == (plain(ODD[:count]) if count else [])


def test_more_leaves_than_a_chunk(spark, monkeypatch):
    rows = [(i * 7919 % 5003, "s", "en" if i % 3 else "de", i % 11, f"text {i}") for i in range(4000)]
    assert shown(run(spark, rows)) == plain(rows)
    monkeypatch.setattr(merkle, "SMALL_BYTES", 0)  # all self-joins by shuffle
    assert shown(run(spark, rows[:2500])) == plain(rows[:2500])


def test_changed_leaves_are_found(spark):
    rows = [(i, "s", "en" if i % 3 else None, i % 11, f"text {i}") for i in range(50)]
    wrong = F.when(F.col("doc_id") % 10 == 3, F.unhex(F.sha2(F.lit("other").cast("binary"), 256)))
    found = merkle.folded(run(spark, rows, claimed=wrong).withColumn("claimed", F.coalesce("claimed", "leaf")), "claimed")
    assert {r.key for r in found.where("folded_root <> root").collect()} == {3, 13, 23, 33, 43}


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES["op12_merkle"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op12_merkle"]) == []

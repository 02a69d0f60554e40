"""SimHash groups against all pairs of a small set."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadencekit.llm import simhash as S


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, most=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    items = list(root)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in items}


def test_fingerprint_of_edge_cases():
    for text in ["", " \t", "one", "Two Words", "a b c", "a b c d", "É é x y z", "x " * 500, "na na na na"]:
        assert S.simhash(text.encode()) & (1 << 64) - 1 == plain_print(text)


@pytest.mark.parametrize("crowded", [1, 32])
def test_links_connect_what_all_pairs_connect(spark, crowded):
    rng = random.Random(4)
    prints = {0}
    for _ in range(40):
        seed = rng.getrandbits(64)
        prints |= {seed}
        for _ in range(6):
            bits = seed
            for b in rng.sample(range(64), rng.randrange(6)):
                bits ^= 1 << b
            prints.add(bits)
    # One half in common, the other one close: a crowded value.
    prints |= {(7 << 32) | (1 << a) | (1 << b) for a in range(12) for b in range(a)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    links = S.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded=crowded, block=16).collect()
    mask = (1 << 64) - 1
    assert all(0 < ((r.a ^ r.b) & mask).bit_count() <= 3 for r in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in links:
        x, y = find(r.a & mask), find(r.b & mask)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == plain_groups(prints)


def test_near_duplicates(spark):
    body = " ".join(f"w{i}" for i in range(400))
    rows = [(5, body), (9, body), (3, body.replace("w7 ", "v7 ")), (1, "quite another text of a few words"), (2, None), (8, ""),
            (2, None), (None, body), (4, "Quite another text of a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("fp", F.lit(1))
    got = sorted(map(tuple, S.near_duplicates(df).collect()), key=repr)
    prints = {r: plain_print(r[1]) for r in rows}
    groups = plain_groups(set(prints.values()))
    least = {}
    for r, p in prints.items():
        if r[0] is not None:
            least[groups[p]] = min(r[0], least.get(groups[p], r[0]))
    want = sorted(((r[0], prints[r] - (1 << 64) if prints[r] >> 63 else prints[r], least[groups[prints[r]]]) for r in rows), key=repr)
    assert got == want
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_spanning_forest_is_small():
    rows = np.arange(64, dtype=np.int64)
    assert len(S.spanning_forest(rows, rows, 3)) == 63

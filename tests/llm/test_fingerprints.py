"""Near copies in a group that holds a third of the table."""

import random
import struct

import numpy as np
import xxhash
from cadencekit.llm import fingerprints


def test_near_copies_in_a_large_group(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, small, table = text(120), text(120), []
    for i in range(300):
        own = base[:] if 100 <= i < 200 else small[:] if 220 <= i < 224 else text(120)
        if 100 <= i < 200 or 220 <= i < 224:
            # New words, and words that other documents have too.
            own[rng.randrange(120)], own[rng.randrange(120)] = f"new{i}", rng.choice(words)
        table.append((i, " ".join(own)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df, fingerprints.lexicon(df)).collect()}
    # A row is next to the one of the id below.
    large = [got[i] for i in range(101, 200)]
    assert min(r.near_next for r in large) > 0.2 and np.mean([r.near_next for r in large]) > 0.4
    assert np.mean([r.near_next for r in large]) > 0.6 * np.mean([got[i].near_next for i in range(221, 224)])
    # Followed by a copy, the first half of the text comes twice.
    assert min(r.near_edited for r in large) > 0.02 and np.mean([r.near_edited for r in large]) > 0.1
    # Half of its text is another's.
    assert got[100].near_edited > 0.02
    assert max(got[i].near_next for i in (*range(1, 101), *range(200, 220))) < 0.1


def test_subset_hashes_are_plain(spark):
    """Without a lexicon: the exclusive or of the terms' hashes, for each own subset, whatever the order of the words."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (0, 1, 7, 15, 60, 300)]
    texts += [" ".join(reversed(t.split())) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df, fingerprints.lexicon(df).where("false")).collect()}
    for doc_id, text in enumerate(texts):
        subsets = {}
        for term in set(text.split()):
            value = xxhash.xxh64_intdigest(term, 42)
            for seed in range(6):
                bits, at = xxhash.xxh64_intdigest(struct.pack("<i", seed), value), 0
                for level, width in enumerate(range(3, 11)):
                    if not bits >> at & (1 << width) - 1:
                        subsets.setdefault(48 + 8 * seed + level, []).append(value)
                    at += width
        least = 2 if len(set(text.split())) >= 16 else 1
        want = [f"{k:02d}-{np.bitwise_xor.reduce(np.array(v, np.uint64)):016x}" for k, v in sorted(subsets.items()) if len(v) >= least]
        assert got[doc_id] == ".".join(want) if want else got[doc_id].startswith("all-")

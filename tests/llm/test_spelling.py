"""Near words, forms and roots against all pairs of small vocabularies."""

import random

import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadencekit.llm import spelling
from cadencekit.llm.queries import ORACLE_SQL, QUERIES


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def found(spark, counts, **more):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    frame = frame.withColumns({c: F.lit("x") for c in ("form", "root", "size", "key", "more", "other", "best")})
    return sorted(tuple(r) for r in spelling.variants(frame, least_letters=1, **more).collect())


WORDS = st.text("abé", min_size=1, max_size=7)


@given(short=WORDS, place=st.integers(0, 8), letter=st.sampled_from(["", "a", "b", "é"]), insert=st.booleans())
@settings(max_examples=300, deadline=None)
def test_edit_place(short, place, letter, insert):
    place = min(place, len(short))
    other = short[:place] + letter + short[place + (0 if insert else 1):]
    if len(other) in (len(short), len(short) + 1):
        assert (spelling.edit_place(short, other) >= 0) == one_edit(short, other)


@pytest.mark.parametrize("block", [4, 32, 512])
def test_small_vocabularies(spark, block):
    draw = random.Random(block)
    counts = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 7))): draw.choice([3, 3, 6, 7, 12, 50]) for _ in range(400)}
    assert found(spark, counts, block=block) == plain(counts)


def test_shared_beginnings_and_endings(spark):
    """Most words share all but the middle: their blocks are cut many times."""
    draw = random.Random(3)
    middles = {"".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 3))) for _ in range(250)}
    counts = {f"unbelievably{m}connected": draw.randint(3, 40) for m in middles} | {"x" * 3000: 3, "x" * 3001: 8, "y" * 2999: 5, "lonely": 4}
    assert found(spark, counts, block=16) == plain(counts)


def test_words_of_texts(spark):
    docs = spark.createDataFrame([(1, "Straße STRASSE straße; naïve Naïve--naïve ÀÉÎ×÷ÿ ab"), (2, None), (3, ""), (4, "naïve 'ÀÉÎ×÷ÿ'"), (5, "ÀÉÎ×÷ÿ1a")],
                                 "doc_id long, text string")
    words = docs.select(F.explode(spelling.letter_runs(F.col("text"))).alias("run")).select(spelling.lowered(F.col("run")).alias("word"))
    got = {r.word: r.n for r in spelling.vocabulary(words, least_count=1).collect()}
    assert got == {"straße": 2, "strasse": 1, "naïve": 4, "ÀÉÎ×÷ÿ": 3}
    assert spelling.variants(spelling.vocabulary(words.limit(0))).count() == 0


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES["op11_spelling"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op11_spelling"]) == []

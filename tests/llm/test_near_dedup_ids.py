"""The pipeline's near-dedup with null and reused ids."""

import random


def test_one_row_a_group(spark):
    import corpus_pipeline as P

    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    a, b, c, d = text(), text(), text(), text()
    # No ids at all; a copy without an id; a reused id whose second text is a copy of another document's.
    table = [(None, a), (None, a), (None, a + " "), (1, b), (None, b), (5, c), (3, d), (5, d), (5, c)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = [tuple(r) for r in P.drop_near_duplicates(spark, df, "").collect()]
    assert len(got) == 4 and {(1, b), (5, c), (3, d)} < set(got)
    assert [t.strip() for i, t in got if i is None] == [a]

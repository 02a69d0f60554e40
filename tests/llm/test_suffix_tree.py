"""The suffix tree's scores with the registered defaults against its plain version, also where contexts are wide."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadencekit.llm import suffix_tree
from cadencekit.llm.common import held_out, text_parts, tokenised

SF_DIR = "/root/testdata/sf0.001"


def plain(table):
    """(base_score, score) of (held, words with the end) by the tree over all words."""
    counts = Counter(w for held, t in table if not held for w in t)
    whole = sum(counts.values()) + 0.5 * (len(counts) + 1)
    number = {w: i for i, w in enumerate(sorted({w for _, t in table for w in t}))}
    root = suffix_tree.Root(np.array([(counts[w] + 0.5) / whole for w in number]))
    steps = defaultdict(list)
    places = []
    for row, (held, t) in enumerate(table):
        for at in range(1, len(t)):
            before = tuple(number[t[i]] for i in range(at - 2, max(-1, at - 4), -1))
            step = (number[t[at]], before)
            places.append((row, number[t[at - 1]], step))
            if not held:
                steps[number[t[at - 1]]].append(step)
    trees = {w: suffix_tree.subtree(x, root, 3, 3.0, 2) for w, x in steps.items()}
    base = [sum(math.log10(root.chance(number[w])) for w in t) for _, t in table]
    score = list(base)
    for row, w, (symbol, before) in places:
        score[row] += math.log10(suffix_tree.longest(trees.get(w, {}), before, root).chance(symbol) / root.chance(symbol))
    return list(zip(base, score))


def compare(spark, df):
    """Ids are different and not null here."""
    got = {r.doc_id: r for r in suffix_tree.scores(df, held_out(F.col("doc_id"), 5, 1)).collect()}
    table = df.select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held")).collect()
    want = plain([(r.held, (r.text or "").encode().lower().split() + [b""]) for r in table])
    assert len(got) == len(table)
    for r, (base, score) in zip(table, want):
        assert math.isclose(got[r.doc_id].base_score, base, rel_tol=1e-9)
        assert math.isclose(got[r.doc_id].score, score, rel_tol=1e-9), r.doc_id
    return got.values()


@pytest.mark.parametrize("most", [None, 1500, 40])
def test_scores_are_the_plain_version(spark, hot, most):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 70 and n_chars < 6000").select("doc_id", "text")
    # A passage of often words, and one that runs through a wide context of three words.
    df = df.unionByName(spark.range(1000, 1080).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the of and the in the of and "), F.when(F.col("id") % 2 == 0, "to the of and a").otherwise("is the of the"), F.col("id") % 7).alias("text")))
    if most:
        hot(most)
    got = compare(spark, df)
    assert sum(r.score - r.base_score for r in got if r.held_out and r.doc_id >= 1000) > 1


def test_often_words_own_contexts(spark):
    """Every word is often: more than a millionth of the tokens."""
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h a c e g b d f h").alias("text"))
    got = suffix_tree.scores(df, held_out(F.col("doc_id"), 5, 1)).collect()
    assert any(r.held_out for r in got) and all(r.score > r.base_score + 5 for r in got)


def test_often_is_no_switch(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    one, other = ({r.doc_id: r.score for r in suffix_tree.scores(df, held_out(F.col("doc_id"), 5, 1), least_share=x).collect()} for x in (1e-6, 1e-3))
    assert all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


def test_packs_give_the_steps_back():
    rng = np.random.default_rng(1)
    n, far = 60_000, 1 << 40
    w = np.minimum(rng.zipf(1.3, n), 50_000)
    w[:100] = suffix_tree.HASHED + rng.integers(0, 1 << 40, 100)
    near, more = (np.minimum(rng.zipf(1.3, n), (1 << 31) - 1) for _ in range(2))
    before, after, row = near << 32 | more, np.minimum(rng.zipf(1.3, n), 50_000), far + np.sort(rng.integers(0, 400, n))
    batch = suffix_tree.packed(w, before, after, row, 5)
    assert sorted(batch.column("bucket").to_pylist()) == list(range(5))
    packs = batch.column("pack").to_pylist()
    got = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*map(suffix_tree.unpacked, packs)))))
    assert got == sorted(zip(w.tolist(), before.tolist(), after.tolist(), row.tolist()))
    assert sum(map(len, packs)) < 10 * n
    # Parts hold all steps after a word.
    seen = [set(x["w"].tolist()) for x in suffix_tree.bucket_groups([batch], np.arange(50_001), 500)]
    assert len(seen) > 5 and sum(map(len, seen)) == len(set(w.tolist()))


def test_the_commonest_words_are_often(spark):
    """As many as there is room for, however small their share of the tokens, under the numbers that their hashes lead to."""
    counts = spark.range(4000).selectExpr("cast(concat('w', id) as binary) word", "4000 - id n")
    total, kinds, least, hashes, n_of = suffix_tree.often_words(counts, 1000)
    assert (total, kinds) == (8_002_000, 4000) and 800 < len(hashes) <= 1000
    assert n_of.tolist() == list(range(4000, 4000 - len(n_of), -1))
    assert counts.where(f"{suffix_tree.LEVEL} < {least}").count() == 4000 - len(hashes)
    order = np.argsort(hashes)
    codes = suffix_tree.codes_of(pa.array([b"w0", b"w700", b"w3000", b""]), hashes[order], order)
    assert codes[:2].tolist() == [0, 700] and (codes[2:] >= suffix_tree.HASHED).all()
    assert len(suffix_tree.often_words(counts.limit(0), 1000)[3]) == 0


def test_tokens_are_the_plain_words():
    texts = ["", None, " a  B\tc\n", "Ünï ÀB x", "\x0b\x0c", "one", "a b\x1cc a"]
    for part in text_parts(pa.record_batch({"text": texts + texts}).slice(1), 5):
        kinds, tokens, starts = tokenised(part.column("text"))
        words = [kinds[i].as_py() for i in tokens]
        want = [(t or "").encode().lower().split() + [b""] for t in part.column("text").to_pylist()]
        assert words == sum(want, []) and starts.tolist() == np.cumsum([0] + [len(x) for x in want[:-1]]).tolist()


def test_parts_of_a_bucket_are_unpacked_one_by_one():
    rng = np.random.default_rng(2)
    w, before, after = (rng.integers(0, 500, 9000) for _ in range(3))
    row = np.sort(rng.integers(0, 300, 9000))
    batch = suffix_tree.packed(w, before, after, row, 3, 4)
    assert batch.num_rows == 12 and set(batch.column("bucket").to_pylist()) == {0, 1, 2}
    for bucket in range(3):
        mine = batch.filter(pa.array([x == bucket for x in batch.column("bucket").to_pylist()]))
        parts = list(suffix_tree.bucket_groups([mine], np.arange(500), 10_000, 3, 4))
        assert len(parts) == 4 and all((suffix_tree.bucket_of(x["w"], 12) // 4 == bucket).all() for x in parts)
        assert len(set.union(*(set(x["w"].tolist()) for x in parts))) == sum(len(set(x["w"].tolist())) for x in parts)


def test_no_step_is_summed_twice_or_left():
    parts = [(np.array([4, 6, 4]), np.ones(3), np.ones(3), np.array([1, 0, 1]))] * 5
    for size in (1, 3, 9, 15, 100):
        got = pa.Table.from_batches(suffix_tree.sums(iter(parts), size)).to_pylist()
        assert sum(x["won"] for x in got if x["row"] == 4) == 10 and sum(x["n_known"] for x in got) == 10


def test_a_task_sends_a_text_once():
    """However many steps it has."""
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 1000, (30, 50_000)) << 1
    parts = [(x, np.zeros(50_000), np.ones(50_000), np.ones(50_000, np.int64)) for x in rows]
    got = list(suffix_tree.sums(iter(parts)))
    assert sum(map(len, got)) == 1000 and got[0]["won"].to_pylist() == np.bincount(rows.ravel() >> 1).tolist()
    # Beyond the most rows a task holds, a text comes again, and nothing is lost.
    again = pa.Table.from_batches(suffix_tree.sums(iter(parts), 900, 50_000)).to_pandas()
    assert len(again) > 1000 and again.groupby("row")["n_known"].sum().tolist() == got[0]["n_known"].to_pylist()


def test_packs_give_the_sums_back():
    rng = np.random.default_rng(5)
    n, far = 20_000, (1 << 33) + (1 << 50)
    columns = [np.sort(rng.integers(0, far, n)), rng.normal(size=n), rng.normal(size=n), *rng.integers(-1 << 63, (1 << 63) - 1, (4, n))]
    for some in (columns, columns[:4], [x[:1] for x in columns]):
        batch = suffix_tree.squeezed(some, 7)
        assert len(set(batch["part"].to_pylist())) == len(batch) == min(7, len(some[0]))
        got = list(zip(*(np.concatenate(x).tolist() for x in zip(*map(suffix_tree.unsqueezed, batch["pack"].to_pylist())))))
        want = [x.tolist() for x in some] + [[0] * len(some[0])] * (7 - len(some))
        assert sorted(got) == sorted(zip(*want))


def test_a_text_is_in_one_pack_of_a_task():
    """Also where the task added up its sums more than once."""
    rng = np.random.default_rng(6)
    found = [[np.arange(0, 20_000, 2), rng.normal(size=10_000), np.ones(10_000), np.full(10_000, 3)] for _ in range(4)]
    for size in (1, 1 << 30):
        got = pa.Table.from_batches(suffix_tree.gathered(iter(found), 9, size)).to_pylist()
        assert [x["part"] for x in got] == list(range(9))
        row, base, won, known, *_ = map(np.concatenate, zip(*(suffix_tree.unsqueezed(x["pack"]) for x in got)))
        assert sorted(row.tolist()) == found[0][0].tolist() and (won == 4).all() and (known == 12).all()
        assert np.allclose(base, sum(x[1] for x in found)[row // 2])


def test_texts_keep_ids_and_exact_counts_over_all_packs(spark, hot):
    """Ids beyond what a double holds, null ids and repeated ones; buckets, wide contexts and groups of texts."""
    df = spark.range(0, 400, 1, 5).select(F.expr("case id % 4 when 0 then null when 1 then 7 else 9007199254740993 + id end").alias("doc_id"),
                                          F.expr("repeat(concat('a b c d', id % 9, ' '), cast(id % 5 as int))").alias("text"))
    hot(50)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known > 0) for r in suffix_tree.scores(df, held_out(F.col("doc_id"), 5, 1)).collect())
    assert got == sorted((r.doc_id or 0, len((r.text or "").split()) + 1, True) for r in df.collect())


def test_steps_after_a_very_often_word_are_walked_in_slices():
    """The chances are those of one walk over all steps."""
    rng = np.random.default_rng(3)
    n = 20_000
    near, far = (np.minimum(rng.zipf(1.4, n), 300) for _ in range(2))
    after, counts = (near * 3 + far % 5) % 301, rng.integers(1, 500, 301)
    whole = float(counts.sum())
    steps = {"w": np.full(n, 7), "before": np.where(near > 250, 0, near) << 32 | np.where(near > 250, 0, far), "next": after, "n": counts[after],
             "row": rng.integers(0, 90, n)}
    chances = (steps["n"] + 0.5) / whole
    want = suffix_tree.walk(steps["w"], steps["before"], after, steps["row"] & 1 == 0, chances, 3, 0, 3.0, 2)
    assert (want != chances).mean() > 0.5
    got = []
    for x in suffix_tree.by_second_word(dict(steps), whole, 3.0, 2, 2000):
        p = suffix_tree.walk(x["w"], x["before"], x["next"], x["row"] & 1 == 0, x["p"], 3, 1, 3.0, 2)
        got += zip(x["before"].tolist(), x["next"].tolist(), x["row"].tolist(), p.tolist())
    wanted = sorted(zip(steps["before"].tolist(), after.tolist(), steps["row"].tolist(), want.tolist()))
    assert len(got) == n and all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(sorted(got), wanted))

"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts, and the form each stands for.

A block holds the words of two adjacent lengths.  NumPy products of its letter-count rows give squared distances; pairs
at most two apart are kept (a replaced letter moves two counts by one, an inserted one a single count) and their edits
verified letter by letter.  A block of too many words is cut in two by the place of the edit: if it lies in the first
half, the second halves are equal, and the other way round, so words meet in a block only if they share the half that the
edit leaves alone.  That is repeated until blocks are small; no pair is lost, and each is found in one block alone.

Null texts have no words; a word of any length is compared whole; equal counts are settled by code-point order; an
empty table gives no rows.  Input columns are taken by position, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import record_batches
from cadencekit.session import materialise

#: Fixed value: a word is a maximal run of these letters.
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_DISTANCE = 2
BLOCK = ["size", "lo", "hi", "key"]
#: Rows of a table of large blocks that is sent to all tasks; a longer one is joined by a shuffle.
FEW = 50_000


def letter_runs(text: Column, least: int = 5) -> Column:
    """Array of the maximal runs of at least ``least`` letters; none of a null text."""
    return F.regexp_extract_all(text.cast("string"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(words: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """Distinct words of the column ``word`` with their number of occurrences ``n``."""
    return (words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def variants(counts: DataFrame, least_letters: int = 5, ratio: int = 2, block: int = 512) -> DataFrame:
    """Per word of ``counts`` (distinct ``word``, ``n``): ``n_near``, words one edit away; ``form``, the most frequent of
    them (ties: least) if it has at least ``ratio`` times the word's ``n``, and ``form_n``; ``root``, where the forms lead.
    """
    counts = materialise(counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")))
    near = _near(_blocks(counts, least_letters, block), block)
    every = near.unionByName(counts.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("other_n"),
                                           F.lit(None).cast("string").alias("other")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other"))))
    found = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    stands = -F.col("best.less") >= ratio * F.col("n")
    found = materialise(found.select("word", "n", "n_near", F.when(stands, F.col("best.other")).alias("form"),
                                     F.when(stands, -F.col("best.less")).alias("form_n")))
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root"))).withColumnRenamed("word", "_word")
    led = found.join(roots, F.col("word") == F.col("_word"), "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _blocks(counts: DataFrame, least: int, most: int) -> DataFrame:
    """Words in blocks of at most ``most`` (more only where a single place of the edit is left).

    A block: words of ``size`` letters and, as ``more``, of one letter more, that agree outside the places ``lo`` to
    ``hi`` of the shorter word (``key``).  Each word is in the block of its size and in that of the size below.
    """
    size = F.char_length("word")
    roles = F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("more")), F.struct((size - 1).alias("size"), F.lit(True).alias("more"))))
    rows = (counts.select("word", "n", roles.alias("r")).select("word", "n", "r.size", "r.more").where(F.col("size") >= least)
            .select("word", "n", "more", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"), F.lit(0).cast("long").alias("key")))
    settled = []
    while True:
        large = materialise(rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > most) & (F.col("lo") < F.col("hi"))))
        number = large.count()
        if not number:
            break
        marked = rows.join(F.broadcast(large) if number <= FEW else large, BLOCK, "left")
        settled.append(marked.where("_n is null").select(*rows.columns))
        rows = materialise(_halved(marked.where("_n is not null").select(*rows.columns)))
    for other in settled:
        rows = rows.unionByName(other)
    return rows


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    sides = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
    cut = rows.withColumn("_side", F.explode(sides)).withColumn("lo", F.col("_side.lo")).withColumn("hi", F.col("_side.hi"))
    after = F.col("hi") + F.when(F.col("more"), 3).otherwise(2)
    kept = F.xxhash64(F.substr("word", F.lit(1), F.col("lo")), F.substr("word", after))
    return cut.withColumn("key", kept).drop("_side")


def _near(rows: DataFrame, most: int) -> DataFrame:
    """Per word and block: ``n_near`` words one edit away, and the most frequent of them."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("other_n", pa.int64()), ("other", pa.string())])

    def run(batches):
        yield from record_batches((row for block in _packs(batches, most) for row in compared(*block)), schema)

    dealt = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).select(*BLOCK, "more", "word", "n")
    return dealt.mapInArrow(run, "word string, n long, n_near long, other_n long, other string")


def _packs(batches, most: int) -> Iterator[tuple]:
    """Whole blocks in sort order, small neighbours together: block number, places, ``more``, words and counts."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in BLOCK], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.array([0])
        waiting = table.slice(starts[-1])  # the last block may go on
        yield from _cut(table.slice(0, starts[-1]), starts[:-1], most)
    if waiting is not None and waiting.num_rows:
        yield from _cut(waiting, np.array([0]), most)


def _cut(table: pa.Table, starts: np.ndarray, most: int) -> Iterator[tuple]:
    if not table.num_rows:
        return
    sizes = np.diff(np.r_[starts, table.num_rows])
    shorter = np.add.reduceat(~table["more"].to_numpy(zero_copy_only=False), starts)
    useful = np.flatnonzero((sizes > 1) & (shorter > 0))  # others hold no pair
    at = 0
    while at < len(useful):
        end, total = at + 1, sizes[useful[at]]
        while end < len(useful) and total + sizes[useful[end]] <= most:
            total += sizes[useful[end]]
            end += 1
        chosen = useful[at:end]
        number = np.repeat(np.arange(len(chosen)), sizes[chosen])
        rows = np.concatenate([np.arange(starts[b], starts[b] + sizes[b]) for b in chosen])
        part = table.take(pa.array(rows))
        yield (number, part["lo"].to_numpy(), part["hi"].to_numpy(), part["more"].to_numpy(zero_copy_only=False),
               part["word"].to_pylist(), part["n"].to_pylist())
        at = end


def letter_counts(words: list[str]) -> np.ndarray:
    """One row a word, one column a letter that some word has; numbers that hold all products exactly."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, column = np.unique(codes, return_inverse=True)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(row * len(letters) + column, minlength=len(words) * len(letters)).reshape(len(words), len(letters))
    return counts.astype(np.float32 if lengths.max(initial=0) < 2048 else np.float64)


def edit_place(short: str, other: str) -> int:
    """Place of the only edit that makes ``other``, as long or one letter longer, of ``short``; -1 if there is none."""
    at = next((i for i, (a, b) in enumerate(zip(short, other)) if a != b), len(short))
    if len(other) == len(short):
        return at if at < len(short) and short[at + 1:] == other[at + 1:] else -1
    return at if short[at:] == other[at + 1:] else -1


def compared(number: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: np.ndarray, words: list[str], n: list[int], slab: int = 1024):
    """Rows (word, n, n_near, other_n, other) of the words of some blocks that have a word one edit away."""
    counts = letter_counts(words)
    norm = np.einsum("ij,ij->i", counts, counts)
    shorter = np.flatnonzero(~more)
    near: dict[int, list] = {}

    def meet(a: int, b: int) -> None:
        seen = near.setdefault(a, [0, 0, ""])
        seen[0] += 1
        if n[b] > seen[1] or (n[b] == seen[1] and words[b] < seen[2]):
            seen[1:] = n[b], words[b]

    for at in range(0, len(shorter), slab):
        mine = shorter[at:at + slab]
        square = norm[mine, None] + norm[None, :] - 2 * (counts[mine] @ counts.T)
        close = (square <= MOST_DISTANCE) & (number[mine, None] == number[None, :])
        for x, b in zip(*(v.tolist() for v in np.nonzero(close)), strict=True):
            a = int(mine[x])
            if more[b] or a < b:
                place = edit_place(words[a], words[b])
                if place >= 0 and lo[a] <= place <= hi[a]:
                    meet(a, b)
                    meet(b, a)
    for a, (count, other_n, other) in near.items():
        yield words[a], n[a], count, other_n, other


def _roots(forms: DataFrame) -> DataFrame:
    """Where the chains of ``forms`` (word, root) end, by pointer doubling: counts at least double along a chain, so
    there are no rings and few rounds.  Words that have arrived are not looked up again."""
    table = active = materialise(forms)
    arrived = None
    while True:
        look = table.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = materialise(active.join(look, F.col("root") == F.col("_word"), "left")
                           .select("word", F.coalesce("_root", "root").alias("root"), F.col("_word").isNotNull().alias("moved")))
        ended = step.where("not moved").drop("moved")
        arrived = ended if arrived is None else arrived.unionByName(ended)
        active = step.where("moved").drop("moved")
        if active.isEmpty():
            return arrived
        table = arrived.unionByName(active)

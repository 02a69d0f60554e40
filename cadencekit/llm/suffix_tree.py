"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased words and one end, which counts as a token.  The root of the tree predicts by the words'
own counts, plus one half.  Longer contexts are the one to ``depth`` words before a token, whatever these words are; a
context is retained if a likelihood test tells its next words apart from those of its longest retained suffix, and
a token is scored in the longest retained context.  Every word is a symbol of its own.

All steps with the same last word of context meet in one task, which looks at one length after the other.  Contexts
with more steps than a task may hold (``spark.cadencekit.hotRows``, or four times a task's share) are counted by
aggregations instead; their chances are joined to the steps, which then meet by a longer context.

A task adds up what its steps give each text and sends that once, packed by groups of texts; so a text comes from each
bucket once at most, and never more often than it has tokens.  Buckets grow in number only when they would be too large.

Null texts count as empty (one end token).  Repeated rows are learned from and scored each, also where they share
a ``doc_id``.  With no training rows every count is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import opened, share, text_parts, tokenised
from cadencekit.session import hot_rows, materialise, materialise_and_free

WORD_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
#: The class of words that have no number, in the plain version.
OTHER = -1
#: A step: codes of the word before (often words' numbers, or hashes) and of the two before that (31 bits each, 0 for none, the
#: nearer one above), the code of the word itself and its training count, the row's number times two, plus one if held out.
#: Steps with a negative ``before`` have no context, see ``SUMS`` to ``NO_CONTEXT``.
STEPS = pa.schema([("w", pa.int64()), ("before", pa.int64()), ("next", pa.int64()), ("n", pa.int64()), ("row", pa.int64())])
SELDOM = pa.schema([("bucket", pa.int32()), ("w", pa.int64()), ("before", pa.int64()), ("word", pa.binary()), ("row", pa.int64()), ("part", pa.int32())])
#: Steps to often words travel packed, see ``packed``, with the number of their part as ``w``; others and those without a context as they are.
SENT = pa.schema([("bucket", pa.int32()), ("pack", pa.binary()), *STEPS, ("part", pa.int32())])
#: Training steps that a bucket has on the mean at most, and parts of a bucket, of which a task unpacks one after the other.
BUCKET, PARTS = 24_000_000, 32
#: Training texts of a group, which one task sums up, on the mean at most.
TEXTS = 20_000
#: What a task gives a text: its sums over all tasks are the result.  The last three come once a text; ``with_id`` is 0 for a null id.
SUMMED = ("row", "base", "won", "n_known", "n_tokens", "doc_id", "with_id")
WON = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                 ("base", pa.float64()), ("won", pa.float64())])
WON_DDL = "row long, doc_id long, n_tokens long, n_known long, base double, won double"
PACKS = "part int, pack binary"
#: ``before`` of a text's base score in often words (bits of a double; ``n``: their tokens), of its id and number of
#: tokens (with and without an id), and of a seldom first word.
SUMS, WITH_ID, WITHOUT_ID, NO_CONTEXT = -1, -2, -3, -4
#: Codes from here on are hashes.
HASHED = 1 << 62
MOST_DEPTH = 3


def word_counts(docs: DataFrame, text: str = "text", most: int = 300_000) -> DataFrame:
    """``word`` (bytes; empty for the end token) and ``n`` over all rows."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in text_parts(batch):
                kinds, tokens, _ = tokenised(part.column("text"))
                held.append(pa.table([kinds, np.bincount(tokens, minlength=len(kinds))], schema=WORD_COUNTS))
                n += len(kinds)
                if n > 2 * most:
                    held = [merged(held)]
                    n = len(held[0])
                    if n > most:
                        yield from held[0].to_batches(20_000)
                        held, n = [], 0
        if held:
            yield from merged(held).to_batches(20_000)
        held.clear()
        pa.default_memory_pool().release_unused()

    def merged(held):
        found = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return pa.table([found["word"], found["n_sum"]], schema=WORD_COUNTS).combine_chunks()

    return (docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


#: Words by their counts' logarithms, a few hundred levels.
LEVEL = "floor(8 * log2(n))"


def often_words(counts: DataFrame, most: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Tokens, different words, the least level of the often words, of which there are at most ``most``, and their hashes and
    counts; the commonest come first, so that they have the least numbers, which pack best."""
    level = F.expr(LEVEL)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    least, room = 1 << 30, most
    for x in levels:
        room -= x["words"]
        if room < 0:
            break
        least = x["level"]
    often = counts.where(level >= least).select(F.xxhash64("word").alias("hash"), "n").toArrow()
    hashes, n_of = often["hash"].to_numpy(), often["n"].to_numpy()
    order = np.lexsort((hashes, -n_of))
    return sum(x["n"] for x in levels), sum(x["words"] for x in levels), least, hashes[order], n_of[order]


class Node:
    """Counts of the symbols after one context, and their smoothed chances: as many shares of the parent's chance as
    there are different symbols are added to the counts (Witten and Bell)."""

    __slots__ = ("counts", "parent", "total")

    def __init__(self, counts: dict[int, int], parent):
        self.counts, self.parent, self.total = counts, parent, sum(counts.values())

    def chance(self, symbol: int) -> float:
        kinds = len(self.counts)
        return (self.counts.get(symbol, 0) + kinds * self.parent.chance(symbol)) / (self.total + kinds)

    def diverges(self, gain: float, least: int) -> bool:
        """Whether the likelihood won over the parent is worth ``gain`` nats for each different symbol."""
        if self.total < least:
            return False
        won = sum(n * math.log(n / self.total / self.parent.chance(s)) for s, n in self.counts.items())
        return won > gain * len(self.counts)


class Root:
    """Chances of the symbols by the words' own counts."""

    def __init__(self, chances: np.ndarray):
        self.chances, self.other = chances, max(1e-12, 1 - float(chances.sum()))

    def chance(self, symbol: int) -> float:
        return self.other if symbol == OTHER else float(self.chances[symbol])


def subtree(steps: list[tuple[int, tuple[int, ...]]], root: Root, depth: int, gain: float, least: int) -> dict[tuple[int, ...], Node]:
    """The plain version of ``walk``: retained contexts that end in one word, from its occurrences (next symbol, words before it, nearest first).

    Contexts are keyed by the words before the last; level by level, only contexts seen often enough are looked
    at, and each is tested against its longest retained suffix."""
    nodes: dict[tuple[int, ...], Node] = {}
    for length in range(depth):
        found: dict[tuple[int, ...], Counter] = {}
        for symbol, before in steps:
            if len(before) >= length:
                found.setdefault(before[:length], Counter())[symbol] += 1
        for context, counts in found.items():
            node = Node(counts, longest(nodes, context[:-1], root) if context else root)
            if node.diverges(gain, least):
                nodes[context] = node
    return nodes


def longest(nodes: dict[tuple[int, ...], Node], before: tuple[int, ...], root: Root):
    """The longest retained suffix of a context, or the root."""
    for length in range(len(before), -1, -1):
        if before[:length] in nodes:
            return nodes[before[:length]]
    return root


def codes_of(kinds: pa.Array, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Codes of words: the numbers of often words, hashes of others.

    ``hashes`` are those of the often words as Spark's ``xxhash64`` has them, in order, and ``numbers`` theirs."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, kinds.to_pylist(), repeat(42)), np.uint64, len(kinds))
    codes = (found >> np.uint64(2)).view(np.int64) | HASHED
    if not len(hashes):
        return codes
    at = np.minimum(np.searchsorted(hashes, found.view(np.int64)), len(hashes) - 1)
    return np.where(hashes[at] == found.view(np.int64), numbers[at], codes)


def short(codes: np.ndarray) -> np.ndarray:
    """Codes in 31 bits, never 0."""
    return np.where(codes < HASHED, codes + 1, codes >> 20 & (1 << 30) - 1 | 1 << 30)


def refined(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of the different pairs of a group and a key, both below 2^31."""
    both = group << 32 | key
    order = np.argsort(both)
    both = both[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], both[1:] != both[:-1]])[:len(order)])
    return out


def walk(w: np.ndarray, before: np.ndarray, symbols: np.ndarray, training: np.ndarray, chances: np.ndarray, depth: int, wide: int,
         gain: float, least: int) -> np.ndarray:
    """Chances of the symbols in their longest retained contexts.

    Contexts are the word before and those in ``before``; ``chances`` are those in the contexts of ``wide`` words, which are behind
    them already.  All steps of a longer context have to be there.  A context that is seen too seldom has no retained longer ones."""
    chances = chances.copy()
    if wide >= depth:
        return chances
    at = np.flatnonzero(before >= 0)
    group = np.unique(w[at], return_inverse=True)[1]
    symbols = np.unique(symbols, return_inverse=True)[1]
    for length in range(1, depth + 1):
        if length > 1:
            key = before[at] >> 32 if length == 2 else before[at] & 0xFFFFFFFF
            there = key > 0
            at, group = at[there], refined(group[there], key[there])
        if not len(at):
            break
        if length <= wide:
            continue
        both = group << 32 | symbols[at]
        order = np.argsort(both)
        at, both = at[order], both[order]
        pairs = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        c = both[pairs] >> 32
        n = np.add.reduceat(training[at], pairs, dtype=np.int64)
        parent = chances[at[pairs]]
        firsts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        total, kinds = np.add.reduceat(n, firsts), np.add.reduceat(n > 0, firsts, dtype=np.int64)
        won = np.add.reduceat(n * np.log(np.maximum(n, 1) / parent), firsts) - total * np.log(np.maximum(total, 1))
        kept = (total >= least) & (won > gain * kinds)
        mine = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(pairs))))
        better = np.where(kept[mine], (n + kinds[mine] * parent) / np.maximum(total + kinds, 1)[mine], parent)
        sizes = np.diff(np.append(pairs, len(at)))
        chances[at] = np.repeat(better, sizes)
        left = np.repeat(total[mine] >= least, sizes)
        at, group = at[left], np.repeat(mine, sizes)[left]
    return chances


def whole_groups(batches, keys: list[str], size: int = 200_000):
    """Columns of sorted rows, in parts that hold all rows of their keys."""
    held: list[dict[str, np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names})
        n += batch.num_rows
        if n < size:
            continue
        steps = {name: np.concatenate([x[name] for x in held]) for name in held[0]}
        other = np.zeros(n, bool)
        for key in keys:
            other |= steps[key] != steps[key][-1]
        cut = int(other.nonzero()[0][-1]) + 1 if other.any() else 0
        if cut:
            yield {name: x[:cut] for name, x in steps.items()}
        held, n = [{name: x[cut:] for name, x in steps.items()}], n - cut
        size = max(200_000, 2 * n)
    if n:
        yield {name: np.concatenate([x[name] for x in held]) for name in held[0]}


def bucket_of(w: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the steps after each word."""
    mixed = (w.view(np.uint64) ^ (w.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def packed(w: np.ndarray, before: np.ndarray, after: np.ndarray, row: np.ndarray, buckets: int, parts: int = 1) -> pa.RecordBatch:
    """One row a part of a bucket: steps to often words, sorted by the word before, columns in planes of bytes, squeezed.

    Rows' numbers lie within 2^32 of each other."""
    bucket = bucket_of(w, buckets * parts)
    order = np.lexsort((w, bucket))
    bucket, w, before, after, row = (x[order] for x in (bucket, w, before, after, row))
    press = zstandard.ZstdCompressor(3)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    numbers, packs = [], []
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        runs, sizes = np.unique(w[a:b], return_counts=True)
        base = int(row[a:b].min())
        planes = np.stack([before[a:b] >> 32, before[a:b] & 0xFFFFFFFF, after[a:b], np.diff(row[a:b] - base, prepend=0)]).astype(np.uint32)
        body = b"".join((np.array([b - a, len(runs), base]).tobytes(), runs.tobytes(), sizes.astype(np.uint32).tobytes(),
                         planes.view(np.uint8).reshape(4, b - a, 4).transpose(0, 2, 1).tobytes()))
        numbers.append(bucket[a])
        packs.append(press.compress(body))
    numbers = np.array(numbers, np.int32)
    columns = {"bucket": pa.array(numbers // parts), "w": pa.array(numbers % parts, pa.int64()), "part": pa.array(numbers % parts),
               "pack": pa.array(packs, pa.binary())}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(packs), f.type)) for f in SENT], schema=SENT)


def unpacked(pack: bytes) -> tuple[np.ndarray, ...]:
    """``w, before, next, row`` of a pack."""
    body = zstandard.decompress(pack)
    n, kinds, base = np.frombuffer(body, np.int64, 3).tolist()
    runs, sizes = np.frombuffer(body, np.int64, kinds, 24), np.frombuffer(body, np.uint32, kinds, 24 + 8 * kinds)
    planes = np.frombuffer(body, np.uint8, 16 * n, 24 + 12 * kinds).reshape(4, 4, n).transpose(0, 2, 1)
    near, far, after, row = np.ascontiguousarray(planes).view(np.uint32).reshape(4, n)
    return (np.repeat(runs, sizes), near.astype(np.int64) << 32 | far, after.astype(np.int64),
            np.cumsum(row, dtype=np.uint32).astype(np.int64) + base)


def by_part(batches):
    """Packs and other steps of one part after the other, from rows in the order of their parts."""
    packs, plain, last = [], [], None
    for batch in batches:
        part = batch.column("part").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)).tolist()
        for a, b in zip([0, *ends], ends):
            if a == b:
                continue
            if part[a] != last:
                if packs or plain:
                    yield packs, plain
                packs, plain, last = [], [], part[a]
            mine = batch.slice(a, b - a)
            packs += mine.column("pack").drop_null().to_pylist()
            rest = mine.select(STEPS.names).filter(mine.column("pack").is_null())
            if rest.num_rows:
                plain.append(rest)
    if packs or plain:
        yield packs, plain


def bucket_groups(batches, n_of: np.ndarray, size: int = 200_000, *_):
    """Columns of a task's steps, sorted by the word before, in parts that hold all steps after a word; of more than ``size``
    steps if they are after one word."""
    for packs, plain in by_part(batches):
        held = []
        for w, before, after, row in map(unpacked, packs):
            held.append((w, before, after, n_of[after], row))
        for batch in plain:
            held.append(tuple(batch.column(name).to_numpy() for name in STEPS.names))
        packs.clear()
        plain.clear()
        columns = dict(zip(STEPS.names, map(list, zip(*held))))
        held.clear()
        # One column after the other, so that only one is there twice.
        steps = {name: np.concatenate(columns.pop(name)) for name in STEPS.names}
        order = np.argsort(steps["w"], kind="stable")
        for name in STEPS.names:
            steps[name] = steps[name][order]
        yield from cut(steps, steps["w"], size)


def cut(steps: dict[str, np.ndarray], key: np.ndarray, size: int):
    """Slices of columns sorted by a key, of ``size`` rows at most unless they have one key."""
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    at = 0
    while at < len(key):
        last = np.searchsorted(ends, at + size, "right") - 1
        end = int(ends[last]) if last >= 0 and ends[last] > at else int(ends[last + 1])
        yield {name: x[at:end] for name, x in steps.items()}
        at = end


def by_second_word(steps: dict[str, np.ndarray], whole: float, gain: float, least: int, size: int = 200_000):
    """The steps after one word in slices that hold all steps after two words, with their chances ``p`` after the one.

    So the steps after a very often word, which a task has in one part, are not walked all at once."""
    symbols, at = np.unique(steps["next"], return_inverse=True)
    n_of = np.zeros(len(symbols), np.int64)
    n_of[at] = steps["n"]
    n = np.bincount(at[steps["row"] & 1 == 0], minlength=len(symbols))
    parent = (n_of + 0.5) / whole
    total, kinds = n.sum(), np.count_nonzero(n)
    won = (n * np.log(np.maximum(n, 1) / parent)).sum() - total * np.log(max(total, 1))
    kept = total >= least and won > gain * kinds
    steps = steps | {"p": ((n + kinds * parent) / (total + kinds) if kept else parent)[at]}
    del at
    order = np.argsort(steps["before"])
    for name in list(steps):
        steps[name] = steps[name][order]
    return cut(steps, steps["before"] >> 32, size)


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The parts' rows, each once and in order, and the sums of their other columns."""
    row, *others = map(np.concatenate, zip(*parts))
    order = np.argsort(row, kind="stable")
    row = row[order]
    firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[:len(row)])
    return row[firsts], *(np.add.reduceat(x[order], firsts) for x in others)


def sums(parts, size: float = 1_000_000, least: int = 600_000):
    """Columns of ``SUMMED`` over many parts, in batches of about ``size`` rows or more, each of which has a row once.

    Parts are added up when they have ``least`` entries, or as many as there are sums."""
    held: list[tuple[np.ndarray, ...]] = []
    n = rows = 0

    def batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=SUMMED[:len(columns)])

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= max(least, rows):
            held, n = [added(held)], 0
            rows = len(held[0][0])
            if rows >= size:
                yield batch(held[0])
                held, rows = [], 0
    if held:
        yield batch(added(held))


def squeeze(columns: list[np.ndarray]) -> bytes:
    mine = np.stack([x.view(np.int64) for x in columns])
    mine[0] = np.diff(mine[0], prepend=0)
    body = mine.view(np.uint8).reshape(*mine.shape, 8).transpose(0, 2, 1).tobytes()
    return zstandard.compress(bytes([len(columns)]) + body, 1)


def squeezed(columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """One row a part of the texts: columns of ``SUMMED`` sorted by row, in planes of bytes, squeezed."""
    # A part has sixteen neighbours at once, so that their rows' differences are small.
    part = bucket_of(columns[0] >> 5, parts)
    order = np.lexsort((columns[0], part))
    part, columns = part[order], [x[order] for x in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    numbers, packs = [], []
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            numbers.append(part[a])
            packs.append(squeeze([x[a:b] for x in columns]))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packs, pa.binary())], names=["part", "pack"])


def unsqueezed(pack: bytes) -> tuple[np.ndarray, ...]:
    """All columns of ``SUMMED``; those that the pack doesn't have are zero."""
    body = zstandard.decompress(pack)
    planes = np.frombuffer(body, np.uint8, len(body) - 1, 1).reshape(body[0], 8, -1).transpose(0, 2, 1)
    columns = list(np.ascontiguousarray(planes).view(np.int64)[:, :, 0])
    columns += [np.zeros(len(columns[0]), np.int64)] * (len(SUMMED) - len(columns))
    return np.cumsum(columns[0]), columns[1].view(np.float64), columns[2].view(np.float64), *columns[3:]


def gathered(found, parts: int, size: int = 4_000_000):
    """Packs of a task's sums, one a part of the texts, from columns of ``SUMMED`` in which a text may come again.

    They wait squeezed, and only one part's are added up at a time."""
    held: dict[int, list[bytes]] = {}
    for columns in found:
        batch = squeezed(columns, parts)
        for part, pack in zip(batch["part"].to_pylist(), batch["pack"].to_pylist()):
            held.setdefault(part, []).append(pack)
    numbers, packs, n = [], [], 0
    for part in sorted(held):
        mine = held.pop(part)
        numbers.append(part)
        packs.append(mine[0] if len(mine) == 1 else squeeze(added([unsqueezed(x) for x in mine])))
        n += len(packs[-1])
        if n >= size or not held:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packs, pa.binary())], names=["part", "pack"])
            numbers, packs, n = [], [], 0


def totals(batches):
    """The texts of a part, from all packs of their sums."""
    for found in sums((unsqueezed(pack.as_py()) for batch in batches for pack in batch.column("pack")), math.inf):
        ids = pa.array(found["doc_id"].to_numpy(), mask=found["with_id"].to_numpy() == 0)
        columns = {name: found[name] for name in SUMMED} | {"doc_id": ids}
        texts = pa.RecordBatch.from_arrays([columns[f.name] for f in WON], schema=WON)
        for at in range(0, len(texts), 20_000):
            yield texts.slice(at, 20_000)


def scores(docs: DataFrame, held_out: Column, least_share: float = 1e-6, depth: int = 3, gain: float = 3.0,
           least_count: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every whole text from the words of the rows that are not ``held_out``.

    ``base_score`` is the root's score of all tokens, ``score`` the tree's.  The commonest words are often: at most
    1 / ``least_share`` of them, whose hashes and counts are broadcast (20 bytes a word).  The counts of other words are joined.
    Which words are often changes no result, unless two seldom words further before have one code of 31 bits."""
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"contexts have 1 to {MOST_DEPTH} words")
    spark = docs.sparkSession
    # A row's number by its place in the scan, which a union of stages doesn't shift.
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         held_out.alias("held_out"))
    counts = materialise_and_free(word_counts(chosen.where(~F.col("held_out"))))
    total, kinds, least_level, hashes, n_of = often_words(counts, round(1 / least_share))
    order = np.argsort(hashes)
    whole = total + 0.5 * (kinds + 1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = min(hot_rows(spark), max(20_000, 4 * total // tasks))
    hot = np.flatnonzero(n_of > limit).tolist()
    # Each bucket gives each text a sum, so there are only as many as the cores or a bucket's size ask for.
    buckets = max(2 * spark.sparkContext.defaultParallelism, total // BUCKET + 1)
    # Training texts have an end each, the empty word.
    text_groups = max(tasks, int(n_of[hashes == np.uint64(xxhash.xxh64_intdigest(b"", 42)).view(np.int64)].sum()) // TEXTS + 1)
    shared = share(spark, (hashes[order], order.astype(np.int32), n_of))

    def coded(batches):
        """Texts in parts: ids, sides, rows' numbers, different words, tokens by number, their codes and the texts' first places."""
        hashes, numbers, _ = opened(shared)
        for batch in batches:
            for part in text_parts(batch):
                kinds, tokens, starts = tokenised(part.column("text"))
                yield (part.column("doc_id"), part.column("held_out").to_numpy(zero_copy_only=False), part.column("row").to_numpy(), kinds, tokens,
                       codes_of(kinds, hashes, numbers)[tokens], starts)

    def placed(sides, row, codes, starts):
        """For each token: its row, its place in the text, the word before it and those before that."""
        sizes = np.diff(np.append(starts, len(codes)))
        rows = np.repeat(row << 1 | sides.astype(np.int64), sizes)
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        small = short(codes)
        w, near, far = np.zeros((3, len(codes)), np.int64)
        w[1:] = codes[:-1]
        if depth > 1:
            near[2:] = small[:-2]
        if depth > 2:
            far[3:] = small[:-3]
        before = np.where(place > 1, near, 0) << 32 | np.where(place > 2, far, 0)
        return rows, np.where(place > 0, w, -1 - rows), np.where(place > 0, before, NO_CONTEXT)

    def often_steps(batches, size: int = min(2_000_000, max(1_000_000, 500 * buckets * PARTS))):
        n_of = opened(shared)[2]
        base = np.log10((n_of + 0.5) / whole)
        waiting, n = [], 0
        for ids, sides, row, _, _, codes, starts in coded(batches):
            rows, w, before = placed(sides, row, codes, starts)
            mine = codes < HASHED
            number = np.where(mine, codes, 0)
            own = rows[starts]
            known = np.add.reduceat(mine, starts, dtype=np.int64)
            score = np.add.reduceat(np.where(mine, base[number] if len(base) else 0.0, 0.0), starts)
            at = np.flatnonzero(mine & (before >= 0) & ~np.isin(w, hot))
            sizes = np.diff(np.append(starts, len(codes)))
            null = ids.is_null().to_numpy(zero_copy_only=False)
            parts = ((-1 - own, np.full(len(ids), SUMS), score.view(np.int64), known, own),
                     (-1 - own, np.where(null, WITHOUT_ID, WITH_ID), ids.fill_null(0).to_numpy(), sizes, own))
            columns = [np.concatenate(x) for x in zip(*parts)]
            number = bucket_of(columns[0], buckets * PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(number // PARTS), pa.nulls(len(number), pa.binary()), *map(pa.array, columns), pa.array(number % PARTS)],
                                             schema=SENT)
            waiting.append((w[at], before[at], codes[at], rows[at]))
            n += len(at)
            if n >= size:
                yield packed(*map(np.concatenate, zip(*waiting)), buckets, PARTS)
                waiting, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*waiting)), buckets, PARTS)

    def hot_steps(batches):
        n_of = opened(shared)[2]
        for _, sides, row, _, _, codes, starts in coded(batches):
            rows, w, before = placed(sides, row, codes, starts)
            at = np.flatnonzero((codes < HASHED) & (before >= 0) & np.isin(w, hot))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w[at], before[at], codes[at], n_of[codes[at]], rows[at])], schema=STEPS)

    def seldom_steps(batches):
        for _, sides, row, kinds, tokens, codes, starts in coded(batches):
            rows, w, before = placed(sides, row, codes, starts)
            at = np.flatnonzero(codes >= HASHED)
            number = bucket_of(w[at], buckets * PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(number // PARTS), pa.array(w[at]), pa.array(before[at]), kinds.take(pa.array(tokens[at])),
                                              pa.array(rows[at]), pa.array(number % PARTS)], schema=SELDOM)

    def win(wide: int, keys: list[str]):
        """Sums for each row of steps that meet by the keys; contexts of ``wide`` words are behind them already."""
        def finer(groups, most: int = 600_000):
            for steps in groups:
                if wide or depth < 2 or len(steps["w"]) <= most or steps["before"].min() < 0:
                    yield steps, wide
                else:
                    yield from ((slices, 1) for slices in by_second_word(steps, whole, gain, least_count))

        def parts(groups, told):
            for steps, wide in finer(groups):
                row, before, n = steps["row"], steps["before"], steps["n"]
                tail = before < 0
                real = ~tail | (before == NO_CONTEXT)
                chances = np.where(real, (n + 0.5) / whole, 1.0)
                found = walk(steps["w"], before, steps["next"], row & 1 == 0, steps["p"] if wide else chances, depth, wide, gain, least_count)
                # Of often words the text's own row has the base score.
                own = real & (steps["next"] >= HASHED)
                whole_text = before == SUMS
                base = np.where(own, np.log10(chances), np.where(whole_text, steps["next"].view(np.float64), 0.0))
                yield row, base, np.log10(found / chances), np.where(own, n > 0, np.where(whole_text, n, 0))
                with_id = before == WITH_ID
                at = np.flatnonzero(with_id | (before == WITHOUT_ID))
                if len(at):
                    none = np.zeros(len(at), np.int64)
                    told.append((row[at], none, none, none, n[at], steps["next"][at], with_id[at].astype(np.int64)))

        def found(batches):
            told: list[tuple[np.ndarray, ...]] = []
            for batch in sums(parts(whole_groups(batches, keys) if wide else bucket_groups(batches, opened(shared)[2]), told)):
                yield [x.to_numpy() for x in batch.columns]
            if told:
                yield list(map(np.concatenate, zip(*told)))

        def run(batches):
            yield from gathered(found(batches), text_groups)
        return run

    c = F.coalesce(F.col("n"), F.lit(0))
    # A word's code as ``Codes`` has it.
    joined = (chosen.mapInArrow(seldom_steps, "bucket int, w long, before long, word binary, row long, part int")
              .join(counts.where(F.expr(LEVEL) < least_level), "word", "left")
              .select("bucket", F.lit(None).cast("binary").alias("pack"), "w", "before",
                      F.shiftrightunsigned(F.xxhash64("word"), 2).bitwiseOR(HASHED).alias("next"), c.alias("n"), "row", "part"))
    steps = chosen.mapInArrow(often_steps, "bucket int, pack binary, w long, before long, next long, n long, row long, part int")
    steps = steps.unionByName(joined.where(~F.col("w").isin(hot)) if hot else joined)
    won = steps.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("part").mapInArrow(win(0, []), PACKS)
    if hot:
        wide_steps = (chosen.mapInArrow(hot_steps, "w long, before long, next long, n long, row long")
                      .unionByName(joined.where(F.col("w").isin(hot)).drop("bucket", "pack", "part")))
        for wide, keys, part in _under_wide(wide_steps, whole, limit, depth, gain, least_count):
            won = won.unionByName(part.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(win(wide, keys), PACKS))
    return (won.repartitionById(text_groups, F.col("part")).mapInArrow(totals, WON_DDL)
            .select("doc_id", (F.col("row") % 2 == 1).alias("held_out"), "n_tokens", "n_known",
                    F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("won")).alias("score")))


def _under_wide(steps: DataFrame, whole: float, limit: int, depth: int, gain: float, least: int):
    """(words in the wide context, keys, steps with their chance ``p`` in it) of steps after wide words.

    A context is wide if it has more than ``limit`` steps; there are few.  The last part holds steps without a longer context."""
    left = materialise(steps.select("*", F.shiftright("before", 32).alias("near"), F.col("before").bitwiseAND(0xFFFFFFFF).alias("far"),
                                    ((F.col("n") + 0.5) / whole).alias("p")))
    names = ["w", "near", "far"]
    for length in range(1, depth + 1):
        keys = names[:length]
        # Counts by sums on both sides of the shuffle, also of the hottest pair; then of their contexts.
        pairs = left.groupBy(*keys, "next").agg(F.sum((F.col("row") % 2 == 0).cast("long")).alias("c"), F.min("p").alias("p"))
        term = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / F.col("p"))).otherwise(0.0)
        pairs = materialise(pairs)
        tested = pairs.groupBy(*keys).agg(F.sum("c").alias("_n"), F.count(F.when(F.col("c") > 0, 1)).alias("_k"), F.sum(term).alias("_t"))
        kept = tested.where((F.col("_n") >= least) & (F.col("_t") - F.col("_n") * F.log("_n") > gain * F.col("_k"))).drop("_t")
        better = (pairs.join(kept, keys).select(*keys, "next", ((F.col("c") + F.col("_k") * F.col("p")) / (F.col("_n") + F.col("_k"))).alias("_p")))
        left = materialise(left.join(better, [*keys, "next"], "left").withColumn("p", F.coalesce("_p", "p")).drop("_p"))
        if length == depth:
            break
        more = names[length]
        sizes = left.where(F.col(more) > 0).groupBy(*names[:length + 1]).agg(F.count(F.lit(1)).alias("_s"))
        # Fewer than steps / limit contexts.
        wide = F.broadcast(materialise(sizes.where(F.col("_s") > limit).drop("_s")))
        yield length, names[:length + 1], left.where(F.col(more) > 0).join(wide, names[:length + 1], "left_anti")
        yield MOST_DEPTH, ["row"], left.where(F.col(more) == 0)
        left = left.where(F.col(more) > 0).join(wide, names[:length + 1], "left_semi")
    yield MOST_DEPTH, ["row"], left

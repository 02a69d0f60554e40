"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Null texts count as empty: one end token.  Repeated rows are packed each.  Empty tables give empty
results.  Only documents longer than a sequence are cut; a very long text is tokenised by its words, whole.  Of items of equal
length the later row is taken first.  Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import record_batches, text_parts, tokenised, words
from cadencekit.session import materialise

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
SHARD_BITS = 31
#: Bytes of texts tokenised at once.
AT_ONCE = 3_000_000


TAIL = b".,!?;:|#$%&*"
ALPHANUMERIC = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class WordIds:
    """Little-endian ids of texts, word by word.

    The tokenizer drops white space and lowers case, so a text's ids are its words' ids in a row, and
    punctuation after a letter or digit is a token run of its own.  ``memory`` holds the words met lately in two
    generations: when the young one has ``most`` words it becomes the old one, and a word met again gets
    young again."""

    def __init__(self, path: str, memory: dict[str, dict[bytes, bytes]], most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.most = Tokenizer.from_file(path), memory, most
        self.known, self.old = (memory.setdefault(age, {}) for age in ("young", "old"))
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [words(text) for text in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, one)) for one in split]

    def arrays(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, each with the end's ids behind it, and the texts' ends there."""
        kinds, tokens, starts = tokenised(texts)
        kinds = kinds.to_pylist()[:-1]
        self.learn(set(kinds))
        found = pa.array([*map(self.known.__getitem__, kinds), end], pa.large_binary()).take(pa.array(tokens))
        _, places, ids = found.buffers()
        ends = np.frombuffer(places, np.int64)[np.append(starts[1:], len(tokens))] // 4
        return np.frombuffer(ids, "<u4", int(ends[-1])), ends

    def learn(self, new: set[bytes]) -> None:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
            self.memory.update(young=self.known, old=self.old)
        new = new.difference(self.known)
        self._recall(new)
        parts = {word: self._parts(word) for word in new.difference(self.known)}
        cores = {p for both in parts.values() for p in both}.difference(self.known)
        self._recall(cores)
        self._learn(list(cores.difference(self.known)))
        self.known.update({word: self.known[both[0]] if len(both) == 1 else self.known[both[0]] + self.known[both[1]]
                           for word, both in parts.items()})

    def _recall(self, new: set[bytes]) -> None:
        # Not by ``intersection``, which would go through all of the old generation.
        old = self.old
        self.known.update({word: old[word] for word in new if word in old})

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        low = word.lower()
        if low.isalnum():
            return (low,)
        core = low.rstrip(TAIL)
        return (core, low[len(core):]) if len(core) < len(low) and core and core[-1] in ALPHANUMERIC else (low,)

    def _learn(self, new: list[bytes], at_once: int = 2000) -> None:
        for at in range(0, len(new), at_once):
            some = [(word, word.decode()) for word in new[at:at + at_once]]
            letters, rest = ([x for x in some if x[1].isalpha() == alpha] for alpha in (True, False))
            self.known.update(self._by_ends(letters))
            self.known.update(self._by_places(rest))

    def _by_ends(self, some: list[tuple[bytes, str]]):
        """Ids of words of letters alone, of which each has one token that ends a word."""
        if not some:
            return ()
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(text for _, text in some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        return self._cut(some, ids, ends) if len(ends) == len(some) else self._by_places(some)

    def _by_places(self, some: list[tuple[bytes, str]]):
        if not some:
            return ()
        found = self.tokenizer.encode(" ".join(text for _, text in some), add_special_tokens=False)
        first = np.cumsum([0] + [len(text) + 1 for _, text in some[:-1]])
        owner = np.searchsorted(first, [start for start, _ in found.offsets], "right")
        return self._cut(some, np.array(found.ids, "<u4"), np.searchsorted(owner, np.arange(1, len(some) + 1), "right"))

    @staticmethod
    def _cut(some, ids, ends):
        packed, ends = ids.tobytes(), (4 * ends).tolist()
        return [(word, packed[a:b]) for (word, _), a, b in zip(some, [0, *ends[:-1]], ends, strict=True)]


def pieces(docs: DataFrame, limit: int = 4096, end_id: int = 1, tokenizer: str | None = None,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every whole text: ids, then the end id, cut into ``limit`` ids where longer.

    ``tokenizer`` is the vocabulary file's path on the executors; by default the public word BPE."""
    end = end_id.to_bytes(4, "little")
    # A Python worker keeps its copy of a broadcast from task to task, so this is its memory of words.
    memory = docs.sparkSession.sparkContext.broadcast({})

    def cut(batches):
        path = tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        vocabulary = WordIds(path, memory.value)

        def rows():
            for batch in batches:
                for part in text_parts(batch, AT_ONCE):
                    ids, ends = vocabulary.arrays(part.column("text"), end)
                    start = 0
                    for doc_id, stop in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                        for piece, at in enumerate(range(start, stop, limit)):
                            cut_ids = ids[at:min(at + limit, stop)]
                            yield doc_id, piece, at - start, len(cut_ids), zlib.crc32(cut_ids)
                        start = stop

        yield from record_batches(rows(), PIECES)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of indices into ``lengths``.

    A bin starts with the longest item left and takes the longest that fits until none does.  If a gap
    stays in a bin of several, its smallest item gives way to two unpacked items that fill more of the widened gap;
    it goes back to the pool.  The lengths that are left are the bits of one number.
    """
    pool: dict[int, list[int]] = {}
    for index, length in enumerate(lengths):
        pool.setdefault(length, []).append(index)
    left = sum(1 << length for length in pool)

    def take(length: int) -> int:
        nonlocal left
        index = pool[length].pop()
        if not pool[length]:
            left ^= 1 << length
        return index

    def longest(most: int) -> int:
        return (left & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    bins = []
    while left:
        chosen, gap = [], limit
        while (length := longest(gap)) > 0:
            chosen.append((length, take(length)))
            gap -= length
        if gap and left and len(chosen) > 1:
            smallest, index = chosen[-1]
            room = gap + smallest
            best, first = (smallest, 0, 0), longest(room - 1)
            while first > 0 and 2 * first > best[0] and best[0] < room:
                second = longest(min(first, room - first))
                if second == first and len(pool[first]) < 2:
                    second = longest(first - 1)
                if second > 0 and first + second > best[0]:
                    best = (first + second, first, second)
                first = longest(first - 1)
            if best[1]:
                chosen[-1:] = [(best[1], take(best[1])), (best[2], take(best[2]))]
                pool[smallest].append(index)
                left |= 1 << smallest
        bins.append([index for _, index in chosen])
    return bins


def pack(parts: DataFrame, limit: int = 4096, shard_rows: int = 20_000) -> DataFrame:
    """Places pieces into sequences.  A piece of full length is a sequence of its own; the others are dealt
    evenly over shards of about ``shard_rows`` pieces, each packed in one task, which costs at most
    about one partly filled sequence a shard."""
    parts = materialise(parts).withColumn("_row", F.monotonically_increasing_id())
    full = parts.where(F.col("length") >= limit)
    rest = parts.where(F.col("length") < limit)
    shards = max(1, -(-rest.count() // shard_rows))

    def place(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("_row")
        lengths = shard["length"].to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, members in enumerate(best_two_fit(lengths, limit)):
            at = 0
            for index in members:
                sequence[index], offset[index] = number, at
                at += lengths[index]
        base = (shard["_shard"][0].as_py() << SHARD_BITS) + (1 << 62)
        return (shard.select(PIECES.names)
                .append_column("sequence_id", pa.array([base + n for n in sequence], pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    # Rows of a checkpoint keep their place, so their running number deals them out alike on a rerun.
    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    packed = dealt.groupBy("_shard").applyInArrow(place, PLACED)
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32",
                        F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)

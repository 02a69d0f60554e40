"""Exact removal of repeated 50-byte strings with a distributed difference-cover sort.

A difference cover is a sample of positions such that any two equal strings of the length meet a sampled position at the
same shift.  The classic cover takes positions by their remainder; here the text itself picks them (the least
hash among the grams of each 50-byte window, first one on ties), which needs a sixteenth of the positions
instead of two thirds and shifts with the text.

1. Each sampled position gets a triple of names: its gram, and with it what lies left and right of it as far as
   its windows reach.  Triples are sorted; equal neighbours of a later document are settled.
2. Where a gram and one side of it are equal but the surroundings are not, the names don't settle the order: the
   remaining windows go into a second sort by their own content, and adjacent entries with the same 50 bytes are compared.

Left out of the classic method: recursion on the names, the merge with the remaining suffixes and the suffix order.

Null texts count as empty, texts shorter than a window keep all bytes.  Rows without a ``doc_id`` take no part: they
neither lose bytes nor cost others any.  Rows that repeat an id are taken to repeat its text; they don't precede
each other.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import binary_column
from cadencekit.session import materialise_and_free

POSITION_BITS = 24
#: Texts are looked at in pieces of at most so many bytes, which overlap by a window less one.
PIECE = 1 << 20
SALTS = np.random.default_rng(50).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ``key`` is the gram's hash (31 bits) and those of the bytes just left and right of it (16 bits each).
NAMES = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
NAME_BITS = 48
MARK = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())])
# A place is position << 16 | first window's start + window length - position << 8 | number of windows; a mark is twice a
# place, plus 1 where its windows still have to be compared.


def mixed(words: np.ndarray) -> np.ndarray:
    """One number for each row of 8-byte words."""
    salted = (words ^ (words >> np.uint64(29))) * SALTS[:words.shape[1]]
    total = (salted ^ (salted >> np.uint64(32))).sum(axis=1, dtype=np.uint64) * SALTS[63]
    return total ^ (total >> np.uint64(31))


def strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of a length that start at the places; the data must reach that far."""
    padded = -(-length // 8) * 8
    rows = np.zeros((len(starts), padded), np.uint8)
    rows[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    return mixed(rows.view("<u8"))


def sampled(data: np.ndarray, valid: np.ndarray, window: int, gram: int):
    """Sampled positions with their gram's hash, first window and number of windows.

    ``valid`` tells which windows lie within one text."""
    n = len(data) - 7
    all_words = np.empty(n, np.uint64)
    for shift in range(8):
        all_words[shift::8] = np.frombuffer(data, "<u8", (n - shift + 7) // 8, shift)
    n = len(data) - gram + 1
    first, middle, second = all_words[:n], all_words[8:8 + n] if gram > 16 else all_words[:n], all_words[gram - 8:gram - 8 + n]
    hashes = first * SALTS[0] ^ (middle * SALTS[1] + (second ^ (second >> np.uint64(27))) * SALTS[2])
    hashes ^= hashes >> np.uint64(30)
    hashes *= SALTS[3]
    order = (hashes >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
    span, least, width = window - gram + 1, order, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:len(order) - span + 1], least[span - width:])
    starts = np.flatnonzero(valid[:len(least)])
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    chosen = (least[starts] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    change = np.flatnonzero(np.diff(chosen, prepend=-1))
    position, lowest = chosen[change], starts[change]
    count = np.diff(change, append=len(chosen))
    return position, (hashes[position] >> np.uint64(33)).astype(np.int64), lowest - position + window, count


def pieces(ids: list, bodies: list[bytes], window: int, gram: int):
    """Joins texts to buffers of bounded size: bytes, owner's index, place in the text, valid windows.

    Between texts lie so many zeros that no context reaches another text."""
    gap = bytes(window)
    parts, index, size = [gap], [], window

    def done():
        data = np.frombuffer(b"".join(parts), np.uint8)
        return data, np.array(index, np.int64).reshape(-1, 4)

    for i, (doc_id, body) in enumerate(zip(ids, bodies)):
        if doc_id is None:
            continue
        for at in range(0, max(1, len(body) - window + 1), PIECE):
            part = body[at:at + PIECE + window - 1]
            if len(part) < window:
                continue
            if size + len(part) > PIECE and index:
                yield done()
                parts, index, size = [gap], [], window
            index.append((i, size, len(part), at))
            parts += [part, gap]
            size += len(part) + window
    if index:
        yield done()


def names(batch: pa.RecordBatch, window: int, gram: int):
    """Triples of a batch.  Of equal triples only those of the least id are sent to the sort; the others are
    settled here and carry a negative key."""
    ids = batch.column("doc_id").to_pylist()
    side = -(-(window - gram) // 2)
    for data, index in pieces(ids, binary_column(batch, "text"), window, gram):
        owner = np.full(len(data), -1, np.int64)
        valid = np.zeros(len(data), bool)
        for row, (_, start, length, _) in enumerate(index.tolist()):
            owner[start:start + length] = row
            valid[start:start + length - window + 1] = True
        position, grams, lowest, count = sampled(data, valid, window, gram)
        if not len(position):
            continue
        context = strings(data, position - (window - gram), 2 * window - gram).view(np.int64)
        # With the same surroundings and the same windows, all of the windows are equal.
        context += (lowest << 8 | count) * 0x9E3779B97F4A7
        context = (context.view(np.uint64) >> np.uint64(64 - NAME_BITS)).astype(np.int64)
        left, right = (strings(data, position + shift, side) >> np.uint64(48) for shift in (-side, gram))
        key = grams << 32 | (left << np.uint64(16) | right).astype(np.int64)
        row = owner[position]
        doc = np.array([ids[i] for i in index[:, 0]], np.int64)[row]
        place = ((position - index[row, 1] + index[row, 3]) << 16) | (lowest << 8) | count
        order = np.lexsort((doc, context, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(context[order]) != 0)
        least = np.empty_like(doc)
        least[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        settled = doc > least
        # In the order of the text, so that neighbouring rows compress well.
        key = np.where(settled, -1 - (((place >> 16) * 31 + doc & 0xFFFFF) << 32), key)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.where(settled, 0, context), doc, place)], schema=NAMES)


def settle(batches, window: int, gram: int):
    """Marks from triples sorted by key, name and id.

    A row of a later id than its triple's first is settled.  The first ones are compared further if a
    string of half a window or more around the gram is met in another document: then the bytes on one side are
    the same.  The gram that a batch ends in waits for the next batch with its first rows only."""
    held = np.empty((0, 4), np.int64)
    last = None  # key, name and least id of the last row
    for batch in batches:
        key, name, doc, place = (batch.column(c).to_numpy() for c in NAMES.names)
        n = len(key)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        new[0] = last is None or last[:2] != (key[0], name[0])
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        least = np.where(first >= 0, doc[np.maximum(first, 0)], last[2] if last else 0)
        settled = (key < 0) | (doc > least)
        yield from _marks(np.stack([doc[settled], place[settled]], axis=1), False)
        leading = np.concatenate([held, np.stack([key, name, doc, place], axis=1)[~settled]])
        still = leading[:, 0] >> 32 == key[-1] >> 32
        held = leading[still]
        yield from _marks(met_elsewhere(leading[~still], window, gram), True)
        last = (key[-1], name[-1], least[-1])
    yield from _marks(met_elsewhere(held, window, gram), True)


def met_elsewhere(leading: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Id and place of the rows whose gram and left or right side are another document's too, with the windows
    that hold the matching side whole: others can't be equal."""
    if not len(leading):
        return leading[:, 2:]
    key, doc, place = leading[:, 0], leading[:, 2], leading[:, 3]
    found = np.zeros((2, len(leading)), bool)
    for mine, side in zip(found, (key >> 16, key >> 32 << 16 | key & 0xFFFF)):
        order = np.lexsort((doc, side))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(side[order]) != 0
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(order)) - 1
        several = doc[order][starts] != doc[order][ends]
        mine[order] = np.repeat(several, ends - starts + 1)
    side = -(-(window - gram) // 2)
    first, count = place >> 8 & 0xFF, place & 0xFF
    lowest = np.where(found[0], first, np.maximum(first, side + gram))
    highest = np.where(found[1], first + count - 1, np.minimum(first + count - 1, window - side))
    wanted = found.any(axis=0) & (lowest <= highest)
    place = place >> 16 << 16 | lowest << 8 | highest - lowest + 1
    return np.stack([doc, place], axis=1)[wanted]


def _marks(rows: np.ndarray, compare: bool):
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] << 1 | int(compare))], schema=MARK)


def windows(marks: np.ndarray, window: int) -> np.ndarray:
    """The starts of the windows of each mark."""
    place = marks >> 1
    count = place & 0xFF
    start = (place >> 16) + ((place >> 8) & 0xFF) - window
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def open_windows(batch: pa.RecordBatch, window: int):
    """Content, id and start of the windows that still have to be compared; of equal ones in a batch only the least
    id's is sent on, the others are settled here and carry a negative content of their own."""
    content, doc, start = [], [], []
    for doc_id, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("marks")):
        if not marks.is_valid:
            continue
        body = zstandard.decompress(text.as_py())
        marks = marks.values.to_numpy()
        starts = windows(marks[marks & 1 == 1], window)
        starts = starts[starts <= len(body) - window]
        for at in range(0, len(starts), 1 << 16):
            some = starts[at:at + (1 << 16)]
            content.append(strings(np.frombuffer(body, np.uint8), some, window))
            doc.append(np.full(len(some), doc_id))
            start.append(some)
    if not content:
        return
    content = (np.concatenate(content) >> np.uint64(1)).astype(np.int64)
    doc, start = np.concatenate(doc), np.concatenate(start)
    order = np.lexsort((doc, content))
    content, doc, start = content[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = content[1:] != content[:-1]
    settled = np.empty(len(order), bool)
    settled[order] = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    back = np.argsort(order)
    content, doc, start = content[back], doc[back], start[back]
    content = np.where(settled, -1 - (start * 31 + doc & 0xFFFFF), content)
    yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(doc), pa.array(start)], names=["content", "doc_id", "start"])


def adjacent(batches, window: int):
    """Marks of one window each, from windows sorted by content and id."""
    last = None
    for batch in batches:
        content, doc, start = (batch.column(c).to_numpy() for c in ("content", "doc_id", "start"))
        if not len(content):
            continue
        new = np.ones(len(content), bool)
        new[1:] = content[1:] != content[:-1]
        new[0] = last is None or last[0] != content[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(content)), -1))
        least = np.where(first >= 0, doc[np.maximum(first, 0)], last[1] if last else 0)
        later = (content < 0) | (doc > least)
        last = (content[-1], least[-1])
        if later.any():
            yield from _marks(np.stack([doc[later], start[later] << 16 | window << 8 | 1], axis=1), False)


def removed(body: bytes, marks: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs of removed bytes, and the bytes kept."""
    place = marks[marks & 1 == 0] >> 1
    start = (place >> 16) + ((place >> 8) & 0xFF) - window
    end = np.minimum(start + (place & 0xFF) + window - 1, len(body))
    if not len(start):
        return 0, 0, body
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    froms, tos = start[opens], reach[np.concatenate([opens[1:] - 1, [len(reach) - 1]])]
    kept, at = [], 0
    for a, b in zip(froms.tolist(), tos.tolist()):
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    return int((tos - froms).sum()), len(froms), b"".join(kept)


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 16, key: str = "doc_id", text: str = "text",
                   with_kept: bool = True) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes, after the removal of each byte
    that a ``window`` bytes long string covers which also starts in a document with a smaller id.

    Triples are equal if hashes of 111 bits in all are, of which 48 are of the whole surroundings; windows, if hashes of
    63 bits are."""
    if not 16 <= gram <= 24 or window < gram + 8 or window > 127:
        raise ValueError("a gram has 16 to 24 bytes, a window 8 more at least and at most 127")
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def name(batches):
        for batch in batches:
            yield from names(batch, window, gram)

    def reopen(batches):
        for batch in batches:
            yield from open_windows(batch, window)

    def single(batches):
        yield from adjacent(batches, window)

    def finish(batches):
        for batch in batches:
            out = []
            for text, one, two in zip(batch.column("text"), batch.column("marks"), batch.column("more")):
                body = zstandard.decompress(text.as_py())
                marks = np.concatenate([x.values.to_numpy() if x.is_valid else np.empty(0, np.int64) for x in (one, two)])
                gone, spans, kept = removed(body, marks, window)
                out.append((len(body), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def order(batches):
        yield from settle(batches, window, gram)

    def squeeze(batches):
        """Texts as shuffled: squeezed further than Spark does by itself."""
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            bodies = pa.array([press.compress(body) for body in binary_column(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bodies], names=["doc_id", "text"])

    triples = chosen.mapInArrow(name, "key long, name long, doc_id long, place long")
    dealt = triples.repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "name", "doc_id")
    # The triples' shuffle, the largest by far, is gone before the texts are shuffled.
    marks = materialise_and_free(dealt.mapInArrow(order, "doc_id long, mark long").groupBy("doc_id")
                                 .agg(F.collect_list("mark").alias("marks")))
    # Both uses of the marked texts read the same shuffle.
    squeezed = chosen.mapInArrow(squeeze, "doc_id long, text binary")
    marked = squeezed.join(marks, "doc_id", "left").select("doc_id", "text", "marks")
    opened = marked.mapInArrow(reopen, "content long, doc_id long, start long")
    found = opened.repartition("content").sortWithinPartitions("content", "doc_id").mapInArrow(single, "doc_id long, mark long")
    more = found.groupBy("doc_id").agg(F.collect_list("mark").alias("more"))
    return (marked.join(more, "doc_id", "left").select("doc_id", "text", "marks", "more")
            .mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))

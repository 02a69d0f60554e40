"""Language identification with interpolated Kneser-Ney character models, one per language.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  Rows without a language are not
learned from.  Where nothing can be learned, every text is ``und``.  Ties go to the language that sorts
first.  Repeated rows are predicted each.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import opened, record_batches, share, unit_hash

LETTERS = re.compile(r"[^\W\d_]+")
START, STOP = 0x110000, 0x110001
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The base distribution is uniform over so many symbols.
SYMBOLS = 1024
UNKNOWN = "und"


def letter_runs(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def gram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1 to ``order``: hashes of the n symbols that end at each place of the framed words.

    Also each place's number within its word (0 is the start mark) and its word's index.  A hash is valid
    where the place's number is at least n - 1.
    """
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    codes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(codes), bool)
    codes[ends - sizes], codes[ends - 1] = START, STOP
    inner[ends - sizes] = inner[ends - 1] = False
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    mixed = (codes + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    mixed ^= mixed >> np.uint64(29)
    hashes, current = [mixed], mixed
    for n in range(1, order):
        longer = mixed.copy()
        longer[1:] += current[:-1] * MULTIPLIER
        current = longer
        hashes.append(current)
    return hashes, place, owner


def kneser_ney(words: list[str], counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n: sorted hashes of the seen n-grams, their discounted probabilities, and the back-off
    weights of the same n-grams as contexts (1 where none follows).

    The longest n-grams, and those that begin at the start mark, have their counts; others the number of
    symbols seen before them.
    """
    hashes, place, owner = gram_hashes(words, order)
    tables, before = [], None
    found = []
    for n in range(order, 0, -1):
        ends = np.flatnonzero((place >= n - 1) & (place >= 1))
        if n == 1:
            ends = np.flatnonzero(place >= 1)
        grams, first, inverse = np.unique(hashes[n - 1][ends], return_index=True, return_inverse=True)
        last = ends[first]
        weight = np.bincount(inverse, counts[owner[ends]], len(grams)).astype(float)
        if before is not None:
            suffixes = np.searchsorted(grams, hashes[n - 1][before])
            extended = place[last] >= n
            weight = np.where(extended, np.bincount(suffixes, minlength=len(grams)), weight)
        found.append((n, grams, last, weight))
        before = last
    follow: dict[int, tuple] = {}
    for n, grams, last, weight in found:
        once, twice = float((weight == 1).sum()), float((weight == 2).sum())
        discount = min(0.95, once / (once + 2 * twice)) if once else 0.5
        context = hashes[n - 2][last - 1] if n > 1 else np.zeros(len(last), np.uint64)
        owners, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, weight)
        spare = discount * np.bincount(which) / total
        follow[n] = (owners, spare)
        tables.append((n, grams, np.maximum(weight - discount, 0) / total[which]))
    out = []
    for n, grams, probability in reversed(tables):
        backoff = np.ones(len(grams))
        if n + 1 in follow:
            owners, spare = follow[n + 1]
            at = np.searchsorted(owners, grams)
            at[at == len(owners)] = 0
            backoff = np.where(owners[at] == grams, spare[at], 1.0)
        out.append((grams, probability, backoff))
    # The start mark is a context but never follows one; the empty context belongs to no n-gram.
    start = (np.array([START], np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    start ^= start >> np.uint64(29)
    owners, spare = follow.get(2, (np.empty(0, np.uint64), np.empty(0)))
    at = np.flatnonzero(owners == start[0])
    first_grams, first_probability, first_backoff = out[0]
    slot = int(np.searchsorted(first_grams, start[0]))
    out[0] = (np.insert(first_grams, slot, start[0]), np.insert(first_probability, slot, 0.0),
              np.insert(first_backoff, slot, spare[at[0]] if len(at) else 1.0))
    empty = np.array([float(follow[1][1][0]) if len(follow[1][1]) else 1.0])
    return [*out, (np.zeros(0, np.uint64), empty, empty)]


class Models:
    """The models of all languages: per n one sorted array of hashes and a column per language."""

    def __init__(self, languages: list[str], tables: dict[str, list]):
        self.languages = sorted(languages)
        self.order = len(next(iter(tables.values()))) - 1 if tables else 0
        self.empty = np.array([tables[x][-1][1][0] for x in self.languages])
        self.levels = []
        for n in range(self.order):
            grams = np.unique(np.concatenate([tables[x][n][0] for x in self.languages]))
            probability = np.zeros((len(grams), len(self.languages)), np.float32)
            backoff = np.ones((len(grams), len(self.languages)), np.float32)
            for column, name in enumerate(self.languages):
                own, p, b = tables[name][n]
                at = np.searchsorted(grams, own)
                probability[at, column], backoff[at, column] = p, b
            self.levels.append((grams, probability, backoff))

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each framed word under each language."""
        hashes, place, owner = gram_hashes(words, self.order)
        chance = np.tile(self.empty / SYMBOLS, (len(place), 1))
        back = None
        for n, (grams, probability, backoff) in enumerate(self.levels):
            at = np.searchsorted(grams, hashes[n])
            at[at == len(grams)] = 0
            seen = (grams[at] == hashes[n]) & (place >= n)
            if back is not None:
                chance[1:] = np.where((place[1:] >= n)[:, None], chance[1:] * back[:-1], chance[1:])
            chance += np.where(seen[:, None], probability[at], 0)
            back = np.where(seen[:, None], backoff[at], 1.0)
        logs = np.log(np.maximum(chance, 1e-30))
        logs[place == 0] = 0
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(logs, starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)))


class Judge:
    """Adds up word scores, which are kept for ``most`` different words."""

    def __init__(self, models: Models, most: int = 200_000):
        self.models, self.most, self.known = models, most, {}

    def totals(self, texts: list[str]) -> list[tuple[np.ndarray, int] | None]:
        counted = [Counter(letter_runs(text)) for text in texts]
        new = list({w for c in counted for w in c if w not in self.known})
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list({w for c in counted for w in c})
        if new:
            self.known.update(zip(new, self.models.score(new)))
        out = []
        for runs in counted:
            if not any(ch.isalpha() for w in runs for ch in w):
                out.append(None)
                continue
            total = np.array([self.known[w] for w in runs]).T @ np.array(list(runs.values()), float)
            out.append((total, sum((len(w) + 1) * n for w, n in runs.items())))
        return out


def _slices(batch: pa.RecordBatch, most: int = 2_000_000):
    """Texts in groups of bounded length, so that one batch of long texts needs bounded memory."""
    texts = batch.column("text").to_pylist()
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > most:
            yield batch.slice(start, i + 1 - start), texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def train(docs: DataFrame, order: int = 4, most_docs: int = 3000, most_languages: int = 1000, reject: float = 0.9995,
          margin: float = 0.35, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Models, dict] | None:
    """Models from a sample of about ``most_docs`` documents a language, picked by a hash of key and text,
    and each language's limit of the entropy in nats a character: the ``reject`` quantile of its own sample
    plus ``margin``.  The bounds of the sample bound the models, which are broadcast; there can be at most
    ``most_languages``."""
    # Rows without a key would all be picked or none.
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    labelled = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
                             unit_hash(F.col(key)).alias("_u"))
    counts = usable.groupBy(
        F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("_n")).limit(most_languages + 1)
    shares = {r["lang"]: most_docs / r["_n"] for r in counts.collect()}
    if len(shares) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not shares:
        return None
    portion = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang"))
    sample = labelled.where(F.col("_u") < portion).select("lang", "text")

    def count(batches):
        def rows():
            for batch in batches:
                per: dict[str, Counter] = {}
                for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    per.setdefault(name, Counter()).update(letter_runs(body))
                for name, runs in per.items():
                    for word, n in runs.items():
                        yield name, word, n

        yield from record_batches(rows(), pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    vocabulary = (sample.mapInArrow(count, "lang string, word string, n long")
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        levels = kneser_ney(group["word"].to_pylist(), group["n"].to_numpy(), order)
        name = group["lang"][0].as_py()
        return pa.table({"lang": [name] * len(levels), "n": pa.array(range(len(levels)), pa.int32()),
                         "grams": [x[0].tobytes() for x in levels], "p": [x[1].tobytes() for x in levels],
                         "b": [x[2].tobytes() for x in levels]})

    tables: dict[str, list] = {}
    for row in vocabulary.groupBy("lang").applyInArrow(
            fit, "lang string, n int, grams binary, p binary, b binary").orderBy("lang", "n").collect():
        tables.setdefault(row["lang"], []).append(tuple(np.frombuffer(row[c], t) for c, t in (
            ("grams", np.uint64), ("p", np.float64), ("b", np.float64))))
    if not tables:
        return None
    models = Models(list(tables), tables)
    names = models.languages
    shared = share(docs.sparkSession, models)

    def entropies(batches):
        judge = Judge(opened(shared))
        for batch in batches:
            for part, texts in _slices(batch):
                own, values = [], []
                for name, found in zip(part.column("lang").to_pylist(), judge.totals(texts)):
                    if found is not None and name in names:
                        own.append(name)
                        values.append(float(-found[0][names.index(name)] / found[1]))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(values, pa.float64())],
                                                 names=["lang", "h"])

    limits = {r["lang"]: r["q"] + margin for r in sample.mapInArrow(entropies, "lang string, h double").groupBy("lang")
              .agg(F.percentile("h", F.lit(reject)).alias("q")).collect()}
    return models, limits


def identify(docs: DataFrame, trained: tuple[Models, dict] | None, text: str = "text", prefix: str = "",
             chunk: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred`` (the language of least entropy a character), ``score`` (its
    share among the languages, from their entropies over the first hundred characters' worth of
    evidence), ``entropy`` and ``rejected`` (no letter, or above the language's limit)."""
    shared = share(docs.sparkSession, trained)
    columns = docs.columns
    inputs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
                         F.col(text).cast("string").alias("text"))
    fields = [(f"c{i}", t) for i, (_, t) in enumerate(docs.dtypes)]
    schema = ", ".join(f"{n} {t}" for n, t in fields) + ", lang_pred string, score double, entropy double, rejected boolean"

    def run(batches):
        models, limits = opened(shared) or (None, {})
        judge = Judge(models) if models else None
        for batch in batches:
            for part, texts in _slices(batch, chunk):
                names, scores, entropy, rejected = [], [], [], []
                found = judge.totals([t or "" for t in texts]) if judge else [None] * len(texts)
                for one in found:
                    if one is None:
                        values = (UNKNOWN, 0.0, None, True)
                    else:
                        h = -one[0] / one[1]
                        best = int(np.argmin(h))
                        name = judge.models.languages[best]
                        share = float(1 / np.exp((h[best] - h) * min(one[1], 100)).sum())
                        values = (name, share, float(h[best]), bool(h[best] > limits.get(name, np.inf)))
                    for to, value in zip((names, scores, entropy, rejected), values):
                        to.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n, _ in fields] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[n for n, _ in fields] + ["lang_pred", "score", "entropy", "rejected"])

    out = inputs.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
                      *[F.col(c).alias(prefix + c) for c in ("lang_pred", "score", "entropy", "rejected")])

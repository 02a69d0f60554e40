"""Toxicity by multiple-instance learning: a text is as toxic as the noisy-or of its sentences.

Null and empty texts have no sentence and score 0.  Rows without a label are not learned from; a document
with several labels counts as toxic if one says so.  Without labels of both kinds every score is 0.  Repeated
rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import unit_hash

SENTENCE = re.compile(r"[^.!?\n]+")
TERM = re.compile(r"[^\W\d_]+")


def sentence_terms(text: str) -> list[list[str]]:
    """Different lower-cased terms of each sentence, those without a term left out."""
    found = (TERM.findall(s) for s in SENTENCE.findall(text.lower()))
    return [list(dict.fromkeys(terms)) for terms in found if terms]


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, most_terms: int = 20_000, least_docs: int = 3,
        least_z: float = 4.5, rounds: int = 400, rate: float = 0.1, shrink: float = 2e-6) -> tuple[dict[str, float], float]:
    """Weights of terms and the bias of a sentence's logit, from labels of whole texts.

    The terms are the ``most_terms`` whose document frequencies tell the labels apart best, by a z score of
    ``least_z`` or more; the weighted log-loss of the noisy-or is then lessened with Adam."""
    bags = [sentence_terms(t) for t in texts]
    frequency = [Counter(), Counter()]
    for bag, label in zip(bags, labels):
        frequency[int(label)].update({t for s in bag for t in s})
    size = [max(1, int((labels == k).sum())) for k in (0, 1)]

    def apart(term: str) -> float:
        p, q = (frequency[k][term] / size[k] for k in (0, 1))
        mean = (frequency[0][term] + frequency[1][term]) / (size[0] + size[1])
        return abs(p - q) / np.sqrt(mean * (1 - mean) * (1 / size[0] + 1 / size[1]) + 1e-12)

    terms = [t for t in set(frequency[0]) | set(frequency[1]) if frequency[0][t] + frequency[1][t] >= least_docs]
    terms = sorted(sorted(t for t in terms if apart(t) >= least_z), key=apart, reverse=True)[:most_terms]
    index = {t: i for i, t in enumerate(terms)}
    sentence, feature, owner = [], [], []
    for doc, bag in enumerate(bags):
        for s in bag:
            hits = [index[t] for t in s if t in index]
            sentence += [len(owner)] * len(hits)
            feature += hits
            owner.append(doc)
    sentence, feature, owner = (np.array(x, np.int64) for x in (sentence, feature, owner))
    n_docs, n_sentences = len(texts), len(owner)
    share = weights / weights.sum()
    values = np.zeros(len(terms) + 1)
    values[-1] = -6.0
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, rounds + 1):
        logit = np.bincount(sentence, values[feature], n_sentences) + values[-1]
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(chance, 1 - 1e-12)), n_docs))
        toxic = np.maximum(1 - clean, 1e-9)
        pull = np.where(labels == 1, -clean / toxic, 1.0) * share
        slope = pull[owner] * chance
        gradient = np.append(np.bincount(feature, slope[sentence], len(terms)), slope.sum())
        gradient[:-1] += shrink * values[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        values -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return {t: float(v) for t, v in zip(terms, values) if abs(v) > 0.02}, float(values[-1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most_docs: int = 6000, key: str = "doc_id",
          text: str = "text", toxic: str = "toxic") -> tuple[dict[str, float], float] | None:
    """Fits on at most about ``most_docs`` labelled documents of each kind, picked by a hash of the key; the
    weights restore the kinds' shares.  ``allowed`` is a condition on ``labels``."""
    marked = (labels.where(allowed & F.col(toxic).isin(0, 1) & F.col(key).isNotNull())
              .groupBy(F.col(key).alias("doc_id")).agg(F.max(toxic).alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    weight = {k: max(1.0, n / most_docs) for k, n in counts.items()}
    picked = marked.where(unit_hash(F.col("doc_id")) * F.when(F.col("toxic") == 1, weight[1]).otherwise(weight[0]) < 1)
    # At most about 2 * most_docs rows of two numbers, whatever the input.
    bodies = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = bodies.where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.max("text").alias("text"))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        y = group["toxic"].to_numpy().astype(np.int64)
        terms, bias = fit(group["text"].to_pylist(), y, np.where(y == 1, weight[1], weight[0]))
        return pa.table({"term": pa.array([*terms, None], pa.string()), "weight": pa.array([*terms.values(), bias], pa.float64())})

    # The sample is bounded by the parameter, so one task fits it.
    learned = sample.groupBy(F.lit(0).alias("_all")).applyInArrow(learn, "term string, weight double").collect()
    weights = {r["term"]: r["weight"] for r in learned}
    if not weights:
        return None
    bias = weights.pop(None)
    return weights, bias


def judge(text: str, weights: dict[str, float], bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of a text and its sentences of a chance of one half or more as (start, end, chance)."""
    offending, clean = [], 0.0
    lowered = text.lower()
    same = len(lowered) == len(text)
    plain = np.log1p(-1 / (1 + np.exp(-bias)))
    for match in SENTENCE.finditer(lowered):
        terms = TERM.findall(match.group())
        if not terms:
            continue
        hits = weights.keys() & terms
        if not hits:
            clean += plain
            continue
        chance = 1 / (1 + np.exp(-min(30.0, bias + sum(weights[t] for t in hits))))
        clean += np.log1p(-chance)
        if chance >= 0.5:
            offending.append((match.start() if same else -1, match.end() if same else -1, float(chance)))
    return float(-np.expm1(clean)), offending


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``offending``, the sentences (start, end, chance) at fault in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [judge(t or "", *model) if model else (0.0, []) for t in batch.column("text").to_pylist()]
            spans = [[{"start": s, "end": e, "chance": c} for s, e, c in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.float64()),
                                              pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double, "
                                  "offending array<struct<start: bigint, end: bigint, chance: double>>")

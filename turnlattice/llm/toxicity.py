"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words; the document's is their noisy-or, so that
one bad sentence is enough. Only documents have labels: the gradient of their likelihood flows through the noisy-or to
the sentences, which afterwards say where a document offends.

`fit` reads at most `sample` labelled documents a class, chosen by a hash of doc_id, whatever the size of the corpus;
scoring is a map over all texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlattice.llm.common import crc_mod, with_answers

#: Bound of the fit: documents a class; each is read whole.
SAMPLE = 3000
#: Words are hashed to so many weights.
WEIGHTS = 1 << 18
STEPS, RATE, DECAY = 150, 0.15, 5e-6
#: Likelihood ratio that a word must have: chance exceeds it for about one word in 200,000.
LEAST_GAIN = 20.0
MEMO = 500_000
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n+")
_EDGES = ".,;:!?()[]{}\"'|*#&%$ \t"


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, in lower case and without marks at their ends; sentences without words are left out."""
    found = ([w for x in s.split() if (w := x.strip(_EDGES))] for s in _SENTENCE.split(text.lower()))
    return [s for s in found if s]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (WEIGHTS - 1)


@dataclass
class Model:
    """`bias` is the logit of a sentence without known words, `weights` those of the words."""

    bias: float
    weights: np.ndarray


class Scorer(dict):
    """Word -> weight; the words' hashes are remembered."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.weights = model, model.weights.tolist()

    def __missing__(self, word: str) -> float:
        found = self[word] = self.weights[bucket(word)]
        return found

    def sentence_scores(self, text: str) -> list[float]:
        if len(self) > MEMO:
            self.clear()
        get, bias = self.__getitem__, self.model.bias
        logits = np.array([bias + sum(map(get, set(s))) for s in sentences(text)] or [bias])
        return (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()


def noisy_or(scores: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the documents (doc_id, text) that `labels` (doc_id, toxic) marks 0 or 1.

    Of several labels for one doc_id the greatest counts, and of several documents one, so that the driver gets at most `sample`
    texts a class, as hashes of their words. Without documents of both classes the model answers one score for all.
    """
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = marked.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(11)).alias("_draw"))
    chosen = None
    for value in (0, 1):
        part = drawn.filter(F.col("toxic") == value).orderBy("_draw", "doc_id").limit(sample).select("doc_id", "toxic")
        chosen = part if chosen is None else chosen.unionByName(part)
    totals = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, place, words = [], [], []
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pairs = [(i, b) for i, s in enumerate(sentences(text or "")) for b in sorted({bucket(w) for w in s})]
                toxic.append(label)
                place.append([i for i, _ in pairs])
                words.append([b for _, b in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(place, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], ["toxic", "place", "words"])

    # two samples of fixed size are broadcast
    held = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    single = held.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    table = single.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(bags, "toxic int, place array<int>, words array<int>").toArrow()
    return learned(table.column("toxic").to_numpy(), [p.values.to_numpy() for p in table.column("place")], [w.values.to_numpy() for w in table.column("words")], totals)


def learned(toxic: np.ndarray, places: list[np.ndarray], buckets: list[np.ndarray], totals: dict) -> Model:
    """A model from bags: per document its label and, pairwise, sentence numbers and word buckets; totals: labels in the whole table."""
    if not len(toxic) or not toxic.any() or toxic.all():  # nothing to tell apart
        return Model(-4.0 if not len(toxic) or not toxic.any() else 4.0, np.zeros(WEIGHTS))
    place = [p.astype(np.int64) for p in places]
    words = np.concatenate(buckets).astype(np.int64)
    n_sentences = np.array([int(p.max()) + 1 if len(p) else 1 for p in place])
    first = np.concatenate([[0], np.cumsum(n_sentences)[:-1]])
    sentence = np.concatenate([p + f for p, f in zip(place, first, strict=True)])
    bag = np.repeat(np.arange(len(toxic)), n_sentences)
    share = {v: totals.get(v, 0) / max(1, int((toxic == v).sum())) for v in (0, 1)}
    weight = np.where(toxic == 1, share[1], share[0])  # as the classes stand in the whole table
    weight = weight / weight.sum()
    # only words that go with a class beyond chance: else rare words learn the documents by heart
    columns, own = np.unique(words, return_inverse=True)
    pairs = np.unique(own.astype(np.int64) * len(toxic) + bag[sentence])
    word, label = pairs // len(toxic), toxic[pairs % len(toxic)]
    in_all = np.bincount(word, minlength=len(columns)).astype(float)
    in_toxic = np.bincount(word, weights=label, minlength=len(columns))
    p = toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(in_toxic > 0, in_toxic * np.log(in_toxic / (in_all * p)), 0) + np.where(in_all > in_toxic, (in_all - in_toxic) * np.log((in_all - in_toxic) / (in_all * (1 - p))), 0))
    common = gain >= LEAST_GAIN
    keep = common[own]
    own, sentence = own[keep], sentence[keep]

    w, bias = np.zeros(len(columns)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, weights=w[own], minlength=len(bag))
        clean = np.bincount(bag, weights=np.logaddexp(0, z), minlength=len(toxic))  # -log of the noisy-or's complement
        slope = np.where(toxic == 1, -1 / np.expm1(np.clip(clean, 1e-9, 50)), 1.0) * weight
        dz = slope[bag] / (1 + np.exp(-z))
        g, gb = np.bincount(own, weights=dz[sentence], minlength=len(w)) + DECAY * w, dz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    weights = np.zeros(WEIGHTS)
    weights[columns] = np.where(common, w, 0)
    return Model(float(bias), weights)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """`documents` with score (0 to 1), predicted (1 if score >= 0.5), n_offending and worst_sentence.

    n_offending counts the sentences that score 0.5 or more, worst_sentence is the number of the highest (from 0). A null or
    empty text counts as one sentence without words. Repeated rows are answered each; an empty table gives no rows. All
    other columns stay, those of the same names apart.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def begin():
        scorer = Scorer(shared.value)

        def answer(text: str) -> tuple:
            own = scorer.sentence_scores(text)
            whole = noisy_or(own)
            return whole, int(whole >= 0.5), sum(x >= 0.5 for x in own), int(np.argmax(own))

        return lambda texts: [answer(t.as_py() or "") for t in texts]

    kinds = [T.DoubleType(), *[T.IntegerType()] * 3]
    return with_answers(documents, [T.StructField(n, k) for n, k in zip(("score", "predicted", "n_offending", "worst_sentence"), kinds, strict=True)], begin)


def training(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those whose crc32(doc_id) modulo 5 isn't 0."""
    return labels.filter(crc_mod("doc_id", 5) != 0)

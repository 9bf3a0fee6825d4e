"""Language identification by nearest centroid.

A text is the TF-IDF vector of its letter trigrams (bytes, lower case, all but letters as one space), scaled to length 1.
Trigrams that the model doesn't know lengthen the vector but match nothing. Each language has several centroids, from
spherical k-means over a bounded sample of labelled texts; the nearest by cosine gives the language, and a text that is too
far from all is rejected.

Vectors of single trigrams: `fit` reads at most `sample` texts a language, chosen by a hash of doc_id and text, whatever the
size of the corpus; scoring is a map over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlattice.llm.common import bound_batches, crc_mod, with_answers

#: Bounds of the fit: texts a language (each is read whole), trigrams that the model knows.
SAMPLE, FEATURES = 500, 6000
CENTROIDS, ROUNDS = 3, 12
#: A text is rejected if its cosine to the nearest centroid is under this share of what is usual for as many trigrams. Texts
#: of the languages learned stay above it, those in another script are far below.
REJECT = 0.3
UNKNOWN = "und"
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """The text in lower case, with one space for each run of what is no letter in ASCII, and one at each end."""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text as integers, repeats included."""
    data = np.frombuffer(letters(text), np.uint8).astype(np.int32)
    return (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """languages[i] is that of centroids[:, i]; `usual` is by the binary logarithm of a text's trigrams."""

    languages: list[str]
    known: np.ndarray
    idf: np.ndarray
    unknown_idf: float
    centroids: np.ndarray
    usual: np.ndarray

    def lookup(self) -> np.ndarray:
        """Trigram -> feature; all others -> the last."""
        table = np.full(1 << 24, len(self.known), np.int16)
        table[self.known] = np.arange(len(self.known))
        return table

    def vector(self, grams: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        counts = np.bincount(lookup[grams], minlength=len(self.known) + 1).astype(np.float32)
        weighed = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.append(self.idf, self.unknown_idf).astype(np.float32)
        return weighed / max(float(np.sqrt((weighed * weighed).sum())), 1e-12)

    def nearest(self, text: str, lookup: np.ndarray) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        grams = trigrams(text)
        near = self.vector(grams, lookup)[:-1] @ self.centroids
        best = int(near.argmax())
        score = min(1.0, max(0.0, float(near[best])))
        return self.languages[best], score, score < REJECT * self.usual[min(len(self.usual) - 1, int(np.log2(len(grams) + 1)))]


def _clusters(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; begins with the vectors that are farthest from those chosen before."""
    chosen = [vectors.mean(axis=0)]
    centres = [vectors[int((vectors @ chosen[0]).argmax())]]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[int((vectors @ np.array(centres).T).max(axis=1).argmin())])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        moved = np.array([vectors[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centres


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows (doc_id, text, lang) with a text and a lang. Repeated rows count each; from none nothing is learned.

    The driver gets the trigram counts of at most `sample` whole texts a language. A row is drawn by a hash of its doc_id and
    text, so that neither null nor repeated ids share a draw; of each language the least draw is in, however few there are.
    """
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(7)), F.lit(1 << 30))
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", draw.alias("_draw"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("_draw").alias("least")).collect()  # a row a language
    if not counts:
        return Model([], np.array([], np.int64), np.array([]), 1.0, np.zeros((0, 0)), np.ones(25))
    limits = F.create_map(*[x for r in sorted(counts) for x in (F.lit(r["lang"]), F.lit(max(r["least"], int(min(1.0, sample / r["n"]) * (1 << 30)))))])
    # equal rows share a draw: tasks drop what is beyond the sample before it is shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "text"))
    drawn = rows.filter(F.col("_draw") <= limits[F.col("lang")]).withColumn("_place", place).filter(F.col("_place") <= sample).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams, counts = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_letter(text):
                    g, n = np.unique(trigrams(text), return_counts=True)
                    langs.append(lang)
                    grams.append(g)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "grams", "counts"])

    table = drawn.mapInArrow(counted, "lang string, grams array<int>, counts array<int>").toArrow()
    langs = table.column("lang").to_pylist()
    if not langs:
        return Model([], np.array([], np.int64), np.array([]), 1.0, np.zeros((0, 0)), np.ones(25))
    grams = [g.values.to_numpy() for g in table.column("grams")]
    counts = [c.values.to_numpy() for c in table.column("counts")]
    seen, often = np.unique(np.concatenate(grams), return_counts=True)
    known = np.sort(seen[np.argsort(-often, kind="stable")[:FEATURES]])
    df = often[np.searchsorted(seen, known)]
    idf = np.log((1 + len(langs)) / (1 + df)) + 1
    model = Model([], known, idf, float(np.log(1 + len(langs)) + 1), np.zeros((len(known), 0), np.float32), np.ones(25))
    lookup = model.lookup()
    vectors = np.array([model.vector(np.repeat(g, c), lookup) for g, c in zip(grams, counts, strict=True)])
    order = np.lexsort((vectors @ np.arange(1, vectors.shape[1] + 1), langs))  # however Spark returned them
    vectors, langs = vectors[order], [langs[i] for i in order]
    sizes = np.array([c.sum() for c in counts])[order]
    centres = []
    for lang in sorted(set(langs)):
        for c in _clusters(vectors[[i for i, x in enumerate(langs) if x == lang]], CENTROIDS):
            model.languages.append(lang)
            centres.append(c[:-1])
    model.centroids = np.array(centres, np.float32).T
    best = (vectors[:, :-1] @ model.centroids).max(axis=1)
    buckets = np.log2(sizes + 1).astype(int)
    low = [float(np.quantile(best[buckets == b], 0.05)) if (buckets == b).sum() >= 20 else None for b in range(25)]
    short = next((x for x in low if x is not None), float(best.min()))
    filled, last = [], short
    for b, x in enumerate(low):  # texts shorter than any that were seen often: less with each halving
        last = last if x is None else x
        first = next((i for i, y in enumerate(low) if y is not None), 0)
        filled.append(short * 0.7 ** (first - b) if b < first else last)
    model.usual = np.array(filled)
    return model


def identified(documents: DataFrame, model: Model) -> DataFrame:
    """`documents` with lang_pred, score (cosine, 0 to 1) and rejected.

    A null text, or one without a letter, is `und`, scores 0 and is rejected; so are all texts if the model was fitted on
    nothing. Repeated rows are answered each; an empty table gives no rows. All other columns stay, those of the same names
    apart.
    """
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def begin():
        own = shared.value
        lookup = own.lookup()
        return lambda texts: [own.nearest(t.as_py() or "", lookup) for t in texts]

    return with_answers(documents, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())], begin)


def training(documents: DataFrame) -> DataFrame:
    """The rows that may be learned from: those whose crc32(doc_id) modulo 4 isn't 2."""
    return documents.select("doc_id", "text", "lang").filter(crc_mod("doc_id", 4) != 2)

"""Language ID and toxicity against plain Python versions of the same scorers, and held-out figures on the driver's small table."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from turnlattice.llm import language_id, queries, toxicity

SMALL = Path("/root/testdata/sf0.01")


def plain_cosine(text, model):
    """The nearest centroid of one text, by dictionaries."""
    kept = [c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in text.lower().encode()]
    data = b" " + b" ".join(bytes(kept).split()) + b" "
    counts = Counter(data[i : i + 3] for i in range(len(data) - 2))
    place = {int(k).to_bytes(3, "big"): i for i, k in enumerate(model.known)}
    known, rest = {}, 0
    for gram, n in counts.items():
        if gram in place:
            known[place[gram]] = n
        else:
            rest += n
    weights = {i: (1 + math.log(n)) * float(model.idf[i]) for i, n in known.items()}
    other = (1 + math.log(rest)) * model.unknown_idf if rest else 0.0
    norm = math.sqrt(sum(w * w for w in weights.values()) + other * other)
    near = [sum(w * float(model.centroids[i, k]) for i, w in weights.items()) / max(norm, 1e-12) for k in range(len(model.languages))]
    best = max(range(len(near)), key=near.__getitem__)
    return model.languages[best], min(1.0, max(0.0, near[best]))


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(language_id.training(docs))
    rows = {r.doc_id: r for r in docs.collect()}
    found = language_id.identified(docs.select("doc_id", "text"), model).collect()
    for r in found[:60]:
        lang, score = plain_cosine(rows[r.doc_id].text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and rows[r.doc_id].lang]
    assert len(held) > 200
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.99 * len(held)
    assert not any(r.rejected for r in found)  # clean documents stay
    odd = ["".join(chr(0x430 + zlib.crc32(f"{i} {k}".encode()) % 32) if k % 6 else " " for k in range(400)) for i in range(50)]
    out = language_id.identified(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in out)  # another script is far from every centroid


def plain_toxicity(text, model):
    clean = 1.0
    for sentence in re.split(r"[.!?\n]+(?=\s|$)|\n+", text.lower()):
        words = {w.strip(".,;:!?()[]{}\"'|*#&%$ \t") for w in sentence.split()} - {""}
        if words:
            z = model.bias + sum(float(model.weights[zlib.crc32(w.encode()) % toxicity.WEIGHTS]) for w in words)
            clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
    return 1 - clean


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    twice = labels.unionByName(labels)  # of repeated labels one counts
    model, same = (toxicity.fit(docs, toxicity.training(x)) for x in (labels, twice))
    assert model.bias == pytest.approx(same.bias) and model.weights == pytest.approx(same.weights)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for i in list(found)[:100]:
        if toxicity.sentences(texts[i]):
            assert found[i].score == pytest.approx(plain_toxicity(texts[i], model), abs=1e-6)
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in found]
    right = sum(found[r.doc_id].predicted == r.toxic for r in held)
    assert len(held) >= 50 and right >= 0.9 * len(held)


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_queries_answer_every_document(spark):
    for query in (queries.op1_centroids, queries.op8_sentence_bags):
        out = query(spark, str(SMALL))
        assert out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
        assert out.filter("score < 0 or score > 1 or score is null").count() == 0

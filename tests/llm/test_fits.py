"""What the fits learn from: bounded samples that lose no language, whatever the ids; columns of any type; tables of other threads."""

import random
import threading
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from tests.llm.test_clashes import MODEL, NONE
from turnlattice.llm import common, language_id, toxicity, url_rules

SMALL = Path("/root/testdata/sf0.01")


def drawn(monkeypatch, frame, sample):
    """How many texts of each language the driver gets."""
    seen = {}
    fit = language_id._clusters

    def counted(vectors, k):
        seen[len(seen)] = len(vectors)
        return fit(vectors, k)

    monkeypatch.setattr(language_id, "_clusters", counted)
    model = language_id.fit(frame, sample)
    return model, list(seen.values())


@pytest.mark.parametrize("ids", [lambda i: i % 2, lambda i: None, lambda i: i])
@pytest.mark.parametrize("same", [False, True])
def test_two_ids_lose_no_language(spark, monkeypatch, ids, same):
    words = {"en": "the and of water", "de": "der und nicht wasser", "fr": "le et pas eau"}
    rnd = random.Random(1)
    rows = [(ids(i), " ".join(rnd.choices(words[lang].split(), k=8)) if not same else words[lang], lang) for i in range(1000) for lang in words]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model, sizes = drawn(monkeypatch, frame, 50)
    assert sorted(set(model.languages)) == ["de", "en", "fr"] and len(sizes) == 3
    assert all(1 <= n <= 50 for n in sizes)


def test_repeated_documents_are_one(spark, monkeypatch):
    rows = [(1, f"bad word {i % 3}.") for i in range(500)] + [(2, f"good {i}.") for i in range(500)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = {}

    def learned(toxic, places, words, totals):
        seen["n"] = len(toxic)
        return MODEL

    monkeypatch.setattr(toxicity, "learned", learned)
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert seen["n"] == 2


def test_planted_sentences_are_found(spark):
    """A model that gives one answer to all has no recall here."""
    rnd = random.Random(5)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "scum", "rotten"]
    sentence = lambda words, n: " ".join(rnd.choices(words, k=n)) + "."
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        found = [sentence(plain, 8) for _ in range(rnd.randint(2, 20))]
        if toxic:
            found.insert(rnd.randrange(len(found)), sentence(plain, 4)[:-1] + " " + " ".join(rnd.choices(bad, k=2)) + ".")
        rows.append((i, " ".join(found)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id % 5 != 0"))
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = list(range(0, 1500, 5))
    hit = sum(out[i].predicted for i in held if i % 6 == 0)
    assert hit >= 0.95 * len([i for i in held if i % 6 == 0]) and hit >= 0.95 * sum(out[i].predicted for i in held)
    for i in held:
        if i % 6 == 0 and out[i].predicted:
            assert set(toxicity.sentences(rows[i][1])[out[i].worst_sentence]) & set(bad)


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_held_out_recall_and_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, toxicity.training(labels))
    score = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(score[r.doc_id].score, score[r.doc_id].predicted, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    positive, negative = [h for h in held if h[2]], [h for h in held if not h[2]]
    assert sum(h[1] for h in positive) >= 0.6 * len(positive)  # six of them, of which two have no word that toxic documents share
    assert sum(h[1] for h in negative) <= 0.02 * len(negative)
    auc = sum((p[0] > n[0]) + (p[0] == n[0]) / 2 for p in positive for n in negative) / (len(positive) * len(negative))
    assert auc >= 0.85


def test_columns_of_any_type(spark):
    frame = corpus.documents(spark, n=5).select("doc_id", "text", F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c`d")).alias("odd `name"), F.array(F.struct(F.lit(2).alias("e:f"))).alias("x.y"))
    for out in (language_id.identified(frame, NONE), toxicity.scored(frame, MODEL)):
        assert out.columns[:4] == frame.columns and [f.dataType for f in out.schema][:4] == [f.dataType for f in frame.schema]
        assert sorted(str(tuple(r)[:4]) for r in out.collect()) == sorted(str(tuple(r)) for r in frame.collect())


def test_tables_of_other_threads_stay(spark):
    held = {}

    def build():
        inner = common.written(spark.range(5))
        other = threading.Thread(target=lambda: held.update(frame=common.written(spark.range(7))))
        other.start()
        other.join()
        return inner

    assert common.settled(spark, build).count() == 5
    assert held["frame"].count() == 7  # written meanwhile by a thread of its own


def test_rules_whatever_the_splits(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example.{('com', 'net')[i % 2]}/{('en', 'de')[i % 2]}/{i % 10}") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string").repartition(3, "page_id").write.parquet(str(tmp_path / "p"))
    pages, rules = spark.read.parquet(str(tmp_path / "p")), url_rules.rule_table(spark, url_rules.RULES)
    want = sorted(map(str, url_rules.judged(pages, rules).collect()))
    before, own = spark.conf.get("spark.sql.files.maxPartitionBytes"), url_rules.written

    def then_split(frame):
        out = own(frame)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
        return out

    monkeypatch.setattr(url_rules, "written", then_split)
    try:
        assert sorted(map(str, url_rules.judged(pages, rules).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_distance_fails_at_once(spark):
    from turnlattice.llm import simhash

    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), distance=3)

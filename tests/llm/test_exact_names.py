import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm import corpus
from turnlattice.llm import exact_names
from turnlattice.llm.sorted_ranks import ranked


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        for k, i in enumerate(ids):
            out[i, keep, len(ids), k == stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_as_brute_force(spark, tmp_path):
    docs = corpus.table(spark, tmp_path / "d")
    want = expected(docs.collect())
    for size in (1024, 64):
        got = exact_names.exact_duplicates(docs, size)
        assert Counter(tuple(r)[:5] for r in got.collect()) == want


def test_names_survive_hash_clashes(spark):
    """All keys share one hash, so that the sort falls back on contents."""
    rows = [(i, 7, f"{i % 13}") for i in range(400)]
    frame = spark.createDataFrame(rows, "_row long, h long, k string")
    named = ranked(frame, ["h", "k"], "_row", ["h"]).collect()
    by_name = defaultdict(set)
    for r in named:
        by_name[r.name].add(r._row % 13)
    assert len(by_name) == 13 and all(len(v) == 1 for v in by_name.values())


def test_deduplicated(spark, tmp_path):
    docs = corpus.table(spark, tmp_path / "d")
    kept = exact_names.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_empty(spark):
    assert exact_names.exact_duplicates(corpus.empty(spark)).count() == 0
    assert exact_names.deduplicated(corpus.empty(spark)).count() == 0

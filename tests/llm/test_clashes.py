"""Columns of awkward names, empty tables, repeated rows and long texts for every operator and stage that returns the columns of its input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import corpus
from turnlattice.llm import exact_names, language_id, line_spread, near_text, simhash, suffix_dedup, toxicity

NAMES = ["_at", "_AT2", "_key", "_gone", "_short", "_row_in", "_k", "_L", "_h", "_line", "_bytes", "data", "spans", "fp", "root"]
MODEL = toxicity.Model(-1.0, toxicity.np.zeros(toxicity.WEIGHTS))
NONE = language_id.Model([], toxicity.np.array([], toxicity.np.int64), toxicity.np.array([]), 1.0, toxicity.np.zeros((0, 0)), toxicity.np.ones(25))

OPERATORS = {
    "exact": (exact_names.deduplicated, []),
    "near": (near_text.representatives, []),
    "simhash": (simhash.representatives, []),
    "passages": (lambda d: suffix_dedup.without_repeats(d, 200), []),
    "lines": (line_spread.without_boilerplate, ["n_lines", "n_removed"]),
    "toxicity": (lambda d: toxicity.scored(d, MODEL), ["score", "predicted", "n_offending", "worst_sentence"]),
    "language": (lambda d: language_id.identified(d, NONE), ["lang_pred", "score", "rejected"]),
}


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("clash") / "d"
    docs = corpus.documents(spark, n=30)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    docs.repartition(2, "doc_id").write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(spark, awkward, name):
    operator, added = OPERATORS[name]
    out = operator(awkward)
    assert out.columns == [*awkward.columns, *added]
    before = {r.doc_id: r for r in awkward.collect()}
    rows = out.collect()
    assert rows and len(rows) <= awkward.count()
    for r in rows:
        assert all(r[n] == before[r.doc_id][n] for n in [*NAMES, "_row", "level", "name"])
    assert operator(awkward.limit(0)).count() == 0


def test_scores_of_repeated_and_long_texts(spark):
    rows = [(1, "one two. " * 30_000), (1, "one two. " * 30_000), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = toxicity.np.zeros(toxicity.WEIGHTS)
    weights[toxicity.bucket("two")] = -3.0
    out = toxicity.scored(docs, toxicity.Model(-9.0, weights)).collect()
    assert max(Counter((r.doc_id, r.score) for r in out).values()) == 2 and len(out) == 4


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_nothing(spark, tmp_path, stage):
    empty = corpus.empty(spark)
    assert dict(corpus_pipeline.STAGES)[stage](spark, empty, str(tmp_path)).count() == 0

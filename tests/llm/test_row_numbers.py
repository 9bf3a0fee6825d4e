"""Row numbers hold when a later read of the documents splits their files otherwise."""

from collections import Counter

import pytest

from tests.llm import corpus
from turnlattice.llm import exact_names, simhash, suffix_dedup

CASES = [(suffix_dedup, suffix_dedup.removed), (suffix_dedup, suffix_dedup.without_repeats), (exact_names, exact_names.deduplicated), (simhash, simhash.representatives)]


@pytest.mark.parametrize("module, operator", CASES, ids=lambda x: getattr(x, "__name__", None))
def test_other_splits_between_reads(spark, tmp_path, monkeypatch, module, operator):
    corpus.documents(spark).repartition(3, "doc_id").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = Counter(map(tuple, operator(docs).collect()))
    settled, before = module.settled, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def then_split(*args):
        out = settled(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
        return out

    monkeypatch.setattr(module, "settled", then_split)
    try:
        assert Counter(map(tuple, operator(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

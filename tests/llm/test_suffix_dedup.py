import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from turnlattice.llm import common, sorted_ranks, suffix_dedup


def expected(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_as_brute_force(spark, tmp_path):
    docs = corpus.table(spark, tmp_path / "d")
    rows = docs.select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in suffix_dedup.removed(docs).collect()) == wanted(rows, 400, 200)


def wanted(rows, length, passage):
    texts = [(r.text or "").encode() for r in rows]
    return Counter((r.doc_id, *e, p[1]) for r, e, p in zip(rows, expected(texts, length), expected(texts, passage)))


@pytest.mark.parametrize("seed", [1])
def test_edits_and_periods(spark, tmp_path, seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcd ") for _ in range(3000))
    texts = [base]
    for _ in range(8):
        t = list(base)
        for _ in range(rnd.randint(1, 5)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        a, b = sorted(rnd.sample(range(len(t)), 2))
        texts.append("".join(t[a:b]))
    texts += ["ab" * rnd.randint(190, 300), "abc" * 150, base[:399], base[100:500], "q" + base[700:1101] + "q"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = docs.collect()
    assert Counter(tuple(r) for r in suffix_dedup.removed(docs).collect()) == wanted(rows, 400, 200)


def test_third_text_shares_less_past_the_edge(spark, tmp_path):
    rnd = random.Random(3)
    fill = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(60):
        at, before = 300, rnd.randint(16, 40)
        x = fill(1200)
        texts += [x, fill(100) + x[at : at + rnd.randint(405, 480)] + fill(100), fill(100) + x[at - before : at - before + rnd.randint(385, 399)] + fill(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = docs.collect()
    assert Counter(tuple(r) for r in suffix_dedup.removed(docs).collect()) == wanted(rows, 400, 200)


@pytest.mark.parametrize("seed", [4])
def test_many_partners_of_other_lengths(spark, tmp_path, seed):
    """Texts that share stretches about as long as the limit, each with others: every edge depends on another partner."""
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdefgh \u00e9") for _ in range(1500))
    texts = []
    for _ in range(120):
        at, size = rnd.randrange(1300), rnd.choice([rnd.randint(60, 70), rnd.randint(45, 140), 64, 63])
        texts.append("".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 60))) + base[at : at + size] + "".join(rnd.choice("uvw") for _ in range(rnd.randint(0, 60))))
    texts += texts[:5] + ["ab" * 60, "b" + "ab" * 50, "x" * 90, "x" * 64, "x" * 63]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for length, passage, unit in ((80, 48, 8),):
        got = Counter(tuple(r) for r in suffix_dedup.removed(docs, length, passage, unit).collect())
        assert got == wanted(docs.collect(), length, passage or length)


def test_empty_and_columns(spark, tmp_path):
    assert suffix_dedup.removed(corpus.empty(spark)).count() == 0
    assert suffix_dedup.without_repeats(corpus.empty(spark)).count() == 0
    docs = corpus.table(spark, tmp_path / "d")
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_rounds_write_repeated_rows_only(spark, monkeypatch):
    """What is unique isn't written between rounds, but for a first and a last row of each partition."""
    tables = []
    monkeypatch.setattr(sorted_ranks, "written", lambda frame: tables.append(common.written(frame)) or tables[-1])
    frame = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(F.col("id") + 1000).alias("k"))
    found = sorted_ranks.ranked(frame, ["k"], "row", kept=["k"], repeats=True).collect()
    assert Counter((r.row, r.k) for r in found) == Counter((i, i % 70) for i in range(0, 3000, 10))
    assert len({r.name for r in found}) == len({(r.name, r.k) for r in found}) == 7 and all(r.again for r in found)
    assert tables[0].filter("_edge is null").count() <= 300 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("bounded", [True, False])
def test_runs_of_a_row_stay_together(spark, monkeypatch, bounded):
    """Runs with a shared gram are kept in their rows without a shuffle, unless there are too many grams for a filter."""
    runs = [(i, [(j, j + 1, j, i * j) for j in range(i)]) for i in range(1, 9)]
    grams = common.written(spark.createDataFrame([(12,), (20,), (0,)], "gram long"))
    if not bounded:
        monkeypatch.setattr(suffix_dedup.chunks, "bounded_filter", lambda longs: None)
    found = suffix_dedup._shared(common.written(spark.createDataFrame(runs, suffix_dedup._RUNS)), grams)
    assert ("Exchange" not in found._jdf.queryExecution().executedPlan().toString()) == bounded
    wanted = {i: sorted(r for r in rs if r[3] in (0, 12, 20)) for i, rs in runs}
    assert {r._row: sorted(tuple(x) for x in r.runs) for r in found.collect()} == {i: rs for i, rs in wanted.items() if rs}


def test_few_equal_cells_are_compared_in_pairs(spark, tmp_path, monkeypatch):
    """As the sort of all windows tells, with a sort less."""
    rnd = random.Random(11)
    fill = lambda n: "".join(rnd.choice("abcdefgh \u00e9") for _ in range(n))
    texts = []
    for n in (2, 3, 5, 9):
        base = fill(900)
        for _ in range(n):
            a, b = sorted((rnd.randrange(0, 350), rnd.randrange(500, 900)))
            texts.append(fill(rnd.randint(0, 60)) + base[a:b] + fill(rnd.randint(0, 60)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    docs, sorts, ranked = spark.read.parquet(str(tmp_path / "t")), [], suffix_dedup.ranked
    monkeypatch.setattr(suffix_dedup, "ranked", lambda frame, keys, *a, **b: sorts.append(keys) or ranked(frame, keys, *a, **b))
    for pairs, some in ((64, False), (1, True)):
        monkeypatch.setattr(suffix_dedup, "PAIRS", pairs)
        sorts.clear()
        assert Counter(tuple(r) for r in suffix_dedup.removed(docs).collect()) == wanted(docs.collect(), 400, 200)
        assert (["cell", "rest"] in sorts) == some

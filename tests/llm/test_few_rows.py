"""Small tables on the way are one task's work, however many partitions a shuffle has."""

import uuid
from contextlib import contextmanager

import pytest

from turnlattice.llm import near_text, simhash
from turnlattice.llm.common import written

MANY = 60
LINKS = [(2, 1), (3, 2), (7, 5), (9, 3), (40, 7)]
ROOTS = {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 7: 5, 40: 5}


@pytest.fixture
def counted(spark):
    """Counts the tasks that ran in a block, with shuffles of MANY partitions that aren't put together."""
    conf = {"spark.sql.shuffle.partitions": str(MANY), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    @contextmanager
    def block():
        group, out, tracker = uuid.uuid4().hex, [], spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(group, group)
        yield out
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        out.append(sum(s.numCompletedTasks for s in stages if s))

    yield block
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_links(spark, counted):
    links = written(spark.createDataFrame(LINKS, "a long, b long"))
    with counted() as tasks:
        found = near_text._joined(None, links)
    assert {r.node: r.root for r in found.collect()} == ROOTS
    assert 0 < tasks[0] < 2 * MANY  # before: a few shuffles a round


def test_few_links_join_few_roots(spark, counted):
    roots = near_text._joined(None, written(spark.createDataFrame(LINKS, "a long, b long")))
    links = written(spark.createDataFrame([(60, 40), (9, 5), (71, 70)], "a long, b long"))
    with counted() as tasks:
        found = near_text._joined(roots, links)
    assert {r.node: r.root for r in found.collect()} == {n: 1 for n in (*ROOTS, 60)} | {70: 70, 71: 70}
    assert 0 < tasks[0] < 2 * MANY


def test_many_links_are_shuffled_with_the_same_result(spark, monkeypatch):
    for module in (simhash, near_text):
        monkeypatch.setattr(module, "FEW", 0)
    links = written(spark.createDataFrame(LINKS, "a long, b long"))
    assert {r.node: r.root for r in near_text._joined(None, links).collect()} == ROOTS


def test_few_pairs_are_compared_in_few_tasks(spark, counted):
    texts = [" ".join(f"w{i}" for i in range(k, k + 40)) for k in (0, 1, 30, 2, 90)]
    rows = written(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_row long, data binary"))
    sets = [near_text.shingles(t.encode()) for t in texts]
    marks = written(spark.createDataFrame([(i, len(s), near_text.parities(s)) for i, s in enumerate(sets)], "_row long, size long, mark binary"))
    pairs = written(spark.createDataFrame([(a, b) for a in range(5) for b in range(a)], "a long, b long"))
    want = {(a, b) for a in range(5) for b in range(a) if near_text.similar(sets[a], sets[b])}
    with counted() as tasks:
        tried = near_text._plausible(pairs, marks, near_text.SIMILARITY)
        found = near_text._checked(rows, tried, near_text.WORDS, near_text.SIMILARITY)
    assert {tuple(r) for r in found.collect()} == want == {(1, 0), (3, 0), (3, 1)}
    assert 0 < tasks[0] < MANY  # before: two shuffles each for marks and texts

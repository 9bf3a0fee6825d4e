"""Null ids, very long texts, ties and repeated rows of the operators whose other tests leave them out."""

from collections import Counter

import numpy as np

from turnlattice.llm import language_id, line_spread, simhash, toxicity, url_rules


def test_fingerprints_of_null_ids_and_long_texts(spark):
    long = "alpha beta gamma " * 60_000
    rows = [(None, long), (None, long), (7, long), (5, None), (None, ""), (9, "one two"), (9, "one two"), (8, "other words here")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in out)
    prints = {r.doc_id: r.fingerprint for r in out if r.doc_id in (7, 5, 9)}
    assert sum(found.values()) == 8 and prints[5] == "0" * 16
    assert found[None, prints[7], 7] == 2 and found[9, prints[9], 9] == 2  # a null id is the largest
    assert found[None, "0" * 16, 5] == 1 and found[5, "0" * 16, 5] == 1
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_long_texts_and_lines(spark):
    shared, long = "the same line on all sites", "x" * 300_000
    rows = [(i, "\n".join([shared, f"own {i}", long if i == 3 else "", *([f"line {i} {k}" for k in range(20_000)] if i == 4 else [])]), f"s{i}") for i in range(12)]
    out = {r.doc_id: r for r in line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        assert out[i].text == text.split("\n", 1)[1] and out[i].n_removed == 1


def test_long_and_repeated_urls(spark):
    path = "/en/" + "a/" * 50_000
    rows = [(1, f"http://x.com{path}"), (1, f"http://x.com{path}"), (2, "http://example.com/en/77"), (2, "http://example.com/en/77"), (None, "http://a.org/es/"), (3, "x" * 100_000)]
    found = Counter((r.page_id, len(r.host), r.rule, r.verdict) for r in url_rules.judged(spark.createDataFrame(rows, "page_id long, url string"), url_rules.rule_table(spark, url_rules.RULES)).collect())
    assert found == {(1, 5, "com/en/", "block"): 2, (2, 11, "example.com/en/7", "allow"): 2, (None, 5, "org/es/", "block"): 1, (3, 0, None, "allow"): 1}


def test_equal_centroids_and_long_texts(spark):
    known = np.unique(language_id.trigrams("some words"))
    one = np.ones((len(known), 1), np.float32) / np.sqrt(len(known))
    model = language_id.Model(["de", "en"], known, np.ones(len(known)), 1.0, np.concatenate([one, one], axis=1), np.full(25, 0.1))
    rows = [(1, "some words"), (2, "some words " * 100_000), (3, None)]
    found = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["de", "de", "und"]  # of equal cosines the first language
    assert found[2].score > 0.9 and found[3].rejected


def test_equal_sentences_tell_the_first(spark):
    weights = np.zeros(toxicity.WEIGHTS)
    weights[toxicity.bucket("bad")] = 5.0
    rows = [(1, "fine. bad. good. bad."), (2, "bad."), (3, "fine. " * 50_000 + "bad."), (4, "...")]
    found = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.Model(-4.0, weights)).collect()}
    assert (found[1].worst_sentence, found[1].n_offending) == (1, 2) and found[3].worst_sentence == 50_000
    assert found[1].score > found[2].score > 0.5 > found[4].score

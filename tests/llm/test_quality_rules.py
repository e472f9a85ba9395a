"""The minimum covariance determinant against all subsets, and groups of any size."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tessellar.llm import quality_rules as q

SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_finds_the_best_of_all_subsets(spark, seed):
    """12 points, 3 of them far away: the least determinant of all 220 subsets of 9."""
    rng = np.random.default_rng(seed)
    points = np.rint(np.concatenate([rng.normal(0, 1, (9, 4)) * [900, 1500, 2500, 4000], rng.normal(0, 1, (3, 4)) * 2000 + 20_000])).astype(int)
    vectors = spark.createDataFrame([("g", *map(int, p), 1) for p in points], "g string, x0 bigint, x1 bigint, x2 bigint, x3 bigint, n bigint")
    found = q.search(vectors).first()
    floors = np.diag(np.array(q.FLOORS, float) ** 2)
    least = min(np.linalg.slogdet(q.CONSISTENT * np.cov(points[list(c)].T, bias=True) + floors)[1] / 2 for c in combinations(range(12), 9))
    assert found.logdet == pytest.approx(least, abs=1e-6) and found.n == 9


def test_repeated_vectors_and_ties_take_an_exact_share(spark):
    vectors = spark.createDataFrame([("g", 0, 0, 0, 0, 10), ("g", 5000, 0, 0, 0, 10), ("h", 1, 2, 3, 4, 1)], "g string, x0 bigint, x1 bigint, x2 bigint, x3 bigint, n bigint")
    assert {r.g: r.n for r in q.search(vectors).collect()} == {"g": 15.0, "h": 1.0}


def test_every_document_past_the_base_rules_gets_a_distance(spark):
    rng = np.random.default_rng(4)
    clean = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(120))
    junk = " ".join("ab###$$$" for _ in range(20)) + " " + " ".join(f"z{i}q{i}%%" for i in range(60))
    rows = [(i, clean(), "en", "s") for i in range(60)]
    rows += [(100 + i, clean(), "en", f"tail{i}") for i in range(5)] + [(200 + i, clean(), None, None) for i in range(3)]
    rows += [(300, junk, "en", "tail1"), (301, junk, "xx", "rare"), (302, junk, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in q.report(docs).collect()}
    assert all(r.distance is not None for r in got.values() if not r.base_failed)
    assert {i for i, r in got.items() if not r.kept} == {300, 301, 302}
    stage = corpus_pipeline.quality(spark, docs, "")
    assert {r.doc_id for r in stage.collect()} == set(got) - {300, 301, 302}

import random
from collections import defaultdict

import pytest

from quorix.llm.mixing import mix_sources

DOCS = "doc_id bigint, source string, n_tokens int, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def sample(seed=0, n=600):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.choice([0, 1, 5, 50, 300]), 1) for i in range(n)]


def test_budgets_caps_and_report(spark):
    docs, targets = sample(), [("a", 0.2, 2), ("b", 0.6, 2), ("c", 0.2, 3), ("none", 0.0, 1)]
    mix = mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    own = defaultdict(int)
    for _, s, t, _ in docs:
        own[s] += t
    whole = sum(own[s] for s in "abc")
    largest = max(t for *_, t, _ in docs)
    used, repeats = defaultdict(int), defaultdict(int)
    for r in mix.documents.collect():
        used[r.source] += r.n_tokens * r.copies
        repeats[r.source] = max(repeats[r.source], r.copies)
    report = {r.source: r for r in mix.report.collect()}
    assert set(report) == {"a", "b", "c", "none"}
    for s, share, most in targets:
        assert repeats[s] <= most
        budget = share * whole
        assert report[s].short == (own[s] * most < budget)
        assert report[s].tokens_used == used[s]
        if report[s].short:
            assert used[s] == own[s] * most
        else:
            assert budget - largest < used[s] <= budget + 1e-6
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1.0)


def test_same_in_every_partitioning(spark):
    docs, targets = spark.createDataFrame(sample(1), DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], TARGETS)
    one = sorted(map(tuple, mix_sources(docs.coalesce(1), targets).documents.collect()))
    assert one == sorted(map(tuple, mix_sources(docs.repartition(9), targets, buckets=7).documents.collect()))


def test_empty_and_odd_targets(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", None, None), ("a", 0.5, 2), (None, 0.5, 1)], TARGETS)
    assert mix_sources(none, targets).documents.count() == 0
    r = mix_sources(none, targets).report.collect()
    assert len(r) == 1 and r[0].tokens_used == 0
    assert mix_sources(spark.createDataFrame(sample(), DOCS), targets.limit(0)).documents.count() == 0

"""Nearest neighbours on uneven sheets, against all pairs."""

import numpy as np
import pytest

from sheetdelta.operators.graph import knn, quadtree


def frame(spark, centres):
    rows = [(1, "old", f"e{i:06}", x - 1, y - 1, x + 1, y + 1) for i, (x, y) in enumerate(centres)]
    return spark.createDataFrame(rows, "comparison_id int, revision string, entity_id string, x0 double, y0 double, x1 double, y1 double")


def brute(centres, k=4):
    xy = np.array([((x - 1 + x + 1) / 2, (y - 1 + y + 1) / 2) for x, y in centres])
    out = set()
    for i, p in enumerate(xy):
        d = np.sqrt((xy[:, 0] - p[0]) ** 2 + (xy[:, 1] - p[1]) ** 2)
        order = np.lexsort((np.arange(len(xy)), d))
        out |= {(f"e{i:06}", f"e{j:06}", r + 1) for r, j in enumerate(order[order != i][:k])}
    return out


def sheets():
    r = np.random.default_rng(1)
    even = [(float(x), float(y)) for x, y in r.uniform(0, 800, (700, 2))]
    cluster = [(400 + float(x), 300 + float(y)) for x, y in r.normal(scale=0.05, size=(800, 2))]
    yield "even", even
    yield "cluster and one far", [*cluster, (1e6, 5.0)]
    yield "clusters of clusters", [*cluster, *even[:60], *[(10 + x / 1000, 10 + y / 1000) for x, y in even[:300]]]
    yield "one centre", [(5.0, 5.0)] * 60 + [(6.0, 5.0), (7.0, 5.0)]
    yield "a line", [(float(x), 7.0) for x in range(150)]
    yield "a lattice with ties", [(float(x % 15), float(x // 15)) for x in range(225)]
    yield "few", [(1.0, 1.0), (2.0, 2.0), (9.0, 9.0)]
    yield "one", [(1.0, 1.0)]


@pytest.mark.parametrize("name,centres", list(sheets()), ids=lambda v: v if isinstance(v, str) else "")
def test_against_all_pairs(spark, name, centres):
    got = {(r.entity_id, r.other_id, r["rank"]) for r in knn(frame(spark, centres)).collect()}
    assert got == brute(centres)


def test_cluster_and_one_far(spark):
    """50,000 entities in a cluster and one far away: leaves stay small, so the pairs that meet are near linear."""
    r = np.random.default_rng(2)
    n = 50_000
    rows = [(1, "old", f"e{i:06}", float(x), float(y), float(x), float(y)) for i, (x, y) in enumerate(r.normal(loc=400, scale=0.5, size=(n, 2)))] + [(1, "old", "far", 1e7, 1e7, 1e7, 1e7)]
    e = spark.createDataFrame(rows, "comparison_id int, revision string, entity_id string, x0 double, y0 double, x1 double, y1 double").repartition(4)
    leaves = quadtree(e).selectExpr("level", "shiftright(gx, 44 - level) x", "shiftright(gy, 44 - level) y").groupBy("level", "x", "y").count()
    most, square = leaves.selectExpr("max(count)", "sum(count * count)").first()
    assert square < 100 * n, (most, square)
    found = knn(e)
    assert found.count() == 4 * (n + 1)
    assert found.where("entity_id = 'far'").count() == 4

"""The tree over a cell library against plain search, and its refinements over many radii."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmon.operators import cell_tree, isolate


def library(n, dim, families, seed=0):
    """Clustered centres with uneven scales."""
    draw = np.random.default_rng(seed)
    hubs = draw.normal(size=(200, dim)) * 10
    centers = hubs[draw.integers(0, 200, n)] + draw.normal(size=(n, dim))
    return [f"F{i % families}" for i in range(n)], centers, draw.uniform(0.5, 2, size=(n, dim))


def frame(spark, names, centers, scales, ids=None):
    ids = range(len(names)) if ids is None else ids
    rows = [(int(i), f, c.tolist(), s.tolist()) for i, f, c, s in zip(ids, names, centers, scales)]
    return spark.createDataFrame(rows, "cell_id long, family_id string, center array<double>, scale array<double>")


def plain(values, names, centers, scales, ids, families):
    out = {}
    for o, v in enumerate(values):
        score = (np.abs(v - centers) / scales).max(axis=1)
        for f in families:
            mine = np.flatnonzero(np.array(names) == f)
            best = min(mine, key=lambda i: (score[i], ids[i]))
            out[o, f] = (score[best], ids[best])
    return out


@pytest.mark.parametrize("part", [8 << 20, 40 * 64])
def test_nearest_cells_equal_plain_search(spark, monkeypatch, part):
    monkeypatch.setattr(cell_tree, "PART_BYTES", part)
    monkeypatch.setattr(cell_tree, "TURN", 50)
    names, centers, scales = library(700, 4, 3)
    centers[100:110] = centers[100]  # equal cells: the smallest id counts
    scales[100:110] = scales[100]
    names[100:110] = ["F1"] * 10
    ids = np.random.default_rng(1).permutation(700)
    values = np.random.default_rng(2).normal(size=(150, 4)) * 8
    values[:5] = centers[100]
    obs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, f array<double>")
    out = cell_tree.nearest_cells(obs, "f", frame(spark, names, centers, scales, ids), ["id"]).collect()
    want = plain(values, names, centers, scales, ids, ["F0", "F1", "F2"])
    assert {(r["id"], r["family_id"]): (r["score"], r["cell_id"]) for r in out} == want and len(out) == len(want)
    whole = cell_tree.nearest_cells(obs, "f", frame(spark, names, centers, scales, ids), ["id"], family=())
    assert whole.columns == ["id", "cell_id", "score"]
    assert {r["id"]: (r["score"], r["cell_id"]) for r in whole.collect()} == {
        o: min(want[o, f] for f in ("F0", "F1", "F2")) for o in range(len(values))
    }


@pytest.mark.parametrize("part", [8 << 20, 40 * 64])
def test_awkward_observations(spark, monkeypatch, part):
    monkeypatch.setattr(cell_tree, "PART_BYTES", part)
    cells = frame(spark, *library(300, 2, 2))
    rows = [(0, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [0.0, 0.0])]
    obs = spark.createDataFrame(rows, "id long, f array<double>")
    out = cell_tree.nearest_cells(obs, "f", cells, ["id"]).collect()
    assert len(out) == 12
    assert all(np.isnan(r["score"]) and r["cell_id"] is None for r in out if r["id"] in (0, 1, 2))
    assert all(r["score"] >= 0 and r["cell_id"] is not None for r in out if r["id"] not in (0, 1, 2))
    assert cell_tree.nearest_cells(obs.where("false"), "f", cells, ["id"]).count() == 0
    with pytest.raises(ValueError, match="empty"):
        cell_tree.build_cell_tree(cells.where("false"))
    with pytest.raises(ValueError, match="differ in length"):
        cell_tree.build_cell_tree(cells.withColumn("scale", F.slice("scale", 1, 1)))


def test_large_library_compares_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(cell_tree, "PART_BYTES", 16 * 4 * 5_000)
    names, centers, scales = library(100_000, 4, 4, seed=5)
    values = np.random.default_rng(6).normal(size=(300, 4)) * 10
    cells = frame(spark, names, centers, scales)
    tree = cell_tree.build_cell_tree(cells)
    assert tree.record is None and tree.parts.count() == 20
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "row long, vec array<double>")
    found = cell_tree.search(tree, rows).collect()
    want = plain(values, names, centers, scales, range(100_000), tree.families)
    assert {(r["row"], tree.families[r["family"]]): (r["score"], r["cell"]) for r in found} == want
    assert sum(r["compared"] for r in found) < 0.05 * 300 * 100_000


def refinements(spark, rows):
    return spark.createDataFrame(rows, "obs long, cell long, level long, lo double, hi double")


NAMES = (["obs"], "cell", "level", "lo", "hi")


def test_one_sweep_answers_all_radii(spark):
    draw = np.random.default_rng(3)
    rows = [(int(o), c, 0, float(a), float(a + w)) for o in range(5) for c, (a, w) in enumerate(zip(draw.uniform(0, 5, 40), draw.uniform(-0.5, 2, 40)))]
    rows += [(9, 0, 0, 1.0, 1.0), (9, 1, 0, 2.0, float("inf"))]
    radii = [0.0, 1.0, 2.0, 2.0, float("inf"), *[float(rows[k][3]) for k in range(3)], *[float(rows[k][4]) for k in range(3)]]
    got = isolate.bounds_over_radii(refinements(spark, rows), ["obs"], "lo", "hi", radii).collect()
    assert len(got) == 6 * len(set(radii))
    for r in got:
        mine = [(x[3], x[4]) for x in rows if x[0] == r["obs"]]
        assert r["outer_score"] == min(a for a, _ in mine) and r["feasible"] == (r["outer_score"] <= r["radius"])
        assert r["unresolved_cells"] == sum(a <= r["radius"] < b for a, b in mine)
    with pytest.raises(ValueError):
        isolate.bounds_over_radii(refinements(spark, rows), ["obs"], "lo", "hi", [])


def test_merging_keeps_the_latest_and_refuses_what_does_not_nest(spark):
    first = isolate.merge_refinements(None, refinements(spark, [(0, 0, 0, 0.0, 4.0), (0, 0, 1, 1.0, 3.0), (0, 1, 0, 2.0, 9.0)]), *NAMES)
    then = isolate.merge_refinements(first, refinements(spark, [(0, 0, 5, 1.5, 3.0), (1, 0, 0, 0.0, 1.0)]), *NAMES)
    assert sorted(map(tuple, then.collect())) == [(0, 0, 5, 1.5, 3.0), (0, 1, 0, 2.0, 9.0), (1, 0, 0, 0.0, 1.0)]
    for bad in ((0, 0, 2, 0.5, 3.0), (0, 0, 2, 1.0, 3.5), (0, 0, 1, 1.5, 2.0)):
        with pytest.raises(Exception, match="does not nest: 0/0"):
            isolate.merge_refinements(first, refinements(spark, [bad]), *NAMES).collect()

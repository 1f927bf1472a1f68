"""Exact nearest vectors by blocks: whole results with copies, odd vectors and several blocks, and plans without nested loops or label pairs."""

import contextlib
import io

import numpy as np
import pytest

from lodestar.operators import ann_index, evaluate, retrieve


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(3).normal(size=(60, 8)).round(3)
    rows = [(i, [float(v) for v in x[i % 60]], i % 4) for i in range(150)]  # most come twice or more
    rows += [(200 + i, rows[5][1], 1) for i in range(30)]  # a large group of copies
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").cache()


def want(vectors, k):
    rows = [(r.vec_id, np.array(r.embedding)) for r in vectors.collect() if r.embedding is not None]
    unit = {i: (v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v) for i, v in rows if not np.isnan(v).any()}
    return {q: [i for _, i in sorted((round(1 - float(unit[q] @ v), 9), i) for i, v in unit.items())[:k]] for q in unit if q % 20 == 0}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("rows, block", [(16384, 2000), (40, 3)])
def test_copies_and_odd_vectors(spark, vectors, monkeypatch, rows, block):
    monkeypatch.setattr(retrieve, "ROWS", rows)
    asked = vectors.filter("vec_id % 20 = 0 AND vec_id <> 300").selectExpr("vec_id AS query_id", "embedding AS q")
    got = retrieve.nearest(vectors, asked, 7, block=block)
    assert found(got) == want(vectors, 7)
    assert "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)


def test_cells(spark, vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS", 40)
    few = vectors.filter("vec_id < 300")
    index = ann_index.CellIndex.build(few)
    asked = few.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    got = index.search(asked, 5, probes=len(index.centroids))
    assert found(got) == want(few, 5)
    assert "Broadcast" not in plan(got)  # queries meet blocks of all rows, not a broadcast copy of each query for each cell
    one = index.search(asked, 5, probes=1)
    cells = {r.id: r.cell for r in index.rows.collect()}
    assert {len({cells[i] for i in ids}) for ids in found(one).values()} == {1}


def test_quality_by_label_pairs_nothing(spark, vectors):
    few = vectors.filter("vec_id < 150")
    shown = retrieve.nearest(few, few.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), 5)
    labels = few.selectExpr("vec_id AS id", "label")
    truth = few.selectExpr("vec_id AS query_id", "label").join(labels, "label")
    by_pairs, by_label = (sorted((r.query_id, round(r.recall, 9), round(r.precision, 9), round(r.ndcg, 9)) for r in q.collect()) for q in (evaluate.retrieval_quality(shown, truth, 5), evaluate.retrieval_quality_by_label(shown, labels, 5)))
    assert by_pairs == by_label

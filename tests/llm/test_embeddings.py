"""The metric range join against brute force over all pairs."""

import numpy as np
import pytest

from panelspark.llm import embeddings_join

SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


def brute(rows, least=0.95):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    root = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, v) in enumerate(good):
        for j, w in good[a + 1 :]:
            if len(v) == len(w) and v @ w >= least:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize(("cell_rows", "block", "chunk"), [(2_000, 2_048, 1_024), (40, 16, 8), (15, 7, 3)])
def test_equals_brute_force(spark, cell_rows, block, chunk):
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 2, 30, 60):
        for centre in rng.normal(size=(4, 16)):
            rows += [centre + rng.normal(size=16) * 0.22 for _ in range(size)]
    rows += list(rng.normal(size=(120, 16))) + [rows[40]] * 25 + [rows[50] * 3.0]
    given = [(7 * i % 1009, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    given += [(2001, None), (2002, []), (2003, [0.0] * 16), (2004, [float("nan")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (2006, [float("inf")] + [1.0] * 15), (2007, [1.0] * 8), (2008, [2.0] * 8), (2009, [1.0, -1.0] * 4)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in given], SCHEMA)
    settings = embeddings_join.RangeSettings(cell_rows=cell_rows, block=block, chunk=chunk)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings_join.near_vectors(frame, settings).collect()}
    assert found == brute(given)


def test_links_at_the_bound(spark):
    """Pairs at a cosine just above the least, their ends in cells of near-equal vectors, whose angles to a pivot are below the rounding of arccos."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    given = []
    for _ in range(60):
        p = unit(rng.normal(size=24))
        side = unit((d := rng.normal(size=24)) - (d @ p) * p)
        angle = np.arccos(0.95) - 1e-9
        given += [p, unit(p + 8e-9 * side), p * np.cos(angle) - side * np.sin(angle), unit(p - 8e-9 * side) * 2]
    given = [(i, [float(x) for x in v]) for i, v in enumerate(given)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    found = embeddings_join.near_vectors(frame, embeddings_join.RangeSettings(cell_rows=2)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute(given)


def test_corner_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embeddings_join.near_vectors(empty).collect() == []
    none = spark.createDataFrame([(1, None, 1, "x"), (None, None, 1, "x")], SCHEMA)
    assert {tuple(r) for r in embeddings_join.near_vectors(none).collect()} == {(1, 0, 1, True), (None, 0, None, True)}
    same = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (5, [1.0, 2.0], 1, "x"), (5, [1.0, 2.0], 1, "x")], SCHEMA)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings_join.near_vectors(same).collect()) == [(0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]

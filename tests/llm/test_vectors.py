"""Vector near-duplicates against brute force over all pairs."""

import math

import numpy as np
import pytest

from trackloom.llm import queries, vectors


def brute(rows, cosine=0.9):
    """``(vec_id, n_links, component_id, kept)`` of each row by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: [j for j in ok if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in ok}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j), todo.append(j)
        named = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(near.get(i, [])), named, vec_id == named))
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def near_copies(rng, groups, dim, start=0):
    """Groups of a vector, its copies, scaled copies and vectors that lie at cosines from 0.95 on."""
    rows = []
    for size, spread in groups:
        base = rng.normal(size=dim)
        for k in range(size):
            v = base if k % 5 == 0 else 2.5 * base if k % 5 == 1 else base + spread * np.linalg.norm(base) / math.sqrt(dim) * rng.normal(size=dim)
            rows.append((start + len(rows), [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("block, small", [(3, 32), (512, 1), (512, 32)])
@pytest.mark.parametrize("dim", [64, 24])
def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch, block, small, dim):
    monkeypatch.setattr(vectors, "HOT", 20)
    rng = np.random.default_rng(dim)
    rows = near_copies(rng, [(1, 0)] * 100 + [(2, 0.2), (9, 0.1), (60, 0.15), (40, 0.02)], dim)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    # More tables than by default, as every link is wanted here.
    got = vectors.near_duplicates(table, block=block, small=small, tables=8).collect()
    assert key(got) == key(brute(rows))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 1.0]), (8, [-0.0, 1.0]), (9, [0.0, 1e300]), (10, [1e-300, 5e-300]), (11, [1.0]), (12, [2.0]), (13, [-2.0]), (14, [1.0, 0.0, 0.0])]
    rows += [(20, [1.0, 2.0, 3.0])] * 3 + [(20, [3.0, -2.0, 1.0]), (None, [1.0, 2.0, 3.1]), (None, [-5.0, 1.0, 1.0]), (None, None), (15, [-5.0, 1.0, 1.2])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rep int, _k string").repartition(3)
    assert key(vectors.near_duplicates(table, tables=8).collect()) == key(brute(rows))
    assert vectors.near_duplicates(table.filter("vec_id < 0")).collect() == []
    with pytest.raises(ValueError, match="right angle"):
        vectors.near_duplicates(table, cosine=0.0)


def test_recall_at_the_threshold_is_as_designed():
    assert vectors.meeting(0.9, 64) >= 0.985
    assert vectors.meeting(0.95, 64) >= 0.998
    assert vectors.meeting(0.9, 768, pairs=1000, tables=8) >= 0.98  # more dimensions ask for more tables
    assert vectors.meeting(0.0, 64) <= 0.01  # and few strangers meet


def test_hadamard_is_orthogonal():
    h = vectors.hadamard(np.eye(16))
    assert (np.abs(h) == 1).all() and (h @ h.T == 16 * np.eye(16)).all()


def test_query_equals_brute_force_on_the_small_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert key(queries.op12_embedding_near_dedup(spark, "/root/testdata/sf0.001").collect()) == key(brute(rows))

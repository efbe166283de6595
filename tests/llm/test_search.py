import numpy as np
import pytest
from pyspark.sql import functions as F

from cobframe.llm import ann
from tests.llm.helpers import SF


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, v string, cls string")


def plain(rows, k):
    """Brute force over the rows that take part."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
             if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    sound = list({(i, v.tobytes()): (i, v) for i, v in sound}.values())
    out = {}
    for q, x in sound:
        if q % 20 == 0:
            near = sorted((-float((x * y).sum()), i) for i, y in sound if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def answers(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_every_leaf_visited_is_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(1, 150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(0, rows[3][1]), (0, rows[3][1])]  # ties, a repeated row
    bad = [(40, None), (60, [0.0] * 6), (80, [1.0, None, 0, 0, 0, 0]), (300, [float("nan")] + [1.0] * 5),
           (320, [float("inf")] + [1.0] * 5), (340, []), (None, rows[0][1]), (360, [1.0, 2.0])]
    bad = [(i, v) for i, v in bad if i not in dict(rows)]
    found = answers(ann.search(frame(spark, rows + bad), F.col("vec_id") % 20 == 0, k=20, recall=1.0, block_rows=16,
                               block_queries=2).collect())
    want = plain(rows, 20)
    assert set(found) == set(want)
    hit = sum(len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hit >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert [r for r, _, _ in found[q]] == list(range(1, len(want[q]) + 1))
        assert all(s == pytest.approx(dict((i, s) for _, i, s in want[q]).get(i, s)) for _, i, s in found[q])
    # all ties of one vector: smallest ids first, never the query itself
    assert [i for _, i, _ in found[0]][:3] == [i for _, i, _ in want[0]][:3]


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = answers(ann.search(rows, F.col("vec_id") % 20 == 0, k=20).collect())
    want = plain([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
    assert set(found) == set(want)
    hit = sum(len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_few_or_no_rows(spark):
    few = answers(ann.search(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 0.0])]), F.col("vec_id") % 20 == 0).collect())
    assert few == {0: [(1, 2, 2.0), (2, 1, 0.5)]}
    assert ann.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(frame(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_walk_visits_every_leaf_once():
    rng = np.random.default_rng(0)
    tree = ann.fit(rng.normal(size=(500, 4)), 40)
    assert sorted(tree.visits(rng.normal(size=4), tree.leaves)) == list(range(tree.leaves))
    assert set(tree.assign(rng.normal(size=(200, 4)))) <= set(range(tree.leaves))

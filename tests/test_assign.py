import random
from itertools import permutations

import numpy as np
import pytest

from framequorum.operators import assign as A


@pytest.mark.parametrize(("cost", "want"), [([[1, 2], [2, 1]], [(0, 0), (1, 1)]), ([[0.1, 0.9, 1], [0.9, 0.2, 0.8]], [(0, 0), (1, 1)])])
def test_literal_pairs(cost, want):
    assert A.optimal(np.array(cost, float)) == want


def test_no_rows():
    assert A.optimal(np.zeros((0, 3))) == []


def test_least_total_cost():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 5, 2)
        c = rng.integers(0, 9, (n, m)).astype(float)
        got = sum(c[i, j] for i, j in A.optimal(c))
        short, wide = (c, m) if n <= m else (c.T, n)
        want = min(sum(short[i, p[i]] for i in range(len(short))) for p in permutations(range(wide), len(short)))
        assert got == want and len(A.optimal(c)) == min(n, m)


def test_iou():
    box = np.array([[0, 0, 10, 10]], float)
    assert A.iou_matrix(box, np.array([[0, 0, 10, 10], [20, 20, 30, 30], [5, 0, 15, 10]], float))[0].tolist() == [1.0, 0.0, pytest.approx(1 / 3)]


def _score(v, p):
    w, h = min(v[2], p[2]) - max(v[0], p[0]), min(v[3], p[3]) - max(v[1], p[1])
    inner = max(0, w) * max(0, h)
    union = (v[2] - v[0]) * (v[3] - v[1]) + (p[2] - p[0]) * (p[3] - p[1]) - inner
    cx, cy = (p[0] + p[2]) / 2, (p[1] + p[3]) / 2
    return inner / union + (v[0] <= cx <= v[2] and v[1] <= cy <= v[3])


def test_exclusive_plates_match_a_loop(spark):
    rng = random.Random(4)
    box = lambda: (x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(5, 60), y + rng.randrange(5, 60))
    vehicles = [(0, f, t, t, *box()) for f in range(30) for t in range(4)]
    plates = [(0, f, p, *box(), rng.choice([0.1, 0.5, 0.9])) for f in range(30) for p in range(3)]
    vdf = spark.createDataFrame(vehicles, "video_id long, frame_index long, ord long, track_id long, x1 int, y1 int, x2 int, y2 int")
    pdf = spark.createDataFrame(plates, "video_id long, frame_index long, ord long, x1 int, y1 int, x2 int, y2 int, confidence double")
    want = set()
    for f in range(30):
        vs, ps = [v for v in vehicles if v[1] == f], [p for p in plates if p[1] == f]
        used = set()
        for v in sorted(vs, key=lambda v: (-max([_score(v[4:], p[3:7]) for p in ps] + [0]), v[3])):
            best, at = 0.0, None
            for p in ps:
                if p[2] not in used and p[7] >= 0.25 and (s := _score(v[4:], p[3:7])) > best:
                    best, at = s, p[2]
            if at is not None:
                used.add(at)
                want.add((f, v[3], at))
    assert {(r.frame_index, r.track_id, r.plate_ord) for r in A.assign_plates(vdf, pdf).collect()} == want

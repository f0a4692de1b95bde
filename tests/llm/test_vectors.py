"""Whitening and counted collisions against brute force on doubles and whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tablecare.llm import collision_search, whitening

ODD = [
    (901, None), (902, []), (903, [1.0, None, 2.0]), (904, [float("nan"), 1.0, 1.0]), (905, [math.inf, 0.0, 0.0]), (906, [0.0, -0.0, 0.0]),
    (907, [3.0, 4.0]), (908, [3.5, -4.0]), (909, [3.0, 4.0]),
]


@pytest.fixture(scope="module")
def embedded(spark):
    def make(rows, kind="double"):
        full = [(i, v, 1, 2, 3, 4, "z", 0.5) for i, v in rows]
        return spark.createDataFrame(full, f"vec_id bigint, embedding array<{kind}>, dim int, n bigint, component int, rank int, number string, score double")

    return make


def some(seed, n, dim, spread=1.0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * np.linspace(spread, 0.3, dim)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def expected_whitening(rows, k):
    """n, and for each id and component the deviation, whitened value up to its sign, and share, by fractions."""
    xs = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dim in {len(x) for _, x in xs}:
        listed = sorted({x for _, x in xs if len(x) == dim})
        n, sums = len(listed), [sum(c) for c in zip(*listed)]
        y = [[n * c - s for c, s in zip(x, sums)] for x in listed]
        cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(dim)] for a in range(dim)])
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1], u[:, ::-1]
        for i, x in xs:
            if len(x) == dim:
                own = [n * c - s for c, s in zip(x, sums)]
                for c in range(min(k, dim)):
                    if e[c] <= 1e-9 * e[0]:
                        continue
                    out.append((i, c + 1, n, sum(v * v for v in own), float(np.array([float(Fraction(v, n)) for v in own]) @ u[:, c]) / math.sqrt(e[c]), e[c] / e.sum()))
    return sorted(out, key=lambda r: r[:2])


def whitened(df, k=4):
    return sorted(whitening.whiten(df, k).collect(), key=lambda r: (r["vec_id"], r["component"]))


@pytest.mark.parametrize("rows", [some(1, 300, 5, 3.0), some(2, 40, 3, 3.0) + [(i + 100, v) for i, v in some(2, 40, 3, 3.0)] + ODD])
def test_whitening_is_that_of_fractions(embedded, rows):
    got, want = whitened(embedded(rows)), expected_whitening(rows, 4)
    got = [r for r in got if r["whitened"] is not None]
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in got] == [w[:4] for w in want]
    signs = {}
    for r, w in zip(got, want):
        dim = 2 if r["vec_id"] in (907, 908, 909) else 0
        sign = signs.setdefault((dim, r["component"]), math.copysign(1, r["whitened"] * w[4]))
        assert r["whitened"] * sign == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(w[5], rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_without_variance(embedded):
    got = whitened(embedded([(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in got] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]


def test_whitening_of_empty_tables(embedded):
    assert whitened(embedded([])) == [] and whitened(embedded(ODD[:5])) == []


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e7, 1e14])
def test_exact_deviations_at_every_size(embedded, scale):
    rows = [(i, [c * scale for c in v]) for i, v in some(3, 60, 3, 2.0)]
    got, want = whitened(embedded(rows)), expected_whitening(rows, 4)
    assert [r["deviation"] if r["deviation"] is None else int(r["deviation"]) for r in got] == [w[3] if w[3] < 10**38 else None for w in want]
    assert max(r["identity_error"] for r in got) < 1e-9


def test_entries_that_need_more_than_64_bits_take_no_part(embedded):
    rows = some(4, 20, 2) + [(100, [1e300, 0.0]), (101, [2.0**60, 1.0])]
    assert {r["vec_id"] for r in whitened(embedded(rows))} == set(range(20))


def expected_nearest(rows, k, every):
    xs = [(i, np.array(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    xs = list({(i, tuple(v + 0.0)): (i, v) for i, v in xs}.values())
    out = []
    for i, q in xs:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in xs if len(v) == len(q) and not (j == i and (v == q).all()))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def found(df, k, every):
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in collision_search.search(df, F.col("vec_id") % every == 0, k).collect())


def test_share_of_the_radius_that_is_found():
    assert collision_search.found_share() > 0.97


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_are_found(embedded, kind):
    rows = some(5, 1500, 24)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    got, want = found(embedded(rows, kind), 10, 25), expected_nearest(rows, 10, 25)
    assert len(got) == len(want)
    best = {(q, j): s for q, _, j, s in want}
    hits = [(q, j, s) for q, _, j, s in got if (q, j) in best]
    assert len(hits) >= 0.95 * len(want)
    assert all(s == pytest.approx(best[q, j], rel=1e-12) for q, j, s in hits)


def test_nearest_over_many_blocks(embedded, monkeypatch):
    monkeypatch.setattr(collision_search, "BLOCK", 60)
    monkeypatch.setattr(collision_search, "QUERIES", 7)
    rows = some(6, 900, 16)
    got, want = found(embedded(rows), 5, 20), expected_nearest(rows, 5, 20)
    assert len(got) == len(want)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.95 * len(want)


def test_equal_vectors_ties_and_odd_rows(embedded):
    same = [(i, [1.0, 2.0, -1.0]) for i in range(200, 240)] + [(200, [1.0, 2.0, -1.0]), (None, [1.0, 2.0, -1.0])]
    rows = same + [(300, [1.0, 2.0, -1.5]), (300, [1.0, 2.0, -1.0]), (310, [0.0, 2.0, -1.0])] + ODD
    got = found(embedded(rows), 10, 10)
    assert got == expected_nearest(rows, 10, 10)


def test_fewer_candidates_than_asked_for(embedded):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (10, [5.0]), (20, [1.0, 2.0, 3.0]), (21, [-1.0, 2.0, 3.0])]
    assert found(embedded(rows), 10, 10) == expected_nearest(rows, 10, 10)
    assert found(embedded([]), 10, 10) == [] and found(embedded(rows[1:2]), 10, 10) == []


@pytest.mark.parametrize("scale", [1e-140, 1e-20, 1e20, 1e140])
def test_nearest_at_every_scale(embedded, scale):
    rows = [(i, [c * scale for c in v]) for i, v in some(7, 200, 6)]
    got, want = found(embedded(rows), 5, 20), expected_nearest(rows, 5, 20)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.95 * len(want)

"""Operators that compare many lines, in small parts: the same as looking at everything."""

import numpy as np
import pytest

from cresthaven.operators import polyline as P
from cresthaven.operators import spatial as S


def lines_of(spark, seed=3, lines=30, n=6, side=60.0):
    rng = np.random.default_rng(seed)
    rows = [(i, "toe" if i % 2 else "crest", k, float(x), float(y)) for i in range(lines) for k, (x, y) in enumerate(rng.uniform(0, side, (n, 2)).round(1))]
    return rows, spark.createDataFrame(rows, "line_id bigint, type string, idx bigint, x double, y double")


def nearest(rows, kind, qx, qy):
    """(line, distance) of a type's lines, by brute force."""
    out = {}
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0] and a[1] == kind and None not in (*a, *b):
            p, q, at = np.array(a[3:]), np.array(b[3:]), np.array([qx, qy])
            l2 = ((q - p) ** 2).sum()
            t = min(1.0, max(0.0, ((at - p) @ (q - p)) / l2)) if l2 > 1e-12 else 0.0
            out[a[0]] = min(out.get(a[0], np.inf), float(np.sqrt(((at - p - t * (q - p)) ** 2).sum())))
    return out


def test_nearest_lines_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "QUERIES", 4)
    monkeypatch.setattr(P, "SEGMENTS", 20)
    rows, v = lines_of(spark)
    asked = [(i, "toe" if i % 3 else "crest", i * 3.0, i * 2.0) for i in range(15)]
    got = P.nearest_lines(spark.createDataFrame(asked, "query_id bigint, type string, qx double, qy double"), v).collect()
    for i, kind, x, y in asked:
        want, mine = nearest(rows, kind, x, y), {r.line_id: r.distance for r in got if r.query_id == i}
        assert mine.keys() == want.keys() and all(abs(want[n] - d) < 1e-9 for n, d in mine.items())


def test_nearest_point_where_a_vertex_has_no_place(spark):
    v = spark.createDataFrame([(1, "toe", 0, 0.0, 0.0), (1, "toe", 1, 5.0, None), (1, "toe", 2, 5.0, 5.0), (1, "toe", 3, 9.0, 5.0), (2, "toe", 0, 1.0, 1.0), (2, "toe", 1, 1.0, 1.0), (3, "toe", 0, 1.0, None), (3, "toe", 1, 2.0, None)], "line_id bigint, type string, idx bigint, x double, y double")
    q = spark.createDataFrame([(7, "toe", 6.0, 4.0)], "query_id bigint, type string, qx double, qy double")
    got = {r.line_id: r.distance for r in P.nearest_on(q, v).collect()}
    assert got == {1: 1.0, 2: np.sqrt(34), 3: None}


@pytest.mark.parametrize("max_dist,max_gap,max_dz", [(50.0, 100.0, None), (30.0, 40.0, 1.0), (60.0, 30.0, 0.5)])
def test_anchors_are_the_best_of_all_pairs(spark, monkeypatch, max_dist, max_gap, max_dz):
    monkeypatch.setattr(S, "GUIDES", 5)
    rows, v = lines_of(spark, lines=24, n=3, side=120.0)
    z = {i: i * 7 % 11 / 4 if i % 5 else None for i in range(24)}
    rng = np.random.default_rng(8)
    guides = [(i, "toe" if i % 3 else "crest", *map(float, rng.uniform(0, 120, 4).round(1))) for i in range(24)]
    g = spark.createDataFrame(guides, "guide_id bigint, type string, sx double, sy double, ex double, ey double")
    got = {r.guide_id: r for r in S.anchors(g, v, spark.createDataFrame(list(z.items()), "line_id bigint, z double"), max_dist, max_gap, max_dz).collect()}
    points = {(r.query_id, r.line_id): r for r in P.nearest_on(spark.createDataFrame([(i * 2 + k, kind, *((sx, sy), (ex, ey))[k]) for i, kind, sx, sy, ex, ey in guides for k in (0, 1)], "query_id bigint, type string, qx double, qy double"), v).collect()}
    want = {}
    for i, *_ in guides:
        for (p, n), a in points.items():
            for (q, m), b in points.items():
                if p == i * 2 and q == i * 2 + 1 and n != m and max(a.distance, b.distance) <= max_dist:
                    gap = float(np.hypot(a.x - b.x, a.y - b.y))
                    if 1 <= gap <= max_gap and (max_dz is None or None in (z[n], z[m]) or abs(z[n] - z[m]) <= max_dz):
                        now = (round(a.distance + b.distance + 0.03 * gap, 9), n, m)
                        want[i] = min(want.get(i, now), now)
    assert want and {i: (round(r.score, 9), r.start_line, r.end_line) for i, r in got.items()} == want


def test_anchors_of_close_scores_go_by_line(spark):
    """Scores equal to nine digits are ties, as in the SQL."""
    v = spark.createDataFrame([(line, "toe", k, 1e-11 * (9 - line) + x, 100.0 * k) for line, x in ((3, 1.0), (4, 1.0), (5, 30.0)) for k in (-1, 1)], "line_id bigint, type string, idx bigint, x double, y double")
    g = spark.createDataFrame([(1, "toe", 0.0, 0.0, 31.0, 0.0)], "guide_id bigint, type string, sx double, sy double, ex double, ey double")
    assert S.anchors(g, v, spark.createDataFrame([(3, 0.0)], "line_id bigint, z double")).first().start_line == 3


@pytest.mark.parametrize("tile,matrix,side", [(1024, 1 << 13, 40.0), (4, 1 << 13, 40.0), (4, 0, 40.0), (4, 1 << 13, 400.0)])
def test_pairs_of_lines_in_tiles(spark, monkeypatch, tile, matrix, side):
    """Close lines by brute force; no pair is a row before the result, however often its lines come near each other."""
    rng = np.random.default_rng(5)
    rows = [(i * 7 - 20, "toe" if i % 2 else "crest", k, float(x), float(y)) for i in range(30) for k, (x, y) in enumerate(rng.uniform(-side / 2, side / 2, (8, 2)).round(2))]
    df = spark.createDataFrame(rows, "line_id bigint, type string, k bigint, x double, y double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and np.sqrt((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2) <= 5.0}
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "MATRIX", matrix)
    table = df.selectExpr("type", "floor(x / 5) bx", "floor(y / 5) by", "line_id", "k", "x", "y")
    number = {n: k for k, n in enumerate(sorted({r[0] for r in rows}, key=lambda n: (n % 14 == 1, n)))}
    own = [{**r.asDict(), "line_id": number[r.line_id], "part": 0} for r in table.collect()]
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    dealt = [{**r, "side": 0} for r in own] + [{**r, "bx": r["bx"] + i, "by": r["by"] + j, "side": 2 if i or j else 1} for r in own for i, j in steps]
    dealt.sort(key=lambda r: (r["type"], r["bx"], r["by"], r["part"], r["side"]))
    names = {k: n for n, k in number.items()}
    import pyarrow as pa

    for most in (1, 64):
        tiles = sorted((r for b in S._tiles(iter([pa.RecordBatch.from_pylist(dealt)]), 5.0, most) for r in b.to_pylist()), key=lambda r: (r["ta"], r["tb"]))
        assert most == 1 or len(tiles) == len({(r["ta"], r["tb"]) for r in tiles})
        got = [(names[a], names[b]) for t in S._of_tiles(iter([pa.RecordBatch.from_pylist(tiles, S.PLACES)])) for a, b in zip(*t.to_pydict().values())]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want
    if tile == 1024:
        got = [tuple(r) for r in S.proximity(df, 5.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_close_samples_come_by_line_and_k():
    """So that the nearest of each line is found without sorting pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [(int(side), int(line), int(k), float(x)) for side, line, k, x in zip([0] * 5 + [1] * 60, rng.integers(0, 6, 65), rng.integers(0, 50, 65), rng.uniform(0, 4, 65))]
    t = pa.RecordBatch.from_pylist([{"type": "toe", "bx": 0, "by": 0, "part": 0, "side": s, "line_id": n, "k": k, "x": x, "y": 0.0} for s, n, k, x in rows])
    seen = 0
    for a, b, d, table in S._close(iter([t]), 1.0):
        line, k = table["line_id"].to_numpy(), table["k"].to_numpy()
        order = list(zip(a.tolist(), line[b].tolist(), k[b].tolist()))
        assert order == sorted(order) and (line[a] != line[b]).all() and (d <= 1.0).all()
        seen += len(a)
    assert seen == sum(p[0] == 0 and q[0] == 1 and p[1] != q[1] and abs(p[3] - q[3]) <= 1.0 for p in rows for q in rows)


@pytest.mark.parametrize("crowd,at_once", [(1 << 14, 1 << 22), (40, 1)])
def test_first_of_each_pair_of_lines_and_cell(spark, monkeypatch, crowd, at_once):
    """As taken from all rows of nearest samples, which q_key_dedup would have to join and sort."""
    from pyspark.sql import functions as F

    from cresthaven.plans import line_queries as Q

    rng = np.random.default_rng(11)
    side = 45.0
    rows = [(i * 3 - 20, "toe" if i % 2 else "crest", k, float(x), float(y)) for i in range(24) for k, (x, y) in enumerate(rng.integers(-side, side, (25, 2)) * 0.5)]
    rows += [(1000, "toe", 0, None, 1.0), (1001, "toe", 0, 2.0, None)]
    s = spark.createDataFrame(rows, "line_id bigint, type string, k bigint, x double, y double")
    want = S.first_per_key(Q.middles(S.nearest_samples(s, 5.0), s), [*Q.place().values()], ["first", "k"]).select("first", "second", "k", "k2")
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S._block_firsts, "__defaults__", (at_once,))
    got = [tuple(r) for r in S.first_nearest(s, 5.0).collect()]
    assert len(got) > 500 and sorted(got) == sorted(tuple(r) for r in want.collect())
    with pytest.raises(ValueError):
        S.first_nearest(s, 5.0, 9.0)


def test_key_dedup_makes_no_row_of_nearest_samples(spark, monkeypatch):
    from cresthaven.plans import line_queries as Q

    monkeypatch.setattr(S, "nearest_samples", None)
    assert Q.q_key_dedup(spark, "/root/testdata/sf0.001").columns == ["first", "second", "k", "k2"]


@pytest.mark.parametrize("nearby,at_once,small", [(1 << 14, 1 << 17, 1 << 12), (40, 50, 0), (40, 1, 1 << 12)])
def test_nearest_samples_leave_arrow_as_lists(spark, monkeypatch, nearby, at_once, small):
    """By brute force: ties, crowded blocks, lists in several rows, samples without a type or place."""
    rng = np.random.default_rng(17)
    rows = [(i * 3 - 20, "toe" if i % 2 else "crest", k, float(x), float(y)) for i in range(24) for k, (x, y) in enumerate(rng.integers(-25, 25, (14, 2)) * 0.5)]
    rows += [(1000 + i, kind, 0, x, 1.0) for i, (kind, x) in enumerate([("toe", None), ("toe", np.nan), ("toe", np.inf), (None, 1.0)])]
    want = {}
    for a in rows[:-4]:
        for b in rows[:-4]:
            d = float(np.sqrt((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2))
            if a[1] == b[1] and a[0] != b[0] and d <= 5.0:
                key = a[1], a[0], a[2], b[0]
                want[key] = min(want.get(key, (d, b[2])), (d, b[2]))
    want = sorted((*key, k2, round(d, 6)) for key, (d, k2) in want.items())
    df = spark.createDataFrame([(*r[:3], *(None if v is None else float(v) for v in r[3:])) for r in rows], "line_id bigint, type string, k bigint, x double, y double")
    monkeypatch.setattr(S, "NEARBY", nearby)
    monkeypatch.setattr(S, "SMALL", small)
    dealt = S._in_blocks(df, 5.0).toArrow().to_batches()
    lists = [r for b in S._nearest_lists(iter(dealt), 5.0, 6, at_once) for r in b.to_pylist()]
    assert all(0 < len(r["seconds"]) <= at_once for r in lists)
    assert sorted((r["type"], r["first"], r["k"], *v) for r in lists for v in zip(r["seconds"], r["k2s"], r["ds"])) == want
    if not small:
        got = S.nearest_samples(df, 5.0, digits=6).select("type", "first", "k", "second", "k2", "d")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_knn1_has_no_row_of_a_pair_before_the_jvm(spark, monkeypatch):
    from cresthaven.plans import line_queries as Q

    monkeypatch.setattr(S, "_bucketed", None)
    assert Q.q_knn1(spark, "/root/testdata/sf0.001").columns == ["first", "k", "second", "k2", "d"]

import heapq
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cresthaven.operators import components, grid, polyline, raster, routing, selection, spatial
from cresthaven.plans import outputs
from cresthaven.plans.config import Config, checked_request
from cresthaven.plans.pipeline import Surface, distances, edt, routed


def mask_df(spark, cells):
    return spark.createDataFrame(sorted(cells) or [], "row int, col int")


def test_components_match_flood_fill(spark):
    r = random.Random(1)
    cells = {(i, j) for i in range(40) for j in range(40) if r.random() < 0.35}
    got = {(x.row, x.col): x.label for x in components.labels(mask_df(spark, cells)).collect()}
    assert set(got) == cells
    seen, count = set(), 0
    for start in sorted(cells):
        if start in seen:
            continue
        count += 1
        todo, part = [start], set()
        while todo:
            p = todo.pop()
            if p in part:
                continue
            part.add(p)
            todo += [q for d in raster.COMPASS if (q := (p[0] + d[0], p[1] + d[1])) in cells]
        seen |= part
        assert len({got[p] for p in part}) == 1
    assert len(set(got.values())) == count
    assert components.labels(mask_df(spark, set())).count() == 0


def test_fill_and_distance(spark):
    r = random.Random(2)
    cells = {(i, j): float(i * 100 + j) for i in range(20) for j in range(20) if r.random() < 0.2}
    df = spark.createDataFrame([(i, j, z) for (i, j), z in cells.items()], "row int, col int, z double")
    got = {(x.row, x.col): (x.z, x.d2) for x in raster.fill(df, 4.0).collect()}
    for i in range(-4, 24):
        for j in range(-4, 24):
            best = min(((i - a) ** 2 + (j - b) ** 2, a, b) for a, b in cells)
            assert got.get((i, j)) == ((cells[best[1:]], best[0]) if best[0] <= 16 else None)


def test_edt():
    r = np.random.default_rng(0)
    mask = r.random((15, 22)) < 0.05
    mask[3, 4] = True
    points = np.argwhere(mask)
    for i in range(15):
        for j in range(22):
            assert edt(mask)[i, j] == pytest.approx(np.sqrt(((points - (i, j)) ** 2).sum(axis=1).min()))


def test_nearest_is_unbounded(spark):
    r = random.Random(7)
    points = {(k, r.randrange(25), r.randrange(40)) for k, n in (("crest", 6), ("toe", 60), ("one", 1)) for _ in range(n)}
    df = spark.createDataFrame([*points, ("crest", -1, 3), ("off", 25, 0)], "kind string, row int, col int")
    got = {(x.kind, x.row, x.col): (x.d2, x.sr, x.sc) for x in raster.nearest(df, 40, 25).collect()}
    assert len(got) == 3 * 25 * 40
    for (kind, i, j), found in got.items():
        assert found == min(((i - a) ** 2 + (j - b) ** 2, a, b) for k, a, b in points if k == kind)


def test_routes_are_priced_by_far_edges(spark):
    """An edge and a line 50 cells off the window count with their true distances."""
    ny, nx = 30, 90
    s = Surface(None, 1.0, 0.0, 0.0, nx, ny)
    edges = spark.createDataFrame([("crest", 0, 85)], "type string, row int, col int")
    taken = spark.createDataFrame([("crest", 29, 80), ("toe", 10, 10)], edges.schema)
    flat = spark.createDataFrame([(i, j, 1.0) for i in range(ny) for j in range(nx)], "row int, col int, z double")
    cand = spark.createDataFrame([(1, "crest", 10.5, -9.5, 1.0, 20.5, -11.5, 1.0, 9, 10, 11, 20)], "cid bigint, type string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, r0 int, c0 int, r1 int, c1 int")
    price = lambda edge, line, z, x, y, f: 1 + 2 * edge + line
    got = routed(cand, s, distances(edges, s, "edge"), distances(taken, s, "line"), flat, F.lit(5), price, 1.0, None).first()
    to = lambda r, c: np.hypot(np.arange(ny)[:, None] - r, np.arange(nx)[None] - c)
    cost = (1 + 2 * to(0, 85) + to(29, 80))[4:17, 5:26]
    assert got.path_cost == pytest.approx(routing.dijkstra(cost, (5, 5), (7, 15))[1])


def test_dijkstra_is_cheapest():
    cost = np.random.default_rng(3).random((9, 11)) + 0.1
    path, total = routing.dijkstra(cost, (0, 0), (8, 10))
    assert path[0] == (0, 0) and path[-1] == (8, 10)
    walked = sum((2**0.5 if a[0] != b[0] and a[1] != b[1] else 1) * (cost[a] + cost[b]) / 2 for a, b in zip(path, path[1:]))
    assert walked == pytest.approx(total)
    best = {(0, 0): 0.0}
    heap = [(0.0, (0, 0))]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        for i in range(max(0, r - 1), min(9, r + 2)):
            for j in range(max(0, c - 1), min(11, c + 2)):
                n = d + float(np.hypot(i - r, j - c)) * (cost[r, c] + cost[i, j]) / 2
                if n < best.get((i, j), 1e9) - 1e-12:
                    best[i, j] = n
                    heapq.heappush(heap, (n, (i, j)))
    assert total == pytest.approx(best[8, 10])


def test_match_equals_sorted_greedy(spark):
    r = random.Random(4)
    rows = [(a, b, a * 2, b * 2 + 1, r.random()) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.3]
    df = spark.createDataFrame(rows, "first_line bigint, second_line bigint, first bigint, second bigint, score double")
    used, want = set(), set()
    for a, b, *_ in sorted(rows, key=lambda x: x[4]):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(x.first_line, x.second_line) for x in selection.match(df, ["score"]).collect()} == want
    assert selection.match(df.limit(0), ["score"]).count() == 0


def test_match_of_a_long_chain(spark):
    """Ties and rising scores let a round take one pair only; none may be left over."""
    ddl = "first_line bigint, second_line bigint, first bigint, second bigint, score double"
    tied = [(i, i + 1, 2 * i, 2 * i + 1, 1.0) for i in range(600)]
    rising = [(i, i + 1, 2 * i, 2 * i + 1, float(i)) for i in range(1000, 1400)]
    got = {(x.first_line, x.second_line) for x in selection.match(spark.createDataFrame(tied + rising, ddl), ["score"]).collect()}
    assert got == {(i, i + 1) for i in [*range(0, 600, 2), *range(1000, 1400, 2)]}


def test_thin_keeps_distance(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["crest", "toe"]), r.randrange(40), 50 + r.randrange(40), r.random() * 100, r.random() * 100, r.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "cid bigint, type string, first_line bigint, second_line bigint, mx double, my double, score double")
    kept = [rows[x.cid] for x in selection.thin(df, 15.0, 30).collect()]
    assert 0 < len(kept) <= 30 and len({k[2:4] for k in kept}) == len(kept)
    for a in kept:
        for b in kept:
            if a[0] < b[0] and a[1] == b[1]:
                assert np.hypot(a[4] - b[4], a[5] - b[5]) >= 15
    assert max(rows, key=lambda x: x[6])[0] in {k[0] for k in kept}


def test_thin_in_rounds_equals_the_sorted_walk(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["crest", "toe"]), r.randrange(30), 50 + r.randrange(30), r.random() * 150, r.random() * 150, r.randrange(60) / 60) for i in range(400)]
    df = spark.createDataFrame(rows, "cid bigint, type string, first_line bigint, second_line bigint, mx double, my double, score double")
    want, pairs = [], set()
    for i, kind, a, b, x, y, _ in sorted(rows, key=lambda v: (-v[6], v[0])):
        if (a, b) not in pairs and all(kind != k or np.hypot(x - u, y - v) >= 12 for k, u, v in want_places(want, rows)):
            want.append(i)
            pairs.add((a, b))
    assert [x.cid for x in selection.thin(df, 12.0, 1000).orderBy("rank").collect()] == want
    assert [x.cid for x in selection.thin(df, 12.0, 20, at_once=30).orderBy("rank").collect()] == want[:20]
    assert selection.thin(df.limit(0), 12.0, 20).count() == 0


def want_places(chosen, rows):
    return [(rows[i][1], rows[i][4], rows[i][5]) for i in chosen]


def test_simplify_of_odd_lines():
    p = np.array([(0.0, 0), (1, 3), (2, -3), (3, 3), (0, 0)])
    assert polyline.simplify(p, 0.5).tolist() == [0, 1, 2, 3, 4] and polyline.simplify(p, 100).tolist() == [0, 4]
    assert polyline.simplify(p[:1], 1).tolist() == [0] and polyline.simplify(p[:0], 1).tolist() == [] and polyline.simplify(p[:2], 1).tolist() == [0, 1]
    assert polyline.simplify(np.array([(0.0, 0), (1, 2), (2, 2), (3, 0)]), 1.0).tolist() == [0, 1, 3]


def test_close_samples_in_dense_buckets(spark, monkeypatch):
    """Dense buckets are dealt over parts; pairs and nearest samples stay those of a plain search."""
    r = random.Random(8)
    rows = [(r.randrange(8), r.choice(["crest", "toe"]), k, r.gauss(0, 6), r.gauss(0, 6)) for k in range(300)]
    df = spark.createDataFrame(rows, "line_id bigint, type string, k bigint, x double, y double")
    want, near = set(), {}
    for a, t, k, x, y in rows:
        for b, u, k2, v, w in rows:
            d = math.sqrt((v - x) * (v - x) + (w - y) * (w - y))
            if t == u and a != b and d <= 2.5:
                want.add((min(a, b), max(a, b)))
                near[t, a, k, b] = min(near.get((t, a, k, b), (9.0, 0)), (d, k2))
    for largest in (4096, 7):
        monkeypatch.setattr(spatial, "LARGEST", largest)
        assert {(p.first, p.second) for p in spatial.proximity(df, 2.5).collect()} == want
        got = spatial.nearest_samples(df, 2.5).collect()
        assert len(got) == len(near) and {(p.type, p.first, p.k, p.second): (p.d, p.k2) for p in got} == near
    assert spatial.proximity(df.limit(0), 2.5).count() == 0


def test_chain_walks_everything_once():
    cells = pd.DataFrame([(0, c) for c in range(10)] + [(5, c) for c in range(3)], columns=["row", "col"])
    found = selection.chain(cells, 1)
    assert [len(f) for f in found] == [10, 3] and [len(f) for f in selection.chain(cells, 5)] == [10]


def test_simplify_stays_within_tolerance():
    t = np.linspace(0, 6, 200)
    p = np.column_stack([t, np.sin(t)])
    kept = polyline.simplify(p, 0.05)
    assert kept[0] == 0 and kept[-1] == 199 and len(kept) < 40
    for a, b in zip(kept, kept[1:]):
        d = p[b] - p[a]
        off = p[a : b + 1] - p[a]
        s = np.clip(off @ d / (d @ d), 0, 1)
        assert np.hypot(*(off - s[:, None] * d).T).max() <= 0.05 + 1e-12


def test_empty_cloud(spark):
    empty = spark.createDataFrame([], "x double, y double, z double, red int, green int, blue int")
    cells, meta = grid.build(empty, 1.0)
    assert cells.count() == 0 and meta.count() == 0
    bad = spark.createDataFrame([(float("nan"), 1.0, 1.0, None, None, None), (1.0, None, 2.0, 1, 1, 1), (1.0, 1.0, -2e6, 1, 1, 1), (1.0, 1.0, 3.0, None, None, None)], empty.schema)
    assert grid.valid(bad).count() == 1
    cells, _ = grid.build(bad, 1.0, colour=True)
    assert [(r.z, r.cnt, r.red) for r in cells.collect()] == [(3.0, 1, 0.0)]


def test_config():
    c = Config.from_dict({"input": "a.ply", "grid_res_m": 2.0, "unknown": 1}, "/base")
    assert c.input == "/base/a.ply" and c.grid_res_m == 2.0 and c.output == ""
    with pytest.raises(ValueError):
        Config(output_crs="UTM")
    assert checked_request({"grid_res_m": 1, "enhanced_link": True}) == {"grid_res_m": 1, "enhanced_link": True}
    for bad in ({"grid_res_m": True}, {"min_line_m": 0}, {"enhanced_link": 1}, {"x": 1}, {"link_gap_m": float("nan")}):
        with pytest.raises(ValueError):
            checked_request(bad)


def test_png():
    data = outputs.png(np.zeros((3, 5, 3), np.uint8))
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND\xaeB`\x82")


def test_routes_in_windows(spark):
    """A wall with one opening inside the window; candidate numbers of 64 bits survive."""
    wall = [(r, c, 100.0 if c == 70 and r != 66 else 1.0) for r in range(55, 75) for c in range(55, 85)]
    cells = spark.createDataFrame(wall, "row int, col int, cost double")
    big = 2**62 + 1
    cand = spark.createDataFrame([(big, 60, 60, 60, 80), (-7, 70, 62, 70, 62)], "cid bigint, r0 int, c0 int, r1 int, c1 int")
    from pyspark.sql import functions as F

    got = {r.cid: r for r in routing.route(routing.windows(cand, cells, F.lit(8))).collect()}
    path = [(p.row, p.col) for p in got[big].path]
    assert path[0] == (60, 60) and path[-1] == (60, 80) and (66, 70) in path and got[big].n == len(path)
    assert got[-7].n == 1 and got[-7].path_cost == 0.0

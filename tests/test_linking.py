"""Linking, local linking, protection and bridges on the straight terraces, with lines laid by hand along a crest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cresthaven.operators import selection, spatial
from cresthaven.plans import pipeline
from cresthaven.plans.config import Config
from cresthaven.sources.frames import terrace

EDGE = 38.5  # the first ramp's upper edge


@pytest.fixture(scope="module")
def ground(spark):
    return pipeline.surface(terrace(spark), Config())


def lines(spark, *spans, **more):
    """Crest lines along the edge, a vertex every five metres."""
    rows = [(k, "crest", [(EDGE, float(y)) for y in range(a, b + 1, 5)], float(b - a), 12.0) for k, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, f"line_id bigint, type string, pts {pipeline.POINTS}, length double, z double").withColumn("source", F.lit("platform_boundary"))
    return pipeline.lines_like(df.withColumns({k: F.lit(v) for k, v in more.items()}))


def found(df):
    return sorted((round(r.length), r.link_mode, r.source) for r in df.collect())


def test_basic_linking(spark, ground):
    out = pipeline.link(lines(spark, (5, 45), (60, 115)), ground, Config(link_gap_m=30.0), enhanced=False)
    (r,) = out.collect()
    assert r.link_mode == "linked" and 108 <= r.length <= 116 and r.z == 12.0
    assert min(p.y for p in r.pts) == 5.0 and max(p.y for p in r.pts) == 115.0
    far = pipeline.link(lines(spark, (5, 40), (80, 115)), ground, Config(link_gap_m=30.0), enhanced=False)
    assert found(far) == [(35, None, "platform_boundary")] * 2


def test_enhanced_linking_and_passes(spark, ground):
    out = pipeline.link(lines(spark, (5, 30), (40, 65), (75, 115)), ground, Config(link_gap_m=30.0))
    (r,) = out.collect()
    assert r.link_mode == "regular_edge" and r.confidence >= 0.9 and 108 <= r.length <= 118


def test_protected_lines_are_left_alone(spark, ground):
    c = Config(link_gap_m=30.0, edge_seed_protect_links=True, edge_seed_protected_region_indices=[1])
    seeded = lines(spark, (5, 45), (60, 115), source="edge_seed", seed_region=1)
    assert len(found(pipeline.link(seeded, ground, c))) == 2
    assert len(found(pipeline.link(seeded, ground, c.but(edge_seed_protected_region_indices=[0])))) == 1


def test_local_linking(spark, ground):
    c = Config(edge_seed_regions=[[30.0, 5.0, 45.0, 30.0], None], edge_seed_local_link_buffer_m=5.0)
    out = pipeline.link_local(lines(spark, (5, 25), (35, 55), (80, 100), (110, 118)), ground, c)
    got = [r[0] for r in found(out)]
    assert len(got) == 3 and got[:2] == [8, 20] and 48 <= got[2] <= 53
    assert pipeline.link_local(lines(spark, (5, 25)), ground, Config()).count() == 1


def test_a_bridge_is_found(spark, ground):
    """A gap of 40 m along a step edge is bridged by a strong path; without evidence there is none."""
    base = lines(spark, (5, 40), (80, 115))
    out = pipeline.bridge(base, ground, Config(auto_gap_enabled=True))
    extra = out.where("source = 'auto_gap_bridge'").collect()
    assert len(extra) == 1 and out.count() == 3
    (b,) = extra
    assert b.evidence_class == "strong" and 39 <= b.anchor_gap_m <= 41 and 0.9 <= b.edge_support_2m and b.length_ratio < 1.2 and {b.anchor_line_start, b.anchor_line_end} == {0, 1}
    off = base.withColumn("pts", F.transform("pts", lambda p: F.struct((p.x + 20).alias("x"), p.y.alias("y"))))
    assert pipeline.bridge(off, ground, Config(auto_gap_enabled=True)).count() == 2


def test_validation_needs_relief(spark, ground):
    on_flat = lines(spark, (5, 60)).withColumn("pts", F.transform("pts", lambda p: F.struct((p.x + 20).alias("x"), p.y.alias("y"))))
    assert pipeline.validate(lines(spark, (5, 60)), ground, Config()).count() == 1
    assert pipeline.validate(on_flat, ground, Config()).count() == 0


def crowd(n=90, seed=3):
    """Line ends close together: (end_id, line_id, type, x, y, tx, ty, z)."""
    r = random.Random(seed)
    angle = [r.uniform(0, 6.283) for _ in range(n)]
    return [(i, i // 2, r.choice(["crest", "toe"]), r.uniform(0, 150), r.expovariate(1 / 40), math.cos(a), math.sin(a), r.uniform(0, 6)) for i, a in enumerate(angle)]


ENDS = "end_id bigint, line_id bigint, type string, x double, y double, tx double, ty double, z double"


def plain_pairs(rows, c):
    """Enhanced candidates by comparing every end with every other: (first, second) -> (classes, score)."""
    found = {}
    for i, l, t, x, y, tx, ty, z in rows:
        for j, m, u, v, w, sx, sy, q in rows:
            d = math.sqrt((v - x) * (v - x) + (w - y) * (w - y))
            if i >= j or l == m or t != u or not 0.5 <= d <= c.link_infer_gap_m:
                continue
            ux, uy, dz = (v - x) / d, (w - y) / d, abs(z - q)
            cos, off = min(tx * ux + ty * uy, -(sx * ux + sy * uy)), max(abs(ux * ty - uy * tx) * d, abs(ux * sy - uy * sx) * d)
            kinds = (d <= c.link_gap_m and dz <= 5 and cos >= 0.35 and off <= 15, d <= 25 and dz <= 3 and off <= 18, d <= 100 and dz <= 9 and cos >= 0.1 and off <= 18)
            if any(kinds):
                found[i, j] = (kinds, d / 100 + 0.35 * (1 - cos) + 0.35 * off / 18 + 0.35 * dz / 9 - 0.2 * kinds[0] - 0.1 * kinds[1])
    return found


@pytest.mark.parametrize("at_once, small", [(2048, 4096), (7, 1), (2048, 1)])
def test_enhanced_pairs_in_dense_buckets(spark, monkeypatch, at_once, small):
    """Dealt over parts, by products or one by one, with a bound on the score or with few wanted ends: the pairs of a plain search."""
    monkeypatch.setattr(spatial, "ENDS", at_once)
    monkeypatch.setattr(spatial, "SMALL", small)
    rows, c = crowd(), Config(link_gap_m=30.0)
    want = plain_pairs(rows, c)
    ends = spark.createDataFrame(rows, ENDS)
    names = ["first", "second", "regular", "short", "inferred", "pre_score"]
    read = lambda df: {(p.first, p.second): ((p.regular, p.short, p.inferred), p.pre_score) for p in df.collect()}
    got = read(spatial.link_pairs_enhanced(ends, c, names))
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1e-9) for p in want)
    for most in (-0.2, 0.0, 0.4):
        assert read(spatial.link_pairs_enhanced(ends, c, names, most)).keys() == {p for p, (_, score) in want.items() if score <= most}
    some = ends.withColumn("wanted", ends.end_id % 5 == 0)
    assert read(spatial.link_pairs_enhanced(some, c, names)).keys() == {p for p in want if p[0] % 5 == 0 or p[1] % 5 == 0}


@pytest.mark.parametrize("few", [5000, 0])
def test_bands_of_the_score_match_and_rank_as_the_whole_list(spark, few):
    """At once or band by band: the greedy matching, and the two best of each end, of all candidates."""
    rows, c = crowd(), Config(link_gap_m=30.0)
    want, used, taken = plain_pairs(rows, c), set(), set()
    for i, j in sorted(want, key=lambda p: (want[p][1], p)):
        if not {i // 2, j // 2} & used:
            used |= {i // 2, j // 2}
            taken.add((i, j))
    ends = spark.createDataFrame(rows, ENDS)
    assert {(p.first, p.second) for p in selection.match_links(ends, c, few).collect()} == taken
    best = {p for i, *_ in rows for p in sorted((p for p in want if i in p), key=lambda p: (round(want[p][1], 9), p))[:2]}
    assert sorted((p.first, p.second) for p in spatial.top_links(ends, c, 2, few=few).collect()) == sorted(best)

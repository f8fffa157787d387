"""Registered terrain queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import components, polyline, raster, routing, selection
from ..sources.frames import terrace
from . import job_queries, line_queries, pipeline, raster_queries
from .config import Config


def q_chain(spark, d):
    """Chains of the platforms' boundary cells."""
    edge = raster.boundary(components.cut(raster_queries.labelled(spark, d)))
    return selection.chains(edge, ["label"], 8)


def q_simplify(spark, d):
    """Douglas-Peucker with 100 m on the event lines."""
    return polyline.simplified(line_queries.vertices(spark, d), 100.0)


def q_match(spark, d):
    """Greedy one-to-one matching of the enhanced candidates."""
    return line_queries.matched(spark, d).select("first", "second", "first_line", "second_line", F.round("pre_score", 6).alias("pre_score"))


def q_route(spark, d):
    """Least-cost paths over the cells between matched line ends; cost: 1 and the height difference to the start."""
    ends = line_queries.on_grid(line_queries.ends(spark, d)).select("end_id", "row", "col")
    side = lambda n, k: ends.select(F.col("end_id").alias(n), F.col("row").alias(f"r{k}"), F.col("col").alias(f"c{k}"))
    pairs = line_queries.matched(spark, d).join(side("first", 0), "first").join(side("second", 1), "second")
    c = pairs.select(F.xxhash64("first", "second").alias("cid"), "first", "second", "r0", "c0", "r1", "c1")
    w = routing.windows(c, raster_queries.cells(spark, d).select("row", "col", "z"), F.lit(4))
    out = routing.route(w.withColumn("cost", 1 + F.abs(F.col("z"))))
    return out.join(c, "cid").select("first", "second", F.round("path_cost", 6).alias("path_cost"), "n")


def q_nms(spark, d):
    """Non-maximum suppression of the 2000 best gap candidates."""
    cid, score = (F.col("first") * 100000 + F.col("second")) * 100000 + F.col("k"), F.round(1 / (1 + F.col("d")), 9)
    best = line_queries.best_candidates(spark, d, lambda r: score > 1 / (1 + r) + 1e-8, [F.desc(score), cid])
    return selection.thin(best.withColumns({"first_line": F.col("first"), "second_line": F.col("second"), "cid": cid, "score": score}), 20.0, 60)


def q_multiscale(spark, d):
    """Lines of strict and relaxed platforms on the terrace."""
    c = Config(platform_slope_deg=3.0, multiscale_slope_deg=12.0)
    s = pipeline.surface(terrace(spark), c)
    out = pipeline.multiscale(pipeline.extract(s, c), s, c)
    return out.select("line_id", "type", F.round("length", 3).alias("length"), "source")


def q_pipeline(spark, d):
    """The report of the whole pipeline on the synthetic terraces."""
    return L.counts(pipeline.lines_of(terrace(spark, wavy=True), Config(link_gap_m=30.0, auto_gap_enabled=True)))


def q_published(spark, d):
    """The published figures of the synthetic terraces."""
    found = L.counts(pipeline.lines_of(terrace(spark, wavy=True), Config(link_gap_m=30.0, auto_gap_enabled=True, compat=True)))
    return found.select("crest", "toe", "auto_gap", "total_length_m")


def q_terrace_slope(spark, d):
    """Slopes of the terrace's one-metre cells."""
    from ..operators import grid

    cells, meta = grid.build(terrace(spark), 1.0)
    s = raster.slope(raster_queries.sized(cells.withColumn("z", F.round("z", 6)), meta), 1.0)
    return s.select("row", "col", "z", F.round("slope", 4).alias("slope"), (F.coalesce(F.round("slope", 4), F.lit(90.0)) < 10).alias("platform"))


_TERRACE = raster_queries.BASE.replace(raster_queries.PTS, """raw AS (SELECT (i%450)*0.4::DOUBLE x, (i//450)*0.4::DOUBLE y FROM range(135000) t(i)), pts AS (SELECT x, y, (least(greatest((x-30.0)/8.0::DOUBLE,0.0),1.0)+least(greatest((x-75.0)/8.0::DOUBLE,0.0),1.0)+least(greatest((x-120.0)/8.0::DOUBLE,0.0),1.0))*12.0::DOUBLE z, 0 red, 0 green, 0 blue FROM raw)""")

OWN = {f.__name__: f for f in (q_chain, q_simplify, q_match, q_route, q_nms, q_multiscale, q_pipeline, q_published, q_terrace_slope)}
# the figures that are published for that cloud
_PUBLISHED = "SELECT 3::BIGINT crest, 3::BIGINT toe, 0::BIGINT auto_gap, 548.83::DOUBLE total_length_m"
_THIN = f"""WITH RECURSIVE {line_queries.LINES}, {line_queries._CAND},
 best AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, cid) r FROM (SELECT * EXCLUDE (r), (fl*100000+sl)*100000+k cid, round(1/(1+d),9) score FROM kd) ORDER BY score DESC, cid LIMIT 2000),
 g AS (SELECT 0::BIGINT r, 0::BIGINT cid, false took, []::STRUCT(t VARCHAR, a BIGINT, b BIGINT, x DOUBLE, y DOUBLE)[] kept UNION ALL
  SELECT r, cid, ok, CASE WHEN ok THEN list_append(kept, me) ELSE kept END FROM (SELECT b.r, b.cid, kept, me, len(kept)<60 AND len(list_filter(kept, lambda e: (e.a=me.a AND e.b=me.b) OR (e.t=me.t AND (e.x-me.x)*(e.x-me.x)+(e.y-me.y)*(e.y-me.y)<400)))=0 ok
   FROM (SELECT g.kept, b.r, b.cid, {{'t': b.type, 'a': least(fl,sl), 'b': greatest(fl,sl), 'x': mx, 'y': my}} me FROM g JOIN best b ON b.r=g.r+1) b))
 SELECT cid, row_number() OVER (ORDER BY r)::INT AS "rank" FROM g WHERE took"""
_SIMPLE = f"""WITH RECURSIVE {line_queries.V}, nn AS (SELECT line_id, max(idx) m FROM v GROUP BY 1),
 spans(line_id, a, b) AS (SELECT line_id, 0::BIGINT, m::BIGINT FROM nn WHERE m>0 UNION ALL
  SELECT line_id, unnest([a, k]), unnest([k, b]) FROM (SELECT s.line_id, s.a, s.b, f.k FROM spans s, LATERAL (SELECT arg_max(i, (off, -i)) k, max(off) off FROM
   (SELECT p.idx i, sqrt((p.x-u.x-t*(w.x-u.x))*(p.x-u.x-t*(w.x-u.x))+(p.y-u.y-t*(w.y-u.y))*(p.y-u.y-t*(w.y-u.y))) off FROM v p JOIN v u ON u.line_id=p.line_id AND u.idx=s.a JOIN v w ON w.line_id=p.line_id AND w.idx=s.b,
    LATERAL (SELECT CASE WHEN (w.x-u.x)*(w.x-u.x)+(w.y-u.y)*(w.y-u.y)>0 THEN greatest(0,least(1,((p.x-u.x)*(w.x-u.x)+(p.y-u.y)*(w.y-u.y))/((w.x-u.x)*(w.x-u.x)+(w.y-u.y)*(w.y-u.y)))) ELSE 0 END t) WHERE p.line_id=s.line_id AND p.idx>s.a AND p.idx<s.b)) f WHERE f.off>100)),
 kept AS (SELECT DISTINCT line_id, a idx FROM spans UNION SELECT line_id, m FROM nn)
 SELECT line_id, type, row_number() OVER (PARTITION BY line_id ORDER BY idx)-1 idx, x, y FROM kept JOIN v USING (line_id, idx)"""
# relaxes the neighbours of cells whose cost has fallen until none falls
_ROUTE = f"""WITH RECURSIVE {raster_queries.BASE}, {line_queries.MATCHED}, eg AS MATERIALIZED (SELECT end_id, {line_queries._ON} FROM ends),
 cd AS (SELECT m."first" f, m."second" s, a."row" r0, a.col c0, b."row" r1, b.col c1 FROM matched m JOIN eg a ON a.end_id=m."first" JOIN eg b ON b.end_id=m."second"),
 seen AS MATERIALIZED (SELECT cd.*, c."row", c.col, 1+abs(c.z) cost FROM cd JOIN cells c ON c."row" BETWEEN least(r0,r1)-4 AND greatest(r0,r1)+4 AND c.col BETWEEN least(c0,c1)-4 AND greatest(c0,c1)+4),
 box AS (SELECT f, s, r0, c0, r1, c1, least(min("row"),r0,r1) t, greatest(max("row"),r0,r1) b, least(min(col),c0,c1) l, greatest(max(col),c0,c1) g FROM seen GROUP BY f, s, r0, c0, r1, c1),
 win AS MATERIALIZED (SELECT x.*, coalesce(n.cost,25.0) cost FROM (SELECT f, s, r0, c0, r1, c1, i::INT "row", unnest(range(l,g+1))::INT col FROM (SELECT *, unnest(range(t,b+1)) i FROM box)) x LEFT JOIN (SELECT f, s, "row", col, cost FROM seen) n USING (f, s, "row", col)),
 far(f, s, "row", col, cost, n, here) USING KEY (f, s, "row", col) AS (SELECT f, s, "row", col, 0.0::DOUBLE, 1::INT, cost::DOUBLE FROM win WHERE "row"=r0 AND col=c0 UNION
  SELECT x.* FROM (SELECT f, s, "row", col, min(d) cost, arg_min(m, d) n, any_value(here) here FROM (SELECT p.f, p.s, w."row", w.col, p.cost+CASE WHEN w."row"<>p."row" AND w.col<>p.col THEN 1.4142135623730951::DOUBLE ELSE 1.0::DOUBLE END*(p.here+w.cost)/2 d, p.n+1 m, w.cost::DOUBLE here
   FROM far p, {raster_queries._DIRS} o JOIN win w ON true WHERE w.f=p.f AND w.s=p.s AND w."row"=p."row"+o.dr AND w.col=p.col+o.dc) GROUP BY f, s, "row", col) x LEFT JOIN recurring.far e ON e.f=x.f AND e.s=x.s AND e."row"=x."row" AND e.col=x.col WHERE e.cost IS NULL OR x.cost<e.cost)
 SELECT far.f AS "first", far.s AS "second", round(far.cost,6) path_cost, far.n FROM far JOIN box ON box.f=far.f AND box.s=far.s AND far."row"=box.r1 AND far.col=box.c1"""
# a walk for each label: on to the nearest unused neighbour, or else to the next unused start
_CHAIN = f"""{raster_queries._COMP}, {raster_queries._BDY}, cs AS MATERIALIZED (SELECT label, "row", col, row_number() OVER (PARTITION BY label ORDER BY "row", col) id FROM bdy),
 nb AS MATERIALIZED (SELECT a.label, a.id, b.id nid, ((b."row"-a."row")*(b."row"-a."row")+(b.col-a.col)*(b.col-a.col))*100+(b."row"-a."row"+2)*10+b.col-a.col+2 o FROM cs a JOIN (SELECT dr::INT dr, dc::INT dc FROM range(-2,3) x(dr), range(-2,3) y(dc) WHERE dr<>0 OR dc<>0) f ON true JOIN cs b ON b.label=a.label AND b."row"=a."row"+f.dr AND b.col=a.col+f.dc),
 st AS MATERIALIZED (SELECT label, id, CASE WHEN (SELECT count(*) FROM nb WHERE nb.label=cs.label AND nb.id=cs.id)>1 THEN 1000000000 ELSE 0 END+id so FROM cs),
 w AS (SELECT label, arg_min(id, so) cur, 0 chain, 0 idx, [arg_min(id, so)] used FROM st GROUP BY label UNION ALL
  SELECT label, coalesce(nx, sx), CASE WHEN nx IS NULL THEN chain+1 ELSE chain END, CASE WHEN nx IS NULL THEN 0 ELSE idx+1 END, list_append(used, coalesce(nx, sx)) FROM
   (SELECT t.label, t.cur, t.chain, t.idx, t.used, t.nx, arg_min(st.id, st.so) sx FROM
     (SELECT w.label, w.cur, w.chain, w.idx, w.used, arg_min(nb.nid, nb.o) nx FROM w LEFT JOIN nb ON nb.label=w.label AND nb.id=w.cur AND NOT list_contains(w.used, nb.nid) GROUP BY ALL) t
    LEFT JOIN st ON t.nx IS NULL AND st.label=t.label AND NOT list_contains(t.used, st.id) GROUP BY ALL) WHERE nx IS NOT NULL OR sx IS NOT NULL),
 long AS (SELECT label, chain old, dense_rank() OVER (PARTITION BY label ORDER BY chain)-1 chain FROM w GROUP BY label, chain HAVING count(*)>=8)
 SELECT w.label, long.chain, w.idx::BIGINT idx, cs."row", cs.col FROM w JOIN long ON long.label=w.label AND long.old=w.chain JOIN cs ON cs.label=w.label AND cs.id=w.cur"""
SQL = {"q_published": _PUBLISHED, "q_chain": _CHAIN, "q_route": _ROUTE, "q_nms": _THIN, "q_simplify": _SIMPLE, "q_match": f'WITH RECURSIVE {line_queries.MATCHED} SELECT "first", "second", first_line, second_line, round(pre_score,6) pre_score FROM matched', "q_terrace_slope": f'WITH {_TERRACE}, {raster_queries.SLOPE} SELECT "row", col, z, slope, coalesce(slope, 90.0) < 10 platform FROM slopes'}
Q = OWN


def queries():
    return raster_queries.Q | line_queries.Q | job_queries.Q | OWN


def oracle_sql():
    return raster_queries.SQL | line_queries.SQL | job_queries.SQL | SQL


def flagship(spark, d):
    """Lineitem's cloud as cells with slope and platform flag."""
    s = raster_queries.slopes(spark, d)
    return s.select("row", "col", "z", "slope", (F.col("slope") < 10).alias("platform"))

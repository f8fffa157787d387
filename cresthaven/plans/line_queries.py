"""Queries on lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lines as L
from ..operators import polyline as P
from ..operators import spatial as S
from ..operators.components import cut
from ..operators.relief import relief
from ..sources.frames import event_vertices
from .config import Config
from .raster_queries import BASE, RES, SLOPE, cells, disk_sql, slopes

Q: dict = {}
SQL: dict[str, str] = {}
LINK = Config(link_gap_m=30.0)
ORIGIN = Config().enu_origin

V = """v AS (SELECT user_id line_id, CASE WHEN user_id%2=0 THEN 'crest' ELSE 'toe' END AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 idx, (event_id%997)*0.5::DOUBLE x, value y FROM events)"""
SEG = """sg AS (SELECT *, CAST(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS DECIMAL(18,6)) seg FROM (SELECT line_id, type, idx, x x0, y y0, lead(x) OVER w x1, lead(y) OVER w y1 FROM v WINDOW w AS (PARTITION BY line_id ORDER BY idx)) WHERE x1 IS NOT NULL),
seg AS (SELECT *, (c1-seg)::DOUBLE a, c1::DOUBLE b FROM (SELECT *, sum(seg) OVER (PARTITION BY line_id ORDER BY idx) c1 FROM sg)),
len AS (SELECT line_id, any_value(type) AS type, count(*)+1 n, sum(seg)::DOUBLE AS length FROM seg GROUP BY line_id),
cum AS (SELECT v.line_id, v.type, v.idx, v.x, v.y, coalesce(s.b, 0) cum FROM v LEFT JOIN seg s ON s.line_id=v.line_id AND s.idx=v.idx-1)"""


def resample_sql(name: str, step: float, end: str) -> str:
    last = f"CASE WHEN b=total THEN floor(b/{step}) ELSE ceil(b/{step})-1 END" if end == "reached" else f"ceil(b/{step})-1"
    tail = f" UNION ALL SELECT v.line_id, v.type, CAST(ceil(length/{step}) AS BIGINT), x, y FROM v JOIN len USING (line_id) WHERE idx=n-1 AND length>0" if end == "always" else ""
    return f"""{name} AS (SELECT line_id, type, k, x0+((k*{step}::DOUBLE-a)/seg::DOUBLE)*(x1-x0) x, y0+((k*{step}::DOUBLE-a)/seg::DOUBLE)*(y1-y0) y FROM
 (SELECT *, unnest(range(CAST(ceil(a/{step}) AS BIGINT), CAST({last} AS BIGINT)+1)) k FROM (SELECT *, max(b) OVER (PARTITION BY line_id) total FROM seg) WHERE seg>0){tail}
 UNION ALL SELECT v.line_id, v.type, 0, x, y FROM v WHERE idx=0 AND line_id NOT IN (SELECT line_id FROM len WHERE length>0))"""


TANGENT = """pick AS (SELECT c.line_id, c.type, l.n, l.length, min(idx) FILTER (idx>0 AND cum>=least(15.0,greatest(l.length*0.4,0.1))) i, min(idx) FILTER (idx>0 AND cum>=greatest(l.length-least(15.0,greatest(l.length*0.4,0.1)),0.0)) j FROM cum c JOIN len l USING (line_id) GROUP BY ALL),
both_ends AS (SELECT line_id, type, 's' which, 0 p, coalesce(i,n-1) q FROM pick UNION ALL SELECT line_id, type, 'e', n-1, greatest(coalesce(j,n)-2,0) FROM pick),
tang AS (SELECT * FROM (SELECT e.line_id, e.type, which, a.x, a.y, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) nn, a.x-b.x dx, a.y-b.y dy FROM both_ends e JOIN v a ON a.line_id=e.line_id AND a.idx=e.p JOIN v b ON b.line_id=e.line_id AND b.idx=e.q) WHERE nn>=1e-6),
ends AS (SELECT line_id*2+CASE WHEN which='e' THEN 1 ELSE 0 END end_id, line_id, type, x, y, dx/nn tx, dy/nn ty, y/100.0::DOUBLE z FROM tang)"""
PAIRS = """prs AS (SELECT type, a.end_id AS "first", b.end_id AS "second", a.line_id first_line, b.line_id second_line, d gap, abs(a.z-b.z) dz, a.tx*ux+a.ty*uy cos_first, -(b.tx*ux+b.ty*uy) cos_second, abs(ux*a.ty-uy*a.tx)*d lf, abs(ux*b.ty-uy*b.tx)*d ls FROM
 (SELECT a, b, a.type AS type, d, (b.x-a.x)/d ux, (b.y-a.y)/d uy FROM (SELECT a, b, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) d FROM ends a JOIN ends b ON a.type=b.type AND a.end_id<b.end_id AND a.line_id<>b.line_id) WHERE d>=0.5))"""
ENH = """enh AS (SELECT *, gap/100.0+0.35*(1-cs)+0.35*lat/18.0+0.35*dz/9.0-CASE WHEN regular THEN 0.2 ELSE 0 END-CASE WHEN short THEN 0.1 ELSE 0 END pre_score FROM (SELECT *, gap<=30 AND dz<=5 AND cs>=0.35 AND lat<=15 regular, gap<=25 AND dz<=3 AND lat<=18 short, gap<=100 AND dz<=9 AND cs>=0.1 AND lat<=18 inferred FROM
 (SELECT *, greatest(lf,ls) lat, least(cos_first,cos_second) cs FROM prs WHERE gap<=100)) WHERE regular OR short OR inferred)"""
LINES = f"{V}, {SEG}"
# down the sorted list, each line once
MATCHED = f"""{LINES}, {TANGENT}, {PAIRS}, {ENH}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY pre_score, first_line, second_line, "first", "second") r FROM enh),
 walk AS (SELECT 0::BIGINT r, []::BIGINT[] used, false took UNION ALL SELECT n, CASE WHEN ok THEN list_concat(used, [a, b]) ELSE used END, ok FROM (SELECT ranked.r n, used, first_line a, second_line b, NOT (list_contains(used, first_line) OR list_contains(used, second_line)) ok FROM walk JOIN ranked ON ranked.r=walk.r+1)),
 matched AS (SELECT ranked.* FROM ranked JOIN walk USING (r) WHERE took)"""


def vertices(spark, d):
    return event_vertices(spark, d)


def ends(spark, d):
    t = P.tangents(vertices(spark, d))
    return t.select((F.col("line_id") * 2 + F.when(F.col("which") == "e", 1).otherwise(0)).alias("end_id"), "line_id", "type", "x", "y", "tx", "ty", (F.col("y") / 100).alias("z"))


def rounded(df, digits=6, *keep):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def register(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@register("q_line_length", f"WITH {LINES} SELECT line_id, type, n, length FROM len UNION ALL SELECT line_id, type, 1, 0.0 FROM v WHERE idx=0 AND line_id NOT IN (SELECT line_id FROM len)")
def q_line_length(spark, d):
    return P.lengths(vertices(spark, d))


@register("q_cumlen", f"WITH {LINES} SELECT line_id, idx, cum::DOUBLE cum FROM cum")
def q_cumlen(spark, d):
    return P.cumulative(vertices(spark, d))


for _name, _step, _end in (("q_resample_end", 25.0, "always"), ("q_resample", 25.0, "reached"), ("q_resample_val", 20.0, "never")):
    register(_name, f"WITH {LINES}, {resample_sql('s', _step, _end)} SELECT line_id, type, k, round(x,6) x, round(y,6) y FROM s")(lambda spark, d, step=_step, end=_end: rounded(P.resample(vertices(spark, d), step, end)))


def _fold_sql(far: str, always_last: bool) -> str:
    last = "idx=n-1" if always_last else "idx=n-1 AND (kx<>x OR ky<>y)"
    return f"""WITH RECURSIVE {V}, nn AS (SELECT line_id, count(*) n FROM v GROUP BY 1), f AS (SELECT line_id, 0 idx, x kx, y ky, true keep FROM v WHERE idx=0 UNION ALL
 SELECT f.line_id, v.idx, CASE WHEN far THEN v.x ELSE kx END, CASE WHEN far THEN v.y ELSE ky END, far FROM f JOIN (SELECT * FROM v) v ON v.line_id=f.line_id AND v.idx=f.idx+1, LATERAL (SELECT sqrt((v.x-f.kx)*(v.x-f.kx)+(v.y-f.ky)*(v.y-f.ky)) {far} far))
 SELECT f.line_id, v.x, v.y, row_number() OVER (PARTITION BY f.line_id ORDER BY f.idx)-1 idx FROM f JOIN v USING (line_id, idx) JOIN nn USING (line_id) WHERE keep OR ({last})"""


@register("q_dedup_basic", _fold_sql("> 150.0", False))
def q_dedup_basic(spark, d):
    p = P.packed(vertices(spark, d))
    return P.unpacked(p.withColumn("pts", P.deduplicate(F.col("pts"), 150.0, False))).select("line_id", "idx", "x", "y")


@register("q_dedup_bridge", _fold_sql(">= 120.0", False))
def q_dedup_bridge(spark, d):
    p = P.packed(vertices(spark, d))
    return P.unpacked(p.withColumn("pts", P.deduplicate(F.col("pts"), 120.0, True))).select("line_id", "idx", "x", "y")


_SM = "sm AS (SELECT line_id, idx, (coalesce(lag(y) OVER w, y)+y+coalesce(lead(y) OVER w, y))/3.0::DOUBLE smooth FROM v WINDOW w AS (PARTITION BY line_id ORDER BY idx))"
_LM = "lm AS (SELECT line_id, idx, smooth FROM (SELECT *, lag(smooth) OVER w p, lead(smooth) OVER w n FROM sm WINDOW w AS (PARTITION BY line_id ORDER BY idx)) WHERE smooth<=80 AND (p IS NULL OR n IS NULL OR (smooth<=p+1e-6 AND smooth<=n+1e-6)))"


def smoothed(spark, d):
    return P.smooth3(vertices(spark, d), "y", ["line_id"], "idx").select("line_id", "idx", "smooth")


@register("q_smooth3", f"WITH {V}, {_SM} SELECT line_id, idx, round(smooth,6) smooth FROM sm")
def q_smooth3(spark, d):
    return rounded(smoothed(spark, d))


@register("q_local_min", f"WITH {V}, {_SM}, {_LM} SELECT line_id, idx, round(smooth,6) smooth FROM lm")
def q_local_min(spark, d):
    return rounded(P.local_minima(smoothed(spark, d), "smooth", ["line_id"], "idx", 80.0))


@register(
    "q_minsep",
    f"""WITH RECURSIVE {V}, {_SM}, {_LM}, rk AS (SELECT line_id, idx, row_number() OVER (PARTITION BY line_id ORDER BY smooth, idx) r FROM lm),
 g AS (SELECT line_id, 1 r, [idx] kept FROM rk WHERE r=1 UNION ALL SELECT g.line_id, g.r+1, CASE WHEN len(kept)<8 AND len(list_filter(kept, lambda k: abs(k-rk.idx)<4))=0 THEN list_append(kept, rk.idx) ELSE kept END FROM g JOIN rk ON rk.line_id=g.line_id AND rk.r=g.r+1)
 SELECT line_id, unnest(kept) idx FROM (SELECT line_id, arg_max(kept, r) kept FROM g GROUP BY line_id)""",
)
def q_minsep(spark, d):
    m = P.local_minima(smoothed(spark, d), "smooth", ["line_id"], "idx", 80.0)
    return P.separated(m, "smooth", ["line_id"], "idx", 4)


@register("q_tangent", f"WITH {LINES}, {TANGENT} SELECT line_id, type, which, x, y, round(dx/nn,6) tx, round(dy/nn,6) ty FROM tang")
def q_tangent(spark, d):
    return rounded(P.tangents(vertices(spark, d)), 6)


@register(
    "q_sample_tangent",
    f"""WITH {LINES}, {resample_sql('s', 200.0, 'never')}, nr AS (SELECT s.line_id, s.type, s.k, s.x, s.y, arg_min(v.idx, ((v.x-s.x)*(v.x-s.x)+(v.y-s.y)*(v.y-s.y), v.idx)) j FROM s JOIN v ON v.line_id=s.line_id GROUP BY ALL),
 t AS (SELECT nr.*, b.x-a.x dx, b.y-a.y dy FROM nr JOIN len USING (line_id) JOIN v a ON a.line_id=nr.line_id AND a.idx=greatest(j-2,0) JOIN v b ON b.line_id=nr.line_id AND b.idx=least(j+2,n-1))
 SELECT line_id, type, k, round(x,6) x, round(y,6) y, round(dx/sqrt(dx*dx+dy*dy),6) tx, round(dy/sqrt(dx*dx+dy*dy),6) ty FROM t WHERE sqrt(dx*dx+dy*dy)>=1e-6""",
)
def q_sample_tangent(spark, d):
    v = vertices(spark, d)
    return rounded(P.sample_tangents(P.resample(v, 200.0, "never"), v))


@register("q_rasterize", f'WITH {LINES}, {resample_sql("s", 5.0, "always")} SELECT DISTINCT type, greatest(0,least(49,CAST(trunc((500.0-y)/10.0) AS INT))) AS "row", greatest(0,least(49,CAST(trunc((x-0.0)/10.0) AS INT))) col FROM s')
def q_rasterize(spark, d):
    return P.rasterise(vertices(spark, d), 5.0, 0.0, 500.0, 10.0, 50, 50)


_NEAR = """pt AS (SELECT q.query_id, s.line_id, s.idx, q.qx, q.qy, s.x0, s.y0, s.x1-s.x0 dx, s.y1-s.y0 dy FROM {q} q JOIN seg s USING (type)),
pj AS (SELECT *, CASE WHEN dx*dx+dy*dy>1e-12 THEN greatest(0,least(1,((qx-x0)*dx+(qy-y0)*dy)/(dx*dx+dy*dy))) ELSE 0 END t FROM pt),
pd AS (SELECT *, x0+t*dx px, y0+t*dy py, sqrt((qx-(x0+t*dx))*(qx-(x0+t*dx))+(qy-(y0+t*dy))*(qy-(y0+t*dy))) d FROM pj),
nst AS (SELECT query_id, line_id, min(d) distance, arg_min(px,(d,idx)) x, arg_min(py,(d,idx)) y FROM pd GROUP BY 1,2)"""


@register("q_closest_point", f"WITH {LINES}, q AS (SELECT line_id query_id, type, x+3 qx, y-2 qy FROM v WHERE idx=0), {_NEAR.format(q='q')} SELECT query_id, line_id, round(distance,6) distance, round(x,6) x, round(y,6) y FROM nst")
def q_closest_point(spark, d):
    v = vertices(spark, d)
    q = v.where("idx = 0").select(F.col("line_id").alias("query_id"), "type", (F.col("x") + 3).alias("qx"), (F.col("y") - 2).alias("qy"))
    return P.nearest_lines(q, v, 6)


@register("q_endpoint_pairs", f'WITH {LINES}, {TANGENT}, {PAIRS} SELECT type, "first", "second", round(gap,6) gap, round(dz,6) dz, round(cos_first,6) cos_first, round(cos_second,6) cos_second, round(lf,6) lateral_first FROM prs WHERE gap<=30 AND dz<=5 AND cos_first>=0.35 AND cos_second>=0.35 AND lf<=15')
def q_endpoint_pairs(spark, d):
    return rounded(S.link_pairs(ends(spark, d), 30.0).select("type", "first", "second", "gap", "dz", "cos_first", "cos_second", "lateral_first"))


def enhanced(spark, d, columns=None):
    return S.link_pairs_enhanced(ends(spark, d), LINK, columns)


@register("q_endpoint_pairs_enh", f'WITH {LINES}, {TANGENT}, {PAIRS}, {ENH} SELECT "first", "second", regular, short, inferred, round(pre_score,6) pre_score FROM enh')
def q_endpoint_pairs_enh(spark, d):
    return rounded(enhanced(spark, d, ["first", "second", "regular", "short", "inferred", "pre_score"]))


@register(
    "q_topk_endpoint",
    f"""WITH {LINES}, {TANGENT}, {PAIRS}, {ENH}, e AS (SELECT "first" en, "first" f, "second" s, round(pre_score,9) p FROM enh UNION ALL SELECT "second", "first", "second", round(pre_score,9) FROM enh),
 k AS (SELECT DISTINCT f, s FROM (SELECT *, row_number() OVER (PARTITION BY en ORDER BY p, f, s) n FROM e) WHERE n<=2) SELECT f AS "first", s AS "second" FROM k""",
)
def q_topk_endpoint(spark, d):
    return S.top_links(ends(spark, d), LINK, 2)


_PROX = f"{resample_sql('s', 50.0, 'reached')}, near_ AS (SELECT a.type, a.line_id fl, a.k, b.line_id sl, b.k k2, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) d FROM s a JOIN s b ON a.type=b.type AND a.line_id<>b.line_id AND b.x BETWEEN a.x-5 AND a.x+5 AND b.y BETWEEN a.y-5 AND a.y+5)"


@register("q_proximity", f'WITH {LINES}, {_PROX} SELECT DISTINCT fl AS "first", sl AS "second" FROM near_ WHERE d<=5 AND fl<sl')
def q_proximity(spark, d):
    return S.proximity(P.resample(vertices(spark, d), 50.0, "reached"), 5.0)


@register("q_knn1", f'WITH {LINES}, {_PROX} SELECT fl AS "first", k, sl AS "second", arg_min(k2,(d,k2)) k2, round(min(d),6) d FROM near_ WHERE d<=5 GROUP BY fl, k, sl')
def q_knn1(spark, d):
    return S.nearest_samples(P.resample(vertices(spark, d), 50.0, "reached"), 5.0, digits=6).drop("type")


def guides(spark, d):
    v = vertices(spark, d)
    g = v.groupBy("line_id", "type").agg(F.min_by(F.struct("x", "y"), "idx").alias("s"), F.max_by(F.struct("x", "y"), "idx").alias("e"))
    return g.select(F.col("line_id").alias("guide_id"), "type", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("e.x").alias("ex"), F.col("e.y").alias("ey"))


@register(
    "q_guided",
    f"""WITH {LINES}, ht AS (SELECT line_id, median(y)/100.0 z FROM v GROUP BY 1), gd AS (SELECT line_id guide_id, any_value(type) AS type, arg_min(x,idx) sx, arg_min(y,idx) sy, arg_max(x,idx) ex, arg_max(y,idx) ey FROM v GROUP BY 1),
 qs AS (SELECT guide_id*2 query_id, type, sx qx, sy qy FROM gd UNION ALL SELECT guide_id*2+1, type, ex, ey FROM gd), {_NEAR.format(q='qs')}, an AS (SELECT query_id//2 guide_id, query_id%2 side, nst.*, z FROM nst JOIN ht USING (line_id) WHERE distance<=50),
 pr AS (SELECT a.guide_id, a.line_id al, b.line_id bl, a.distance ad, b.distance bd, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) gap, abs(a.z-b.z) dz FROM an a JOIN an b ON a.guide_id=b.guide_id AND a.side=0 AND b.side=1 AND a.line_id<>b.line_id)
 SELECT guide_id, arg_min(al,(round(ad+bd+0.03*gap,9),al,bl)) start_line, arg_min(bl,(round(ad+bd+0.03*gap,9),al,bl)) end_line, round(min(ad+bd+0.03*gap),6) score FROM pr WHERE gap BETWEEN 1 AND 100 AND dz<=5 GROUP BY 1""",
)
def q_guided(spark, d):
    v = vertices(spark, d)
    heights = v.groupBy("line_id").agg((F.median("y") / 100).alias("z"))
    return rounded(S.anchors(guides(spark, d), v, heights, 50.0, 100.0, 5.0).select("guide_id", "start_line", "end_line", "score"))


_CAND = f"{_PROX}, nn AS (SELECT type, fl, sl, k, arg_min(k2,(d,k2)) k2, min(d) d FROM near_ WHERE d<=5 GROUP BY ALL), cd AS (SELECT nn.type, fl, sl, nn.k, nn.k2, d, (a.x+b.x)*0.5 mx, (a.y+b.y)*0.5 my FROM nn JOIN s a ON a.line_id=fl AND a.k=nn.k JOIN s b ON b.line_id=sl AND b.k=nn.k2), kd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(fl,sl), greatest(fl,sl), round_even(mx/10.0,0), round_even(my/10.0,0), round_even(d/10.0,0) ORDER BY fl, k) r FROM cd) WHERE r=1)"


def middles(near, s, on=()):
    """Nearest samples with the middle between both, as candidates."""
    a = s.select(*on, F.col("line_id").alias("first"), "k", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = s.select(*on, F.col("line_id").alias("second"), F.col("k").alias("k2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return near.join(a, [*on, "first", "k"]).join(b, [*on, "second", "k2"]).withColumns({"mx": (F.col("ax") + F.col("bx")) * 0.5, "my": (F.col("ay") + F.col("by")) * 0.5})


def place():
    """What candidates are told apart by."""
    return {"low": F.least("first", "second"), "high": F.greatest("first", "second"), "px": F.bround(F.col("mx") / 10), "py": F.bround(F.col("my") / 10), "pd": F.bround(F.col("d") / 10)}


def candidates(spark, d):
    s = P.resample(vertices(spark, d), 50.0, "reached")
    return S.first_per_key(middles(S.nearest_samples(s, 5.0), s), [*place().values()], ["first", "k"])


def best_candidates(spark, d, sure, order, most=2000):
    """The first ``most`` of candidates() in an order in which those with d above r come after all that ``sure(r)`` holds for.

    Within growing distances: nearest samples there are the nearest of all, and whether one is the first of its key is
    seen on the samples around it of its two lines alone.  Ends when enough are found or the whole distance is searched.
    """
    s = cut(P.resample(vertices(spark, d), 50.0, "reached"))
    reach = 27500.0 / max(s.count(), 1)
    while True:
        reach = min(5.0, reach)
        found = middles(S.nearest_samples(s, reach, max(reach * 8, 0.25)), s).withColumns(place())
        found = cut(found if reach >= 5.0 else found.where(sure(reach)))
        keys = ["low", "high", "px", "py", "pd"]
        key = found.select(*keys, F.concat_ws(" ", *keys).alias("key")).distinct()
        around = s.join(key.select("key", "px", "py", F.explode(F.array("low", "high")).alias("line_id")), "line_id")
        around = cut(around.where((F.abs(F.col("x") - F.col("px") * 10) <= 12.6) & (F.abs(F.col("y") - F.col("py") * 10) <= 12.6)).select("line_id", F.col("key").alias("type"), "k", "x", "y"))
        there = middles(S.nearest_samples(around, 5.0), around, ["type"]).withColumns(place()).where(F.concat_ws(" ", *keys) == F.col("type"))
        first = there.groupBy("type").agg(F.min(F.struct("first", "k")).alias("m")).select(F.col("type").alias("key"), "m.first", "m.k")
        kept = cut(found.withColumn("key", F.concat_ws(" ", *keys)).join(first, ["key", "first", "k"], "left_semi").drop("key", *keys))
        if reach >= 5.0 or kept.count() >= most:
            return kept.orderBy(*order).limit(most)
        reach *= 3


@register("q_key_dedup", f'WITH {LINES}, {_CAND} SELECT fl AS "first", sl AS "second", k, k2 FROM kd')
def q_key_dedup(spark, d):
    return S.first_nearest(P.resample(vertices(spark, d), 50.0, "reached"), 5.0)


@register("q_topk_quick", f'WITH {LINES}, {_CAND} SELECT fl AS "first", sl AS "second", k, round(round(d+3.0*abs(mx-my)/100.0,9),6) quick_score FROM kd ORDER BY round(d+3.0*abs(mx-my)/100.0,9), fl, sl, k LIMIT 2000')
def q_topk_quick(spark, d):
    score = F.round(F.col("d") + 3.0 * F.abs(F.col("mx") - F.col("my")) / 100.0, 9)
    c = best_candidates(spark, d, lambda r: score < r - 1e-8, [score, "first", "second", "k"])
    return c.select("first", "second", "k", F.round(score, 6).alias("quick_score"))


_ON = 'greatest(0,least(123,CAST(trunc((122.0-y)) AS INT))) "row", greatest(0,least(183,CAST(trunc((x+2.0)) AS INT))) col'


def on_grid(samples):
    """Line samples on the lineitem cells."""
    return P.to_cells(samples, -2.0, 122.0, RES, 184, 124)


@register(
    "q_edge_support",
    f"""WITH {BASE}, {SLOPE}, {LINES}, {resample_sql('s', 25.0, 'always')}, steep AS (SELECT "row", col FROM slopes WHERE slope>=30), near4 AS (SELECT s."row"-o.dr "row", s.col-o.dc col, min(o.dr*o.dr+o.dc*o.dc) d2 FROM steep s, {disk_sql(4)} o GROUP BY 1,2),
 g AS (SELECT line_id, {_ON} FROM s) SELECT line_id, round(avg(CASE WHEN d2<=4 THEN 1.0 ELSE 0.0 END),6) support, round(median(coalesce(sqrt(d2::DOUBLE), 8.0)),6) median FROM g LEFT JOIN near4 USING ("row", col) GROUP BY 1""",
)
def q_edge_support(spark, d):
    from ..operators import raster

    steep = slopes(spark, d).where("slope >= 30").withColumn("z", F.lit(1.0)).select("row", "col", "z")
    near = raster.fill(steep, 4.0).select("row", "col", "d2")
    g = on_grid(P.resample(vertices(spark, d), 25.0, "always")).join(near, ["row", "col"], "left")
    return rounded(g.groupBy("line_id").agg(F.avg(F.when(F.col("d2") <= 4, 1.0).otherwise(0.0)).alias("support"), F.median(F.coalesce(F.sqrt("d2"), F.lit(8.0))).alias("median")))


@register(
    "q_relief",
    f"""WITH {BASE}, {LINES}, {resample_sql('s', 200.0, 'never')}, nr AS (SELECT s.line_id, s.type, s.k, s.x, s.y, arg_min(v.idx, ((v.x-s.x)*(v.x-s.x)+(v.y-s.y)*(v.y-s.y), v.idx)) j FROM s JOIN v ON v.line_id=s.line_id GROUP BY ALL),
 t AS (SELECT nr.*, b.x-a.x dx, b.y-a.y dy FROM nr JOIN len USING (line_id) JOIN v a ON a.line_id=nr.line_id AND a.idx=greatest(j-2,0) JOIN v b ON b.line_id=nr.line_id AND b.idx=least(j+2,n-1)),
 u AS (SELECT line_id, type, k, x, y, dx/sqrt(dx*dx+dy*dy) tx, dy/sqrt(dx*dx+dy*dy) ty FROM t WHERE sqrt(dx*dx+dy*dy)>=1e-6),
 pr AS (SELECT line_id, type, k, o, x-ty*o x, y+tx*o y FROM u, (VALUES (0),(2),(3),(4),(5),(6),(7),(8),(-2),(-3),(-4),(-5),(-6),(-7),(-8)) q(o)),
 pz AS (SELECT p.line_id, p.type, p.k, p.o, c.z FROM (SELECT line_id, type, k, o, {_ON} FROM pr) p JOIN cells c USING ("row", col)),
 sm AS (SELECT line_id, type, k, max(z) FILTER (o=0) z0, min(z) FILTER (o<>0) low, max(z) FILTER (o<>0) high, count(*) FILTER (o>0) l, count(*) FILTER (o<0) r FROM pz GROUP BY ALL)
 SELECT line_id, round(median(CASE WHEN type='crest' THEN z0-low ELSE high-z0 END),6) relief FROM sm WHERE z0 IS NOT NULL AND l>0 AND r>0 GROUP BY 1""",
)
def q_relief(spark, d):
    v = vertices(spark, d)
    return rounded(relief(P.sample_tangents(P.resample(v, 200.0, "never"), v), cells(spark, d), on_grid))


_ED = "((\"first\"*37+\"second\"*11)%101)/100.0::DOUBLE"


def moded(spark, d, *more):
    """Enhanced candidates with a mode: what it takes to tell it, and ``more`` columns."""
    e = enhanced(spark, d, ["first", "second", "regular", "short", "inferred", *more]).withColumn("edge_fraction", ((F.col("first") * 37 + F.col("second") * 11) % 101) / 100.0)
    return e.withColumn("mode", L.link_mode(F.col("edge_fraction"), 0.7, F.col("regular"), F.col("short"), F.col("inferred"))).where("mode is not null")


_MODE = f"md AS (SELECT *, CASE WHEN regular AND ef>=0.7 THEN 'regular_edge' WHEN short AND ef>=0.7 THEN 'edge_supported_short' WHEN inferred AND ef>=0.7 THEN 'edge_supported_long' WHEN regular THEN 'regular_low_evidence' WHEN inferred THEN 'geometry_inferred' END AS mode FROM (SELECT *, {_ED} ef FROM enh))"


@register("q_link_mode", f"""WITH {LINES}, {TANGENT}, {PAIRS}, {ENH}, {_MODE} SELECT "first", "second", mode, CASE mode WHEN 'regular_edge' THEN 0 WHEN 'edge_supported_short' THEN 1 WHEN 'edge_supported_long' THEN 2 WHEN 'regular_low_evidence' THEN 3 ELSE 4 END AS "rank" FROM md WHERE mode IS NOT NULL""")
def q_link_mode(spark, d):
    return moded(spark, d).select("first", "second", "mode", L.mode_rank(F.col("mode")).alias("rank"))


@register(
    "q_confidence",
    f"""WITH {LINES}, {TANGENT}, {PAIRS}, {ENH}, {_MODE} SELECT "first", "second", round(greatest(0.2,least(0.99,CASE mode WHEN 'regular_edge' THEN 0.95 WHEN 'edge_supported_short' THEN 0.88 WHEN 'edge_supported_long' THEN 0.82 WHEN 'regular_low_evidence' THEN 0.68 ELSE 0.45 END::DOUBLE+0.10*ef-0.12*least(1.0,gap/100.0))),6)::DOUBLE confidence,
 round(0.55*ef+0.35*least(gap/100.0,1.0)+0.10*(1-least(greatest(1+dz/10.0-1,0)/0.7,1.0)),6)::DOUBLE score FROM md WHERE mode IS NOT NULL""",
)
def q_confidence(spark, d):
    m = moded(spark, d, "gap", "dz")
    return rounded(m.select("first", "second", L.link_confidence(F.col("mode"), F.col("edge_fraction"), F.col("gap"), 100.0).alias("confidence"), L.bridge_score(F.col("edge_fraction"), F.least(F.col("gap") / 100, F.lit(1.0)), 1 + F.col("dz") / 10).alias("score")))


E2 = "0.0066943799901413165"


def _geo_sql(x: str, y: str) -> str:
    import math

    o = ORIGIN
    lat, lon, h = math.radians(o["lat"]), math.radians(o["lon"]), o["h"]
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    n0 = 6378137.0 / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    steps = "".join(f", l{k + 1} AS (SELECT *, atan2(gz, gp*(1-{e2!r}*nn/(nn+gp/cos(lt)-nn))) lt2 FROM (SELECT *, 6378137.0/sqrt(1-{e2!r}*sin(lt)*sin(lt)) nn FROM (SELECT * EXCLUDE (lt{', lt2, nn' if k else ''}), {'lt2' if k else 'lt'} lt FROM l{k})))" for k in range(8))
    return f""", xyz AS (SELECT *, {(n0 + h) * math.cos(lat) * math.cos(lon)!r}-{x}*{math.sin(lon)!r}-{y}*{math.sin(lat) * math.cos(lon)!r} gx, {(n0 + h) * math.cos(lat) * math.sin(lon)!r}+{x}*{math.cos(lon)!r}-{y}*{math.sin(lat) * math.sin(lon)!r} gy, {(n0 * (1 - e2) + h) * math.sin(lat)!r}+{y}*{math.cos(lat)!r} gz FROM v),
 l0 AS (SELECT *, sqrt(gx*gx+gy*gy) gp, atan2(gz, sqrt(gx*gx+gy*gy)*(1-{e2!r})) lt FROM xyz){steps}"""


@register("q_wgs84", f"WITH {V}{_geo_sql('x', 'y')} SELECT line_id, idx, round(degrees(atan2(gy,gx)),7) lon, round(degrees(lt2),7) lat FROM l8")
def q_wgs84(spark, d):
    lon, lat = L.geodetic(F.col("x"), F.col("y"), ORIGIN)
    return vertices(spark, d).select("line_id", "idx", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_ATTR = """ln AS (SELECT l.line_id, l.type, l.length, z, CASE l.line_id%6 WHEN 0 THEN NULL WHEN 1 THEN 'geometry_inferred' WHEN 2 THEN 'edge_supported_long' WHEN 3 THEN 'manual_guided' WHEN 4 THEN 'auto_edge_path' ELSE 'regular_edge' END link_mode,
 CASE l.line_id%6 WHEN 3 THEN 'manual_constraint' WHEN 4 THEN 'auto_gap_bridge' WHEN 2 THEN 'edge_seed_linked' WHEN 1 THEN 'multiscale_seed' END AS source FROM len l JOIN (SELECT line_id, median(y)/100.0 z FROM v GROUP BY 1) USING (line_id))"""


def attributed(spark, d):
    v = vertices(spark, d)
    m = F.col("line_id") % 6
    mode = F.when(m == 1, "geometry_inferred").when(m == 2, "edge_supported_long").when(m == 3, "manual_guided").when(m == 4, "auto_edge_path").when(m == 5, "regular_edge")
    source = F.when(m == 3, "manual_constraint").when(m == 4, "auto_gap_bridge").when(m == 2, "edge_seed_linked").when(m == 1, "multiscale_seed")
    z = v.groupBy("line_id").agg((F.median("y") / 100).alias("z"))
    return P.lengths(v).join(z, "line_id").withColumns({"link_mode": mode, "source": source, "confidence": F.lit(None).cast("double")})


@register("q_geojson", f"""WITH {LINES}, {_ATTR}, co AS (SELECT line_id, list(round(x,3) ORDER BY idx) xs, list(round(y,3) ORDER BY idx) ys FROM v GROUP BY 1) SELECT line_id, ln.type AS line, round(length,2) length_m, coalesce(link_mode,'observed') link_mode,
 CASE WHEN link_mode IS NULL THEN 'observed' WHEN link_mode='geometry_inferred' THEN 'inferred' WHEN link_mode='manual_guided' THEN 'manual_constraint' WHEN link_mode='auto_edge_path' THEN 'auto_gap' ELSE 'linked' END connection_mode, len(xs) n_points, round(xs[len(xs)],3) last_x, round(ys[len(ys)],3) last_y FROM ln JOIN co USING (line_id)""")
def q_geojson(spark, d):
    lines = attributed(spark, d).join(P.packed(vertices(spark, d)).select("line_id", "pts"), "line_id")
    f = L.features(lines)
    g = F.from_json("feature", "type string, properties struct<line:string,length_m:double,link_mode:string,connection_mode:string>, geometry struct<type:string,coordinates:array<array<double>>>")
    f = f.select("line_id", g.alias("f"))
    at = lambda k: F.element_at(F.element_at("f.geometry.coordinates", -1), k)
    return f.select("line_id", "f.properties.*", F.size("f.geometry.coordinates").cast("bigint").alias("n_points"), at(1).alias("last_x"), at(2).alias("last_y"))


@register("q_line_counts", f"""WITH {LINES}, {_ATTR} SELECT count(*) FILTER (type='crest') crest, count(*) FILTER (type='toe') toe, count(*) FILTER (link_mode='geometry_inferred') inferred, count(*) FILTER (link_mode LIKE 'edge\\_supported%' ESCAPE '\\') edge_supported, count(*) FILTER (starts_with(source,'edge_seed')) edge_seed,
 count(*) FILTER (starts_with(source,'multiscale')) multiscale_seed, count(*) FILTER (source='manual_constraint') manual_constraint, count(*) FILTER (source='auto_gap_bridge') auto_gap, round(sum(length),2) total_length_m FROM ln""")
def q_line_counts(spark, d):
    return L.counts(attributed(spark, d))


@register("q_mode_split", f"""WITH {LINES}, {_ATTR} SELECT 'all' part, count(*) n, round(sum(length),2) length FROM ln UNION ALL SELECT 'without_auto_gap', count(*), round(sum(length),2) FROM ln WHERE coalesce(link_mode,'')<>'auto_edge_path' UNION ALL SELECT 'auto_gap', count(*), round(sum(length),2) FROM ln WHERE link_mode='auto_edge_path'""")
def q_mode_split(spark, d):
    a = attributed(spark, d)
    gap = F.coalesce(F.col("link_mode") == "auto_edge_path", F.lit(False))
    parts = F.explode(F.when(gap, F.array(F.lit("all"), F.lit("auto_gap"))).otherwise(F.array(F.lit("all"), F.lit("without_auto_gap"))))
    return a.select(parts.alias("part"), "length").groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("length"), 2).alias("length"))


# --- bookkeeping of linking ---------------------------------------------------
from ..operators import selection  # noqa: E402
from . import pipeline  # noqa: E402


def matched(spark, d):
    return selection.match_links(ends(spark, d), LINK)


@register("q_unlinked", f"WITH RECURSIVE {MATCHED} SELECT DISTINCT line_id FROM v WHERE line_id NOT IN (SELECT first_line FROM matched UNION ALL SELECT second_line FROM matched)")
def q_unlinked(spark, d):
    """Lines that no link uses up."""
    used = matched(spark, d).select(F.explode(F.array("first_line", "second_line")).alias("line_id"))
    return vertices(spark, d).select("line_id").distinct().join(used, "line_id", "left_anti")


_Z = "CASE WHEN {0}.line_id%7=0 THEN NULL ELSE {0}.z END"


@register(
    "q_merge",
    f"""WITH RECURSIVE {MATCHED}, {_ATTR}, {_MODE.replace('FROM enh', 'FROM matched')}, fl AS (SELECT line_id, count(*) n, arg_min(x,idx) x0, arg_min(y,idx) y0, arg_max(x,idx) x1, arg_max(y,idx) y1 FROM v GROUP BY 1),
 mg AS (SELECT m.*, a.link_mode ma, b.link_mode mb, coalesce(a.source,'platform_boundary') sa, coalesce(b.source,'platform_boundary') sb, {_Z.format('a')} za, {_Z.format('b')} zb, f.n+g.n n_points, CASE WHEN m."first"%2=0 THEN f.x1 ELSE f.x0 END first_x, CASE WHEN m."first"%2=0 THEN f.y1 ELSE f.y0 END first_y, CASE WHEN m."second"%2=1 THEN g.x0 ELSE g.x1 END last_x, CASE WHEN m."second"%2=1 THEN g.y0 ELSE g.y1 END last_y
  FROM md m JOIN ln a ON a.line_id=first_line JOIN ln b ON b.line_id=second_line JOIN fl f ON f.line_id=first_line JOIN fl g ON g.line_id=second_line WHERE mode IS NOT NULL)
 SELECT first_line, second_line, type, n_points, first_x, first_y, last_x, last_y, round(coalesce((za+zb)/2,za,zb),6) z,
 CASE WHEN sa='edge_seed' AND sb='edge_seed' THEN 'edge_seed' WHEN sa='edge_seed' OR sb='edge_seed' THEN 'edge_seed_linked' WHEN sa='multiscale_seed' AND sb='multiscale_seed' THEN 'multiscale_seed' WHEN sa='multiscale_seed' OR sb='multiscale_seed' THEN 'multiscale_linked' ELSE 'platform_boundary' END source,
 CASE WHEN 'geometry_inferred' IN (coalesce(ma,''),coalesce(mb,''),mode) THEN 'geometry_inferred' WHEN 'edge_supported_long' IN (coalesce(ma,''),coalesce(mb,''),mode) THEN 'edge_supported_long' WHEN 'edge_supported_short' IN (coalesce(ma,''),coalesce(mb,''),mode) THEN 'edge_supported_short' WHEN 'regular_edge' IN (coalesce(ma,''),coalesce(mb,''),mode) THEN 'regular_edge' ELSE mode END link_mode FROM mg""",
)
def q_merge(spark, d):
    """Matched pairs of attributed lines as the lines they make."""
    lines = attributed(spark, d).withColumn("z", F.when(F.col("line_id") % 7 != 0, F.col("z"))).join(P.packed(vertices(spark, d)).select("line_id", "pts"), "line_id")
    end = lambda c: F.when(F.col(c) % 2 == 1, "e").otherwise("s")
    ef = ((F.col("first") * 37 + F.col("second") * 11) % 101) / 100.0
    pairs = matched(spark, d).withColumns({"which0": end("first"), "which1": end("second"), "edge_fraction": ef, "path": F.array().cast(pipeline.POINTS), "confidence": F.lit(1.0)})
    pairs = pairs.withColumn("mode", L.link_mode(F.col("edge_fraction"), 0.7, F.col("regular"), F.col("short"), F.col("inferred"))).where("mode is not null")
    m = pipeline.merge(pairs, lines)
    ids = pairs.select("first_line", "second_line", F.xxhash64("first_line", "second_line", F.lit(0)).alias("line_id"))
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    return ids.join(m, "line_id").select("first_line", "second_line", "type", F.size("pts").cast("bigint").alias("n_points"), first.x.alias("first_x"), first.y.alias("first_y"), last.x.alias("last_x"), last.y.alias("last_y"), F.round("z", 6).alias("z"), "source", "link_mode")


@register("q_local_lines", f"WITH {V} SELECT DISTINCT line_id FROM v WHERE (x BETWEEN 115 AND 145 AND y BETWEEN 195 AND 245) OR (x BETWEEN 375 AND 425 AND y BETWEEN 135 AND 165)")
def q_local_lines(spark, d):
    """Lines with a vertex in one of two buffered rectangles."""
    return P.packed(vertices(spark, d)).where(L.in_regions(F.col("pts"), [(140.0, 240.0, 120.0, 200.0), (380.0, 140.0, 420.0, 160.0)], 5.0)).select("line_id")


@register("q_long_lines", f"WITH {LINES} SELECT line_id, n, length FROM len WHERE n >= 8 AND length >= 2500")
def q_long_lines(spark, d):
    """Lines of eight vertices and 2500 m or more."""
    return P.lengths(vertices(spark, d)).where("n >= 8 and length >= 2500").select("line_id", "n", "length")


@register("q_protected", f"WITH {LINES}, {_ATTR} SELECT line_id FROM ln WHERE NOT coalesce(source='edge_seed_linked' AND line_id%3 IN (0,2), false)")
def q_protected(spark, d):
    """Lines that linking may use: seeded ones of two regions are protected."""
    a = attributed(spark, d).withColumn("seed_region", (F.col("line_id") % 3).cast("int"))
    return a.where(~L.protected(F.col("source"), F.col("seed_region"), [0, 2])).select("line_id")


@register("q_line_height", f'WITH {BASE}, {LINES}, {resample_sql("s", 25.0, "always")}, g AS (SELECT line_id, {_ON} FROM s) SELECT line_id, round(median(z),6) z FROM g LEFT JOIN cells USING ("row", col) GROUP BY 1')
def q_line_height(spark, d):
    """The median height of the cells that a line's samples fall into; samples off the data do not count."""
    g = on_grid(P.resample(vertices(spark, d), 25.0, "always")).join(cells(spark, d).select("row", "col", "z"), ["row", "col"], "left")
    return rounded(g.groupBy("line_id").agg(F.median("z").alias("z")))


Q["q_relief_lines"] = lambda spark, d: q_relief(spark, d).where("relief >= 0.0252").select("line_id")
SQL["q_relief_lines"] = f"SELECT line_id FROM ({SQL['q_relief']}) WHERE relief >= 0.0252"


@register(
    "q_link_score",
    f"""WITH {LINES}, {TANGENT}, {PAIRS}, {ENH}, {_MODE} SELECT "first", "second", round(1+dz+0.015*gap+0.35*(1-cs)-0.45*ef+CASE WHEN mode='geometry_inferred' THEN 0.35 ELSE 0 END,6)::DOUBLE score, round(greatest(0.2,least(0.95,0.62+0.30*ef)),6)::DOUBLE confidence,
 CASE WHEN ef>=0.75 AND gap/100.0>=0.75 AND 1+dz/10<=1.5 THEN 'strong' WHEN ef>=0.7 AND gap/100.0>=0.65 AND 1+dz/10<=1.55 THEN 'weak' END evidence_class FROM md WHERE mode IS NOT NULL""",
)
def q_link_score(spark, d):
    """Scores of links and the evidence class that a bridge with such values would have."""
    m, ef = moded(spark, d, "gap", "dz", "cos"), F.col("edge_fraction")
    return m.select("first", "second", F.round(L.link_score(1 + F.col("dz"), F.col("gap"), F.col("cos"), ef, F.col("mode")), 6).alias("score"), F.round(L.multiscale_confidence(ef), 6).alias("confidence"), L.evidence_class(ef, F.col("gap") / 100, 1 + F.col("dz") / 10, LINK).alias("evidence_class"))


@register("q_longest_first", f"WITH {LINES} SELECT line_id, length, row_number() OVER (PARTITION BY type ORDER BY length DESC, line_id) AS \"rank\" FROM len")
def q_longest_first(spark, d):
    """Lines of each type by falling length, the order in which they are accepted."""
    w = Window.partitionBy("type").orderBy(F.desc("length"), "line_id")
    return P.lengths(vertices(spark, d)).where("n > 1").select("line_id", "length", F.row_number().over(w).alias("rank"))

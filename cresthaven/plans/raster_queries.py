"""Queries on clouds and cells, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import components, grid, raster
from ..sources.frames import lineitem_points

RES = 1.0
Q: dict = {}
SQL: dict[str, str] = {}

# --- the same frames in SQL -------------------------------------------------
_STEP = "least(greatest((x-{s})/8.0::DOUBLE,0.0),1.0)"
PTS = f"""raw AS (SELECT ((l_partkey*13+l_linenumber*7)%1800)/10.0::DOUBLE x, ((l_orderkey*37+l_suppkey*11)%1200)/10.0::DOUBLE y, l_quantity q,
 CAST(l_partkey%256 AS INT) red, CAST(l_suppkey%256 AS INT) green, CAST(l_orderkey%256 AS INT) blue FROM lineitem),
pts AS (SELECT x, y, ({_STEP.format(s=30.0)}+{_STEP.format(s=75.0)}+{_STEP.format(s=120.0)})*12.0::DOUBLE + q*0.001::DOUBLE z, red, green, blue FROM raw)"""
BND = """bnd AS (SELECT min(x)-2.0::DOUBLE xmin, max(y)+2.0::DOUBLE ymax, CAST(ceil(((max(x)+2.0::DOUBLE)-(min(x)-2.0::DOUBLE))/0.5::DOUBLE) AS INT) nx,
 CAST(ceil(((max(y)+2.0::DOUBLE)-(min(y)-2.0::DOUBLE))/0.5::DOUBLE) AS INT) ny FROM pts)"""
HALF = """half AS (SELECT "row", col, max(z) z, count(*) cnt, sum(red)::DOUBLE red, sum(green)::DOUBLE green, sum(blue)::DOUBLE blue, any_value(nx) nx, any_value(ny) ny FROM
 (SELECT CAST(floor((ymax-y)/0.5::DOUBLE) AS INT) "row", CAST(floor((x-xmin)/0.5::DOUBLE) AS INT) col, * FROM pts, bnd) WHERE "row">=0 AND "row"<ny AND col>=0 AND col<nx GROUP BY "row", col)"""
CELLS = """cells AS (SELECT "row"//2 "row", col//2 col, round(median(z),6) z, sum(cnt)::BIGINT cnt, sum(red)/sum(cnt) red, sum(green)/sum(cnt) green, sum(blue)/sum(cnt) blue, any_value(nx)//2 nx, any_value(ny)//2 ny
 FROM half WHERE "row"<(ny//2)*2 AND col<(nx//2)*2 GROUP BY "row"//2, col//2)"""
BASE = f"{PTS}, {BND}, {HALF}, {CELLS}"
SLOPE = """near AS (SELECT c."row", c.col, c.z, c.nx, c.ny, u.z up, d.z down, l.z lft, r.z rgt FROM cells c LEFT JOIN cells u ON u."row"=c."row"-1 AND u.col=c.col LEFT JOIN cells d ON d."row"=c."row"+1 AND d.col=c.col
 LEFT JOIN cells l ON l."row"=c."row" AND l.col=c.col-1 LEFT JOIN cells r ON r."row"=c."row" AND r.col=c.col+1),
grad AS (SELECT *, CASE WHEN col=0 THEN rgt-z WHEN col=nx-1 THEN z-lft ELSE (rgt-lft)/2.0::DOUBLE END gx, CASE WHEN "row"=0 THEN down-z WHEN "row"=ny-1 THEN z-up ELSE (down-up)/2.0::DOUBLE END gy FROM near),
slopes AS (SELECT "row", col, z, round(degrees(atan(sqrt(gx*gx+gy*gy))),4) slope FROM grad)"""
MASK = 'mask AS (SELECT "row", col FROM slopes WHERE slope < 10)'


FULL = """dims AS (SELECT any_value(nx) nx, any_value(ny) ny FROM cells), full_ AS (SELECT r::INT "row", c::INT col FROM dims, range(ny) a(r), range(nx) b(c))"""
STEEP = 'steep AS (SELECT "row", col FROM slopes WHERE slope >= 30)'


def disk_sql(radius: float) -> str:
    k = int(radius)
    return f"(SELECT dr::INT dr, dc::INT dc FROM range({-k},{k + 1}) a(dr), range({-k},{k + 1}) b(dc) WHERE dr*dr+dc*dc <= {radius * radius})"


def points(spark, d):
    return lineitem_points(spark, d)


def half(spark, d, colour=False):
    p = grid.valid(points(spark, d))
    return grid.half_cells(p, grid.extent(p, RES), RES, colour)


def cells(spark, d):
    """(row, col, z, cnt, nx, ny), heights to the micrometre."""
    c, meta = grid.build(points(spark, d), RES)
    return sized(c.withColumn("z", F.round("z", 6)), meta)


def sized(cells, meta):
    """Cells with the grid's nx and ny as literals."""
    m = meta.first()
    return cells.withColumns({n: F.lit(m[n] if m else None).cast("int") for n in ("nx", "ny")})


def slopes(spark, d):
    return raster.slope(cells(spark, d), RES).withColumn("slope", F.round("slope", 4))


def mask(spark, d):
    return slopes(spark, d).where("slope < 10").select("row", "col")


def register(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@register("q_bounds", f"WITH {PTS}, {BND} SELECT xmin, ymax, nx, ny FROM bnd")
def q_bounds(spark, d):
    return grid.extent(grid.valid(points(spark, d)), RES)


@register("q_valid_filter", f"WITH {PTS} SELECT count(*) n, round(sum(z),3) z FROM (SELECT z FROM (SELECT x, y, CASE WHEN red%7=0 THEN 'NaN'::DOUBLE WHEN red%7=1 THEN 'Infinity'::DOUBLE WHEN red%7=2 THEN -2e6::DOUBLE ELSE z END z FROM pts) WHERE isfinite(z) AND z > -1e6)")
def q_valid_filter(spark, d):
    z = F.when(F.col("red") % 7 == 0, F.lit(float("nan"))).when(F.col("red") % 7 == 1, F.lit(float("inf"))).when(F.col("red") % 7 == 2, F.lit(-2e6)).otherwise(F.col("z"))
    return grid.valid(points(spark, d).withColumn("z", z)).agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("z"))


@register("q_cell_max", f'WITH {PTS}, {BND}, {HALF} SELECT "row", col, round(z,6) z FROM half')
def q_cell_max(spark, d):
    return half(spark, d).select("row", "col", F.round("z", 6).alias("z"))


@register("q_cell_count", f'WITH {PTS}, {BND}, {HALF} SELECT "row", col, cnt FROM half')
def q_cell_count(spark, d):
    return half(spark, d).select("row", "col", "cnt")


@register("q_cell_rgb", f'WITH {BASE} SELECT "row", col, round(red,6) red, round(green,6) green, round(blue,6) blue FROM cells')
def q_cell_rgb(spark, d):
    out, _ = grid.build(points(spark, d), RES, True)
    return out.select("row", "col", *(F.round(c, 6).alias(c) for c in ("red", "green", "blue")))


@register("q_block_median", f'WITH {BASE} SELECT "row", col, z, cnt FROM cells')
def q_block_median(spark, d):
    return cells(spark, d).select("row", "col", "z", "cnt")


@register("q_slope", f'WITH {BASE}, {SLOPE} SELECT "row", col, slope FROM slopes')
def q_slope(spark, d):
    return slopes(spark, d).select("row", "col", "slope")


@register("q_slope_summary", f"WITH {BASE}, {SLOPE} SELECT round(quantile_cont(slope,0.5),4) median, round(quantile_cont(slope,0.9),4) p90, count(slope) n FROM slopes")
def q_slope_summary(spark, d):
    # the exact percentiles of rounded slopes (at most 900,001 values), each with its number
    s = slopes(spark, d).where("slope is not null").groupBy("slope").agg(F.count("*").alias("n"))
    at = lambda p: F.round(F.percentile("slope", p, F.col("n")), 4)
    return s.agg(at(0.5).alias("median"), at(0.9).alias("p90"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@register("q_platform", f'WITH {BASE}, {SLOPE}, {MASK} SELECT "row", col FROM mask')
def q_platform(spark, d):
    return mask(spark, d)


@register("q_shift", f'WITH {BASE} SELECT c."row", c.col, s.z z FROM cells c LEFT JOIN cells s ON s."row"=c."row"+1 AND s.col=c.col-2')
def q_shift(spark, d):
    return raster.shift(cells(spark, d), 1, -2)


_DIL = 'SELECT DISTINCT m."row"-o.dr "row", m.col-o.dc col FROM {m} m, {k} o'
_ERO = 'SELECT m."row"-o.dr "row", m.col-o.dc col FROM {m} m, {k} o GROUP BY 1,2 HAVING count(*)=(SELECT count(*) FROM {k})'


@register("q_dilate", f"WITH {BASE}, {SLOPE}, {MASK} {_DIL.format(m='mask', k=disk_sql(2))}")
def q_dilate(spark, d):
    return raster.dilate(mask(spark, d), raster.disk(2))


@register("q_erode", f"WITH {BASE}, {SLOPE}, {MASK} {_ERO.format(m='mask', k=disk_sql(1))}")
def q_erode(spark, d):
    return raster.erode(mask(spark, d), raster.disk(1))


@register("q_close", f"WITH {BASE}, {SLOPE}, {MASK}, g AS ({_DIL.format(m='mask', k=disk_sql(2))}) {_ERO.format(m='g', k=disk_sql(2))}")
def q_close(spark, d):
    return raster.closing(mask(spark, d), raster.disk(2))


@register("q_open", f"WITH {BASE}, {SLOPE}, {MASK}, g AS ({_ERO.format(m='mask', k=disk_sql(1))}) {_DIL.format(m='g', k=disk_sql(1))}")
def q_open(spark, d):
    return raster.opening(mask(spark, d), raster.disk(1))


_GROW = 'SELECT DISTINCT m."row"-o.dr "row", m.col-o.dc col FROM {m} m, {k} o, dims WHERE m."row"-o.dr BETWEEN 0 AND ny-1 AND m.col-o.dc BETWEEN 0 AND nx-1'
_SHRINK = 'SELECT "row", col FROM full_ EXCEPT SELECT f."row", f.col FROM full_ f, {k} o, dims WHERE f."row"+o.dr BETWEEN 0 AND ny-1 AND f.col+o.dc BETWEEN 0 AND nx-1 AND (f."row"+o.dr, f.col+o.dc) NOT IN (SELECT ("row", col) FROM {m})'


@register("q_clean_mask", f"WITH {BASE}, {SLOPE}, {MASK}, {FULL}, g1 AS ({_GROW.format(m='mask', k=disk_sql(2))}), g2 AS ({_SHRINK.format(m='g1', k=disk_sql(2))}), g3 AS ({_SHRINK.format(m='g2', k=disk_sql(1))}) {_GROW.format(m='g3', k=disk_sql(1))}")
def q_clean_mask(spark, d):
    """Closing by two cells, then opening by one, the grid's edges not eroded."""
    c = components.cut(slopes(spark, d).join(cells(spark, d).select("row", "col", "nx", "ny"), ["row", "col"]))
    m = c.select("nx", "ny").first()
    nx, ny = (m.nx, m.ny) if m else (0, 0)
    return raster.opening(raster.closing(c.where("slope < 10").select("row", "col"), raster.disk(2), nx, ny), raster.disk(1), nx, ny)


@register("q_region", f"WITH {BASE} {_DIL.format(m='cells', k=disk_sql(3))}")
def q_region(spark, d):
    return raster.region(cells(spark, d), 3.0)


@register("q_nearest_fill", f'WITH {BASE}, f AS (SELECT c."row"-o.dr "row", c.col-o.dc col, c.z, o.dr*o.dr+o.dc*o.dc d2, c."row" sr, c.col sc FROM cells c, {disk_sql(3)} o) SELECT "row", col, arg_min(z, (d2, sr, sc)) z, min(d2)::INT d2 FROM f GROUP BY "row", col')
def q_nearest_fill(spark, d):
    return raster.fill(cells(spark, d), 3.0)


@register("q_median3", f'WITH {BASE}, g AS (SELECT c."row", c.col, greatest(0,least(c.ny-1,c."row"+o.dr)) sr, greatest(0,least(c.nx-1,c.col+o.dc)) sc FROM cells c, (SELECT dr::INT dr, dc::INT dc FROM range(-1,2) a(dr), range(-1,2) b(dc)) o) SELECT g."row", g.col, round(median(s.z),6) z FROM g JOIN cells s ON s."row"=g.sr AND s.col=g.sc GROUP BY 1,2')
def q_median3(spark, d):
    return raster.median3(cells(spark, d)).withColumn("z", F.round("z", 6))


_W = "[" + ",".join(map(repr, raster.gaussian_weights(1.0))) + "]"


@register("q_gauss", f'WITH {BASE}, o AS (SELECT k::INT k, ({_W})[k+5] w FROM range(-4,5) t(k)), g1 AS (SELECT c."row", c.col, sum(w*s.z)/sum(w) z FROM cells c, o JOIN cells s ON true WHERE s."row"=c."row"+k AND s.col=c.col GROUP BY 1,2) SELECT c."row", c.col, round(sum(w*s.z)/sum(w),5) z FROM g1 c, o JOIN g1 s ON true WHERE s."row"=c."row" AND s.col=c.col+k GROUP BY 1,2')
def q_gauss(spark, d):
    return raster.gaussian(cells(spark, d), 1.0).withColumn("z", F.round("z", 5))


# per column the nearest set row above and below, then the least over the columns of a row
APART = """vert AS (SELECT f."row", f.col, max(s."row") OVER (PARTITION BY f.col ORDER BY f."row") up, min(s."row") OVER (PARTITION BY f.col ORDER BY f."row" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) dn FROM full_ f LEFT JOIN {m} s ON s."row"=f."row" AND s.col=f.col),
pick AS (SELECT "row", col, CASE WHEN up IS NOT NULL AND (dn IS NULL OR "row"-up<=dn-"row") THEN up ELSE dn END sr FROM vert)"""


@register("q_edt", f'WITH {BASE}, {SLOPE}, {FULL}, {STEEP}, {APART.format(m="steep")}, f AS (SELECT a."row", a.col, min((b.sr-a."row")*(b.sr-a."row")+(b.col-a.col)*(b.col-a.col)) d2 FROM cells a JOIN pick b ON b."row"=a."row" WHERE b.sr IS NOT NULL GROUP BY 1,2) SELECT c."row", c.col, f.d2::BIGINT d2 FROM cells c LEFT JOIN f ON f."row"=c."row" AND f.col=c.col')
def q_edt(spark, d):
    """Squared distance to the nearest steep cell, however far."""
    s = components.cut(slopes(spark, d).join(cells(spark, d).select("row", "col", "nx", "ny"), ["row", "col"]))
    m = s.select("nx", "ny").first()
    if m is None:
        return s.select("row", "col", F.lit(None).cast("bigint").alias("d2"))
    far = raster.nearest(s.where("slope >= 30").select(F.lit(0).alias("kind"), "row", "col"), m.nx, m.ny).select("row", "col", "d2")
    return s.select("row", "col").join(far, ["row", "col"], "left")


@register("q_nearest_any", f'WITH {BASE}, {FULL}, {APART.format(m="cells")}, f AS (SELECT a."row", a.col, min((b.sr-a."row")*(b.sr-a."row")+(b.col-a.col)*(b.col-a.col)) d2, arg_min((b.sr, b.col), ((b.sr-a."row")*(b.sr-a."row")+(b.col-a.col)*(b.col-a.col), b.sr, b.col)) s FROM full_ a JOIN pick b ON b."row"=a."row" WHERE b.sr IS NOT NULL GROUP BY 1,2) SELECT f."row", f.col, f.d2::BIGINT d2, c.z FROM f JOIN cells c ON c."row"=f.s[1] AND c.col=f.s[2]')
def q_nearest_any(spark, d):
    """Every cell of the grid with the height of the nearest known one, however far (ties: the least row, col)."""
    c = components.cut(cells(spark, d))
    m = c.select("nx", "ny").first()
    known = c.select("row", "col", "z")
    if m is None:
        return known.select("row", "col", F.lit(None).cast("bigint").alias("d2"), "z")
    near = raster.nearest(known.select(F.lit(0).alias("kind"), "row", "col"), m.nx, m.ny)
    return near.join(known.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z"), ["sr", "sc"]).select("row", "col", "d2", "z")


@register("q_gauss_mirror", f'WITH {BASE}, o AS (SELECT k::INT k, ({_W})[k+5] w FROM range(-4,5) t(k)), m1 AS (SELECT c."row", c.col, w, CASE WHEN c."row"+k<0 THEN -1-c."row"-k WHEN c."row"+k>=ny THEN 2*ny-1-c."row"-k ELSE c."row"+k END sr FROM cells c, o), g1 AS (SELECT m."row", m.col, sum(w*s.z)/sum(w) z, any_value(s.nx) nx FROM m1 m JOIN cells s ON s."row"=sr AND s.col=m.col GROUP BY 1,2), m2 AS (SELECT c."row", c.col, w, CASE WHEN c.col+k<0 THEN -1-c.col-k WHEN c.col+k>=nx THEN 2*nx-1-c.col-k ELSE c.col+k END sc FROM g1 c, o) SELECT m."row", m.col, round(sum(w*s.z)/sum(w),5) z FROM m2 m JOIN g1 s ON s."row"=m."row" AND s.col=sc GROUP BY 1,2')
def q_gauss_mirror(spark, d):
    """Gaussian smoothing with the grid mirrored at its edges."""
    c = components.cut(cells(spark, d))
    m = c.select("nx", "ny").first()
    return raster.gaussian(c, 1.0, m and m.nx, m and m.ny).withColumn("z", F.round("z", 5))


RUNS = """runs AS (SELECT "row"*2147483648+min(col) run, "row", min(col) c0, max(col) c1 FROM (SELECT "row", col, col-row_number() OVER (PARTITION BY "row" ORDER BY col) g FROM mask) GROUP BY "row", g),
edges AS (SELECT a.run a, b.run b FROM runs a JOIN runs b ON b."row"=a."row"+1 AND a.c0<=b.c1+1 AND b.c0<=a.c1+1),
two AS (SELECT a,b FROM edges UNION SELECT b,a FROM edges),
reach(a,b) AS (SELECT run, run FROM runs UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b=t.a),
root AS (SELECT a run, min(b) root FROM reach GROUP BY a),
lab AS (SELECT r."row", r.c0, r.c1, dense_rank() OVER (ORDER BY root) label FROM runs r JOIN root USING (run)),
labelled AS (SELECT "row", unnest(range(c0,c1+1))::INT col, label::INT label FROM lab)"""
_COMP = f"WITH RECURSIVE {BASE}, {SLOPE}, {MASK}, {RUNS}"


def labelled(spark, d):
    return components.labels(components.cut(mask(spark, d)))


@register("q_components", f'{_COMP} SELECT "row", col, label FROM labelled')
def q_components(spark, d):
    return labelled(spark, d)


@register("q_component_area", f"{_COMP} SELECT label, count(*) area FROM labelled GROUP BY label")
def q_component_area(spark, d):
    return components.areas(labelled(spark, d))


@register("q_component_bbox", f'{_COMP} SELECT label, min("row") row0, max("row") row1, min(col) col0, max(col) col1 FROM labelled GROUP BY label')
def q_component_bbox(spark, d):
    return components.boxes(labelled(spark, d))


_RUNS4 = RUNS.replace("a.c0<=b.c1+1 AND b.c0<=a.c1+1", "a.c0<=b.c1 AND b.c0<=a.c1")


@register("q_remove_small", f'WITH RECURSIVE {BASE}, {SLOPE}, {MASK}, {_RUNS4} SELECT "row", col FROM labelled WHERE label IN (SELECT label FROM labelled GROUP BY label HAVING count(*)>=80)')
def q_remove_small(spark, d):
    """The platforms without 4-connected parts of fewer than 80 cells."""
    return components.remove_small(components.cut(mask(spark, d)), 80)


_NB = "(SELECT dr::INT dr, dc::INT dc FROM range(-1,2) a(dr), range(-1,2) b(dc))"
_BDY = f'bdy AS (SELECT l."row", l.col, l.label FROM labelled l, {_NB} o JOIN labelled n ON true WHERE n."row"=l."row"+o.dr AND n.col=l.col+o.dc AND n.label=l.label GROUP BY 1,2,3 HAVING count(*)<9)'


@register("q_boundary", f'{_COMP}, {_BDY} SELECT "row", col, label FROM bdy')
def q_boundary(spark, d):
    return raster.boundary(labelled(spark, d))


_DIRS = "(SELECT dr::INT dr, dc::INT dc FROM range(-1,2) a(dr), range(-1,2) b(dc) WHERE dr<>0 OR dc<>0)"


@register(
    "q_ray_edges",
    f"""{_COMP}, {_BDY}, p AS (SELECT b."row", b.col, b.label, c.z zc, o.dr, o.dc, b."row"+o.dr*k sr, b.col+o.dc*k sc FROM bdy b JOIN cells c ON c."row"=b."row" AND c.col=b.col, {_DIRS} o, (VALUES (2),(3),(4),(5)) r(k)),
 h AS (SELECT p.*, s.z FROM p JOIN cells s ON s."row"=p.sr AND s.col=p.sc LEFT JOIN labelled l ON l."row"=p.sr AND l.col=p.sc WHERE l.label IS NULL OR l.label<>p.label),
 per AS (SELECT "row", col, label, zc, dr, dc, avg(z) o FROM h GROUP BY ALL HAVING count(*)>=2)
 SELECT "row", col, label, bool_or(zc-o>2.0) crest, bool_or(o-zc>2.0) toe FROM per GROUP BY 1,2,3 HAVING bool_or(zc-o>2.0) OR bool_or(o-zc>2.0)""",
)
def q_ray_edges(spark, d):
    return raster.ray_edges(labelled(spark, d), cells(spark, d), drop=2.0)


_BOX = 'box AS (SELECT label, min("row") row0, max("row") row1, min(col) col0, max(col) col1 FROM labelled GROUP BY label)'


@register("q_ray_edges_boxed", SQL["q_ray_edges"].replace(", p AS (SELECT b.", f", {_BOX}, p AS (SELECT b.", 1).replace("WHERE l.label IS NULL OR l.label<>p.label", 'JOIN box x ON x.label=p.label WHERE (l.label IS NULL OR l.label<>p.label) AND p.sr BETWEEN x.row0 AND x.row1 AND p.sc BETWEEN x.col0 AND x.col1').replace(">2.0", ">0.0123"))
def q_ray_edges_boxed(spark, d):
    """Crest and toe by rays that end at the component's bounding box."""
    return raster.ray_edges(labelled(spark, d), cells(spark, d), drop=0.0123, boxed=True)


@register(
    "q_step_edges",
    f"""WITH {BASE}, {SLOPE}, p AS (SELECT c."row", c.col, c.z zc, o.dr, o.dc, c."row"+o.dr*k sr, c.col+o.dc*k sc FROM slopes c, {_DIRS} o, (VALUES (2),(3),(4),(5)) r(k) WHERE c.slope<=25),
 h AS (SELECT p.*, p.zc-s.z fall FROM p JOIN cells s ON s."row"=p.sr AND s.col=p.sc),
 per AS (SELECT "row", col, dr, dc, count(*) FILTER (fall>2.0) dn, avg(fall) FILTER (fall>2.0) md, count(*) FILTER (fall<-2.0) un, avg(-fall) FILTER (fall<-2.0) mu FROM h GROUP BY ALL),
 best AS (SELECT "row", col, max(dn) dn, coalesce(max(md),0) md, max(un) un, coalesce(max(mu),0) mu FROM per GROUP BY 1,2)
 SELECT "row", col, CASE WHEN dn>=3 AND (un<3 OR md>=mu) THEN 'crest' ELSE 'toe' END AS type FROM best WHERE dn>=3 OR un>=3""",
)
def q_step_edges(spark, d):
    return raster.step_edges(slopes(spark, d), drop=2.0)


@register("q_cell_rgb_plain", f'WITH {PTS}, {BND}, {HALF} SELECT "row"//2 "row", col//2 col, round(sum(red/cnt)/4,6) red, round(sum(green/cnt)/4,6) green, round(sum(blue/cnt)/4,6) blue FROM half WHERE "row"<(ny//2)*2 AND col<(nx//2)*2 GROUP BY 1,2')
def q_cell_rgb_plain(spark, d):
    """Colour as the plain mean of the four half cells, empty ones as 0."""
    out, _ = grid.build(points(spark, d), RES, True, compat=True)
    return out.select("row", "col", *(F.round(c, 6).alias(c) for c in ("red", "green", "blue")))


@register("q_cell_centre", f'WITH {BASE} SELECT c."row", c.col, round(xmin+(c.col+0.5)*1.0,6)::DOUBLE x, round(ymax-(c."row"+0.5)*1.0,6)::DOUBLE y FROM cells c, bnd')
def q_cell_centre(spark, d):
    """The cells' centres in metres."""
    c, meta = grid.build(points(spark, d), RES)
    m = meta.first()
    x, y = grid.centre(F.col("row"), F.col("col"), m.xmin if m else 0.0, m.ymax if m else 0.0, RES)
    return c.select("row", "col", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@register("q_seed_fresh", f'WITH {BASE}, {SLOPE}, {STEEP}, around AS (SELECT DISTINCT s."row"-o.dr "row", s.col-o.dc col FROM steep s, {disk_sql(4)} o) SELECT "row", col FROM slopes WHERE slope < 10 EXCEPT SELECT "row", col FROM around')
def q_seed_fresh(spark, d):
    """Cells of one mask that are not within four cells of another."""
    s = components.cut(slopes(spark, d))
    near = raster.dilate(s.where("slope >= 30").select("row", "col"), raster.disk(4))
    return s.where("slope < 10").select("row", "col").join(near, ["row", "col"], "left_anti")


@register("q_seed_rect", f'WITH {BASE} SELECT "row", col, z FROM cells WHERE "row">=18 AND "row"<74 AND col>=34 AND col<114')
def q_seed_rect(spark, d):
    return raster.in_rectangle(cells(spark, d), (112.0, 103.8, 32.0, 48.8), -2.0, 121.9, RES).select("row", "col", "z")


@register("q_ply_round_trip", f"WITH {PTS} SELECT round(x,6) x, round(y,6) y, round(z,6) z, red, green, blue, count(*) n FROM pts GROUP BY ALL")
def q_ply_round_trip(spark, d):
    """Points written as a folder of PLY files and read back from all of them."""
    from ..sources.pointcloud import PointCloud

    folder = f"{components.shared(spark)}/clouds-{uuid.uuid4().hex}"
    spark.dataSource.register(PointCloud)
    colours = [F.col(c).cast("smallint").alias(c) for c in ("red", "green", "blue")]
    points(spark, d).select("x", "y", "z", *colours).write.format("pointcloud").mode("append").save(folder)
    back = spark.read.format("pointcloud").option("pieceRecords", 20_000).load(folder)
    keys = [*(F.round(c, 6).alias(c) for c in "xyz"), *(F.col(c).cast("int").alias(c) for c in ("red", "green", "blue"))]
    return back.groupBy(*keys).agg(F.count("*").alias("n"))

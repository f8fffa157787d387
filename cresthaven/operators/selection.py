"""Order-dependent selections: matching, thinning, chains, acceptance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected, cut
from .spatial import link_pairs_enhanced


def match(pairs: DataFrame, order: list[str], most: int = 100, at_once: int = 1 << 18) -> DataFrame:
    """Greedy one-to-one matching of lines: pairs (first_line, second_line, ...) in a strict total ``order``, each line once.

    Round by round a pair is taken if it is the best of both its lines, and what it uses is removed; with a strict
    order that is what going down the sorted list gives, but distributed.  Where rounds take little (chains of ever
    better pairs) or ``most`` are done, what is left is walked in order, each connected part by itself; ``at_once`` pairs
    or fewer are walked by one task.
    """
    strict = [*order, "first_line", "second_line", "first", "second"]
    strict = [c for c in strict if c in pairs.columns]
    rest, taken = cut(pairs.where("first_line is not null and second_line is not null")), None
    left = rest.count()
    for _ in range(most):
        if left <= at_once:
            break
        key = F.struct(*strict)
        lines = rest.select(F.explode(F.array("first_line", "second_line")).alias("line"), key.alias("key")).groupBy("line").agg(F.min("key").alias("best"))
        best = lambda side: lines.select(F.col("line").alias(side), F.col("best").alias(f"_{side}"))
        now = rest.join(best("first_line"), "first_line").join(best("second_line"), "second_line").where((key == F.col("_first_line")) & (key == F.col("_second_line"))).select(*pairs.columns)
        now = cut(now)
        taken = now if taken is None else taken.unionByName(now)
        used = now.select(F.explode(F.array("first_line", "second_line")).alias("used"))
        rest = cut(rest.join(used, F.col("first_line") == F.col("used"), "left_anti").join(used, F.col("second_line") == F.col("used"), "left_anti"))
        before, left = left, rest.count()
        if left * 10 > before * 9:
            break
    if left:
        last = walked(rest, strict, left <= at_once)
        taken = taken.unionByName(last) if taken is not None else last
    return taken if taken is not None else pairs.limit(0)


def match_links(ends: DataFrame, c, few: int = 5000, crowd: int = 200_000) -> DataFrame:
    """``match`` of all of enhanced linking's candidates by their preliminary score, without making them all.

    Band by band: the pairs of lines still free that score at most so much are made and matched, which is how far down
    the sorted list this goes; the lines that they use need no pairs of higher score.  The last band has no bound.
    """
    rest, taken, width = cut(ends), None, 0.04
    left = rest.count()
    width *= min(1.0, (crowd / max(left, 1)) ** 0.5)
    while left:
        most = width - 0.3 if left > few and width < 1 else None
        now = match(link_pairs_enhanced(rest, c, most=most), ["pre_score"])
        taken = now if taken is None else taken.unionByName(now)
        if most is None:
            break
        used = now.select(F.explode(F.array("first_line", "second_line")).alias("line_id"))
        rest = cut(rest.join(used, "line_id", "left_anti"))
        left, width = rest.count(), width * 2
    return taken if taken is not None else link_pairs_enhanced(rest, c)


def walked(pairs: DataFrame, strict: list[str], few: bool = False) -> DataFrame:
    """The greedy matching, each connected part of the lines walked in order by one task; a part's rows are four numbers each.

    few: so few pairs that one task may walk them all, without looking for parts.
    """
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        used, out = set(), []
        for a, b, n in zip(g["first_line"].tolist(), g["second_line"].tolist(), g["n"].tolist()):
            if a not in used and b not in used:
                used.update((a, b))
                out.append(n)
        return pd.DataFrame({"_kept": out})

    numbered = cut(pairs.withColumn("_n", F.monotonically_increasing_id()))
    if few:
        named = numbered.withColumn("root", F.lit(0).cast("bigint"))
    else:
        roots = connected(numbered.select(F.col("first_line").alias("a"), F.col("second_line").alias("b")))
        named = numbered.join(roots, F.col("first_line") == F.col("node"), "left").withColumn("root", F.coalesce("root", "first_line"))
    ranked = named.select("root", "first_line", "second_line", F.col("_n").alias("n"), F.row_number().over(Window.partitionBy("root").orderBy(*strict)).alias("rank"))
    kept = ranked.groupBy("root").applyInPandas(one, "_kept bigint")
    return cut(numbered.join(kept, F.col("_n") == F.col("_kept"), "left_semi").select(*pairs.columns))


def thin(candidates: DataFrame, radius: float, most: int, at_once: int = 4096) -> DataFrame:
    """Non-maximum suppression: candidates (cid, type, first_line, second_line, mx, my, score) by falling score (ties: cid) -> cid, rank.

    Kept: one per pair of lines, none nearer than ``radius`` to a kept one of its type, at most ``most`` in all.  While
    there are over ``at_once``, rounds take every candidate that is the best of its pair and of the square buckets
    around it, and what these rule out goes; the rest is decided by one task.  Both give what going down the sorted
    list gives: who is the best of all that could rule it out is kept in any case.
    """
    pair = F.struct(F.least("first_line", "second_line").alias("a"), F.greatest("first_line", "second_line").alias("b"))
    better = F.struct((-F.col("score")).alias("s"), "cid")
    bucket = lambda c: F.floor(F.col(c) / radius)
    rest = cut(candidates.select("cid", "type", pair.alias("pair"), "mx", "my", "score", better.alias("place"), bucket("mx").alias("bx"), bucket("my").alias("by")))
    kept, left = None, rest.count()
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while left > at_once:
        best = rest.groupBy("pair").agg(F.min("place").alias("of_pair"))
        seen = rest.select("type", "place", step.alias("o"), "bx", "by").groupBy("type", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by")).agg(F.min("place").alias("around"))
        won = cut(rest.join(best, "pair").join(seen, ["type", "bx", "by"]).where("place = of_pair and place = around").select(rest.columns))
        kept = won if kept is None else kept.unionByName(won)
        w = won.select("type", step.alias("o"), F.col("mx").alias("wx"), F.col("my").alias("wy"), "bx", "by").select("type", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), "wx", "wy")
        near = (F.col("mx") - F.col("wx")) * (F.col("mx") - F.col("wx")) + (F.col("my") - F.col("wy")) * (F.col("my") - F.col("wy")) < radius * radius
        ruled = rest.join(w, ["type", "bx", "by"]).where(near).select("cid")
        rest = cut(rest.join(won.select("pair"), "pair", "left_anti").join(ruled, "cid", "left_anti"))
        left = rest.count()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((g["cid"], -g["score"]))
        kind, of = g["type"].to_numpy()[order], g.groupby(["a", "b"]).ngroup().to_numpy()[order]
        at, cid = g[["mx", "my"]].to_numpy()[order], g["cid"].to_numpy()[order]
        open_, won = np.ones(len(g), bool), []
        while open_.any():
            k = int(open_.argmax())
            won.append(cid[k])
            open_ &= (of != of[k]) & ((kind != kind[k]) | (((at - at[k]) ** 2).sum(axis=1) >= radius * radius))
            open_[k] = False
        return pd.DataFrame({"cid": np.array(won, np.int64)})

    last = cut(rest.select("cid", "type", "pair.a", "pair.b", "mx", "my", "score").withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(one, "cid bigint"))
    found = candidates.select("cid", "score").join(last, "cid")
    if kept is not None:
        found = found.unionByName(kept.select("cid", "score"))
    top = found.orderBy(F.desc("score"), "cid").limit(most)
    return top.select("cid", F.row_number().over(Window.orderBy(F.desc("score"), "cid")).alias("rank"))  # at most ``most`` rows


def chain(cells: pd.DataFrame, least: int, unsorted: bool = False) -> list[np.ndarray]:
    """Chains of cells (row, col): from cells with at most one neighbour first, then the others, in order of (row, col); each step goes to the nearest unvisited cell within two.

    A walk uses its cells up, also where it is too short to be kept.  unsorted: each step goes to the first unvisited
    one of the neighbours' numbers (by row, col) in the order of a Python set, as in the published figures.
    """
    order = sorted(zip(cells["row"].tolist(), cells["col"].tolist()))
    there = set(order)
    around = sorted(((r * r + c * c, r, c) for r in range(-2, 3) for c in range(-2, 3) if r or c))
    near = {p: [(p[0] + r, p[1] + c) for _, r, c in around if (p[0] + r, p[1] + c) in there] for p in order}
    if unsorted:
        number = {p: n for n, p in enumerate(order)}
        near = {p: [order[n] for n in {number[q] for q in sorted(around)}] for p, around in near.items()}
    seen: set = set()
    out = []
    for p in sorted(order, key=lambda p: (len(near[p]) > 1, p)):
        if p in seen:
            continue
        walk = [p]
        seen.add(p)
        while nxt := next((q for q in near[walk[-1]] if q not in seen), None):
            walk.append(nxt)
            seen.add(nxt)
        if len(walk) >= least:
            out.append(np.array(walk))
    return out


def chains(cells: DataFrame, keys: list[str], least: int, unsorted: bool = False) -> DataFrame:
    """(keys, row, col) -> (keys, chain, idx, row, col): the chains of each group, a component's boundary."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = chain(g, least, unsorted)
        rows = [{**{k: g[k].iloc[0] for k in keys}, "chain": i, "idx": j, "row": int(r), "col": int(c)} for i, w in enumerate(found) for j, (r, c) in enumerate(w)]
        return pd.DataFrame(rows, columns=[*keys, "chain", "idx", "row", "col"])

    kinds = dict(cells.dtypes)
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "chain bigint, idx bigint, row int, col int"])
    return cells.select(*keys, "row", "col").groupBy(*keys).applyInPandas(one, ddl)


def accept(candidates: DataFrame, existing: DataFrame, c) -> DataFrame:
    """Multiscale acceptance: candidates' samples (line_id, type, length, k, row, col, d_edge in metres), existing cells (type, row, col) -> line_id, edge_fraction.

    Per type, longest first (ties: line_id): enough samples near an edge, the median distance to accepted or existing
    lines above the duplicate limit, and either an end near the network or a long line of strong evidence.  Each
    acceptance adds its cells to the network.  ``c`` is a Config.  A group holds one type's candidate samples and the
    existing cells in whose reach they are.
    """
    res = c.grid_res_m

    def one(key, lines: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        net = cells[["row", "col"]].to_numpy(float)
        out = []

        def to_net(p):
            d = np.full(len(p), np.inf)
            for at in range(0, len(net), 4096):
                part = net[at : at + 4096]
                d = np.minimum(d, np.sqrt(((p[:, None] - part[None]) ** 2).sum(axis=2)).min(axis=1))
            return d * res

        heads = lines.groupby("line_id")["length"].first().reset_index().sort_values(["length", "line_id"], ascending=[False, True])
        by_id = dict(list(lines.groupby("line_id")))
        for line_id, length in zip(heads["line_id"], heads["length"]):
            g = by_id[line_id].sort_values("k")
            support = float((g["d_edge"].fillna(np.inf) <= c.multiscale_edge_dist_m).mean())
            if support < c.multiscale_edge_min_fraction:
                continue
            p = g[["row", "col"]].to_numpy(float)
            d = to_net(p)
            if np.median(d) <= c.multiscale_dedup_dist_m:
                continue
            if not (min(d[0], d[-1]) <= c.multiscale_network_gap_m or (length >= c.multiscale_isolated_min_length_m and support >= c.multiscale_isolated_edge_fraction)):
                continue
            out.append((line_id, support))
            net = np.concatenate([net, p])
        return pd.DataFrame(out, columns=["line_id", "edge_fraction"])

    a, b = candidates.groupBy("type"), existing.select("type", "row", "col").distinct().groupBy("type")
    return a.cogroup(b).applyInPandas(one, "line_id bigint, edge_fraction double")

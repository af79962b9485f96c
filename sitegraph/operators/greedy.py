"""Greedy one-to-one matching of ids that come in groups; no pair of ids is written out before it is taken."""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .components import components
from .ranks import positioned

#: A run is written out by so many pairs at a time; so many ids, or one component, go to a task.
RUN, TASK = 10_000, 100_000


def _once(rows: DataFrame, links: DataFrame, mine: str) -> tuple[DataFrame, DataFrame]:
    """Each id in one group: an id of several gets one of its own, linked with what any of them is linked with."""
    ids = rows.where("id is not null").join(links.select(F.col(mine).alias("g")).distinct(), "g", "left_semi")
    ids = ids.groupBy("id").agg(F.min("g").alias("g"), F.max("g").alias("h")).checkpoint()
    own = ids.where("g <> h").select("id", (-1 - F.monotonically_increasing_id()).alias("own")).checkpoint()
    if not own.limit(1).count():
        return ids.select("id", "g"), links
    other = "b_g" if mine == "a_g" else "a_g"
    more = rows.join(own, "id").join(links.withColumnRenamed(mine, "g"), "g").groupBy(F.col("own").alias(mine), other).agg(F.min("metres").alias("metres"))
    return ids.where("g = h").select("id", "g").union(own), links.unionByName(more).checkpoint()


def _sole(links: DataFrame) -> DataFrame:
    """Links that are the one nearest of either group."""

    def nearest(mine: str, other: str) -> DataFrame:
        tied = links.groupBy(mine, "metres").agg(F.count("*").alias("k"), F.min(other).alias(other))
        return tied.groupBy(mine).agg(F.min(F.struct("metres", "k", other)).alias("m")).where("m.k = 1").select(mine, f"m.{other}", "m.metres")

    return nearest("a_g", "b_g").join(nearest("b_g", "a_g").drop("metres"), ["a_g", "b_g"])


def _pair_after_pair(links: pa.Table, members: pa.Table) -> pa.Table:
    """ap, bp, metres: at each distance the least a goes first and takes its least b that is free."""
    sides = []
    for name in ("a_id", "b_id"):
        rows = members.filter(pc.is_valid(members[name])).sort_by("p")
        g, p, ids = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("g", "p", name))
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[: len(g)]
        spans = {int(g[s]): [int(s), int(e)] for s, e in zip(starts, [*starts[1:], len(g)], strict=True)}  # what is free of a group
        sides.append((spans, p, ids))
    (a, a_p, a_ids), (b, b_p, b_ids) = sides
    rows = links.sort_by("metres").select(["metres", "a_g", "b_g"])
    out: list[tuple[int, int, float]] = []
    for metres, tied in groupby(zip(*(c.to_pylist() for c in rows.columns), strict=True), lambda r: r[0]):
        near: dict[int, list] = {}
        for _, x, y in tied:
            if a[x][0] < a[x][1] and b[y][0] < b[y][1]:
                near.setdefault(x, []).append((b_ids.item(b[y][0]), y))
        for ys in near.values():
            heapify(ys)
        first = [(a_ids.item(a[x][0]), x) for x in near]
        heapify(first)
        while first:
            x = first[0][1]
            ys = near[x]
            while ys and (b[ys[0][1]][0] == b[ys[0][1]][1] or b_ids.item(b[ys[0][1]][0]) != ys[0][0]):  # others took from it
                y = ys[0][1]
                if b[y][0] == b[y][1]:
                    heappop(ys)
                else:
                    heapreplace(ys, (b_ids.item(b[y][0]), y))
            if not ys:
                heappop(first)
                continue
            y = ys[0][1]
            out.append((a[x][0], b[y][0], metres))
            a[x][0] += 1
            b[y][0] += 1
            if a[x][0] == a[x][1]:
                heappop(first)
            else:
                heapreplace(first, (a_ids.item(a[x][0]), x))
    i, j, m = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"ap": pa.array(a_p[list(i)], pa.int64()), "bp": pa.array(b_p[list(j)], pa.int64()), "metres": pa.array(m, pa.float64())})


def _rest(links: DataFrame, sides: tuple[tuple[DataFrame, DataFrame], ...]) -> DataFrame:
    """ap, bp, metres of links that tie or chain: whole components of linked groups, several to a task, pair after pair."""
    spark = links.sparkSession
    ship(spark)
    ids = sum(groups.agg(F.sum("n")).first()[0] or 0 for _, groups in sides)
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids // TASK)
    comps = components(links.select(F.col("a_g").alias("node"), F.col("b_g").alias("key"))).withColumnRenamed("node", "a_g")
    dealt = links.join(comps, "a_g").select("a_g", "b_g", "metres", F.pmod(F.xxhash64("comp"), F.lit(lots)).alias("lot")).checkpoint()
    members = []
    for side, (rows, groups) in zip("ab", sides, strict=True):
        of = dealt.select(F.col(f"{side}_g").alias("g"), F.col("lot").alias("of")).distinct().join(groups.select("g", F.col("p").alias("least")), "g")
        members.append(rows.join(of, "g").where("p >= least").select("of", "g", "p", F.col("id").alias(f"{side}_id")))
    both = members[0].unionByName(members[1], allowMissingColumns=True)
    return dealt.groupBy("lot").cogroup(both.groupBy("of")).applyInArrow(_pair_after_pair, "ap long, bp long, metres double")


def greedy_in_groups(a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """a_id, b_id, metres: what greedy_one_to_one takes of all pairs of an id of a group with one of a linked group.

    a and b have id and g (a long of 0 or more), links a_g, b_g and metres. Ids of a group differ in their
    order alone, so the least of them are taken first, and what two groups give each other is a run of
    positions. Rounds match groups of which each is the one nearest of the other, by their numbers of ids, as
    long as that takes half of the links; the rest goes pair after pair, by components of linked groups.
    """
    links = links.where("metres is not null").groupBy("a_g", "b_g").agg(F.min("metres").alias("metres")).checkpoint()
    if not links.limit(1).count():
        return a.limit(0).select(F.col("id").alias("a_id")).crossJoin(b.limit(0).select(F.col("id").alias("b_id"))).withColumn("metres", F.lit(0.0))
    a, links = _once(a, links, "a_g")
    b, links = _once(b, links, "b_g")
    a, b = (positioned(x, [F.col("g"), F.col("id")], "p") for x in (a, b))
    free = [x.groupBy("g").agg(F.count("*").alias("n"), F.min("p").alias("p")).checkpoint() for x in (a, b)]

    def linked(rows: DataFrame) -> DataFrame:
        for side, groups in zip("ab", free, strict=True):
            rows = rows.join(groups.select(F.col("g").alias(f"{side}_g")), f"{side}_g", "left_semi")
        return rows.checkpoint()

    links = linked(links)
    was, size, runs = 0, links.count(), []
    while size and (not runs or 2 * size <= was):
        run = _sole(links)
        for side, groups in zip("ab", free, strict=True):
            run = run.join(groups.select(F.col("g").alias(f"{side}_g"), F.col("n").alias(f"{side}n"), F.col("p").alias(f"{side}p")), f"{side}_g")
        runs.append(run.withColumn("n", F.least("an", "bn")).select("a_g", "b_g", "ap", "bp", "metres", "n").checkpoint())
        for i, side in enumerate("ab"):
            taken = free[i].join(runs[-1].select(F.col(f"{side}_g").alias("g"), F.col("n").alias("m")), "g", "left").fillna(0, ["m"])
            free[i] = taken.select("g", F.expr("n - m").alias("n"), F.expr("p + m").alias("p")).where("n > 0").checkpoint()
        links = linked(links)
        was, size = size, links.count()
    pairs = [links.limit(0).select(F.col("a_g").alias("ap"), F.col("b_g").alias("bp"), "metres")] + [
        r.withColumn("i", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)"))).withColumn("i", F.explode(F.expr(f"sequence(i, least(i + {RUN}, n) - 1)"))).select(F.expr("ap + i").alias("ap"), F.expr("bp + i").alias("bp"), "metres")
        for r in runs
    ]
    if size:
        pairs.append(_rest(links, ((a, free[0]), (b, free[1]))).checkpoint())
    taken = pairs[0]
    for more in pairs[1:]:
        taken = taken.unionByName(more)
    return taken.join(a.select(F.col("p").alias("ap"), F.col("id").alias("a_id")), "ap").join(b.select(F.col("p").alias("bp"), F.col("id").alias("b_id")), "bp").select("a_id", "b_id", "metres")

"""Exact top-k search by inner product: columnar branch and bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from ._shared import materialise

QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSIONS = 2048, 8192, 8
_OUT = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_SAFE = float(1 << 52)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vertical layout: a row for each dimension; shorter vectors are filled with zeros."""
    c = column.combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0)
    sizes = np.diff(c.offsets.to_numpy())
    out = np.zeros((max(1, int(sizes.max(initial=0))), len(c)))
    flat = c.flatten().to_numpy()
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(c)), sizes)] = flat
    return out


def _search(k: int, block: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        none = _OUT.empty_table()
        if not queries.num_rows or not candidates.num_rows:
            return none
        q, c = _matrix(queries.column("v")), _matrix(candidates.column("v"))
        d = max(len(q), len(c))
        q, c = (np.pad(m, ((0, d - len(m)), (0, 0))) for m in (q, c))
        order = np.argsort(-np.abs(q).sum(axis=1) * np.abs(c).sum(axis=1), kind="stable")
        q, c = q[order], c[order]
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d < _SAFE
        fine = lambda m: m if exact else m / 2.0 ** np.ceil(np.log2(max(1.0, float(np.abs(m).max(initial=0)))))
        whole_q, whole_c, q, c = q, c, fine(q), fine(c)  # beyond 53 bits bounds are kept on scaled numbers, their rounding included
        rest = lambda m: np.sqrt(np.vstack([np.cumsum((m * m)[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))
        q_rest, c_rest = rest(q), rest(c)  # mass of the dimensions that are still to come
        rough = 0.0 if exact else (d + 4) * 2.0**-52
        qid, qrow, cid = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy(), candidates.column("vec_id").to_numpy()
        by_id = np.argsort(cid, kind="stable")
        cid, c, c_rest, whole_c = cid[by_id], c[:, by_id], c_rest[:, by_id], whole_c[:, by_id]
        found: list[tuple] = []
        for j in range(len(qid)):
            alive = np.flatnonzero(cid != qid[j])
            part = np.zeros(len(alive))
            at = 0
            while at < d and len(alive):
                end = min(d, at + block)
                part += q[at:end, j] @ (c[at:end] if len(alive) == c.shape[1] else c[at:end, alive])
                at = end
                if at < d and len(alive) > k:
                    slack = q_rest[at, j] * c_rest[at, alive] * (1 + 1e-9) + rough * q_rest[0, j] * c_rest[0, alive] + (1e-6 if exact else 1e-290)
                    floor = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                    live = part + slack >= floor
                    if live.mean() < 0.75:  # compact
                        alive, part = alive[live], part[live]
            if len(alive) > k:
                slack = rough * q_rest[0, j] * c_rest[0, alive] + (0.0 if exact else 1e-290)
                floor = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                keep = part + slack >= floor
                alive, part = alive[keep], part[keep]
            if exact:
                best = np.lexsort((alive, -part))[:k]
                found += [(qid[j], qrow[j], cid[i], int(s)) for i, s in zip(alive[best], part[best], strict=True)]
            else:  # the few that are left, in whole numbers
                v = [int(x) for x in whole_q[:, j]]
                score = [sum(a * int(b) for a, b in zip(v, whole_c[:, i], strict=True)) for i in alive]
                told = sorted(zip(alive, score, strict=True), key=lambda x: (-x[1], x[0]))[:k]
                found += [(qid[j], qrow[j], cid[i], max(-(1 << 63), min(s, (1 << 63) - 1))) for i, s in told]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [f.type for f in _OUT], strict=True)], schema=_OUT) if found else none

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k candidates of the highest inner product.

    vectors has vec_id and embedding; components become floor(scale * x). Queries are the rows whose
    vec_id is divisible by every; candidates are all rows with another vec_id. Ties go to the
    smaller vec_id. Vectors that are null or hold a null or non-finite component, and rows without
    vec_id, take no part; an empty vector is a zero vector, shorter ones are filled with zeros.
    Repeated rows stay candidates each; queries that are alike in id and vector count once, queries
    alike in id only are told apart and have a ranking each. Scores beyond 64 bits stop at its ends.
    Other columns are ignored; an empty table gives an empty table.

    Blocks of candidates and of queries, dealt by hashes, meet in tasks of bounded size. A task keeps
    candidates in vertical layout, adds up the product a block of dimensions at a time, bounds what
    is to come by the norms of the remaining dimensions, and compacts the surviving candidates.
    """
    ship(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    ok = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull()
    rows = vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform(vec, lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))
    rows, _ = materialise(rows.withColumn("row", F.xxhash64("vec_id", "v")), "vectors")
    asked = F.col("vec_id") % every == 0
    queries = rows.where(asked).dropDuplicates(["vec_id", "row"])
    q_blocks, c_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(rows.count() / CANDIDATE_BLOCK))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    spread = F.xxhash64("row", F.monotonically_increasing_id(), F.lit(2))  # copies of a vector go to many blocks
    candidates = rows.withColumn("cb", F.pmod(spread, F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    near = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(_search(k, DIMENSIONS), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

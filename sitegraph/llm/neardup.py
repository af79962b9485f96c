"""N-gram Jaccard join by a MinHash LSH forest with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise, mix64, shingle_hashes, slices, small_batches, unused, word_hashes
from .graph import connected_components

TREES, FLOOR, DEPTH = 32, 5, 8
TARGET_RECALL = 0.99999
SMALL_SETS = 64
UNIT_CLASSES, UNIT_SHINGLES = 512, 600_000
BROADCAST_ROWS = 200_000
HOT_COPIES = 1000
CACHED = 1 << 16
_U, _W = np.uint64, np.uint32
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("keys", pa.list_(pa.int64())), ("deep", pa.list_(pa.int32()))])


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity at or above the threshold that a set of n shingles can have with another set."""
    return min((i / u for i in range(1, n + 1) for u in range(n, math.ceil(n / threshold) + 1) if i < u and i >= threshold * u - 1e-9), default=1.0)


def recall(similarity: float, prefix: int) -> float:
    return 1 - (1 - similarity**prefix) ** TREES


def matched_prefix(n: int, threshold: float, target: float) -> int:
    """How many minima of its labels a set of n shingles is matched by: DEPTH, shortened until the target recall is met.

    Small sets can't have every similarity, so theirs are shortened less.
    """
    similarity = least_similarity(n, threshold) if n <= SMALL_SETS else threshold
    return next((k for k in range(DEPTH, FLOOR, -1) if recall(similarity, k) >= target), FLOOR)


def distinct_shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    s, at = shingle_hashes(words, bounds, width)
    sets = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return sets, np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def set_digests(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits for each set of shingles, of its size and two sums; None for an empty set."""
    out: list[bytes | None] = []
    for x in sets:
        if not len(x):
            out.append(None)
            continue
        n = _U(len(x))
        two = np.array([mix64(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U), mix64(x ^ _U(0x14057B7EF767814F)).sum(dtype=_U)])
        out.append(mix64(two + n).tobytes())
    return out


def forest_labels(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of non-empty sets in each tree: a hash of the first FLOOR minima, and a byte of each of the others up to DEPTH, the first on top."""
    rng = np.random.default_rng(20_240_501)
    seeds = [[(_W(rng.integers(0, 2**31) * 2 + 1), _W(rng.integers(0, 2**32))) for _ in range(DEPTH)] for _ in range(TREES)]
    h = (flat >> _U(32)).astype(_W)
    minima = np.empty((TREES, DEPTH, len(at)), dtype=_W)
    bounds = np.append(at, len(h))
    i = 0
    while i < len(at):  # a few sets at a time stay in the cache
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CACHED, side="right")) - 1)
        part, heads = h[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]
        x = np.empty_like(part)
        for t in range(TREES):
            for d in range(DEPTH):
                a, b = seeds[t][d]
                np.bitwise_xor(part, b, out=x)
                np.multiply(x, a, out=x)
                minima[t, d, i:j] = np.minimum.reduceat(x, heads)
        i = j
    keys = np.empty((len(at), TREES), dtype=_U)
    deep = np.zeros((len(at), TREES), dtype=np.int32)
    for t in range(TREES):
        key = np.full(len(at), _U(t + 1))
        for d in range(FLOOR):
            key = mix64(key * _U(0x9E3779B97F4A7C15) + minima[t, d].astype(_U))
        keys[:, t] = key
        for d in range(FLOOR, DEPTH):
            deep[:, t] = (deep[:, t] << 8) | (mix64(minima[t, d].astype(_U)) & _U(255)).astype(np.int32)
    return keys.view(np.int64), deep


def sketch(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words, bounds = word_hashes(b.column("text"))
            sets, at = distinct_shingles(words, bounds, width)
            full = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [None] * len(sets)
            deep: list = [None] * len(sets)
            if full:
                for i, k, d in zip(full, *forest_labels(np.concatenate([sets[i] for i in full]), at[:-1][full]), strict=True):
                    keys[i], deep[i] = k, d
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array(set_digests(sets), pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(deep, pa.list_(pa.int32()))], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n int, cls binary, keys array<long>, deep array<int>")


def met_edges(classes: DataFrame, threshold: float, target: float) -> DataFrame:
    """Edges u, v that connect the sets that meet under a matched prefix of a label.

    All trees of a set are ascended together, from whole labels to its matched prefix. A prefix that
    one set is matched by holds for all sets that share it: the shortest among the sets of one FLOOR
    prefix is taken for them. The nodes of the prefix tries are grouped by hash, which gives the runs
    of a sorted trie without a sort; labels whose FLOOR prefix nobody shares go at once.
    """
    depths = F.array(*[F.lit(matched_prefix(n, threshold, target)) for n in range(1, SMALL_SETS + 2)])
    k = F.element_at(depths, F.least(F.col("n"), F.lit(SMALL_SETS + 1)))
    members = classes.select("node", k.alias("k"), F.explode(F.arrays_zip("keys", "deep")).alias("x")).select("node", "k", F.col("x.keys").alias("key"), F.col("x.deep").alias("deep"))
    shared = members.groupBy("key").agg(F.min("k").alias("k"), F.count("*").alias("c")).where("c > 1").drop("c")
    held = members.drop("k").join(shared, "key").select("node", "key", F.expr(f"shiftright(deep, 8 * ({DEPTH} - k))").alias("prefix"))
    roots = held.groupBy("key", "prefix").agg(F.min("node").alias("root"), F.count("*").alias("c")).where("c > 1").drop("c")
    return held.join(roots, ["key", "prefix"]).where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def _unit_links(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the linked pairs, i before j; rows of both sides pair across the sides only."""
    n = np.array([len(x) for x in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    mark = mix64(np.arange(1, len(sets) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    pattern = np.zeros(len(df), dtype=_U)
    np.add.at(pattern, ids, mark[rows])  # shingles of the same sets count as one, weighed
    one, weight = np.unique(pattern[df > 1], return_counts=True)
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    if len(one):
        keep = df[ids] > 1
        ids, rows = np.searchsorted(one, pattern[ids[keep]]), rows[keep]
        step = max(1, (4 << 20) // len(sets))
        for a in range(0, len(one), step):
            x = np.zeros((len(sets), min(step, len(one) - a)), dtype=np.float32)
            here = (ids >= a) & (ids < a + step)
            x[rows[here], ids[here] - a] = 1
            shared += (x * weight[a : a + step].astype(np.float32)) @ x.T
    linked = shared.astype(np.float64) * (1 + threshold) + 1e-6 >= threshold * (n[:, None] + n[None, :])
    linked &= np.triu(np.ones_like(linked), 1)
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    return linked


def _verify(threshold: float):
    schema = pa.schema([("cls", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def settle(seen: dict) -> tuple[list, list, list]:
        rows = sorted(seen.values(), key=lambda r: (r[0], r[2]))
        if len(rows) < 2:
            return [], [], []
        linked = _unit_links([np.frombuffer(r[3], dtype=_U) for r in rows], np.array([r[2] for r in rows]), threshold)
        weight = np.array([r[1] for r in rows], dtype=np.int64)
        both = linked | linked.T
        count = both.astype(np.float64) @ weight
        root = np.arange(len(rows))
        while True:  # least linked row, until settled
            best = np.minimum(root, np.where(both, root[None, :], len(rows)).min(axis=1))
            best = best[best]
            if (best == root).all():
                break
            root = best
        hit = np.flatnonzero(count > 0)
        return [rows[i][0] for i in hit], [int(count[i]) for i in hit], [rows[root[i]][0] for i in hit]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}
        for b in batches:
            cols = [b.column(k) for k in ("unit", "cls", "copies", "side", "sh")]
            for u, cls, copies, side, sh in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2].to_pylist(), cols[3].to_pylist(), cols[4], strict=True):
                if u != unit and held:
                    yield pa.record_batch(list(settle(held)), schema=schema)
                    held = {}
                unit = u
                if (side, cls) not in held:
                    held[side, cls] = (cls, copies, side, sh.as_py())
        if held:
            yield pa.record_batch(list(settle(held)), schema=schema)

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose rows were counted; the rows hold a few numbers and short keys (under 100 bytes)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ngram_jaccard_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs (doc_id, text).

    Shingles are the distinct runs of width words (lowercased; a text of fewer words has one shingle
    of all of them). n_links counts the other rows whose sets have a Jaccard similarity of the
    threshold or more, equal sets included; class_id is the least doc_id of the connected group.

    Method: each set gets labels of DEPTH MinHash values in TREES prefix tries; the prefix that a
    set is matched by is shortened until any set that it can be alike with is found with
    target_recall (see matched_prefix). Equal sets are one class before anything is joined. Classes that meet, however indirectly, form a candidate group; each group is verified
    exactly, in units of bounded size (a large group is cut by set size, as sets whose sizes differ
    by more than the threshold can't link, then by hash), and only link counts and one root per
    class leave a unit, never its pairs.

    Null and empty texts and texts without words: their own class, no links. Long texts count
    whole. Repeated rows are copies of each other. Null doc_ids stay; class_id is null if a whole
    group has none. Other columns are ignored. An empty table gives an empty table. A threshold too
    low for FLOOR minima in all TREES trees to reach the target is an error.
    """
    if recall(threshold, FLOOR) < target_recall:
        raise ValueError(f"{TREES} trees of {FLOOR} minima do not find pairs at {threshold} with a recall of {target_recall}")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    sketched, sketch_path = materialise(sketch(docs, width), "sketch")
    first = [F.first(c).alias(c) for c in ("n", "keys", "deep")]
    classes, class_path = materialise(sketched.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *first).withColumn("node", F.xxhash64("cls")), "classes")
    groups, group_path = materialise(connected_components(met_edges(classes, threshold, target_recall)), "groups")
    width_of = math.log(1 / threshold) if threshold < 1 else 1.0
    placed = classes.drop("keys", "deep").join(groups, "node").withColumn("sb", F.floor(F.log(F.col("n").cast("double")) / F.lit(width_of)).cast("int"))
    placed, placed_path = materialise(placed, "placed")
    cut = lambda: F.ceil(F.greatest(F.count("*") / F.lit(UNIT_CLASSES), F.sum("n") / F.lit(UNIT_SHINGLES))).cast("int")
    large = _small(placed.groupBy("comp").agg(cut().alias("parts")).where("parts > 1"))
    near, near_path = materialise(placed.join(large, "comp").groupBy("comp", "sb").agg(cut().alias("nb")), "near")
    sized = (
        near.join(near.select("comp", (F.col("sb") + 1).alias("sb"), F.col("nb").alias("below")), ["comp", "sb"], "left")
        .join(near.select("comp", (F.col("sb") - 1).alias("sb"), F.col("nb").alias("above")), ["comp", "sb"], "left")
    )
    dealt = placed.join(_small(sized), ["comp", "sb"], "left").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("nb")).cast("int")).select("rep", "cls", "copies", "comp", "sb", "nb", "above", "below", "own")
    dealt, dealt_path = materialise(dealt, "dealt")
    seen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(_small(dealt), F.col("id").eqNullSafe(F.col("rep")))
    carried = ["cls", "copies", "comp", "sb", "nb", "above", "below", "own"]

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # repeated rows leave a task once
        for b in slices(batches, "text"):
            sets, _ = distinct_shingles(*word_hashes(b.column("text")), width)
            ok = []
            for i, (x, y) in enumerate(zip(set_digests(sets), b.column("cls").to_pylist(), strict=True)):
                if x == y and y not in done:  # other texts may bear the id
                    done.add(y)
                    ok.append(i)
            if ok:
                kept = b.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in carried] + [pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=[*carried, "sh"])

    shingled = seen.select("text", *carried).mapInArrow(expand, "cls binary, copies long, comp long, sb int, nb int, above int, below int, own int, sh binary")
    shingled = shingled.withColumn("u", F.explode(_units())).select(F.concat_ws(":", "comp", "u.at").alias("unit"), "cls", "copies", F.col("u.side").alias("side"), "sh")
    shuffled = shingled.repartition("unit").sortWithinPartitions("unit")
    found, found_path = materialise(shuffled.mapInArrow(_verify(threshold), "cls binary, links long, root binary"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined, joined_path = materialise(connected_components(found.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls"), "joined")
    slim = classes.select("cls", "rep", "copies")
    named = slim.join(joined, "cls")
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    info = slim.join(named.join(least, "comp").select("cls", "least"), "cls", "left").join(links, "cls", "left")
    info, info_path = materialise(info.select("cls", "copies", F.coalesce("least", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "info")  # read three times
    hot = info.where(F.col("copies") >= HOT_COPIES).select("cls", F.col("class_id").alias("hot_id"), F.col("n_links").alias("hot_links"))
    info = info.drop("copies")
    if hot.count() <= BROADCAST_ROWS:  # rows of a text of many copies stay where they are
        seen = sketched.select("doc_id", "cls").join(F.broadcast(hot), "cls", "left")
        cold = seen.where("hot_links is null").select("doc_id", "cls").join(info, "cls", "left")
        told = cold.unionByName(seen.where("hot_links is not null").select("doc_id", "cls", F.col("hot_id").alias("class_id"), F.col("hot_links").alias("n_links")))
    else:
        told = sketched.select("doc_id", "cls").join(info, "cls", "left")
    out = told.select("doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out, _ = materialise(out, "classed")
    discard(spark, sketch_path, class_path, group_path, placed_path, near_path, dealt_path, found_path, joined_path, info_path)
    return out


def _units():
    """The units that a class of a candidate group goes to, with its side: all of a small group are one unit."""
    sb, own = F.col("sb"), F.col("own")
    unit = lambda s, i, t, j: F.format_string("%d,%d,%d,%d", s, i, t, j)
    counted = lambda n: F.sequence(F.lit(0), n - 1)
    nothing = F.array().cast("array<struct<at:string,side:int>>")
    beside = lambda n, at, side: F.when(n.isNotNull(), F.transform(counted(n), lambda x: F.struct(at(x).alias("at"), F.lit(side).alias("side")))).otherwise(nothing)
    among = F.transform(counted(F.col("nb")), lambda x: F.struct(unit(sb, F.least(x, own), sb, F.greatest(x, own)).alias("at"), F.when(own > x, 1).otherwise(0).alias("side")))
    above = beside(F.col("above"), lambda x: unit(sb, own, sb + 1, x), 0)
    below = beside(F.col("below"), lambda x: unit(sb - 1, x, sb, own), 1)
    return F.when(F.col("nb").isNull(), F.array(F.struct(F.lit("all").alias("at"), F.lit(0).alias("side")))).otherwise(F.concat(among, above, below))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate group: the one whose doc_id is the least; all columns stay.

    Rows without words each stay. Rows that bear the same doc_id as the one that stays are told
    apart by a second pass over those few rows only; of rows alike in doc_id and text one stays.
    """
    head, row = unused(docs, "head"), unused(docs, "text_hash")
    joined = ngram_jaccard_join(docs, **options)
    own = F.col("doc_id").eqNullSafe(F.col("class_id"))
    told = joined.groupBy("doc_id").agg(F.count_if(own).alias("c"), F.max(F.when(own, F.col("n_links"))).alias("links"), F.count("*").alias("count"))
    sole = (F.col("c") == 1) & (F.col("count") == 1) | F.coalesce(F.col("links") == 0, F.lit(False))
    others, _ = materialise(told.where(~sole).select(F.col("doc_id").alias(head), (F.col("c") > 0).alias("many")), "others")  # as a rule fewer than those that stay
    many = others.where("many").select(head)
    once = docs.join(_small(others.select(head)), docs.doc_id.eqNullSafe(F.col(head)), "left_anti")
    if not many.limit(1).count():
        return once
    rest = docs.join(many, docs.doc_id.eqNullSafe(F.col(head)), "left_semi").withColumn(row, F.xxhash64("text"))
    return once.unionByName(rest.dropDuplicates(["doc_id", row]).drop(row))

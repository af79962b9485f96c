"""Benchmark decontamination: short test items found inside long documents."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise, mix64, shingle_hashes, slices, small_batches, unused, word_hashes
from .neardup import BROADCAST_ROWS, distinct_shingles

BLOCK_SHINGLES = 2_000_000
_U = np.uint64


def sketch_size(n: int, threshold: float) -> int:
    """Minima that an item of n shingles needs so that one of them is in any document that contains the threshold's share.

    Items are partitioned by size, in steps of a quarter; a partition's largest size sets the number.
    """
    upper = n if n < 4 else math.ceil(1.25 ** math.ceil(math.log(n) / math.log(1.25)))
    return min(n, upper - math.ceil(threshold * upper - 1e-9) + 1)


def item_sets(items: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, _ = distinct_shingles(*word_hashes(b.column("text")), width)
            ok = [i for i, x in enumerate(sets) if len(x)]
            yield pa.record_batch([b.column("item_id").take(pa.array(ok, pa.int64())), pa.array([len(sets[i]) for i in ok], pa.int32()), pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["item_id", "n", "sh"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, n int, sh binary")


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each item contained in a document.

    containment is the share of the item's distinct shingles of width words that the document has.
    Method: items are partitioned by size; each is sketched by as many bottom MinHash values as its
    partition needs for a certain hit at the threshold (with fewer than a fifth missing, one of the
    least fifth is there). Documents look each of their shingles up in that sketch index, so a long
    document needs no sketch of its own, in which a short item would vanish; hits are verified on
    the whole sets. The index goes to the executors in blocks of about BLOCK_SHINGLES shingles
    (16 MB). More items take more passes, one block after the other, each written before the next
    block is read, so driver and executors hold one block at a time.

    Null, empty and wordless texts neither contain nor are contained. An item of fewer words than
    width is one shingle of all its words, contained only in a text of just these words. Repeated
    rows of either table give repeated pairs. Empty tables give an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets, path = materialise(item_sets(items, width).groupBy("item_id", "n", "sh").agg(F.count("*").alias("copies")), "items")
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SHINGLES))
    passes = []
    for block in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "sh"), F.lit(blocks)) == block).collect()  # a block
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], [bytes(r.sh) for r in rows], [r.copies for r in rows]))
        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search(held, width, threshold), "doc_id long, item_id long, n_shingles long, n_shared long, copies long")
        if blocks > 1:
            found, _ = materialise(found, "contained")
            held.unpersist()
        passes.append(found)
    discard(spark, path)
    each = reduce(DataFrame.unionByName, passes).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def _search(held, width: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, copies = held.value
        if not ids:
            return
        full = [np.frombuffer(x, dtype=_U) for x in raw]
        least = []
        for x in full:
            order = np.argsort(mix64(x ^ _U(0x2545F4914F6CDD1D)))
            least.append(x[order[: sketch_size(len(x), threshold)]])
        keys = np.concatenate(least)
        owner = np.repeat(np.arange(len(full)), [len(x) for x in least])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        gate = np.zeros(1 << 20, dtype=bool)
        gate[(keys >> _U(44)).astype(np.int64)] = True
        for b in slices(batches, "text"):
            s, at = shingle_hashes(*word_hashes(b.column("text")), width)
            maybe = np.flatnonzero(gate[(s >> _U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, s[maybe], "left"), np.searchsorted(keys, s[maybe], "right")
            sure = hi > lo
            maybe, lo, hi = maybe[sure], lo[sure], hi[sure]
            out: list[tuple] = []
            doc_of = np.searchsorted(at, maybe, "right") - 1
            names = b.column("doc_id").to_pylist() if len(maybe) else []
            for d in np.unique(doc_of):
                mine = doc_of == d
                wanted = np.unique(np.concatenate([owner[x:y] for x, y in zip(lo[mine], hi[mine], strict=True)]))
                have = np.unique(s[at[d] : at[d + 1]])
                for i in wanted:
                    x = full[i]
                    place = np.minimum(np.searchsorted(have, x), len(have) - 1)
                    shared = int((have[place] == x).sum())
                    if shared + 1e-9 >= threshold * len(x):
                        out.append((names[d], ids[i], len(x), shared, copies[i]))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_shared", "copies"])

    return run


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that contain an item; all other rows and all columns stay as they are, null ids and repeated rows included."""
    hit = unused(docs, "hit")
    hits, _ = materialise(contained_items(docs, items, **options).select(F.col("doc_id").alias(hit)).distinct(), "leaks")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits  # an id each
    return docs.join(hits, docs.doc_id.eqNullSafe(F.col(hit)), "left_anti")

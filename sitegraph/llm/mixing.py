"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import materialise, slices, small_batches

BLOCK_DOCS = 1024
SECTIONS, ROUNDS = 32, 4
STEEPEST = 4.0
BROADCAST_ROWS = 200_000


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _hash(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose rows were counted and are few numbers and a name each."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_weights(sources: DataFrame, max_repeat: float, target_entropy: float | None = None) -> tuple[DataFrame, float]:
    """(sources with weight and repeats, exponent) for sources (src, tokens, docs).

    Shares are raised to an exponent and normalised. The exponent is bisected, in sections of
    SECTIONS at a time so that a few small aggregations suffice, to the least one at which no source
    is repeated more than max_repeat times and, if given, the weights' entropy (in nats) is at most
    target_entropy. The budget is the least at which each source is read once in full, so repeats
    are 1 for the source that is turned down most. Sources without tokens are read once. If no
    exponent up to STEEPEST meets both limits, that is an error.
    """
    if max_repeat < 1:
        raise ValueError("max_repeat is 1 at least, as every row is read once")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats")), 1.0
    p = F.col("tokens") / F.lit(float(total))
    able = sources.where("tokens > 0")
    low, high = 0.0, STEEPEST if target_entropy is not None else 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        up, less = F.pow(p, F.element_at("grid", F.col("i") + 1)), F.pow(p, F.element_at("grid", F.col("i") + 1) - 1)
        tried = able.withColumn("grid", F.array(*map(F.lit, grid))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))))
        r = sorted(tried.groupBy("i").agg(F.sum(up).alias("z"), F.sum(up * F.log(p)).alias("l"), F.max(less).alias("x"), F.min(less).alias("n")).collect())  # a row for each exponent
        entropy = [math.log(r[i]["z"]) - a * r[i]["l"] / r[i]["z"] for i, a in enumerate(grid)]
        fits = [r[i]["x"] / r[i]["n"] <= max_repeat * (1 + 1e-12) and (target_entropy is None or entropy[i] <= target_entropy + 1e-12) for i in range(len(grid))]
        if not any(fits):
            raise ValueError(f"no exponent up to {STEEPEST} gives an entropy of {target_entropy} within {max_repeat} repeats")
        k = fits.index(True)
        low, high = grid[max(0, k - 1)], grid[k]
    power = F.pow(p, F.lit(high - 1))
    r = able.agg(F.min(power), F.sum(F.pow(p, F.lit(high)))).first()
    weighed = sources.select("*", F.when(F.col("tokens") > 0, F.pow(p, F.lit(high)) / r[1]).otherwise(0.0).alias("weight"), F.when(F.col("tokens") > 0, F.greatest(power / r[0], F.lit(1.0))).otherwise(1.0).alias("repeats"))
    return weighed, high


def _counted(docs: DataFrame, tokenizer: str | None, seed: int) -> DataFrame:
    """doc_id, src, h, n_tokens of each row: ids of the tokenizer, or without one runs of non-space characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("src"), _hash(seed).alias("h"), text.alias("text"))
    if tokenizer is None:
        return keyed.select("doc_id", "src", "h", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens"))
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), b.column("src"), b.column("h"), pa.array(enc.counts(b.column("text").to_pylist()), pa.int64())], names=["doc_id", "src", "h", "n_tokens"])

    return keyed.mapInArrow(run, "doc_id long, src string, h long, n_tokens long")


def _permuted(sums: DataFrame, seed: int) -> DataFrame:
    """sums (src, block, held) with block_rank and end, the running sum of held, in each source's order of a hash.

    Blocks are range-partitioned by source and hash; what the partitions before hold is added, so a
    source of many blocks is spread over many tasks.
    """
    spark = sums.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = sums.withColumn("o", F.xxhash64("src", "block", F.lit(seed))).repartitionByRange(parts, "src", "o", "block")
    lined, _ = materialise(lined.withColumn("part", F.spark_partition_id()), "mix-order")
    by_part = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = lined.groupBy("src", "part").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    before = before.select("src", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("n_before"), F.coalesce(F.sum("held").over(by_part), F.lit(0)).alias("held_before"))
    order = Window.partitionBy("src", "part").orderBy("o", "block")
    ranked = lined.withColumns({"block_rank": F.row_number().over(order), "end": F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.join(_small(before), ["src", "part"]).withColumns({"block_rank": F.col("block_rank") + F.col("n_before"), "end": F.col("end") + F.col("held_before")}).drop("o", "part", "n_before", "held_before")


def _plan(docs: DataFrame, max_repeat: float, target_entropy: float | None, seed: int, tokenizer: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with block, sources with their number of blocks, blocks with what they get, documents of cut blocks that get one more)."""
    small, _ = materialise(_counted(docs, tokenizer, seed), "mix-docs")
    sources, _ = materialise(small.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-counts")
    sources, _ = materialise(source_weights(sources, max_repeat, target_entropy)[0], "mix-sources")
    lots = _small(sources.select("src", "tokens", "weight", "repeats", F.ceil(F.col("docs") / BLOCK_DOCS).alias("n_blocks")))
    placed = small.join(lots, "src").withColumn("block", F.pmod("h", "n_blocks"))
    sums = placed.groupBy("src", "block").agg(F.sum("n_tokens").alias("held"), F.first("repeats").alias("repeats"), F.first("tokens").alias("tokens"), F.first("weight").alias("weight"))
    sums = _permuted(sums, seed).withColumn("whole", F.floor("repeats"))
    budget = (F.col("repeats") - F.col("whole")) * F.col("tokens")
    sums = sums.withColumn("left", budget - (F.col("end") - F.col("held")))
    blocks, _ = materialise(sums.select("src", "block", "block_rank", "weight", "repeats", "whole", "left", (F.col("left") >= F.col("held")).alias("more"), ((F.col("left") > 0) & (F.col("left") < F.col("held"))).alias("cut")), "mix-blocks")
    within = Window.partitionBy("src", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    cut = _small(blocks.where("cut").select("src", "block", "left"))
    alike = placed.join(cut, ["src", "block"]).groupBy("src", "block", "left", "h").agg(F.sum("n_tokens").alias("n_tokens"))  # about BLOCK_DOCS hashes in a block
    extra = alike.withColumn("run", F.sum("n_tokens").over(within)).where("run <= left").select("src", "h", F.lit(True).alias("extra"))
    extra, _ = materialise(extra, "mix-extra")
    return placed, lots, blocks, extra


def _with_copies(rows: DataFrame, blocks: DataFrame, extra: DataFrame) -> DataFrame:
    out = rows.join(_small(blocks), ["src", "block"]).join(_small(extra), ["src", "h"], "left")
    return out.withColumn("copies", (F.col("whole") + F.when(F.col("more") | F.col("extra"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, max_repeat: float = 2.0, target_entropy: float | None = None, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight, repeats, copies, block, block_rank for each row of docs (doc_id, text, source).

    n_tokens counts the ids of a tokenizer file, or without one runs of non-space characters. weight
    is the source's share of the mixture, repeats how often it is read (see source_weights), copies
    how often this row is. A source's rows fall to blocks by hash; blocks are permuted by another
    hash (block_rank); all rows get the whole part of repeats, and the blocks first in the
    permutation one more, until the source's budget of tokens is used up; the block that the budget
    cuts goes row by row in the order of the hash.

    No row is lost: copies is 1 at least. A null source is the source of the empty name; null and
    empty texts have no tokens; long texts count whole; rows alike in doc_id and text get the same
    copies, null ids included. Sources of equal shares get equal weights. Other columns are ignored;
    an empty table gives an empty table.
    """
    placed, _, blocks, extra = _plan(docs, max_repeat, target_entropy, seed, tokenizer)
    rows = placed.select("doc_id", "h", "src", "block", "n_tokens")
    return _with_copies(rows, blocks, extra).select("doc_id", F.col("src").alias("source"), "n_tokens", "weight", "repeats", "copies", "block", "block_rank")


def mixed_rows(docs: DataFrame, max_repeat: float, target_entropy: float | None = None, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """docs with each row as many times as mix() says; all columns stay, whatever their names.

    Nulls, empty and long texts, repeated rows and empty tables are as in mix().
    """
    _, lots, blocks, extra = _plan(docs, max_repeat, target_entropy, seed, tokenizer)
    keyed = docs.select(F.struct("*").alias("row"), _source().alias("src"), _hash(seed).alias("h"))
    rows = keyed.join(lots.select("src", "n_blocks"), "src").withColumn("block", F.pmod("h", "n_blocks"))
    return _with_copies(rows, blocks, extra).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")

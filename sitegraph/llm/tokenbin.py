"""Binary shards of token ids with a minimal perfect hash index.

Format of a token folder (Parquet, so writes commit whole and any storage that Spark reaches will do):

  shards    by part; a row for each shard, in ascending order of (part, seq): n_docs, n_tokens, width
            (bytes of an id), doc_ids (int64), known (0 for a null doc_id), ends (int64, end of each
            document in ids of the shard), token_base (ids before it in the part), ids (the raw payload)
  parts     a row for each part: ids before it
  index     by shelf (neighbouring buckets); a row for each bucket of keys: n, seeds (int32 for each
            group of keys), prints (uint32 for each slot), part, seq, slot (where the key's first row
            lies), copies (its rows there), runs (shards that hold the key)
  more      doc_id, part, seq, slot, copies of the other shards of keys whose copies go on there
  meta      the number of buckets

Numbers in binary columns are little-endian. A key's bucket and group come from its hash, the group's
seed sends its keys to slots of their own, one for each key (hash and displace), and the stored
fingerprint tells keys that are not there. A few keys are found in the folders of their shelves and
parts alone; other folders are not listed or opened.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import materialise, mix64, shared_dir, slices, small_batches

SHARD_TOKENS = 1 << 20
SHARD_DOCS = 8192
PART_BYTES = 64 << 20
BUCKET_KEYS = 4096
SHELF_BUCKETS = 64
GROUP_KEYS = 4
FEW_KEYS = 10_000
BROADCAST_ROWS = 200_000
_U = np.uint64
_SHARD = "part int, seq int, n_docs int, n_tokens long, width int, doc_ids binary, known binary, ends binary, token_base long, ids binary"
_INDEX = "shelf long, bucket long, n int, seeds binary, prints binary, part binary, seq binary, slot binary, copies binary, runs binary"
_PLACES = ("part", "seq", "slot", "copies", "runs")
_ROWS = "part int, seq int, slot int, key long, start long, n_tokens long, ids_crc32 long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(tokenizer: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = enc.dtype.itemsize
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        token_base = 0
        keys: list = []
        sizes: list[int] = []
        held: list[bytes] = []
        n = 0

        def shard() -> pa.RecordBatch:
            row = [part, seq, len(keys), n, width, np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is not None for k in keys), np.cumsum(sizes, dtype="<i8").tobytes(), token_base, b"".join(held)]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=_names(_SHARD))

        for b in slices(batches, "text"):
            for k, x in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                keys.append(k)
                held += (x, end)
                sizes.append(len(x) // width + 1)
                n += sizes[-1]
                if n >= SHARD_TOKENS or len(keys) >= SHARD_DOCS:
                    yield shard()
                    seq, token_base = seq + 1, token_base + n
                    keys, sizes, held, n = [], [], [], 0
        if keys:
            yield shard()

    return run


@contextmanager
def _unsorted_folders(spark: SparkSession, n: int):
    """Let a task write n folders at once, so that rows which lie in order are not sorted again."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> str:
    """Encode docs (doc_id, text), end_id after each, and write shards, parts and index under path.

    Documents lie in ascending order of doc_id (nulls first), equal ids in the order of a hash of
    their texts. A part is about PART_BYTES of text, and at least the session's shuffle partitions
    are made; rows alike in doc_id and text may lie in several parts. A null text is empty and has
    its end id only. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"h": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(parts, "doc_id", "h", "spread").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with _unsorted_folders(spark, 2):
        ordered.mapInArrow(_pack(tokenizer, end_id), _SHARD).write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = shards(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before")).write.parquet(f"{path}/parts")
    write_index(spark, path)
    return path


def shards(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """Rows of the shards; those of a few parts from their folders alone."""
    reader = spark.read.schema(_SHARD)
    if parts is None:
        return reader.parquet(f"{path}/shards")
    return reader.option("basePath", f"{path}/shards").parquet(*[f"{path}/shards/part={p}" for p in parts])


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, seq, slot, copies of each run of equal ids in a shard."""
    for b in batches:
        for r in b.to_pylist():
            known = np.frombuffer(r["known"], np.uint8).astype(bool)
            slot = np.flatnonzero(known)
            keys = np.frombuffer(r["doc_ids"], "<i8")[slot]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            whole = lambda c: pa.array(np.full(len(head), r[c], np.int32))  # noqa: B023, E731
            yield pa.record_batch([pa.array(keys[head]), whole("part"), whole("seq"), pa.array(slot[head].astype(np.int32)), pa.array(np.diff(np.append(head, len(keys))).astype(np.int32))], names=["doc_id", "part", "seq", "slot", "copies"])


def _key_hash(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype("<i8").view(_U) + _U(0x632BE59BD9B4E019))


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each group, slot of each key): a minimal perfect hash of distinct keys.

    Groups are placed from the largest on; a group of one key takes any free slot, which its seed
    then names as -1 - slot.
    """
    n = len(keys)
    h = _key_hash(keys)
    groups = max(1, n // GROUP_KEYS)
    group = (h % _U(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, slots, taken = np.zeros(groups, np.int32), np.full(n, -1, np.int64), np.zeros(n, bool)
    sizes = np.diff(cuts)
    tries = np.arange(1, 257, dtype=np.uint64)
    free: list[int] | None = None
    for g in np.argsort(-sizes, kind="stable"):
        mine = order[cuts[g] : cuts[g + 1]]
        if not len(mine):
            continue
        if len(mine) == 1:
            if free is None:
                free = np.flatnonzero(~taken).tolist()
            slots[mine[0]] = free.pop()
            seeds[g] = -1 - slots[mine[0]]
            continue
        at = 0
        while True:
            d = tries + _U(at)
            spot = (mix64(h[mine][None, :] + d[:, None] * _U(0x9E3779B97F4A7C15)) % _U(n)).astype(np.int64)
            lined = np.sort(spot, axis=1)
            good = np.flatnonzero((lined[:, 1:] != lined[:, :-1]).all(axis=1) & ~taken[spot].any(axis=1))
            if len(good):
                seeds[g] = int(d[good[0]])
                slots[mine] = spot[good[0]]
                taken[slots[mine]] = True
                break
            at += len(tries)
    return seeds, slots


def find_slots(keys: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    h = _key_hash(keys)
    seed = seeds[(h % _U(len(seeds))).astype(np.int64)].astype(np.int64)
    spot = (mix64(h + seed.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(n)).astype(np.int64)
    return np.where(seed < 0, -1 - seed, spot)


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix64(_key_hash(keys) ^ _U(0xA24BAED4963EE407)) >> _U(32)).astype("<u4")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).withColumn("shelf", F.floor(F.col("bucket") / SHELF_BUCKETS))


def write_index(spark: SparkSession, path: str) -> None:
    entries = shards(spark, path).select("part", "seq", "doc_ids", "known").mapInArrow(_entries, "doc_id long, part int, seq int, slot int, copies int")
    keys = entries.groupBy("doc_id").agg(F.min(F.struct("part", "seq", "slot", "copies")).alias("at"), F.count("*").cast("int").alias("runs")).select("doc_id", "at.*", "runs")
    total = shards(spark, path).agg(F.sum(F.col("n_docs").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))
    spark.range(1).select(F.lit(buckets).cast("long").alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("doc_id").to_numpy()
        seeds, slots = build_mph(ids)
        back = np.argsort(slots)
        row = [t.column("shelf")[0].as_py(), t.column("bucket")[0].as_py(), len(ids), seeds.astype("<i4").tobytes(), prints(ids)[back].tobytes()] + [t.column(c).to_numpy()[back].astype("<i4").tobytes() for c in _PLACES]
        types = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 7
        return pa.table([pa.array([x], k) for x, k in zip(row, types, strict=True)], names=_names(_INDEX))

    shelves = -(-buckets // SHELF_BUCKETS)
    tasks = min(shelves, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 16)
    with _unsorted_folders(spark, 64):
        _bucketed(keys, buckets).repartition(tasks, "shelf").groupBy("shelf", "bucket").applyInArrow(build, _INDEX).write.partitionBy("shelf").parquet(f"{path}/index")
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the first run of each key that goes on in another shard lies."""
        for b in batches:
            for r in b.to_pylist():
                many = np.flatnonzero(np.frombuffer(r["runs"], "<i4") > 1)
                yield pa.record_batch([pa.array(np.frombuffer(r[c], "<i4")[many]) for c in ("part", "seq", "slot")], names=["part", "seq", "slot"])

    # at most one key goes on from a shard to the next, so these rows are no more than the shards
    first = index.select("runs", "part", "seq", "slot").mapInArrow(split, "part int, seq int, slot int")
    spread = entries.join(first, ["part", "seq", "slot"], "left_semi").select("doc_id")
    entries.join(spread, "doc_id", "left_semi").join(first, ["part", "seq", "slot"], "left_anti").select("doc_id", "part", "seq", "slot", "copies").write.parquet(f"{path}/more")


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, part, seq, slot, copies, runs of each distinct key of keys (doc_id) that the index holds.

    Up to FEW_KEYS keys open only the shelves that hold them.
    """
    buckets = spark.read.schema("buckets long").parquet(f"{path}/meta").first()[0]
    wanted, _ = materialise(_bucketed(keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct(), buckets), "keys")
    reader = spark.read.schema(_INDEX)
    if wanted.count() <= FEW_KEYS:
        held = _folders(spark, f"{path}/index", "shelf", [r[0] for r in wanted.select("shelf").distinct().collect()])
        index = reader.option("basePath", f"{path}/index").parquet(*held) if held else spark.createDataFrame([], _INDEX)
    else:
        index = reader.parquet(f"{path}/index")
    asked = wanted.groupBy("bucket").agg(F.collect_list("doc_id").alias("doc_ids")).join(index, "bucket")  # a bucket holds about BUCKET_KEYS keys

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.array(r["doc_ids"], dtype="<i8")
                slot = find_slots(ids, r["n"], np.frombuffer(r["seeds"], "<i4"))
                ok = np.frombuffer(r["prints"], "<u4")[slot] == prints(ids)
                yield pa.record_batch([pa.array(ids[ok]), *(pa.array(np.frombuffer(r[c], "<i4")[slot[ok]]) for c in _PLACES)], names=["doc_id", *_PLACES])

    return asked.select("doc_ids", "n", "seeds", "prints", *_PLACES).mapInArrow(run, "doc_id long, part int, seq int, slot int, copies int, runs int")


def _folders(spark: SparkSession, base: str, name: str, values: list[int]) -> list[str]:
    """Folders of these values that are there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for v in values:
        at = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}={v}")
        if at.getFileSystem(conf).exists(at):
            out.append(f"{base}/{name}={v}")
    return out


def _decode(with_ids: bool, wanted: bool):
    """Rows of _ROWS (and ids) of each document of a shard, or of those at its wanted slots."""
    names = _names(_ROWS) + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
                view = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                ends = view("ends", "<i8")
                slot = np.arange(get("n_docs"))
                if wanted:
                    slot = np.concatenate([np.arange(x["slot"], x["slot"] + x["copies"]) for x in get("runs")])
                starts = np.where(slot > 0, ends[slot - 1], 0)
                raw = view("ids", f"<u{get('width')}")
                found = [raw[x:y] for x, y in zip(starts.tolist(), ends[slot].tolist(), strict=True)]
                whole = lambda c: pa.array(np.full(len(slot), get(c), np.int32))  # noqa: B023, E731
                cols = [whole("part"), whole("seq"), pa.array(slot.astype(np.int32)), pa.array(view("doc_ids", "<i8")[slot], mask=view("known", np.uint8)[slot] == 0), pa.array(starts + get("token_base")), pa.array(ends[slot] - starts)]
                cols.append(pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()))
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names=names)

    return run


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows with start counted from the first part."""
    parts = spark.read.schema("part int, tokens_before long").parquet(f"{path}/parts")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    return rows.join(parts, "part").withColumn("start", F.col("start") + F.col("tokens_before")).drop("tokens_before")


def stored(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """part, seq, slot, key, start, n_tokens, ids_crc32 and, if wanted, ids of each document in the shards."""
    return _placed(spark, path, shards(spark, path).mapInArrow(_decode(with_ids, False), _ROWS + ", ids array<int>" * with_ids))


def fetch(spark: SparkSession, path: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every stored row of each key, found through the index.

    Up to FEW_KEYS places are cut out of the shards that hold them, read from the folders of their
    parts alone; more are joined to the rows of all shards by part, seq and slot.
    """
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    found, _ = materialise(locate(spark, path, keys), "found")
    rest = spark.read.schema("doc_id long, part int, seq int, slot int, copies int").parquet(f"{path}/more")
    spread = found.where("runs > 1").select("doc_id")
    runs = found.drop("runs").unionByName(rest.join(spread, "doc_id", "left_semi")) if spread.limit(1).count() else found.drop("runs")
    if runs.count() <= FEW_KEYS:
        parts = [r[0] for r in runs.select("part").distinct().collect()]
        if not parts:
            return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
        asked = runs.groupBy("part", "seq").agg(F.collect_list(F.struct("slot", "copies")).alias("runs"))
        held = shards(spark, path, parts).join(F.broadcast(asked), ["part", "seq"])  # FEW_KEYS rows at most
        rows = _placed(spark, path, held.mapInArrow(_decode(with_ids, True), _ROWS + ", ids array<int>" * with_ids))
        return rows.withColumnRenamed("key", "doc_id").select(*columns)
    places = runs.select("doc_id", "part", "seq", F.explode(F.sequence("slot", F.col("slot") + F.col("copies") - 1)).alias("slot"))
    return stored(spark, path, with_ids).drop("key").join(places, ["part", "seq", "slot"]).select(*columns)


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each row of docs, read back from the files through the index.

    Rows without a doc_id have no key; they are read in the order they lie in. Repeated ids give a
    row each. Null and empty texts have n_tokens 1 (the end id). An empty table gives an empty table.
    """
    spark = docs.sparkSession
    path = write_tokens(docs, tokenizer, path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", end_id)
    keyed = fetch(spark, path, docs.select("doc_id"))
    keyless = stored(spark, path).where("key is null").select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
    return keyed.unionByName(keyless) if docs.where("doc_id is null").limit(1).count() else keyed

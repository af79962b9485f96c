"""Toxicity by compression distance with two zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, held_out, materialise, slices, small_batches, word_spans

WINDOW_WORDS = 8
SAMPLE = {1: 4000, 0: 6000}
SAMPLE_WORDS = 1000
ORDINARY_BYTES, TOXIC_BYTES = 1 << 20, 20 << 10
TABLE_LOG = 20
THRESHOLD = 0.3
MARK = b" \x01\x02"
GAINS = (2, 3, 4, 5, 6)
_FEATURES = ("windows", *(f"gain_{g}" for g in GAINS), "total", "most")


@dataclass
class Dictionaries:
    """What zstandard trained on ordinary and on toxic text.

    Windows are compressed with the ordinary dictionary, and with the toxic one set before it. As
    the ordinary part lies at the same distance in both, lengths differ only where toxic text matches.
    """

    ordinary: bytes
    toxic: bytes
    _made: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic

    def __setstate__(self, state: tuple) -> None:
        self.ordinary, self.toxic = state
        self._made = None

    def lengths(self, raw: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import zstandard as z

        if self._made is None:
            size = max(15, (len(self.toxic) + len(self.ordinary)).bit_length() + 1)
            log = min(size, TABLE_LOG)
            p = z.ZstdCompressionParameters(window_log=size, chain_log=log, hash_log=log, search_log=4, min_match=6, target_length=32, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            made = []
            for x in (self.ordinary, self.toxic + self.ordinary):
                d = z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                made.append(z.ZstdCompressor(dict_data=d, compression_params=p))
            self._made = tuple(made)
        held = z.BufferWithSegments(raw, spans.astype("=u8").tobytes())
        out = []
        for c in self._made:
            got = c.multi_compress_to_buffer(held)
            out.append(np.fromiter((len(got[i]) for i in range(len(got))), dtype=np.int64, count=len(got)))
        return out[0], out[1]


def _marked(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, each after MARK; start and end of each with its mark): a match at the head of a word is longer than one inside."""
    size = (ends - starts).astype(np.int32)
    whole = size + len(MARK)
    last = np.cumsum(whole, dtype=np.int64)
    first = last - whole
    out = np.empty(int(last[-1]) if len(last) else 0, dtype=np.uint8)
    for k, c in enumerate(MARK):
        out[first + k] = c
    before = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
    step = np.arange(int(size.sum()), dtype=np.int32)
    out[np.repeat(first.astype(np.int32) + len(MARK) - before, size) + step] = raw[np.repeat(starts.astype(np.int32) - before, size) + step]
    return out, first, last


def _windows(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset and length of each window of WINDOW_WORDS words, number of windows of each text)."""
    counts = np.diff(bounds)
    n = -(-counts // WINDOW_WORDS)
    at = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    first = bounds[:-1][text] + (np.arange(at[-1]) - at[:-1][text]) * WINDOW_WORDS
    last = np.minimum(first + WINDOW_WORDS, bounds[1:][text]) - 1
    return np.stack([starts[first], ends[last] - starts[first]], axis=1) if len(first) else np.zeros((0, 2), np.int64), n


def _measure(d: Dictionaries):
    """Maps (text, other columns) to the other columns and the features of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            *words, bounds = word_spans(b.column("text"))
            raw, starts, ends = _marked(*words)
            spans, n = _windows(starts, ends, bounds)
            text = np.repeat(np.arange(len(n)), n)
            gain = np.zeros(len(spans))
            if len(spans):
                plain, toxic = d.lengths(raw.tobytes(), spans)
                gain = (plain - toxic).astype(float)
            most = np.zeros(len(n))
            np.maximum.at(most, text, gain)
            sums = [np.bincount(text, w, minlength=len(n)) for w in (*((gain >= g).astype(float) for g in GAINS), np.maximum(gain, 0))]
            others = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(x.astype(float)) for x in (n, *sums, most)], names=[*others, *_FEATURES])

    return run


def measured(rows: DataFrame, d: Dictionaries) -> DataFrame:
    others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_measure(d), others + "".join(f", {c} double" for c in _FEATURES))


def _design(x: np.ndarray) -> np.ndarray:
    windows, *gained, total, most = x.T
    shares = [np.log1p(100 * g / (windows + 4)) for g in gained]
    return np.stack([np.ones(len(x)), np.minimum(most, 12) / 4, *map(np.log1p, gained), np.log1p(total), *shares, np.log1p(windows)], axis=1)


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]]
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(np.r_[1e-6, np.full(len(w) - 1, ridge)])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of what samples have in common; their beginnings, where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(rows: list[tuple[int, bytes]]) -> Dictionaries:
    """From (toxic, distinct words after marks) of each document: a document counts once for what it holds."""
    ordinary = train([x for toxic, x in rows if not toxic and x], ORDINARY_BYTES)
    return Dictionaries(ordinary or b" " * 8, train([x for toxic, x in rows if toxic and x], TOXIC_BYTES))


@dataclass
class Model:
    dictionaries: Dictionaries
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out.

    The sample is bounded: SAMPLE[1] toxic and SAMPLE[0] ordinary documents, the first by a hash of
    doc_id, equal texts once (toxic if one is), and of each the SAMPLE_WORDS distinct words at most
    that come first by a hash. zstandard trains a dictionary on the words of the toxic documents and
    another on those of the ordinary ones. The thresholds are calibrated by a logistic curve over
    window gains that each half of the sample has under dictionaries of the other half, weighted to
    the classes' shares among all labelled rows.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    hashed = usable.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    chosen = hashed.where("toxic = 1").orderBy("h").limit(SAMPLE[1]).union(hashed.where("toxic = 0").orderBy("h").limit(SAMPLE[0]))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(chosen), "doc_id")  # the sample's ids
    rows = rows.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    rows = rows.groupBy(F.xxhash64("text").alias("same")).agg(F.max("toxic").alias("toxic"), F.min("h").alias("h"), F.min("text").alias("text"))
    sample, path = materialise(rows.select("h", "toxic", "text", F.pmod(F.xxhash64("h", F.lit(5)), F.lit(2)).cast("int").alias("fold")), "toxic-sample")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^0-9a-z_\x{80}-\x{10FFFF}]+"), lambda w: w != ""))
    some = F.slice(F.array_sort(F.transform(words, lambda w: F.struct(F.crc32(w.cast("binary")).alias("c"), w.alias("w")))), 1, SAMPLE_WORDS)
    marked = F.transform(some, lambda x: F.concat(F.lit(MARK.decode()), x["w"]))
    held = sample.select("h", "toxic", "fold", F.array_join(marked, "").cast("binary").alias("words")).orderBy("h").collect()  # a few kilobytes for each document of the sample
    known = [(r["fold"], r["toxic"], bytes(r["words"])) for r in held]
    del held
    got, classes = [], []
    for fold in (0, 1):
        d = dictionaries([(t, x) for f, t, x in known if f != fold])
        part = measured(sample.where(F.col("fold") == fold).select("toxic", "text"), d).collect()  # numbers for each document of the sample
        got += [[r[c] for c in _FEATURES] for r in part]
        classes += [r["toxic"] for r in part]
    discard(docs.sparkSession, path)
    final = dictionaries([(t, x) for _, t, x in known])
    y = np.array(classes, dtype=float)
    if not len(y) or y.min() == y.max():  # one class only: its share
        w = np.zeros(_design(np.zeros((1, len(_FEATURES)))).shape[1])
        w[0] = 4.0 if len(y) and y[0] == 1 else -4.0
        return Model(final, w)
    total = sum(share.values())
    weight = np.where(y == 1, share.get(1, 0) / total / (y == 1).mean(), share.get(0, 0) / total / (y == 0).mean())
    return Model(final, _logistic(_design(np.array(got)), y, weight))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Each window of WINDOW_WORDS words of the whole text, each word after a mark, is compressed with both dictionaries; the
    bytes that the toxic one saves are counted, and the calibrated curve makes them a score from 0
    to 1. predicted is 1 from THRESHOLD on. Null, empty and wordless texts have the score of a text
    without windows; long texts are scored whole. Repeated rows and null ids stay (a null id is not held out and not learnt
    from); repeated labels of an id count as toxic if one is. Without labels every score is low.
    Other columns are ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    weights = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _measure(weights.dictionaries)(batches):
            x = np.stack([b.column(c).to_numpy() for c in _FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(weights.score(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

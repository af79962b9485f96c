"""Transcript parsing: roles by a hidden Markov model, then canonical turns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, small_batches

ROLES = ("system", "user", "assistant")
CHUNK = 256
#: What names of speakers stand for.
NAMES = {"system": "system", "sys": "system", "user": "user", "human": "user", "customer": "user", "client": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "model": "assistant", "a": "assistant"}
_SPEAKER = r"[ \t]*(?:\*\*|\[|<\|?)?(?i:(%s))(?:\*\*|\]|\|?>)?[ \t]*:[ \t]*"
MARKER = r"^\s*" + _SPEAKER % "|".join(NAMES)
NEXT_TURN = r"\r?\n(?=" + _SPEAKER.replace("(%s)", "(?:%s)") % "|".join(NAMES) + ")"
#: How far the role column and a marker are to be believed, in rows for and against, before any row is seen.
COLUMN_PRIOR, MARKER_PRIOR = (96.0, 4.0), (90.0, 10.0)
LENGTHS = 16
_ORDER = ["conv_id", "turn", "role", "h", "line"]


@dataclass
class Model:
    """Log probabilities: the first role, role after role, a line's shape in a role, and what a named or marked role says."""

    start: np.ndarray
    step: np.ndarray
    shape: np.ndarray
    given: np.ndarray
    marked: np.ndarray

    def line(self, given: int, marked: int, shape: int) -> np.ndarray:
        out = self.shape[:, shape].copy()
        if given >= 0:
            out += self.given[:, given]
        if marked >= 0:
            out += self.marked[:, marked]
        return out


def _role_number(name) -> F.Column:
    out = F.lit(-1)
    for k, v in NAMES.items():
        out = F.when(F.lower(F.trim(name)) == k, ROLES.index(v)).otherwise(out)
    return F.coalesce(out, F.lit(-1)).cast("int")


def _features(turns: DataFrame) -> DataFrame:
    """A row for each turn that a text holds: texts are cut before every line that begins with a speaker marker.

    The role column speaks for the first of them, where that has no marker of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, NEXT_TURN, -1)).alias("line", "text"))
    body = F.col("text")
    marked = _role_number(F.regexp_extract(body, MARKER, 1))
    return rows.select(
        "conv_id", "turn", "role", "h", "line", "text",
        F.when(F.col("line") == 0, _role_number(F.col("role"))).otherwise(-1).alias("given"), marked.alias("marked"),
        (F.least(F.floor(F.log2(F.length(body) + 1.0)), F.lit(LENGTHS - 1)) * 2 + F.when(F.rtrim(body).endswith("?"), 1).otherwise(0)).cast("int").alias("shape"),
    )


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds chunk: sorted rows of a conversation fall into chunks of CHUNK rows, numbered upwards over all partitions."""
    base, seq, n, now = TaskContext.get().partitionId() << 40, -1, 0, object()
    for b in batches:
        out = np.empty(b.num_rows, dtype=np.int64)
        for i, c in enumerate(b.column("conv_id").to_pylist()):
            if c != now or n == CHUNK:
                now, n, seq = c, 0, seq + 1
            n += 1
            out[i] = base + seq
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "chunk"])


def _normal(counts: np.ndarray) -> np.ndarray:
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def fit(lines: DataFrame) -> Model:
    """Count the model over all lines whose role the column or a marker names; every count starts at one.

    Steps and starts are counted within chunks, a start where a chunk begins a conversation; markers
    are held against the column where a line has both.
    """
    known = F.when(F.col("given") >= 0, F.col("given")).when(F.col("marked") >= 0, F.col("marked"))
    order = Window.partitionBy("chunk").orderBy("turn", "role", "h", "line")
    seen = lines.select("conv_id", "chunk", "given", "marked", "shape", known.alias("known"), F.lag(known).over(order).alias("before"), F.row_number().over(order).alias("r"))
    shape, step, marked = np.ones((3, 2 * LENGTHS)), np.ones((3, 3)), np.full((3, 3), MARKER_PRIOR[1] / 2)
    np.fill_diagonal(marked, MARKER_PRIOR[0])
    for r in seen.groupBy("given", "marked", "known", "before", "shape").count().collect():  # a few values each
        if r["known"] is not None:
            shape[r["known"], r["shape"]] += r["count"]
            if r["before"] is not None:
                step[r["before"], r["known"]] += r["count"]
        if r["given"] >= 0 and r["marked"] >= 0:
            marked[r["given"], r["marked"]] += r["count"]
    first = lines.groupBy("conv_id").agg(F.min("chunk").alias("chunk"))
    start = np.ones(3)
    for r in seen.where("r = 1 and known is not null").join(first.select("chunk"), "chunk", "left_semi").groupBy("known").count().collect():
        start[r["known"]] += r["count"]
    given = np.full((3, 3), COLUMN_PRIOR[1] / 2)
    np.fill_diagonal(given, COLUMN_PRIOR[0])
    return Model(_normal(start), _normal(step), _normal(shape), _normal(given), _normal(marked))


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows alike in keys, from sorted rows."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[c] for c in keys)
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(r)
    if held:
        yield now, held


def format_turns(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """conv_id, turn, line, given_role, role, rendered for each turn that the texts of turns (conv_id, turn, role, text) hold.

    A text is one turn (line 0), or several if lines inside it begin with speaker markers. The
    hidden states are ROLES; a turn shows the role column (its first one only), a speaker marker at
    its head, its length and whether it asks. Viterbi finds the likeliest roles of a conversation in
    the order of turn (nulls first, ties by role and text). Roles of other names are recovered like
    missing ones. rendered is the canonical turn: <|role|>, the text without its speaker marker,
    <|end|>; a "<|" inside becomes "<\\|".

    Conversations are sorted over all tasks and cut into chunks of CHUNK turns, however many turns
    bear one number: each chunk gives a matrix of best scores from state to state, the matrices of a
    conversation are chained (nine numbers for CHUNK turns), and each chunk is then decoded between
    the states that the chain sets. Null texts are empty; long texts are read whole; null conv_ids
    are one conversation; repeated rows stay. Other columns are ignored; an empty table gives an
    empty table.
    """
    spark = turns.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "conv_id long, turn long, role string, h long, line int, text string, given int, marked int, shape int, chunk long"
    lined = _features(turns).repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_numbered, schema)
    lined, _ = materialise(lined, "chat-lines")
    model = model or fit(lined)

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (chunk,), held in _grouped(batches, ["chunk"]):
            m = np.full((3, 3), -math.inf)
            np.fill_diagonal(m, 0.0)
            lines = [model.line(r["given"], r["marked"], r["shape"]) for r in held]
            for e in lines[1:]:
                m = (m[:, :, None] + model.step[None]).max(axis=1) + e[None, :]
            out.append((held[0]["conv_id"], chunk, (lines[0][:, None] + m).ravel().tolist()))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["conv_id", "chunk", "m"])

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, held in _grouped(batches, ["conv_id"]):
            score, back = None, []
            for r in held:
                m = np.array(r["m"]).reshape(3, 3)  # first state in the chunk, last state
                into = model.start if score is None else (score[:, None] + model.step).max(axis=0)
                before = np.full(3, -1) if score is None else (score[:, None] + model.step).argmax(axis=0)
                back.append(((into[:, None] + m).argmax(axis=0), before))
                score = (into[:, None] + m).max(axis=0)
            last = int(score.argmax())
            for r, (heads, before) in zip(reversed(held), reversed(back), strict=True):
                head = int(heads[last])
                out.append((r["chunk"], head, last))
                last = int(before[head])
            if len(out) >= 4096:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["chunk", "head", "tail"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["chunk", "head", "tail"])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "line", "given_role", "state", "marked", "text"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for _, held in _grouped(batches, ["chunk"]):
            score = np.full(3, -math.inf)
            score[held[0]["head"]] = 0.0
            back = []
            for r in held[1:]:
                step = score[:, None] + model.step
                back.append(step.argmax(axis=0))
                score = step.max(axis=0) + model.line(r["given"], r["marked"], r["shape"])
            path = [int(held[0]["tail"])]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            data = [[r[c] for r in held] for c in ("conv_id", "turn", "line", "role")] + [path[::-1]] + [[r[c] for r in held] for c in ("marked", "text")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(data, types, strict=True)], names=names)

    sorted_chunks = lambda df: df.repartition("chunk").sortWithinPartitions("chunk", "turn", "role", "h", "line")
    scores, _ = materialise(sorted_chunks(lined.drop("text")).mapInArrow(matrices, "conv_id long, chunk long, m array<double>"), "chat-chunks")
    ends, _ = materialise(scores.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(chain, "chunk long, head long, tail long"), "chat-ends")
    told = sorted_chunks(lined.join(ends, "chunk")).mapInArrow(decode, "conv_id long, turn long, line int, given_role string, state int, marked int, text string")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("state") + 1)
    body = F.replace(F.when(F.col("marked") >= 0, F.regexp_replace("text", MARKER, "")).otherwise(F.col("text")), F.lit("<|"), F.lit("<\\|"))
    return told.select("conv_id", "turn", "line", "given_role", role.alias("role"), F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("<|end|>\n")).alias("rendered"))

"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import held_out, materialise, slices, small_batches, span_hashes, unused, word_spans

SAMPLE_DOCS = 400
SAMPLE_WORDS = 30_000
LANGS = 256
LEARNT_RUN = 24
ROUNDS = 3
UNSEEN = 1e-8
_MARK = 0x2581
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Lowercased pieces of a SentencePiece file that hold a letter; the mark of a word's start counts."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {m.id_to_piece(i).lower() for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    return sorted(p for p in out if any(c.isalpha() for c in p) and "▁" not in p[1:])


def _codes(words: list[str], mark: str = "▁") -> np.ndarray:
    """Code points of words of one length, each after the mark of a start."""
    return np.frombuffer("".join(mark + w for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


@dataclass
class Pieces:
    """Finds pieces by hashes of their code points."""

    names: list[str]
    _table: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> list[str]:
        return self.names

    def __setstate__(self, names: list[str]) -> None:
        self.names, self._table = names, None

    def _tables(self) -> tuple:
        if self._table is None:
            keys = np.zeros(len(self.names), dtype=_U)
            for n, p in enumerate(self.names):
                h = 0
                for c in p:
                    h = ((h + ord(c) + 1) * int(_MULT)) & 0xFFFFFFFFFFFFFFFF
                keys[n] = h
            order = np.argsort(keys)
            gate = np.zeros(1 << 18, dtype=bool)
            gate[(keys >> _U(46)).astype(np.int64)] = True
            self._table = keys[order], order, gate
        return self._table

    @property
    def longest(self) -> int:
        return max(map(len, self.names), default=1)

    def find(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 on, the piece that ends at each position of each word, or -1."""
        keys, order, gate = self._tables()
        n, width = codes.shape
        out = []
        wide = codes.astype(_U) + _U(1)
        h = np.zeros((n, width), dtype=_U)
        for size in range(1, min(self.longest, width) + 1):
            h = (h[:, : width - size + 1] + wide[:, size - 1 :]) * _MULT
            piece = np.full((n, width), -1, dtype=np.int32)
            maybe = np.nonzero(gate[(h >> _U(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            ok = keys[at] == h[maybe]
            piece[maybe[0][ok], maybe[1][ok] + size - 1] = order[at[ok]]
            out.append(piece)
        return out


@dataclass
class Model:
    """langs, pieces and probs: a row for each piece and a last one for characters without a piece; a column for each language."""

    langs: list[str]
    pieces: Pieces
    probs: np.ndarray

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language: the forward sum over its segmentations."""
        out = np.empty((len(words), len(self.langs)))
        lengths = np.array([len(w) for w in words])
        for width in np.unique(lengths):
            mine = np.flatnonzero(lengths == width)
            step = max(1, 400_000 // (int(width) + 1))
            for a in range(0, len(mine), step):
                part = mine[a : a + step]
                out[part] = self._forward(self.pieces.find(_codes([words[i] for i in part])))[0]
        return out

    def _forward(self, found: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        n, width = found[0].shape
        none, longest = len(self.pieces.names), len(found)
        ring = [np.ones((n, len(self.langs)))]
        shift = np.zeros((n, len(self.langs)))
        for j in range(width):
            total = ring[-1] * self.probs[np.where(found[0][:, j] >= 0, found[0][:, j], none)]
            for size in range(2, min(len(found), j + 1) + 1):
                piece = found[size - 1][:, j]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    total[hit] += ring[-size][hit] * self.probs[piece[hit]]
            ring = [*ring[1 - longest :], total] if longest > 1 else [total]
            if j % 8 == 7:
                scale = np.maximum(total, 1e-280)
                ring = [r / scale for r in ring]
                shift += np.log(scale)
        return np.log(np.maximum(ring[-1], 1e-300)) + shift, ring, shift


def _learn(pieces: Pieces, counts: dict[str, dict[str, int]]) -> Model:
    """Expected counts of pieces over all segmentations, a few rounds for each language."""
    langs = sorted(counts)
    none = len(pieces.names)
    probs = np.full((none + 1, max(1, len(langs))), UNSEEN)
    for lang, words in counts.items():
        k = langs.index(lang)
        p = np.full(none + 1, 1.0 / none)
        p[none] = UNSEEN
        by_width: dict[tuple[str, int], list[tuple[str, int]]] = {}
        for w, c in words.items():
            for a in range(0, len(w), LEARNT_RUN):
                part = w[a : a + LEARNT_RUN]
                by_width.setdefault(("" if a else "▁", len(part)), []).append((part, c))
        groups = [(pieces.find(_codes([w for w, _ in x], mark)), np.array([c for _, c in x], dtype=float)) for (mark, _), x in by_width.items()]
        for _ in range(ROUNDS):
            got = np.full(none + 1, 1e-3)
            for found, weight in groups:
                n, width = found[0].shape
                q = [p[np.where(f >= 0, f, none)] * ((f >= 0) | (s == 0)) for s, f in enumerate(found)]
                fore = np.zeros((width + 1, n))
                fore[0] = 1
                for j in range(width):
                    for s in range(min(len(found), j + 1)):
                        fore[j + 1] += fore[j - s] * q[s][:, j]
                back = np.zeros((width + 1, n))
                back[width] = 1
                for j in range(width - 1, -1, -1):
                    for s in range(min(len(found), width - j)):
                        back[j] += back[j + s + 1] * q[s][:, j + s]
                total = np.maximum(fore[width], 1e-300)
                for s, f in enumerate(found):
                    for j in range(s, width):
                        share = weight * fore[j - s] * q[s][:, j] * back[j + 1] / total
                        np.add.at(got, np.where(f[:, j] >= 0, f[:, j], none), share)
            p = got / got.sum()
            p[none] = UNSEEN
        probs[:, k] = p
    return Model(langs, pieces, probs)


def fit(docs: DataFrame, vocabulary_path: str) -> Model:
    """Learn from rows with a lang and a text that are not held out.

    The sample is bounded: the first SAMPLE_DOCS documents of each language by a hash of doc_id, and
    of their words the SAMPLE_WORDS most frequent; documents are chosen before any text is read.
    Words of more than LEARNT_RUN letters are learnt in pieces of that length. More than LANGS
    languages are an error, as their words come to the driver.
    """
    able = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counted = able.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGS + 1).collect()
    if len(counted) > LANGS:
        raise ValueError(f"more than {LANGS} languages to learn")
    if not counted:
        return _learn(Pieces(vocabulary(vocabulary_path)), {})
    n = F.element_at(F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], r["n"])]), F.col("lang"))
    near = F.col("h") / float(1 << 30) * n < 4 * SAMPLE_DOCS  # about four times the sample is ranked, not all rows
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = able.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))).where(near).distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_DOCS).select("doc_id", "lang")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).join(F.broadcast(chosen), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one text of a repeated id
    words = texts.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    ranked = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    kept, _ = materialise(words.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= SAMPLE_WORDS).drop("r"), "lang-words")
    counts: dict[str, dict[str, int]] = {}
    for r in kept.collect():
        counts.setdefault(r["lang"], {})[r["word"]] = r["count"]
    return _learn(Pieces(vocabulary(vocabulary_path)), counts)


def _scorer(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, starts, ends, bounds = word_spans(b.column("text"))
            total = np.zeros((b.num_rows, len(model.langs)))
            counts = np.diff(bounds)
            if len(starts) and model.langs:
                _, where, code = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                data = raw.tobytes()
                names = [data[x:y].decode() for x, y in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
                logs = model.log_words(names)
                text = np.repeat(np.arange(b.num_rows), counts)
                for k in range(len(model.langs)):
                    total[:, k] = np.bincount(text, logs[code, k], minlength=b.num_rows)
            letters = b.column("letters").to_pylist()
            langs, scores = [], []
            for i in range(b.num_rows):
                if not letters[i] or not counts[i] or not model.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total[i]))
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(np.minimum(total[i] - total[i, best], 0)).sum()))
            yield pa.record_batch([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def identify(docs: DataFrame, vocabulary_path: str, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text; lang to learn from).

    A text's likelihood in a language is the product over its words of the word's probability: the
    sum over all segmentations of the word, after a mark of its start, into vocabulary pieces (the
    forward algorithm); score is the best language's share under equal priors. und with score 0:
    null texts, texts without a letter, and all texts if nothing could be learnt. Ties go to the
    least lang. Repeated rows and null ids stay (a null id is not held out and not learnt from);
    other columns are ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, vocabulary_path)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = rows.mapInArrow(_scorer(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary_path: str, min_score: float = 0.5) -> DataFrame:
    """docs without the rows whose language can't be told or whose score is below min_score; columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(docs, vocabulary_path)
    schema = docs.schema
    score = _scorer(model)
    letters = unused(docs, "letters")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            judged = next(iter(score([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column("text"), b.column(letters)], names=["doc_id", "text", "letters"])])), None)
            ok = [i for i, (x, y) in enumerate(zip(judged.column("lang_pred").to_pylist(), judged.column("score").to_pylist(), strict=True)) if x != "und" and y >= min_score]
            yield b.select([c for c in b.schema.names if c != letters]).take(pa.array(ok, pa.int64()))

    return docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)

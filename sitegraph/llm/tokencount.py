"""Token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import SPLIT_CHARS, encoder
from ._shared import slices, small_batches


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = SPLIT_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    n_tokens is what the tokenizers library gives for the whole text, without added special tokens.
    Texts over chunk characters are encoded in overlapping chunks, spliced at cuts that both sides
    prove (see Encoder.count_spliced); others at once. Null and empty texts have no bytes or tokens.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches, "text"):
            n = enc.counts(b.column("text").to_pylist(), chunk)
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from sitegraph.llm._shared import materialise
from tests.llm.test_operators import linked, shingles


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [d for d, r in rows.items() if any(c.isalpha() for c in r.text)]
    groups = linked([(d, rows[d].text) for d in kept])
    heads = {d for d, least, _ in groups if d == least}
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d in heads if not any(len(x & shingles(rows[d].text)) >= 0.8 * len(x) - 1e-9 for x in items if x)}
    want = [set(kept), heads, clean]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        got = Counter(r.doc_id for r in docs.collect())
        assert set(got) == want[min(k, 2)]
        assert max(got.values()) == 1 or k == 3 and max(got.values()) == 2
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for d, n in got.items():
        ids = lib.encode(rows[d].text, add_special_tokens=False).ids + [1]
        expected[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == expected
    assert corpus_pipeline.run(spark, sf).count() == len(out)


CLASHES = ("src", "block", "copies", "head", "hit", "_letters", "weight", "left", "n_blocks", "text_hash", "row", "h", "copy", "cls", "node", "key", "part", "seq", "slot", "bucket", "spread", "extra", "count", "Head", "HIT_")


def test_stages_keep_columns_of_any_name(spark, sf, odd):
    docs = odd.drop("cls", "count")
    for k, c in enumerate(dict.fromkeys(c.lower() for c in CLASHES)):
        docs = docs.withColumn(c, F.lit(f"keep{k}"))
    want = {c: f"keep{k}" for k, c in enumerate(dict.fromkeys(c.lower() for c in CLASHES))}
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows, _ = materialise(stage(spark, rows, sf), name)
            assert rows.columns == docs.columns
            assert all(r[c] == v for r in rows.collect() for c, v in want.items())
        got = corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows.collect())
    assert not got

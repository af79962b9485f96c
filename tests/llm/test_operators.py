import hashlib
import itertools
import re
import shutil
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegraph.llm import chat, decontam, langid, mixing, neardup, secrets, tokenbin, tokencount, topk, toxicity
from sitegraph.llm._bpe import Encoder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def shingles(text):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    n, group = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
            n[i] += 1
            n[j] += 1
            group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, least.get(root(i)), n[i]) for i, (d, _) in enumerate(rows))


def test_join_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert Counter(map(tuple, neardup.ngram_jaccard_join(documents).collect())) == linked(rows)


def test_join_of_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 4)):
            w[k] = f"z{rng.integers(0, 9)}"
        rows.append((i, " ".join(w[: 80 - int(rng.integers(0, 25))])))
    monkeypatch.setattr(neardup, "UNIT_CLASSES", 10)
    got = neardup.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == linked(rows)


def test_join_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert Counter(map(tuple, neardup.ngram_jaccard_join(odd).collect())) == linked(rows)
    assert neardup.ngram_jaccard_join(odd.limit(0)).count() == 0
    kept = neardup.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect() if r.text and shingles(r.text)) == ["1", "4", "6", "7", "None"]


def test_prefixes_are_shortened_until_the_recall_is_met():
    target = neardup.TARGET_RECALL
    for n in (1, 3, 4, 5, 6, 7, 8, 9, 20, 64, 65, 10_000):
        k = neardup.matched_prefix(n, 0.8, target)
        pairs = [i / u for i in range(1, min(n, 200) + 1) for u in range(n, 2 * n) if 0.8 <= i / u < 1]
        worst = min(pairs, default=1.0) if n <= 200 else 0.8
        assert neardup.recall(worst, k) >= target and (k == neardup.DEPTH or neardup.recall(min(worst, 0.8) if n > 64 else worst, k + 1) < target)
    assert neardup.matched_prefix(1000, 0.8, target) == 5 and neardup.matched_prefix(7, 0.8, target) == 7 and neardup.matched_prefix(3, 0.8, target) == 8


def test_forest_finds_every_pair_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(600):
        w = [f"a{k}x{x}" for x in rng.integers(0, 10**9, 49)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:44], *(f"b{k}x{x}" for x in rng.integers(0, 10**9, 5))]))]  # 40 of 50 shingles are shared
    got = neardup.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_links = 1 and class_id = doc_id - doc_id % 2").count() == 1200


def test_join_of_repeated_rows_and_low_thresholds(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text)] * 300 + [(8, text + " more")] * 5
    got = neardup.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == linked(rows)
    with pytest.raises(ValueError):
        neardup.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.3)


def test_containment(spark, documents, sf, odd):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    held = {r.item_id: shingles(r.text) for r in items.collect()}
    for r in documents.collect():
        s = shingles(r.text)
        want |= {(r.doc_id, i, len(x), len(x & s)) for i, x in held.items() if x and len(x & s) >= 0.8 * len(x) - 1e-9}
    got = decontam.contained_items(documents, items)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == want and want
    few = spark.createDataFrame([(1, "beta gamma delta epsilon zeta"), (2, None), (3, ""), (3, "short")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contained_items(odd, few).collect()) == [(1, 1), (1, 1), (7, 3)]
    assert decontam.contained_items(odd, few.limit(0)).count() == decontam.contained_items(odd.limit(0), few).count() == 0
    assert decontam.without_items(odd, few).count() == odd.count() - 3


def test_containment_in_blocks(spark, documents, sf, odd, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = items.union(items.limit(5))
    want = Counter(map(tuple, decontam.contained_items(documents, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 150)
    assert Counter(map(tuple, decontam.contained_items(documents, items).collect())) == want and max(want.values()) >= 1


@pytest.mark.parametrize("n", range(1, 60))
def test_sketch_holds_a_shared_shingle(n):
    missing = n - int(np.ceil(0.8 * n - 1e-9))
    assert decontam.sketch_size(n, 0.8) >= min(n, missing + 1)


def test_encoder_is_the_library():
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in range(0x250)] + list("   \n\n'''sreldmv12aB") + ["<|endoftext|>", "中", "́", "İ", "ſ"]
    for path in (WORD, BYTE):
        enc, lib = Encoder(path), Tokenizer.from_file(path)
        texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(800)]
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.ids(texts)] == want
        assert enc.ids(texts, counting=True) == [len(x) for x in want]
    counting = Encoder(BYTE)
    lib = Tokenizer.from_file(BYTE)
    for k in range(150):
        t = "".join(rng.choice(letters, 400)) + ("q" * 300 if k % 3 == 0 else " " * 300 if k % 3 == 1 else "") + "tail of text"
        assert counting.count_spliced(t, chunk=int(rng.integers(50, 200)), overlap=30) == len(lib.encode(t, add_special_tokens=False))


def test_token_counts(documents, odd):
    lib = Tokenizer.from_file(BYTE)
    for df in (documents, odd):
        rows = {(r.doc_id, r.text) for r in df.collect()}
        want = Counter((d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for d, t in ((r.doc_id, r.text) for r in df.collect()))
        got = tokencount.token_counts(df, BYTE, chunk=5000).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and rows
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokencount.token_counts(odd.limit(0), BYTE).count() == 0


def test_token_files(spark, documents, odd, tmp_path):
    lib = Tokenizer.from_file(WORD)
    for df in (documents, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = tokenbin.token_table(df, WORD).collect()
        sizes = {}
        want = Counter()
        for d, t in rows:
            ids = lib.encode(t, add_special_tokens=False).ids + [1]
            want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
            sizes.setdefault(d, []).append(len(ids))
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for d, _ in rows]
    assert tokenbin.token_table(odd.limit(0), WORD).count() == 0


def test_keyed_access(spark, documents, tmp_path):
    path = tokenbin.write_tokens(documents, WORD, f"file://{tmp_path}/t")
    some = documents.orderBy("doc_id").limit(3)
    keys = some.select("doc_id").union(spark.createDataFrame([(10**12,)], "doc_id long"))
    lib = Tokenizer.from_file(WORD)
    want = {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids + [1] for r in some.collect()}
    assert {r.doc_id: r.ids for r in tokenbin.fetch(spark, path, keys, with_ids=True).collect()} == want
    whole = {r.key: (r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.stored(spark, path).collect()}
    folders = sorted(tmp_path.glob("t/shards/part=*"))
    assert len(folders) > 1
    for f in folders[1:]:  # the first ids lie in the first part: nothing else is opened
        shutil.rmtree(f)
    got = tokenbin.fetch(spark, path, keys, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(whole[r.doc_id] == (r.start, r.n_tokens, r.ids_crc32) for r in got)


def test_keys_that_go_on_in_other_shards(spark, tmp_path, monkeypatch):
    rows = [(5, "alpha beta")] * 40 + [(5, f"gamma {i}") for i in range(30)] + [(i, f"delta {i}") for i in range(20)] + [(None, "epsilon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(tokenbin, "SHARD_DOCS", 8)
    monkeypatch.setattr(tokenbin, "BUCKET_KEYS", 4)
    want = Counter(d for d, _ in rows)
    for few in (tokenbin.FEW_KEYS, 0):
        monkeypatch.setattr(tokenbin, "FEW_KEYS", few)
        path = tokenbin.write_tokens(df, WORD, f"file://{tmp_path}/m{few}")
        assert spark.read.parquet(f"{path}/more").count() > 5
        asked = spark.createDataFrame([(5,), (5,), (3,), (99,)], "doc_id long")
        assert Counter(r.doc_id for r in tokenbin.fetch(spark, path, asked).collect()) == {5: want[5], 3: 1}
        got = tokenbin.token_table(df, WORD).collect()
        assert Counter(r.doc_id for r in got) == want and len({r.start for r in got}) == len(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 100, 4096])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**9, n, replace=False).astype("<i8")
    seeds, slots = tokenbin.build_mph(keys)
    assert sorted(slots) == list(range(n)) and (tokenbin.find_slots(keys, n, seeds) == slots).all()


def brute_top(rows, k=5):
    vecs = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, v in {(i, tuple(v)) for i, v in vecs if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q)[:k]
        out.update((q, r + 1, i, -x) for r, (x, i) in enumerate(s))
    return out


def test_top_k(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert Counter(map(tuple, topk.top_k(df).collect())) == brute_top(rows)


def test_top_k_odd(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 4)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, -1.0]), (100, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0]), (10, [-1.0, -1.0]), (11, [0.001, 3.0])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, rank string")
    assert Counter(map(tuple, topk.top_k(df).collect())) == brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e5, 1e6, 1e150])
def test_top_k_of_large_numbers(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=20) * (scale if i % 7 == 0 else 1.0)]) for i in range(400)] + [(400 + i, [scale] * 20) for i in range(9)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    clip = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))
    want = Counter({(q, r, v, clip(s)): n for (q, r, v, s), n in brute_top(rows).items()})
    key = lambda c: sorted((q, s) for q, _, _, s in c)
    assert key(map(tuple, got.collect())) == key(want) and (scale > 1e7 or Counter(map(tuple, got.collect())) == want)


def spans(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in out)


def test_secrets(spark, documents, odd):
    extra = spark.createDataFrame([(9, "token=token : abcdefgh"), (10, "é password: 'abcdef' token=ab"), (11, "passwd=ab user=bob http://db.example.com/x"), (12, "user=bob only"), (13, "AKIA" + "A" * 16 + " secret=xy")], "doc_id long, text string")
    for df in (documents, odd, extra):
        got = secrets.secret_spans(df).collect()
        assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter((r.doc_id, hashlib.sha256(spans(r.text).encode()).hexdigest()) for r in df.collect())
    linked_spans = {r.doc_id: r.spans for r in secrets.secret_spans(extra).collect()}
    assert linked_spans[11] == "weak:0:9,ident:10:18,endpoint:19:42" and linked_spans[12] == "" and linked_spans[13] == "access:0:20,weak:21:30"
    assert secrets.secret_spans(odd.limit(0)).count() == 0


def test_secrets_link_by_the_gap_between_parts(spark):
    url = "https://db.example.com/" + "p" * 240
    rows = [(1, url + " token=ab"), (3, "token=ab" + " " * 201 + "https://db.example.com/x"), (4, "token=ab" + " " * 200 + "https://db.example.com/x user=bob")]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    weak = lambda a: f"weak:{a}:{a + 8}"
    assert got[1] == weak(len(url) + 1) and got[3] == "" and got[4].startswith(weak(0) + ",endpoint:208:")


def test_secrets_of_many_hits_and_long_texts(spark):
    n = 40_000
    text = " ".join("0123456789abcdef01234567" for _ in range(n)) + " lorem ipsum" * 100_000
    began = time.time()
    row = secrets.secret_spans(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).where("doc_id = 1").first()
    assert row.n_hex == n and row.base_sha256 == hashlib.sha256(spans(text).encode()).hexdigest()
    assert time.time() - began < 60  # the former running concatenation took 13 s for half of this and grew with its square


def test_language(documents, odd):
    got = {r.doc_id: r for r in langid.identify(documents, PIECES).collect()}
    held = [(r.lang, got[r.doc_id]) for r in documents.collect() if got[r.doc_id].held_out]
    assert sum(a == b.lang_pred for a, b in held) >= 0.95 * len(held)
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == r.held_out for d, r in got.items())
    rows = langid.identify(odd, PIECES).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 6, 8)} == {"und"}
    assert langid.identify(odd.limit(0), PIECES).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}
    kept = langid.keep_identified(odd, PIECES)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "4", "5", "7", "None"]


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁a", "a", "ab", "b", "▁ab", "▁"])
    model = langid.Model(["x"], pieces, np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2], [1e-8]]))
    ways = 0.05 + 0.1 * 0.15 + 0.2 * 0.3 + 0.2 * 0.2 * 0.15
    assert abs(np.exp(model.log_words(["ab"])[0, 0]) - ways) < 1e-12
    assert np.isfinite(model.log_words(["ab" * 5000])).all()


def brute_log(word, probs, k):
    """Log of the sum over all ways to cut a marked word into pieces, single characters included."""
    w, ways = "▁" + word, [1.0]
    for j in range(1, len(w) + 1):
        ways.append(sum(ways[i] * probs.get(w[i:j], probs[None] if j - i == 1 else np.zeros(len(probs[None])))[k] for i in range(j)))
    return float(np.log(ways[-1]))


def test_language_against_brute_force(spark, documents, odd):
    model = langid.fit(documents, PIECES)
    assert model.pieces.longest > 12 and len(model.pieces.names) > 20_000
    probs = dict(zip(model.pieces.names, model.probs)) | {None: model.probs[-1]}
    docs = documents.orderBy("doc_id").limit(40)
    got = {r.doc_id: r for r in langid.identify(docs, PIECES, model).collect()}
    for r in docs.collect():
        words = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (r.text or "").lower())
        if not words or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        kept = [w for w in words if len(w) < 40]
        known = {w: [brute_log(w, probs, k) for k in range(len(model.langs))] for w in set(kept)}
        logs = model.log_words(list(known))
        assert np.allclose(logs, list(known.values()), rtol=1e-9)
        if len(kept) == len(words):
            total = np.sum([known[w] for w in words], axis=0)
            assert got[r.doc_id].lang_pred == model.langs[int(total.argmax())]
            assert abs(got[r.doc_id].score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_language_of_long_texts_and_many_languages(spark, monkeypatch):
    long = " ".join(f"mot{i} phrase" for i in range(120_000))  # over a megabyte
    rows = [(i, "der hund und die katze", "de") for i in range(8)] + [(i, "le chien et le chat", "fr") for i in range(8, 16)] + [(20, "le chien " + long, "fr"), (21, "x" * 300_000, "de")] + [(3, "der hund", "de")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, PIECES).collect()}
    assert got[0] == "de" and got[9] == "fr" and got[20] == "fr"
    monkeypatch.setattr(langid, "LANGS", 1)
    with pytest.raises(ValueError):
        langid.fit(df, PIECES)


def test_toxicity(spark, odd):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    seen = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    bad = [g.score for t, g in seen if t == 1]
    fine = [g.score for t, g in seen if t == 0]
    assert np.mean([[a > b for b in fine] for a in bad]) > 0.75
    assert np.mean([s >= toxicity.THRESHOLD for s in fine]) < 0.1
    marks = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(odd, marks).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(odd, marks.limit(0)).count() == odd.count() and toxicity.toxicity(odd.limit(0), marks).count() == 0


def test_toxicity_against_windows_one_by_one(spark, documents):
    marked = lambda t: [toxicity.MARK + w for w in re.findall(rb"[0-9a-z_\x80-\xff]+", (t or "").lower().encode())]
    rows = [(r.doc_id % 3 == 0, b"".join(marked(r.text))) for r in documents.collect()]
    d = toxicity.dictionaries(rows)
    assert d.toxic and d.ordinary and d.toxic != d.ordinary[: len(d.toxic)]
    some = documents.orderBy("doc_id").limit(60)
    got = {r.doc_id: r for r in toxicity.measured(some.select("doc_id", "text"), d).collect()}
    for r in some.collect():
        m = marked(r.text)
        wins = [b"".join(m[i : i + 8]) for i in range(0, len(m), 8)]
        gains = []
        for w in wins:
            a, b = d.lengths(w, np.array([[0, len(w)]]))
            gains.append(int(a[0] - b[0]))
        assert got[r.doc_id].windows == len(wins) and got[r.doc_id].most == max([0, *gains]) and got[r.doc_id].total == sum(g for g in gains if g > 0)
        assert all(got[r.doc_id][f"gain_{k}"] == sum(g >= k for g in gains) for k in toxicity.GAINS)


def test_toxicity_of_long_texts_and_equal_texts(spark):
    plain = " ".join(f"wort{i % 977} und" for i in range(150_000))  # over a megabyte
    rows = [(i, f"das ist ein text {i} und noch mehr worte hier {i * 7}") for i in range(400)] + [(400 + i, f"du bist ein schlimmwort{'' if i % 2 else 'er'} und text {i}") for i in range(300)] + [(900, plain), (901, plain + " schlimmwort " * 3), (902, "gleich"), (903, "gleich")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(400 <= i < 700)) for i, _ in rows if i < 900] + [(902, 1), (903, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks).collect()}
    assert np.mean([got[i] for i in range(400, 700)]) > 0.8 and np.mean([got[i] for i in range(400)]) < 0.2
    assert got[901] > got[900] and got[902] == got[903]


def test_mixing(documents, odd):
    rows = mixing.mix(documents, max_repeat=2.0).collect()
    assert len(rows) == documents.count()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for held in by.values():
        tokens, got = sum(r.n_tokens for r in held), sum(r.n_tokens * r.copies for r in held)
        budget = held[0].repeats * tokens
        assert got <= budget + 1e-6 and got > budget - max(r.n_tokens for r in held) * 2 and held[0].repeats <= 2 + 1e-9
        assert max(r.copies for r in held) - min(r.copies for r in held) <= 1 and min(r.copies for r in held) >= 1
    shares = [sum(r.n_tokens for r in h) for h in by.values()]
    p = np.array(shares) / sum(shares)
    target = float(-(p * np.log(p)).sum() + 0.01)
    weighed = mixing.mix(documents, max_repeat=100.0, target_entropy=target).select("source", "weight").distinct().collect()
    w = np.array([r.weight for r in weighed])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - target) < 1e-3
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_rows(odd, 1.5).columns == odd.columns and mixing.mixed_rows(odd, 1.5).count() >= odd.count()


def test_mixing_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    most = 1.7
    got = {r.doc_id: r for r in mixing.mix(documents, max_repeat=most).collect()}
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.xxhash64("doc_id", "text", F.lit(17)).alias("h"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).alias("n")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.src, []).append(r)
    tokens = {s: sum(r.n for r in held) for s, held in by.items()}
    p = {s: t / sum(tokens.values()) for s, t in tokens.items()}
    a = max(0.0, 1 - np.log(most) / np.log(max(p.values()) / min(p.values())))  # the least exponent within the limit
    least = min(x ** (a - 1) for x in p.values())
    blocks = {s: -(-len(held) // 16) for s, held in by.items()}
    named = spark.createDataFrame([(s, b) for s in by for b in range(blocks[s])], "src string, block long")
    lined = {(r.src, r.block): r.o for r in named.withColumn("o", F.xxhash64("src", "block", F.lit(17))).collect()}
    partly = 0
    for s, held in by.items():
        repeats = got[held[0].doc_id].repeats
        assert abs(repeats - p[s] ** (a - 1) / least) < 1e-3 and abs(got[held[0].doc_id].weight - p[s] ** a / sum(x**a for x in p.values())) < 1e-3
        left = (repeats - np.floor(repeats)) * tokens[s]
        for rank, b in enumerate(sorted({r.h % blocks[s] for r in held}, key=lambda b: (lined[s, b], b)), 1):
            mine = sorted((r for r in held if r.h % blocks[s] == b), key=lambda r: r.h)
            size, run = sum(r.n for r in mine), 0
            for r in mine:
                run += r.n
                more = left >= size or (0 < left < size and run <= left)
                partly += 0 < left < size
                assert (got[r.doc_id].block, got[r.doc_id].block_rank, got[r.doc_id].copies) == (b, rank, int(np.floor(repeats)) + more)
            left -= size
    assert partly and len(got) == len(rows)


def test_mixing_limits_and_repeats(spark):
    rows = [(1, "a b c", "x")] * 3000 + [(i, "d e", "x") for i in range(2, 1500)] + [(i, "f g h", "y") for i in range(5000, 5100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, max_repeat=1.5).collect()
    for name in "xy":
        held = [r for r in got if r.source == name]
        budget = held[0].repeats * sum(r.n_tokens for r in held)
        read = sum(r.n_tokens * r.copies for r in held)
        assert read <= budget + 1e-6 and read > budget - 9000 - 3
        ranks = {r.block: r.block_rank for r in held}
        assert sorted(ranks.values()) == list(range(1, len(ranks) + 1))
    assert mixing.mixed_rows(df, 1.5).count() == sum(r.copies for r in got)
    with pytest.raises(ValueError):
        mixing.mix(df, target_entropy=1e-6)
    with pytest.raises(ValueError):
        mixing.mix(df, max_repeat=0.5)


def test_mixing_counts_tokens(documents):
    lib = Tokenizer.from_file(WORD)
    rows = {r.doc_id: r.n_tokens for r in mixing.mix(documents, tokenizer=WORD).collect()}
    assert rows == {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False)) for r in documents.collect()}


def brute_roles(lines, m):
    """(score, path) of the likeliest path over the whole conversation, written out."""
    best = {k: (float(m.start[k]), [k]) for k in range(3)}
    for n, (given, marked, shape) in enumerate(lines):
        seen = [float(m.shape[k, shape]) + (float(m.given[k, given]) if given >= 0 else 0.0) + (float(m.marked[k, marked]) if marked >= 0 else 0.0) for k in range(3)]
        if n:
            best = {k: max(((s + float(m.step[p[-1], k]), [*p, k]) for s, p in best.values()), key=lambda x: x[0]) for k in range(3)}
        best = {k: (s + seen[k], p) for k, (s, p) in best.items()}
    return max(best.values(), key=lambda x: x[0])


def path_score(path, lines, m):
    out = float(m.start[path[0]])
    for n, (k, (given, marked, shape)) in enumerate(zip(path, lines, strict=True)):
        out += (float(m.step[path[n - 1], k]) if n else 0.0) + float(m.shape[k, shape]) + (float(m.given[k, given]) if given >= 0 else 0.0) + (float(m.marked[k, marked]) if marked >= 0 else 0.0)
    return out


def test_chat(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = chat.format_turns(df).collect()
    assert Counter((r.conv_id, r.turn) for r in got if r.line == 0) == Counter((r.conv_id, r.turn) for r in df.collect())
    assert np.mean([r.role == r.given_role for r in got if r.given_role in chat.ROLES]) > 0.98
    hidden = df.withColumn("role", F.when((F.col("turn") % 3 == 1) | F.col("turn").isNull(), None).otherwise(F.col("role")))
    monkeypatch.setattr(chat, "CHUNK", 3)
    rows = chat._features(hidden).orderBy("conv_id", "turn", "role", "h", "line").collect()
    model = chat.fit(chat._features(df).withColumn("chunk", F.coalesce(F.col("conv_id"), F.lit(-1))))
    told = {}
    for r in chat.format_turns(hidden, model).collect():
        told.setdefault(r.conv_id, []).append((r.turn is not None, r.turn, r.given_role is not None, r.given_role or "", r.line, chat.ROLES.index(r.role)))
    convs = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.given, r.marked, r.shape))
    for c, lines in convs.items():
        best, path = brute_roles(lines, model)
        assert abs(path_score(path, lines, model) - best) < 1e-9
        ours = [x[-1] for x in sorted(told[c], key=lambda x: (x[0], x[1] or 0, x[2], x[3], x[4]))]
        if len({(x[1], x[3]) for x in told[c]}) == len(lines):  # no ties in the order
            assert abs(path_score(ours, lines, model) - best) < 1e-6
        else:
            assert len(ours) == len(lines)


def test_chat_recovers_masked_roles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("role in ('system', 'user', 'assistant')")
    mask = F.xxhash64("conv_id", "turn", F.lit(1)) % 2 == 0
    got = chat.format_turns(df.withColumn("role", F.when(~mask, F.col("role"))))
    both = got.join(df.groupBy("conv_id", "turn").agg(F.min("role").alias("truth"), F.max("role").alias("other")).where("truth = other"), ["conv_id", "turn"]).where("given_role is null and line = 0")
    right = both.agg(F.avg((F.col("role") == F.col("truth")).cast("int"))).first()[0]
    assert right > 0.9


def test_chat_odd(spark):
    df = spark.createDataFrame([(1, 0, "weird", "User: hi <|x|>?", 1), (1, 1, None, "Assistant: hello", 1), (None, None, None, None, 1), (1, 1, None, "Assistant: hello", 1), (2, 0, "system", "", 1), (3, 0, None, "User: one\nmore of it\nAssistant: two\n  Human: three?", 1)], "conv_id long, turn long, role string, text string, chunk int")
    rows = chat.format_turns(df).collect()
    assert len(rows) == 8
    first = next(r for r in rows if r.conv_id == 1 and r.turn == 0)
    assert first.rendered == "<|user|>\nhi <\\|x|>?<|end|>\n" and first.given_role == "weird"
    assert next(r for r in rows if r.conv_id == 1 and r.turn == 1).rendered == "<|assistant|>\nhello<|end|>\n"
    assert [r.rendered for r in sorted(rows, key=lambda r: r.line) if r.conv_id == 3] == ["<|user|>\none\nmore of it<|end|>\n", "<|assistant|>\ntwo<|end|>\n", "<|user|>\nthree?<|end|>\n"]
    assert chat.format_turns(df.limit(0)).count() == 0


def test_chat_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 7)
    df = spark.createDataFrame([(1, None if i % 2 else 4, "user" if i % 3 else None, f"text {i}") for i in range(200)], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(df).count() == 200

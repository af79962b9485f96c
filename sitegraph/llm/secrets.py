"""Secret scans: base patterns and multipart credentials linked by an interval join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200

#: The three base patterns, and the least length of what they must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Weak parts: none is reported by itself.
IDENTITY = r"""(?i:(client_?id|access_?key_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|ssh)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
KINDS = ("assign", "access", "hex", "weak", "ident", "endpoint")


def _matches(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """array<struct<kind, pos, gap, len, ok>> of the matches, leftmost and not overlapping; ok: the group has the least length.

    The pieces between the matches and the matches themselves, both in order, give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spots = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), (F.length(F.regexp_extract(x["hit"], pattern, group)) >= least).alias("ok")),
    )
    return F.when(text.rlike(pattern), spots).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of docs (doc_id, text).

    Base spans: assignments of six characters or more, access identifiers of twenty, hexadecimal runs
    of 24. Weak parts are assignments of fewer characters (weak), account names (ident) and endpoint
    addresses (endpoint). Parts of a text are joined to those that begin at most scope characters
    after their end, or end at most scope before their start: a weak secret is reported if an
    identifier or an endpoint is near, an identifier if a secret is near, an endpoint if both are
    near. Base spans count as parts (access as identifier, assign and hex as secrets); weak parts
    that overlap a base span go.

    spans: kind:start:end (code points, end exclusive) by start, then kind, joined by commas.
    Null texts are empty; a text without spans has an empty string. Long texts are scanned whole.
    Repeated rows and null ids stay, each row for itself; other columns are ignored; an empty table
    gives an empty table.

    The interval join is two running frames over the parts of each row: the farthest end of a kind
    among the parts up to one, and, read backwards, the nearest start from it on. So the cost grows
    with the parts and not with their pairs; rows go by a row number of the scan.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), text.alias("text"))
    hits = F.concat(*[_matches(F.col("text"), p, k, g, n) for k, p, g, n in (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("ident", IDENTITY, 2, 2), ("endpoint", ENDPOINT, 0, 8))])
    found = rows.select("rid", "doc_id", F.explode_outer(hits).alias("x")).select("rid", "doc_id", "x.*").repartition("rid")
    of_kind = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_kind = lambda *names: F.col("kind").isin(*[KINDS.index(n) for n in names])
    each = found.withColumn("e", F.sum(F.col("gap") + F.col("len")).over(of_kind).cast("int")).withColumn("s", F.col("e") - F.col("len"))
    each = each.withColumn("kind", F.when(is_kind("assign") & ~F.col("ok"), KINDS.index("weak")).when(F.col("ok") | is_kind("endpoint", "access", "hex"), F.col("kind")))
    base = is_kind("assign", "access", "hex")
    behind = Window.partitionBy("rid").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("rid").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.max(F.when(c, F.col("e"))).over(behind)
    after = lambda c: F.min(F.when(c, F.col("s"))).over(ahead)
    near = lambda c: F.coalesce(last(c) >= F.col("s") - scope, F.lit(False)) | F.coalesce(after(c) <= F.col("e") + scope, F.lit(False))
    joined = each.select(
        "rid", "doc_id", "s", "e", "kind", base.alias("base"),
        near(is_kind("assign", "hex", "weak")).alias("secret"), near(is_kind("access", "ident")).alias("ident"), near(is_kind("endpoint")).alias("endpoint"),
        (F.coalesce(last(base) > F.col("s"), F.lit(False)) | F.coalesce(after(base) < F.col("e"), F.lit(False))).alias("covered"),
    )
    linked = F.when(F.col("base"), True).when(F.col("covered"), False).when(is_kind("weak"), F.col("ident") | F.col("endpoint")).when(is_kind("ident"), F.col("secret")).when(is_kind("endpoint"), F.col("secret") & F.col("ident")).otherwise(False)
    told = joined.withColumn("keep", F.coalesce(linked, F.lit(False)))
    spot = F.struct("s", "kind", "e")
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["s"], x["e"])
    total = lambda k: F.sum(F.when(is_kind(k), 1).otherwise(0)).cast("long").alias(f"n_{k}")
    return (
        told.groupBy("rid")
        .agg(F.first("doc_id").alias("doc_id"), total("assign"), total("access"), total("hex"), F.sort_array(F.collect_list(F.when(F.col("keep"), spot))).alias("all"))
        .select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < 3), name), ","), 256).alias("base_sha256"), F.array_join(F.transform("all", name), ",").alias("spans"), F.size(F.filter("all", lambda x: x["kind"] >= 3)).cast("long").alias("n_linked"))
    )

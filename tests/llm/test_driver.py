"""What the pipeline asks of the driver: few jobs, small plans, memory given back."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import _shared, graph, mixing, neardup


def jobs_of(spark, action):
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = action()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def least_of(edges):
    """Least node of each node's component, by a plain search."""
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += near[n]
    return out


@pytest.mark.parametrize("few", [0, 60, 200_000])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_are_the_same_in_one_task_and_in_rounds(spark, monkeypatch, few, kind):
    rng = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(-40, 20)]
    hub = [(100, int(x)) for x in rng.integers(101, 180, 60)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (90, 2))] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    edges = [*chain, *hub, *loose]
    if kind == "binary":
        edges = [tuple((x % 2**16).to_bytes(2 + x % 2, "big") for x in e) for e in edges]  # of both lengths, bytes above 127 too
    rows = spark.createDataFrame(edges, f"u {kind}, v {kind}").repartition(5)
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    held = lambda x: bytes(x) if kind == "binary" else x
    for part in (rows, rows.limit(0), rows.where("u = v")):
        want = least_of([(held(r.u), held(r.v)) for r in part.collect()])
        got = [(held(r.node), held(r.comp)) for r in graph.connected_components(part).collect()]
        assert len(got) == len(want)
        assert dict(got) == want


def test_small_graphs_take_few_jobs(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got, jobs = jobs_of(spark, lambda: graph.connected_components(edges).collect())
    assert {r.comp for r in got} == {0} and len(got) == 301
    assert jobs <= 6


def test_near_duplicates_take_few_jobs(spark, documents):
    got, jobs = jobs_of(spark, lambda: neardup.one_per_group(documents).collect())
    assert got
    assert jobs <= 65


def test_exponents_are_tried_in_small_plans(spark, monkeypatch):
    """Four aggregates a trial, not four for each exponent, over counts that are written once."""
    frame, widest = type(spark.range(0)), []
    group = type(spark.range(0).groupBy())
    for kind in (frame, group):
        monkeypatch.setattr(kind, "agg", lambda self, *cols, f=kind.agg: (widest.append(len(cols)), f(self, *cols))[1])
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 11, F.lit(3))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"))
    rows = mixing.mix(docs, max_repeat=1.5).collect()
    assert len(rows) == 500 and max(r.repeats for r in rows) == pytest.approx(1.5, rel=1e-3)
    assert max(widest) <= 4


def test_memory_is_given_back_after_each_table(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(_shared, "trim_driver", asked.append, raising=False)
    _shared.materialise(spark.range(3), "given")
    assert asked == [spark]


def test_a_driver_that_cannot_give_back_goes_on(spark, monkeypatch):
    class Broken:
        @property
        def java(self):
            raise _shared.Py4JError("no such command")

    monkeypatch.setattr(type(spark.sparkContext), "_jvm", Broken())
    _shared.trim_driver(spark)

"""The network of nations, dealt out by the number of lines."""

import os

import pytest

from flowloom.plans import testnet

DATA = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_lines(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert testnet.dealt(df, 10, "k") is df
    assert testnet.dealt(df, 100 * testnet.TASK_LINES, "k").rdd.getNumPartitions() == 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_dealt_out_flows_are_the_same(spark, monkeypatch):
    want = sorted(map(tuple, testnet.flows(spark, DATA).collect()))
    monkeypatch.setattr(testnet, "TASK_LINES", 500)
    got = sorted(map(tuple, testnet.flows(spark, DATA).collect()))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)  # sums of floats in another order, rounded

import math

import numpy as np
import pytest

from fathomline import functions as fn
from fathomline.operators import joins, kernels
from fathomline.operators.dataflow import GraphError, Registry, accepts


def test_tails():
    assert fn.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert fn.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert fn.expected_max_sharpe(1.0, 33) == pytest.approx(2.112, abs=5e-3)
    assert fn.deflated_sharpe(0.1, 250, 0, 3, 1.0, 1) == fn.probabilistic_sharpe(0.1, 250, 0, 3)


def test_wavelet_identities():
    x = np.random.default_rng(1).normal(size=64)
    assert np.allclose(kernels.mra(x, 3).sum(0), x)
    w, v = kernels.modwt(x, 3)
    assert (w**2).sum() + (v**2).sum() == pytest.approx((x**2).sum())


def test_snooping_finds_a_planted_model_and_is_repeatable():
    x = np.random.default_rng(2).normal(size=(500, 20))
    assert kernels.snooping(x)["p_white"] > 0.05
    x[:, 7] += 0.3
    got = kernels.snooping(x)
    assert got["p_white"] < 0.01 and got["rejected"] >= 1 and got == kernels.snooping(x)


def test_online_levels():
    with pytest.raises(ValueError):
        kernels.addis(np.array([0.1, math.nan]))
    level = kernels.addis(np.array([1e-6, 0.9, 0.4, 0.01]))
    assert level[1] == 0 and (level[[0, 2, 3]] > 0).all() and level[2] > level[0] * 0.5  # above tau a test is discarded


def test_online_levels_by_the_sum_over_all_rejections():
    p = np.random.default_rng(4).random(3000) ** 4
    gamma = np.arange(1, 3002) ** -1.6 / (np.arange(1, 100_001) ** -1.6).sum()
    paid, rejected = np.concatenate([[0], np.cumsum((p <= 0.5) & (p > 0.125))]), []
    want = []
    for t, x in enumerate(p):
        if x > 0.5:
            want.append(0.0)
            continue
        total = 0.025 * gamma[paid[t]] + sum((0.025 if k == 0 else 0.05) * gamma[paid[t] - paid[r + 1]] for k, r in enumerate(rejected))
        want.append(min(0.125, 0.25 * total))
        if x / 0.5 <= want[-1]:
            rejected.append(t)
    assert len(rejected) > 100 and np.allclose(kernels.addis(p), want, rtol=1e-9)


def test_online_replay_takes_all_events(spark):
    from fathomline.plans.kernels import QUERIES

    data = "/root/testdata/sf0.001"
    assert QUERIES["online_fdr"](spark, data).count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_fluctuations_and_drawdowns():
    assert kernels.dfa(np.random.default_rng(3).normal(size=4000)) == pytest.approx(0.5, abs=0.08)
    assert kernels.simulated_drawdown(0, 1, 100, 2000, 1) == pytest.approx(math.sqrt(math.pi / 2) * 10, rel=0.15)
    assert kernels.visibility_rsi(np.array([1.0, 2, 3, 4])) > 50


def test_asof_and_merge(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, ts int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0), ("a", 4, 39.0)], "k string, ts int, v double")
    assert sorted(map(tuple, joins.asof(left, right, ["k"], "ts", "v").collect()), key=repr) == [("a", 1, 10.0), ("a", 5, 40.0), ("b", 2, None)]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, joins.last_wins(old, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_graph():
    r = Registry()
    r.register("one", lambda i, p: p["x"], x=1)
    r.register("twice", lambda i, p: 2 * i["a"], {"a": "Frame"})
    g = {"nodes": [{"id": "b", "type": "twice"}, {"id": "a", "type": "one", "params": {"x": 4}}], "edges": [{"from": ["a", "out"], "to": ["b", "a"]}]}
    assert r.execute(g)["b"] == {"out": 8}
    assert accepts("Frame[*]", "Frame[x]") and not accepts("Frame[y]", "Frame[x]")
    with pytest.raises(GraphError):
        r.order({"nodes": g["nodes"], "edges": []})


def test_streaming_bars_equal_batch(spark, tmp_path):
    from fathomline.streaming import windowed_bars

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    live = windowed_bars(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("append").format("memory").queryName("bars_live").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars_live")
    batch = windowed_bars(ev)
    assert got.count() > 0 and got.exceptAll(batch).isEmpty()


def test_entry_without_the_corpus_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/fathomline", tmp_path / "fathomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'obv' in e.queries() and 'pipeline' not in e.queries()"], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})

"""Operators against values worked out from their definitions, or against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import functions as fn
from fathomline.functions import tails
from fathomline.operators import causal, classify, joins, kernels, library, portfolio, risk, validation, volume


def day(i: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, volumes, symbol="a", **more):
    rows = [(symbol, day(i), None if c is None else float(c), None if v is None else float(v)) for i, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts date, close double, volume double")


def values(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_obv_signs_volume_and_a_missing_close_voids_the_rest(spark):
    assert values(volume.obv(bars(spark, [10, 11, 11, 9, 12], [5, 7, 3, 4, 6])), "obv") == [0, 7, 7, 3, 9]
    assert values(volume.obv(bars(spark, [10, None, 11, 9], [5, 7, 3, 4])), "obv") == [0, None, None, None]


def test_excess_volume_judges_against_rows_before(spark):
    v = [1, 2, 4, 8, 100]
    got = values(volume.excess_volume(bars(spark, v, v), 3), "z")
    x = np.log1p(v)
    assert got[:3] == [None] * 3
    assert got[4] == pytest.approx((x[4] - x[1:4].mean()) / x[1:4].std(ddof=1))
    assert values(volume.excess_volume(bars(spark, [1] * 4, [5, 5, 5, 5]), 3), "z")[3] == 0
    assert values(volume.volume_breakout(bars(spark, v, v), 3, 2.0), "breakout") == [False, False, False, True, True]


def test_vwap_leaves_bars_without_price_out(spark):
    df = spark.createDataFrame([("a", day(0), 1.0, 1.0, 1.0, 2.0), ("a", day(1), None, 2.0, 2.0, 50.0), ("a", day(2), 4.0, 4.0, 4.0, 2.0)], "symbol string, ts date, high double, low double, close double, volume double")
    assert values(volume.rolling_vwap(df, 3), "vwap") == [None, None, 2.5]


def test_standard_scores(spark):
    df = bars(spark, [1, 2, 3, 4, 10], [1] * 5)
    assert values(volume.standardize(df, "close", 4, "rank"), "z")[4] == 1
    assert values(volume.standardize(df, "close", 4, "robust"), "z")[4] == pytest.approx((10 - 2.5) / 1.4826)
    assert values(volume.standardize(df, "close", 4), "z")[4] == pytest.approx(min(5, (10 - 2.5) / np.std([1, 2, 3, 4], ddof=1)))


def test_spearman_sees_order_only(spark):
    df = bars(spark, [1, 2, 4, 8, 16], [1, 1, 1, 1, 1])
    assert values(volume.price_volume_divergence(df, 5, "spearman"), "corr")[4] == pytest.approx(1)
    assert values(volume.price_volume_divergence(df, 5), "corr")[4] < 0.95


@pytest.mark.parametrize("f", [lambda d: volume.obv_slope(d, 4), lambda d: volume.excess_volume(d, 4), lambda d: volume.price_volume_divergence(d, 4), lambda d: volume.price_volume_divergence(d, 4, "spearman"), lambda d: volume.divergence_flag(d, 4), lambda d: volume.standardize(d, "close", 4, "robust"), lambda d: volume.standardize(d, "close", None), lambda d: volume.detrend(d, "close", "ols", window=None), lambda d: volume.rolling_ols_slope(d, "close", 4), lambda d: risk.drawdown_series(d, "close")])
def test_windows_do_not_look_ahead(spark, f):
    rnd = random.Random(3)
    c, v = [10 + rnd.random() for _ in range(24)], [1 + rnd.random() for _ in range(24)]
    whole = f(bars(spark, c, v))
    name = next(x for x in whole.columns if x not in ("symbol", "ts", "close", "volume"))
    assert values(f(bars(spark, c[:17], v[:17])), name) == pytest.approx(values(whole, name)[:17], nan_ok=True)


def wealth(spark, w):
    return spark.createDataFrame([("a", day(i), float(x)) for i, x in enumerate(w)], "symbol string, ts date, w double")


def test_drawdowns(spark):
    df = wealth(spark, [100, 120, 90, 110, 130, 117, 130])
    got = risk.drawdown_table(df).collect()
    assert [(r.peak, r.trough, r.recovery, round(r.depth, 4)) for r in got] == [(day(1), day(2), day(4), 0.25), (day(4), day(5), day(6), 0.1)]
    assert risk.max_drawdown(df).first().max_drawdown == pytest.approx(0.25)
    d = np.array([0, 0, 0.25, 1 - 110 / 120, 0, 0.1, 0])
    assert risk.ulcer_index(df).first().ulcer == pytest.approx(math.sqrt((d * d).mean()))
    assert risk.time_under_water(df).first().longest == 2


def test_ratio_report_by_hand(spark):
    r = [0.1, -0.05, 0.02, -0.1, 0.2] * 8
    df = spark.createDataFrame([("a", day(30 * i), x) for i, x in enumerate(r)], "symbol string, ts date, r double")
    got, x = risk.ratio_report(df, periods=12, window=36).first(), np.array(r)
    growth = np.prod(1 + x) ** (12 / len(x)) - 1
    assert got.cagr == pytest.approx(growth) and got.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * 12**0.5)
    assert got.sortino == pytest.approx(x.mean() / math.sqrt((np.minimum(x, 0) ** 2).mean()) * 12**0.5)
    w = np.cumprod(1 + x)
    assert got.max_drawdown == pytest.approx((1 - w / np.maximum.accumulate(w)).max())
    assert got.martin == pytest.approx(growth / got.ulcer) and got.calmar is not None


def test_expected_drawdown(spark):
    assert risk.expected_max_drawdown(0, 2, 4, "exact") == pytest.approx(math.sqrt(math.pi / 2) * 4, rel=0.01)
    assert risk.expected_max_drawdown(-20, 1, 1, "exact") == pytest.approx(20, rel=0.05)
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(0.5 / 2000, 2000**-0.5, (1000, 2000)), 1)
    simulated = (np.maximum.accumulate(np.maximum(x, 0), 1) - x).max(1).mean()
    assert risk.expected_max_drawdown(0.5, 1, 1) == pytest.approx(simulated, rel=0.06)


def test_tails_against_the_standard_library(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([(x,) for x in (-3.0, -1.0, -0.2, 0.0, 0.5, 1.96, 4.0)], "x double")
    for r in df.select("x", tails.normal_cdf(F.col("x")).alias("c"), tails.normal_quantile(tails.normal_cdf(F.col("x"))).alias("q"), tails.t_two_sided(F.col("x"), F.lit(7)).alias("t"), tails.chi2_tail(F.abs("x") * 5, F.lit(7)).alias("k")).collect():
        assert r.c == pytest.approx(NormalDist().cdf(r.x), abs=1e-7) and r.q == pytest.approx(r.x, abs=1e-5)
        assert r.t == pytest.approx(fn.t_tail(r.x, 7), abs=1e-9) and r.k == pytest.approx(fn.chi2_tail(abs(r.x) * 5, 7), abs=1e-9)
    assert fn.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)


def test_holm_and_bonferroni(spark):
    got = validation.adjusted(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")).orderBy("p").collect()
    assert [round(r.holm, 6) for r in got] == [0.03, 0.06, 0.06] and [round(r.bonferroni, 6) for r in got] == [0.03, 0.09, 0.12]


def test_deflated_sharpe_matches_the_scalar(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0.01, 0.1, 200)
    df = spark.createDataFrame([("a", day(i), float(v)) for i, v in enumerate(x)], "symbol string, ts date, r double")
    got = validation.deflated_sharpe(df, 1).first()
    m = ((x - x.mean()) ** 3).mean() / x.std() ** 3, ((x - x.mean()) ** 4).mean() / x.std() ** 4
    assert got.psr == pytest.approx(fn.probabilistic_sharpe(x.mean() / x.std(ddof=1), 200, *m), abs=1e-6) and got.dsr == pytest.approx(got.psr)


def test_folds_and_purged_combinations(spark):
    rows = spark.range(11).withColumnRenamed("id", "k")
    assert [r.fold for r in validation.folds(rows, 4, "k").orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    got = validation.cpcv(rows, 4, 2, 1).collect()
    assert len({r.split for r in got}) == 6
    first = [(r.k, r.role) for r in got if r.split == 0]  # folds 0 and 1 held out: rows 0 to 5, with one row of embargo
    assert sorted(k for k, role in first if role == "train") == [7, 8, 9, 10]


def test_pbo_is_low_when_one_model_is_better(spark):
    rng = np.random.default_rng(0)
    rows = [(m, day(i), float(rng.normal(0.3 if m == "b" else 0.0, 0.1))) for m in "abcd" for i in range(100)]
    got = validation.pbo(spark.createDataFrame(rows, "symbol string, ts date, r double"), 6).first()
    assert got.splits == 20 and got.pbo == 0


def test_resampling_covers_the_ratio_and_sees_a_mean(spark):
    rng = np.random.default_rng(4)
    rows = [("up", day(i), float(rng.normal(0.05, 0.1))) for i in range(200)] + [("flat", day(i), float(rng.normal(0, 0.1))) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts date, r double")
    got = {r.symbol: r for r in validation.bootstrap_sharpe(df, 500, 5).collect()}
    assert got["up"].low < got["up"].sharpe < got["up"].high and got["up"].p < 0.01 and got["flat"].p > 0.05
    flip = {r.symbol: r for r in validation.sign_flip(df, 500).collect()}
    assert flip["up"].p_one < 0.01 and flip["flat"].p_two > 0.05


def test_rules_must_match_exactly_once(spark):
    facts = spark.createDataFrame([("a", "x", 0.5)], "key string, name string, value double")
    rules = [{"slot": "s", "name": "x", "low": None, "high": 0.4, "verdict": "no"}, {"slot": "s", "name": "x", "low": 0.4, "high": None, "verdict": "yes"}]
    assert validation.resolved(facts, rules).first().verdict == "yes"
    with pytest.raises(Exception, match="meets 0 rules"):
        validation.resolved(facts, rules[:1]).collect()


def addis_by_definition(p, alpha=0.05, tau=0.5, lam=0.25):
    total = (np.arange(1, 100_001) ** -1.6).sum()
    gamma = lambda j: j**-1.6 / total
    w0, tested, candidates, rejected, out = alpha / 2, 0, [], [], []
    for x in p:
        if x > tau:
            out.append((0.0, False))
            continue
        tested += 1
        level = w0 * gamma(tested - sum(candidates))
        for n, r in enumerate(rejected):
            level += (alpha - w0 if n == 0 else alpha) * gamma(tested - r - sum(candidates[r:]))
        level = min(tau * lam, (tau - lam) * level)
        candidates.append(x / tau <= lam)
        if x / tau <= level:
            rejected.append(tested)
        out.append((level, x / tau <= level))
    return out


def test_addis_follows_its_definition(spark):
    rng = np.random.default_rng(2)
    p = np.where(rng.random(300) < 0.2, rng.random(300) * 1e-4, rng.random(300))
    want = addis_by_definition(p)
    assert kernels.addis(p) == pytest.approx([w for w, _ in want])
    got = kernels.online_fdr(spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(p)], "g string, i long, p double"), "g", ["i"], "p").orderBy("seq").collect()
    assert [r.rejected for r in got] == [bool(r) for _, r in want] and any(r.rejected for r in got)


def panel(spark, theta, n=2400, periods=60, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n) % periods
    z = rng.normal(size=n)
    d = 0.5 * z + rng.normal(size=n)
    y = theta * d + 2 * z + rng.normal(size=n)
    return spark.createDataFrame([(int(a), float(b), float(c), float(e)) for a, b, c, e in zip(t, z, d, y, strict=True)], "t int, z double, d double, y double")


def test_effects_are_found_and_nothing_is_not(spark):
    e = causal.plr_effect(panel(spark, 0.4), "d", "y", ["z"], "t")
    assert abs(e.theta - 0.4) < 4 * e.se and e.p < 1e-6 and e.clusters == 60
    v = causal.verdict(panel(spark, 0.4), "d", "y", ["z"], "t")
    assert v["verdict"] == "PASS" and v["signs"]["share"] == 1
    assert causal.verdict(panel(spark, 0.4), "d", "y", ["z"])["verdict"] == "CONDITIONAL"
    assert causal.verdict(panel(spark, 0.0, seed=5), "d", "y", ["z"], "t")["verdict"] == "FAIL"


def test_cross_fitting_predicts_each_fold_from_the_others(spark):
    df = causal.fold_ids(panel(spark, 0.3, 300), 3, "t")
    assert df.groupBy("t").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    got = causal.cross_fit_residuals(df, ["y"], ["z"]).toPandas()
    for k in got.fold.unique():
        train, test = got[got.fold != k], got[got.fold == k]
        b = np.polyfit(train.z, train.y, 1)
        assert test.res_y.to_numpy() == pytest.approx((test.y - np.polyval(b, test.z)).to_numpy())


def test_kinds_templates_and_tags(spark):
    df = spark.createDataFrame([(1, "Cross-sectional anomalies and the value factor"), (2, "A trading strategy: momentum, trend following"), (3, "RSI and reversal; RSI again"), (4, None)], "id int, body string")
    got = {r.id: r for r in classify.template(classify.kind(df, F.col("body")), F.col("body")).collect()}
    assert (got[1].kind, got[1].subcats) == ("factor", ["value"]) and (got[2].kind, got[4].kind, got[4].subcats) == ("strategy", "strategy", [])
    assert (got[2].template, got[2].matched) == ("momentum", ["momentum", "trend following"]) and (got[3].template, got[3].matched) == ("mean_reversion", ["reversal", "rsi"]) and got[4].template == "buy_and_hold"
    tags = {r.id: r.t for r in df.select("id", classify.flat_tags(F.col("body")).alias("t")).collect()}
    assert tags[1] == ["value", "cross-sectional"] or tags[1][0] == "value"


def test_chunks_overlap_and_break_at_spaces():
    words = [f"w{i:04d}" for i in range(700)]
    got = library.cut("  \n".join(words))
    assert all(len(c) <= 1000 for c in got) and set(" ".join(got).split()) >= set(words)
    assert all(not c.startswith(" ") and c.split()[-1] in words for c in got)
    assert library.cut("x" * 1200) == ["x" * 1000, "x" * 350] and library.cut(" \n ") == [] and library.cut(None) == []


def test_search_context_and_listing(spark):
    docs = spark.createDataFrame([(1, "s", "alpha beta gamma"), (2, "s", "beta beta"), (3, "t", "delta"), (4, "t", None)], "doc_id long, source string, text string")
    pieces = library.chunks(docs, ["doc_id", "source"])
    papers = docs.select("doc_id", "source", F.when(F.col("doc_id") < 3, "factor").otherwise("strategy").alias("kind"))
    got = library.search_chunks(pieces, papers, ["doc_id", "source"], 'beta "OR" (delta)').collect()
    assert [r.doc_id for r in got] == [3, 2, 1] and got[0].score < 0
    assert [r.doc_id for r in library.search_chunks(pieces, papers, ["doc_id", "source"], "beta delta", kind="strategy").collect()] == [3]
    assert library.paper_context(pieces, ["doc_id"], {"doc_id": 4}).first().indexed is False
    assert library.paper_context(pieces, ["doc_id"], {"doc_id": 1}).first().fulltext == "alpha beta gamma"
    assert {r.doc_id: r.n_chunks for r in library.list_indexed(pieces, papers, ["doc_id", "source"]).collect()} == {1: 1, 2: 1, 3: 1}
    files = docs.select("doc_id", (F.col("doc_id") != 3).alias("file"), F.lit(None).cast("boolean").alias("bad"))
    s = library.ingest_summary(files.unionByName(spark.createDataFrame([(9, True, True)], files.schema)), pieces.select("doc_id", "chunk"), ["doc_id"], "file", "bad").first()
    assert (s.targets, s.skipped, s.no_file, s.failed, s.indexed) == (5, 3, 0, 1, 1)


def test_dates(spark):
    rows = ["2024-03-05", "2024-03-05T10:00:00+02:00", "Tue, 05 Mar 2024 10:00:00 +0200", "Tue, 05 Mar 2024 10:00:00 GMT", "soon", "", None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(F.date_format(library.parse_time(F.col("x")), "yyyy-MM-dd HH:mm").alias("t")).collect()]
    assert got == ["2024-03-05 00:00", "2024-03-05 08:00", "2024-03-05 08:00", "2024-03-05 10:00", None, None, None]
    days = [day(i) for i in range(14)]
    plus = [r.d for r in spark.createDataFrame([(x,) for x in days], "x date").orderBy("x").select(library.add_business_days(F.col("x"), 3).alias("d")).collect()]
    for x, y in zip(days, plus, strict=True):
        n, z = 0, x
        while n < 3:
            z += dt.timedelta(days=1)
            n += z.weekday() < 5
        assert y == z, (x, y, z)


def test_names_objects_and_encodings(spark):
    df = spark.createDataFrame([("arXiv", "2605.01300v2", "/x/Foo Bar (2026).pdf")], "s string, i string, f string")
    r = df.select(library.paper_slug(F.col("s"), F.col("i")).alias("a"), library.pdf_filename(F.col("s"), F.col("i")).alias("b"), library.slug_from_filename(F.col("f")).alias("c"), library.stable_hash(F.col("s"), F.col("i")).alias("h")).first()
    import hashlib

    assert (r.a, r.b, r.c) == ("arxiv_2605_01300v2", "arxiv_2605_01300v2.pdf", "foo-bar-2026") and r.h == hashlib.sha1(b"arXiv\x002605.01300v2\x00").hexdigest()[:16]
    assert library.first_object('so: ```json {"a": {"b": 1}} ``` {"c": 2}') == '{"a": {"b": 1}}' and library.first_object("{no} {}") == "{}" and library.first_object("[1]") is None
    t = spark.createDataFrame([("<think>why</think> yes",), ("hm</think>no",), ("plain",)], "t string").select(library.think_split(F.col("t")).alias("x")).collect()
    assert [(r.x.content, r.x.reasoning) for r in t] == [("yes", "why"), ("no", "hm"), ("plain", "")]
    wrong = "café – déjà".encode().decode("latin-1")
    assert library.repaired(wrong) == "café – déjà" and library.repaired("café") is None and library.repaired("well-known") is None
    d = spark.createDataFrame([('{"direction": "long", "confidence": 0.7}',), ('{"direction": "up", "confidence": 0.7}',), ('{"direction": "flat", "confidence": 7}',)], "t string").select(library.decision(F.col("t")).alias("d")).collect()
    assert [r.d and r.d.direction for r in d] == ["long", None, None]


def test_labels_listings_and_accounts(spark):
    labels = spark.createDataFrame([(1, "factor", ["a", "b"])], "doc_id long, kind string, subcats array<string>")
    changes = spark.createDataFrame([(1, 1, "remove", "A "), (1, 2, "add", " C"), (1, 3, "add", "b"), (2, 1, "kind", "strategy"), (1, 4, "kind", None)], "doc_id long, seq long, action string, value string")
    got = {r.doc_id: (r.kind, r.subcats) for r in library.labelled(labels, changes, ["doc_id"]).collect()}
    assert got == {1: (None, ["b", "c"]), 2: ("strategy", [])}
    with pytest.raises(Exception, match="unknown kind"):
        library.labelled(labels, spark.createDataFrame([(1, 1, "kind", "x")], changes.schema), ["doc_id"]).collect()
    papers = spark.createDataFrame([(1, "2024-01-01 10:00", "u", None, "factor", ["a"]), (2, "2024-01-02 10:00", "", "f", "strategy", [])], "id int, fetched_at string, pdf_url string, pdf_local string, kind string, subcats array<string>")
    ids = lambda **k: [r.id for r in library.list_papers(papers, **k).orderBy("id").collect()]
    assert ids(day="2024-01-02") == [2] and ids(day="2024-01-02", kind="factor") == [1] and ids(pdf="local") == [2] and ids(pdf="any") == [1] and ids(subcat="a") == [1]
    old = spark.createDataFrame([("x", 1)], "k string, v int")
    new = spark.createDataFrame([("x", 2), ("y", 4), ("y", 3)], "k string, v int")
    assert sorted(tuple(r) for r in library.appended(old, new, "k", "v").collect()) == [("x", 1), ("y", 3)]
    assert sorted(tuple(r) for r in joins.replaced(old, new.where("k = 'x'"), ["k"]).collect()) == [("x", 2)]


def test_state_machines(spark):
    s = [0.7, 0.7, 0.7, 0.7, 0.2, 0.7]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(s)], "symbol string, ts date, score double")
    assert [r.legs for r in portfolio.timing_legs(df, legs=2, cooldown=2).orderBy("ts").collect()] == [1, 1, 2, 2, 0, 1]
    p = [10, 10, 12, 11, 11.2, 9, 12.5]
    df = spark.createDataFrame([("a", day(i), float(x)) for i, x in enumerate(p)], "symbol string, ts date, close double")
    assert [round(r.position, 4) for r in portfolio.tail_hedge(df, lookback=3, steps=(0.1, 0.5)).orderBy("ts").collect()] == [0, 0, 0, -1, -1, -0.6667, 0]
    events = spark.createDataFrame([("g", day(0), "a"), ("g", day(0), "b"), ("g", day(0), "c"), ("g", day(2), "c")], "g string, d date, symbol string")
    sessions = spark.createDataFrame([("g", day(i)) for i in range(4)], "g string, d date")
    got = portfolio.event_hold(events, sessions, 2, 2).orderBy("d").collect()
    assert [(r.n_positions, r.opened, r.skipped) for r in got] == [(2, 2, 1), (2, 0, 0), (1, 1, 0), (1, 0, 0)]


def test_walk_forward_takes_the_best_threshold_of_training(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        good = rng.random() < 0.5
        rows.append(("a", day(i), 1.0, 0.9 if good else 0.2, 100.0, 0.0))
    rets = [0.0] + [0.02 if rows[i][3] > 0.5 else -0.03 for i in range(59)]
    df = spark.createDataFrame([(*r[:5], x) for r, x in zip(rows, rets, strict=True)], "symbol string, ts date, direction double, confidence double, price double, ret double")
    got = portfolio.nested_walk_forward(df, [0.1, 0.5], 60, 20, 10, whole=False).orderBy("fold").collect()
    assert len(got) == 4 and {r.chosen for r in got} == {0.5} and all(r.oos_sharpe > 0 for r in got)
    assert portfolio.fold_plan(10, 4, 3, 1, "rolling") == [(0, 4, 5, 8), (3, 7, 8, 10)]


def test_complexity_gap_of_copies_is_near_zero_and_of_noise_is_not(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=40)
    rows = [("same", f"k{k}", day(i), float(base[i])) for k in range(6) for i in range(40)] + [("noise", f"k{k}", day(i), float(rng.normal())) for k in range(6) for i in range(40)] + [("few", f"k{k}", day(i), 1.0 * i) for k in range(3) for i in range(40)]
    got = {r.g: r.gap for r in portfolio.complexity_gap(spark.createDataFrame(rows, "g string, symbol string, ts date, r double")).collect()}
    assert got["same"] == pytest.approx(0, abs=1e-9) and got["noise"] > 0.15 and got["few"] is None


def test_frames_in_force_and_guards(spark):
    b = spark.createDataFrame([("a", day(i), float(i)) for i in range(4)], "symbol string, ts date, close double")
    d = spark.createDataFrame([("a", day(1), "long"), ("a", day(3), "flat")], "symbol string, decided date, view string")
    assert [r.view for r in portfolio.replay(b, d).orderBy("ts").collect()] == [None, "long", "long", "flat"]
    with pytest.raises(ValueError, match="null"):
        portfolio.covered(b.withColumn("x", F.when(F.col("close") > 1, 1)), "x")
    assert portfolio.trim_tail_zeros(spark.createDataFrame([("a", day(0), 0.0), ("a", day(1), 1.0), ("a", day(2), 0.0)], "symbol string, ts date, r double")).count() == 2
    known = spark.createDataFrame([(1, day(0), 5), (2, day(2), 9), (3, None, 99)], "id int, known date, score int")
    seen = joins.visible_top(known, spark.createDataFrame([(day(i),) for i in range(1, 4)], "at date"), "known", "at", 1, "score", "id", 1).orderBy("at").collect()
    assert [(r.at, r.id) for r in seen] == [(day(1), 1), (day(2), 1), (day(3), 2)]


def test_random_walks_and_trends_are_told_apart(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=400)
    trend = np.zeros(400)
    for i in range(1, 400):
        trend[i] = 0.6 * trend[i - 1] + e[i]
    df = spark.createDataFrame([(s, day(i), float(x)) for s, v in (("noise", rng.normal(size=400)), ("trend", trend)) for i, x in enumerate(v)], "symbol string, ts date, r double")
    got = {r.symbol: r for r in validation.suitability(df).collect()}
    assert got["noise"].verdict == "unsuitable" and got["trend"].verdict == "suitable" and got["trend"].score > got["noise"].score
    c = trend - trend.mean()
    for r in validation.variance_ratio(df).where("symbol = 'trend'").collect():
        q, n = r.q, 400
        sums = np.convolve(c, np.ones(q), "valid")
        assert r.vr == pytest.approx((sums @ sums) / (q * (n - q + 1) * (1 - q / n)) / (c @ c / (n - 1)))
        theta = sum((2 * (q - k) / q) ** 2 * (c[k:] ** 2 @ c[:-k] ** 2) for k in range(1, q)) / (c @ c) ** 2
        assert r.z_het == pytest.approx((r.vr - 1) / math.sqrt(theta))
    s = np.sign(trend[trend != 0])
    assert {r.symbol: r.runs for r in validation.runs_test(df).collect()}["trend"] == 1 + (s[1:] != s[:-1]).sum()
    codes = [tuple(np.argsort(trend[i : i + 3], kind="stable")) for i in range(398)]
    p = np.unique(codes, axis=0, return_counts=True)[1] / 398
    assert {r.symbol: r.entropy for r in validation.permutation_entropy(df).collect()}["trend"] == pytest.approx(-(p * np.log(p)).sum() / math.log(6))


def test_diagrams_compose_and_run(spark):
    from fathomline.operators import dataflow
    from fathomline.operators.dataflow import GraphError, box, standard

    r = standard()
    frame = bars(spark, [10 + math.sin(i / 3) + i / 10 for i in range(60)], [1] * 60)
    data = box(r, "data.frame")
    chain = box(r, "feature.signed_momentum", lookback=3) >> box(r, "signal.direction") >> box(r, "sizing.fixed", exposure=0.5) >> box(r, "backtest.vector")
    assert chain.signature() == "(bars: Frame[bars]) -> (features: Frame[features], pnl: Frame[pnl], signal: Frame[signal], weights: Frame[weights])"
    with pytest.raises(GraphError, match="open inputs"):
        chain.graph()
    graph = (data >> chain).graph()
    assert dataflow.unavailable(graph, {"signal.direction"}) == {"signal.direction", "sizing.fixed", "backtest.vector"}
    r.types["data.frame"].run = lambda i, p: frame
    out = r.execute(graph)["backtest.vector"]["pnl"]
    assert out.count() == 60 and out.where("pnl <> 0").count() > 40
    with pytest.raises(GraphError, match="ambiguous"):
        data @ data
    with pytest.raises(GraphError, match="unknown parameters"):
        box(r, "sizing.fixed", leverage=2)
    with pytest.raises(GraphError, match="does not fit"):
        box(r, "data.frame", "d") >> dataflow.Diagram((), (), {"bars": (("x", "bars", "Frame[other]"),)})


def series(spark, x, symbol="a"):
    return spark.createDataFrame([(symbol, day(i), float(v)) for i, v in enumerate(x)], "symbol string, ts date, r double")


@pytest.mark.parametrize("wavelet", ["haar", "d4"])
def test_wavelets(spark, wavelet):
    from fathomline.operators import multiscale as m

    x = np.random.default_rng(0).normal(size=64)
    g, h = m.filters(wavelet)
    assert g.sum() == pytest.approx(1) and h.sum() == pytest.approx(0) and (g @ g, h @ h, g @ h) == pytest.approx((0.5, 0.5, 0))
    assert m.details(x, 3, wavelet).sum(0) == pytest.approx(x)
    w, v = m.circular(x, 3, wavelet)
    assert (w * w).sum() + (v * v).sum() == pytest.approx(x @ x)
    got = m.modwt(series(spark, x), 3, wavelet).orderBy("ts").toPandas()
    for j in (1, 2, 3):
        width = (2**j - 1) * (len(g) - 1) + 1
        assert got[f"w{j}"].isna().sum() == width - 1 and got[f"w{j}"][width - 1 :].to_numpy() == pytest.approx(w[j - 1][width - 1 :])
    parts = m.mra(series(spark, x), 3, wavelet).orderBy("ts").toPandas()
    assert parts[["d1", "d2", "d3", "s"]].sum(1).to_numpy() == pytest.approx(x)
    e = m.scale_energy(series(spark, x), 3, wavelet).first().energy
    assert sum(e) == pytest.approx(1) and len(e) == 4 and m.scale_energy(series(spark, [2.0] * 16), 2, wavelet).first().energy is None
    assert m.max_level(64, "haar") == 6 and m.max_level(2, "d4") == 1
    with pytest.raises(Exception, match="missing"):
        m.modwt(series(spark, x).withColumn("r", F.when(F.col("r") < 1, F.col("r"))), 1).collect()
    r = [v for v in values(m.resonance(series(spark, np.cumsum(np.ones(40))), 2), "resonance") if v is not None]
    assert r and all(v == pytest.approx(1) for v in r)


def test_lift(spark):
    from fathomline.operators import multiscale as m

    df = spark.createDataFrame([(i < 40, (i % 4 > 0) if i < 40 else i % 2 == 0) for i in range(200)] + [(True, None), (None, True)], "c boolean, s boolean")
    r = m.conditional_lift(df, F.col("c"), F.col("s")).first()
    assert (r.n, r.n_cond, r.p_cond) == (201, 40, 0.75) and r.p_uncond == pytest.approx(111 / 201) and r.lift == pytest.approx(0.75 / (111 / 201))
    pool = (111 + 30) / 241
    assert r.z == pytest.approx((0.75 - 111 / 201) / math.sqrt(pool * (1 - pool) * (1 / 201 + 1 / 40))) and r.low < 0.75 < r.high and r.power_warning is False

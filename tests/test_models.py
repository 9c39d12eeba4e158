"""Sampler, attention model, ensemble, API source and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import rows
from tallyforge.operators import association, energy, evaluate, neural, predictor, sampler, stats, strategies
from tallyforge.sources import api, draws, history
from tallyforge.streaming import ingest


@pytest.fixture(scope="module")
def d(spark, sf):
    return draws.draws(spark, sf).cache()


@pytest.fixture(scope="module")
def model(d):
    return energy.fit(d)


def test_fitted_tables_are_those_of_the_operators(d, model):
    s = stats.sum_distribution(d).first()
    assert (model.mean, model.std) == (pytest.approx(s["mean"]), pytest.approx(s["std"]))
    dist = {(r["dist"], tuple(k for k in (r["k1"], r["k2"], r["k3"]) if k is not None)): r["p"] for r in stats.distributions(d).collect()}
    assert {(n, k): p for n, own in model.dist.items() for k, p in own.items()} == pytest.approx(dist)
    f = {(r["colour"], r["ball"]): r["weight"] for r in stats.frequencies(d, 200).collect()}
    assert model.red == pytest.approx([f["red", b] for b in range(1, 34)]) and model.blue == pytest.approx([f["blue", b] for b in range(1, 17)])
    assert all(model.conditional[r["a"] - 1][r["b"] - 1] == pytest.approx(r["p"]) for r in stats.conditional(d, 200).collect())
    lifts = {(r["x"], r["y"]): r["lift"] for r in association.pair_scores(association.rules(association.itemsets(d, 0.01, 2, 200))).collect()}
    assert model.lifts == pytest.approx(lifts) and len(lifts) == 25
    assert energy.fit(d.limit(0)).lifts == {}


def test_plain_energy_is_the_query_energy(d, model):
    e = sampler.energy_function(model)
    blue = energy.blue_energy(model)
    for r in d.where("idx < 20").select("reds", "blue", energy.energy(model).alias("e")).collect():
        assert e(r["reds"], r["blue"]) == pytest.approx(r["e"] + blue[r["blue"] - 1])


def test_chains_are_seeded_and_near_the_exact_marginals(spark, model):
    s = sampler.sample(spark, model, 1500, n_chains=4, seed=3, thin=4).cache()
    again = sampler.sample(spark, model, 1500, n_chains=4, seed=3, thin=4)
    assert s.exceptAll(again).count() == 0 and s.count() == 6000
    exact = {r["ball"]: r["p"] for r in energy.marginal_exact(spark, model).collect()}
    seen = {r["ball"]: r["p"] for r in energy.marginal_share(s).collect()}
    assert np.mean([abs(exact[b] - seen.get(b, 0)) for b in exact]) < 0.06
    assert all(0.02 < r["acceptance"] < 0.98 for r in s.select("acceptance").distinct().collect())
    assert sampler.autocorrelation(s).count() == 4
    states = [(tuple(r["reds"]), r["blue"]) for r in sampler.distinct_states(s).collect()]
    assert len(states) == len(set(states)) and set(states) == {(tuple(r["reds"]), r["blue"]) for r in s.collect()}


def test_gradients_are_the_differences():
    rng = np.random.default_rng(0)
    p = neural.init(5, width=8, heads=2, length=4, seed=1)
    x, reds, blues = rng.normal(size=(3, 4, 5)), (rng.random((3, 33)) < 0.2).astype(float), rng.integers(0, 16, 3)
    _, g = neural.gradients(p, x, reds, blues)
    for name in g:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            keep, both = p[name][at], []
            for step in (1e-5, -1e-5):
                p[name][at] = keep + step
                both.append(neural.loss(*neural.forward(p, x)[:2], reds, blues))
            p[name][at] = keep
            assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-5)


def test_the_block_is_whole():
    p = neural.init(31, width=48, heads=2, length=20)
    assert sum(p[k].size for k in p if k not in neural.FIXED) == 32_017
    x = np.random.default_rng(1).normal(size=(2, 20, 31))
    red, blue, c = neural.forward(p, x)
    assert c["a"].shape == (2, 2, 20, 20) and np.allclose(c["a"].sum(-1), 1) and np.allclose(red.sum(1), 1) and np.allclose(blue.sum(1), 1)
    # One row by hand, a place at a time.
    h = [x[0, t] @ p["w_in"] + p["b_in"] + p["place"][t] for t in range(20)]
    heads = []
    for k in range(2):
        own = slice(k * 24, (k + 1) * 24)
        q, key, v = ([(y @ p[w])[own] for y in h] for w in "qkv")
        weights = [np.exp([a @ b / np.sqrt(24) for b in key]) for a in q]
        heads.append([sum(w / ws.sum() * b for w, b in zip(ws, v)) for ws in weights])

    def norm(r, g, s):
        return (r - r.mean()) / np.sqrt(((r - r.mean()) ** 2).mean() + 1e-5) * g + s

    out = []
    for t in range(20):
        y = norm(h[t] + np.concatenate([heads[0][t], heads[1][t]]) @ p["o"], p["gain1"], p["shift1"])
        z = y @ p["w_up"] + p["b_up"]
        f = 0.5 * z * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3))) @ p["w_down"] + p["b_down"]
        out.append(norm(y + f, p["gain2"], p["shift2"]))
    logits = np.mean(out, 0) @ p["w_red"] + p["b_red"]
    assert np.allclose(red[0], np.exp(logits) / np.exp(logits).sum())


def test_optimizer_and_clipping():
    g = {"a": np.array([3.0]), "b": np.array([[4.0]])}
    assert neural.clip_gradients(g, 10) is g and neural.clip_gradients(g, 1)["b"][0, 0] == pytest.approx(0.8)
    adam, p = neural.AdamW(rate=0.1, decay=0.5), {"a": np.array([2.0]), "b": np.array([[1.0]])}
    once = adam.step(p, {"a": np.array([0.5])})
    assert once["a"][0] == pytest.approx(2 * (1 - 0.05) - 0.1) and once["b"] is p["b"]
    twice = adam.step(once, {"a": np.array([-0.5])})
    m, v = (0.9 * 0.05 - 0.05) / (1 - 0.81), (0.999 * 0.00025 + 0.00025) / (1 - 0.998001)
    assert twice["a"][0] == pytest.approx(once["a"][0] * 0.95 - 0.1 * m / (np.sqrt(v) + 1e-8))


def test_vector_functions(spark):
    v = F.array(*map(F.lit, (1.0, -2.0, 3.0, 3.0)))
    m = neural.reshape(v, 2, 2)
    r = spark.range(1).select(neural.argsort(v).alias("up"), neural.argsort(v, True).alias("down"), neural.argmax(v).alias("most"), neural.shape(m).alias("shape"), neural.transpose(m).alias("t"), neural.outer(v, v).alias("o"), neural.one_hot(F.lit(1), 3).alias("one"), neural.softmax_2d(m).alias("s2"), neural.layer_norm(v, v, v).alias("ln"), neural.scaled(v, 2.0).alias("two"), neural.sub(v, v).alias("zero"), neural.sqrt(v).alias("root"), neural.binary_cross_entropy(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("bce")).first()
    assert r["up"] == [1, 0, 2, 3] and r["down"] == [2, 3, 0, 1] and r["most"] == 2 and r["shape"] == [2, 2] and r["t"] == [[1, 3], [-2, 3]] and r["o"][1] == [-2, 4, -6, -6] and r["one"] == [0, 1, 0]
    assert [sum(x) for x in r["s2"]] == pytest.approx([1, 1]) and r["two"][2] == 6 and set(r["zero"]) == {0} and r["root"][1] == 0 and r["bce"] == pytest.approx(-np.log(1e-10) / 2)
    x = np.array([1.0, -2, 3, 3])
    assert r["ln"] == pytest.approx(list((x - x.mean()) / np.sqrt(x.var() + 1e-5) * x + x))
    d = spark.range(2000).select(neural.dropout(F.array(F.lit(1.0), F.lit(2.0)), 0.25, F.col("id"), seed=3).alias("d"))
    kept = [x for row in d.collect() for x in row["d"]]
    assert sum(x == 0 for x in kept) / 4000 == pytest.approx(0.25, abs=0.03) and set(kept) <= {0.0, 1 / 0.75, 2 / 0.75} and d.collect() == d.collect()


def test_noise_has_mean_deviation_and_entropy(spark):
    p = spark.createDataFrame([(1, [0.5, 0.3, 0.2], [0.9, 0.1])], "idx long, red_p array<double>, blue_p array<double>")
    got = neural.noisy(p, 4000, 0.1, seed=5).collect()
    by = {(r["colour"], r["ball"]): r for r in got}
    draws_ = np.random.default_rng(0).normal(1, 0.1, (200_000, 3)) * [0.5, 0.3, 0.2]
    want = draws_ / draws_.sum(1, keepdims=True)
    for k in range(3):
        assert by["red", k + 1]["mean"] == pytest.approx(want[:, k].mean(), abs=0.002) and by["red", k + 1]["std"] == pytest.approx(want[:, k].std(), abs=0.002)
    means = [by["red", k]["mean"] for k in (1, 2, 3)]
    assert by["red", 1]["entropy"] == pytest.approx(-sum(m * np.log(m) for m in means)) and sum(by["blue", k]["mean"] for k in (1, 2)) == pytest.approx(1)
    assert all(r["std"] == 0 for r in neural.noisy(p, 5, 0.0).collect())


def test_cold_chains_and_autocorrelation(spark, model):
    e = sampler.energy_function(model)
    got, rate = sampler.chain(e, 50, 3, tau=1, burn_in=1000, thin=2)
    assert len(got) == 50 and 0 < rate < 1
    rows_ = [(0, k, float(x)) for k, x in enumerate([1, 3, 2, 5, 4])] + [(1, 0, 7.0)]
    r = {x["chain"]: x["r"] for x in sampler.autocorrelation(spark.createDataFrame(rows_, "chain int, sample int, energy double")).collect()}
    c = np.array([1, 3, 2, 5, 4]) - 3.0
    assert r[0] == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum()) and r[1] == 0


def test_evaluated_predictions(spark):
    p = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6], 7), (2, [1, 2, 3, 9, 10, 11], 8)], "idx long, reds array<int>, blue int")
    actual = spark.createDataFrame([(1, [1, 2, 3, 4, 20, 21], 7), (2, [1, 20, 21, 22, 23, 24], 9)], "idx long, reds array<int>, blue int")
    r = neural.evaluate(p, actual).first()
    assert (r["n"], r["avg_hits"], r["blue_rate"], r["share_3"]) == (2, 2.5, 0.5, 0.5) and r["red_rate"] == pytest.approx(2.5 / 6)


def test_training_lowers_the_loss(spark, d, tmp_path):
    seq = neural.sequences(d, [c / 33.0 for c in rows.positional().values()], 5).cache()
    p = neural.init(6, width=8, heads=2, length=5)
    best, losses = neural.train(seq, p, epochs=6, rate=0.02)
    assert losses[-1] < losses[0]
    got = neural.predict(seq, best)
    first = got.first()
    assert sum(first["red_p"]) == pytest.approx(1) and len(first["reds"]) == 6
    assert neural.evaluate(got, d).first()["n"] == seq.count()
    assert neural.evaluate(got.limit(0), d).first()["red_rate"] == 0
    neural.save(best, spark, str(tmp_path / "p"))
    assert all(np.allclose(neural.load(spark, str(tmp_path / "p"))[k], v) for k, v in best.items())
    assert neural.noisy(got.limit(2), 5).agg(F.sum("mean")).first()[0] == pytest.approx(4)
    assert all(sum(w) == pytest.approx(1) for w in first["attention"])


def test_vector_columns(spark):
    v, m = F.array(*map(F.lit, (1.0, 2.0))), F.array(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(5.0), F.lit(6.0)))
    r = spark.range(1).select(neural.mat_vec(m, v).alias("p"), neural.softmax(v).alias("s"), neural.layer_norm(v).alias("n"), neural.variance(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))).alias("var"), neural.multi_hot(F.array(F.lit(2)), 3).alias("h"), neural.relu(F.array(F.lit(-1.0))).alias("r"), neural.gelu(F.array(F.lit(0.0))).alias("g"), neural.sigmoid(F.array(F.lit(0.0))).alias("sg")).first()
    assert r["p"] == [11.0, 17.0] and sum(r["s"]) == pytest.approx(1) and r["var"] == 1.25 and r["h"] == [0, 1, 0] and r["r"] == [0.0] and r["sg"] == [0.5]


def test_strategies_pick_seven_balls(d):
    for name, make in strategies.STRATEGIES.items():
        one = make(100)(d).first()
        assert len(set(one["reds"])) == 6 and one["reds"] == sorted(one["reds"]) and 1 <= one["blue"] <= 16, name
    assert strategies.paired(min_lift=99)(d).first() == strategies.frequency()(d).first()


def test_ensemble_votes_and_learns(spark, d):
    e = strategies.Ensemble(spark)
    assert e.predict(d).count() == 0
    e.add("even", strategies.frequency())
    e.add("recent", strategies.frequency(20), 2.0)
    e.add("broken", lambda _: 1 / 0)
    got = e.predict(d).first()
    assert len(got["reds"]) == 6 and 0 < got["confidence"] <= 1
    picks = {r["member"]: r for r in e.last.collect()}
    assert set(picks) == {"even", "recent"} and got["blue"] == picks["recent"]["blue"]
    e.update(picks["even"]["reds"], picks["even"]["blue"])
    assert e.weights["even"] == pytest.approx(1.0)
    summary = {r["member"]: r for r in e.summary().collect()}
    assert summary["even"]["recent"] == pytest.approx(0.1) and summary["broken"]["weight"] == 1.0
    e.remove("broken")
    assert e.summary().count() == 2


def test_cross_validation_by_method(d):
    each, summary = evaluate.run_cv(d, evaluate.frequency_picks, "expanding", least=200, val=50, step=50)
    s = summary.first()
    assert each.count() == s["n_folds"] > 1 and s["red_to_chance"] == pytest.approx(s["red_rate_mean"] * 33 / 6)
    assert evaluate.run_cv(d, evaluate.frequency_picks, "anchored", anchors=(0.2, 0.5))[0].count() == 2
    none, empty = evaluate.run_cv(d, evaluate.frequency_picks, "rolling", train=10**6, val=1, step=1)
    assert none.count() == 0 and empty.count() == 0
    with pytest.raises(ValueError):
        evaluate.run_cv(d, evaluate.frequency_picks, "other")


def test_short_histories_have_no_significance(d):
    assert strategies.hotness_test(d.where("idx < 15")).first()["p"] == 1.0
    assert strategies.permutation_test(d.where("idx < 5")).first()["p"] == 1.0


def test_facade_predicts_and_reports(spark, d):
    p = predictor.Predictor(spark, seed=4)
    with pytest.raises(ValueError):
        p.predict()
    m = p.prepare(d)
    got = p.predict(5, 1200)
    best = got.recommendations.collect()
    assert len(best) == 5 and [r["score"] for r in best] == sorted((r["score"] for r in best), reverse=True)
    e, blue = sampler.energy_function(m), energy.blue_energy(m)
    for r in best:
        reds = [r[f"r{k}"] for k in range(1, 7)]
        assert r["energy"] == pytest.approx(e(reds, r["blue"])) and blue[r["blue"] - 1] <= r["energy"]
    share = {(r["colour"], r["ball"]): r["p"] for r in got.marginals.collect()}
    assert sum(v for (c, _), v in share.items() if c == "red") == pytest.approx(6) and sum(v for (c, _), v in share.items() if c == "blue") == pytest.approx(1)
    assert got.n_candidates > 100 and got.diagnostics.count() == 4 and got.ranked.count() == 5
    lines = predictor.report(got).collect()
    assert {r["section"] for r in lines} == {"recommendations", "ranked", "marginals red", "marginals blue"} and all(r["line"] for r in lines)
    exact = p.predict(3, 0)
    assert exact.n_candidates == 0 and exact.recommendations.count() == 3 and exact.ranked.count() == 0


def make_transport(d, n: int):
    found = {r["issue"]: r.asDict(recursive=True) for r in history.api_objects(d.where(f"idx < {n}")).collect()}

    def transport(params, timeout):
        if params["transactionType"] == "list":
            return {"resCode": "000000", "issue": sorted(found, key=int, reverse=True)[: int(params["count"])]}
        if params["issue"] not in found:
            return {"resCode": "999"}
        return {"resCode": "000000"} | found[params["issue"]]

    return transport, found


def test_api_source(spark, d):
    transport, found = make_transport(d, 12)
    ids = [r["issue"] for r in api.issue_list(spark, transport).collect()]
    assert len(ids) == 12
    got = history.parse_issue(api.issue_details(spark, transport, [*ids, "0"], chunk=5))
    assert got.count() == sum(int(i) % 7 != 0 for i in ids)
    tried = []

    def failing(params, timeout):
        tried.append(1)
        raise OSError

    assert api.fetch(failing, {}, wait=lambda s: None) is None and len(tried) == 3
    for bad in ({}, {"resCode": "0"}, {"resCode": None}, ["000000"]):
        assert api.fetch(lambda params, timeout, bad=bad: bad, {}) is None


def test_update_appends_and_counts(spark, d):
    transport, found = make_transport(d, 12)
    store = history.raw(d.where("idx BETWEEN 4 AND 8"))
    after, outcome = history.completed(spark, store, transport, 10)
    rows_ = outcome.orderBy("place").collect()
    ids = sorted(int(i) for i in found)[-10:]
    have = {int(r["issue"]) for r in store.collect()}
    assert [int(r["issue"]) for r in rows_] == [i for i in ids if i not in have]
    assert all(r["stored"] == (int(r["issue"]) % 7 != 0) for r in rows_)
    assert after.count() == 5 + sum(r["stored"] for r in rows_)
    again, nothing = history.completed(spark, after, transport, 10)
    assert not nothing.where("stored").count() and again.count() == after.count()


def test_malformed_files_are_counted(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"期号": "1", "红球": "01 02 03 04 05 06", "蓝球": "07"}, {"期号": "2", "红球": "1 2 3 4 5 6", "蓝球": "8"}]')
    (tmp_path / "bad.json").write_text('[{"期号": "3", "红球"')
    assert history.load_history(spark, str(tmp_path)).count() == 2
    bad = history.malformed(spark, str(tmp_path)).collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("bad.json") and history.malformed(spark, str(tmp_path / "none")).count() == 0
    assert history.load_history(spark, str(tmp_path / "none")).count() == 0


def test_polling_waits_for_the_draw(spark, d, tmp_path):
    from datetime import datetime

    at = datetime(2024, 2, 20, 21, 30)  # a Tuesday
    assert api.due(at, "") and not api.due(at, "20240220") and api.due(at, "20240218")
    assert not api.due(at.replace(hour=21, minute=29), "") and not api.due(at.replace(day=21), "")
    transport, found = make_transport(d, 12)
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    for clock, many in ((lambda: datetime(2024, 2, 21, 22, 0), 0), (lambda: datetime(2024, 2, 20, 22, 0), 1), (lambda: datetime(2024, 2, 20, 23, 0), 1)):
        q = ingest.follow(spark, transport, store, checkpoint, clock, "0 seconds")
        q.processAllAvailable()
        q.stop()
        have = ingest.stored_ids(spark, store)
        want = {int(i) for i in sorted(found, key=int)[-10:] if int(i) % 7}
        assert ({r["draw_no"] for r in have.collect()} if have is not None else set()) == (want if many else set())


def test_draw_status(d):
    s = history.status(d, "2030-01-01").first()
    days = d.selectExpr("count(*) AS n", "max(draw_no) AS last", "datediff(max(draw_date), min(draw_date)) AS days", "datediff(DATE'2030-01-01', max(draw_date)) AS since").first()
    assert (s["total"], s["latest"], s["days_covered"], s["days_since"], s["missed"]) == (days["n"], days["last"], days["days"], days["since"], days["since"] // 2)


def test_streamed_ids_are_stored_once(spark, d, tmp_path):
    raw = [r.asDict() for r in history.raw(d.where("idx < 9")).collect()]
    source = tmp_path / "in"
    source.mkdir()
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    for k, part in enumerate((raw[:5], raw[3:9], raw[3:9])):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in part))
        ingest.ingest(spark, str(source), store, checkpoint).awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("draw_no").distinct().count() == 9
    ingest.full_refresh(spark, str(source), str(tmp_path / "anew"))
    assert spark.read.parquet(str(tmp_path / "anew")).count() == 9


def test_streamed_weights_are_the_folded_ones(spark, tmp_path):
    scores = spark.createDataFrame([(m, k, (m + k) % 5 / 5) for m in range(2) for k in range(12)], "member int, idx long, score double")
    scores.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = ingest.weight_stream(spark.readStream.schema(scores.schema).parquet(str(tmp_path / "s")))
    q = stream.writeStream.format("memory").queryName("weights").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    folded = {r["member"]: r["weight"] for r in evaluate.member_weights(scores).collect()}
    assert all(r["weight"] == pytest.approx(folded[r["member"]]) for r in spark.table("weights").collect())

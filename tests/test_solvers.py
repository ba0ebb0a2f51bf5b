"""Grouped solvers on planted answers and against plain searches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyospark.operators import bias, bic, segmentation as sg


def test_lowess_follows_a_curve_and_ignores_outliers():
    rng = np.random.default_rng(0)
    x = rng.uniform(0.2, 0.8, 600)
    y = 100 + 80 * (x - 0.5) ** 2 + rng.normal(0, 0.5, 600)
    y[::50] += 60
    fit = sg.lowess_fit(x, y, 0.2)
    assert np.abs(fit - (100 + 80 * (x - 0.5) ** 2)).max() < 1.5


def test_gc_correction_flattens_and_zeroes_masked(spark):
    rng = np.random.default_rng(1)
    rows = [("s", "1", i, float(200 * (0.5 + g) + rng.normal(0, 2)), float(g), i % 10 == 0) for i, g in enumerate(rng.uniform(0.3, 0.7, 300))]
    df = spark.createDataFrame(rows, "sample string, chrom string, bin bigint, n double, gc double, masked boolean")
    got = sg.gc_lowess(df, frac=0.3).toPandas()
    assert (got[got.masked].value == 0).all()
    kept = got[~got.masked]
    assert abs(np.corrcoef(kept.gc, kept.value)[0, 1]) < 0.2 and abs(kept.value.mean() - 1) < 0.01


def test_cbs_finds_planted_segment_and_leaves_noise_alone(spark):
    rng = np.random.default_rng(2)
    step = rng.normal(0, 0.1, 200)
    step[80:120] += 0.6
    flat = rng.normal(0, 0.1, 200)
    rows = [(s, "1", i, float(v)) for s, x in (("step", step), ("flat", flat)) for i, v in enumerate(x)]
    got = sg.cbs_segments(spark.createDataFrame(rows, "sample string, chrom string, bin bigint, log2_ratio double"), permutations=2000)
    out = got.toPandas()
    assert (out["sample"] == "flat").sum() == 1
    s = out[out["sample"] == "step"].sort_values("start_bin")
    assert s.n_bins.sum() == 200 and len(s) == 3
    mid = s.iloc[1]
    assert abs(mid.start_bin - 80) <= 2 and abs(mid.end_bin - 119) <= 2 and mid["mean"] > 0.5


def test_cbs_finds_step_at_the_end():
    x = np.concatenate([np.zeros(90), np.ones(30)]) + np.random.default_rng(3).normal(0, 0.1, 120)
    assert sg.cbs_breaks(x, 1e-4, 1000, 1) == pytest.approx([0, 90, 120], abs=1)


def test_best_arc_matches_search():
    x = np.random.default_rng(4).normal(0, 1, 24)
    s = np.concatenate([[0], np.cumsum(x - x.mean())])
    want = max(abs(s[j] - s[i]) / math.sqrt((j - i) * (1 - (j - i) / 24)) for i in range(24) for j in range(i + 2, 25) if 2 <= j - i <= 22)
    assert sg.best_arc(x)[0] == pytest.approx(want)


def test_best_arc_in_lots_of_widths_matches_search_of_all_bounds():
    for n in (1, 3, 4, 5, 24, 61):
        x = np.random.default_rng(n).poisson(2, n).astype(float)
        s = np.concatenate([[0], np.cumsum(x - x.mean())])
        want = max([abs(s[j] - s[i]) / math.sqrt((j - i) * (1 - (j - i) / n)) for i in range(n) for j in range(i + 2, n + 1) if j - i <= n - 2], default=0)
        whole, lots = sg.best_arc(x), sg.best_arc(x, cells=3 * n)
        z, i, j = whole
        assert whole == lots and z == pytest.approx(want)
        assert want == 0 or abs(s[j] - s[i]) / math.sqrt((j - i) * (1 - (j - i) / n)) == pytest.approx(want)


def test_solver_gets_whole_groups_however_batches_cut_them(spark):
    sizes = [1, 9, 3, 30, 7, 7, 2, 1, 14]
    rows = [(f"s{g // 4}", str(g), i) for g, n in enumerate(sizes) for i in range(n)] + [(None, "1", 5), (None, "1", 6)]
    df = spark.createDataFrame(rows, "sample string, chrom string, bin bigint").repartition(3)

    def size(cols, params):
        assert len(set(cols["sample"])) == len(set(cols["chrom"])) == 1
        return {"chrom": [cols["chrom"][0]], "n": [len(cols["bin"])], "total": [int(cols["bin"].sum())]}

    key, least = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    old = {k: spark.conf.get(k) for k in (key, least)}
    try:
        for batch in (1, 7, 1000):
            spark.conf.set(key, batch)
            out = sg.run_solver(df, size, "chrom string, n bigint, total bigint", None, ("sample", "chrom"))
            got = sorted((r.chrom, r.n, r.total) for r in out.collect())
            assert got == sorted([(str(g), n, n * (n - 1) // 2) for g, n in enumerate(sizes)] + [("1", 2, 11)])
            # No message of its own for each group.
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_outlier_cap_reads_one_sliding_window(spark):
    rng = np.random.default_rng(5)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(0, 1, 120) * np.where(rng.random(120) < 0.1, 12, 1)]
    rows = [("s", c, i, v) for c, track in (("1", x), ("2", [4.0]), ("3", [1.0, 9.0])) for i, v in enumerate(track)]
    df = sg.cap_outliers(spark.createDataFrame(rows, "sample string, chrom string, bin bigint, log2_ratio double"), region=4)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("specifiedwindowframe(RowFrame, -") == 2  # lag and neighbours
    sd = np.median([abs(b - a) for a, b in zip(x, x[1:]) if a is not None and b is not None]) * 1.4826 / math.sqrt(2)
    want = []
    for i, v in enumerate(x):
        others = [u for u in [*x[max(i - 4, 0):i], *x[i + 1:i + 5]] if u is not None]
        med = np.median([*others, v]) if v is not None else None
        want.append(v if v is None or min(others) - 4 * sd <= v <= max(others) + 4 * sd else med + (2 if v > med else -2) * sd)
    got = {(r.chrom, r.bin): r.log2_ratio for r in df.collect()}
    assert want != x and [got["1", i] for i in range(len(x))] == [None if w is None else pytest.approx(w) for w in want]
    assert [got["2", 0], got["3", 0], got["3", 1]] == [4.0, 1.0, 9.0]


def slow_merge(obs, exp, price):
    """Same greedy rule by recomputing everything."""
    segs = [(i, list(o), list(e)) for i, (o, e) in enumerate(zip(obs.tolist(), exp.tolist()))]
    level = 2
    while True:
        merged = 0
        while len(segs) >= level:
            best = None
            for i in range(len(segs) - level + 1):
                part = segs[i:i + level]
                o, e = [sum(v) for v in zip(*(p[1] for p in part))], [sum(v) for v in zip(*(p[2] for p in part))]
                g = sg._cost(o, e) - sum(sg._cost(p[1], p[2]) for p in part) - (level - 1) * price
                if g < 0 and (best is None or g < best[0]):
                    best = (g, i, o, e)
            if best is None:
                break
            _, i, o, e = best
            segs[i:i + level] = [(segs[i][0], o, e)]
            merged += 1
        if merged:
            level += 1
        elif level <= 2:
            return [s[0] for s in segs] + [len(obs)]
        else:
            level -= 1


@pytest.mark.parametrize("seed", range(4))
def test_bic_merge_matches_recomputation(seed):
    rng = np.random.default_rng(seed)
    rate = np.where(np.arange(60) // 20 == 1, 40, 20)
    obs, exp = rng.poisson(rate)[:, None].astype(float), np.full((60, 1), 20.0)
    assert sg.bic_merge(obs, exp, 1.2 * math.log(2000)) == slow_merge(obs, exp, 1.2 * math.log(2000))


def test_bic_segments_two_levels(spark):
    rng = np.random.default_rng(7)
    rate = np.where((np.arange(400) >= 150) & (np.arange(400) < 250), 60, 30)
    rows = [("s", "1", int(i * 100 + 1), int((i + 1) * 100), int(o), 30.0, 2.0) for i, o in enumerate(rng.poisson(rate))]
    df = spark.createDataFrame(rows, "sample string, chrom string, start bigint, end bigint, obs bigint, expected double, lam double")
    for block in (50_000, 64):
        got = sg.bic_segments(df, [("obs", "expected")], block=block).toPandas().sort_values("start")
        assert got.bin_num.sum() == 400 and got.obs.sum() == sum(r[4] for r in rows)
        assert len(got) == 3 and abs(got.iloc[1].bin_num - 100) <= 4


def test_bic_segments_many_samples(spark):
    rows = [("g", "1", i * 100 + 1, (i + 1) * 100, 40 if i < 20 else 20, 20.0, 20, 20.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "grp string, chrom string, start bigint, end bigint, o1 bigint, e1 double, o2 bigint, e2 double, lam double")
    got = sg.bic_segments(df, [("o1", "e1"), ("o2", "e2")], group="grp").toPandas().sort_values("start")
    assert got.bin_num.tolist() == [20, 30]


def test_theta_of_a_bin_is_that_of_its_group(spark):
    rows = [(s, str(i % 3), i, float(i % 5), 0.0 if s == "none" or i == 4 else 1.5, 2.0) for s in ("a", "b", "none", None) for i in range(len(s or "xy") * 7)]
    df = spark.createDataFrame(rows, "sample string, chrom string, bin bigint, obs double, expected double, var double")
    want = {r["sample"]: r.theta for r in bic.noise_factor(df.filter("sample IS NOT NULL"), ["sample"]).collect()}
    got = bic.with_theta(df, "sample").collect()
    assert set(want) == {"a", "b"} and len(got) == 14
    assert all(r.theta == pytest.approx(want[r["sample"]]) for r in got)


def test_bic_query_reads_its_table_once(spark):
    from karyospark.plans.catalogue import CATALOGUE
    plan = CATALOGUE["w12_bic_segments"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey#") and plan.count("Relation [") == 1


def test_bic_merge_counts_each_likelihood_once(monkeypatch):
    calls, cost = [], sg._cost
    monkeypatch.setattr(sg, "_cost", lambda o, e: calls.append(1) or cost(o, e))
    n = 200
    assert sg.bic_merge(np.full((n, 1), 20.0), np.full((n, 1), 20.0), 10.0) == [0, n]
    # One a bin, one a pair, two for the neighbours of each merge.
    assert len(calls) <= 4 * n


def test_close_neighbours_merge(spark):
    rows = [("s", "1", 1, 10, 5, 100.0, 100.0, 0.0), ("s", "1", 11, 20, 5, 103.0, 100.0, 0.0), ("s", "1", 21, 30, 5, 200.0, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "sample string, chrom string, start bigint, end bigint, bin_num bigint, obs double, expected double, adjust double")
    got = sg.merge_close(df).toPandas().sort_values("start")
    assert got.bin_num.tolist() == [10, 5] and got.obs.tolist() == [203.0, 200.0] and got.end.tolist() == [20, 30]


def test_mixture_recovers_tied_means(spark):
    rng = np.random.default_rng(8)
    alpha, xi = 0.3, 0.02
    mus = [i / 2 + alpha * (1 - i / 2) + xi for i in range(4)]
    x = np.concatenate([rng.normal(m, 0.04, k) for m, k in zip(mus, (100, 400, 2000, 500))])
    df = spark.createDataFrame([("s", float(v)) for v in x], "sample string, ratio double")
    for equal in (True, False):
        m = sg.copy_ratio_models(df, components=range(3, 7), starts=4, equal_variance=equal).first()
        assert m.ploidy == 2 and abs(m.alpha - alpha) < 0.08 and abs(m.mu[2] - mus[2]) < 0.05
        assert sum(v > 0 for v in m.p) == 4


def test_gc_loess_ratio_is_flat(spark):
    rng = np.random.default_rng(9)
    rows = [("s", "1", i, int(rng.poisson(200 * math.exp(g))), float(g)) for i, g in enumerate(rng.uniform(0.3, 0.7, 400))]
    df = spark.createDataFrame(rows, "sample string, chrom string, start bigint, obs bigint, gc double")
    r = sg.gc_loess_ratio(df).toPandas()
    assert abs(r.ratio.mean() - 1) < 0.02 and abs(np.corrcoef(r.gc, r.ratio)[0, 1]) < 0.15


def test_chi_square_tail(spark):
    zs = [0.0, 0.5, 1.0, 1.96, 3.0, 5.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", bic.chi1_upper(F.col("z")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-6)


def _cells(spark, gc, letters, n, fragment=300):
    rows = [(int(round(g * (2 * fragment + 1))), [int(x) for x in c], float(v)) for g, c, v in zip(gc, letters, n)]
    return bias.covariate_cells(spark.createDataFrame(rows, "gc_count int, letters array<tinyint>, n double"))


def test_bias_regression_recovers_gc_slope_and_letters(spark):
    rng = np.random.default_rng(10)
    gc, letters = rng.uniform(0.3, 0.7, 4000), rng.integers(0, 4, (4000, 2))
    effect = np.array([[0, 0.3, -0.4, 0.1], [0, 0.0, 0.2, -0.2]])
    n = rng.poisson(np.exp(0.5 + 2 * gc + effect[0][letters[:, 0]] + effect[1][letters[:, 1]]))
    cells = _cells(spark, gc, letters, n)
    model = bias.fit_bias(cells, 300, [-1, 0])
    assert np.abs(model.letters - effect[:, 1:]).max() < 0.06 and 0 < model.theta <= 10.0 and model.steps < 15
    at = spark.createDataFrame([(240, [0, 0]), (361, [2, 0])], "gc_count int, letters array<tinyint>")
    got = [r.rate for r in at.select(model.rate().alias("rate")).collect()]
    assert got == pytest.approx([math.exp(0.5 + 2 * 240 / 601), math.exp(0.1 + 2 * 361 / 601)], rel=0.08)
    # the score equations hold: expected reads equal observed ones for each term
    judged = cells.withColumn("expected", F.col("positions") * model.rate())
    for i in range(2):
        for code in (1, 2, 3):
            r = judged.where(F.get("letters", F.lit(i)) == code).agg(F.sum("expected"), F.sum("reads")).first()
            assert r[0] == pytest.approx(r[1], rel=1e-7)


def test_bias_fits_of_odd_training_sets(spark):
    none = bias.fit_bias(_cells(spark, [], [], []), 300, [0])
    assert none.intercept == -math.inf and spark.createDataFrame([(5, [1])], "gc_count int, letters array<tinyint>").select(none.rate()).first()[0] == 0
    one = bias.fit_bias(_cells(spark, [0.5] * 4, [[1]] * 4, [1, 2, 3, 2]), 300, [0])  # one cell: all columns but the mean are undetermined
    cell = spark.createDataFrame([(300, [1])], "gc_count int, letters array<tinyint>").select(one.rate()).first()[0]
    assert cell == pytest.approx(2.0)


def test_bin_rates_sum_the_rates_of_positions(spark):
    rng = np.random.default_rng(12)
    seq = "".join(rng.choice(list("ACGTN"), 700))
    chunks = spark.createDataFrame([("c", a, seq[a:b]) for a, b in ((0, 90), (90, 91), (91, 700))] + [("short", 0, "ACGT")], "chrom string, offset bigint, seq string")
    refine = (bias.Spline(0.2, 0.8), 0.05, [0.1, -0.05, 0.02, 0.3, 0, 0, 0.1])
    model = bias.BiasModel(20, bias.read_offsets(3, 25), bias.Spline(0.1, 0.7), -1.0, [0.5, -0.2, 0.1, 0.3, -0.1, 0.2, 0.4], rng.normal(0, 0.1, (12, 3)), 4.0, refine)
    got = {r.bin: r for r in bias.bin_rates(chunks, model, 50, tile=64).collect()}
    positions = spark.createDataFrame([("c", p) for p in range(700)], "chrom string, pos bigint")
    rows = bias.covariates(positions, chunks, 20, model.offsets, tile=128).withColumn("rate", model.rate()).collect()
    assert len(rows) == 700 - 2 * 27
    for k, r in got.items():
        own = [x for x in rows if x.pos // 50 == k]
        assert r.positions == len(own) and r.expected == pytest.approx(sum(x.rate for x in own)) and r["var"] == pytest.approx(sum(x.rate + x.rate**2 / 4 for x in own))
        assert r.gc == pytest.approx(sum(x.gc_count for x in own) / 41 / len(own))
    assert sum(r.positions for r in got.values()) == len(rows)


def test_bin_rates_of_many_short_tiles_in_one_go(spark, monkeypatch):
    """Contigs of all lengths, some too short and some with letters of several bytes: each bin has the sums of its positions, by few calls."""
    rng = np.random.default_rng(21)
    texts = {f"c{i}": "".join(rng.choice(list("ACGTgtNé漢\U0001f9ec"), k)) for i, k in enumerate([*rng.integers(1, 400, 60), 0, 24, 25, 26])}
    chunks = spark.createDataFrame([(c, 0, s) for c, s in texts.items()], "chrom string, offset bigint, seq string")
    offsets = [-2, -1, 0, 1, 2, 3, 4, 7, 12]
    model = bias.BiasModel(12, offsets, bias.Spline(0.2, 0.7), -0.5, [0.3, -0.2, 0.1, 0.4, -0.3, 0.2, 0.1], rng.normal(0, 0.3, (9, 3)), 3.0)
    want = {}
    for c, s in texts.items():
        codes = [{"G": 1, "C": 2, "T": 3}.get(x.upper(), 0) for x in s]
        for p in range(12, len(s) - 12):
            count = sum(k in (1, 2) for k in codes[p - 12:p + 13])
            rate = math.exp(model.gc_curve()[count] + sum(([0.0, *model.letters[i]])[codes[p + k]] for i, k in enumerate(offsets)))
            one = want.setdefault((c, p // 50), [0, 0.0, 0.0, 0.0])
            for i, v in enumerate((1, rate, rate + rate * rate / 3.0, count / 25)):
                one[i] += v
    for run in (bias._RUN_BYTES, 1000, 1):
        monkeypatch.setattr(bias, "_RUN_BYTES", run)
        got = {(r.chrom, r.bin): r for r in bias.bin_rates(chunks, model, 50, tile=128).collect()}
        assert set(got) == set(want)
        for key, (n, expected, var, gc) in want.items():
            r = got[key]
            assert r.positions == n and [r.expected, r.var, r.gc] == pytest.approx([expected, var, gc / n], rel=1e-9)


def test_covariates_stream_over_batches(spark):
    """Tiles and positions in batches of three rows, contigs without positions and the other way round; no join sends the sequence to each row."""
    rng = np.random.default_rng(22)
    texts = {f"c{i}": "".join(rng.choice(list("ACGTé"), k)) for i, k in enumerate((300, 20, 150, 90))}
    chunks = spark.createDataFrame([(c, 0, s) for c, s in texts.items()], "chrom string, offset bigint, seq string")
    rows = [(c, int(p), float(p % 3), f"r{p}") for c in ("c0", "c1", "c3", "x") for p in (0, 9, 10, 63, 64, 65, 79, 80, 139, 289, 290, 400, 64)]
    rows += [(None, 20, 1.0, "no"), ("c0", None, 1.0, "no")]
    positions = spark.createDataFrame(rows, "chrom string, pos bigint, n double, name string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = bias.covariates(positions, chunks, 10, [-3, 0, 10], tile=64)
        assert df.columns == ["chrom", "pos", "n", "name", "gc_count", "letters"] and "Join" not in df._jdf.queryExecution().toString()
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    code = {"G": 1, "C": 2, "T": 3}
    assert got == sorted((c, p, n, name, sum(x in "GC" for x in texts[c][p - 10:p + 11]), [code.get(texts[c][p + k], 0) for k in (-3, 0, 10)])
                         for c, p, n, name in rows if c in texts and p is not None and 10 <= p < len(texts[c]) - 10)


def test_cells_of_spots_are_those_of_rows(spark):
    rows = [("a", p, float(n)) for p, n in ((1, 2), (1, 3), (1, 3), (2, 0), (5, 4))] + [("a", 5, None), ("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "chrom string, pos bigint, n double")
    cell = [(F.col("pos") % 2).alias("gc_count"), F.array("chrom").alias("letters")]
    one, two = (sorted(tuple(r) for r in bias.covariate_cells(d.select("*", *cell)).collect()) for d in (df, bias.spots(df)))
    assert one == two and len(one) == 3


def test_bias_chain_reads_the_sequence_once(spark, monkeypatch):
    """Tiles, spots and first bins are tables; no later step goes back to the documents."""
    from karyospark.plans import bic_queries
    from karyospark.plans.catalogue import CATALOGUE
    read, write = [], bic_queries.materialise
    keep = lambda df, name: (read.append((name, df._jdf.queryExecution().analyzed().toString())), write(df, name))[1]
    monkeypatch.setattr(bic_queries, "materialise", keep)
    monkeypatch.setattr(bias, "materialise", keep)
    out = CATALOGUE["a58_bias_chain"].run(spark, "/root/testdata/sf0.001")
    read.append(("result", out._jdf.queryExecution().analyzed().toString()))
    assert [n for n, plan in read if "text#" in plan] == ["sequence-tiles"]


def test_covariates_match_slices(spark):
    seq = "".join(np.random.default_rng(11).choice(list("ACGTN"), 500))
    cuts = [0, 37, 37, 120, 300, 500]
    chunks = spark.createDataFrame([("c", a, seq[a:b]) for a, b in zip(cuts, cuts[1:])], "chrom string, offset bigint, seq string")
    pos = spark.createDataFrame([("c", p) for p in range(0, 500, 11)], "chrom string, pos bigint")
    got = {r.pos: r for r in bias.training_covariates(pos, chunks, 12, 2, tile=64).collect()}
    assert sorted(got) == [p for p in range(0, 500, 11) if p >= 12 and p + 12 < 500]
    for p, r in got.items():
        w = seq[p - 12:p + 13]
        assert r.gc == pytest.approx((w.count("G") + w.count("C")) / 25)
        assert [r["G-2"], r["C-1"], r["T0"], r["G1"]] == [int(seq[p - 2] == "G"), int(seq[p - 1] == "C"), int(seq[p] == "T"), int(seq[p + 1] == "G")]
    win = {r.pos: r.gc_count for r in bias.gc_window(chunks, 10, tile=64).collect()}
    assert win == {p: sum(c in "GC" for c in seq[p - 10:p + 11]) for p in range(10, 490)}
    both = bias.training_covariates(pos, chunks, 12, 2, tile=64, read_length=9).collect()
    whole = bias.training_covariates(pos, chunks, 12, 2, tile=64, read_length=9, whole_read=True).collect()
    assert [r.pos for r in sorted(both, key=lambda r: r.pos)] == [p for p in range(0, 500, 11) if p >= 12 and p + 12 < 500]
    for r in both:
        assert [r["T7"], r["G10"]] == [int(seq[r.pos + 7] == "T"), int(seq[r.pos + 10] == "G")] and "G3" not in r
    assert all([r["T3"], r["G10"]] == [int(seq[r.pos + 3] == "T"), int(seq[r.pos + 10] == "G")] for r in whole)


def test_negative_binomial_and_polynomial_fits(spark):
    rng = np.random.default_rng(13)
    gc = rng.uniform(0.3, 0.7, 4000)
    mu = np.exp(1.0 + 1.5 * gc)
    n = rng.poisson(mu * rng.gamma(2.0, 0.5, 4000))
    model = bias.fit_bias(_cells(spark, gc, np.zeros((4000, 0)), n), 300, [], negative_binomial=True)
    got = spark.createDataFrame([(300, [])], "gc_count int, letters array<tinyint>").select(model.rate()).first()[0]
    assert got == pytest.approx(math.exp(1.75), rel=0.08) and 1.4 < model.theta < 2.8
    bins = spark.createDataFrame([(float(g), float(0.3 - 0.8 * g + e)) for g, e in zip(gc, rng.normal(0, 0.02, 4000))], "gc double, log_ratio double")
    for polynomial in (False, True):
        model, inputs = bic.fit_refine(bins, polynomial=polynomial)
        at = spark.createDataFrame([(0.4,)], "gc double").withColumns(bic.hinge_columns(F.col("gc"), bic.KNOTS))
        assert at.select(bic.refine_term(model, inputs).alias("o")).first().o == pytest.approx(-0.02, abs=0.02)
    spline, intercept, coefficients = bias.fit_refine_curve(bins)
    assert intercept + float((spline.basis(np.array([0.4])) @ np.array(coefficients))[0]) == pytest.approx(-0.02, abs=0.005)


def test_bias_positions_reach_the_end_of_long_contigs(spark):
    from karyospark.plans import bic_queries
    from karyospark.plans.projections import ref_chunks

    sf = "/root/testdata/sf0.01"
    length = {r.chrom: r.n for r in ref_chunks(spark, sf).groupBy("chrom").agg(F.sum(F.length("seq")).alias("n")).collect()}
    got = bic_queries._marked(spark, sf).collect()
    assert all(0 <= r.pos < length[r.chrom] for r in got)
    assert max(r.pos for r in got) > 3000 and any(r.pos > 0.9 * length[r.chrom] > 3000 for r in got)


def test_resampled_and_circular_shares_need_no_joins(spark):
    """Draws and circular runs against plain loops, whole blocks for long segments included; no draw or run is a row."""
    from karyospark.operators import bic
    track = [("s", i % 2 + 1, i * 10, i * 10 + 9, (i * 7) % 5, 0.5 + i % 3) for i in range(240)]
    bins = spark.createDataFrame(track, "sample string, chrom_num int, start bigint, end bigint, obs bigint, expected double")
    order = sorted(track, key=lambda b: (b[1], b[2]))
    segs = spark.createDataFrame([("s", 7, 3, 4, 2.0), ("s", 8, 120, 90, 80.0), ("none", 9, 1, 1, 1.0)],
                                 "sample string, seg_id bigint, bin_num bigint, obs bigint, expected double")
    df = bic.resampled_significance(segs, bins, 20, 2)
    got = {r.seg_id: r.z for r in df.collect()}
    fine, coarse = [b[4:] for b in order], [tuple(map(sum, zip(*(b[4:] for b in order[i:i + 2])))) for i in range(0, 240, 2)]
    for seg, pool, n, m, o, e in ((7, fine, 240, 3, 4, 2.0), (8, coarse, 120, 60, 90, 80.0)):
        freq = []
        for draw in range(1, 21):
            at = [(seg * 7368787 + draw * 1299709 + k * 15485863) % 2147483647 * 48271 % 2147483647 % n for k in range(1, m + 1)]
            a, b = sum(pool[i][0] for i in at), sum(pool[i][1] for i in at)
            freq.append(a / (a + b + 1e-10))
        assert got[seg] == pytest.approx((o / (o + e + 1e-10) - np.mean(freq)) / max(np.std(freq, ddof=1), 0.01))
    assert set(got) == {7, 8}
    regions = spark.createDataFrame([("s", 1, 500, 9, 4.0), ("s", 2, 0, 0, 0.0)], "sample string, region int, n bigint, obs bigint, expected double")
    rd = bic.region_significance(regions, bins)
    p = {r.region: r.pvalue for r in rd.collect()}
    runs = [[order[(i + k) % 240][4:] for k in range(500)] for i in range(240)]
    f = [round((sum(x[0] for x in r) + 1e-10) / (sum(x[0] + x[1] for x in r) + 1e-10), 9) for r in runs]
    own = round((9 + 1e-10) / (13 + 1e-10), 9)
    tail = 2 * min(sum(x <= round(own + 0.01, 9) for x in f), sum(x >= round(own - 0.01, 9) for x in f)) / 240
    assert p == {1: pytest.approx(min(1.0, tail) if tail else 1 / 240), 2: 1.0}
    assert all("Join" not in d._jdf.queryExecution().toString() for d in (df, rd))


def _one_mixture(x, w, n, start, equal_variance):
    """One fit by itself, row by row of the method: what the fits of all models and samples at once must give for each."""
    rng, i = np.random.default_rng(start * 1009 + n), np.arange(n) / 2.0
    alpha, xi, last = rng.uniform(0.0, 0.6), 0.0, -np.inf
    var = np.full(n, float(np.average((x - np.average(x, weights=w)) ** 2, weights=w)) / n + 1e-4)
    p = rng.dirichlet(np.full(n, 5.0))
    for _ in range(200):
        mu = i + alpha * (1 - i) + xi
        dens = p * np.exp(-((x[:, None] - mu) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var)
        total = dens.sum(axis=1) + 1e-300
        ll = float((w * np.log(total)).sum())
        if ll - last < 1e-6 * abs(ll):
            break
        last = ll
        r = w[:, None] * dens / total[:, None]
        m = r.sum(axis=0)
        p = np.where(m / w.sum() < 1e-4, 0.0, m)
        p = p / p.sum()
        q, y = m / var, (r * (x[:, None] - i)).sum(axis=0) / var
        a = np.array([[(q * (1 - i) ** 2).sum(), (q * (1 - i)).sum()], [(q * (1 - i)).sum(), q.sum()]]) + 1e-9 * np.eye(2)
        alpha = float(np.clip(np.linalg.solve(a, [(y * (1 - i)).sum(), y.sum()])[0], 0.0, 0.999))
        xi = float((y - q * alpha * (1 - i)).sum() / q.sum())
        spread_sq = (r * (x[:, None] - (i + alpha * (1 - i) + xi)) ** 2).sum(axis=0)
        pooled = max(float(spread_sq.sum() / w.sum()), 1e-6)
        var = np.full(n, pooled) if equal_variance else np.where(p > 0, np.maximum(spread_sq / np.maximum(m, 1e-9), 1e-6), pooled)
    return {"alpha": alpha, "xi": xi, "loglik": last, "p": p, "mu": i + alpha * (1 - i) + xi, "var": var}


@pytest.mark.parametrize("equal_variance", [True, False])
def test_mixtures_at_once_equal_single_fits_in_few_passes(monkeypatch, equal_variance):
    """All models of several samples, of unlike numbers of points; a pass over all of them is one call of exp, not one a fit."""
    rng = np.random.default_rng(4)
    models = [(n, start) for n in range(3, 16) for start in range(10)]
    groups = []
    for s, k in enumerate((40, 25, 33)):
        cell = np.sort(rng.choice(250, k, replace=False))
        order = rng.permutation(k)
        groups.append({"sample": np.array([f"s{s}"] * k), "cell": cell[order], "x": (cell / 100 + 0.004)[order], "w": rng.integers(1, 300, k)})
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: (calls.append(1), exp(*a, **k))[1])
    got = list(sg._fitted(groups, models, sg._mixture_starts(models), equal_variance))
    monkeypatch.undo()
    assert len(calls) <= 200
    for g, out in zip(groups, got, strict=True):
        order = np.argsort(g["cell"])
        for k, (n, start) in enumerate(models):
            one = _one_mixture(g["x"][order], g["w"][order].astype(float), n, start, equal_variance)
            assert (out["sample"][k], out["n"][k], out["start"][k]) == (g["sample"][0], n, start)
            assert all(np.allclose(out[c][k], one[c], rtol=1e-6, atol=1e-8) for c in one)
            assert [v > 0 for v in out["p"][k]] == [v > 0 for v in one["p"]]


def test_mixtures_of_one_ratio(spark):
    """A sample whose ratios are all 0.5 leaves alpha open; the single fits could stop there with a singular matrix."""
    rows = [("a", 0.5)] * 2000 + [("b", 1.0)] * 50
    got = {r.sample: r for r in sg.mixture_models(spark.createDataFrame(rows, "sample string, ratio double"), range(3, 5), 2).collect()}
    assert set(got) == {"a", "b"}
    for s, x in (("a", 0.5), ("b", 1.0)):
        assert math.isfinite(got[s].bic) and min(abs(m - x) for m, p in zip(got[s].mu, got[s].p) if p > 0) < 1e-3


def test_copy_ratio_models_reads_the_bins_once(spark, monkeypatch):
    """Quantiles, cut and fits read the counted ratios, not the bins again for each."""
    read, write = [], sg.materialise
    monkeypatch.setattr(sg, "materialise", lambda df, name: (read.append(df), write(df, name))[1])
    rows = [(s, 0.5 * (i % 4) + (i % 7) / 100) for s in "ab" for i in range(400)] + [("a", 90.0), ("b", None)]
    df = spark.createDataFrame(rows, "sample string, ratio double")
    best = sg.copy_ratio_models(df, components=range(3, 5), starts=2)
    plans = [df._jdf.queryExecution().analyzed().toString() for df in (*read, best)]
    assert ["LogicalRDD" in p for p in plans] == [True, False, False]
    from karyospark.operators.bic import mad_cut
    every = sg.best_model(sg.mixture_models(mad_cut(df, ["sample"], "ratio"), range(3, 5), 2))
    assert "REPARTITION_BY_NUM" in best._jdf.queryExecution().executedPlan().toString()
    for a, b in zip(sorted(best.collect()), sorted(every.collect()), strict=True):
        assert (a.sample, a.n, a.start) == (b.sample, b.n, b.start) and a.bic == pytest.approx(b.bic, rel=1e-9)


def test_quantiles_of_counted_rows(spark):
    """Rows that stand for several equal values, in groups that are ordered at once and in groups that are narrowed by rank."""
    from karyospark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(6)
    rows = [(g, float(v), int(n)) for g, k in (("few", 30), ("many", 900)) for v, n in zip(rng.normal(size=k), rng.integers(1, 40, k) ** 2)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    for block in (100_000, 200):
        got = {r.g: r for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99], block, count="n").collect()}
        for g in ("few", "many"):
            all_of = np.repeat([v for k, v, _ in rows if k == g], [n for k, _, n in rows if k == g])
            assert got[g].n == len(all_of) and got[g].q == pytest.approx(np.quantile(all_of, [0.1, 0.5, 0.99]).tolist())


def test_all_mixtures_of_a_sample_share_one_group(spark):
    """Every (components, start) is fitted from one shuffled histogram: no copies of it for the fits."""
    ratios = spark.createDataFrame([(s, 0.5 * (i % 4) + i / 1000) for s in "ab" for i in range(60)], "sample string, ratio double")
    df = sg.mixture_models(ratios, range(3, 5), 2)
    assert "Generate" not in df._jdf.queryExecution().toString()
    assert sorted((r.sample, r.n, r.start) for r in df.collect()) == [(s, n, i) for s in "ab" for n in (3, 4) for i in (0, 1)]

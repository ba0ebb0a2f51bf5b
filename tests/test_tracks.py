"""Bin tracks: counting rules, proportions, references, masks, smoothing."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from karyospark.operators import counts, masks, reference, smoothing
from karyospark.operators.bic import cap_outliers, disjoint_pieces
from karyospark.schema import CHROMOSOME_LENGTHS

B = 10_000_000
READS = "sample string, chrom string, pos bigint, end bigint"


def test_read_over_an_edge_counts_twice_and_tail_is_dropped(spark):
    n21 = CHROMOSOME_LENGTHS["21"] // B
    rd = [("s", "21", B - 10, B + 10), ("s", "21", 5, 6), ("s", "21", n21 * B + 1, n21 * B + 5)]
    got = counts.count_reads(spark.createDataFrame(rd, READS), B)
    assert {r.bin: r.n for r in got.filter("chrom = '21'").collect()} == {0: 2, 1: 1, **{i: 0 for i in range(2, n21)}}
    assert got.count() == sum(n // B for n in CHROMOSOME_LENGTHS.values())


def test_bins_with_reads_are_found_without_joining_the_grid(spark):
    """A filter on the counts once made the join of the grid an inner one, which broadcast all bins of all samples."""
    rd = [("s", "21", 5, 6), ("s", "nowhere", 5, 6), (None, "1", 5, 6)]
    bins = counts.count_reads(spark.createDataFrame(rd, READS), B)
    plan = bins.filter("n > 0")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert [tuple(r) for r in bins.filter("n > 0").collect()] == [("s", "21", 0, 1)]
    assert bins.filter("sample IS NULL").agg(F.count("*"), F.sum("n")).first() == (sum(n // B for n in CHROMOSOME_LENGTHS.values()), 0)


def test_sample_without_autosome_reads(spark):
    rd = [("x", "X", 5, 6), ("a", "1", 5, 6)]
    bins = counts.count_reads(spark.createDataFrame(rd, READS), B)
    assert [r.sample for r in counts.frequency(bins, B, "n").select("sample").distinct().collect()] == ["a"]
    p = counts.proportion(bins, B, "n").filter("sample = 'x'").agg(F.sum("proportion")).first()[0]
    assert p == 0.0


def test_proportion_leaves_own_chromosome_out(spark):
    b = spark.createDataFrame([("s", "1", 0, 10.0), ("s", "2", 0, 30.0), ("s", "X", 0, 8.0)], "sample string, chrom string, bin bigint, value double")
    got = {r.chrom: r.proportion for r in counts.proportion(b, 1).collect()}
    assert got == pytest.approx({"1": 10 / 30, "2": 30 / 10, "X": 8 / 40})


def test_shares_and_sex_from_tracks_are_those_from_bins(spark):
    """Sums are taken before the bins are listed: no window sees a bin."""
    rng = random.Random(7)
    rd = [(s, c, p, p + rng.choice([1, 50, B])) for s, chroms in (("f", ["1", "2", "X"]), ("m", ["1", "3", "X", "Y"]), ("x", ["X", "Y"]), ("one", ["5"]))
          for c in chroms for p in [rng.randrange(CHROMOSOME_LENGTHS[c]) for _ in range(20)]] + [(None, "1", 5, 6)]
    reads = spark.createDataFrame(rd, READS)
    got = counts.proportions_and_sex(reads, B)
    bins = counts.count_reads(reads, B).withColumn("value", F.col("n").cast("double"))
    want = counts.with_sex(counts.proportion(bins, B), "proportion")
    cols = ["sample", "chrom", "bin", "n", "value", "sex", *[F.round(c, 9).alias(c) for c in ("proportion", "xy_ratio")]]
    assert got.count() == want.count() and got.select(cols).exceptAll(want.select(cols)).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Window")


def test_tracks_are_dealt_over_many_tasks_whatever_the_session_has(spark):
    """A task sorts the bins that it lists, so with few shuffle partitions its memory grew with the number of samples."""
    bins = counts.count_reads(spark.createDataFrame([("s", "21", 5, 6)], READS), B)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < bins.rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism


def test_reference_uses_females_for_x_and_males_for_y(spark):
    rows = [("f", "female", "X", 0, 2.0), ("m", "male", "X", 0, 9.0), ("f", "female", "Y", 0, 9.0), ("m", "male", "Y", 0, 1.0),
            ("f", "female", "1", 0, 1.0), ("m", "male", "1", 0, 3.0)]
    df = spark.createDataFrame(rows, "sample string, sex string, chrom string, bin bigint, v double")
    assert {r.chrom: r.reference for r in reference.reference_mean(df, "v").collect()} == {"X": 2.0, "Y": 1.0, "1": 2.0}


def test_one_sex_only_is_an_error(spark):
    ok = spark.createDataFrame([("a", "male"), ("b", "female")], "sample string, sex string")
    assert reference.require_both_sexes(ok).count() == 2
    with pytest.raises(PySparkException):
        reference.require_both_sexes(ok.filter("sex = 'male'")).collect()


def test_bins_without_reference_are_aberrant_and_majority_flags_chromosome(spark):
    rows = [("s", "1", i, 1.0 if i < 2 else 2.0, 1.0) for i in range(5)] + [("s", "2", 0, 0.0, 0.0), ("s", "2", 1, 1.0, 1.0), ("s", "2", 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, chrom string, bin bigint, ratio double, reference double")
    got = {(r.chrom, r.bin): r.aberrant for r in reference.aberrant_bins(df).collect()}
    assert all(got["1", i] for i in range(5))
    assert got["2", 0] and not got["2", 1] and not got["2", 2]


def test_totals_by_one_window_a_track_and_one_a_sample(spark):
    rng = random.Random(11)
    rows = [(s, c, i, float(rng.randrange(4)), rng.choice([0.0, 0.5, 1.0, 1.1, 2.0, None]), rng.choice([0.0, 1.0, 2.5, None] if c == "3" else [1.0, 2.0, 0.5]))
            for s in ("a", "b", "c") for c in ("1", "2", "3", "X", "Y") for i in range(12)]
    rows += [("none", "1", i, 1.0, None, None) for i in range(3)] + [("none", "2", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, chrom string, bin bigint, value double, ratio double, reference double")
    got = reference.aberration_totals(df)
    want = reference.adjusted_totals(reference.rescale(reference.aberrant_bins(df)))
    cols = ["sample", "chrom", "bin", "aberrant", F.round("scale", 9).alias("scale"), F.round("total", 9).alias("total")]
    assert got.count() == want.count() == len(rows) and got.select(cols).exceptAll(want.select(cols)).isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


def test_masks_only_grow(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.random(), rng.random(), i % 9 == 0) for c in ("1", "2", "X", "Y") for i in range(40)]
    df = spark.createDataFrame(rows, "chrom string, bin bigint, mean double, cv double, masked boolean")
    z = masks.zscore_mask(df, limit=1.2)
    c = masks.cv_mask(z)
    d = masks.dilate(c)
    sets = [{(r.chrom, r.bin) for r in x.filter("masked").collect()} for x in (df, z, c, d)]
    assert sets[0] <= sets[1] < sets[2] < sets[3]
    kept_auto = 80 - sum(1 for k in sets[1] if k[0] in "12")
    assert sum(1 for k in sets[2] - sets[1] if k[0] in "12") == -(-kept_auto // 10)
    assert sets[3] == {(k, b) for k in ("1", "2", "X", "Y") for b in range(40) if {(k, b - 1), (k, b), (k, b + 1)} & sets[2]}


def test_combine_masks_keeps_one_sided_bins(spark):
    s = "chrom string, bin bigint, masked boolean"
    a, b = spark.createDataFrame([("1", 0, True), ("1", 1, False)], s), spark.createDataFrame([("1", 1, True), ("1", 2, False)], s)
    assert {r.bin: r.masked for r in masks.combine_masks(a, b).collect()} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("how", ["mean", "median"])
def test_nearest_valid_matches_search(spark, how):
    import statistics
    rng = random.Random(5)
    x = [rng.random() if rng.random() > 0.4 else None for _ in range(60)]
    df = spark.createDataFrame([("s", "1", i, v) for i, v in enumerate(x)], "sample string, chrom string, bin bigint, log2_ratio double")
    got = {r.bin: r.smoothed for r in smoothing.nearest_valid(df, 5, how).collect()}
    valid = [i for i, v in enumerate(x) if v is not None]
    for i in range(60):
        near = sorted(valid, key=lambda j: (abs(j - i), j >= i))[:5]
        want = (statistics.mean if how == "mean" else statistics.median)([x[j] for j in near])
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("how", ["mean", "median"])
def test_nearest_valid_writes_its_conditions_once(spark, how):
    """Repeated for each sum they made a method that the JVM no longer compiles."""
    df = spark.createDataFrame([("s", "1", 0, 1.0)], "sample string, chrom string, bin bigint, log2_ratio double")
    plan = smoothing.nearest_valid(df, 4, how)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(CASE WHEN") == 1 and sum(line.count("CASE WHEN") > 20 for line in plan.splitlines()) <= 1


def test_bilateral_keeps_steps_and_masks(spark):
    x = [0.0, 0.01, -0.01, 0.0, None, 1.0, 1.01, 0.99, 1.0]
    df = spark.createDataFrame([("s", "1", i, v) for i, v in enumerate(x)], "sample string, chrom string, bin bigint, log2_ratio double")
    got = {r.bin: r.smoothed for r in smoothing.bilateral(df, 5, sigma_range=0.05).collect()}
    assert got[4] is None and abs(got[3]) < 0.02 and abs(got[5] - 1) < 0.02


def test_outlier_cap_blocks_agree_with_one_block(spark):
    rng = random.Random(6)
    rows = [(s, "1", p, 50 if rng.random() < 0.04 else rng.randrange(1, 4)) for s, n in (("hot", 300), ("cold", 12)) for p in rng.sample(range(5_000_000), n)]
    df = spark.createDataFrame(rows, "sample string, chrom string, pos bigint, n bigint")
    small = cap_outliers(df, 20, block=32).collect()
    whole = cap_outliers(df, 20).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, whole)) and len(small) == len(rows)
    for s in ("hot", "cold"):
        mine = sorted((p, n) for ss, _, p, n in rows if ss == s)
        capped = {r.pos: r.n for r in small if r["sample"] == s}
        for i, (p, n) in enumerate(mine):
            c = max(min(i, len(mine) - 11), 9) if len(mine) > 20 else i
            win = sorted(v for _, v in mine[max(0, c - 9):c + 11])
            if len(mine) > 20:
                assert capped[p] == min(n, 5 * win[-(-95 * len(win) // 100) - 1])


@pytest.mark.parametrize("block", [3, 100_000])
def test_exact_quantiles_with_a_hot_group(spark, block):
    import numpy as np

    from karyospark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(12)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", "c"]), float(np.round(rng.normal(), 2)) if i % 7 else 0.5) for i in range(900)]
    rows += [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), *(("wild", float(10.0**k * (-1) ** k)) for k in range(-80, 80))]
    df = spark.createDataFrame([(None if k is None else str(k), v) for k, v in rows], "k string, v double")
    cuts = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: (r.n, r.q) for r in exact_quantiles(df, ["k"], "v", cuts, block=block).collect()}
    for k in ("hot", "a", "b", "c", "one", None, "wild"):
        v = [x for kk, x in rows if kk == k]
        assert got[k][0] == len(v) and got[k][1] == pytest.approx(np.quantile(v, cuts))
    assert "none" not in got


def test_exact_quantiles_narrow_a_large_group_in_rounds(spark, monkeypatch):
    import numpy as np

    from karyospark.operators import quantiles
    monkeypatch.setattr(quantiles, "GRID", 16)
    df = spark.range(60_000).selectExpr("id % 3 > 0 as k", "pow(rand(4), 9) * 1e6 as v").union(spark.range(5000).selectExpr("true", "7.5D"))
    df = spark.createDataFrame(df.toPandas())
    cuts = [0.001, 0.25, 0.5, 0.9, 0.9999]
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", cuts, block=40).collect()}
    frame = df.toPandas()
    for k in (True, False):
        v = frame.v[frame.k == k]
        assert got[k].n == len(v) and got[k].q == pytest.approx(np.quantile(v, cuts)) and got[k]["mean"] == pytest.approx(v.mean())


def test_exact_quantiles_of_many_small_groups_are_one_aggregate(spark):
    from karyospark.operators.quantiles import exact_quantiles
    df = spark.range(300_000).selectExpr("id div 3 as k", "cast(id % 3 as double) as v")
    got = exact_quantiles(df, ["k"], "v", [0.0, 0.25, 1.0], block=1000)
    assert got.filter("n = 3 AND q = array(0.0D, 0.5D, 2.0D)").count() == 100_000


def test_mappable_runs_tile_the_pieces(spark):
    from karyospark.operators.bic import mappable_runs
    rng = random.Random(8)
    iv = [("c", a, a + rng.randrange(0, 30)) for a in rng.sample(range(400), 25)] + [("d", 5, 9)]
    pos = {("c", p): rng.randrange(1, 5) for p in rng.sample(range(430), 120)} | {("e", 4): 2}
    pieces = disjoint_pieces(spark.createDataFrame(iv, "chrom string, start bigint, end bigint"), ["chrom"], 64)
    counts = spark.createDataFrame([(c, p, n) for (c, p), n in pos.items()], "chrom string, pos bigint, n bigint")
    runs = mappable_runs(counts, pieces, ["chrom"], 64).collect()
    listed = [(r.chrom, p, r.n) for r in runs for p in range(r.start, r.end)]
    mappable = {(c, p) for c, a, z in iv for p in range(a, z)}
    assert sorted(listed) == sorted((c, p, pos.get((c, p), 0)) for c, p in mappable)
    assert all(r.n == 0 or r.end == r.start + 1 for r in runs)


def test_sliding_quantile_against_sorting():
    import numpy as np

    from karyospark.operators.bic import sliding_quantile
    rng = np.random.default_rng(2)
    for top in (1, 2, 5, 1000):
        v = rng.integers(0, top, 300)
        first = rng.integers(0, 250, 80)
        last = first + rng.integers(1, 51, 80)
        for q in (0.05, 0.5, 0.95, 1.0):
            want = [np.sort(v[a:z])[int(np.ceil((z - a) * q)) - 1] for a, z in zip(first, last)]
            assert sliding_quantile(v, first, last, q).tolist() == want

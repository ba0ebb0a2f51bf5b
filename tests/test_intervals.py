"""Interval operators against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from karyospark.operators import intervals
from karyospark.operators.bic import disjoint_pieces, equal_mappability_bins, gap_distance, position_rank, ranked_pieces
from karyospark.operators.running import running_totals


def make(n, seed, span=2000, longest=300, keys="abc"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = "a" if i % 3 == 0 else rng.choice(keys)
        s = rng.randrange(span)
        out.append((k, i, s, s + rng.randrange(1, longest), rng.randrange(10)))
    return out


SCHEMA = "k string, id int, start bigint, end bigint, v int"


def overlap(a, b, closed):
    return a[2] <= b[3] and b[2] <= a[3] if closed else a[2] < b[3] and b[2] < a[3]


def test_running_totals_blocks_and_hot_position(spark):
    rng = random.Random(1)
    ev = [("a", 50 if i % 3 == 0 else rng.randrange(300), rng.randrange(5)) for i in range(500)] + [("b", 7, 1)]
    got = {(r.k, r.x): r.run_m for r in running_totals(
        spark.createDataFrame(ev, "k string, x bigint, m int"), ["k"], "x", ["m"], block=16).collect()}
    assert got == {(k, x): sum(m for kk, xx, m in ev if kk == k and xx <= x) for k, x, _ in ev}


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("salt", [1, 4])
def test_overlap_pairs(spark, closed, salt):
    a, b = make(90, 2), make(70, 3)
    got = intervals.overlap_pairs(spark.createDataFrame(a, SCHEMA),
                                  spark.createDataFrame(b, SCHEMA).withColumnsRenamed({"id": "r_id", "v": "r_v"}),
                                  ["k"], bucket=64, closed=closed, salt=salt)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and overlap(x, y, closed))
    assert sorted((r.id, r.r_id) for r in got.collect()) == want


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_sums_make_no_pairs_but_match_them(spark, closed):
    a, b = make(80, 4), make(120, 5)
    got = intervals.overlap_sum(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"], ["id"],
                                {"total": "v"}, closed)
    want = {x[1]: (sum(1 for y in b if y[0] == x[0] and overlap(x, y, closed)),
                   sum(y[4] for y in b if y[0] == x[0] and overlap(x, y, closed))) for x in a}
    assert {r.id: (r.n, r.total) for r in got.collect()} == want


@pytest.mark.parametrize("closed", [False, True])
def test_track_sums_match_pairs_and_take_one_exchange(spark, closed):
    a, b = make(80, 14), make(120, 15)
    q = spark.createDataFrame([*a, ("a", 900, None, 50, 0), ("a", 901, 5, None, 0), (None, 902, 0, 999, 0), ("none", 903, 0, 999, 0)], SCHEMA)
    held = spark.createDataFrame([*b, ("a", 0, None, 40, 7), ("a", 0, 3, None, 7), (None, 0, 0, 999, 7)], SCHEMA)
    got = intervals.track_overlap_sum(q.withColumnRenamed("v", "own"), held, ["k"], {"total": "v"}, closed)
    want = {x[1]: (x[0], x[2], x[3], x[4], sum(1 for y in b if y[0] == x[0] and overlap(x, y, closed)),
                   sum(y[4] for y in b if y[0] == x[0] and overlap(x, y, closed))) for x in a}
    want |= {900: ("a", None, 50, 0, 0, 0), 901: ("a", 5, None, 0, 0, 0), 902: (None, 0, 999, 0, 0, 0), 903: ("none", 0, 999, 0, 0, 0)}
    assert {r.id: (r.k, r.start, r.end, r.own, r.n, r.total) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_region_counts_neither_join_nor_exchange_their_edges_again(spark):
    from karyospark.operators import bic
    regions = spark.createDataFrame([("s", 1, "1", 50, 250, "x"), ("s", 2, "1", 950, 990, "y"), ("s", 3, "2", 1, 2, "z")],
                                    "sample string, region int, chrom string, start bigint, end bigint, note string")
    bins = spark.createDataFrame([("s", "1", i * 100 + 1, i * 100 + 100, i, 0.5 * i) for i in range(9)] + [("t", "2", 1, 100, 9, 9.0)],
                                 "sample string, chrom string, start bigint, end bigint, obs bigint, expected double")
    got = bic.region_counts(regions, bins)
    assert sorted((r.region, r.note, r.n, r.size, r.obs, r.expected) for r in got.collect()) == [
        (1, "x", 3, 300, 3, 1.5), (2, "y", 0, 0, 0, 0.0), (3, "z", 0, 0, 0, 0.0)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_covered_length(spark):
    a, b = make(80, 6), make(120, 7)
    got = intervals.covered_length(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"], ["id"])
    want = {x[1]: sum(max(0, min(x[3], y[3]) - max(x[2], y[2])) for y in b if y[0] == x[0]) for x in a}
    assert {r.id: r.covered for r in got.collect()} == want


def test_touching_intervals_do_not_overlap_half_open(spark):
    q = spark.createDataFrame([("a", 1, 10, 20, 0)], SCHEMA)
    b = spark.createDataFrame([("a", 1, 0, 10, 0), ("a", 2, 20, 30, 0)], SCHEMA)
    assert [r.touched for r in intervals.touched(q, b, ["k"], ["id"]).collect()] == [False]
    assert [r.touched for r in intervals.touched(q, b, ["k"], ["id"], closed=True).collect()] == [True]


def test_best_overlap_takes_first_of_equals(spark):
    regions = spark.createDataFrame([("a", 1, 0, 100), ("a", 2, 500, 600)], "k string, id int, start bigint, end bigint")
    seg = spark.createDataFrame([("a", 0, 50, 1.0, 7), ("a", 50, 100, 2.0, 3)], "k string, start bigint, end bigint, cn double, seg_id int")
    got = {r.id: r.cn for r in intervals.best_overlap(regions, seg, ["k"], ["id"], "cn", "seg_id").collect()}
    assert got == {1: 2.0, 2: None}


def test_first_hit_order(spark):
    pts = spark.createDataFrame([("a", 1, 10, 12)], "k string, id int, start bigint, end bigint")
    reg = spark.createDataFrame([("a", 0, 50, "late", 9), ("a", 11, 60, "early", 2)], "k string, start bigint, end bigint, name string, o int")
    assert intervals.first_hit(pts, reg, ["k"], ["id"], "name", "o").first().name == "early"
    assert intervals.first_hit(pts, reg, ["k"], ["id"], "name", "o", inside=True).first().name == "late"


def test_segment_at_over_block_edges(spark):
    seg = spark.createDataFrame([("a", 0, 95, 1.0, 1), ("a", 100, 900, 2.0, 2)], "k string, start bigint, end bigint, cn double, seg_id bigint")
    pts = spark.createDataFrame([("a", p) for p in (0, 95, 97, 100, 512, 900, 901)], "k string, pos bigint")
    got = {r.pos: r.cn for r in intervals.segment_at(pts, seg, ["k"], "pos", "cn", block=64).collect()}
    assert got == {0: 1.0, 95: 1.0, 97: None, 100: 2.0, 512: 2.0, 900: 2.0, 901: None}


def test_segment_at_keeps_every_point_without_joining_back(spark):
    """Repeated points, missing keys and positions, further columns; the points go through one exchange."""
    seg = spark.createDataFrame([("a", 0, 95, 1.0, 1), (None, 0, 95, 3.0, 3)], "k string, start bigint, end bigint, cn double, seg_id bigint")
    pts = [(1, "a", 7), (2, "a", 7), (3, "a", None), (4, None, 7), (5, "b", 7)]
    df = intervals.segment_at(spark.createDataFrame(pts, "id int, k string, pos bigint"), seg, ["k"], "pos", "cn", block=64)
    assert df.columns == ["k", "pos", "id", "cn"]
    assert {(r.id, r.k, r.pos, r.cn) for r in df.collect()} == {(i, k, p, 1.0 if i < 3 else None) for i, k, p in pts}
    assert "Join" not in df._jdf.queryExecution().toString()


def test_positions_outside(spark):
    iv = make(20, 8, longest=40)
    pos = [("a", p) for p in range(0, 2300, 7)] * 2
    got = intervals.positions_outside(spark.createDataFrame(pos, "k string, pos bigint"), spark.createDataFrame(iv, SCHEMA), ["k"])
    want = sorted(p for k, p in pos if not any(i[0] == k and i[2] <= p <= i[3] for i in iv))
    assert sorted(r.pos for r in got.collect()) == want


def test_bins_of_intervals_stop_at_the_end(spark):
    iv = spark.createDataFrame([("1", 5, 25), ("1", 30, 30), ("1", 95, 400)], "chrom string, start bigint, end bigint")
    got = intervals.bins_of_intervals(iv, 10, F.lit(10).cast("bigint"))
    assert sorted(r.bin for r in got.collect()) == [0, 1, 2, 9]


def test_pieces_ranks_and_equal_bins(spark):
    iv = [(k, s, e) for k, _, s, e, _ in make(25, 9, longest=60)]
    covered = {k: sorted({p for kk, s, e in iv if kk == k for p in range(s, e)}) for k in "abc"}
    df = spark.createDataFrame(iv, "k string, start bigint, end bigint")
    pieces = disjoint_pieces(df, ["k"], 64).collect()
    assert {k: sorted(p for r in pieces if r.k == k for p in range(r.start, r.end)) for k in "abc"} == covered
    ranked = ranked_pieces(df, ["k"], 64)
    pos = spark.createDataFrame([("a", p, 1) for p in range(0, 2000, 3)], "k string, pos bigint, n int")
    got = {r.pos: r.rank for r in position_rank(pos, ranked, ["k"], 64).collect()}
    assert got == {p: covered["a"].index(p) for p in range(0, 2000, 3) if p in set(covered["a"])}
    bins = {(r.k, r.bin): (r.start, r.end, r.positions) for r in equal_mappability_bins(ranked, ["k"], 50).collect()}
    want = {}
    for k, ps in covered.items():
        last = max(len(ps) // 50 - 1, 0)
        for b in range(last + 1):
            part = ps[b * 50:] if b == last else ps[b * 50:(b + 1) * 50]
            want[k, b] = (part[0], part[-1], len(part))
    assert bins == want


def test_gap_distance(spark):
    gaps = [("1", 100, 120), ("1", 110, 150), ("1", 900, 901)]
    pts = [("1", p) for p in (0, 99, 100, 130, 149, 151, 500, 900, 2000)] + [("2", 5)]
    got = {(r.chrom, r.pos): r.distance_kb for r in gap_distance(
        spark.createDataFrame(pts, "chrom string, pos bigint"), spark.createDataFrame(gaps, "chrom string, start bigint, end bigint"), 64).collect()}

    def near(p):
        return min(0 if s <= p <= e else s - p if p < s else p - e for _, s, e in gaps) / 1000
    assert got == {(c, p): (near(p) if c == "1" else None) for c, p in pts}


def test_gap_distance_has_no_frame_that_shrinks_row_by_row(spark):
    """Such a frame is summed anew for each row, so the gaps of a block cost the square of their number."""
    gaps = spark.createDataFrame([("1", 100, 120)], "chrom string, start bigint, end bigint")
    plan = gap_distance(spark.createDataFrame([("1", 5)], "chrom string, pos bigint"), gaps)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in plan
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in plan


def test_first_overlaps_finds_what_pairs_find(spark):
    """Counts and first ids without pairs: long, short, empty, reversed and missing intervals, hot places, many copies."""
    rng = random.Random(5)
    def spans(n, widest):
        at = [rng.choice([rng.randrange(-50_000, 200_000_000), 7_000_000]) for _ in range(n)]
        return [(i, rng.choice("12"), x, x + rng.choice([0, 1, -5, rng.randrange(1, 1_000), rng.randrange(1, widest)])) for i, x in enumerate(at)]
    left = [*spans(200, 150_000_000), (900, "1", None, 5), (901, "1", 5, None), (902, None, 5, 9), (903, "3", 5, 9), (904, "1", 1, 1 << 30)]
    right = [*spans(400, 60_000), (1000, "1", None, 5), (1001, None, 5, 9)]
    a = spark.createDataFrame(left, "id int, chrom string, start bigint, end bigint")
    b = spark.createDataFrame(right, "rid int, chrom string, start bigint, end bigint")
    want = {i: sorted(r for r, d, x, y in right if None not in (c, s, e, d, x, y) and c == d and s < y and x < e) for i, c, s, e in left}
    for salt in (1, 3):
        df = intervals.first_overlaps(a, b, "chrom", ["rid"], 10, salt=salt)
        got = {r.id: (r.n, [h.rid for h in r.hits]) for r in df.collect()}
        assert got == {i: (len(w), w[:10]) for i, w in want.items()}
    assert "Join" not in df._jdf.queryExecution().toString()

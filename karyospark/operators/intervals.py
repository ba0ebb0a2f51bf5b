"""Interval operators: overlap joins that return pairs, and overlap sums that never build pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from karyospark.operators.running import running_totals
from karyospark.session import spread

BUCKET = 1 << 22
#: Tracks are ordered in the memory of a task, however few partitions the session has.
TRACK_TASKS_PER_CORE = 16


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET, closed: bool = False,
                  salt: int = 1) -> DataFrame:
    """Inner join of overlapping intervals.

    Both sides carry `keys`, `start`, `end`; the right side's other columns come through, its
    interval as `r_start`, `r_end`. Intervals are copied to each bucket they touch and joined by
    (keys, bucket). A pair is kept only in the first bucket both share, so no second shuffle is
    needed to drop repeats. `salt` copies the right side that many times and splits a hot bucket
    of the left side over as many tasks; without it the adaptive skew join does the splitting.
    """
    top = F.col("end") if closed else F.col("end") - 1
    renamed = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    r_top = F.col("r_end") if closed else F.col("r_end") - 1
    first, last = F.floor(F.col("start") / bucket), F.floor(F.greatest(top, F.col("start")) / bucket)
    r_first, r_last = F.floor(F.col("r_start") / bucket), F.floor(F.greatest(r_top, F.col("r_start")) / bucket)
    a = left.withColumn("_b", F.explode(F.sequence(first, last)))
    b = renamed.withColumn("_b", F.explode(F.sequence(r_first, r_last)))
    on = [*keys, "_b"]
    if salt > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salt)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("_salt")
    if closed:
        touch = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end"))
    else:
        touch = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    return (a.join(b, on)
            .filter(touch & (F.col("_b") == F.floor(F.greatest("start", "r_start") / bucket)))
            .drop("_b", "_salt"))


def overlap_length() -> Column:
    """Shared length of a pair made by `overlap_pairs`."""
    return F.greatest(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(0))


def best_overlap(regions: DataFrame, segments: DataFrame, keys: list[str], region_id: list[str], value: str,
                 tie: str, **join) -> DataFrame:
    """Value of the segment that overlaps each region most; first by `tie` on equal overlap, NULL if none."""
    pairs = overlap_pairs(regions.select(*keys, *region_id, "start", "end"), segments, keys, **join)
    rank = F.struct(overlap_length(), -F.col(tie))
    by = list(dict.fromkeys([*keys, *region_id]))
    best = pairs.groupBy(*by).agg(F.max_by(value, rank).alias(value))
    return regions.join(best, by, "left")


def first_hit(points: DataFrame, regions: DataFrame, keys: list[str], point_id: list[str], value: str, order: str,
              inside: bool = False, closed: bool = False, **join) -> DataFrame:
    """Value of the first interval, by `order`, that touches (or fully holds) each left interval."""
    pairs = overlap_pairs(points.select(*keys, *point_id, "start", "end"), regions, keys, closed=closed, **join)
    if inside:
        pairs = pairs.filter((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")))
    by = list(dict.fromkeys([*keys, *point_id]))
    hit = pairs.groupBy(*by).agg(F.min_by(value, order).alias(value))
    return points.join(hit, by, "left")


def _counted(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """How many intervals [a, b) overlap each [s, e); reversed and empty ones are compared one by one."""
    plain, odd = a <= b, np.flatnonzero(s >= e)
    n = np.searchsorted(np.sort(a[plain]), e, "left") - np.searchsorted(np.sort(b[plain]), s, "right")
    n[odd] = 0
    for who, x, y in ((odd, a[plain], b[plain]), (np.arange(len(s)), a[~plain], b[~plain])):
        step = max(1, cells // max(len(x), 1))
        for i in range(0, len(who) if len(x) else 0, step):
            w = who[i:i + step]
            n[w] += ((x < e[w, None]) & (s[w, None] < y)).sum(axis=1)
    return n


def _first_hits(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, top: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and the first `top` overlapping intervals of each row in the order of a and b (-1: no more).

    Rows are compared with ever more of the intervals, and leave as soon as they have what the counts say they must find.
    """
    n = _counted(s, e, a, b, cells)
    want, found, at, step = np.minimum(n, top), np.zeros(len(s), np.int64), 0, 64
    hits, todo = np.full((len(s), top), -1, np.int32), np.flatnonzero(n > 0)
    while len(todo):
        x, y = a[at:at + step], b[at:at + step]
        for part in np.array_split(todo, len(todo) * len(x) // cells + 1):
            m = (x < e[part, None]) & (s[part, None] < y)
            rank = np.cumsum(m, axis=1) + found[part, None]
            i, j = np.nonzero(m & (rank <= want[part, None]))
            hits[part[i], rank[i, j] - 1] = at + j
            found[part] = np.minimum(rank[:, -1], want[part])
        todo = todo[found[todo] < want[todo]]
        at, step = at + step, min(2 * step, 4096)
    return n, hits


def first_overlaps(left: DataFrame, right: DataFrame, key: str, columns: list[str], top: int, out: str = "hits",
                   bucket: int = BUCKET, salt: int = 1) -> DataFrame:
    """Every left row with the number `n` of right intervals that overlap it and the first `top` of them by `columns`.

    No pairs are shuffled. A left interval lies in one bucket, by its start, of the smallest bucket size that its length fits;
    right ones are copied to the one or two buckets of each size from which a left one can reach them.
    """
    sizes = [bucket, bucket << 3, bucket << 6]
    length = F.col("end") - F.col("start")
    size = F.when(length <= sizes[0], 0).when(length <= sizes[1], 1).when(length <= sizes[2], 2).when(length.isNotNull(), 3).otherwise(-1)
    block = F.when(size.between(0, 2), F.floor(F.col("start") / F.element_at(F.array(*[F.lit(z) for z in sizes]), F.least(size, F.lit(2)) + 1)))
    lot = F.pmod(F.xxhash64(*left.columns), F.lit(salt)).cast("int")
    a = left.withColumns({"_size": size, "_block": F.coalesce(F.when(size >= 0, block), F.lit(0).cast("bigint")), "_lot": lot})
    last = F.greatest(F.col("end") - 1, F.col("start"))
    places = F.array(*[F.struct(F.lit(i).alias("s"), F.sequence(F.floor(F.col("start") / z) - 1, F.floor(last / z)).alias("b"))
                       for i, z in enumerate(sizes)], F.struct(F.lit(3).alias("s"), F.array(F.lit(0).cast("bigint")).alias("b")))
    b = right.na.drop(subset=[key, "start", "end"]).select(key, "start", "end", *columns, F.explode(places).alias("_p"))
    b = b.select(key, "start", "end", *columns, F.col("_p.s").alias("_size"), F.explode("_p.b").alias("_block"))
    b = b.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    entry = T.StructType([right.schema[c] for c in columns])
    schema = T.StructType([*left.schema.fields, T.StructField("n", T.LongType()), T.StructField(out, T.ArrayType(entry))])
    names, fields = left.columns, to_arrow_schema(schema)

    def on_tables(rows: pa.Table, near: pa.Table) -> pa.Table:
        found = fields.field(out).type
        if not rows.num_rows or not near.num_rows:
            empty = pa.ListArray.from_arrays(pa.array([0] * (rows.num_rows + 1), pa.int32()), pa.array([], found.value_type), type=found)
            return pa.Table.from_arrays([*[rows.column(c) for c in names], pa.array(np.zeros(rows.num_rows, np.int64)), empty], schema=fields)
        near = near.sort_by([(c, "ascending") for c in columns])
        s, e, x, y = (t.column(c).to_numpy() for t in (rows, near) for c in ("start", "end"))
        n, hits = _first_hits(s, e, x, y, top)
        taken = near.select(columns).take(pa.array(hits[hits >= 0])).combine_chunks()
        parts = [taken.column(c).combine_chunks() if taken.num_rows else pa.array([], near.schema.field(c).type) for c in columns]
        at = np.concatenate([[0], np.cumsum((hits >= 0).sum(axis=1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(parts, fields=list(found.value_type)), type=found)
        return pa.Table.from_arrays([*[rows.column(c) for c in names], pa.array(n.astype(np.int64)), lists], schema=fields)

    on = [key, "_size", "_block", "_lot"]
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(on_tables, schema)


def _edges(intervals: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    """Start and end events with the sums that coverage at any position needs."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    at = F.explode(F.array(
        F.struct(F.col("start").alias("x"), w.alias("opened"), F.lit(0).cast(_kind(weight)).alias("closed"),
                 (w * F.col("start")).alias("opened_x"), F.lit(0).cast(_kind(weight)).alias("closed_x")),
        F.struct(F.col("end").alias("x"), F.lit(0).cast(_kind(weight)).alias("opened"), w.alias("closed"),
                 F.lit(0).cast(_kind(weight)).alias("opened_x"), (w * F.col("end")).alias("closed_x"))))
    return intervals.select(*keys, at.alias("e")).select(*keys, "e.*")


def _kind(weight: str | None) -> str:
    return "double" if weight else "bigint"


_SUMS = ["opened", "closed", "opened_x", "closed_x"]


def _lookup(queries: DataFrame, intervals: DataFrame, keys: list[str], query_id: list[str],
            weight: str | None) -> DataFrame:
    """Running sums of the interval edges at both ends of each query."""
    ends = queries.select(*keys, *query_id, F.explode(F.array(
        F.struct(F.col("start").alias("x"), F.lit(-1).alias("side")),
        F.struct(F.col("end").alias("x"), F.lit(1).alias("side")))).alias("p")).select(*keys, *query_id, "p.*")
    zero = [F.lit(0).cast(_kind(weight)).alias(m) for m in _SUMS]
    events = _edges(intervals, keys, weight).unionByName(ends.select(*keys, "x", *zero))
    return ends.join(running_totals(events, keys, "x", _SUMS), [*keys, "x"])


def covered_length(queries: DataFrame, intervals: DataFrame, keys: list[str], query_id: list[str],
                   out: str = "covered", weight: str | None = None) -> DataFrame:
    """Per query the (weighted) sum of its overlap with all intervals of the same keys.

    Coverage up to x is x*(opened-closed)-(sum of starts-sum of ends), so two lookups per query
    replace the pairs and a group of any size stays linear.
    """
    c = F.col("side") * (F.col("x") * (F.col("run_opened") - F.col("run_closed"))
                         - (F.col("run_opened_x") - F.col("run_closed_x")))
    q = list(dict.fromkeys([*keys, *query_id]))
    return _lookup(queries, intervals, keys, query_id, weight).groupBy(*q).agg(F.sum(c).alias(out))


def overlap_sum(queries: DataFrame, intervals: DataFrame, keys: list[str], query_id: list[str],
                measures: dict[str, str], closed: bool = False) -> DataFrame:
    """Per query the number of overlapping intervals (`n`) and the sums of their measures.

    An interval overlaps unless it starts after the query or ends before it, so every sum is
    (all that start in time) minus (all that end too early). `measures` maps output to column.
    """
    cols = {"n": F.lit(1).cast("bigint"), **{o: F.col(c) for o, c in measures.items()}}
    gap = 0 if closed else 1
    # An end event sits where queries starting there no longer see the interval.
    ev = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("x"), F.lit(1).alias("kind")),
        F.struct((F.col("end") + (1 - gap)).alias("x"), F.lit(-1).alias("kind")))).alias("p"),
        *[e.alias(o) for o, e in cols.items()]).select(*keys, "p.*", *cols)
    split = ev.select(*keys, "x", *[
        F.when(F.col("kind") == k, F.col(o)).otherwise(F.lit(0)).alias(f"{o}_{s}")
        for o in cols for k, s in ((1, "in"), (-1, "out"))])
    sums = [c for c in split.columns if c not in [*keys, "x"]]
    ends = queries.select(*keys, *query_id, F.explode(F.array(
        F.struct((F.col("end") - gap).alias("x"), F.lit(True).alias("top")),
        F.struct(F.col("start").alias("x"), F.lit(False).alias("top")))).alias("p")).select(*keys, *query_id, "p.*")
    events = split.unionByName(ends.select(*keys, "x", *[F.lit(0).alias(s) for s in sums]))
    run = running_totals(events, keys, "x", sums)
    q = list(dict.fromkeys([*keys, *query_id]))
    return ends.join(run, [*keys, "x"]).groupBy(*q).agg(*[
        F.sum(F.when(F.col("top"), F.col(f"run_{o}_in")).otherwise(-F.col(f"run_{o}_out"))).alias(o) for o in cols])


def track_overlap_sum(queries: DataFrame, intervals: DataFrame, keys: list[str], measures: dict[str, str], closed: bool = False) -> DataFrame:
    """Every query row, each given once, with what `overlap_sum` finds for it, for keys that hold a bounded number of intervals.

    A track of a sample is such a group: it may be one task's, so edges and query ends are put in one ordered stream by the first
    key. One exchange and one sort, without running totals of blocks and joins; queries and intervals without a place match nothing.
    """
    gap, whole = 0 if closed else 1, F.col("start").isNotNull() & F.col("end").isNotNull()
    edges = F.array(F.struct(F.col("start").alias("_x"), F.lit(0).alias("_k")), F.struct((F.col("end") + (1 - gap)).alias("_x"), F.lit(1).alias("_k")))
    ends = F.array(F.struct((F.col("end") - gap).alias("_x"), F.lit(2).alias("_k")), F.struct(F.col("start").alias("_x"), F.lit(3).alias("_k")))
    cols = {"n": F.lit(1).cast("bigint"), **{o: F.col(c) for o, c in measures.items()}}
    s = intervals.na.drop(subset=[*keys, "start", "end"]).select(*keys, *[c.alias(f"_v_{o}") for o, c in cols.items()], F.explode(edges).alias("_p"))
    rest = [c for c in queries.columns if c not in keys]
    q = queries.select(*keys, F.struct(*rest).alias("_q"), F.explode(ends).alias("_p"), whole.alias("_w"))
    x = F.when(F.coalesce("_w", F.lit(True)), F.col("_p._x"))
    stream = s.unionByName(q, allowMissingColumns=True).select(*keys, x.alias("_x"), F.col("_p._k").alias("_k"), "_q", *[f"_v_{o}" for o in cols])
    # Of equal places the edges come first; a query's last place sums what starts in time, its first what ends too early.
    w = Window.partitionBy(*keys).orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    run = spread(stream, keys[0], per_core=TRACK_TASKS_PER_CORE).select("*", *[
        F.coalesce(F.sum(F.when(F.col("_k") == k, F.col(f"_v_{o}"))).over(w), F.lit(0)).alias(f"_{side}_{o}")
        for o in cols for side, k in (("in", 0), ("out", 1))]).filter("_k > 1")
    found = run.groupBy(*keys, "_q").agg(*[
        F.sum(F.when(F.col("_k") == 2, F.col(f"_in_{o}")).otherwise(-F.col(f"_out_{o}"))).alias(f"_r_{o}") for o in cols])
    return found.select(*[F.col(c if c in keys else f"_q.{c}").alias(c) for c in queries.columns],
                        *[F.col(f"_r_{o}").alias(o) for o in cols])


def touched(queries: DataFrame, intervals: DataFrame, keys: list[str], query_id: list[str],
            closed: bool = False, out: str = "touched") -> DataFrame:
    """Flag per query: does any interval overlap it? Linear, without pairs."""
    q = list(dict.fromkeys([*keys, *query_id]))
    return overlap_sum(queries, intervals, keys, query_id, {}, closed).select(
        *q, (F.col("n") > 0).alias(out))


def positions_outside(positions: DataFrame, intervals: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Rows whose position lies in no interval (ends included)."""
    distinct = positions.select(*keys, F.col(pos).alias("start"), F.col(pos).alias("end")).distinct()
    inside = touched(distinct, intervals, keys, ["start"], closed=True).filter("touched")
    return positions.join(inside.select(*keys, F.col("start").alias(pos)), [*keys, pos], "left_anti")


def bins_of_intervals(intervals: DataFrame, bin_size: int, n_bins: Column) -> DataFrame:
    """chrom, bin of every bin that a half-open interval reaches; bins past the end are left out."""
    last = F.least(F.floor((F.col("end") - 1) / bin_size), n_bins - 1)
    first = F.greatest(F.floor(F.col("start") / bin_size), F.lit(0).cast("bigint"))
    ok = (F.col("end") > F.col("start")) & (first <= last)
    return (intervals.filter(ok).select("chrom", F.explode(F.sequence(first, last)).alias("bin")).distinct())


def segment_at(points: DataFrame, segments: DataFrame, keys: list[str], pos: str, value: str,
               order: str = "seg_id", block: int = BUCKET) -> DataFrame:
    """As-of lookup: value of the latest segment that starts at or before a position and still holds it.

    Segments of one key do not overlap. Points and segment starts are put in one ordered stream
    per (keys, block); a segment reaching into later blocks is listed in each of them, so a block
    is complete on its own and a chromosome never has to be one task. The points themselves are in
    the stream, with all their columns: one exchange and one sort, nothing is joined back.
    """
    rest = [c for c in points.columns if c not in [*keys, pos]]
    seg = segments.na.drop(subset=keys).select(*keys, "start", "end", F.col(value).alias("_v"), F.col(order).alias("_o"))
    seg = seg.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    s = seg.select(*keys, "_b", F.col("start").alias("_x"), F.lit(0).alias("_k"), "_o", F.struct("_v", "end").alias("_s"))
    p = points.select(*keys, F.floor(F.col(pos) / block).alias("_b"), F.col(pos).alias("_x"), F.lit(1).alias("_k"),
                      F.struct(*(rest or [F.lit(True)])).alias("_p"))
    w = Window.partitionBy(*keys, "_b").orderBy("_x", "_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = (s.unionByName(p, allowMissingColumns=True)
             .withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_k = 1"))
    back = {pos: F.col("_x"), **{c: F.col(f"_p.{c}") for c in rest}}
    return found.select(*[back.get(c, F.col(c)).alias(c) for c in [*keys, pos, *rest]],
                        F.when(F.col("_s.end") >= F.col("_x"), F.col("_s._v")).alias(value))

"""Planted gain, from reads to segments."""

from pyspark.sql import functions as F

from karyospark.operators import evaluate, segmentation
from karyospark.plans import ratio_chain
from karyospark.plans.projections import located
from karyospark.schema import CHROMOSOMES

B = 10_000_000
GAIN = ("3", 50_000_000, 130_000_000)


def planted_reads(spark):
    """Eight samples, even ones female; sample 1 carries one more copy of a stretch, by thinning all the rest."""
    ids = spark.range(8 * 24 * 3000).withColumn("k", F.col("id") % 8)
    n = F.expr("id div 8") % 24 + 1
    df = located(ids, F.when((F.col("k") % 2 == 0) & (n == 24), 23).otherwise(n))
    df = df.withColumn("pos", F.pmod(F.xxhash64("id"), F.col("length") - 100))
    inside = (F.col("chrom") == GAIN[0]) & (F.col("pos") >= GAIN[1]) & (F.col("pos") < GAIN[2])
    cn = F.when(inside & (F.col("k") == 1), 3.0).otherwise(2.0)
    kept = evaluate.thinning_keep(df, cn / 3.0, F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)))
    return kept.filter("kept").select(F.concat(F.lit("S"), "k").alias("sample"), "chrom", "pos", (F.col("pos") + 50).alias("end"))


def test_planted_gain_is_found(spark):
    first = ratio_chain.first_pass(planted_reads(spark), B)
    sex = {r["sample"]: r.sex for r in first.select("sample", "sex").distinct().collect()}
    assert sex == {f"S{k}": "male" if k % 2 else "female" for k in range(8)}
    log2 = ratio_chain.second_pass(ratio_chain.ratios(first, B), B)
    rows = log2.filter("sample = 'S1' AND chrom = '3'").orderBy("bin").collect()
    inside = [r.log2_ratio for r in rows if 5 <= r.bin < 13]
    outside = [r.log2_ratio for r in rows if not 5 <= r.bin < 13]
    assert abs(sum(inside) / len(inside) - 0.53) < 0.12 and abs(sum(outside) / len(outside)) < 0.15
    seg = segmentation.cbs_segments(log2, alpha=1e-3, permutations=2000).toPandas()
    found = seg[(seg["sample"] == "S1") & (seg.chrom == "3") & (seg["mean"] > 0.35)]
    assert len(found) == 1 and abs(found.iloc[0].start_bin - 5) <= 1 and abs(found.iloc[0].end_bin - 12) <= 1
    quiet = seg[(seg["sample"] != "S1") & seg.chrom.isin(CHROMOSOMES[:22])]
    assert len(quiet) <= 7 * 22 + 2

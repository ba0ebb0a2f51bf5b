"""Given tables seen as genomic tables.

Each projection exists twice, as a DataFrame and as a SQL common table expression of the same
name, so a query and its checking SQL start from the same rows. Every projection keeps all rows
of its table. Samples, experiments and results grow with the tables; the genome does not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.schema import CHROM_NUM, CHROMOSOME_LENGTHS, DEFAULT_BIN_SIZE, chromosome_dim

READ_BIN = DEFAULT_BIN_SIZE
BIC_BIN = DEFAULT_BIN_SIZE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample(idx) -> F.col:
    return F.concat(F.lit("S"), F.lpad(idx.cast("string"), 6, "0"))


def located(df: DataFrame, chrom_num) -> DataFrame:
    """Attach chrom and length of a chromosome number."""
    dim = F.broadcast(chromosome_dim(df.sparkSession))
    return df.withColumn("chrom_num", chrom_num.cast("int")).join(dim, "chrom_num")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as aligned reads; odd samples are male, even ones female (no Y)."""
    return reads_of(table(spark, sf_dir, "lineitem"))


def reads_of(li: DataFrame) -> DataFrame:
    """The projection itself, for a table or a stream of line items."""
    idx = F.expr("l_suppkey div 5")
    raw = F.col("l_partkey") % 24 + 1
    df = located(li.withColumn("sample_idx", idx),
                 F.when((F.col("sample_idx") % 2 == 0) & (raw == 24), 23).otherwise(raw))
    pos = (F.col("l_orderkey") * 2654435 + F.col("l_linenumber") * 40503) % (F.col("length") - 200_000)
    return df.select(
        _sample(F.col("sample_idx")).alias("sample"), "sample_idx", "chrom", "chrom_num",
        pos.alias("pos"), (pos + 36 + 2000 * F.col("l_quantity").cast("bigint")).alias("end"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"),
        (F.when(F.col("l_returnflag") == "R", 4).otherwise(0)
         + F.when(F.col("l_linestatus") == "F", 16).otherwise(0)).alias("flag"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("weight"),
    )


def gc_of_bin():
    return F.lit(0.2) + ((F.col("bin") * 37 + F.col("chrom_num") * 11) % 61) / F.lit(100.0)


def n_of_bin():
    return ((F.col("bin") * 13 + F.col("chrom_num") * 7) % 12) / F.lit(100.0)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as caller segments which tile the covered part of each chromosome."""
    o = table(spark, sf_dir, "orders")
    df = located(o.withColumn("sample_idx", F.expr("o_custkey div 50")), F.col("o_orderkey") % 24 + 1)
    k = F.floor("o_totalprice") % 100
    base = (F.when(k < 60, 200 + (k % 5 - 2) * 5).when(k < 80, 100 + (k % 10) * 5).otherwise(250 + (k % 10) * 7))
    female = F.col("sample_idx") % 2 == 0
    df = df.select(
        F.expr("sample_idx * 2 div 3").alias("experiment_idx"), "sample_idx",
        _sample(F.col("sample_idx")).alias("sample"),
        F.when(F.col("o_orderstatus") == "F", "clinical").when(F.col("o_orderstatus") == "O", "cbs")
        .otherwise("bic").alias("algorithm"),
        "chrom_num", F.col("o_orderkey").alias("seg_id"), "length",
        ((F.col("o_orderkey") * 48271 * 7919) % (F.col("length") - 1_000_000)).alias("start"),
        base.cast("bigint").alias("base"), female.alias("female"))
    hundredths = (F.when((F.col("chrom_num") == 24) & F.col("female"), F.expr("base div 10"))
                  .when((F.col("chrom_num") >= 23) & ~F.col("female"), F.expr("base div 2"))
                  .otherwise(F.col("base")))
    order = Window.partitionBy("sample", "algorithm", "chrom_num").orderBy("start", "seg_id")
    return df.select(
        F.concat(F.lit("E"), F.lpad(F.col("experiment_idx").cast("string"), 5, "0")).alias("experiment"),
        "sample", "algorithm", "chrom_num", "seg_id", "start",
        F.coalesce(F.lead("start").over(order), F.col("length")).alias("end"),
        (hundredths / F.lit(100.0)).alias("copy_number"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as experiment regions with type and mosaic fraction; regions may overlap."""
    df = located(table(spark, sf_dir, "part"), (F.col("p_partkey") * 7) % 24 + 1)
    start = (F.col("p_partkey") * 7919 * 131071) % (F.col("length") - 10_000_000)
    return df.select(
        F.concat(F.lit("E"), F.lpad(F.expr("p_partkey div 100").cast("string"), 5, "0")).alias("experiment"),
        (F.col("p_partkey") % 100 + 1).cast("int").alias("region"), "chrom_num", "chrom",
        start.alias("start"), (start + F.col("p_size").cast("bigint") * 150_000).alias("end"),
        F.when(F.col("p_size") % 2 == 0, "G").otherwise("L").alias("type"),
        ((F.lit(3) + F.col("p_partkey") % 5) / F.lit(10.0)).alias("mosaic"),
        F.col("p_partkey").alias("region_key"))


def scale_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ratio per sample and region of its experiment."""
    members = table(spark, sf_dir, "customer").select(
        F.expr("c_custkey div 50").alias("sample_idx")).distinct().select(
        _sample(F.col("sample_idx")).alias("sample"), "sample_idx",
        F.concat(F.lit("E"), F.lpad(F.expr("sample_idx * 2 div 3").cast("string"), 5, "0")).alias("experiment"))
    tilt = F.lit(1.0) + (F.col("sample_idx") % 5) / F.lit(100.0)
    ratio = F.when(F.col("type") == "G", (F.lit(2.0) + F.col("mosaic")) / 2).otherwise(
        (F.lit(2.0) - F.col("mosaic")) / 2)
    return regions(spark, sf_dir).join(members, "experiment").select(
        "experiment", "sample", "region", F.round(ratio * tilt, 4).alias("ratio"))


def bic_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected counts per bin, 1-based inclusive coordinates."""
    b = F.expr(f"pos div {BIC_BIN}")
    return (reads(spark, sf_dir).groupBy("sample", "chrom", "chrom_num", b.alias("bin"))
            .agg(F.count("*").alias("obs"), F.sum("weight").alias("weight"))
            .select("sample", "chrom", "chrom_num", "bin", (F.col("bin") * BIC_BIN + 1).alias("start"),
                    ((F.col("bin") + 1) * BIC_BIN).alias("end"), "obs",
                    (F.col("weight") * F.lit(0.25) + F.lit(0.5)).alias("expected"),
                    (F.col("weight") * F.lit(0.3) + F.lit(0.6)).alias("var"),
                    gc_of_bin().alias("gc")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as embryos: ten per cycle, a hundred per flow cell."""
    c = table(spark, sf_dir, "customer")
    flowcell = F.concat(F.lit("FC"), F.expr("c_custkey div 100").cast("string"))
    cycle = F.concat(F.lit("CY-"), F.expr("c_custkey div 10").cast("string"))
    embryo = F.concat(F.lit("E"), F.col("c_custkey").cast("string"))
    return c.select(
        F.col("c_custkey").alias("id"), F.concat_ws("-", flowcell, cycle, embryo).alias("name"),
        flowcell.alias("flowcell_id"), cycle.alias("cycle_id"), embryo.alias("embryo_id"),
        F.concat(F.concat_ws("-", flowcell, cycle, embryo), F.lit("_S"),
                 (F.col("c_custkey") % 96 + 1).cast("string"), F.lit(".bam")).alias("file_name"),
        F.col("c_mktsegment").alias("cell_type"),
        F.when(F.col("c_nationkey") % 2 == 0, "hg19").otherwise("hg38").alias("reference_genome"))


def algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as algorithms."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("algorithm_id"), F.col("n_name").alias("algorithm_name"),
        F.concat(F.lit("v"), F.col("n_regionkey").cast("string")).alias("version"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stored parameter sets in JSON."""
    s = table(spark, sf_dir, "supplier")
    size = ((F.col("s_suppkey") % 4 + 1) * 100_000).cast("string")
    text = F.concat(
        F.lit('{"bin_size":{"type":"int","default":"400000","value":"'), size,
        F.lit('"},"method":{"type":"str","default":"cbs","value":"m'),
        (F.col("s_suppkey") % 3).cast("string"), F.lit('"}}'))
    return s.select(F.col("s_suppkey").alias("parameter_id"), F.col("s_nationkey").alias("algorithm_id"),
                    text.alias("value"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored results of a sample under one parameter set."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("sample_id"),
        (F.col("o_orderkey") % 10).alias("parameter_id"), F.col("o_orderdate").alias("created_at"))


def result_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as segments of results."""
    li = table(spark, sf_dir, "lineitem")
    df = located(li, F.col("l_partkey") % 24 + 1)
    start = (F.col("l_orderkey") * 2654435 + F.col("l_suppkey") * 1299709) % (F.col("length") - 2_000_000)
    q = F.col("l_quantity").cast("bigint")
    return df.select(
        F.col("l_orderkey").alias("result_id"), "chrom", "chrom_num", start.alias("start"),
        (start + q * 20_000).alias("end"), ((q * 8) / F.lit(100.0)).alias("copy_number"),
        F.col("l_discount").alias("confidence"), F.col("l_suppkey").alias("tag"),
        F.col("l_partkey").alias("tag2"), F.col("l_linenumber").alias("line"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as annotated intervals of gene size."""
    df = located(table(spark, sf_dir, "part"), F.col("p_partkey") % 24 + 1)
    start = (F.col("p_partkey") * 15485863) % (F.col("length") - 1_000_000)
    return df.select(
        F.col("p_partkey").alias("annotation_id"), "chrom", start.alias("start"),
        (start + F.col("p_size").cast("bigint") * 1000).alias("end"), F.col("p_name").alias("name"),
        F.col("p_type").alias("phenotype"), (F.col("p_partkey") + 100_000).cast("string").alias("omim_id"),
        (F.col("p_partkey") % 6).cast("string").alias("acmg"))


def ref_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as contigs; the lines of a text are its sequence chunks, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "acgtn", "ACGTN").alias("text"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "seq"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("chrom"),
        F.coalesce(F.sum(F.length("seq").cast("bigint")).over(w), F.lit(0).cast("bigint")).alias("offset"), "seq")


_DIM = ", ".join(f"('{c}', {CHROM_NUM[c]}, {n})" for c, n in CHROMOSOME_LENGTHS.items())

# SQL twins of the projections above, in dependency order.
CTES: dict[str, str] = {
    "chromosomes": f"SELECT * FROM (VALUES {_DIM}) t(chrom, chrom_num, length)",
    "grid": f"""SELECT chrom, chrom_num, unnest(range(0, length // {READ_BIN})) AS bin FROM chromosomes""",
    "reads": """
        SELECT 'S' || lpad(CAST(sample_idx AS VARCHAR), 6, '0') AS sample, sample_idx, chrom, chrom_num,
               pos, pos + 36 + 2000 * q AS "end", mapq, flag, read_id, weight
        FROM (SELECT *, (l_orderkey * 2654435 + l_linenumber * 40503) % (length - 200000) AS pos,
                     CAST(l_quantity AS BIGINT) AS q,
                     CAST(round(l_discount * 100) AS INTEGER) * 6 AS mapq,
                     (CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END)
                     + (CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END) AS flag,
                     l_orderkey * 8 + l_linenumber AS read_id,
                     CAST(round(l_tax * 100) AS BIGINT) AS weight
              FROM (SELECT *, l_suppkey // 5 AS sample_idx,
                           CASE WHEN (l_suppkey // 5) % 2 = 0 AND l_partkey % 24 = 23 THEN 23
                                ELSE l_partkey % 24 + 1 END AS cn FROM lineitem) l
              JOIN chromosomes ON chrom_num = cn)""",
    "segments": """
        SELECT 'E' || lpad(CAST(sample_idx * 2 // 3 AS VARCHAR), 5, '0') AS experiment,
               'S' || lpad(CAST(sample_idx AS VARCHAR), 6, '0') AS sample, algorithm, chrom_num, seg_id, start,
               coalesce(lead(start) OVER (PARTITION BY sample_idx, algorithm, chrom_num ORDER BY start, seg_id),
                        length) AS "end",
               (CASE WHEN chrom_num = 24 AND sample_idx % 2 = 0 THEN base // 10
                     WHEN chrom_num >= 23 AND sample_idx % 2 = 1 THEN base // 2 ELSE base END)
               / CAST(100.0 AS DOUBLE) AS copy_number
        FROM (SELECT o_custkey // 50 AS sample_idx, o_orderkey AS seg_id, chrom_num, length,
                     CASE o_orderstatus WHEN 'F' THEN 'clinical' WHEN 'O' THEN 'cbs' ELSE 'bic' END AS algorithm,
                     (o_orderkey * 48271 * 7919) % (length - 1000000) AS start,
                     CASE WHEN k < 60 THEN 200 + (k % 5 - 2) * 5 WHEN k < 80 THEN 100 + (k % 10) * 5
                          ELSE 250 + (k % 10) * 7 END AS base
              FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 100 AS k FROM orders) o
              JOIN chromosomes ON chrom_num = o_orderkey % 24 + 1)""",
    "regions": """
        SELECT 'E' || lpad(CAST(p_partkey // 100 AS VARCHAR), 5, '0') AS experiment,
               CAST(p_partkey % 100 + 1 AS INTEGER) AS region, chrom_num, chrom, start,
               start + CAST(p_size AS BIGINT) * 150000 AS "end",
               CASE WHEN p_size % 2 = 0 THEN 'G' ELSE 'L' END AS type,
               (3 + p_partkey % 5) / CAST(10.0 AS DOUBLE) AS mosaic, p_partkey AS region_key
        FROM (SELECT *, (p_partkey * 7919 * 131071) % (length - 10000000) AS start
              FROM part JOIN chromosomes ON chrom_num = (p_partkey * 7) % 24 + 1)""",
    "members": """
        SELECT DISTINCT c_custkey // 50 AS sample_idx,
               'S' || lpad(CAST(c_custkey // 50 AS VARCHAR), 6, '0') AS sample,
               'E' || lpad(CAST((c_custkey // 50) * 2 // 3 AS VARCHAR), 5, '0') AS experiment FROM customer""",
    "scale_ratios": """
        SELECT experiment, sample, region,
               round((CASE WHEN type = 'G' THEN (2.0::DOUBLE + mosaic) / 2 ELSE (2.0::DOUBLE - mosaic) / 2 END)
                     * (1.0::DOUBLE + (sample_idx % 5) / CAST(100.0 AS DOUBLE)), 4) AS ratio
        FROM regions JOIN members USING (experiment)""",
    "bic_bins": f"""
        SELECT sample, chrom, chrom_num, bin, bin * {BIC_BIN} + 1 AS start, (bin + 1) * {BIC_BIN} AS "end", obs,
               w * 0.25::DOUBLE + 0.5::DOUBLE AS expected, w * 0.3::DOUBLE + 0.6::DOUBLE AS var,
               0.2::DOUBLE + ((bin * 37 + chrom_num * 11) % 61) / 100.0::DOUBLE AS gc
        FROM (SELECT sample, chrom, chrom_num, pos // {BIC_BIN} AS bin, count(*) AS obs,
                     CAST(sum(weight) AS BIGINT) AS w FROM reads GROUP BY ALL)""",
    "samples": """
        SELECT c_custkey AS id, 'FC' || (c_custkey // 100) || '-CY-' || (c_custkey // 10) || '-E' || c_custkey AS name,
               'FC' || (c_custkey // 100) AS flowcell_id, 'CY-' || (c_custkey // 10) AS cycle_id,
               'E' || c_custkey AS embryo_id,
               'FC' || (c_custkey // 100) || '-CY-' || (c_custkey // 10) || '-E' || c_custkey
                 || '_S' || (c_custkey % 96 + 1) || '.bam' AS file_name,
               c_mktsegment AS cell_type,
               CASE WHEN c_nationkey % 2 = 0 THEN 'hg19' ELSE 'hg38' END AS reference_genome
        FROM customer""",
    "algorithms": """SELECT n_nationkey AS algorithm_id, n_name AS algorithm_name, 'v' || n_regionkey AS version
        FROM nation""",
    "parameters": """
        SELECT s_suppkey AS parameter_id, s_nationkey AS algorithm_id,
               CAST((s_suppkey % 4 + 1) * 100000 AS VARCHAR) AS bin_size, 'm' || (s_suppkey % 3) AS method,
               '{"bin_size":{"type":"int","default":"400000","value":"' || ((s_suppkey % 4 + 1) * 100000)
               || '"},"method":{"type":"str","default":"cbs","value":"m' || (s_suppkey % 3) || '"}}' AS value
        FROM supplier""",
    "results": """SELECT o_orderkey AS result_id, o_custkey AS sample_id, o_orderkey % 10 AS parameter_id,
        o_orderdate AS created_at FROM orders""",
    "result_segments": """
        SELECT l_orderkey AS result_id, chrom, chrom_num, start, start + q * 20000 AS "end",
               (q * 8) / CAST(100.0 AS DOUBLE) AS copy_number, l_discount AS confidence, l_suppkey AS tag,
               l_partkey AS tag2, l_linenumber AS line
        FROM (SELECT *, (l_orderkey * 2654435 + l_suppkey * 1299709) % (length - 2000000) AS start,
                     CAST(l_quantity AS BIGINT) AS q
              FROM lineitem JOIN chromosomes ON chrom_num = l_partkey % 24 + 1)""",
    "annotations": """
        SELECT p_partkey AS annotation_id, chrom, start, start + CAST(p_size AS BIGINT) * 1000 AS "end",
               p_name AS name, p_type AS phenotype, CAST(p_partkey + 100000 AS VARCHAR) AS omim_id,
               CAST(p_partkey % 6 AS VARCHAR) AS acmg
        FROM (SELECT *, (p_partkey * 15485863) % (length - 1000000) AS start
              FROM part JOIN chromosomes ON chrom_num = p_partkey % 24 + 1)""",
    "ref_chunks": """
        SELECT 'D' || doc_id AS chrom, CAST(coalesce(sum(length(seq)) OVER (PARTITION BY doc_id ORDER BY i
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", seq
        FROM (SELECT doc_id, unnest(l) AS seq, generate_subscripts(l, 1) AS i
              FROM (SELECT doc_id, string_split(translate(text, 'acgtn', 'ACGTN'), chr(10)) AS l FROM documents))""",
}


def add_cte(name: str, sql: str) -> None:
    """Give a longer chain of steps a name that checking SQL can use."""
    if name in CTES:
        raise ValueError(f"projection defined twice: {name}")
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prepend the projections that `sql` uses, directly or through others, each after those it needs."""
    seen: set[str] = set()
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                visit(body)
                ordered.append(name)

    visit(sql)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    own = sql.strip()
    if own[:5].upper() == "WITH ":
        return ("WITH " + ",\n".join(parts) + ",\n" + own[5:]) if parts else own
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + own

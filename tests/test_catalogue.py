"""The driver contract, and a spread of queries beside their SQL on the smallest tables."""

import importlib.util
import os
import re

import pytest
from check_queries import compare, connect
from conftest import SF

import __spark_entry__ as entry
from karyospark.plans.catalogue import CATALOGUE

QUICK = ["a01_read_count_per_bin", "a12_recomputed_log2", "w01_blacklist_dilated", "j05_best_overlap_segment", "j07_a69_region_counts",
         "a25_chromosome_confusion", "a34_region_deviation", "a46_p32_p33_aberrations", "j21_sample_report", "a52_equal_mappability_bins",
         "a70_region_significance", "s14_validated_upload", "t02_incremental_uploads"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample", "chrom", "bin", "sex", "log2_ratio", "copy_number", "call"]
    assert df.count() > 0


def test_names_and_sql():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(s) > 150
    own = set(q) - set(CATALOGUE)
    assert all(re.fullmatch(r"pipeline|op\d+_\w+", n) for n in own)
    assert bool(own) == bool(importlib.util.find_spec("karyospark.llm.catalogue") if importlib.util.find_spec("karyospark.llm") else None)


@pytest.mark.parametrize("name", list(CATALOGUE) if os.environ.get("CHECK_ALL") else QUICK)
def test_query_matches_sql(spark, con, name):
    q = CATALOGUE[name]
    df = q.run(spark, SF)
    if q.sql:
        assert compare(df, con, q.sql) is None
    else:
        assert df.count() > 0

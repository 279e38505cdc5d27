"""Every query is registered well-formed; a spread of them is compared with its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a13_field_profiles", "j01_assign_points", "a23_average_precision", "a41_differential_expression", "a44_score_cell_types", "a30_counting_errors",
          "g14_stitch_slices", "a29_grouped_precision", "k08_capped_sample", "s20_polygon_json", "t05_tumbling", "t01_append_metrics", "a10_haralick"]


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda d: d[cols].astype(object).sort_values(cols, key=lambda s: s.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(norm(got), norm(want), check_dtype=False, atol=1e-6)

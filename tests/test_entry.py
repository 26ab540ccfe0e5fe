import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from benthos.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
CHEAP = ["counting_metrics", "classification_summary", "grounding_metrics", "caption_bleu", "review_summary", "validate_samples", "packing_boundaries", "pope_by_category", "scienceqa_accuracy", "conversation_prompts_two", "box_parse_plain", "worker_sessions"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", CHEAP)
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(repr(norm(tuple(r[c] for c in sorted(names)))) for r in df.collect())
    theirs = sorted(repr(norm(tuple(r[names.index(c)] for c in sorted(names)))) for r in result.fetchall())
    assert mine == theirs


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0

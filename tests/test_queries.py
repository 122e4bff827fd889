"""Some registered queries against their SQL on the smallest data; ``check_queries.py`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog_queries import ORACLES, QUERIES
from check_queries import TABLES, rows

SF = "/root/testdata/sf0.001"
SOME = [
    "f2_front_matter_fields", "f4_fallback_description", "f13_risk_flags", "p8_parse_failures", "s2_file_contents", "s8_export_csv",
    "o2_final_outcomes", "j1_repo_stats", "j3_tree_flags", "a6_directory_counts", "w1_first_seen", "w3_last_wins", "m1_upsert",
    "t6_due_for_check", "c6_record_builder", "c4_effects", "m2_repeated_ids", "j4_change_classes", "j7_with_retries", "f13_extended_rules",
    "c3_submission_job", "r2_first_seen_across_runs",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["risk_level", "n"] and df.count() == 3


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    result = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns)


def test_known_answers(spark):
    """Facts about the derived inputs at the next larger size."""
    from catalog_queries.views import Inputs
    from shelfmark.operators import layout

    i = Inputs(spark, "/root/testdata/sf0.01")
    levels = {r["risk_level"]: r["n"] for r in entry.queries()["f14_risk_distribution"](spark, i.sf_dir).collect()}
    assert levels == {"high": 364, "medium": 419, "low": 217}
    flagged = layout.attach_flags(i.skill_files, layout.flags_from_tree(i.tree_items))
    counts = [flagged.filter(f).count() for f in layout.FLAGS]
    assert counts == [334, 333, 333, 334]

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string, _found string, fp string"


@pytest.fixture
def documents(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang), with columns whose names may clash."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), "a", None, "b", "c") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def given():
    """Rows of a given table: (sf, table, columns)."""
    import duckdb

    def rows(sf, table, columns):
        return duckdb.sql(f"SELECT {columns} FROM '/root/testdata/{sf}/{table}.parquet' ORDER BY ALL").fetchall()

    return rows

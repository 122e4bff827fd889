"""Value coercions and the defaults of an index row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas


def flag01(value: Column) -> Column:
    return F.coalesce(value.cast("smallint"), F.lit(0).cast("smallint"))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp; unreadable text is NULL."""
    return F.try_to_timestamp(text)


_ZERO = [
    "stars", "forks", "watchers", "open_issues", "repo_archived", "repo_disabled", "repo_private",
    "has_scripts", "has_assets", "has_references", "has_tests",
]
_TEXT = {
    "risk_level": "unknown",
    "license_status": "unknown",
    "source_type": "github_search",
    "status": "pending",
}


def to_record(df: DataFrame, as_of: Column, keep: tuple | list = ()) -> DataFrame:
    """Shape any frame into a full record: missing columns and values get their defaults.

    Columns named in ``keep`` stay behind the record as they are.
    """
    have = set(df.columns)

    def value(name: str, kind: T.DataType) -> Column:
        col = F.col(name) if name in have else F.lit(None)
        if name == "allowed_tools" and name in have and isinstance(df.schema[name].dataType, T.ArrayType):
            col = F.array_join(col, ",")
        if name in _ZERO:
            col = F.coalesce(col.cast(kind), F.lit(0))
        elif name in _TEXT:
            col = F.coalesce(col, F.lit(_TEXT[name]))
        elif name == "risk_flags":
            col = F.coalesce(col, F.array().cast("array<string>"))
        elif name == "frontmatter_json":
            col = F.coalesce(col, F.lit("{}"))
        elif name in ("first_found_at", "last_checked_at"):
            col = F.coalesce(col, as_of)
        return col.cast(kind).alias(name)

    return df.select(*[value(n, schemas.INDEX[n].dataType) for n in schemas.RECORD_COLUMNS], *keep)

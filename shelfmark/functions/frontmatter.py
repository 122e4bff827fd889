"""Front matter to typed metadata.

Nearly all blocks are flat: ``key: words`` and lists of words.  Column expressions read
those.  YAML beyond that (typed, quoted or nested values) is what they cannot express, so
such blocks, and never the whole text, go through one Arrow-batched function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx

try:
    import yaml  # noqa: F401
except ImportError:  # the caller gets a clear message from front_matter()
    yaml = None

FRONT_MATTER_TYPE = (
    "name STRING, description STRING, license STRING, compatibility STRING, "
    "allowed_tools ARRAY<STRING>, frontmatter_json STRING, broken BOOLEAN"
)
FRONT_MATTER_STRUCT = f"struct<{FRONT_MATTER_TYPE.replace(' ', ':').replace(',:', ',')}>"


def _reader():
    # Nested on purpose: the function is shipped by value, so executors need
    # pandas and PyYAML but not this package.
    def read_blocks(blocks):
        import json
        import re

        import pandas as pd
        import yaml

        # Both loaders agree on flat "key: words" lines and simple lists; the
        # compiled one is only trusted with those.
        flat = re.compile(r"(?:[A-Za-z][\w-]*:(?: [A-Za-z0-9][A-Za-z0-9 ,./_()-]*)?\n|  - [A-Za-z0-9][A-Za-z0-9 ./_-]*\n)*", re.A)
        quick = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def plain(value):
            if isinstance(value, dict):
                return {k if isinstance(k, str) else json.dumps(k, default=str).strip('"'): plain(v) for k, v in value.items()}
            if isinstance(value, (list, tuple)):
                return [plain(v) for v in value]
            return value

        def text_of(value):
            return str(value).strip() if value else None

        def read(block):
            if block is None:
                return (None, None, None, None, [], "{}", False)
            try:
                meta = yaml.load(block, quick if flat.fullmatch(block + "\n") else yaml.SafeLoader)
            except yaml.YAMLError:
                meta = None
            except Exception:  # e.g. an impossible date: the file counts as failed
                return (None, None, None, None, [], None, True)
            if not isinstance(meta, dict):
                meta = {}
            tools = meta.get("allowed-tools") or meta.get("allowed_tools") or []
            if not isinstance(tools, list):
                tools = [tools]
            try:
                dumped = json.dumps(plain(meta), default=str, ensure_ascii=False)
            except (ValueError, RecursionError):  # self-referencing anchors
                return (None, None, None, None, [], None, True)
            return (
                text_of(meta.get("name")),
                text_of(meta.get("description")),
                text_of(meta.get("license")),
                text_of(meta.get("compatibility")),
                [str(t) for t in tools],
                dumped,
                False,
            )

        names = ["name", "description", "license", "compatibility", "allowed_tools", "frontmatter_json", "broken"]
        return pd.DataFrame([read(b) for b in blocks], columns=names, index=blocks.index)

    # The annotations carry the UDF kind; set here because pandas is imported above.
    import pandas as pd

    read_blocks.__annotations__ = {"blocks": pd.Series, "return": pd.DataFrame}
    return read_blocks


_KEY = r"[A-Za-z][A-Za-z0-9_-]*"
_WORDS = r"[A-Za-z](?:[A-Za-z0-9 ,./_()-]*[A-Za-z0-9,./_()-])?"
# Lines are matched one at a time, and no pattern repeats a group: Java's matcher would recurse
# once for every repeat, and a block of many lines would exhaust the stack of its task.
_LINE = rf"^(?:{_KEY}:(?: {_WORDS})?|  - {_WORDS})$"
# words that YAML reads as something else
_TYPED = "(?:" + "|".join(f"{w}|{w.capitalize()}|{w.upper()}" for w in ("true", "false", "yes", "no", "on", "off", "null")) + ")"
_NOT_FLAT = [
    r"\A  - ",
    rf"(?m)^{_KEY}: [^\n]+\n  - ",
    rf"(?m)^{_TYPED}:",
    rf"(?m)(?:: |^  - ){_TYPED}$",
    r"(?m)^(?:name|description|license|compatibility):\n  - ",
]
_ITEM = "\x01"


def is_flat(block: Column) -> Column:
    """Whether column expressions read the block; false for NULL."""
    lines = F.split(block, "\n", -1)
    flat = F.forall(lines, lambda line: line.rlike(_LINE))
    for pattern in _NOT_FLAT:
        flat = flat & ~block.rlike(pattern)
    keys = F.regexp_extract_all(block, F.lit(rf"(?m)^({_KEY}):"), F.lit(1))
    return F.coalesce(flat & (F.size(F.array_distinct(keys)) == F.size(keys)), F.lit(False))


def read_flat(block: Column) -> Column:
    """What the YAML reader gives for a flat block."""
    # the items of a list follow its key on one line
    listed = F.regexp_replace(block, r"\n  - ([^\n]+)", _ITEM + '"$1"')
    lists = F.regexp_replace(listed, rf'(?m)^({_KEY}):({_ITEM}[^\n]+)$', '"$1": [$2]')
    lists = F.replace(F.replace(lists, F.lit("[" + _ITEM), F.lit("[")), F.lit(_ITEM), F.lit(", "))
    words = F.regexp_replace(lists, rf"(?m)^({_KEY}): ([^\n]+)$", '"$1": "$2"')
    pairs = F.regexp_replace(words, rf"(?m)^({_KEY}):$", '"$1": null')

    def text(key: str) -> Column:
        return F.nullif(F.regexp_extract(block, rf"(?m)^{key}: ([^\n]+)$", 1), F.lit(""))

    def tools(key: str) -> Column:
        items = F.regexp_extract(listed, rf"(?m)^{key}:({_ITEM}[^\n]+)$", 1)
        many = F.split(F.substring(items, F.lit(3), F.length(items) - 3), f'"{_ITEM}"')
        return F.when(items != "", many).when(text(key).isNotNull(), F.array(text(key)))

    return F.struct(
        *[text(key).alias(key) for key in ("name", "description", "license", "compatibility")],
        F.coalesce(tools("allowed-tools"), tools("allowed_tools"), F.array().cast("array<string>")).alias("allowed_tools"),
        F.concat(F.lit("{"), F.replace(pairs, F.lit("\n"), F.lit(", ")), F.lit("}")).alias("frontmatter_json"),
        F.lit(False).alias("broken"),
    ).cast(FRONT_MATTER_STRUCT)


def read_yaml(block: Column) -> Column:
    """The same for any block, by the YAML reader; for NULL the fields of an empty mapping."""
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read front matter; ship it with the job")
    return F.pandas_udf(_reader(), FRONT_MATTER_TYPE)(block)


def front_matter(block: Column) -> Column:
    """Struct of the known fields, the whole mapping as JSON, and whether loading broke.

    Only blocks that are not flat enter Python.
    """
    flat = is_flat(block)
    return F.when(flat, read_flat(block)).otherwise(read_yaml(F.when(~flat, block)))


def parse_metadata(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``meta`` (NULL when the file is unusable) next to the text.

    A file is unusable when it is blank, when loading its front matter breaks, or
    when name or description is missing even after falling back to the body.  The
    fallbacks read the text only for rows whose front matter leaves a gap.
    """
    c = F.col(content)
    # One step per column: each text expression is evaluated once, and only where it is needed.
    steps = df.withColumn("_fm", front_matter(tx.front_matter_block(c)))
    no_name, no_description = F.col("_fm.name").isNull(), F.col("_fm.description").isNull()
    steps = steps.withColumn("_rest", F.when(no_name | no_description, tx.without_front_matter(c)))
    steps = steps.withColumns(
        {
            "_title": F.when(no_name, tx.first_title(F.col("_rest"))),
            "_body": F.when(no_description, tx.body_line(F.col("_rest"))),
        }
    )
    found = steps.withColumns(
        {
            "_name": F.coalesce(F.col("_fm.name"), tx.blank_to_null(F.col("_title"))),
            "_description": F.coalesce(F.col("_fm.description"), tx.blank_to_null(tx.truncate_words(F.col("_body")))),
        }
    )
    usable = (
        ~tx.is_blank(c) & ~F.col("_fm.broken") & F.col("_name").isNotNull() & F.col("_description").isNotNull()
    )
    meta = F.struct(
        F.col("_name").alias("name"),
        tx.strip(F.col("_description")).alias("description"),
        F.coalesce(F.col("_fm.license"), F.lit("")).alias("license"),
        F.coalesce(F.col("_fm.compatibility"), F.lit("")).alias("compatibility"),
        F.col("_fm.allowed_tools").alias("allowed_tools"),
        F.col("_fm.frontmatter_json").alias("frontmatter_json"),
    )
    return found.withColumn("meta", F.when(usable, meta)).drop("_fm", "_rest", "_title", "_body", "_name", "_description")

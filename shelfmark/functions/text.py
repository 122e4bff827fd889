"""Text expressions: front-matter block, heading and body fallbacks, slug, truncation.

The regular expressions are Java ones.  ``(?U)`` widens ``\\s`` to Unicode
white space, ``(?d)`` makes ``\\n`` the only line end, and the four separators
U+001C..U+001F are added by hand because Java does not call them space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.fixed_values import DESCRIPTION_LIMIT, NAME_LIMIT

_S, _BLOCK, _TITLE, _HEADING = fv.SPACE_PATTERN, fv.BLOCK_PATTERN, fv.TITLE_PATTERN, fv.HEADING_PATTERN

# All characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_S}+", " ")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def front_matter_block(content: Column) -> Column:
    """The text between the opening and the closing ``---`` line, NULL without one."""
    return blank_to_null(F.regexp_extract(content, _BLOCK, 1))


def without_front_matter(content: Column) -> Column:
    return F.regexp_replace(content, _BLOCK, "")


def first_title(text: Column) -> Column:
    """First level-one heading, empty when there is none."""
    return strip(F.regexp_extract(text, _TITLE, 1))


def body_line(text: Column) -> Column:
    """The text without its heading lines, on one line."""
    return collapse_whitespace(strip(F.regexp_replace(text, _HEADING, "")))


def fallback_name(content: Column) -> Column:
    """First level-one heading after the block, NULL when there is none."""
    return blank_to_null(first_title(without_front_matter(content)))


def truncate_words(text: Column, limit: int = DESCRIPTION_LIMIT) -> Column:
    """Cut to ``limit`` characters at the last space and mark the cut with dots."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*\z", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)


def fallback_description(content: Column, limit: int = DESCRIPTION_LIMIT) -> Column:
    """Body text without heading lines, on one line, cut to ``limit``; NULL when empty."""
    return blank_to_null(truncate_words(body_line(without_front_matter(content)), limit))


def slug(text: Column) -> Column:
    words = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", "")
    return F.trim(F.regexp_replace(words, r"(?U)[-\s\x1c-\x1f]+", "-"), F.lit("-"))


def is_valid_metadata(name: Column, description: Column) -> Column:
    present = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(description, F.lit("")) != "")
    return present & (F.length(name) <= NAME_LIMIT)

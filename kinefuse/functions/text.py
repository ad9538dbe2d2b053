"""Text clean-up: decoding, null words, names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinefuse.schemas import ASSOCIATION_TYPES

REPLACEMENT = "�"
# A noncharacter that stands in for a genuine U+FFFD while broken bytes are removed.
HOLD = "\U0010ffff"

# Words that mean "no column".
NULL_WORDS = ("NULL", "NONE", "")

# Unicode white space plus the four ASCII separators.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"


def lenient_utf8(content: Column) -> Column:
    """Bytes (or unchecked text) to text; invalid bytes are dropped."""
    raw = content.cast("string")
    held = F.replace(raw, F.lit(REPLACEMENT), F.lit(HOLD))
    dropped = F.replace(F.make_valid_utf8(held), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(dropped, F.lit(HOLD), F.lit(REPLACEMENT))
    )


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, rf"\A{BLANKS}++|{BLANKS}++\z", "")


def null_words_to_null(text: Column) -> Column:
    """Null for NULL, NONE and empty text in any case."""
    return F.when(~F.upper(text).isin(*NULL_WORDS), text)


def stripped_or_null(text: Column) -> Column:
    """Stripped text, null when what is left is a null word."""
    return null_words_to_null(strip(text))


def section_name(source_name: Column) -> Column:
    """Section a source is stored in; null for an empty name."""
    safe = F.lower(F.regexp_replace(source_name, r"[^\p{L}\p{N}]", "_"))
    return F.when(source_name != "", F.concat(F.lit("section_"), safe))


def pair_id(edge_id: Column) -> Column:
    """Identifier of the opposite direction: `-123` for `123` and back."""
    return F.when(edge_id.startswith("-"), F.substr(edge_id, F.lit(2))).otherwise(
        F.concat(F.lit("-"), edge_id)
    )


def known_association(association: Column) -> Column:
    """Association type, UNASSOCIATED when the value is not one of the three."""
    return F.when(association.isin(*ASSOCIATION_TYPES), association).otherwise("UNASSOCIATED")


def base_name(path: Column) -> Column:
    """Last part of a slash-separated path, trailing slashes ignored."""
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_extension(name: Column) -> Column:
    """Lower-case last extension with its dot; empty for none or for a leading-dot name."""
    return F.lower(F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1))

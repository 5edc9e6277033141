"""Text cleaning used before regular-expression classification."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.functions.missing import ColumnLike, as_column

# The dash characters that count as a plain hyphen
# (hyphen, non-breaking hyphen, figure dash, en dash, em dash, minus sign).
DASHES = "‐‑‒–—−"

# A word keeps inner apostrophes, so "patient's" has one capital; a hyphen starts a new word.
_WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.:][\p{L}\p{M}\p{N}_]+)*"
_PIECES = rf"({_WORD}|[^\p{{L}}\p{{M}}\p{{N}}_]+)"


def squish(column: ColumnLike) -> Column:
    """Trim, and collapse every run of Unicode white space to one space."""
    return F.trim(F.regexp_replace(as_column(column), r"(?U)\s+", " "))


def plain_dashes(column: ColumnLike) -> Column:
    return F.translate(as_column(column), DASHES, "-" * len(DASHES))


def normalise_label(column: ColumnLike) -> Column:
    """Squished, upper-case text with one kind of dash."""
    return plain_dashes(F.upper(squish(column)))


def title_case(column: ColumnLike) -> Column:
    """Capital first letter in every word, counting the parts of a hyphenated word."""
    pieces = F.regexp_extract_all(as_column(column), F.lit(_PIECES), F.lit(1))
    capital = F.transform(
        pieces,
        lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.right(p, F.length(p) - 1))),
    )
    return F.array_join(capital, "")


def contains(column: ColumnLike, *patterns: str, ignore_case: bool = False) -> Column:
    """True when any pattern occurs anywhere in the text; NULL text gives NULL."""
    joined = "|".join(patterns)
    return as_column(column).rlike(f"(?i){joined}" if ignore_case else joined)


def snake_name(name: str) -> str:
    """One column name in snake_case ASCII, safe to use without quoting."""
    text = name.replace("'", "").replace('"', "").replace("µ", "u")
    text = text.replace("%", "_percent_").replace("#", "_number_")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower() or "x"
    return f"x{text}" if text[0].isdigit() else text


def clean_names(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename columns to snake_case, but for ``keep``; a repeated name gets _2, _3, and so on."""
    seen: dict[str, int] = {}
    names = []
    for name in (c if c in keep else snake_name(c) for c in df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)

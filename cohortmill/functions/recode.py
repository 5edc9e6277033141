"""Recoding by ordered rules and by lookup tables.

A rule list becomes one chain of ``when`` branches: the first condition that is true
decides, a NULL condition never does, and a branch may yield NULL and still win.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cohortmill.functions.missing import ColumnLike, as_column, is_in


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Column
    value: Column | str | int | float | None


def _value(rule: Rule) -> Column:
    return rule.value if isinstance(rule.value, Column) else F.lit(rule.value)


def first_match(rules: Sequence[Rule], default: Column | str | None = None) -> Column:
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(rule.condition, _value(rule))
    if default is None:
        return chain
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def first_match_name(rules: Sequence[Rule], default: str = "default") -> Column:
    """Name of the rule that decided, for checking a ladder branch by branch."""
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(rule.condition, F.lit(rule.name))
    return chain.otherwise(F.lit(default))


def lookup(column: ColumnLike, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Translate codes through a literal map; unknown and NULL codes take ``default``."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    # A map refuses a NULL key, so NULL input is kept away from it.
    code = as_column(column)
    found = F.when(code.isNotNull(), F.try_element_at(F.create_map(*pairs), code))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def lookup_or_keep(column: ColumnLike, table: Mapping[str, str]) -> Column:
    return lookup(column, table, default=as_column(column))


def invert_groups(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """{label: [codes]} to {code: label}; a code listed twice belongs to the first label."""
    flat: dict[str, str] = {}
    for label, codes in groups.items():
        for code in codes:
            flat.setdefault(code, label)
    return flat


def array_lookup(column: ColumnLike, table: Mapping[str, Sequence[str]]) -> Column:
    """Translate a code to an array of text; unknown codes give an array holding one NULL."""
    code = as_column(column)
    chain = None
    for key, members in table.items():
        value = F.array(*[F.lit(m) for m in members])
        chain = (F if chain is None else chain).when(code == key, value)
    return chain.otherwise(F.array(F.lit(None).cast("string")))


def any_in(array: ColumnLike, values: Sequence[str]) -> Column:
    """Whether any element is in the list; missing elements do not count."""
    return F.coalesce(F.exists(as_column(array), lambda x: is_in(x, values)), F.lit(False))


def all_missing(array: ColumnLike) -> Column:
    return F.forall(as_column(array), lambda x: x.isNull())

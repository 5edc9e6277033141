"""SQL fragments shared by the twins: number parsing, rounding, lookups, text joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def in_list(column: str, values: Sequence) -> str:
    return f"coalesce({column} IN ({', '.join(map(quote, values))}), false)"


def case_map(column: str, table: Mapping, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def case_bands(column: str, bands, value=None) -> str:
    parts = []
    for i, b in enumerate(bands):
        tests = []
        if b.low is not None:
            tests.append(f"{column} {'>' if b.open_low else '>='} {b.low}")
        if b.high is not None:
            tests.append(f"{column} {'<=' if b.closed else '<'} {b.high}")
        parts.append(f"WHEN {' AND '.join(tests)} THEN {quote(b.label) if value is None else value(i)}")
    return f"CASE {' '.join(parts)} END"


def band_rank(column: str, bands) -> str:
    return case_bands(column, bands, lambda i: f"CAST({i + 1} AS INTEGER)")


def number(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({text}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
        f"THEN TRY_CAST(trim({text}) AS DOUBLE) END"
    )


def half_even(x: str, digits: int) -> str:
    s = float(10**digits)
    low, high = f"(floor(({x})*{s})/{s})", f"(ceil(({x})*{s})/{s})"
    gap = f"(({high} - ({x})) - (({x}) - {low}))"
    return f"(CASE WHEN {gap} < 0 OR ({gap} = 0 AND floor(({x})*{s}) % 2 = 1) THEN {high} ELSE {low} END)"


def pick(values: Sequence, index: str) -> str:
    """One of a fixed list, by a number starting at 0."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


def normal_label(text: str) -> str:
    squished = f"trim(regexp_replace({text}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"translate(upper({squished}), '‐‑‒–—−', '------')"

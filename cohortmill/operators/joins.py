"""Joins in which a missing key matches a missing key.

Keys compare with ``<=>``, which Spark still plans as an equi-join. Name collisions get
suffixes that repeat until every name is unique, so chained joins never give two columns
of one name. No side is hinted for broadcast: Spark compares its own size estimate, and
with adaptive execution the measured shuffle size, with ``autoBroadcastJoinThreshold``.

In left, semi and anti joins adaptive execution can split a hot key of the left side, in
inner joins of either side. It cannot split a full outer join, so full merges are put together
from an inner join and the unmatched rows of both sides. Where the first row per key is wanted,
``merge_first_rows`` needs no join and holds no key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.operators.dedup import first_per_key
from cohortmill.sources.files import stage

Keys = str | Sequence[str | tuple[str, str]]
SUFFIX = ("_x", "_y")


def _pairs(on: Keys) -> list[tuple[str, str]]:
    names = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in names]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _renamed(left: Sequence[str], right: Sequence[str], fixed: Sequence[str], suffix) -> tuple[dict, dict]:
    """New names for the payload of both sides; ``fixed`` are key names that never change."""
    def low(names):
        return {n.lower() for n in names}

    clash = low(left) & low(right)
    taken = low(fixed) | (low(left) | low(right)) - clash

    def assign(names, ending, also):
        out = {}
        for name in names:
            new = name
            if name.lower() in also:
                new = name + ending
                while new.lower() in taken:
                    new += ending
                taken.add(new.lower())
            out[name] = new
        return out

    return assign(left, suffix[0], clash), assign(right, suffix[1], clash | low(fixed))


def _once(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``df``, of which the query fails when it meets a key a second time; no job of its own."""
    names = [_quoted(k) for k in keys]
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(*[_quoted(c).alias(f"c{i}") for i, c in enumerate(payload)], F.lit(True).alias("known"))
    met = df.groupBy(*names).agg(F.any_value(row).alias("__row"), F.count(F.lit(1)).alias("__times"))
    shown = F.concat(F.lit(f"{side} side repeats the join key "), F.to_json(F.struct(*names)))
    met = met.filter(F.when(F.col("__times") > 1, F.raise_error(shown).cast("boolean")).otherwise(F.lit(True)))
    own = {c: F.col("__row").getField(f"c{i}") for i, c in enumerate(payload)}
    return met.select(*[own[c].alias(c) if c in own else _quoted(c) for c in df.columns])


def _join(left: DataFrame, right: DataFrame, on: Keys, how: str, suffix, expect: str, na_match: bool) -> DataFrame:
    pairs = _pairs(on)
    left_keys, right_keys = [p[0] for p in pairs], [p[1] for p in pairs]
    if expect.endswith(":1"):
        right = _once(right, right_keys, "right")
    if expect.startswith("1:"):
        left = _once(left, left_keys, "left")

    left_payload = [c for c in left.columns if c not in left_keys]
    right_payload = [c for c in right.columns if c not in right_keys]
    new_left, new_right = _renamed(left_payload, right_payload, left_keys, suffix)

    ours = left.select(*[_quoted(c).alias(new_left.get(c, c)) for c in left.columns])
    theirs = right.select(
        *[_quoted(k).alias(f"__key{i}") for i, k in enumerate(right_keys)],
        *[_quoted(c).alias(new_right[c]) for c in right_payload],
    )
    tests = []
    for i, key in enumerate(left_keys):
        mine, other = _quoted(key), F.col(f"__key{i}")
        tests.append(mine.eqNullSafe(other) if na_match else mine == other)
    joined = ours.join(theirs, reduce(lambda a, b: a & b, tests), how)
    return joined.drop(*[f"__key{i}" for i in range(len(right_keys))])


def left_join(
    left, right, on, suffix=SUFFIX, expect="m:m", na_match=True, hot_rows: int | None = None
) -> DataFrame:
    """Keep every left row; matches multiply it.

    ``on`` lists names, or (left name, right name) pairs, and the left name survives.
    ``expect`` ("1:1", "m:1", "1:m", "m:m") checks the uniqueness it promises: the query fails
    where a key repeats, found in the aggregate by key that the join is given for its side.
    ``na_match=False`` uses plain equality for keys known not to be missing, which lets
    Spark reuse a bucketing or an earlier shuffle on the same columns.
    ``hot_rows`` looks for left keys with more rows than that and deals them out over
    several tasks; it is for joins followed by another step on the same keys, where
    adaptive execution leaves a hot key alone.
    """
    if hot_rows is not None:
        keys = [l for l, _ in _pairs(on)]
        hot = _hot_keys([left], keys, hot_rows)
        if hot is not None:
            options = (suffix, expect, na_match)
            cold = _join(anti_join(left, hot, keys), right, on, "left", *options)
            return cold.unionByName(_dealt_left_join(left, right, on, hot, *options))
    return _join(left, right, on, "left", suffix, expect, na_match)


def _dealt_left_join(left, right, on: Keys, hot: DataFrame, suffix, expect, na_match) -> DataFrame:
    """Left join of the hot keys: left rows dealt out over parts, right rows in every part."""
    pairs = _pairs(on)
    keys = [l for l, _ in pairs]
    parts = hot.select(*[_quoted(l).alias(r) for l, r in pairs], "__parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))
    copies = inner_join(right, parts, [r for _, r in pairs])
    copies = copies.select(*[_quoted(c) for c in right.columns], every.alias("__part"))
    joined = _join(_dealt(left, 0, hot, keys), copies, [*pairs, "__part"], "left", suffix, expect, na_match)
    return joined.drop("__part")


def inner_join(left, right, on, suffix=SUFFIX, expect="m:m", na_match=True) -> DataFrame:
    return _join(left, right, on, "inner", suffix, expect, na_match)


def natural_left_join(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Left join on every column name the two sides share."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common column to join on")
    return left_join(left, right, common, **options)


def _unique_keys(right: DataFrame, pairs) -> DataFrame:
    """One row per key, so a key that fills much of ``right`` reaches the join once."""
    return right.select(*[_quoted(r).alias(l) for l, r in pairs]).distinct()


def semi_join(left: DataFrame, right: DataFrame, on: Keys, na_match=True) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    pairs = _pairs(on)
    return _join(left, _unique_keys(right, pairs), [l for l, _ in pairs], "left_semi", SUFFIX, "m:m", na_match)


def anti_join(left: DataFrame, right: DataFrame, on: Keys, na_match=True) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    pairs = _pairs(on)
    return _join(left, _unique_keys(right, pairs), [l for l, _ in pairs], "left_anti", SUFFIX, "m:m", na_match)


def without_payload(left: DataFrame, right: DataFrame, on: Keys, payload: str, **options) -> DataFrame:
    """Left join, then keep the rows whose ``payload`` from the right is missing.

    This equals ``anti_join`` only while ``payload`` is never missing in ``right``.
    """
    return left_join(left, right, on, **options).filter(_quoted(payload).isNull())


def with_payload(left: DataFrame, right: DataFrame, on: Keys, payload: str, **options) -> DataFrame:
    """Left join, then keep the rows whose ``payload`` from the right is present.

    Such a row must have matched, so an inner join on the filtered right side is the same.
    """
    return inner_join(left, right.filter(_quoted(payload).isNotNull()), on, **options)


def _row_counts(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key of any frame; ``__rows`` holds the rows each frame has for it.

    One shuffle of pre-aggregated keys, whatever the number of frames.
    """
    tagged = [f.select(*[_quoted(k) for k in keys], F.lit(i).alias("__frame")) for i, f in enumerate(frames)]
    rows = F.array(*[F.count_if(F.col("__frame") == i) for i in range(len(frames))])
    return reduce(DataFrame.unionAll, tagged).groupBy(*[_quoted(k) for k in keys]).agg(rows.alias("__rows"))


def presence(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key found in any frame, with one true/false column per frame."""
    counts = _row_counts(list(frames.values()), keys)
    flags = [(F.get("__rows", F.lit(i)) > 0).alias(name) for i, name in enumerate(frames)]
    return counts.select(*[_quoted(k) for k in keys], *flags)


def _hot_keys(frames: Sequence[DataFrame], keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows in a frame, or None when there are none.

    There are at most (rows / hot_rows) of them per frame. They are written down, so that
    all steps that follow agree on them.
    """
    counts = _row_counts(frames, keys)
    most = F.array_max("__rows")
    hot = counts.filter(most > hot_rows)
    if hot.isEmpty():
        return None
    return stage(
        hot.withColumn("__parts", F.ceil(most / hot_rows))
        .withColumn("__largest", F.array_position("__rows", most) - 1)
    )


def _dealt(frame: DataFrame, i: int, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hot rows of a frame, completed and dealt out over the parts of their key.

    A hot key the frame lacks gets a row of missing payload. The frame with most rows of
    a key deals them out over ``__part``; the others repeat theirs in every part, so that
    each combination of rows still meets exactly once.
    """
    names = [_quoted(k) for k in keys]
    lacking = hot.filter(F.get("__rows", F.lit(i)) == 0).select(*names)
    complete = semi_join(frame, hot, keys).unionByName(lacking, allowMissingColumns=True)
    columns = [_quoted(c) for c in complete.columns]
    sized = left_join(complete, hot.select(*names, "__parts", "__largest"), keys)
    own = F.array(F.pmod(F.xxhash64(*columns), F.col("__parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)
    part = F.explode(F.when(F.col("__largest") == i, own).otherwise(every))
    return sized.select(*columns, part.alias("__part"))


def _full_pair(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix) -> DataFrame:
    left_payload = [c for c in left.columns if c not in keys]
    right_payload = [c for c in right.columns if c not in keys]
    new_left, new_right = _renamed(left_payload, right_payload, keys, suffix)
    names = [_quoted(k) for k in keys]
    ours = left.select(*names, *[_quoted(c).alias(new_left[c]) for c in left_payload])
    theirs = right.select(*names, *[_quoted(c).alias(new_right[c]) for c in right_payload])
    columns = [*names, *[_quoted(c) for c in (*new_left.values(), *new_right.values())]]
    unmatched = [anti_join(ours, theirs, keys), anti_join(theirs, ours, keys)]
    parts = [inner_join(ours, theirs, keys), *unmatched]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns)


def _chain_names(payload: Sequence[Sequence[str]], keys: Sequence[str], suffix) -> list[dict[str, str]]:
    """The names that the columns of each table have after joining them one after the other."""
    names = [{c: c for c in payload[0]}]
    for cols in payload[1:]:
        left, right = _renamed([n for known in names for n in known.values()], cols, keys, suffix)
        names = [{c: left[n] for c, n in known.items()} for known in names] + [{c: right[c] for c in cols}]
    return names


def stacked_merge(
    frames: Sequence[DataFrame], on: Sequence[str], suffix=SUFFIX, needs: Mapping[int, Sequence[int]] | None = None
) -> DataFrame:
    """Full outer merge of tables that hold few rows per key, in one shuffle whatever the number of tables.

    The tables are stacked and grouped by key, and the rows that each table has for a key are combined with those of the
    others. ``needs`` turns tables into lookups, as in a left join: the rows of table i are taken for a key only if one
    of the tables in ``needs[i]`` has it, and make no row by themselves. All rows of a key meet in one task.
    """
    keys, needs = list(on), needs or {}
    names = [_quoted(k) for k in keys]
    payload = [[c for c in f.columns if c not in keys] for f in frames]
    shown = _chain_names(payload, keys, suffix)
    parts = []
    for i, (frame, cols) in enumerate(zip(frames, payload, strict=True)):
        row = F.struct(F.lit(True).alias("known"), *[_quoted(c).alias(f"c{j}") for j, c in enumerate(cols)])
        parts.append(frame.select(*names, row.alias(f"__{i}")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = stacked.groupBy(*names).agg(*[F.collect_list(f"__{i}").alias(f"__{i}") for i in range(len(frames))])

    def has(i: int) -> Column:
        return F.size(f"__{i}") > 0

    own = [has(i) for i in range(len(frames)) if i not in needs]
    out = out.filter(reduce(lambda a, b: a | b, own))
    out = out.withColumns({f"__{i}": F.when(reduce(lambda a, b: a | b, [has(j) for j in asked]), F.col(f"__{i}")) for i, asked in needs.items()})
    for i in range(len(frames)):
        out = out.withColumn(f"__{i}", F.explode_outer(f"__{i}"))
    columns = [F.col(f"__{i}").getField(f"c{j}").alias(shown[i][c]) for i, cols in enumerate(payload) for j, c in enumerate(cols)]
    return out.select(*names, *columns)


def full_merge(
    frames: Sequence[DataFrame],
    on: Sequence[str],
    suffix=SUFFIX,
    order: str | None = None,
    hot_rows: int | None = None,
    split: bool = True,
) -> DataFrame:
    """Full outer join of two or more tables on one list of keys, keys coalesced.

    Two tables are met in an inner join, to which the rows of either side without a match are added: all three joins
    can be split where a key is hot, and no job looks for such keys. Of more tables each step is written before the next,
    which would read it three times. Tables that hold few rows per key are better merged in one shuffle, with ``split=False`` (see
    ``stacked_merge``). ``hot_rows`` does the same, after a job that counts rows per key and deals out keys with more rows.

    With ``order``, the column of that name in every frame comes back as ``_order_0``,
    ``_order_1``, ..., for picking first rows (see ``merged_order``).
    """
    keys = list(on)
    if order is not None:
        frames = [f.withColumnRenamed(order, f"_order_{i}") for i, f in enumerate(frames)]
    split = split and hot_rows is None

    def plain(parts):
        if not split:
            return stacked_merge(parts, keys, suffix)
        out = parts[0]
        for i, part in enumerate(parts[1:]):
            out = _full_pair(stage(out) if i else out, part, keys, suffix)
        return out

    hot = None if hot_rows is None else _hot_keys(frames, keys, hot_rows)
    if hot is None:
        return plain(frames)
    dealt = [_dealt(f, i, hot, keys) for i, f in enumerate(frames)]
    met = reduce(lambda a, b: inner_join(a, b, [*keys, "__part"], suffix=suffix), dealt).drop("__part")
    return plain([anti_join(f, hot, keys) for f in frames]).unionByName(met)


def full_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffix=SUFFIX, hot_rows: int | None = None) -> DataFrame:
    return full_merge([left, right], on, suffix, hot_rows=hot_rows)


def merged_order(frames: int) -> list[Column]:
    """Row order after ``full_merge``: left rows first, unmatched right rows after them."""
    return [F.col(f"_order_{i}").asc_nulls_last() for i in range(frames)]


def merge_first_rows(frames: Sequence[DataFrame], on: Sequence[str], order: str, suffix=SUFFIX) -> DataFrame:
    """The first row per key of ``full_merge``, in ``merged_order``, without joining.

    That row combines the first row of each frame, so one grouped minimum per frame over the
    stacked frames gives it: one shuffle, combined before it, whatever rows a key has. The
    names are those of ``full_merge``; the row orders come back as ``_order_0``, ...
    """
    keys = list(on)
    payload = [[c for c in f.columns if c not in keys and c != order] for f in frames]
    names = [{c: c for c in payload[0]}]
    for cols in payload[1:]:
        shown = [n for known in names for n in known.values()]
        left, right = _renamed([*shown, *[f"_order_{i}" for i in range(len(names))]], [*cols, f"_order_{len(names)}"], keys, suffix)
        names = [{c: left[n] for c, n in known.items()} for known in names] + [{c: right[c] for c in cols}]
    stacked = None
    for i, (frame, cols) in enumerate(zip(frames, payload, strict=True)):
        packed = F.struct(F.lit(True).alias("__known"), *[_quoted(c) for c in cols])
        part = frame.select(*[_quoted(k) for k in keys], _quoted(order).alias(f"__o{i}"), packed.alias(f"__p{i}"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    firsts = stacked.groupBy(*[_quoted(k) for k in keys]).agg(
        *[F.min_by(f"__p{i}", f"__o{i}").alias(f"__p{i}") for i in range(len(frames))],
        *[F.min(f"__o{i}").alias(f"_order_{i}") for i in range(len(frames))],
    )
    columns = [F.col(f"__p{i}").getField(c).alias(n) for i, known in enumerate(names) for c, n in known.items()]
    return firsts.select(*[_quoted(k) for k in keys], *columns, *[f"_order_{i}" for i in range(len(frames))])


def lookup_with_fallback(df, table, on, preferred: str, fallback: str, output: str, **options) -> DataFrame:
    """Join a lookup and take its value, or the row's own value where the lookup has none."""
    joined = left_join(df, table, on, **options)
    return joined.withColumn(output, F.coalesce(_quoted(preferred), _quoted(fallback)))


def fill_from_first_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    attributes: Mapping[str, str],
    hot_rows: int | None = None,
    few_rows: bool = False,
) -> DataFrame:
    """Give every row of a key the attributes of that key's first row, missing ones included.

    ``attributes`` maps source column to new column. The first rows are picked before
    the shuffle and joined back, many to one; ``hot_rows`` as in ``left_join``. For keys that hold few rows each, such as the
    subjects of a study, ``few_rows`` reads ``df`` once and shuffles it once, in a window over each key.
    """
    if few_rows:
        first = Window.partitionBy(*[_quoted(k) for k in keys]).orderBy(*order)
        return df.withColumns({new: F.first(_quoted(c)).over(first) for c, new in attributes.items()})
    firsts = first_per_key(df, keys, order).select(
        *[_quoted(k) for k in keys], *[_quoted(c).alias(new) for c, new in attributes.items()]
    )
    return left_join(df, firsts, list(keys), hot_rows=hot_rows)

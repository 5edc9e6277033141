"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.staging import fresh

Targets = dict[str, float]

#: The topic ladder: the first topic whose marks a text holds, else the last.
TOPICS: dict[str, list[str]] = {"tables": [" | "], "legal": ["icensed under", "eleased under", "opyright"], "contact": ["@"]}
REST_TOPIC = "prose"


def topic(text: Column) -> Column:
    out = F
    for name, marks in TOPICS.items():
        holds = F.lit(False)
        for mark in marks:
            holds = holds | text.contains(mark)
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(REST_TOPIC))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def category(value: Column, targets: Targets) -> Column:
    """The place of a value among the targets; values without a target, NULL included, share the last place."""
    place = F.array_position(F.array(*[F.lit(k) for k in targets]), value)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(targets))).cast("int")


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(weights: Column, places: Column, n: int) -> Column:
    """The total weight at each place."""
    pairs = F.arrays_zip(weights.alias("w"), places.alias("p"))

    def total(pair: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.aggregate(pair, F.lit(0.0), lambda a, x: a + F.when(x["p"] == k, x["w"]).otherwise(0.0)))

    return _bind(pairs, total)


def _goals(mass: Column, targets: Targets) -> Column:
    """What each place should weigh: the rest keeps its share, and the targets present divide what remains in proportion.

    If no row meets a target above zero, every place keeps its weight.
    """
    want = F.array(*[F.lit(float(x)) for x in targets.values()], F.lit(0.0))
    here = F.transform(want, lambda x, k: F.when(F.get(mass, k) > 0, x).otherwise(0.0))
    known = F.struct(here.alias("here"), F.aggregate(here, F.lit(0.0), lambda a, x: a + x).alias("met"), F.aggregate(mass, F.lit(0.0), lambda a, x: a + x).alias("all"), F.get(mass, F.lit(len(targets))).alias("rest"), mass.alias("mass"))

    def goal(b: Column) -> Column:
        return F.transform(b["here"], lambda x, k: F.when((k == len(targets)) | (b["met"] <= 0), F.get(b["mass"], k)).otherwise(F.try_divide(x, b["met"]) * (b["all"] - b["rest"])))

    return _bind(known, goal)


def rake(cells: DataFrame, margins: list[tuple[str, Targets]], rounds: int) -> DataFrame:
    """(places, tokens, weight, residual) of the cells, with weights whose sums over each margin come to meet its targets.

    The residual is how far the place that is furthest from its goal still is from it, over all weight; each row has it.

    ``cells`` has a column of places per margin and ``tokens``. There are at most as many cells as the targets and their rests
    multiply to, so they fit in one row, in which every round of every margin is an expression on arrays.
    """

    def goals_of(targets: Targets):
        return lambda mass: _goals(mass, targets)

    def raked_by(name: str, targets: Targets):
        return lambda weights: one(weights, name, targets)

    names = [name for name, _ in margins]
    row = cells.agg(F.sort_array(F.collect_list(F.struct(*names, "tokens"))).alias("cell"))
    row = row.select("cell", F.col("cell.tokens").cast("array<double>").alias("start"), *[F.col(f"cell.{m}").alias(m) for m in names])
    row = row.select("*", *[_bind(_sums(F.col("start"), F.col(m), len(t)), goals_of(t)).alias(f"goal_{m}") for m, t in margins])

    def one(weights: Column, name: str, targets: Targets) -> Column:
        return _bind(_sums(weights, F.col(name), len(targets)), lambda total: F.transform(F.arrays_zip(weights.alias("w"), F.col(name).alias("p")), lambda x: F.when(F.get(total, x["p"]) > 0, x["w"] * F.get(F.col(f"goal_{name}"), x["p"]) / F.get(total, x["p"])).otherwise(0.0)))

    def step(weights: Column, _: Column) -> Column:
        for name, targets in margins:
            weights = _bind(weights, raked_by(name, targets))
        return weights

    raked = row.withColumn("weight", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("start"), step))
    off = [F.array_max(F.zip_with(_sums(F.col("weight"), F.col(m), len(t)), F.col(f"goal_{m}"), lambda a, b: F.abs(a - b))) for m, t in margins]
    whole = F.aggregate("start", F.lit(0.0), lambda a, x: a + x)
    raked = raked.withColumn("residual", F.coalesce(F.try_divide(F.greatest(*off) if len(off) > 1 else off[0], whole), F.lit(0.0)))
    return raked.select("residual", F.explode(F.arrays_zip("cell", "weight")).alias("x")).select("x.cell.*", F.col("x.weight").alias("weight"), "residual")


def uniform(id: Column, seed: int) -> Column:
    """A number from 0 to below 1 that the seed and the id determine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, sources: Targets, langs: Targets, topics: Targets, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", rate: float = 1.0, rounds: int = 50, seed: int = 42) -> DataFrame:
    """``docs`` with raking_residual, topic, n_tokens, expected_copies and copies.

    Token weights are raked to the three margins over the whole table. A document of a cell is expected in the sample as often as its
    cell's weight is to its tokens, times ``rate``: it gets the whole part of that and one more with the chance of the fraction, by a
    hash of seed and id, so equal ids fare alike. With a rate of 1 the sample has as many tokens as the table, on average.
    Values without a target, NULL included, keep their share of the tokens. A target that no document meets is spread over the others in proportion; a
    margin none of whose targets is met leaves all weights as they are. raking_residual says how far the shares still are from the targets
    after the last round (the largest gap of any margin; every row has it). NULL and empty
    texts have no tokens and fare like their cell, or get no copy if the cell has no tokens. An empty table gives an empty result. Other
    columns pass through; a name that is taken gets underscores in front.
    """
    named = ("raking_residual", "topic", "n_tokens", "expected_copies", "copies")
    out = dict(zip(named, fresh(docs, *named), strict=True))
    p_source, p_lang, p_topic, tokens, weight = fresh(docs.select("*", *[F.lit(0).alias(c) for c in out.values()]), "place_source", "place_lang", "place_topic", "cell_tokens", "cell_weight")
    margins = [(p_source, sources), (p_lang, langs), (p_topic, topics)]
    told = docs.select("*", topic(F.col(text)).alias(out["topic"]), n_tokens(F.col(text)).alias(out["n_tokens"]))
    placed = told.select("*", category(F.col(source), sources).alias(p_source), category(F.col(lang), langs).alias(p_lang), category(F.col(out["topic"]), topics).alias(p_topic))
    places = [name for name, _ in margins]
    cells = placed.groupBy(*places).agg(F.sum(out["n_tokens"]).alias("tokens"))
    raked = rake(cells, margins, rounds).select(*places, F.col("tokens").alias(tokens), F.col("weight").alias(weight), F.col("residual").alias(out["raking_residual"]))
    met = placed.join(F.broadcast(raked), places)  # as many rows as declared categories multiply to
    expected = F.when(F.col(tokens) > 0, rate * F.col(weight) / F.col(tokens)).otherwise(0.0)
    rated = met.withColumn(out["expected_copies"], expected)
    whole = F.floor(out["expected_copies"])
    more = (uniform(F.col(id), seed) < F.col(out["expected_copies"]) - whole).cast("long")
    return rated.select(*[f"`{c}`" for c in docs.columns], out["raking_residual"], out["topic"], out["n_tokens"], out["expected_copies"], (whole + more).alias(out["copies"]))

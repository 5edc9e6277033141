"""Generalised linear models through Spark ML."""

from __future__ import annotations

import re

from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from cohortmill.functions.factors import levels_of
from cohortmill.sources.files import stage


def glm(df: DataFrame, formula: str, family: str = "gaussian") -> DataFrame:
    """Fit ``formula`` and return one row per coefficient.

    A factor becomes an indicator column for each declared level but the first. Rows with a missing value in any used column are
    left out. The rows are collapsed to their distinct patterns with counts where the fit takes several rounds (a binomial of
    declared factors and numbers), so the data are read once; only the normal equations, of the size of the
    predictors, reach the driver. Other text predictors, and formulas with more than sums, go through Spark's own formula
    reader, which looks up the levels, the alphabetically first one being the reference.
    """
    label, terms = _plain_terms(df, formula)
    if terms is None:
        return _by_formula(df, formula, family)
    columns = {label: F.col(label).cast("double")}
    names = []
    for term in terms:
        levels = levels_of(df, term)
        if levels is None:
            columns[term], names = F.col(term).cast("double"), [*names, (term, F.col(term))]
        else:
            columns[term] = F.col(term)
            names += [(f"{term}_{v}", (F.col(term) == v).cast("double")) for v in levels[1:]]
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).dropna()
    if family == "binomial":
        rows = rows.groupBy(*terms).agg(F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("__weight"))
    else:
        rows = rows.withColumn("__weight", F.lit(1.0))
    rows = stage(rows)
    features = rows.select(label, "__weight", *[c.alias(f"__x{i}") for i, (_, c) in enumerate(names)])
    data = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(names))], outputCol="features").transform(features)
    model = GeneralizedLinearRegression(family=family, labelCol=label, weightCol="__weight").fit(data)
    return _coefficients(df, model, [n for n, _ in names])


def _plain_terms(df: DataFrame, formula: str) -> tuple[str, list[str] | None]:
    """The outcome and the predictors of a formula that adds up declared factors and numbers, else no predictors."""
    label, _, right = (part.strip() for part in formula.partition("~"))
    terms = [t.strip() for t in right.split("+")]
    plain = all(t in df.columns for t in [label, *terms]) and label not in terms and len(set(terms)) == len(terms)
    if not plain or any(levels_of(df, t) is None and not isinstance(df.schema[t].dataType, NumericType) for t in terms):
        return label, None
    return label, terms


def _by_formula(df: DataFrame, formula: str, family: str) -> DataFrame:
    words = set(re.findall(r"\w+", formula))
    rows = stage(df if "." in formula else df.select(*[c for c in df.columns if c in words]))
    rules = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc", handleInvalid="skip").fit(rows)
    data = rules.transform(rows)
    model = GeneralizedLinearRegression(family=family, featuresCol="features", labelCol="label").fit(data)
    meta = data.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in meta.values() for a in kind}
    return _coefficients(df, model, [names[i] for i in range(len(names))])


def _coefficients(df: DataFrame, model, names: list[str]) -> DataFrame:
    summary = model.summary
    # Spark lists the intercept last in the summary vectors.
    values = [*model.coefficients, model.intercept]
    errors = summary.coefficientStandardErrors
    rows = [
        (name, float(values[i]), float(errors[i]), float(summary.tValues[i]), float(summary.pValues[i]))
        for i, name in enumerate([*names, "(Intercept)"])
    ]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, statistic double, p_value double"
    )

"""Schema rules: required, type, inclusive bounds and a pattern that is searched for, not matched whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    required: bool = False
    type: str = ""
    min: float | None = None
    max: float | None = None
    pattern: str = ""


_TYPES = {"string": (T.StringType,), "int": (T.IntegralType,), "float": (T.FractionalType, T.IntegralType), "bool": (T.BooleanType,), "array": (T.ArrayType,)}


def violation(df: DataFrame, rules: dict[str, Rule]) -> Column:
    """The first rule that a row breaks, as text, or null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        if name not in df.columns:
            if rule.required:
                out = F.lit(f"{name}: required")
            continue
        c, t = F.col(f"`{name}`"), df.schema[name].dataType
        checks: list[tuple[Column, str]] = []
        if rule.required:
            checks.append((c.isNull(), "required"))
        if rule.type and not isinstance(t, _TYPES[rule.type]):
            checks.append((c.isNotNull(), f"not a {rule.type}"))
        elif rule.type == "string" and rule.pattern:
            checks.append((~c.rlike(rule.pattern), "pattern"))
        # what isn't a number counts as 0
        x = c.cast("double") if isinstance(t, T.NumericType) else F.when(c.isNotNull(), F.lit(0.0))
        if rule.min is not None:
            checks.append((x < rule.min, "below minimum"))
        if rule.max is not None:
            checks.append((x > rule.max, "above maximum"))
        for bad, why in reversed(checks):
            out = F.when(bad, F.lit(f"{name}: {why}")).otherwise(out)
    return out


def validate(df: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with their ``violation``)."""
    marked = df.withColumn("violation", violation(df, rules))
    return marked.filter("violation is null").drop("violation"), marked.filter("violation is not null")

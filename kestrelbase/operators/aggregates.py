"""Group-by aggregates with document semantics.

count counts rows whatever the field; sum, avg, min and max look at numeric values only and
give 0.0 where there are none.  ``avg`` divides by all rows of the group in mode
"rows" and by the numeric values in mode "values".  A group exists only if it has
rows, so a global aggregate over nothing has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Agg:
    """One aggregate; the alias defaults to ``<field>_<op>``."""

    op: str
    field: str = ""
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias or f"{self.field or 'total'}_{self.op}"


def numeric(df: DataFrame, field: str) -> Column:
    """The field as double where it is numeric; NULL in all other cases."""
    if field not in df.columns or not isinstance(df.schema[field].dataType, T.NumericType):
        return F.lit(None).cast("double")
    return F.col(f"`{field}`").cast("double")


def column_of(df: DataFrame, agg: Agg, mode: str = "rows") -> Column:
    zero, x = F.lit(0.0), numeric(df, agg.field)
    if agg.op == "count":
        return F.count(F.lit(1)).alias(agg.name)
    if agg.op == "avg":
        return (F.coalesce(F.sum(x), zero) / F.count(F.lit(1)) if mode == "rows" else F.coalesce(F.avg(x), zero)).alias(agg.name)
    if agg.op == "count_distinct":
        return F.count_distinct(F.col(f"`{agg.field}`")).alias(agg.name)
    if agg.op == "approx_count_distinct":
        return F.approx_count_distinct(F.col(f"`{agg.field}`")).alias(agg.name)
    known = {"sum": F.sum, "min": F.min, "max": F.max}
    if agg.op not in known:
        raise ValueError(f"unknown aggregate: {agg.op}")
    return F.coalesce(known[agg.op](x), zero).alias(agg.name)


def group(df: DataFrame, by: list[str], aggs: list[Agg], mode: str = "rows") -> DataFrame:
    """One row for each distinct combination of ``by``; nulls form a group."""
    columns = [column_of(df, a, mode) for a in aggs]
    if by:
        return df.groupBy(*(F.col(f"`{b}`") for b in by)).agg(*columns)
    return df.agg(F.count(F.lit(1)).alias("__rows"), *columns).filter("__rows > 0").drop("__rows")

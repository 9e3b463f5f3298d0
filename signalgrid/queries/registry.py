"""Registry of runnable queries and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.plans import views

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, needs: Sequence[str] = (), recursive: bool = False):
    """Register a query; `needs` names the driver views its SQL refers to."""
    def wrap(fn: Build) -> Build:
        text = None
        if sql is not None:
            body = sql.strip()
            ctes = [f"{v} AS ({views.view_sql(v)})" for v in needs]
            if ctes:
                # SQL that starts with WITH continues the list of view expressions.
                head = "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(ctes)
                text = head + ", " + body[5:] if body[:5].upper() == "WITH " else head + " " + body
            else:
                text = body
        REGISTRY[name] = Query(name, fn, text)
        return fn
    return wrap


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Output form shared with the checking SQL: BIGINT integers, rounded DOUBLE, NULL for NaN."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), special.get(name, digits))
            c = c + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def scan_rows(spark: SparkSession, sf_dir: str, table: str) -> int:
    """Rows of a driver table from its footers: the proven bound on any group in it."""
    return views.read_table(spark, sf_dir, table).count()

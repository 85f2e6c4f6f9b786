"""Logical tables of a warehouse's own catalogue, as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Unsupported:
    """What stands in for a result when tables or columns are missing: absent is not empty."""

    missing: list[str]
    reason: str = "absent_on_system"


@dataclass
class Landscape:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    denied: set[str] = field(default_factory=set)

    def raw(self, name: str) -> DataFrame:
        return self.tables[name]

    def active(self, name: str, version_col: str = "OBJVERS") -> DataFrame:
        """The active version of a table that has versions; any other table as it is."""
        return self.scan(name, version_col=version_col)

    def scan(self, name: str, *where: str, columns: list[str] | None = None, compare_versions: bool = False, version_col: str = "OBJVERS") -> DataFrame:
        """The rows of a table that meet all conditions, of its active version if it has versions.

        All versions are read where a condition names the version itself, outside literals, or where compare_versions asks for it.
        """
        df = self.tables[name]
        named = any(re.search(rf"\b{re.escape(version_col)}\b", re.sub(r"'[^']*'", "''", w), re.IGNORECASE) for w in where)
        versioned = version_col.upper() in {c.upper() for c in df.columns}
        if versioned and not named and not compare_versions:
            df = df.where(F.col(version_col) == "A")
        for w in where:
            df = df.where(w)
        return df.select(*columns) if columns else df

    def require(self, *names: str) -> Unsupported | None:
        """None if all tables can be read, else what is missing and whether it was refused or is absent."""
        if refused := [n for n in names if n in self.denied]:
            return Unsupported(refused, "permission_denied")
        absent = [n for n in names if n not in self.tables]
        return Unsupported(absent) if absent else None

    def require_columns(self, name: str, *columns: str) -> Unsupported | None:
        known = {c.upper() for c in self.tables[name].columns}
        absent = [f"{name}.{c}" for c in columns if c.upper() not in known]
        return Unsupported(absent) if absent else None


def page(df: DataFrame, order: list, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page in a stated order, of 1 to `most` rows; `total` counts all rows."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
    return rows.crossJoin(F.broadcast(total))


def capped(df: DataFrame, order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` rows in a stated order, and a one-row frame that tells whether more were there."""
    more = df.orderBy(*order).limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return df.orderBy(*order).limit(limit), more

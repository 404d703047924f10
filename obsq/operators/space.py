"""An observation space: a DataFrame with a row for each location, and the state that quality control keeps in columns.

For a simulated variable v: `ObsValue/v`, `HofX/v`, `Err/v` (the current error), `QC/v` (0: passed) and flags `Diag/f/v`.
Filters never drop rows, and only AcceptList sets a rejected value back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our codes; 0 is a pass.
CODES = {"pass": 0, "missing": 10, "preqc": 11, "list": 12, "domain": 14, "bounds": 15, "thinned": 16, "difference": 17, "background": 19, "perform": 20}


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class ObsSpace:
    df: DataFrame
    variables: tuple[str, ...]
    location: str = "Location"

    @classmethod
    def of(cls, df: DataFrame, columns: Mapping[str, Column], variables: Sequence[str], keep: Sequence[str] = ()) -> "ObsSpace":
        """A space from a table: named columns, and the first state of each variable."""
        named = df.select(*keep, *(c.alias(n) for n, c in columns.items()))
        return cls(named, tuple(variables)).started()

    def started(self) -> "ObsSpace":
        """QC 10 where the value or, if there is one, what was simulated is missing; errors from ObsError where there are."""
        have = set(self.df.columns)
        new = {}
        for v in self.variables:
            gone = col(f"ObsValue/{v}").isNull()
            if f"HofX/{v}" in have:
                gone = gone | col(f"HofX/{v}").isNull()
            if f"QC/{v}" not in have:
                new[f"QC/{v}"] = F.when(gone, CODES["missing"]).otherwise(0)
            if f"Err/{v}" not in have:
                new[f"Err/{v}"] = col(f"ObsError/{v}").cast("double") if f"ObsError/{v}" in have else F.lit(None).cast("double")
        return self.with_columns(new)

    def with_columns(self, new: Mapping[str, Column]) -> "ObsSpace":
        if not new:
            return self
        have = self.df.columns
        out = [(new[c].alias(c) if c in new else col(c)) for c in have] + [e.alias(c) for c, e in new.items() if c not in have]
        return replace(self, df=self.df.select(*out))

    def passed(self, v: str) -> Column:
        return col(f"QC/{v}") == 0

    def departure(self, v: str) -> Column:
        """Observation less what was simulated."""
        return col(f"ObsValue/{v}") - col(f"HofX/{v}")

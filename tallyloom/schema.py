"""Values that name columns: a hierarchy of levels and metrics with a state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a metric, from the best to the worst in a combination.
STATES = ("observed", "not_applicable", "unknown", "unavailable")


@dataclass(frozen=True)
class Hierarchy:
    """Levels in order, coarsest first; each is a column of the fact table."""

    levels: tuple[str, ...]

    def key(self, level: str) -> list[str]:
        return list(self.levels[: self.levels.index(level) + 1])

    def path(self, level: str) -> Column:
        """Canonical path: ancestor ids joined by "/", the level's own id last."""
        return F.concat_ws("/", *[F.col(c).cast("string") for c in self.key(level)])


@dataclass(frozen=True)
class Metric:
    """A value that is there exactly if its state is "observed"; zero is data."""

    value: str

    @property
    def status(self) -> str:
        return f"{self.value}_status"

    def observed(self) -> Column:
        return F.col(self.status) == "observed"

    def valid(self) -> Column:
        """State and value agree."""
        return F.coalesce(F.col(self.status).isin(*STATES) & (self.observed() == F.col(self.value).isNotNull()), F.lit(False))

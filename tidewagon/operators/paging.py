"""Pages of a table at any depth (TOP-2): no task holds the rows before a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.functions.ranges import sorted_ranges


@dataclass(frozen=True)
class Pages:
    """A table stored in sorted ranges, with the number of rows before each; both are made once for all pages."""

    held: DataFrame
    starts: list[tuple[int, int]]  # (range, rows before it)
    key: str

    @classmethod
    def of(cls, table: DataFrame, key: str) -> Pages:
        """``key`` must be unique and not null; its order is that of the pages."""
        return cls(*sorted_ranges(table, [F.col(key)]), key)

    def _plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop("_range", "_in_range")

    def page(self, limit: int, offset: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order; reads the ranges that these rows are in, and of them these rows."""
        ends = [before for _, before in self.starts[1:]] + [None]
        wanted = [(number, before) for (number, before), end in zip(self.starts, ends)
                  if before < offset + limit and (end is None or end > offset)]
        inside: Column = F.lit(False)
        for number, before in wanted:
            inside = inside | ((F.col("_range") == number) & F.col("_in_range").between(offset - before, offset + limit - 1 - before))
        return self._plain(self.held.where(F.col("_range").isin([n for n, _ in wanted]) & inside)).orderBy(self.key)

    def after(self, last, limit: int) -> DataFrame:
        """The page that follows the key ``last``; None starts at the front."""
        rows = self._plain(self.held)
        return (rows if last is None else rows.where(F.col(self.key) > F.lit(last))).orderBy(self.key).limit(limit)

"""Ingestion of listings in stages: parse, prune what is stored, complete the rest, judge, insert, and note who was seen."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import upsert
from .stored import drop, written

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Ingested:
    """stored: the table after the run; new: the rows inserted; excluded: found rows that weren't completed or are no good; seen: the keys of all that was found and is stored now."""

    stored: DataFrame
    new: DataFrame
    excluded: DataFrame
    seen: DataFrame
    _tables: tuple[DataFrame, ...]

    def drop(self) -> None:
        """Delete what the results read; they can't be read any more."""
        drop(*self._tables)


@dataclass(frozen=True)
class Ingestion:
    """The stages of a source. keys: what identifies a listing. Every stage but parse may be left out.

    parse: pages to found rows. complete: rows that aren't stored yet to rows with more columns (say, from their own pages); a row that it
    loses is excluded. valid: a condition on completed rows, null counts as false. finish: completed rows to the columns of the stored table.
    """

    keys: list[str]
    parse: Stage
    complete: Stage | None = None
    valid: Column | None = None
    finish: Stage | None = None

    def run(self, pages: DataFrame, stored: DataFrame) -> Ingested:
        """Pages are parsed once and only new listings completed once: both are written. Keys may repeat among the found rows; one row of each is inserted. Stored rows never change."""
        keys = self.keys
        found = written(self.parse(pages), "found")
        fresh = upsert.new_rows(found, stored, keys)
        whole = fresh if self.complete is None else self.complete(fresh)
        good = whole if self.valid is None else whole.where(F.coalesce(self.valid, F.lit(False)))
        made = good if self.finish is None else self.finish(good)
        new = written(upsert.last_of_each(made.select(stored.columns), keys, None), "new")
        after = stored.unionByName(new)
        excluded = fresh.join(new.select(*keys), keys, "left_anti")
        seen = found.select(*keys).distinct().join(after.select(*keys), keys, "left_semi")
        return Ingested(after, new, excluded, seen, (found, new))

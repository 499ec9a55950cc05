"""Pages of a long ordered list by a sparse index: the rows stored in ranges of the order, with where each range begins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import page_number
from .stored import drop, read, write, written

RANGE_ROWS = 10_000  # rows of a range
FILE_ROWS = 200_000  # rows of a stored part, or so; its ranges are told apart by place
MOST_RANGES, MOST_FILES = 100_000, 10_000
_PART, _PLACE = "page_part", "page_place"


@dataclass
class PageIndex:
    """Rows stored by part and place in it; for each range its part and the places of its rows in the whole order, the first is 0."""

    folder: str
    schema: object
    starts: DataFrame
    rows: int

    def drop(self) -> None:
        drop(read(self.starts.sparkSession, self.folder, self.schema), self.starts)


def build(rows: DataFrame, order: list[Column], *, range_rows: int = RANGE_ROWS, file_rows: int = FILE_ROWS) -> PageIndex:
    """Store rows in the order of columns (which must tell rows apart for pages to be the same each time), in ranges of range_rows rows.

    The order is made once, by parts of about file_rows rows, each numbered apart in its own task. A part is one sorted file whose pages of Parquet are no
    longer than a range, so a page reads the one or two ranges that it lies in, whichever page it is. The driver deals with parts, not with ranges: what
    it samples and lists grows with the files. The ranges, rows of a table, are at most MOST_RANGES, or one for each part.
    """
    spark, total = rows.sparkSession, rows.count()
    range_rows = max(range_rows, -(-total // MOST_RANGES))
    parts = max(1, min(MOST_FILES, -(-total // max(file_rows, range_rows))))
    at = F.monotonically_increasing_id()  # the task, then the place of a row in it
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(_PLACE, at)
    spread = spread.withColumns({_PART: F.shiftright(_PLACE, 33).cast("int"), _PLACE: F.col(_PLACE).bitwiseAND((1 << 33) - 1)})
    folder = write(spread.sortWithinPartitions(_PART, _PLACE), "pages", by=_PART, options={"parquet.page.row.count.limit": str(range_rows)})
    stored = read(spark, folder, spread.schema)
    sizes = stored.groupBy(_PART).agg(F.count("*").alias("rows"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = sizes.select(_PART, "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    ranges = offsets.select(_PART, "rows", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(range_rows).cast("long"))).alias("at"))
    starts = ranges.select(_PART, F.least(F.col("rows") - F.col("at"), F.lit(range_rows)).alias("size"), (F.col("offset") + F.col("at")).alias("start"), F.col("at").alias("first"))
    return PageIndex(folder, spread.schema, written(starts.coalesce(1), "starts"), total)


def page(index: PageIndex, asked: str | int | None = 1, per_page: int = 50) -> DataFrame:
    """One page, as search.paged gives it, in order; only the ranges that it lies in are read."""
    first = (page_number(asked, index.rows, per_page) - 1) * per_page
    last = min(first + per_page, index.rows)
    spark = index.starts.sparkSession
    stored = read(spark, index.folder, index.schema)
    hit = index.starts.where((F.col("start") < last) & (F.col("start") + F.col("size") > first)).collect()  # the few ranges of a page
    columns = [c for c in index.schema.names if c not in (_PART, _PLACE)]
    if not hit:
        return stored.limit(0).select(columns)
    wanted = F.lit(False)
    for r in hit:
        begin, end = r["first"] + max(first - r["start"], 0), r["first"] + min(last - r["start"], r["size"])
        wanted = wanted | ((F.col(_PART) == r[_PART]) & F.col(_PLACE).between(begin, end - 1))
    return stored.where(F.col(_PART).isin(sorted({r[_PART] for r in hit})) & wanted).orderBy(_PART, _PLACE).select(columns)

"""A paged HTTP source of rounds as a Spark data source: paged_rounds, and paged_rounds_pushed with filters."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from answergauge import schema

#: Rounds in a page.
PAGE = 500


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


def fetch(url: str, intent: str | None, offset: int, timeout: float) -> dict:
    query = {"limit": PAGE, "offset": offset} | ({"intent": intent} if intent else {})
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(query)}", timeout=timeout) as answer:
        return json.load(answer)


class PagedReader(DataSourceReader):
    """One partition for each page; the first page says how many there are."""

    def __init__(self, options: dict, get: Callable[[str, str | None, int, float], dict] = fetch):
        self.url, self.intent = options["url"], options.get("intent") or None
        self.most, self.timeout, self.get = int(options.get("max", 0)), float(options.get("timeout", 30)), get
        self.keep = str(options.get("keep", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        total = int(self.get(self.url, self.intent, 0, self.timeout).get("total") or 0)
        return [_Page(o) for o in range(0, min(total, self.most) if self.most else total, PAGE)] or [_Page(0)]

    def read(self, page: _Page) -> Iterator[tuple]:
        try:
            rows = self.get(self.url, self.intent, page.offset, self.timeout).get("scores") or []
        except Exception as e:
            if not self.keep:
                raise
            yield (page.offset, *([None] * len(schema.ROUND)), f"{type(e).__name__}: {e}")
            return
        kinds = {"bigint": (int, 0), "double": (float, 0.0), "string": (str, "")}
        for k, row in enumerate(rows):
            if self.most and page.offset + k >= self.most:
                return
            made = (kinds[f.dataType.simpleString()] + (row.get(f.name),) for f in schema.ROUND)
            yield (page.offset + k, *(zero if value is None else kind(value) for kind, zero, value in made), *[None] * self.keep)


class PushingReader(PagedReader):
    """A filter on intent_id goes to the server; Spark asks for spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("intent_id",) and not self.intent:
                self.intent = f.value
            yield f  # Spark applies it, too


class PagedRounds(DataSource):
    """Options: url, intent, max (rounds), timeout (seconds), keep. Columns: pos and those of a round.

    keep: a page that can't be read is a row with its pos and, in a further column, its error; the other pages are read.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rounds"

    def schema(self) -> StructType:
        kept = str(self.options.get("keep", "false")).lower() == "true"
        return StructType([StructField("pos", LongType()), *schema.ROUND, *[StructField("error", StringType())] * kept])

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)


class PushedRounds(PagedRounds):
    """The same with filters pushed to the server."""

    @classmethod
    def name(cls) -> str:
        return "paged_rounds_pushed"

    def reader(self, schema: StructType) -> PagedReader:
        return PushingReader(self.options)


def up_to_the_end(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """Of rows read with keep those before the first page that failed, or up to the first that isn't full, and what failed.

    A server that gives a short page has no more, whatever its total was. If nothing was read, the error is raised.
    """
    page = F.floor(F.col("pos") / PAGE).alias("page")
    pages = rows.groupBy(page).agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n"), F.first("error", True).alias("error"))
    ends = pages.where((F.col("n") < PAGE) | F.col("error").isNotNull()).agg(F.min_by(F.struct("page", "error"), "page").alias("r")).first().r
    if ends is None:
        return rows.drop("error"), None
    if ends.error and ends.page == 0:
        raise OSError(ends.error)
    return rows.where("error is null").where(F.floor(F.col("pos") / PAGE) <= ends.page).drop("error"), ends.error

"""Feeds that page backwards in time, as a source that plans and prunes.

A partition is a range of time of one symbol. It walks the feed's cursor from the
end of its range down to its start, so filters on symbol and ts decide which
pages are asked for at all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quantloom.sources.connectors import BARS
from quantloom.sources.shared import opened, ship

PAGE = 200
LEAST, MOST = datetime(1, 1, 1), datetime(9999, 12, 31)
TICK = timedelta(microseconds=1)


class Feed:
    """What the source asks: symbols, and pages of rows (in the order of BARS)."""

    def symbols(self) -> list[str]:
        raise NotImplementedError

    def span(self, symbol: str) -> tuple[datetime, datetime] | None:
        """The first and last time of a symbol, if that is known without a page."""
        return None

    def page(self, symbol: str, before: datetime | None) -> tuple[list[tuple], datetime | None]:
        """The last rows before a time (null: of all), and the next cursor, null
        where nothing is left."""
        raise NotImplementedError


class Archive(Feed):
    """Pages that `write_pages` has stored, one file a page, found by listing."""

    def __init__(self, path: str):
        self.path = path

    def symbols(self) -> list[str]:
        files, root = opened(self.path)
        found = files.get_file_info(filesystems.FileSelector(root))
        return sorted(f.base_name.removeprefix("page_of=") for f in found if f.base_name.startswith("page_of="))

    def pages(self, symbol: str) -> list[tuple[int, str]]:
        files, root = opened(self.path)
        found = files.get_file_info(filesystems.FileSelector(f"{root}/page_of={symbol}", recursive=True, allow_not_found=True))
        return sorted((int(re.search(r"until=(-?\d+)/", f.path)[1]), f.path) for f in found if f.path.endswith(".parquet"))

    def page(self, symbol: str, before: datetime | None) -> tuple[list[tuple], datetime | None]:
        files, _ = opened(self.path)
        known = self.pages(symbol)
        ends = [end for end, _ in known]
        limit = None if before is None else micros(before)
        k = len(known) - 1 if limit is None else min(bisect_left(ends, limit - 1), len(known) - 1)
        if k < 0:
            return [], None
        table = pq.read_table(known[k][1], filesystem=files).select(NAMES)
        rows = [r for r in zip(*(c.to_pylist() for c in table.columns)) if limit is None or micros(r[1]) < limit]
        return rows, datetime(1970, 1, 1) + timedelta(microseconds=ends[k - 1] + 1) if k else None


def micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1)) // TICK


NAMES = [c.split()[0] for c in BARS.split(", ")]


def write_pages(bars: DataFrame, path: str, size: int = PAGE) -> None:
    """Stores bars (columns of BARS) as pages of `size` rows by symbol, the newest
    page full: what an answering feed would hand out. The newest time of a page
    names it. Bars of one time of a symbol stay on one page."""
    line = W.partitionBy("symbol").orderBy(F.desc("ts"))
    numbered = bars.select(*NAMES).withColumn("n", F.floor((F.rank().over(line) - 1) / size))
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    until = F.max(at).over(W.partitionBy("symbol", "n"))
    ready = numbered.select("*", F.col("symbol").alias("page_of"), until.alias("until")).drop("n")
    ready.repartition("page_of", "until").sortWithinPartitions("page_of", "until", "ts").write.partitionBy("page_of", "until").parquet(path)


class Slice(InputPartition):
    """A symbol from a time to before another."""

    def __init__(self, symbol: str, start: datetime, end: datetime):
        super().__init__((symbol, start, end))


class PagedReader(DataSourceReader):
    """Filters on symbol (equal, one of) and ts (compared) are taken over whole and
    decide what is planned; others are left to Spark."""

    def __init__(self, feed: Feed, options):
        self.feed = feed
        self.wanted = {s.strip() for s in options["symbols"].split(",") if s.strip()} if "symbols" in options else None
        self.start, self.end = LEAST, MOST
        self.slices = int(options.get("slices", "1"))
        if not 1 <= self.slices <= 10_000:
            raise ValueError("1 to 10,000 slices a symbol")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.taken(f):
                yield f

    def taken(self, f: Filter) -> bool:
        name = ".".join(f.attribute) if hasattr(f, "attribute") else None
        if isinstance(f, IsNotNull) and name in ("symbol", "ts"):
            return True  # no page has a null there
        if name == "symbol" and isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted = asked if self.wanted is None else self.wanted & asked
            return True
        value = getattr(f, "value", None)
        if name != "ts" or not isinstance(value, datetime) or value.tzinfo is not None:
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.start = max(self.start, value + TICK if isinstance(f, GreaterThan) else value)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.end = min(self.end, value if isinstance(f, LessThan) else value + TICK)
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def partitions(self) -> list[Slice]:
        """Ranges of time by symbol: as many of equal length as asked for where the
        range is known, the first and last open where the filters leave them open."""
        out = []
        for symbol in self.feed.symbols():
            if self.wanted is None or symbol in self.wanted:
                span = self.feed.span(symbol)
                low = max(self.start, span[0]) if span else self.start
                high = min(self.end, span[1] + TICK) if span else self.end
                if self.start < self.end and low < high:
                    cuts = [low + (high - low) * k / self.slices for k in range(1, self.slices)] if low > LEAST and high < MOST else []
                    out += [Slice(symbol, a, b) for a, b in zip([self.start, *cuts], [*cuts, self.end])]
        return out or [Slice("", LEAST, LEAST)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        symbol, start, end = partition.value
        if start >= end:
            return
        cursor, seen, last = (None if end == MOST else end), set(), None
        while True:
            rows, following = self.feed.page(symbol, cursor)
            for r in sorted(rows, key=lambda r: r[1], reverse=True):
                # a feed may repeat a row at the seam of two pages
                if start <= r[1] < end and (last is None or r[1] < last or r not in seen):
                    if r[1] != last:
                        seen, last = set(), r[1]
                    seen.add(r)
                    yield r
            oldest = min((r[1] for r in rows), default=None)
            if following is None or following == cursor or cursor is not None and following > cursor or following <= start or oldest is not None and oldest < start:
                return
            cursor = following


def paged_source(source_name: str, feed: type[Feed]) -> type[DataSource]:
    """A source over a kind of feed, made from the option `path`. Other options:
    symbols (all), slices (1) of the known range of time."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return BARS

        def reader(self, schema) -> PagedReader:
            return PagedReader(feed(self.options["path"]), self.options)

    return Paged


def register(spark: SparkSession, source_name: str = "paged_bars", feed: type[Feed] = Archive) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged_source(source_name, feed))


def last_bars(spark: SparkSession, path: str, symbol: str, limit: int, source_name: str = "paged_bars") -> DataFrame:
    """The last `limit` bars of a symbol, oldest first."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    found = spark.read.format(source_name).option("path", path).load().where(F.col("symbol") == symbol)
    return found.orderBy(F.desc("ts")).limit(limit).orderBy("ts")

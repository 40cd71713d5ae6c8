"""Python data sources: a seeded mock feed, one partition a symbol, and a polled
stream. Feeds that page are in `pages`, recorded push feeds in `frames`."""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, price_basis string, seq bigint"
TICKS = "symbol string, ts timestamp_ntz, price double, seq bigint"


class Symbol(InputPartition):
    def __init__(self, value: str):
        super().__init__(value)


def walk(symbol: str, n: int, start: datetime, base: float = 100.0) -> Iterator[tuple]:
    """A seeded random walk of daily bars."""
    rng = random.Random(symbol)
    price = base
    for i in range(n):
        open_ = price
        price = round(price * (1 + rng.uniform(-0.022, 0.026)), 2)
        high = round(max(open_, price) * (1 + rng.uniform(0.001, 0.014)), 2)
        low = round(min(open_, price) * (1 - rng.uniform(0.001, 0.014)), 2)
        yield symbol, start + timedelta(days=i), open_, high, low, price, rng.randint(500_000, 15_000_000), "unadjusted", i


class MockBars(DataSource):
    """Options: symbols (comma-separated), count, start (ISO date)."""

    @classmethod
    def name(cls) -> str:
        return "mock_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> "MockBarsReader":
        return MockBarsReader(self.options)


class MockBarsReader(DataSourceReader):
    def __init__(self, options):
        self.symbols = [s.strip().upper() for s in options.get("symbols", "").split(",") if s.strip()]
        self.count = int(options.get("count", "120"))
        self.start = datetime.fromisoformat(options.get("start", "2026-01-01"))
        if not self.symbols or not 1 <= self.count <= 100_000:
            raise ValueError("symbols, and a count of 1 to 100,000")

    def partitions(self):
        return [Symbol(s) for s in self.symbols]

    def read(self, partition):
        yield from walk(partition.value, self.count, self.start)


class PolledTicks(DataSource):
    """Each poll gives one tick a symbol. Options: symbols, polls (of one batch)."""

    @classmethod
    def name(cls) -> str:
        return "polled_ticks"

    def schema(self) -> str:
        return TICKS

    def simpleStreamReader(self, schema):
        return PolledTicksReader(self.options)


class PolledTicksReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.symbols = [s for s in options.get("symbols", "A").split(",") if s]
        self.polls = int(options.get("polls", "1"))

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def rows(self, start: int, end: int) -> list[tuple]:
        at = datetime(2026, 1, 1)
        return [(s, at + timedelta(seconds=2 * i), 100.0 + random.Random(f"{s}{i}").randint(-50, 50) / 10, i) for i in range(start, end) for s in self.symbols]

    def read(self, start: dict):
        end = start["seq"] + self.polls
        return iter(self.rows(start["seq"], end)), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.rows(start["seq"], end["seq"]))


def register(spark: SparkSession) -> None:
    for source in (MockBars, PolledTicks):
        spark.dataSource.register(source)


class Routes:
    """Which source serves a capability: the first that says it does."""

    def __init__(self) -> None:
        self.found: list[tuple[str, frozenset[str], str]] = []

    def add(self, source: str, capabilities: set[str], price_basis: str) -> "Routes":
        self.found.append((source, frozenset(capabilities), price_basis))
        return self

    def source(self, capability: str) -> tuple[str, str]:
        for name, able, basis in self.found:
            if capability in able:
                return name, basis
        raise LookupError(f"no source for {capability}")

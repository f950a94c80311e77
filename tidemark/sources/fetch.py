"""A connector for bars from a remote service, as a Python data source.

The service is a function (symbol, start, end) -> rows of (date, open, high, low, close,
volume); without a network any such function, a file reader or a fake, serves."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import DataConfig
from ..schemas import BARS_RAW
from .universe import INDEXES

Fetch = Callable[[str, str, str], list[tuple]]


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def fetched(fetch: Fetch, symbol: str, cfg: DataConfig, sleep: Callable[[float], None] = time.sleep) -> list[tuple]:
    """Rows of a symbol after at most ``max_retries`` attempts, with doubling delays; none
    if all fail or there is nothing."""
    delay = cfg.retry_delay
    for attempt in range(cfg.max_retries):
        try:
            return fetch(symbol, cfg.start_date, cfg.end_date)
        except Exception:  # noqa: BLE001
            if attempt + 1 < cfg.max_retries:
                sleep(delay)
                delay *= 2
    return []


def fetched_chunks(fetch: Fetch, parts: list[list[tuple[str, str]]], cfg: DataConfig, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Rows of chunks of (name, symbol), one chunk after the other, with ``chunk_delay``
    between two chunks."""
    for i, part in enumerate(parts):
        if i:
            sleep(cfg.chunk_delay)
        for ticker, symbol in part:
            for row in fetched(fetch, symbol, cfg, sleep):
                yield (ticker, *row)


def bar_source(fetch: Fetch, symbols: dict[str, str], cfg: DataConfig = DataConfig(), name: str = "bars", lanes: int = 1) -> type[DataSource]:
    """A data source over ``symbols`` (name in the table -> symbol of the service). Chunks
    are dealt to ``lanes``, a partition each; a lane pauses between its chunks, so the
    service sees at most ``lanes`` requests at a time. A lost task fetches its lane again."""

    class Lane(InputPartition):
        def __init__(self, parts: list[list[tuple[str, str]]]):
            self.parts = parts

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            parts = chunks(sorted(symbols.items()), cfg.chunk_size)
            return [Lane(parts[i::lanes]) for i in range(max(1, min(lanes, len(parts))))]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetched_chunks(fetch, partition.parts, cfg)

    class Bars(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BARS_RAW

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    return Bars


def load(spark: SparkSession, fetch: Fetch, symbols: dict[str, str], cfg: DataConfig = DataConfig(), name: str = "bars", lanes: int = 1) -> DataFrame:
    spark.dataSource.register(bar_source(fetch, symbols, cfg, name, lanes))
    return spark.read.format(name).load()


def load_indexes(spark: SparkSession, fetch: Fetch, cfg: DataConfig = DataConfig(), indexes: dict[str, str] = INDEXES, name: str = "index_bars") -> DataFrame:
    """Bars of the index series by ``index_name``, their plain name, one after the other
    with ``index_delay`` between them."""
    one_by_one = replace(cfg, chunk_size=1, chunk_delay=cfg.index_delay)
    return load(spark, fetch, indexes, one_by_one, name).withColumnRenamed("ticker", "index_name")

"""Sources of daily bars."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidewind.schemas import BARS


def bars_from_trades(trades: DataFrame, day: Column, price: Column, volume: Column, order: Column, symbol: Column | None = None) -> DataFrame:
    """One bar per symbol and day: first, highest, lowest and last price and the summed volume.

    ``order`` is a total order of a day's trades.  One aggregation with map-side
    combination; a hot symbol costs no task more than its days.
    """
    rows = trades.select(day.alias("Date"), price.alias("px"), volume.alias("vol"), order.alias("at"), *([symbol.alias("symbol")] if symbol is not None else []))
    keys = ["symbol", "Date"] if symbol is not None else ["Date"]
    return rows.groupBy(*keys).agg(
        F.min_by("px", "at").alias("Open"),
        F.max("px").alias("High"),
        F.min("px").alias("Low"),
        F.max_by("px", "at").alias("Close"),
        F.sum("vol").alias("Volume"),
    )


def lineitem_bars(spark: SparkSession, sf_dir: str, symbol: str | None = None) -> DataFrame:
    """Bars of the unit prices of lineitem by ship date, of all rows or for each value of a column."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity <> 0")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars_from_trades(rows, F.to_date("l_shipdate"), price, F.col("l_quantity"), order, F.col(symbol).cast("string") if symbol else None)


def provider_bars(spark: SparkSession, path: str, ticker: int, start: str, end: str, auto_adjust: bool = True) -> DataFrame:
    """Bars of one ticker (a supplier) from a provider's table of trades, from ``start`` up to but without ``end`` (ISO dates).

    Adjusted prices are net of the trade's discount.  Ticker and dates reach the scan.
    No rows at all are an error, as an empty answer would be.
    """
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    rows = spark.read.parquet(path).where((F.col("l_suppkey") == ticker) & (F.col("l_shipdate") >= at(start)) & (F.col("l_shipdate") < at(end)) & (F.col("l_quantity") != 0))
    if rows.isEmpty():
        raise ValueError(f"no rows for {ticker} from {start} to {end}")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars_from_trades(rows, F.to_date("l_shipdate"), price * (1 - F.col("l_discount")) if auto_adjust else price, F.col("l_quantity"), order)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files whose header and rows fit the schema; those that don't are an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files with a header; a row that doesn't fit the schema is an error, NaN becomes null."""
    rows = spark.read.schema(BARS).option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
    return nan_to_null(rows)


def write_bars_csv(bars: DataFrame, path: str) -> None:
    bars.write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def nan_to_null(rows: DataFrame) -> DataFrame:
    doubles = {c for c, t in rows.dtypes if t in ("double", "float")}
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in rows.columns])


def flatten_names(names: list[tuple[str, str]]) -> list[str]:
    """Field names of a provider's two-level header (field, ticker)."""
    return [field for field, _ in names]


class SyntheticMarketSource(DataSource):
    """``spark.read.format("tidewind_market")``: an offline stand-in for a remote market-data provider.

    Options: ticker, start, end (ISO dates; end excluded).  A ticker's walk is a
    function of ticker and day, so partitions (years) are read on their own and
    always alike.  An empty range is an error, as an empty answer would be.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewind_market"

    def schema(self) -> str:
        return "Date date, Open double, High double, Low double, Close double, Volume double"

    def reader(self, schema: object) -> DataSourceReader:
        return _MarketReader(self.options)


class _MarketReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        from datetime import date

        self.ticker = options.get("ticker", "TIDE")
        self.start, self.end = (date.fromisoformat(options.get(k, d)) for k, d in (("start", "2020-01-01"), ("end", "2021-01-01")))
        if self.start >= self.end:
            raise ValueError(f"no rows for {self.ticker} from {self.start} to {self.end}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(y) for y in range(self.start.year, self.end.year + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import math
        import zlib
        from datetime import date, timedelta

        day, stop = max(self.start, date(partition.value, 1, 1)), min(self.end, date(partition.value + 1, 1, 1))
        while day < stop:
            if day.weekday() < 5:
                draw = [zlib.crc32(f"{self.ticker}|{day}|{i}".encode()) / 2**32 for i in range(3)]
                base = 100 * math.exp(0.2 * math.sin(day.toordinal() / 90))
                opened, closed = base * (1 + 0.01 * (draw[0] - 0.5)), base * (1 + 0.01 * (draw[1] - 0.5))
                yield day, opened, max(opened, closed) * 1.002, min(opened, closed) * 0.998, closed, float(1_000_000 * (1 + draw[2]) // 1)
            day += timedelta(days=1)

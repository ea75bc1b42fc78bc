"""Tables by path, and the documentation's data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The documentation's 24 sales.
_STORE = ("Boston", "New York", None, "San Francisco", "Seattle", "Seattle")
_REGION = ("East", "East", "East", "West", "West", "West")
_PRODUCT = ("Laptop", "Monitor", "Headphones")
_CHANNEL = (
    "Store", "Store", "Online", "Store", "Online", "Store",
    "Online", "Store", "Online", "Store", "Store", "Online",
    "Store", "Online", "Online", "Store", "Online", "Store",
    "Online", "Store", "Online", "Online", "Store", "Online",
)
_UNITS = (3, 8, 15, 4, 6, 11, 4, 7, 18, 5, 9, 13, 5, 10, 22, 6, 11, 16, 7, 12, 25, 8, 14, 19)
_REVENUE = (3600, 2400, 1500, 4800, 1800, 1100, 4800, 2100, 1800, 6000, 2700, 1300, 6000, 3000, 2200, 7200, 3300, 1600, 8400, 3600, 2500, 9600, 4200, 1900)


def retail_sales(spark: SparkSession) -> DataFrame:
    """24 sales: year, month, region, store (null: online-direct), product, channel, units, revenue."""
    rows = [
        (2025 + k // 12, ("Jan", "Feb")[k // 6 % 2], _REGION[k % 6], _STORE[k % 6], _PRODUCT[k % 3], _CHANNEL[k], _UNITS[k], float(_REVENUE[k]))
        for k in range(24)
    ]
    return spark.createDataFrame(rows, "year int, month string, region string, store string, product string, channel string, units int, revenue double")

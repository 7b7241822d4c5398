"""The registered queries and their SQL, and ways to register them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.sources import bookings, raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BOTH_DATES = {"booking": "booking_date", "arrival": "arrival_date"}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_bookings(name: str, sql: str | None, job: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: job(bookings.from_orders(spark, sf_dir)))


def on_lines(name: str, sql: str | None, job: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: job(raw.json_lines(spark, sf_dir)))


def on_history(name: str, sql: str | None, job: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: job(raw.history(spark, sf_dir)))


def with_calendar(name: str, sql: str | None, job: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: job(bookings.from_orders(spark, sf_dir), bookings.calendar(spark)))

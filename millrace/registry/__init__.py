"""Registered queries over the supplied tables, each with its SQL oracle where one exists."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from millrace.registry.book import Book, book

_MODULES = ("modelling", "checks", "runs", "graphs", "landing", "shelves", "streams")


def all_queries() -> Book:
    for name in _MODULES:
        importlib.import_module(f"millrace.registry.{name}")
    return book


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return all_queries().queries["analyze_segments"](spark, sf)

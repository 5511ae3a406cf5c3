"""Per-query context: the staging set and the two stars of one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import SparkSession

from tessera.operators.star import Star
from tessera.sources.bindings import Staging


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.stg = Staging(spark, sf_dir)

    @cached_property
    def a(self) -> Star:
        return Star(self.stg, "a")

    @cached_property
    def b(self) -> Star:
        return Star(self.stg, "b")

    def star(self, rules: str) -> Star:
        return self.a if rules == "a" else self.b

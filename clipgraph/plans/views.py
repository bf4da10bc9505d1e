"""Adapters that give the benchmark tables the shapes of the data model.

Each view is one SQL text. Names in braces are the tables and views it reads. Where array
and lambda syntax differ between Spark and the checking engine, both texts are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipgraph.plans.fixture_sql import BOTH, DUCK_ONLY, SPARK_ONLY

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

SPARK = {**BOTH, **SPARK_ONLY}
DUCK = {**BOTH, **DUCK_ONLY}


def plain(text: str) -> str:
    """Resolve the braces to bare names."""
    return text.format(**{n: n for n in (*TABLES, *SPARK)})


class Views:
    """Lazy access to the tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = SPARK[name]
        deps = {d: self[d] for d in (*TABLES, *SPARK) if "{" + d + "}" in text}
        return self.spark.sql(text, **deps)

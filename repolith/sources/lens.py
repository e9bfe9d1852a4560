"""Driver tables seen as repository snapshots: the same SQL text runs in Spark and in the oracle engine."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "events", "labels")


def _texts() -> dict[str, str]:
    found = (Path(__file__).parent / "lens.sql").read_text()
    return {m[1]: m[2].strip() for m in re.finditer(r"-- (lens_\w+)\n(.*?)(?=\n-- lens_|\Z)", found, re.S)}


LENSES = _texts()


def with_lenses(*names: str) -> str:
    """The opening of an oracle query: WITH lens_a AS (...), ..."""
    return "WITH " + ",\n".join(f"lens_{n} AS (\n{LENSES[f'lens_{n}']}\n)" for n in names)


class Lens:
    """Snapshot tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lens(self, name: str) -> DataFrame:
        text = LENSES[f"lens_{name}"]
        for t in TABLES:
            if re.search(rf"\bFROM {t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        found = self.spark.sql(text)
        if name != "files":
            return found
        # Its paths and contents are long expressions: a generator of one row keeps them from being written into every
        # later condition.
        return found.select(F.inline(F.array(F.struct(*found.columns))))

    def __getattr__(self, name: str) -> DataFrame:
        if f"lens_{name}" not in LENSES:
            raise AttributeError(name)
        return self.lens(name)

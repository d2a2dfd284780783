"""A named query: a Spark plan, its output columns, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Build = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, "Query"] = {}

TYPES = {"s": ("string", "VARCHAR"), "i": ("bigint", "BIGINT"), "b": ("boolean", "BOOLEAN")}


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def spark_frame(self, spark: SparkSession, folder: str) -> DataFrame:
        """The plan with the declared column types; doubles are rounded for comparison."""
        out = []
        for name, kind in self.columns:
            c = F.col(name)
            if kind[0] == "f":
                out.append((F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name))
            else:
                out.append(c.cast(TYPES[kind][0]).alias(name))
        return self.build(spark, folder).select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind[0] == "f":
                out.append(f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0.0 AS {name}")
            else:
                out.append(f"CAST({name} AS {TYPES[kind][1]}) AS {name}")
        return f"SELECT {', '.join(out)} FROM ({self.sql.strip()}) AS result"


def query(columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a plan under its function name.

    ``columns`` reads ``name:kind ...`` with kinds s, i, b and f<digits>.
    """
    parsed = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build: Build) -> Build:
        REGISTRY[build.__name__] = Query(build.__name__, build, parsed, sql)
        return build

    return register


def drain(stream: DataFrame, folder: str, mode: str) -> None:
    """Run a stream over everything that is there, writing each result table to ``folder``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        target = folder if mode == "complete" else f"{folder}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}-progress")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

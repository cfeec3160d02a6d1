"""Records kept as Parquet, by collection, and the digest that says whether two stores hold the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refusal


def save(rows: DataFrame, path: str) -> None:
    """Writes (collection, key, data) rows so that reading one collection reads its files alone. A key is once in a collection."""
    twice = rows.groupBy("collection", "key").count().where("count > 1").take(1)
    if twice:
        raise Refusal("key", f"{twice[0]['key']} is twice in {twice[0]['collection']}")
    rows.select("collection", "key", "data").write.partitionBy("collection").mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """The rows of save(), of one collection if it is named."""
    rows = spark.read.schema("key string, data string, collection string").parquet(path)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def digest(rows: DataFrame) -> DataFrame:
    """collection, rows, digest: the same for the same records in whatever order and parts they lie.

    The digest adds up the first 60 bits of each record's md5, of its key and text with a line's end between them; a null text
    is the empty one.
    """
    own = F.md5(F.concat("key", F.lit("\n"), F.coalesce("data", F.lit(""))).cast("binary"))
    bits = F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).cast("string").alias("digest"))


def verify(rows: DataFrame, expected: dict[str, tuple[int, str]]) -> None:
    """Refused where a collection's number of rows or digest isn't the expected one; collections that aren't expected too."""
    found = {r["collection"]: (r["rows"], r["digest"]) for r in digest(rows).collect()}
    for name in sorted(found.keys() | expected.keys()):
        if found.get(name) != expected.get(name):
            raise Refusal("digest", f"{name} holds other records than expected")

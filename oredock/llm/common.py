"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all contracts, and ASCII lower-casing.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()
WHITE_CLASS = r"[\x20\x09-\x0D]"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may go without one: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.conf.get("oredock.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("oredock.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of few narrow columns, marked for a broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def fold(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame, dict[str, Column]], DataFrame]]:
    """docs as the columns `own` (null where docs lacks one) and `row`, which holds all others: no name of theirs clashes.

    The second value turns such rows back into the columns of docs, followed by those of `new`, which
    replace columns of the same name; a name of `own` in `new` takes the place it had.
    """
    names = docs.columns
    at = {c: next((f"c{i}" for i, n in enumerate(names) if n.lower() == c), None) for c in own}
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rest = [f"c{i}" for i in range(len(names)) if f"c{i}" not in at.values()]
    folded = numbered.select(*[(F.col(at[c]) if at[c] else F.lit(None).cast("long" if c == "doc_id" else "string")).alias(c) for c in own], F.struct(F.lit(0).alias("_"), *rest).alias("row"))

    def unfold(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
        replaced = {k.lower() for k in new}
        out: list[Column] = []
        for i, n in enumerate(names):
            if f"c{i}" in at.values():
                out.append(new.get(n.lower(), F.col(n.lower())).alias(n))
            elif n.lower() not in replaced:
                out.append(F.col(f"row.c{i}").alias(n))
        return rows.select(*out, *[c.alias(k) for k, c in new.items() if k not in own])

    return folded, unfold


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder

"""Shared helpers: shared-folder tables, folds, and byte-level word splitting.

All text work in Python runs on UTF-8 bytes (``text`` is cast to binary before it crosses Arrow): ``bytes.split()``
splits on exactly ``\\x20\\x09-\\x0D`` and ``bytes.translate`` lower-cases A-Z without touching other characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import ensure_importable, shared_folder

#: Words of the contracts, as a regular expression for the JVM.
SPACE = r"[\x20\x09-\x0D]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns every ASCII character that is neither letter nor digit into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
CHUNK = 256
#: So many rows of keys are broadcast at most (counted first); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: So many keys count as frequent at most, and so many rows a frequent key has at least.
FREQUENT_KEYS, FREQUENT_ROWS = 10_000, 100
#: Columns that tell a row: its id and two independent hashes of its text, 96 bits together.
ROW = ["row_id", "row_hash", "row_check"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Cuts lineage: writes ``df`` as a Parquet table in the shared folder and reads it back.

    The table survives the loss of any executor. Spark commits it only when every task has succeeded.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/logloom-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(modulus: int, column: str = "doc_id"):
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = CHUNK) -> Iterator[tuple[list, ...]]:
    """Python lists of at most ``size`` rows, so that one batch of long texts is never held twice as a whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield tuple(part.column(c).to_pylist() for c in columns)


def per_row(fn: Callable[..., tuple], columns: tuple[str, ...], schema: pa.Schema):
    """A mapInArrow function that calls ``fn`` on the values of ``columns`` of each row; ``fn`` returns one output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in slices(batches, columns):
            rows = [fn(*row) for row in zip(*lists, strict=True)]
            yield rows_to_batch(rows, schema)

    return run


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def id_and_bytes(docs: DataFrame, *more) -> DataFrame:
    """Only what the scan needs: doc_id and the text as UTF-8 bytes (null: empty)."""
    ensure_importable(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def hot_threshold(counts: DataFrame, most: int) -> int:
    """The smallest count at which no more than ``most`` words remain, from the (short) histogram of counts."""
    left = 0
    least = 1 << 62
    for n, words in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        left += words
        if left > most:
            break
        least = n
    return least


def row_columns():
    """The columns of ``ROW`` for a table of documents. Rows that agree in them are the same document with the same text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").alias("row_id"), F.xxhash64(text).alias("row_hash"), F.hash(text, F.length(text)).alias("row_check")]


def keyed(docs: DataFrame) -> DataFrame:
    """``ROW``, and the whole row as one column ``whole``, so that no column of the documents can clash."""
    return docs.select(*row_columns(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


def same_row(a: DataFrame, b: DataFrame):
    """Whether rows of ``a`` and ``b`` agree in ``ROW``; null ids are equal."""
    return (a["row_hash"] == b["row_hash"]) & (a["row_check"] == b["row_check"]) & a["row_id"].eqNullSafe(b["row_id"])


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and in ``n`` the number of rows that ``left`` has of it.

    A frequent key's rows stay where they are: no more than ``FREQUENT_KEYS`` keys can hold a ten-thousandth of the rows each, so
    theirs are broadcast. The other keys are shuffled, none with more rows than that. Both sides are read twice (written tables).
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_ROWS, total // FREQUENT_KEYS + 1)
    frequent = F.broadcast(right.where(F.col("n") >= least).drop("n"))
    rare = left.join(F.broadcast(right.where(F.col("n") >= least).select(key)), key, "left_anti").join(right.where(F.col("n") < least).drop("n"), key)
    return left.join(frequent, key).unionByName(rare)

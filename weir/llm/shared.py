"""What the operators share: input tables, and a folder that driver and executors all see."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weir.sources.kept import shared_top

#: Between words: white space of ASCII.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_top(spark)}/weir-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd", schema: str | None = None) -> DataFrame:
    """df as a table in the shared folder, so that nothing before it is computed again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc32_of(column: str) -> Column:
    """crc32 of a column as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes each, one text at least; no text is null."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


def byte_letters() -> dict[int, str]:
    """The printable character that stands for a byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def with_result(docs: DataFrame, text: Column, names: list[str], run: Callable[[pa.Array], pa.Array], into: str, kind: str) -> DataFrame:
    """Columns `names` of docs with the column that run makes of a batch of texts.

    Columns go through Python under numbers, as Spark takes a dot in the name of a column there for a path.
    """
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], text.alias("text"))
    schema = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(chosen.schema.fields[:-1])]).add("made", StructType.fromDDL(kind))
    own = schema.fieldNames()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], run(b.column(b.num_columns - 1))], names=own)

    return chosen.mapInArrow(each, schema).toDF(*names, into)


#: Rows of a table that is broadcast; and a key of more than one row in HOT is joined apart from the others.
BROADCAST_ROWS, HOT = 200_000, 1_000


def joined_evenly(left: DataFrame, right: DataFrame, keys: dict[str, Column], weight: str, how: str = "inner") -> DataFrame:
    """left with the row of right that has its keys: keys maps right's columns, not null, to expressions over left.

    right is a small row for each key and says in `weight` how many rows of left have it. Up to BROADCAST_ROWS
    rows it is broadcast. Beyond, only the keys that more than one row in HOT has are: fewer than HOT. All other
    rows are shuffled, and no key holds a task up.
    """
    match = lambda r: reduce(Column.__and__, [r[k] == v for k, v in keys.items()])
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), match(right), how).drop(weight)
    rows = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(weight) > rows // HOT))
    cool = right.where(F.col(weight) <= rows // HOT)
    rest = left.join(hot, match(hot), "left_anti").join(cool, match(cool), how)
    return left.join(hot, match(hot)).unionByName(rest).drop(weight)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name

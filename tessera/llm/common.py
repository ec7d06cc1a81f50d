"""What the text operators share: word rules, Arrow batches, checked broadcasts, let-bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

ROWS = 1_024  # of an Arrow batch that are Python objects at a time
BROADCAST_ROWS = 100_000  # rows of a few dozen bytes: some MB at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, close to ``names`` (case does not matter)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count; a larger table is left to a shuffled join with AQE's skew splits."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def per_batch(df: DataFrame, column: str, fields: list[T.StructField], worker: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """Columns ``fields`` computed from ``column``, one Arrow batch at a time, beside the columns ``keep``.

    ``worker()`` is called once per task and gives a function from the list of values to one list per field.
    A column of ``keep`` that bears the name of a field is replaced.
    """
    made = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    names = [*keep, *[f.name for f in fields]]
    schema = T.StructType([*df.select(*keep).schema.fields, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                made = work(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], *[pa.array(v, type=t) for v, t in zip(made, types, strict=True)]], names
                )

    (given,) = fresh(df, "_given")
    return df.select(*keep, F.col(column).alias(given)).mapInArrow(run, schema)

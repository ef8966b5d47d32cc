"""Rows from files: a reader of one text, applied to Arrow batches of files, some files at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 200  # files read before their rows are handed on
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def rows_of(files: DataFrame, keys: list[str], inputs: list[str], read: Callable[..., Iterable[tuple]], schema: str, place: str | None = None) -> DataFrame:
    """The keys of each file with the rows (of ``schema``) that ``read`` makes of its inputs; nothing is shuffled.

    Null inputs are empty texts.  ``place`` names a column for the number of a row within its file.
    """
    rows = files.select(*keys, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    columns = [x.split() for x in schema.split(", ")]
    names = [*keys, *([place] if place else []), *[n for n, _ in columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                texts = [some.column(f"_in{i}").to_pylist() for i in range(len(inputs))]
                made = [list(read(*[t or "" for t in one])) for one in zip(*texts)]
                owner = pa.array([i for i, m in enumerate(made) for _ in m], pa.int32())
                flat = [r for m in made for r in m]
                data = [some.column(i).take(owner) for i in range(len(keys))]
                data += [pa.array([k for m in made for k in range(len(m))], pa.int32())] if place else []
                data += [pa.array([r[i] for r in flat], KINDS[k]) for i, (_, k) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(data, names)

    head = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]] + ([f"{place} int"] if place else [])
    return rows.mapInArrow(run, ", ".join([*head, schema]))

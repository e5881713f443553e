"""Arrow functions that add columns to whole rows.

A row's own columns travel as one struct, so none of them can clash with what
is added, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans

ROW = "__row"


def names_of(new: str) -> list[str]:
    return [x.split()[0] for x in new.split(", ")]


def packed(docs: DataFrame) -> DataFrame:
    """ROW alone: each row as one struct."""
    return docs.select(F.struct("*").alias(ROW))


def mapped(whole: DataFrame, needed: list[str], beside: list[str], new: str, f: Callable[..., list[pa.Array]], most: int | None = None) -> DataFrame:
    """ROW of `whole` and the columns `new` (a schema string): f gets the arrays of the row's `needed` columns and of those `beside` ROW.

    With `most`, f is called for stretches of rows of about so many bytes of
    the first needed column, which is a text.
    """
    names = names_of(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            first = row.field(needed[0])
            for a, b in spans.chunks(first, most) if most else [(0, batch.num_rows)]:
                own = row.slice(a, b - a)
                given = [own.field(c) for c in needed] + [batch[c].slice(a, b - a) for c in beside]
                cols = [pa.array(x) if not isinstance(x, pa.Array) else x for x in f(*given)]
                yield pa.RecordBatch.from_arrays([own, *cols], [ROW, *names])

    whole = whole.select(ROW, *beside)
    return whole.mapInArrow(run, f"{ROW} {whole.schema[ROW].dataType.simpleString()}, {new}")


def added(docs: DataFrame, needed: list[str], new: str, f: Callable[..., list[pa.Array]], most: int | None = None) -> DataFrame:
    """mapped() for rows that have nothing beside them."""
    return mapped(packed(docs), needed, [], new, f, most)


def spread(df: DataFrame, columns: list[str], new: list[str]) -> DataFrame:
    """The row's columns and the new ones; a new one takes the place of the row's of that name."""
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns if c not in new], *new)


def own(df: DataFrame, columns: list[str]) -> DataFrame:
    """The row's columns as they were."""
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns])

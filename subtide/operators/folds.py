"""Ordered folds over keys: one shuffle, then a stream of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

OUT_ROWS = 4096


def runs(column: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values, nulls too, of a sorted column."""
    n = len(column)
    if not n:
        return []
    a, b = column[1:], column[:-1]
    null = pc.xor(pc.is_null(a), pc.is_null(b))
    change = pc.or_(null, pc.fill_null(pc.not_equal(a, b), False))
    starts = [0, *[k + 1 for k in pc.indices_nonzero(change).to_pylist()]]
    return list(zip(starts, [*starts[1:], n], strict=True))


def _arrow(schema: str) -> pa.Schema:
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def _sorted(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order)


def fold(rows: DataFrame, key: str, order: list[str], step: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """step(rows of one key in order) gives the other columns of schema, whose first is the key; a key is in memory alone."""
    arrow = _arrow(schema)

    def result(at, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        made = step(pa.Table.from_batches(held))
        columns = [pa.array(made[f.name], f.type) for f in list(arrow)[1:]]
        return pa.RecordBatch.from_arrays([pa.array([at] * len(columns[0]), arrow[0].type), *columns], schema=arrow)

    def run(batches):
        at, held, done = None, [], []
        for batch in batches:
            for a, z in runs(batch.column(key)):
                now = batch.column(key)[a].as_py()
                if held and now != at:
                    done.append(result(at, held))
                    held = []
                    if sum(b.num_rows for b in done) >= OUT_ROWS:
                        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                        done = []
                at = now
                held.append(batch.slice(a, z - a))
        if held:
            done.append(result(at, held))
        yield from pa.Table.from_batches(done, arrow).combine_chunks().to_batches()

    return _sorted(rows, key, order).mapInArrow(run, arrow_schema(schema))


def scan(rows: DataFrame, key: str, order: list[str], start: Callable[[], Callable[[dict], list]], to: str, kind: str) -> DataFrame:
    """rows with one more column, worked out in order: start() makes a key's state, which maps each slice of its rows to values.

    Nothing but the state is held of a key, however many rows it has.
    """
    out = rows.schema.add(to, kind)
    arrow = to_arrow_schema(out)

    def run(batches):
        at, state = None, None
        for batch in batches:
            made: list = []
            for a, z in runs(batch.column(key)):
                now = batch.column(key)[a].as_py()
                if state is None or now != at:
                    at, state = now, start()
                made += state(batch.slice(a, z - a))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow.field(to).type)], schema=arrow)

    return _sorted(rows, key, order).mapInArrow(run, out)


def arrow_schema(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def rows_of(table: pa.Table, *names: str) -> Iterator[tuple]:
    """Rows as tuples of some columns."""
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)

"""Grouped maps for many small groups: a task's groups are met in order, whole, some in each call of a kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seatrace.shipping import ship_package


def _begins(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; nulls equal each other."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        a, b = batch[k].slice(1), batch[k].slice(0, batch.num_rows - 1)
        off = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= off.to_numpy(zero_copy_only=False)
    return new


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Callable[[pa.Table, np.ndarray], dict | Iterator[dict]], schema: str, *, deal: tuple[int, Column] | tuple[()] | None = None) -> DataFrame:
    """kernel(rows, bounds) for whole groups by keys, rows in the given order; bounds: where groups begin, and the end.

    The kernel returns a column (array or list) for each field of the schema, or an iterator of such. A group that goes on
    in the next batch is held back until it is whole, so memory follows the largest group, and a small group costs no call
    of its own. deal: number of tasks and that of a row's task, if keys aren't dealt by their hash; empty if groups are
    together as they are, after a window over some of the keys.
    """
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    ship_package(df.sparkSession)

    def run(batches):
        def made(rows, begins):
            found = kernel(rows.combine_chunks(), np.append(begins, rows.num_rows))
            for got in [found] if isinstance(found, dict) else found:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], (pa.Array, pa.ChunkedArray)) else _flat(got[f.name]).cast(f.type) for f in arrow], schema=arrow)

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = held[-1] if held else None
            both = pa.Table.from_batches([batch] if last is None else [last.slice(last.num_rows - 1), batch])
            begins = np.flatnonzero(_begins(both, keys))
            cut = int(begins[-1]) - (0 if last is None else 1)  # the last group of the batch may go on
            if begins[-1] == 0:
                held.append(batch)
                continue
            if held or cut:
                rows = pa.Table.from_batches([*held, batch.slice(0, cut)])
                yield from made(rows, np.flatnonzero(_begins(rows, keys)))
            held = [batch.slice(cut)]
        if held:
            rows = pa.Table.from_batches(held)
            yield from made(rows, np.flatnonzero(_begins(rows, keys)))

    dealt = df.repartition(*keys) if deal is None else df.repartitionById(*deal) if deal else df
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, fields)


def _flat(a):
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def floats(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as numpy arrays of doubles, nan for null."""
    return [rows[n].cast(pa.float64()).to_numpy() for n in names]

"""Attention over touching boxes, added up in grid cells by matrix products.

Rows of one cell lie together, so who touches whom, the weights and their sums are arrays of one cell, and a row leaves for each
target, not for each pair.  A sum is (level, total, sums): the largest weight's exponent, and the weights and weighted values divided by
its exponential.  Two sums of a target add up in any order, first where they lie, so a target in many cells is few rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Weights worked out at once, and rows that are given out together.
AT_ONCE, TOGETHER = 500_000, 8_192


def matrix(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def arrays(values: np.ndarray) -> pa.ListArray:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), flat)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin."""
    frame = table.select(keys).to_pandas()
    return np.flatnonzero((frame != frame.shift()).any(axis=1).to_numpy())


def _whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that part no run of equal keys, with the beginnings of runs."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if table.num_rows:
            starts = _starts(table, keys)
            if starts[-1]:
                yield table.slice(0, starts[-1]), starts[:-1]
            table = table.slice(starts[-1])
        rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, int)


def leaky(x: np.ndarray, slope: float) -> np.ndarray:
    return np.where(x > 0, x, slope * x)


def scores(keys: list[str], source: np.ndarray, target: np.ndarray, weight: np.ndarray | None):
    """Rows (keys, x) with both scores of each head, and what they pass on: ``x``, or its product."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b, "x")
                carried = x if weight is None else x @ weight.T
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], arrays(carried), arrays(x @ source.T), arrays(x @ target.T)], [*keys, "carried", "s", "t"])

    return run


def _touched(box: np.ndarray, at: np.ndarray, target: np.ndarray, source: np.ndarray, n: np.ndarray, s: np.ndarray, t: np.ndarray, carried: list[np.ndarray], slope: float):
    """(targets, sums) of one cell, for those who hear anyone in it.  ``box``: x0, y0, x1, y1, tol, cell; ``at``: the cell's numbers."""
    sx0, sy0, sx1, sy1, tol, size = box[source].T
    step = max(1, AT_ONCE // max(1, len(source)))
    for low in range(0, len(target), step):
        here = target[low : low + step]
        x0, y0, x1, y1 = (c[:, None] for c in box[here, :4].T)
        touch = (x0 <= sx1 + tol) & (x1 >= sx0 - tol) & (y0 <= sy1 + tol) & (y1 >= sy0 - tol)
        # Boxes that share several cells count in the first of them, where the later of their lower corners lies.
        for lower, c in ((np.maximum(sx0, x0), at[0]), (np.maximum(sy0, y0), at[1])):
            touch &= np.floor((lower - tol) / size) == c
        some = touch.any(1)
        here, touch = here[some], touch[some]
        levels, totals, sums = [], [], []
        for h, passed in enumerate(carried):
            w = np.where(touch, leaky(s[source, h] + t[here, h][:, None], slope), -np.inf)
            levels.append(w.max(1, keepdims=True, initial=-np.inf))
            w = np.exp(w - levels[-1]) * n[source]
            totals.append(w.sum(1, keepdims=True))
            sums.append(w @ passed[source])
        yield here, np.concatenate([*levels, *totals, *sums], 1)


def _summed(names: pa.Table, sums: np.ndarray, heads: int) -> tuple[pa.Table, np.ndarray]:
    """One row for each run of equal ``names`` of sorted rows."""
    starts = _starts(names, names.column_names)
    level, total, rest = sums[:, :heads], sums[:, heads : 2 * heads], sums[:, 2 * heads :]
    most = np.maximum.reduceat(level, starts)
    share = np.exp(level - np.repeat(most, np.diff(np.append(starts, len(sums))), axis=0))
    weighted = (rest.reshape(len(sums), heads, -1) * share[:, :, None]).reshape(rest.shape)
    return names.take(pa.array(starts)), np.concatenate([most, np.add.reduceat(total * share, starts), np.add.reduceat(weighted, starts)], 1)


def cell_sums(keys: list[str], cell: list[str], heads: int, out: int | None, slope: float):
    """Rows of cells, sorted by ``cell``, to (keys, entity_id, sums).  ``out``: numbers that each head has of its own in ``carried``."""
    names = [*keys, "entity_id"]

    def together(found: list[tuple[pa.Table, np.ndarray]]) -> pa.RecordBatch:
        rows, sums = pa.concat_tables([x for x, _ in found]), np.concatenate([x for _, x in found])
        order = pa.compute.sort_indices(rows, [(c, "ascending") for c in names])
        rows, sums = _summed(rows.take(order), sums[order.to_numpy()], heads)
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rows.columns], arrays(sums)], [*names, "sums"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for table, starts in _whole(batches, cell):
            number = lambda c: table.column(c).to_numpy().astype(float)
            box = np.stack([number(c) for c in ("x0", "y0", "x1", "y1", "tol", "cell")], 1)
            at, n, part = np.stack([number("_cx"), number("_cy")], 1), number("n"), number("_part")
            s, t, carried = matrix(table, "s"), matrix(table, "t"), matrix(table, "carried")
            of = [carried[:, h * out : (h + 1) * out] if out else carried for h in range(heads)]
            every = table.select(names)
            for low, high in zip(starts, [*starts[1:], table.num_rows]):
                rows = np.arange(low, high)
                for here, sums in _touched(box, at[low], rows[part[rows] != 2], rows[part[rows] != 1], n, s, t, of, slope):
                    if len(here):
                        found.append((every.take(pa.array(here)), sums))
                        size += len(here)
                if size >= TOGETHER:
                    yield together(found)
                    found, size = [], 0
        if found:
            yield together(found)

    return run


def finished(keys: list[str], heads: int, weight: np.ndarray | None, bias: np.ndarray):
    """Sums, sorted by name, to (keys, entity_id, x): the mean of what each head hears, times its ``weight`` if it heard inputs."""
    names = [*keys, "entity_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _whole(batches, names):
            rows, sums = _summed(table.select(names), matrix(table, "sums"), heads)
            mean = sums[:, 2 * heads :].reshape(len(sums), heads, -1) / sums[:, heads : 2 * heads, None]
            mean = mean if weight is None else np.einsum("nhi,hoi->nho", mean, weight)
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rows.columns], arrays(mean.reshape(len(sums), -1) + bias)], [*names, "x"])

    return run

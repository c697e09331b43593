"""Numpy helpers for tasks that hold slices: whole groups of sorted batches, packed cells, planes of many slices at once, lower envelopes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Grid points of planes that are held at once, unless one slice has more.
PLANE_POINTS = 4_000_000
#: Columns up to this length are shifted, not enveloped.
SHORT_COLUMN = 96


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the row before it in ``keys``."""
    out = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for key in keys:
        column = table.column(key)
        if column.null_count or not pa.types.is_primitive(column.type):  # nulls are alike
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            column = column.dictionary_encode("encode").indices
        values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
        out |= values[1:] != values[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables in which every group of equal ``keys`` is whole, from batches in which groups are runs; one open group is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(changes(batch, keys))
        cut = int(edges[-1]) + 1 if len(edges) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    return np.flatnonzero(np.r_[True, changes(table, keys)])


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a group: the group's numbers, whose ``counts`` follow each other in ``values``."""
    offsets = np.r_[0, np.cumsum(counts)] * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column and how many each row has; null has none."""
    parts, counts = [], []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data and len(chunk) and offsets[-1] > offsets[0] else np.empty(0, dtype))
        counts.append(np.diff(offsets) // np.dtype(dtype).itemsize)
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.empty(0, dtype), np.empty(0, np.int64))


def coded(columns: list[np.ndarray], starts: np.ndarray) -> pa.Array:
    """One binary value a group: whole numbers of several columns of rows whose groups begin at ``starts``, column by column as steps, seven bits a byte."""
    n = len(columns[0])
    rows = np.diff(np.r_[starts, n])
    inside = np.arange(n) - np.repeat(starts, rows)
    values = np.empty(n * len(columns), np.int64)
    for k, column in enumerate(columns):
        step = np.diff(column, prepend=0)
        step[starts] = column[starts]
        values[np.repeat(starts * len(columns) + k * rows, rows) + inside] = (step << 1) ^ (step >> 63)
    values = values.view(np.uint64)
    size = np.ones(len(values), np.int64)
    top = int(values.max()) if len(values) else 0
    for bits in range(7, max(top.bit_length(), 1), 7):
        size += values >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[(ends - size + k)[has]] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return packed(out, np.add.reduceat(size, starts * len(columns)) if len(starts) else np.empty(0, np.int64))


def decoded(column: pa.ChunkedArray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of each value of a :func:`coded` column, and the numbers of its columns; null has none."""
    data, sizes = unpacked(column, np.uint8)
    last = data < 128
    ends = np.flatnonzero(last) + 1
    begins = np.r_[0, ends[:-1]]
    size = ends - begins
    values = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        values[has] |= (data[begins[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    steps = (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)
    rows = np.diff(np.searchsorted(ends, np.r_[0, np.cumsum(sizes)], side="right")) // columns
    starts = np.r_[0, np.cumsum(rows)]
    n = int(starts[-1])
    inside = np.arange(n) - np.repeat(starts[:-1], rows)
    out = []
    for k in range(columns):
        step = steps[np.repeat(starts[:-1] * columns + k * rows, rows) + inside]
        total = np.cumsum(step)
        before = np.r_[0, total][starts[:-1]]
        out.append(total - np.repeat(before, rows))
    return rows, out


def shares(sizes: np.ndarray, most: int = PLANE_POINTS) -> Iterator[tuple[int, int]]:
    """Ranges of planes with ``most`` points together, or one plane."""
    start = 0
    while start < len(sizes):
        total = np.cumsum(sizes[start:])
        stop = start + max(1, int(np.searchsorted(total, most, side="right")))
        yield start, stop
        start = stop


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` whole numbers from each of ``starts`` on, behind each other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Bricks:
    """Points of groups in nested bricks of 4, 16, 64.. points a side: ``order`` sorts the points, ``starts`` has where the bricks of each level begin, points first."""

    def __init__(self, group: np.ndarray, zyx: list[np.ndarray], levels: int, scale: list[np.ndarray]):
        code = np.zeros(len(group), np.int64)
        for level in range(levels):
            for axis, c in enumerate(zyx):
                code |= ((c >> (2 * level)) & 3) << (6 * level + 2 * axis)
        self.order = np.lexsort((code, group))
        code, self.group = code[self.order], group[self.order]
        moved = np.diff(self.group) != 0
        self.starts = [np.flatnonzero(np.r_[True, moved | (np.diff(code >> (6 * level)) != 0)]) if level else np.arange(len(code)) for level in range(levels + 1)]
        self.points = [c[self.order] for c in zyx]
        points = [c * s[self.group] for c, s in zip(self.points, scale)]
        self.low = [[np.minimum.reduceat(c, at) for c in points] if k else points for k, at in enumerate(self.starts)]
        self.high = [[np.maximum.reduceat(c, at) for c in points] if k else points for k, at in enumerate(self.starts)]
        #: Where the children of each brick begin among those of the level below.
        self.child = [None] + [np.searchsorted(self.starts[k - 1], np.r_[self.starts[k], len(code)]) for k in range(1, levels + 1)]


def nearest_points(group: np.ndarray, zyx: list[np.ndarray], to_group: np.ndarray, to_zyx: list[np.ndarray], scale: list[np.ndarray], most: int = PLANE_POINTS // 4) -> np.ndarray:
    """Squared distance of each point to the nearest one of its group among the others, ``scale`` by group; every group has points on both sides.

    Bricks meet from coarse to fine. A pair is left out when it is farther at least than another is at most, so the points that meet in the end are few; ``most`` pairs
    are held at once on a level, unless one brick has more.
    """
    low = [min(int(a.min()), int(b.min())) for a, b in zip(zyx, to_zyx)]
    zyx, to_zyx = ([c.astype(np.int64) - n for c, n in zip(cs, low)] for cs in (zyx, to_zyx))
    levels = max(1, -(-max(int(c.max()) for c in (*zyx, *to_zyx)).bit_length() // 2))
    own, to = Bricks(group, zyx, levels, scale), Bricks(to_group, to_zyx, levels, scale)
    out = np.empty(len(group))

    def descend(level: int, bricks: np.ndarray, met: np.ndarray, ends: np.ndarray) -> None:
        """``bricks`` of a level and, from ``ends`` to ``ends``, the others that each may be nearest to."""
        children = np.diff(own.child[level])[bricks]
        parent = np.repeat(np.arange(len(bricks)), children)
        child = spread(own.child[level][bricks], children)
        width = np.diff(to.child[level])
        weight = np.add.reduceat(width[met], ends[:-1])[parent]
        for first, last in shares(weight, most):
            asks, of = child[first:last], parent[first:last]
            pairs = met[spread(ends[of], np.diff(ends)[of])]
            others = spread(to.child[level][pairs], width[pairs])
            n = weight[first:last]
            at = np.r_[0, np.cumsum(n)]
            row = np.repeat(asks, n)
            least = np.zeros(len(row))
            if level == 1:
                for a, b, s in zip(own.points, to.points, scale):
                    least += ((a[row] - b[others]) * np.repeat(s[own.group[asks]], n)) ** 2
                out[own.order[asks]] = np.minimum.reduceat(least, at[:-1])
                continue
            widest = np.zeros(len(row))
            for a0, a1, b0, b1 in zip(own.low[level - 1], own.high[level - 1], to.low[level - 1], to.high[level - 1]):
                ahead, behind = b0[others] - a1[row], a0[row] - b1[others]
                least += np.maximum(np.maximum(ahead, behind), 0.0) ** 2
                widest += np.maximum(b1[others] - a0[row], a1[row] - b0[others]) ** 2
            kept = least <= np.repeat(np.minimum.reduceat(widest, at[:-1]) * (1 + 1e-9), n)
            descend(level - 1, asks, others[kept], np.r_[0, np.cumsum(np.add.reduceat(kept, at[:-1], dtype=np.int64))])

    top = np.arange(len(own.starts[levels]))
    descend(levels, top, np.searchsorted(to.group[to.starts[levels]], own.group[own.starts[levels]]), np.arange(len(top) + 1))
    return out


def nearest_along(f: np.ndarray, step: np.ndarray) -> np.ndarray:
    """``min over j of f[j] + ((i - j) * step)^2`` for every column of ``f`` at once, ``step`` by column.

    Short columns are shifted against themselves; long ones use the lower envelope, whose work is linear in their length.
    """
    if len(f) > SHORT_COLUMN:
        return lower_envelope(f, step)
    out = f.copy()
    for d in range(1, len(f)):
        far = (d * step) ** 2
        np.minimum(out[d:], f[:-d] + far, out=out[d:])
        np.minimum(out[:-d], f[d:] + far, out=out[:-d])
    return out


def lower_envelope(f: np.ndarray, step: float) -> np.ndarray:
    """As :func:`nearest_along`, by the envelope of a column's parabolas; infinite ones are left out."""
    n, m = f.shape
    step = np.broadcast_to(step, m)
    column = np.arange(m)
    apex = np.zeros((n, m), np.int64)  # parabolas of the envelope, in order
    left = np.full((n + 1, m), np.inf)  # from where on each is the lowest
    top = np.full(m, -1)
    for j in range(n):
        open_ = np.flatnonzero(np.isfinite(f[j]))
        while len(open_):
            k = top[open_]
            first = open_[k < 0]
            top[first] = 0
            apex[0, first] = j
            left[0, first] = -np.inf
            open_, k = open_[k >= 0], k[k >= 0]
            v = apex[k, open_]
            cross = ((f[j, open_] - f[v, open_]) / step[open_] ** 2 + (j * j - v * v)) / (2.0 * (j - v))
            pushed = cross > left[k, open_]
            own = open_[pushed]
            top[own] += 1
            apex[top[own], own] = j
            left[top[own], own] = cross[pushed]
            open_ = open_[~pushed]
            top[open_] -= 1
    out = np.full((n, m), np.inf)
    known = top >= 0
    at = np.zeros(m, np.int64)
    for i in range(n):
        while True:
            ahead = known & (at < top) & (left[np.minimum(at + 1, n), column] <= i)
            if not ahead.any():
                break
            at[ahead] += 1
        v = apex[at, column]
        out[i, known] = (f[v, column] + ((i - v) * step) ** 2)[known]
    return out

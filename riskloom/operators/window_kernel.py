"""Vectorised kernels for past-only windows over sorted Arrow rows.

Rows come sorted by (entity, bucket, instant, id); a segment is one
(entity, bucket).  All segments of a chunk are worked on at once: a window's
first row is found by binary search on (segment, instant), maxima come from a
sparse table, and distinct counts from spans: a row stands for its value from
the next row on until the value comes again or the row leaves the window.  Sums
and moments need no subtraction, so they depend on the window's rows alone: time
is cut into blocks of the window's length, and a window is the end of one block
and the beginning of the next, both read from segmented scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_ROWS = 100_000
OWN, CONTEXT, CARRY = 0, 1, 2


@dataclass(frozen=True)
class Spec:
    """What a kernel computes.  ``lengths``: window lengths in microseconds;
    ``z``: number of the window of the z-score, or None; ``span``: bucket length."""

    lengths: tuple[int, ...]
    span: int
    attrs: tuple[str, ...]
    strict: bool
    z: int | None
    z_eps: float
    recency: bool

    def fields(self) -> list[tuple[str, str]]:
        """Names and Spark types of the computed columns."""
        out = []
        for k in range(len(self.lengths)):
            out += [(f"n{k}", "long"), (f"s{k}", "double"), (f"m{k}", "double"), (f"x{k}", "double")]
            out += [(f"{a}{k}", "long") for a in self.attrs]
        return out + ([("z", "double")] if self.z is not None else []) + ([("since", "double")] if self.recency else [])


# --- ranges of one array ----------------------------------------------------------

def _counts(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v) + 1, np.int64)
    np.cumsum(v, out=out[1:])
    return out


def range_max(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Greatest of v[lo:hi] for each range, -inf where it is empty."""
    out = np.full(len(lo), -np.inf)
    size = hi - lo
    width, table = 1, v
    longest = int(size.max(initial=0))
    while width <= longest:
        here = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(here):
            out[here] = np.maximum(table[lo[here]], table[hi[here] - width])
        if 2 * width <= longest:
            table = np.maximum(table[:-width], table[width:])
        width *= 2
    return out


def _first_of(group: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's run of equal groups."""
    at = np.arange(len(group))
    return np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), at, 0)) if len(group) else at


def _scan(parts: tuple[np.ndarray, ...], first: np.ndarray, combine: Callable) -> tuple[np.ndarray, ...]:
    """Inclusive scan of each run (whose first row is ``first``), in doubling steps."""
    parts = tuple(x.copy() for x in parts)
    place = np.arange(len(first)) - first
    step, longest = 1, int(place.max(initial=0)) + 1
    while step < longest:
        i = np.flatnonzero(place >= step)
        new = combine(tuple(x[i - step] for x in parts), tuple(x[i] for x in parts))
        for x, y in zip(parts, new):
            x[i] = y
        step *= 2
    return parts


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b))


def merge_moments(a, b):
    """(count, mean, sum of squared deviations) of two sets together."""
    (n1, m1, q1), (n2, m2, q2) = a, b
    n = n1 + n2
    some = np.maximum(n, 1)
    d = m2 - m1
    return n, np.where(n1 == 0, m2, m1 + d * (n2 / some)), q1 + q2 + d * d * (n1 * (n2 / some))


class Amounts:
    """Counts, sums, extremes and moments over ranges of a column of doubles.

    ``block``: runs of rows; a range is the end of one run and the beginning of
    the next, [lo, split) and [split, p) with split the first row of a run.
    """

    def __init__(self, a: np.ndarray, present: np.ndarray, moments: bool):
        self.n = _counts(present)
        finite = present & np.isfinite(a)
        self.odd = None
        if (present & ~finite).any():
            self.odd = [_counts(present & x) for x in (np.isnan(a), a == np.inf, a == -np.inf)]
        self.parts = [(np.where(finite, a, 0.0),)]
        if moments:
            self.parts.append((finite.astype(np.float64), np.where(finite, a, 0.0), np.zeros(len(a))))
        self.high = np.where(finite | (present & (a == np.inf)), a, -np.inf)
        self.low = np.where(finite, -a, -np.inf)

    def cut(self, block: np.ndarray) -> None:
        """Scan the runs of ``block`` in both directions."""
        self.first = _first_of(block)
        last = _first_of(block[::-1])
        self.before = [_scan(x, self.first, f) for x, f in zip(self.parts, (_add, merge_moments))]
        self.after = [tuple(y[::-1] for y in _scan(tuple(y[::-1] for y in x), last, lambda a, b, f=f: f(b, a)))
                      for x, f in zip(self.parts, (_add, merge_moments))]

    def _beginning(self, kind: int, split: np.ndarray, p: np.ndarray):
        """Of the rows [split, p) of one run."""
        some = p > split
        at = np.where(some, p - 1, 0)
        return tuple(np.where(some, x[at], 0.0) if len(x) else np.zeros(len(p)) for x in self.before[kind])

    def _end(self, kind: int, lo: np.ndarray, split: np.ndarray):
        """Of the rows [lo, split) of one run that ends there."""
        some = lo < split
        at = np.where(some, lo, 0)
        return tuple(np.where(some, x[at], 0.0) if len(x) else np.zeros(len(lo)) for x in self.after[kind])

    def count(self, lo, hi):
        return self.n[hi] - self.n[lo]

    def strange(self, lo, hi, total):
        """``total`` with the values that are not finite."""
        if self.odd:
            nan, up, down = (x[hi] - x[lo] > 0 for x in self.odd)
            total = np.where(nan | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, total)))
        return total

    def total(self, lo, split, p):
        split = np.maximum(split, lo)
        return self.strange(lo, p, self._end(0, lo, split)[0] + self._beginning(0, split, p)[0])

    def moments(self, lo, split, p):
        split = np.maximum(split, lo)
        return merge_moments(self._end(1, lo, split), self._beginning(1, split, p))

    def most(self, lo, hi):
        """-inf where no value is present; NaN is the greatest."""
        out = range_max(self.high, lo, hi)
        return np.where(self.odd[0][hi] - self.odd[0][lo] > 0, np.nan, out) if self.odd else out

    def least(self, lo, hi):
        return -range_max(self.low, lo, hi)


def z_score(a, present, n, mean, square, low, high, odd, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(z, valid): (a - mean) / (std + eps) with std of ddof 1, 0 for one value or equal ones."""
    same = (n < 2) | (low == high)
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.where(same, 0.0, np.sqrt(square / np.maximum(n - 1, 1)))
        z = (a - np.where(low == high, low, mean)) / (std + eps)
    return np.where(odd, np.nan, z), present & (n > 0)


def _following(code: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """For each row the next row of the same segment and code (or the number of rows)."""
    n = len(code)
    out = np.full(n, n, np.int64)
    order = np.lexsort((np.arange(n), code, seg))
    same = (code[order[1:]] == code[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
    out[order[:-1][same]] = order[1:][same]
    return out


def span_counts(code: np.ndarray, seg: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Distinct codes (-1: none) among the rows before each row that have not left its window.

    ``leaves``: for each row the first row whose window it is no longer in.
    """
    n = len(code)
    j = np.flatnonzero(code >= 0)
    end = np.minimum(_following(code, seg)[j] + 1, leaves[j])
    step = np.bincount(j + 1, minlength=n + 2) - np.bincount(np.maximum(end, j + 1), minlength=n + 2)
    return np.cumsum(step)[:n]


# --- chunks ---------------------------------------------------------------------------

def _codes(col: pa.ChunkedArray) -> np.ndarray:
    """Numbers of a column's values, -1 for null."""
    enc = col.combine_chunks().dictionary_encode()
    return pc.fill_null(enc.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _segments(table: pa.Table) -> np.ndarray:
    e, b = _codes(table.column("e")), table.column("b").to_numpy()
    return np.concatenate(([0], np.cumsum((e[1:] != e[:-1]) | (b[1:] != b[:-1])))) if len(e) else np.zeros(0, np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about CHUNK_ROWS rows that hold whole segments."""
    held, rows, limit = [], 0, CHUNK_ROWS
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(seg := _segments(table), seg[-1]))
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()
                held, rows, limit = rest.to_batches(), rest.num_rows, CHUNK_ROWS
            else:
                limit = 2 * rows                       # one segment so far
    if held:
        yield pa.Table.from_batches(held)


def _floats(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    present = pc.is_valid(col).to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else pc.is_valid(col).to_numpy()
    return pc.fill_null(col, 0.0).to_numpy(), present.astype(bool)


def _batch(spec: Spec, ids: pa.ChunkedArray, columns: list[np.ndarray], masks: list[np.ndarray | None]) -> pa.RecordBatch:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    kinds = {"long": pa.int64(), "double": pa.float64()}
    arrays = [pa.array(v, kinds[t], mask=m) for v, m, (_, t) in zip(columns, masks, spec.fields())]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *[f for f, _ in spec.fields()]])


def _amount_columns(n_rows, n, total, most) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Count, sum, mean and maximum of one window; mean and maximum are null without values."""
    none = n == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = total / n
    return [n_rows, total, mean, most], [None, None, none, none]


def _recency(us: np.ndarray, seg: np.ndarray, carry: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seconds since the row before, null?) of sorted rows; ``carry`` is the instant before a segment's first row."""
    before = np.zeros(len(us), np.int64)
    before[1:] = us[:-1]
    first = np.ones(len(us), bool)
    first[1:] = seg[1:] != seg[:-1]
    before = np.where(first, carry[seg], before)
    return (us - before) / 1e6, first & ~carried[seg]


def contiguous(spec: Spec) -> Callable:
    """Kernel for segments that hold a whole bucket and the rows up to the longest window before it.

    Columns: e, b, kind (own, context, carry), us, id, a and the attributes.  A
    carry row has the instant of the entity's last row before the bucket.
    """
    wide = 4 * spec.span

    def run(batches):
        for table in chunks(batches):
            seg = _segments(table)
            most = max(1, (1 << 62) // wide)           # segments that fit one key
            for s in range(0, int(seg[-1]) + 1, most):
                i, j = np.searchsorted(seg, [s, s + most])
                out = part(table.slice(i, j - i), seg[i:j] - s)
                if out.num_rows:
                    yield out

    def part(table, seg):
        kind = table.column("kind").to_numpy()
        us = table.column("us").to_numpy()
        carry, carried = np.zeros(seg[-1] + 1, np.int64), np.zeros(seg[-1] + 1, bool)
        at = np.flatnonzero(kind == CARRY)
        carry[seg[at]], carried[seg[at]] = us[at], True
        rows = np.flatnonzero(kind != CARRY)
        table, seg, us, own = table.take(rows), seg[rows], us[rows], kind[rows] == OWN
        idx = np.flatnonzero(own)
        key = seg * wide + us - (table.column("b").to_numpy() - 1) * spec.span
        a, present = _floats(table.column("a"))
        # The place of a row's past: before the row itself, or before all rows of its instant.
        p = np.searchsorted(key, key[idx]) if spec.strict else idx
        codes = [_codes(table.column(c)) for c in spec.attrs]
        columns, masks, z = [], [], None
        for k, w in enumerate(spec.lengths):
            x = Amounts(a, present, k == spec.z)
            x.cut(seg * (1 << 40) + us // w - int(us.min(initial=0)) // w)
            lo = np.searchsorted(key, key[idx] - w)
            split = x.first[p]
            n, total = x.count(lo, p), x.total(lo, split, p)
            c, m = _amount_columns(p - lo, n, total, x.most(lo, p))
            columns, masks = columns + c, masks + m
            if codes:
                leaves = np.searchsorted(key, key + w, "right")
                columns += [span_counts(v, seg, leaves)[p] for v in codes]
                masks += [None] * len(codes)
            if k == spec.z:
                z = z_score(a[idx], present[idx], *x.moments(lo, split, p), x.least(lo, p), x.most(lo, p), ~np.isfinite(total), spec.z_eps)
        if z is not None:
            columns.append(z[0])
            masks.append(~z[1])
        if spec.recency:
            since, none = _recency(us, seg, carry, carried)
            # The first row of a segment may be context, or the row before may be older than any context.
            columns.append(since[idx])
            masks.append(none[idx])
        return _batch(spec, table.column("id").take(idx), columns, masks)

    return run


# --- hot entities: blocks shorter than the windows -------------------------------------

def offsets(length: int, block: int) -> list[int]:
    """Blocks back from a row's own in which its window can begin (its own left out)."""
    q, rest = divmod(length, block)
    return sorted({q} - {0} | ({q + 1} if rest else set()))


#: Values of one window in a summary row: rows, amounts, sum, maximum, minimum, centred moments, then distinct counts.
MID = 7


def blocked(spec: Spec, block: int) -> Callable:
    """Kernel for segments of one block, with summaries in place of the rows in the middle of a window.

    ``kind`` is the number of blocks a row comes from before the segment's own
    (0: own rows), or -1 for the segment's summary row, whose ``mid`` holds the
    centre of the moments, the entity's last instant before the block, and for
    each window the summary of the blocks between the one(s) it begins in and the
    segment's own.  ``{attr}_pb`` and ``{attr}_nb`` are the nearest blocks before
    and after a row's own that have its value.
    """
    reach = max(spec.lengths) + 4 * block
    wide = 4 * reach

    def run(batches):
        for table in chunks(batches):
            seg = _segments(table)
            most = max(1, (1 << 62) // wide)
            for s in range(0, int(seg[-1]) + 1, most):
                i, j = np.searchsorted(seg, [s, s + most])
                out = part(table.slice(i, j - i), seg[i:j] - s)
                if out is not None and out.num_rows:
                    yield out

    def part(table, seg):
        kind = table.column("kind").to_numpy()
        summary = np.flatnonzero(kind == -1)
        if not len(summary):
            return None                                # context of a block without rows of its own
        width = 2 + len(spec.lengths) * (MID + len(spec.attrs))
        mid = np.full((seg[-1] + 1, width), np.nan)
        mid[seg[summary]] = np.array([[np.nan if v is None else v for v in r]
                                      for r in table.column("mid").take(summary).to_pylist()], np.float64)
        rows = np.flatnonzero(kind != -1)
        table, seg, kind = table.take(rows), seg[rows], kind[rows]
        us, block_no = table.column("us").to_numpy(), table.column("b").to_numpy()
        key = seg * wide + us - block_no * block + reach
        a, present = _floats(table.column("a"))
        centre = mid[:, 0]
        codes = [_codes(table.column(c)) for c in spec.attrs]
        near = [[pc.fill_null(table.column(f"{c}_{x}"), y).to_numpy() for x, y in (("pb", -(1 << 60)), ("nb", 1 << 60))]
                for c in spec.attrs]
        own = np.flatnonzero(kind == 0)
        o_key, o_seg = key[own], seg[own]
        o = Amounts(a[own], present[own], spec.z is not None)
        o.cut(o_seg)
        first = np.searchsorted(o_seg, o_seg)          # first own row of each row's segment
        end = np.searchsorted(o_seg, o_seg, "right")
        p = np.searchsorted(o_key, o_key) if spec.strict else np.arange(len(own))
        columns, masks, z = [], [], None
        for k, w in enumerate(spec.lengths):
            q = w // block
            at = 2 + k * (MID + len(spec.attrs))
            m_rows, m_n, m_s, m_x, m_min, m_1, m_2 = mid[o_seg, at:at + MID].T
            m_x, m_min = np.where(np.isnan(m_x) & (np.nan_to_num(m_n) == 0), -np.inf, m_x), np.where(np.isnan(m_min), np.inf, m_min)
            m_rows, m_n, m_s, m_1, m_2 = (np.where(np.nan_to_num(m_n) + np.nan_to_num(m_rows) == 0, 0.0, x) for x in (m_rows, m_n, m_s, m_1, m_2))
            m_s, m_1, m_2 = (np.where(m_n == 0, 0.0, x) for x in (m_s, m_1, m_2))
            head = np.flatnonzero(np.isin(kind, offsets(w, block)))
            if q == 0:
                # The window lies in the own block and the one before: their rows are one sequence.
                both = np.flatnonzero((kind == 0) | np.isin(kind, offsets(w, block)))
                x = Amounts(a[both], present[both], k == spec.z)
                x.cut(seg[both] * (1 << 40) + us[both] // w - int(us.min(initial=0)) // w)
                place = np.searchsorted(key[both], o_key) if spec.strict else np.searchsorted(both, own)
                lo = np.searchsorted(key[both], o_key - w)
                n, rows_in, total = x.count(lo, place), place - lo, x.total(lo, x.first[place], place)
                high, low = x.most(lo, place), x.least(lo, place)
                moments = x.moments(lo, x.first[place], place) if k == spec.z else None
            else:
                h = Amounts(a[head], present[head], k == spec.z)
                h.cut(seg[head])
                lo, stop = np.searchsorted(key[head], o_key - w), np.searchsorted(seg[head], o_seg, "right")
                lo = np.minimum(lo, stop)
                n = h.count(lo, stop) + o.count(first, p) + m_n.astype(np.int64)
                rows_in = (stop - lo) + (p - first) + m_rows.astype(np.int64)
                total = h.total(lo, stop, stop) + m_s + o.total(first, first, p)
                high = np.maximum(np.maximum(h.most(lo, stop), o.most(first, p)), m_x)
                low = np.minimum(np.minimum(h.least(lo, stop), o.least(first, p)), m_min)
                moments = None
                if k == spec.z:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        inner = (m_n, np.where(m_n > 0, np.nan_to_num(centre[o_seg]) + m_1 / m_n, 0.0),
                                 np.where(m_n > 0, np.maximum(m_2 - m_1 * m_1 / m_n, 0.0), 0.0))
                    moments = merge_moments(merge_moments(h.moments(lo, stop, stop), inner), o.moments(first, first, p))
            c, m = _amount_columns(rows_in, n, total, high)
            columns, masks = columns + c, masks + m
            for v, code in enumerate(codes):
                if q == 0:
                    leaves = np.searchsorted(key[both], key[both] + w, "right")
                    columns.append(span_counts(code[both], seg[both], leaves)[place])
                else:
                    inside = np.nan_to_num(mid[o_seg, at + MID + v]).astype(np.int64)
                    columns.append(inside + _ends(code, seg, block_no, near[v], own, head, key, w, q, p, first, end))
                masks.append(None)
            if k == spec.z:
                z = z_score(a[own], present[own], *moments, low, high, ~np.isfinite(total), spec.z_eps)
        if z is not None:
            columns.append(z[0])
            masks.append(~z[1])
        if spec.recency:
            carried = ~np.isnan(mid[:, 1])
            since, none = _recency(us[own], o_seg, np.nan_to_num(mid[:, 1]).astype(np.int64), carried)
            columns.append(since)
            masks.append(none)
        return _batch(spec, table.column("id").take(own), columns, masks)

    return run


def _ends(code, seg, block_no, near, own, head, key, w, q, p, first, end) -> np.ndarray:
    """Distinct values of a window's two ends that the blocks in its middle do not have."""
    before, after = near
    o_code, o_seg = code[own], seg[own]
    # Own rows: the first of each value, unless a middle block has the value.
    new = o_code >= 0
    follows = _following(o_code, o_seg)
    repeated = np.zeros(len(own) + 1, bool)
    repeated[follows] = True
    firsts = new & ~repeated[:-1]
    count = _counts(firsts & (before[own] < block_no[own] - q + 1))
    total = count[p] - count[first]
    # Head rows: the last of each value, unless a middle block has it; until it leaves the window or comes in the own block.
    h_code, h_seg = code[head], seg[head]
    last = (h_code >= 0) & (_following(h_code, h_seg) == len(head)) & (after[head] >= block_no[head])
    j = np.flatnonzero(last)
    if len(j) and len(own):
        pair = lambda c, s: s * (int(code.max()) + 2) + c                                    # noqa: E731
        f = np.flatnonzero(firsts)
        f = f[np.argsort(pair(o_code[f], o_seg[f]), kind="stable")]
        known, wanted = pair(o_code[f], o_seg[f]), pair(h_code[j], h_seg[j])
        at = np.minimum(np.searchsorted(known, wanted), max(len(f) - 1, 0))
        seen = np.full(len(j), len(own), np.int64)
        if len(f):
            seen = np.where(known[at] == wanted, f[at], seen)
        begin = np.searchsorted(o_seg, h_seg[j])
        stop = np.searchsorted(o_seg, h_seg[j], "right")
        leaves = np.searchsorted(key[own], key[head[j]] + w, "right")
        until = np.clip(np.minimum(leaves, seen + 1), begin, stop)
        step = np.bincount(begin, minlength=len(own) + 1) - np.bincount(until, minlength=len(own) + 1)
        total = total + np.cumsum(step)[p]
    return total

"""Pairs of boxes and greedy picks, by array arithmetic over many cells at once.

A cell is a number: only rows of one cell meet. All functions take and give numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of whole cells that are worked on at once, and pairs that are compared at once.
CHUNK_ROWS, BLOCK_PAIRS = 1 << 16, 1 << 20
Box = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns as numpy arrays; a null is NaN, false or 0."""
    out = {}
    for name in batch.schema.names:
        column = batch[name]
        blank = float("nan") if pa.types.is_floating(column.type) else False if pa.types.is_boolean(column.type) else 0
        out[name] = column.fill_null(blank).to_numpy(zero_copy_only=False)
    return out


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, if there are as many, that end where a cell does: ``place`` counts its rows from 1 on."""
    kept, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        starts = np.flatnonzero(batch["place"].to_numpy() == 1)
        if len(starts) and n - batch.num_rows + starts[-1] > 0:
            cut = int(starts[-1])
            kept[-1] = batch.slice(0, cut)
            yield _one([b for b in kept if b.num_rows])
            kept, n = [batch.slice(cut)], batch.num_rows - cut
    if kept:
        yield _one(kept)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def numbered(x: dict[str, np.ndarray], by: list[str]) -> np.ndarray:
    """The number of each row's cell, which begins where ``place`` is 1; fails if one begins or goes on elsewhere."""
    place = x["place"]
    new = place == 1
    other = np.append(True, np.any([x[c][1:] != x[c][:-1] for c in by], axis=0))
    if (other & ~new).any() or (np.diff(place)[~new[1:]] != 1).any():
        raise RuntimeError("a cell's rows aren't together")
    return np.cumsum(new) - 1


def meeting(d_cell: np.ndarray, d: Box, g_cell: np.ndarray, g: Box, crowd: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """``det, gt, iou, plain`` of every pair of a cell that overlaps, at ``least`` or more; ``iou`` is by the detection's area where ``gt`` is a crowd.

    The ground truth of a cell is ordered by its left sides. Of these, a detection is held against those
    from the first whose running rightmost side is beyond the detection's left, up to the last that begins
    before its right. A box with a null or NaN meets nothing.
    """
    (dx, dy, dw, dh), (gx, gy, gw, gh) = d, g
    dr, db, gr, gb = dx + dw, dy + dh, gx + gw, gy + gh
    of_d, of_g = np.flatnonzero(~(np.isnan(dr) | np.isnan(db))), np.flatnonzero(~(np.isnan(gr) | np.isnan(gb)))

    def keys(of_gt: np.ndarray, of_dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integers that order both by cell and value."""
        n = len(of_gt) + len(of_dt)
        place = np.unique(np.concatenate([of_gt, of_dt]), return_inverse=True)[1]
        return g_cell[of_g] * n + place[: len(of_gt)], d_cell[of_d] * n + place[len(of_gt) :]

    left, end = keys(gx[of_g], dr[of_d])
    order = np.argsort(left, kind="stable")
    of_g = of_g[order]
    stop = np.searchsorted(left[order], end, side="left")
    right, begin = keys(gr[of_g], dx[of_d])
    start = np.searchsorted(np.maximum.accumulate(right), begin, side="right")
    n = np.maximum(stop - start, 0)
    ends = np.cumsum(n)
    top, bottom, sides = gy[of_g], gb[of_g], gr[of_g]
    size_d, size_g = dw * dh, gw * gh
    out: list[tuple[np.ndarray, ...]] = []
    i, done = 0, 0
    while done < (ends[-1] if len(ends) else 0):
        j = max(int(np.searchsorted(ends, done + BLOCK_PAIRS, side="right")), i + 1)
        own = n[i:j]
        det = np.repeat(of_d[i:j], own)
        at = np.arange(done, ends[j - 1]) + np.repeat(start[i:j] - (ends[i:j] - own), own)
        near = np.flatnonzero((top[at] < np.repeat(db[of_d[i:j]], own)) & (np.repeat(dy[of_d[i:j]], own) < bottom[at]) & (np.repeat(dx[of_d[i:j]], own) < sides[at]))
        det, gt = det[near], of_g[at[near]]
        inter = (np.minimum(gr[gt], dr[det]) - np.maximum(gx[gt], dx[det])) * (np.minimum(gb[gt], db[det]) - np.maximum(gy[gt], dy[det]))
        both = size_g[gt] + size_d[det] - inter
        ratio = lambda under, inter=inter: np.divide(inter, under, out=np.zeros(len(inter)), where=under > 0)
        plain = ratio(both)
        iou = np.where(crowd[gt], ratio(size_d[det]), plain)
        good = iou >= least
        out.append((det[good], gt[good], iou[good], plain[good]))
        i, done = j, int(ends[j - 1])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


class Picks:
    """The greedy match of many cells at once.

    Edge ``i`` joins detection ``det[i]``, numbered by cell and rank, and ground truth ``gt[i]``. A
    detection's level is one above the highest of the better ones that share ground truth with it, so a
    level's detections don't compete: they pick together, after all lower levels. ``of`` then gives what
    one after the other would: candidates that count before ignored ones, the most similar first, of equal
    ones the last by ``order``; only a crowd is taken twice.
    """

    def __init__(self, n: int, det: np.ndarray, gt: np.ndarray, order: np.ndarray, crowd: np.ndarray, iou: np.ndarray):
        self.n, level = n, self._levels(n, det, gt, crowd)
        self.by = np.lexsort((-np.arange(len(det)), -order, -iou, det, level[det]))
        self.det, self.gt, self.crowd, self.iou = (c[self.by] for c in (det, gt, crowd, iou))
        self.bounds = np.searchsorted(level[self.det], np.arange(int(level.max(initial=0)) + 2)).tolist()
        self.own = np.cumsum(np.append(0, self.det[1:] != self.det[:-1])) if len(det) else self.det

    @staticmethod
    def _levels(n: int, det: np.ndarray, gt: np.ndarray, crowd: np.ndarray) -> np.ndarray:
        level = np.zeros(n, dtype=np.int64)
        solid = np.flatnonzero(~crowd)
        shared = solid[np.bincount(gt[solid])[gt[solid]] > 1] if len(solid) else solid
        if len(shared):
            shared = shared[np.argsort(det[shared], kind="stable")]
            heads = np.flatnonzero(np.append(True, det[shared][1:] != det[shared][:-1]))
            wanted, upto = gt[shared].tolist(), [*heads[1:].tolist(), len(shared)]
            last, found, i = dict.fromkeys(wanted, 0), [], 0
            for j in upto:
                own = wanted[i:j]
                here = max([last[g] for g in own])
                for g in own:
                    last[g] = here + 1
                found.append(here)
                i = j
            level[det[shared[heads]]] = found
        return level

    def of(self, seeds: np.ndarray, ignored: np.ndarray) -> np.ndarray:
        """For each detection and seed, the edge that it takes, or -1."""
        out = np.full((self.n, len(seeds)), -1, dtype=np.int64)
        if not len(self.det):
            return out
        sort = np.argsort(self.own * 2 + ignored[self.by], kind="stable")
        det, gt, by = self.det[sort], self.gt[sort], self.by[sort]
        reached, crowd = self.iou[sort][:, None] >= seeds, self.crowd[sort][:, None]
        taken = np.zeros((int(gt.max()) + 1, len(seeds)), dtype=bool)
        for s, e in zip(self.bounds, self.bounds[1:]):
            free = reached[s:e] & (crowd[s:e] | ~taken[gt[s:e]])
            heads = np.flatnonzero(np.append(True, det[s:e][1:] != det[s:e][:-1]))
            first = np.minimum.reduceat(np.where(free, np.arange(e - s)[:, None], e - s), heads, axis=0)
            own, t = np.nonzero(first < e - s)
            edge = s + first[own, t]
            out[det[edge], t] = by[edge]
            taken[gt[edge], t] = True
        return out

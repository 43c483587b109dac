"""Sweeps of rectangles inside of tiles, in arrays: the slabs of many tiles at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rectangles whose edges are put in order at a time (or those of one tile), and parts of rectangles
#: in slabs that are swept at a time.
RECTS, PARTS = 1 << 16, 1 << 19


def _ordered(tile: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of every (tile, value) among the distinct ones, and these in order."""
    order = np.lexsort((value, tile))
    tile, value = tile[order], value[order]
    new = np.r_[True, (tile[1:] != tile[:-1]) | (value[1:] != value[:-1])]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, tile[new], value[new]


def sweep(
    tile: np.ndarray, box: dict[str, np.ndarray], sides: tuple[np.ndarray, np.ndarray], on: Callable, joined: bool, gaps: bool
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Maximal y intervals for which ``on`` holds (or the gaps between them) in every slab of every tile.

    The distinct x edges of a tile make its slabs, and in a slab the y edges are swept with a
    running depth for each side. With ``joined`` slabs side by side with the same interval are one.
    """
    n, both = len(tile), np.r_[tile, tile]
    x, owner, xs = _ordered(both, np.r_[box["xl"], box["xh"]])
    y, _, ys = _ordered(both, np.r_[box["yl"], box["yh"]])
    first, last = x[:n], x[n:]
    # Slabs are taken together until they hold PARTS parts.
    parts = np.cumsum(np.cumsum(np.bincount(first, minlength=len(xs)) - np.bincount(last, minlength=len(xs))))
    cuts = np.unique(np.r_[0, np.searchsorted(parts, np.arange(PARTS, parts[-1], PARTS)), len(xs)])
    found = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        hit = np.flatnonzero((first < high) & (last > low))
        begin = np.maximum(first[hit], low)
        many = np.minimum(last[hit], high) - begin
        rect = np.repeat(hit, many)
        slab = np.arange(len(rect)) + np.repeat(begin - np.cumsum(many) + many, many)
        key = np.r_[slab * len(ys) + y[rect], slab * len(ys) + y[n + rect]]
        order = np.argsort(key)
        key = key[order]
        settled = np.r_[key[1:] != key[:-1], True]
        depths = [np.cumsum(np.r_[s[rect], -s[rect]][order])[settled] > 0 for s in sides]
        key, state = key[settled], on(*depths)
        # Every slab ends uncovered, so the turns are starts and ends by turns.
        slab, turn = np.divmod(key[state != np.r_[False, state[:-1]]], len(ys))
        slab, start, end = slab[::2], turn[::2], turn[1::2]
        if gaps:
            same = slab[1:] == slab[:-1]
            slab, start, end = slab[1:][same], end[:-1][same], start[1:][same]
        found.append((slab, start, end))
    slab, start, end = (np.concatenate(c) for c in zip(*found))
    until = slab
    if joined and len(slab):
        order = np.lexsort((slab, end, start))
        slab, start, end = slab[order], start[order], end[order]
        new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (slab[1:] != slab[:-1] + 1)]
        until = slab[np.r_[new[1:], True]]
        slab, start, end = slab[new], start[new], end[new]
    return owner[slab], {"xl": xs[slab], "yl": ys[start], "xh": xs[until + 1], "yh": ys[end]}


def swept_tiles(batches: Iterator[pa.RecordBatch], on: Callable, joined: bool, gaps: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one tile each, with its rectangles as the last column, to rows of swept boxes."""
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1).value_lengths().to_numpy()
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):
            until = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + RECTS, "right")))
            part = batch.slice(at, until - at)
            rects = part.column(part.num_columns - 1).flatten()
            columns = {f.name: rects.field(f.name).to_numpy().astype(np.int64) for f in rects.type}
            tile = np.repeat(np.arange(until - at), sizes[at:until])
            owner, boxes = sweep(tile, columns, (columns["a"], columns["b"]), on, joined, gaps)
            kept = [c.take(pa.array(owner)) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v) for v in boxes.values()]], names=[*part.schema.names[:-1], *boxes])
            at = until

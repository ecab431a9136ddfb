"""Burrows-Wheeler transform and common-prefix lengths of a collection, built column by column over sequential files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

from textquarry.llm.token_shards import _store

_FAR = np.iinfo(np.int64).max


class _Column:
    """Numbers in a file that is only ever read or written from its start to its end, a block at a time."""

    def __init__(self, disk: fs.FileSystem, path: str, kind: type, block: int):
        self.disk, self.path, self.kind, self.block = disk, path, np.dtype(kind), block

    def read(self) -> Iterator[np.ndarray]:
        with self.disk.open_input_stream(self.path) as f:
            while data := f.read(self.block * self.kind.itemsize):
                yield np.frombuffer(data, self.kind)

    def write(self, blocks: Iterator[np.ndarray]) -> None:
        with self.disk.open_output_stream(self.path) as f:
            for b in blocks:
                f.write(np.ascontiguousarray(b, self.kind))

    def whole(self) -> np.ndarray:
        return np.concatenate([*self.read(), np.zeros(0, self.kind)])


class ColumnBWT:
    """Built by inserting one symbol of every document each round, from its last to its first.

    After round j the files hold the BWT and the LCP of all suffixes of at most j symbols. A round reads them twice from
    start to end: the first time it counts where the suffixes that grow by one symbol belong and which LCP they get, the
    second time it writes both anew with the insertions merged in. It holds a block of each file and a few numbers for
    each document and symbol. Symbols are byte + 1 (0xFF never occurs in UTF-8), 0 is the end of a document; the empty
    suffixes keep document order. LCP values stop at `most`. The files stand in a folder of their own in `folder` (a path
    or an address that pyarrow.fs reaches), which is deleted at the end; `bwt` and `lcp` are read from them.
    """

    def __init__(self, documents: list[bytes], folder: str, most: int = 255, block: int = 1 << 18):
        self.m, self.most = len(documents), most
        self.lengths = np.array([len(d) for d in documents], np.int64)
        self.data = np.frombuffer(b"".join(documents), np.uint8)
        self.ends = np.cumsum(self.lengths)
        width = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
        disk, root = _store(folder)
        at = f"{root}/bwt-{uuid.uuid4().hex}"
        disk.create_dir(at)
        try:
            pairs = [(_Column(disk, f"{at}/bwt-{i}", np.uint8, block), _Column(disk, f"{at}/lcp-{i}", width, block)) for i in range(2)]
            bwt, lcp = self._build(pairs)
            self.bwt, self.lcp = bwt.whole(), lcp.whole()
        finally:
            disk.delete_dir(at)

    def _symbols(self, which: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the last j ones of each document; 0 where there is none."""
        at = self.ends[which] - 1 - j
        ok = j < self.lengths[which]
        out = np.zeros(len(which), np.uint8)
        out[ok] = self.data[at[ok]] + 1
        return out

    def _build(self, pairs: list[tuple[_Column, _Column]]) -> tuple[_Column, _Column]:
        everyone = np.arange(self.m)
        symbols = self._symbols(everyone, 0)
        old, new = pairs
        old[0].write(iter([symbols]))
        old[1].write(iter([np.zeros(self.m)]))
        totals = np.bincount(symbols, minlength=256)
        # documents whose next suffix is due, in the order in which their last symbols stand, and where these stand
        live = place = everyone[self.lengths > 0]
        symbols = symbols[live]
        j = 1
        while len(live):
            rank, before, after = _scan(old[0].read(), old[1].read(), place, symbols)
            totals[0] = self.m  # empty suffixes come first; ended documents have no further suffix
            to = (np.cumsum(totals) - totals)[symbols] + rank
            order = np.argsort(to, kind="stable")
            to, live, before, after = to[order], live[order], before[order], after[order]
            symbols = self._symbols(live, j)
            values = [np.where(x < 0, 0, np.minimum(x, self.most - 1) + 1) for x in (before, after)]
            slots = to - np.arange(len(to))  # the old row before which each one is inserted
            last = np.append(slots[1:] != slots[:-1], True) & (after >= 0)
            new[0].write(_merged(old[0].read(), slots, symbols))
            new[1].write(_merged(old[1].read(), slots, values[0], slots[last], values[1][last]))
            old, new = new, old
            totals += np.bincount(symbols, minlength=256)
            more = symbols > 0
            live, place, symbols = live[more], to[more], symbols[more]
            j += 1
        return old

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, start) of each suffix in sorted order, by walking all documents from their ends at once. In memory,
        which is what bounds a collection."""
        order = np.argsort(self.bwt, kind="stable")
        ended = int(np.count_nonzero(self.bwt == 0))
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order)) - ended + self.m
        doc, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        at, who, j = np.arange(self.m), np.arange(self.m), 0
        while len(at):
            doc[at], start[at] = who, self.lengths[who] - j
            more = self.bwt[at] > 0
            at, who, j = to[at[more]], who[more], j + 1
        return doc, start


def _scan(bwt: Iterator[np.ndarray], lcp: Iterator[np.ndarray], place: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of `place` (rising) with its symbol: how many equal symbols stand before it, and the least LCP on the
    way from the equal symbol before it and to the one after it; -1 where there is none."""
    rank, before, after = np.zeros(len(place), np.int64), np.full(len(place), -1, np.int64), np.full(len(place), -1, np.int64)
    seen, least = np.zeros(256, np.int64), np.full(256, _FAR)  # how often each symbol stood, and the least LCP since it last did
    waiting = np.full(256, -1, np.int64)  # the row whose next equal symbol lies beyond the blocks so far
    at = lo = 0
    passed = None  # the block before: its LCPs, its symbols and where each of them stood last
    for b, common in zip(bwt, lcp, strict=True):
        hi = lo + int(np.searchsorted(place[lo:], at + len(b)))
        inside = place[lo:hi] - at
        order = np.argsort(b, kind="stable")
        counts = np.bincount(b, minlength=256)
        begin = np.cumsum(counts) - counts
        due = np.zeros(len(b), bool)
        due[inside] = True
        k = np.flatnonzero(due[order])
        p = order[k]
        row = lo + np.searchsorted(inside, p)
        c = symbols[row]
        rank[row] = seen[c] + k - begin[c]
        first, last = k == begin[c], k == begin[c] + counts[c] - 1
        before[row[~first]], after[row[~last]] = _least(common, (order[k[~first] - 1], p[~first]), (p[~last], order[k[~last] + 1]))
        there = counts > 0
        if passed is not None:
            to_end = np.append(np.minimum.accumulate(passed[0][::-1])[::-1].astype(np.int64), _FAR)
            least = np.minimum(least, to_end[0])
            least[passed[1]] = to_end[passed[2] + 1]
            from_start = np.minimum.accumulate(common)
            again = first & (seen[c] > 0)
            before[row[again]] = np.minimum(least[c[again]], from_start[p[again]])
            met = there & (waiting >= 0)
            after[waiting[met]] = np.minimum(least[met], from_start[order[begin[met]]])
            waiting[there] = -1
        waiting[c[last]] = row[last]
        passed = common, there, order[(begin + counts - 1)[there]]
        seen += counts
        at, lo = at + len(b), hi
    return rank, before, after


def _least(common: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The least of common[a + 1 .. b] for each pair of each of the `ranges` (a, b)."""
    a, b = (np.concatenate(x) for x in zip(*ranges, strict=True))
    out = np.empty(len(a), np.int64)
    if len(a):
        padded = np.append(common, common.dtype.type(0))
        down = np.argsort(-a, kind="stable")  # by falling starts, since reduceat would also run over gaps that rise
        out[down] = np.minimum.reduceat(padded, np.stack([a[down] + 1, b[down] + 1], 1).ravel())[::2]
    return np.split(out, np.cumsum([len(x) for x, _ in ranges])[:-1])


def _merged(blocks: Iterator[np.ndarray], slots: np.ndarray, values: np.ndarray, changed: np.ndarray | None = None, to: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The blocks with `values` inserted before the rows `slots` (rising), and the old rows `changed` set to `to`."""
    at = lo = fixed = 0
    for b in blocks:
        if changed is not None:
            end = fixed + int(np.searchsorted(changed[fixed:], at + len(b)))
            if end > fixed:
                b = b.copy()
                b[changed[fixed:end] - at] = to[fixed:end]
            fixed = end
        hi = lo + int(np.searchsorted(slots[lo:], at + len(b)))
        yield _inserted(b, slots[lo:hi] - at, values[lo:hi])
        at, lo = at + len(b), hi
    if lo < len(slots):
        yield values[lo:]


def _inserted(b: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(b) + len(slots), b.dtype)
    old = np.ones(len(out), bool)
    new = slots + np.arange(len(slots))
    old[new] = False
    out[old], out[new] = b, values
    return out

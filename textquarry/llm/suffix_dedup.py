"""Removal of byte runs that occur before, by sorted suffixes of a collection built column by column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.column_bwt import ColumnBWT
from textquarry.llm.common import bit_table, drop, may_hold, save
from textquarry.plans.rounds import folder

SEED_BYTES = 32
#: A key (at first, an anchor) with more distinct strings than this is dealt out by longer contexts: by what all windows have in
#: common whose distance to the anchor lies in one of CONTEXTS parts of its range, and in the end by whole windows.
HOT_STRINGS, CONTEXTS = 2_000, 8
#: Strings of one collection at most; a task with more builds several, cut between anchors.
COLLECTION = 3_000
#: So many collections' strings are held at once and dealt by length.
TOGETHER = 16
#: An anchor's strings are compared in this many parts of the window range before a collection is built of them.
CELLS = 4
#: Window starts that are looked at together, so that their hashes stay in a core's cache.
CACHED = 1 << 15
_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(0xB17E).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchored_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `length` bytes that have the same anchor: (text number, start, windows, anchor - start, anchor hash).

    The anchor of a window is its SEED_BYTES-gram with the smallest hash, the first of equal ones, so equal windows
    have the same anchor at the same place wherever they stand. Every window lies in exactly one run. `data` holds
    at most 2**24 bytes, of texts that end at `bounds`.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    span = length - SEED_BYTES + 1
    hashes, low = np.empty(len(data) - SEED_BYTES + 1, np.uint64), np.empty(len(data) - length + 1, np.uint64)
    for a in range(0, len(low), CACHED):
        part = data[a : min(a + CACHED, len(low)) + length - 1]
        with np.errstate(over="ignore"):
            h, power, width = _BYTE[part], _MULTIPLIER, 1
            while width < SEED_BYTES:
                longer = h[:-width] * np.uint64(power)
                longer += h[width:]
                h, power, width = longer, power * power & (1 << 64) - 1, width * 2
            h = hashes[a : a + len(h)] = _mix(h)
        key, width = (h & ~_PLACE) | np.arange(a, a + len(h), dtype=np.uint64), 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        low[a : a + CACHED] = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    begins = np.concatenate(([0], bounds[:-1]))
    text = np.flatnonzero(bounds - begins >= length)  # a run starts where one of these does, or where the anchor changes
    if not len(text):
        return none
    change = np.concatenate(([True], low[1:] != low[:-1]))
    change[begins[text]] = True
    turn = np.flatnonzero(change)
    text = np.searchsorted(bounds, turn, side="right")
    ok = turn + length <= bounds[text]
    turn, text = turn[ok], text[ok]
    last = np.append(turn[1:], len(low))
    n = np.minimum(last, bounds[text] - length + 1) - turn
    at = (low[turn] & _PLACE).astype(np.int64)
    return text, turn, n, at - turn, hashes[at]


def _slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, ends) of consecutive texts of about `most` bytes. A longer text stands alone."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i + len(parts) < len(texts) and (not parts or size < most):
            v = texts[i + len(parts)].as_py()
            parts.append((v or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
        yield i, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        i += len(parts)


def runs_of(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """anchored_runs of all texts, of very long ones in overlapping pieces. Starts are within the text, offsets within data."""
    piece = 1 << 21
    for first, data, ends in _slices(texts):
        if len(data) <= piece:
            text, start, n, left, h = anchored_runs(data, ends, length)
            yield first, data, (text, start, start - np.concatenate(([0], ends[:-1]))[text], n, left, h)
            continue
        begins = np.concatenate(([0], ends[:-1]))
        for k, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            for at in range(b, max(e - length + 1, b), piece):
                part = data[at : min(at + piece + length - 1, e)]
                text, start, n, left, h = anchored_runs(part, np.array([len(part)]), length)
                yield first, data, (text + k, start + at, start + at - b, n, left, h)


def _recurring(docs: DataFrame, length: int) -> DataFrame:
    """Anchor hashes that more than one run has; counted over all documents, within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, (_, _, _, _, _, h) in runs_of(batch.column(0), length):
                k, n = np.unique(h, return_counts=True)
                if len(k):
                    yield pa.RecordBatch.from_pydict({"anchor": k.astype(np.int64), "n": np.minimum(n, 2).astype(np.int32)})

    seen = docs.select(F.col("text").cast("string")).mapInArrow(run, "anchor long, n int")
    return seen.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def _by_context(data: np.ndarray, runs: tuple[np.ndarray, ...], parts: int, length: int) -> tuple[np.ndarray, ...]:
    """Runs (text, at, start, n, left, _) cut where their windows' distance to the anchor passes from one of `parts` parts of its
    range to the next, each with a hash of the bytes around the anchor that all windows of that part cover. Equal windows
    lie in the same part and have the same bytes there."""
    text, at, start, n, left, _ = runs
    edges = (length - SEED_BYTES + 1) * np.arange(parts + 1) // parts
    first = np.searchsorted(edges, left - n + 1, side="right") - 1
    k = np.searchsorted(edges, left, side="right") - first
    i = np.repeat(np.arange(len(k)), k)
    part = np.arange(len(i)) - np.repeat(np.cumsum(k) - k - first, k)
    near, far = edges[part], edges[part + 1] - 1
    most, least = np.minimum(left[i], far), np.maximum((left - n + 1)[i], near)
    anchor, raw = at[i] + left[i], data.tobytes()
    key = [xxhash.xxh3_64_intdigest(raw[a:b], c) for a, b, c in zip((anchor - near).tolist(), (anchor - far + length).tolist(), (part + 1).tolist(), strict=True)]
    moved = left[i] - most
    return text[i], at[i] + moved, start[i] + moved, most - least + 1, most, np.array(key, np.uint64)


def _runs(docs: DataFrame, hot: list[np.ndarray], near: np.ndarray | None, length: int, keys: np.ndarray | None = None) -> DataFrame:
    """(anchor, doc_id, start, n, left, g) of the runs whose anchor may be in the bit table `near`: `left` is how far
    before its anchor a run starts, g a 64-bit hash of its bytes. With `hot`, bit tables of each level's hot keys: of the runs
    with such keys, cut by the contexts of the next level, and `anchor` is that context's key. With `keys`: of these runs
    those whose _key() may be in that table, and with their bytes."""
    held, with_bytes = docs.sparkSession.sparkContext.broadcast((hot, near, keys)), keys is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, near, keys = held.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, runs in runs_of(batch.column(1), length):
                for table, parts in zip(hot, (CONTEXTS, length - SEED_BYTES + 1), strict=False):
                    some = may_hold(table, runs[5])
                    runs = _by_context(data, tuple(c[some] for c in runs), parts, length) if some.any() else tuple(c[:0] for c in runs)
                if near is not None:
                    some = may_hold(near, runs[5])
                    runs = tuple(c[some] for c in runs)
                text, at, start, n, left, h = runs
                doc = ids[first + text].astype(np.int64)
                raw = data.tobytes() if len(h) else b""
                strings = [raw[a:b] for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                g = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings)).astype(np.int64)
                columns = [h.astype(np.int64), doc, start, n.astype(np.int32), left.astype(np.int32), g]
                if with_bytes:
                    wanted = np.flatnonzero(may_hold(keys, g ^ start ^ (doc << 20)))
                    columns = [c[wanted] for c in columns] + [[strings[i] for i in wanted.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "anchor long, doc_id long, start long, n int, left int, g long" + ", bytes binary" * with_bytes
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()][: len(names)]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _key() -> Column:
    return F.col("g").bitwiseXOR(F.col("start")).bitwiseXOR(F.shiftleft("doc_id", 20))


def repeated_windows(strings: list[bytes], firsts: list[tuple[int, int]], length: int, folder: str) -> list[np.ndarray]:
    """For each string the window offsets at which a window that equals it starts earlier than the string's first
    occurrence does. Suffixes in sorted order fall into classes of equal windows where the LCP drops below `length`."""
    built = ColumnBWT(strings, folder, most=length)
    doc, start = built.suffixes()
    whole = built.lengths[doc] - start >= length
    doc, start = doc[whole], start[whole]
    if not len(doc):
        return [np.zeros(0, np.int64) for _ in strings]
    # whole windows that are equal stand next to each other: shorter suffixes never lie between them
    lcp = built.lcp.astype(np.int64)
    group = np.cumsum(lcp < length)[whole]
    first = np.array(firsts, np.int64).reshape(-1, 2)
    d, p = first[doc, 0], first[doc, 1] + start
    order = np.lexsort((p, d, group))
    head = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = order[(d[order] != d[order][lead]) | (p[order] != p[order][lead])]
    later = later[np.lexsort((start[later], doc[later]))]
    cut = np.searchsorted(doc[later], np.arange(len(strings) + 1))
    return [start[later[a:b]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _ranges(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive offsets as (first, count)."""
    if not len(offsets):
        return []
    turn = np.flatnonzero(np.concatenate(([True], np.diff(offsets) > 1)))
    return list(zip(offsets[turn].tolist(), np.diff(np.append(turn, len(offsets))).tolist(), strict=True))


def _trim(rows: list[tuple], length: int) -> list[tuple[tuple, int, bytes]]:
    """(row, windows cut off in front, bytes) of an anchor's distinct strings (anchor, g, doc_id, start, n, left, bytes) that
    may share a window with another one.

    A window starts 0 to length-SEED_BYTES bytes before the anchor; in each of CELLS parts of that range all windows
    hold the same bytes around the anchor, and a string that no other one agrees with there shares no window there."""
    span = length - SEED_BYTES + 1
    cells = [(span * c // CELLS, span * (c + 1) // CELLS - 1) for c in range(CELLS)]  # least and greatest distance to the anchor
    seen: dict[tuple[int, bytes], int] = {}
    parts = []
    for _, _, _, _, n, left, string in rows:
        mine = []
        for c, (near, far) in enumerate(cells):
            if left >= near and left - n + 1 <= far:
                k = (c, string[left - near : left - far + length])
                mine.append(k)
                seen[k] = seen.get(k, 0) + 1
        parts.append(mine)
    out = []
    for r, mine in zip(rows, parts, strict=True):
        shared = [c for c, k in mine if seen[c, k] > 1]
        if shared:
            n, left, string = r[4:]
            a = max(0, left - cells[shared[-1]][1])
            b = min(n - 1, left - cells[shared[0]][0])
            out.append((r, a, string[a : b + length]))
    return out


def _judge(strings: DataFrame, length: int) -> DataFrame:
    """(anchor, g, runs): for each distinct string (anchor, g, doc_id, start, n, left, bytes) the window runs that repeat
    earlier ones, if there are any.

    All strings of an anchor are in one partition and stand together; a task takes them in collections of COLLECTION
    strings, cut between anchors, so memory is bounded by that and by HOT_STRINGS. Of several collections' anchors those
    with strings of like length go together: a collection takes as many rounds as its longest string has bytes. Its files stand in
    the shared folder while it is built; what a lost task leaves is deleted when the driver ends."""
    files = folder(strings.sparkSession, f"transforms-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[tuple, int, bytes]]] = []
        waiting = 0
        group: dict[int, tuple] = {}

        def judged(held: list[tuple[tuple, int, bytes]]) -> pa.RecordBatch:
            found = repeated_windows([x for _, _, x in held], [(r[2], r[3] + a) for r, a, _ in held], length, files)
            some = [(r, a + x) for (r, a, _), x in zip(held, found, strict=True) if len(x)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r, _ in some], pa.int64()), pa.array([r[1] for r, _ in some], pa.int64()),
                    pa.array([[{"at": a, "n": b} for a, b in _ranges(x)] for _, x in some], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))),
                ],
                ["anchor", "g", "runs"],
            )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal groups, waiting
            held: list[tuple[tuple, int, bytes]] = []
            for members in sorted(groups, key=lambda m: max(len(x) for _, _, x in m)):
                held += members
                if len(held) >= COLLECTION:
                    yield judged(held)
                    held = []
            if held:
                yield judged(held)
            groups, waiting = [], 0

        anchor = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "g", "doc_id", "start", "n", "left", "bytes")), strict=True):
                if row[0] != anchor:
                    if len(group) > 1 and (members := _trim(list(group.values()), length)):
                        groups.append(members)
                        waiting += len(members)
                    if waiting >= TOGETHER * COLLECTION:
                        yield from flush()
                    anchor, group = row[0], {}
                old = group.get(row[1])
                if old is None or row[2:4] < old[2:4]:
                    group[row[1]] = row
        if len(group) > 1 and (members := _trim(list(group.values()), length)):
            groups.append(members)
        yield from flush()

    # Dealt by a hash of the anchor, not by it: a repartition by the key of the join below would be optimised away, and
    # adaptive execution may then split that join's partitions.
    dealt = strings.withColumn("deal", F.xxhash64("anchor")).repartition("deal").sortWithinPartitions("anchor")
    return dealt.drop("deal").mapInArrow(run, "anchor long, g long, runs array<struct<at:int,n:int>>")


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, start, n): starts start..start+n-1 of `length`-byte windows that also start earlier (smaller doc_id, or
    the same document and a smaller start), over all documents and whole texts. Rows without doc_id take no part.

    A key's distinct strings meet in one collection. Keys with too many of them go on to a next level, where longer contexts
    tell their windows apart; its last one has a key for each window, so only equal strings are left together."""
    if length < SEED_BYTES:
        raise ValueError(f"windows have at least {SEED_BYTES} bytes")
    docs = docs.filter("doc_id is not null")
    anchors = save(_recurring(docs, length), "anchors")
    near = bit_table(anchors, "anchor", anchors.count())
    drop(anchors)
    found, hot = _level(docs, [], near, length)
    tables = []
    while hot is not None:
        tables.append(hot)
        more, hot = _level(docs, tables, None, length)
        found = found.unionByName(more)
    return found


def _level(docs: DataFrame, tables: list[np.ndarray], near: np.ndarray | None, length: int) -> tuple[DataFrame, np.ndarray | None]:
    """The repeated windows of the keys with up to HOT_STRINGS distinct strings, and a bit table of the other keys, if any."""
    runs = save(_runs(docs, tables, near, length), "runs")
    strings = save(_distinct(runs), "strings")
    several = save(strings.groupBy("anchor").agg(F.count("*").alias("strings")).filter("strings > 1"), "several")
    last = len(tables) == 2  # equal windows: with two strings here their hashes of 64 bits would have to be equal
    hot = several.filter((F.col("strings") > HOT_STRINGS) & F.lit(not last)).select("anchor")
    some = several.filter((F.col("strings") <= HOT_STRINGS) | F.lit(last))
    size = some.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("strings"), F.lit(0)).alias("strings")).first()
    told = strings.withColumnsRenamed({"doc_id": "first_doc", "start": "first_start"}).join(hot, "anchor", "left_anti")
    judged = None
    if size.anchors:
        wanted = strings.join(some, "anchor", "left_semi").select(_key().alias("key"))
        whole = _runs(docs, tables, bit_table(some, "anchor", size.anchors), length, bit_table(wanted, "key", size.strings))
        judged = save(_judge(whole.join(hot, "anchor", "left_anti"), length), "judged")
        told = told.join(judged, ["anchor", "g"], "left")
    else:
        told = told.withColumn("runs", F.lit(None).cast("array<struct<at:int,n:int>>"))
    # Where a string stands again, all its windows have stood before; where it stands first, those that were judged so.
    told = save(told.filter("k > 1 or runs is not null"), "told")
    again = (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    own = F.when(again, F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("n")))).otherwise(F.col("runs"))
    cool = runs.join(told, ["anchor", "g"]).select("doc_id", "start", F.inline(own)).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n")
    found = save(cool, "found")
    keys = hot.count()
    table = bit_table(hot, "anchor", keys) if keys else None
    drop(strings, several, runs, told, *([judged] if judged is not None else []))
    return found, table


def _distinct(runs: DataFrame) -> DataFrame:
    """(anchor, g, doc_id, start, k): the distinct strings with their first place and how often they stand."""
    top = runs.agg(F.max("doc_id").alias("d"), F.min("doc_id").alias("least"), F.max("start").alias("s")).first()
    if top.d is None or (0 <= top.least and top.d < 1 << 36 and top.s < 1 << 27):  # place fits a long, which hash aggregation takes
        place = F.shiftleft("doc_id", 27).bitwiseOR(F.col("start"))
        found = runs.groupBy("anchor", "g").agg(F.min(place).alias("place"), F.count("*").alias("k"))
        return found.select("anchor", "g", F.shiftright("place", 27).alias("doc_id"), F.col("place").bitwiseAND((1 << 27) - 1).alias("start"), "k")
    found = runs.groupBy("anchor", "g").agg(F.min(F.struct("doc_id", "start")).alias("place"), F.count("*").alias("k"))
    return found.select("anchor", "g", "place.doc_id", "place.start", "k")


def _merged(windows: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal spans that each row's windows cover, in order."""
    counts = np.diff(windows.offsets.to_numpy())
    values = windows.flatten()
    row = np.repeat(np.arange(len(windows)), counts if windows.null_count == 0 else np.where(windows.is_valid().to_numpy(zero_copy_only=False), counts, 0))
    start = values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + values.field(1).to_numpy(zero_copy_only=False) - 1 + length
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    far = np.maximum.accumulate((row << 40) + end) if len(row) else end  # a later row's ends are beyond all earlier ones'
    head = np.concatenate(([True], (row[1:] << 40) + start[1:] > far[:-1])) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return row[first], start[first], far[last] - (row[last] << 40)


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove from every document each byte that a repeated window covers: (doc_id, n_bytes, n_removed, n_spans, spans, kept).

    Texts count as UTF-8 bytes, null as empty; windows never cross documents and are judged on the input. spans are
    the maximal removed [start, end) in bytes and kept the remaining bytes. Rows that repeat a doc_id with the same
    text are one document, and one row comes back for each of them; of different texts with one doc_id the one with the
    least hash is that document, and the others stay whole and take no part, as rows without doc_id do. No documents
    give no rows.
    """
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if _repeats_ids(docs):
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        chosen = save(whole.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("chosen")), "chosen")
        own = whole.join(chosen, "doc_id", "left").withColumn("own", digest.eqNullSafe(F.col("chosen")))
        found = repeats(own.filter("own").select("doc_id", "text").dropDuplicates(["doc_id"]), length)
    else:
        own, found = whole.withColumn("own", F.lit(True)), repeats(whole, length)
    of = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("windows"))  # at most a document's own windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                doc, start, end = _merged(part.column(2), length)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                start, end = start.tolist(), end.tolist()
                out = []
                for k, (doc_id, data) in enumerate(zip(part.column(0).to_pylist(), texts, strict=True)):
                    data = data or b""
                    spans = list(zip(start[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]], strict=True))
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(data[at:a])
                        at = b
                    kept = b"".join([*kept, data[at:]])
                    out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "spans": [{"start": a, "end": b} for a, b in spans], "kept": kept})
                yield pa.RecordBatch.from_pylist(out, schema=_KEPT)

    cut = own.join(of, "doc_id", "left")
    return cut.select("doc_id", "text", F.when(F.col("own"), F.col("windows")).alias("windows")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _repeats_ids(docs: DataFrame) -> bool:
    return bool(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").head(1))



"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EOS = 1
_ENCODERS: dict[str, tuple] = {}


def encoder(json_path: str, ranks_path: str | None = None):
    """ids(text) of the byte-level BPE in `json_path`, one instance for each worker.

    The file's added tokens are found in any text, as the library does by default. `ranks_path` names the same vocabulary
    as ranks: its encoder gives the same ids at four to five times the speed (tests hold both against the plain library);
    a text on which it gives up (very long white space) goes to the first.
    """
    key = f"{json_path}|{ranks_path}"
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(json_path)
        slow = lambda text: np.asarray(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if ranks_path is None:
            _ENCODERS[key] = (slow,)
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

            def ids(text: str) -> np.ndarray:
                try:
                    return fast.encode_to_numpy(text, allowed_special="all")
                except Exception:  # noqa: BLE001  the pattern engine's limit on one run of white space
                    return slow(text)

            _ENCODERS[key] = (ids,)
    return _ENCODERS[key][0]


def capacities(total: int, size: int) -> list[int]:
    """Rooms that `total` tokens fill without padding: full sequences, then one for each power of two in what is left."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset): documents by descending length, each to the lowest-cost
    sequence that has room for all of it, else cut over the lowest-cost ones with room left. A piece costs
    linear*n + quadratic*n*n, since attention is masked between documents."""
    room = capacities(sum(lengths), size)
    used = [0] * len(room)
    # A heap of (cost, sequence) for each room left, and over these a tree of least tops: the cheapest with enough room is exact.
    leaves, none = 1 << size.bit_length(), (float("inf"), -1)
    heaps: dict[int, list[tuple[float, int]]] = {}
    least = [none] * (2 * leaves)

    def settle(r: int) -> None:
        at = leaves + r
        least[at] = heaps[r][0] if heaps[r] else none
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def cheapest(r: int) -> tuple[float, int]:
        at = leaves + r
        best = least[at]
        while at > 1:
            if not at & 1:
                best = min(best, least[at + 1])
            at >>= 1
        return best

    for s, r in enumerate(room):
        heaps.setdefault(r, []).append((0.0, s))
    for r in heaps:
        settle(r)
    out = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[d]
        while left:
            fit = cheapest(left) if left <= size else none
            if fit is none:
                fit = least[1]
            r = room[fit[1]] - used[fit[1]]
            heapq.heappop(heaps[r])
            settle(r)
            cost, s = fit
            n = min(left, room[s] - used[s])
            out.append((d, start, n, s, used[s]))
            used[s] += n
            start += n
            left -= n
            if used[s] < room[s]:
                r = room[s] - used[s]
                heapq.heappush(heaps.setdefault(r, []), (cost + linear * n + quadratic * n * n, s))
                settle(r)
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 6_000_000) -> DataFrame:
    """Pack every document (doc_id, text; null text is empty) into sequences of at most `size` tokens.

    A document is its ids and an end id. Whole runs of `size` ids become sequences of their own; the remainders of a
    task's documents, in blocks of about `block_tokens` tokens, are packed by assign(). There is no shuffle: a task
    packs what it reads, and memory is bounded by the block. sequence_id is task * 2**32 + number, so a rerun task
    gives the same rows. Returns a row for each piece, `ids` as little-endian unsigned 32-bit. Rows that repeat a
    doc_id are packed as they come; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        rests: list[tuple[int, int, np.ndarray, int]] = []
        held = sent = 0

        def emit() -> pa.RecordBatch:
            nonlocal sent
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows.clear()
            sent = 0
            return got

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, sent
            made = 0
            for d, start, n, s, offset in assign([len(r[2]) for r in rests], size, linear, quadratic):
                doc, at, ids, total = rests[d]
                rows.append((doc, at + start, n, ids[start : start + n].astype("<u4").tobytes(), total, sequence + s, offset))
                made = max(made, s + 1)
                sent += n
                if sent > 1_000_000:
                    yield emit()
            sequence += made
            held = 0
            rests.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(EOS))
                full = len(ids) // size * size
                for at in range(0, full, size):
                    rows.append((doc, at, size, ids[at : at + size].astype("<u4").tobytes(), len(ids), sequence, 0))
                    sequence += 1
                    sent += size
                if full < len(ids):
                    rests.append((doc, full, ids[full:].astype(np.uint16) if ids.max() < 65536 else ids[full:], len(ids)))
                    held += len(ids) - full
                if sent > 1_000_000:
                    yield emit()
                if held > block_tokens:
                    yield from flush()
        yield from flush()
        if rows:
            yield emit()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

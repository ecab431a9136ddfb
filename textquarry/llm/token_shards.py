"""Training-order materialisation: token sequences in the order of a keyed permutation, as fixed-stride binary shards."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import save, shared_dir
from textquarry.llm.packing import EOS, encoder

ROUNDS = 6
#: Of so many documents, and of so many characters of each, the dictionary of the compression is learned; its bytes; the level.
SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL = 1_000, 20_000, 112_640, 9
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot of each index in [0, n): a balanced Feistel network over the least even number of bits that holds n,
    walked along its cycle until the value is below n. A bijection for every n and key; inverse=True undoes it."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(((key + 1) * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & _MASK) for r in range(ROUNDS)]
    x = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> np.uint64(half), x[todo] & low
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left + k) & low), left
                else:
                    left, right = right, left ^ (_mix(right + k) & low)
            x[todo] = (left << np.uint64(half)) | right
            todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


SEQUENCE = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("tokens", pa.int32()), ("payload", pa.binary())])


def learned(docs: DataFrame, json_path: str, ranks_path: str | None, length: int) -> bytes:
    """A zstandard dictionary for sequences, learned from a few documents; empty where they are too few. It decides how small
    sequences are stored, never what they hold."""
    some = docs.select(F.left(F.col("text").cast("string"), F.lit(SAMPLE_CHARS)).alias("text")).head(SAMPLE)  # of the first files, without a shuffle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        held = [np.append(encode(t or ""), EOS) for b in batches for t in b.column(0).to_pylist()]
        raw = np.concatenate(held).astype("<u2").tobytes() if held else b""
        try:
            words = zstandard.train_dictionary(DICTIONARY, [raw[i : i + 2 * length] for i in range(0, len(raw), 2 * length)]).as_bytes() if len(raw) > 4 * DICTIONARY else b""
        except zstandard.ZstdError:  # nothing in it repeats
            words = b""
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.binary())], ["words"])

    if not some:
        return b""
    return docs.sparkSession.createDataFrame(some, "text string").coalesce(1).mapInArrow(run, "words binary").first().words


def _known(words: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(words) if words else None


def sequences(docs: DataFrame, json_path: str, ranks_path: str | None, length: int, words: bytes = b"") -> DataFrame:
    """(part, nth, tokens, payload): each task's documents, tokenised and joined by the end id, cut every `length` ids.
    payload is `length` little-endian unsigned 16-bit ids, as zstandard with the dictionary `words` since it is stored and shuffled; a
    task's last sequence is filled up with end ids. An id beyond 16 bits is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, nth = encoder(json_path, ranks_path), TaskContext.get().partitionId(), 0
        small = zstandard.ZstdCompressor(level=LEVEL, dict_data=_known(words)).compress
        held: list[np.ndarray] = []
        size = 0

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal held, size, nth
            ids = np.concatenate(held)
            if ids.max(initial=0) > 0xFFFF:
                raise ValueError("the vocabulary does not fit 16 bits")
            n = len(ids) // length
            rest = len(ids) - n * length
            rows = ids[: n * length].reshape(n, length)
            tokens = [length] * n
            held, size = ([] if last or not rest else [ids[n * length :]]), 0 if last else rest
            if last and rest:
                rows = np.vstack([rows, np.append(ids[n * length :], np.full(length - rest, EOS, ids.dtype))[None]])
                tokens.append(rest)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int64()), pa.array(range(nth, nth + len(rows)), pa.int64()), pa.array(tokens, pa.int32()), pa.array([small(r.astype("<u2").tobytes()) for r in rows], pa.binary())],
                schema=SEQUENCE,
            )
            nth += len(rows)
            return out

        for batch in batches:
            for text in batch.column(0):
                held += [encode(text.as_py() or ""), np.array([EOS], np.uint32)]
                size += len(held[-2]) + 1
                if size >= 256 * length:
                    yield cut(False)
        if size:
            yield cut(True)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part long, nth long, tokens int, payload binary")


def placed(docs: DataFrame, json_path: str, ranks_path: str | None = None, length: int = 2048, per_shard: int = 256, key: int = 20_240_601, shard_partitions: int | None = None, words: bytes = b"") -> DataFrame:
    """(shard, slot, tokens, payload) of all sequences() of `docs`, in training order within range partitions of shards.

    Sequences are written once to the shared folder and numbered by task and place; permute() gives each a slot in
    [0, N), so slots are spread evenly whatever the documents are.
    """
    saved = save(sequences(docs, json_path, ranks_path, length, words), "sequences")
    counts = {r.part: r.n for r in saved.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each task
    total, starts = 0, {}
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    begin = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def slot(part: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(permute(part.map(begin.value).to_numpy(np.int64) + nth.to_numpy(np.int64), total, key))

    rows = saved.select(slot("part", "nth").alias("slot"), "tokens", "payload").select(F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), "slot", "tokens", "payload")
    n = shard_partitions or max(1, min(-(-total // per_shard), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartitionByRange(n, "shard").sortWithinPartitions("slot")


def materialise(docs: DataFrame, json_path: str, ranks_path: str | None = None, length: int = 2048, per_shard: int = 256, key: int = 20_240_601, shard_partitions: int | None = None, folder: str | None = None) -> DataFrame:
    """Write every document's ids (null text: empty), once, in training order as raw files, and return a row for each:
    (shard, first_slot, n_sequences, n_tokens, stride, file, bytes, sha256). No documents give no shards.

    Shard s is shard-<s>.bin in `folder` (default: a new one in the shared folder): the slots from s*per_shard in
    order, stride bytes each, so slot g is at byte (g % per_shard) * stride of shard g // per_shard, and a reader seeks to
    where it resumes. A task writes its range of shards one sequence at a time, each file under a name of its own that
    is moved at the end, so a task that is run again, or twice, leaves the same files.
    """
    at = folder or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    stride, words = 2 * length, learned(docs, json_path, ranks_path, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(at)
        store.create_dir(base, recursive=True)
        large = zstandard.ZstdDecompressor(dict_data=_known(words)).decompress
        row, out, digest, part = None, None, None, ""

        def close() -> pa.RecordBatch:
            out.close()
            store.move(part, f"{base}/{row['file']}")
            return pa.RecordBatch.from_pylist([row | {"sha256": digest.hexdigest()}], schema=SHARD)

        for batch in batches:
            for s, g, n, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row is None or s != row["shard"]:
                    if row:
                        yield close()
                    row = {"shard": s, "first_slot": g, "n_sequences": 0, "n_tokens": 0, "stride": stride, "file": file_name(s), "bytes": 0}
                    part = f"{base}/{row['file']}.{TaskContext.get().taskAttemptId()}"
                    out, digest = store.open_output_stream(part), hashlib.sha256()
                ids = large(p)
                out.write(ids)
                digest.update(ids)
                row["n_sequences"] += 1
                row["n_tokens"] += n
                row["bytes"] += len(ids)
        if row:
            yield close()

    ordered = placed(docs, json_path, ranks_path, length, per_shard, key, shard_partitions, words)
    return ordered.mapInArrow(run, "shard long, first_slot long, n_sequences int, n_tokens long, stride int, file string, bytes long, sha256 string")


SHARD = pa.schema([
    ("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int32()), ("n_tokens", pa.int64()), ("stride", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()),
])


def file_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def _store(folder: str):
    """pyarrow's file system and the path in it of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def read_slots(spark: SparkSession, folder: str, start: int, stop: int, length: int = 2048, per_shard: int = 256) -> DataFrame:
    """(slot, ids) from `start` to before `stop`, in order: where a reader resumes, only the files needed are opened, and
    of each only the bytes needed are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, last = max(start, shard * per_shard), min(stop, (shard + 1) * per_shard)
                with store.open_input_file(f"{base}/{file_name(shard)}") as f:
                    f.seek((first - shard * per_shard) * 2 * length)
                    for g in range(first, last):
                        ids = np.frombuffer(f.read(2 * length), "<u2").astype(np.int32)
                        if len(ids):
                            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["slot", "ids"])

    shards = spark.range(start // per_shard, max(start, stop - 1) // per_shard + (stop > start))
    return shards.mapInArrow(run, "slot long, ids array<int>").orderBy("slot")

"""Token-ID / binary output: length-delimited records of token ids, with an offset index beside each file.

A record file holds frames ``length (u64) | masked crc of length (u32) | payload | masked crc of payload (u32)``,
all little-endian, with CRC-32C; the payload is ``doc_id (i64) | flags (u64) | ids``.  The index file beside it
holds an (offset, length) pair of u64 for each frame, so that records can be read in any order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, row_id, tasks, text_or_empty
from .tokens import encoder, slices

#: CRC-32C (Castagnoli), reflected polynomial; and the mask constant of the record format.
_POLYNOMIAL, _MASK_DELTA = 0x82F63B78, 0xA282EAD8
_BLOCK = 512  # bytes of a record that are summed in step with those of other records


def _word_table() -> np.ndarray:
    """CRC-32C of each 16-bit word after a zero register."""
    crc = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(_POLYNOMIAL), crc >> 1)
    return crc.astype(np.uint32)


_T = _word_table()


def _advance_table(n_bytes: int) -> np.ndarray:
    """What a register becomes after n_bytes zero bytes, as four tables of 256 for its four bytes."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n_bytes // 2):
        basis = _T[basis & 0xFFFF] ^ (basis >> 16)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            hit = (np.arange(256) >> bit) & 1 == 1
            out[byte, hit] ^= basis[8 * byte + bit]
    return out


_ADVANCE = _advance_table(_BLOCK)


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload of an even length of 4 bytes or more; blocks of all payloads are summed in step.

    The register's start value is xored into the first four bytes; then zero bytes before them change
    nothing, and each payload is filled up in front to whole blocks.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    if (sizes % 2).any() or sizes.min() < 4:
        raise ValueError("payloads of an odd length or under 4 bytes")
    block = min(_BLOCK, int(sizes.max()))
    blocks = -(-sizes // block)
    zeros = bytes(block)
    body = np.frombuffer(bytearray().join(x for p, n in zip(payloads, (blocks * block - sizes).tolist(), strict=True) for x in (zeros[:n], p)), "<u2").copy()
    first = np.cumsum(blocks) - blocks
    at = (first * block + blocks * block - sizes) // 2
    body[at] ^= 0xFFFF
    body[at + 1] ^= 0xFFFF
    columns = np.ascontiguousarray(body.reshape(-1, block // 2).T)
    own = np.zeros(columns.shape[1], np.uint32)
    for k in range(block // 2):
        own = _T[(own ^ columns[k]) & 0xFFFF] ^ (own >> 16)
    order = np.argsort(-blocks, kind="stable")
    state, deepest = own[first], blocks[order]
    for k in range(1, int(deepest[0])):
        live = order[: np.searchsorted(-deepest, -k)]  # those with more than k blocks
        s = state[live]
        s = _ADVANCE[0, s & 255] ^ _ADVANCE[1, (s >> 8) & 255] ^ _ADVANCE[2, (s >> 16) & 255] ^ _ADVANCE[3, s >> 24]
        state[live] = s ^ own[first[live] + k]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> 15) | (crc << 17)) + np.uint32(_MASK_DELTA)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4").tobytes(), masked(crc32c(payloads)).astype("<u4").tobytes()
    return [b"".join((h, a[4 * i : 4 * i + 4], p, b[4 * i : 4 * i + 4])) for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def unframed(data: list[bytes]) -> list[bytes]:
    """The payloads of whole frames; a wrong length or checksum raises."""
    payloads = []
    for f in data:
        n = int.from_bytes(f[:8], "little")
        if n != len(f) - 16:
            raise ValueError(f"a frame of {len(f)} bytes names a payload of {n}")
        payloads.append(f[12:-4])
    for parts, at in (([f[:8] for f in data], slice(8, 12)), (payloads, slice(-4, None))):
        stored = np.array([int.from_bytes(f[at], "little") for f in data], np.uint32)
        if not np.array_equal(masked(crc32c(parts)), stored):
            raise ValueError("a record's checksum is wrong")
    return payloads


def _write_shard(batches: Iterator[pa.RecordBatch], out: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Write one range of documents to its own file; the file gets its name when it is whole."""
    context = TaskContext.get()
    shard, enc = context.partitionId(), encoder(path)
    store, root = fs.FileSystem.from_uri(out)
    final, work = f"{root}/part-{shard:06d}", f"{root}/_tmp-{shard:06d}-{context.taskAttemptId()}"
    end = np.array([end_id], enc.dtype).tobytes()
    offset = records = tokens = 0
    with store.open_output_stream(f"{work}.rec") as data, store.open_output_stream(f"{work}.idx") as index:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                payloads = []
                for doc_id, encoded in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    head = (0 if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + int(doc_id is None).to_bytes(8, "little")
                    payloads.append(head + encoded + end)
                    tokens += len(encoded) // enc.dtype.itemsize + 1
                written = frames(payloads)
                sizes = np.array([len(f) for f in written], "<u8")
                starts = offset + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8")
                index.write(np.stack([starts, sizes], 1).astype("<u8").tobytes())
                data.write(b"".join(written))
                offset += int(sizes.sum())
                records += len(written)
    for kind in ("rec", "idx"):
        store.move(f"{work}.{kind}", f"{final}.{kind}")
    yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [records], "tokens": [tokens]}, pa.schema([("shard", pa.int64()), ("records", pa.int64()), ("tokens", pa.int64())]))


def write_records(docs: DataFrame, path: str, out: str | None = None, shards: int | None = None, end_id: int = 0) -> tuple[str, list[tuple[int, int, int]]]:
    """Write the ids of every whole text, and ``end_id`` after each, in ascending doc_id order.

    Returns the folder and (shard, records, tokens) of each shard; a manifest in the folder says the same.
    Rows are range-partitioned by (doc_id, hash of text), so repeated ids spread over files; a null doc_id
    comes first, a null text is empty, equal ids go by the hash of their text; an empty table gives no file.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "records")
    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = row_id("text")
    ordered = rows.repartitionByRange(shards or tasks(spark), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    done = ordered.mapInArrow(lambda b: _write_shard(b, out, path, end_id), "shard long, records long, tokens long")
    found = sorted((r["shard"], r["records"], r["tokens"]) for r in done.collect())  # a row a file
    width = encoder(path).dtype.itemsize
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"id_bytes": width, "end_id": end_id, "shards": found}).encode())
    return out, found


def _read_shards(batches: Iterator[pa.RecordBatch], out: str, width: int) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(out)
    kind = np.dtype(f"<u{width}")
    for batch in batches:
        for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_file(f"{root}/part-{shard:06d}.idx") as f:
                index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
            with store.open_input_file(f"{root}/part-{shard:06d}.rec") as f:
                at = 0
                while at < len(index):
                    stop = at + max(1, int(np.searchsorted(index[at:, 0], index[at, 0] + (4 << 20))))
                    f.seek(int(index[at, 0]))
                    data = f.read(int(index[stop - 1].sum() - index[at, 0]))
                    first = int(index[at, 0])
                    got = unframed([data[o - first : o - first + n] for o, n in index[at:stop].tolist()])
                    ids = [None if p[8] else int.from_bytes(p[:8], "little", signed=True) for p in got]
                    counts = [(len(p) - 16) // width for p in got]
                    crcs = [zlib.crc32(np.frombuffer(p, kind, offset=16).astype("<u4").tobytes()) for p in got]
                    starts = base + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                    base += sum(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = stop


def read_records(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of a folder, each file by its own task, checksums checked."""
    store, root = fs.FileSystem.from_uri(out)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    bases, total = [], 0
    for shard, records, tokens in manifest["shards"]:
        if records:
            bases.append((shard, total))
        total += tokens
    width = manifest["id_bytes"]
    todo = spark.createDataFrame(bases, "shard long, base long").repartition(max(1, len(bases)))
    return todo.mapInArrow(lambda b: _read_shards(b, out, width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_record(out: str, shard: int, number: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """One record through the index: a shuffled read."""
    store, root = fs.FileSystem.from_uri(out)
    with store.open_input_file(f"{root}/part-{shard:06d}.idx") as f:
        f.seek(16 * number)
        offset, size = np.frombuffer(f.read(16), "<u8").tolist()
    with store.open_input_file(f"{root}/part-{shard:06d}.rec") as f:
        f.seek(offset)
        payload = unframed([f.read(size)])[0]
    return None if payload[8] else int.from_bytes(payload[:8], "little", signed=True), np.frombuffer(payload, f"<u{width}", offset=16)

"""Media columns: text as 8-bit sound, its log-mel features as fixed-shape tensors with time spans.

A payload of bytes is stored as the samples of a WAV file and read back.  Features come from the samples:
polyphase resampling by UP / DOWN, overlapped Hann frames, log-mel filterbanks, and segments of the frame
energy between two thresholds.  They are stored beside the sound: the log-mel rows in blocks of one shape,
each with its span of time, and the segments with theirs.  Sound of any length is worked through in parts of
PART samples.  All sums run in double precision and in a fixed order, never in a threaded library, so that
every machine finds the same bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Samples a second, the resampling ratio, and samples that one step works on (a multiple of all the rest).
RATE, UP, DOWN, PART = 8000, 3, 4, 192 * 4096
#: Frame and hop in resampled samples, filterbanks, frames of a tensor, taps of a resampling phase.
FRAME, HOP, BANDS, TENSOR_FRAMES, TAPS = 256, 128, 20, 16, 16
#: Energy in dB above which a segment begins and below which it ends.
BEGIN_DB, END_DB = -7.0, -8.0
UNIT, FLOOR = 192, 1e-6


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 filled with spaces to a positive multiple of UNIT, and the length before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT)), len(raw)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples, a byte each."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit WAV file with one channel; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit samples of one channel")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _phases() -> np.ndarray:
    """The low-pass filter of the resampler, a row of TAPS for each of UP phases."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(t * cut) * cut * np.hamming(n) * UP
    return h.reshape(TAPS, UP).T[:, ::-1].copy()


def _mel_bank() -> np.ndarray:
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), BANDS + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    bins = np.linspace(0, top, FRAME // 2 + 1)
    up = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down))


_PHASES, _MEL, _HANN = _phases(), _mel_bank(), np.hanning(FRAME)


def resampled(x: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Outputs start to stop (start a multiple of UP) of ``x`` at UP / DOWN of its rate; beyond its ends ``x`` is silent."""
    count = stop - start
    whole = -(-count // UP)
    first = start // UP * DOWN - TAPS // 2
    last = first + (whole - 1) * DOWN + DOWN + TAPS
    part = np.zeros(last - first)
    a, b = max(first, 0), min(last, len(x))
    if b > a:
        part[a - first : b - first] = x[a:b]
    out = np.empty((whole, UP))
    for r in range(UP):
        # output UP * k + r lies at input DOWN * k + r * DOWN / UP
        move, phase = divmod(r * DOWN, UP)
        rows = np.lib.stride_tricks.sliding_window_view(part[move + 1 :], TAPS)[::DOWN][:whole]
        out[:, r] = np.einsum("ij,j->i", rows, _PHASES[phase])
    return out.ravel()[:count]


def log_mel(samples: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-mel rows, frame energies in dB) of the sound, part by part; a frame begins each HOP samples."""
    raw = np.frombuffer(samples, np.uint8)
    total = len(raw) * UP // DOWN
    frames = max(1, -(-total // HOP))
    step = PART * UP // DOWN // HOP
    for f in range(0, frames, step):
        n = min(step, frames - f)
        a, b = f * HOP, (f + n - 1) * HOP + FRAME
        lo = max(0, a // UP * DOWN - TAPS)
        hi = min(len(raw), b // UP * DOWN + DOWN + TAPS)
        shift = lo // DOWN * DOWN  # only the part's own samples are turned into numbers
        x = (raw[shift:hi].astype(np.float64) - 128) / 128
        y = resampled(x, a - shift // DOWN * UP, b - shift // DOWN * UP)
        end = max(0, min(len(y), total - a))
        y[end:] = 0
        rows = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(rows * _HANN, axis=1)) ** 2
        mel = np.log10(np.maximum(np.einsum("ij,jk->ik", power, _MEL), FLOOR)).astype(np.float32)
        yield mel, (10 * np.log10(np.maximum(np.einsum("ij,ij->i", rows, rows) / FRAME, FLOOR))).astype(np.float32)


def segments(db: np.ndarray, begin: float = BEGIN_DB, end: float = END_DB) -> np.ndarray:
    """(first, past last) frames of segments: on from a frame above ``begin`` until one below ``end``."""
    mark = np.where(db > begin, 1, np.where(db < end, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(db)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


#: Frames a second.
PACE = RATE * UP / DOWN / HOP
#: Columns of the stored features: the frames' number, the tensors one after the other with the spans of their frames, the segments' spans.
FEATURES = "n_frames long, log_mel array<float>, block_start_s array<double>, block_end_s array<double>, segment_start_s array<double>, segment_end_s array<double>"


def features(samples: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES of one sound: frames past the end of the last tensor hold the floor."""
    mels, levels = zip(*log_mel(samples), strict=True)
    mel, spans = np.vstack(mels), segments(np.concatenate(levels))
    n = len(mel)
    blocks = -(-n // TENSOR_FRAMES)
    filled = np.full((blocks * TENSOR_FRAMES, BANDS), np.log10(FLOOR), np.float32)
    filled[:n] = mel
    at = np.arange(blocks) * TENSOR_FRAMES
    return n, filled.ravel(), at / PACE, np.minimum(at + TENSOR_FRAMES, n) / PACE, spans[:, 0] / PACE, spans[:, 1] / PACE


def described(n_frames: int, log_mel_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Stored features in short: frames, segments, seconds in segments, mean and spread of each band over all frames."""
    mel = log_mel_.reshape(-1, BANDS)[:n_frames].astype(np.float64)
    mean = np.add.reduce(mel, axis=0) / n_frames
    spread = np.sqrt(np.add.reduce((mel - mean) ** 2, axis=0) / n_frames)
    numbers = ",".join(f"{m:.2f}~{s:.2f}" for m, s in zip(mean, spread, strict=True))
    return f"frames={n_frames};segments={len(starts)};seconds={float(np.sum(ends - starts)):.2f};mel={numbers}"


def _feature_arrays(found: list[tuple]) -> list[pa.Array]:
    """One Arrow array for each of FEATURES."""
    out = [pa.array([f[0] for f in found], pa.int64())]
    for k in range(1, 6):
        parts = [f[k] for f in found]
        kind = pa.float32() if k == 1 else pa.float64()
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind)))
    return out


_NAMES = ["n_frames", "log_mel", "block_start_s", "block_end_s", "segment_start_s", "segment_end_s"]


def _by_size(values: list, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of bounded total length, one value at least."""
    start = size = 0
    for i, v in enumerate(values):
        size += len(v or b"")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in _by_size(texts):
            seen: dict[str, tuple] = {}
            rows = []
            for text in texts[i:j]:
                text = text or ""
                if text not in seen:
                    payload, n = payload_of(text)
                    media = to_wav(payload)
                    seen[text] = (n, media, features(from_wav(media)[0]))
                rows.append(seen[text])
            plain = [batch.column(0).slice(i, j - i), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*plain, *_feature_arrays([r[2] for r in rows])], names=["doc_id", "n_bytes", "media", *_NAMES])


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media and FEATURES) of every row: each text as a sound file with its tensors and segments.

    Null text is empty and becomes UNIT spaces.  Equal texts have equal values; repeated rows repeat them, and
    a null id stays null.  Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stored_rows, "doc_id long, n_bytes long, media binary, " + FEATURES)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        media = batch.column(2).to_pylist()
        mel, starts, ends = batch.column("log_mel"), batch.column("segment_start_s"), batch.column("segment_end_s")
        frames = batch.column("n_frames").to_pylist()
        out: list[list] = [[] for _ in kinds]
        for i, m in enumerate(media):
            back, _ = from_wav(m)
            short = described(frames[i], *(column[i].values.to_numpy() for column in (mel, starts, ends)))
            for column, value in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), short), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)


def media_digests(media: DataFrame) -> DataFrame:
    """Lengths and hashes of payload and file and the features in short, read from rows of ``media_columns``."""
    return media.mapInArrow(_digest_rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    """Each text's media column with its tensors, written to the shared folder, read back and described.

    Null text is empty and becomes UNIT spaces.  Equal texts have equal values; repeated rows repeat them.
    """
    return media_digests(stored(media_columns(docs), "media"))


def feature_tensors(media: DataFrame) -> DataFrame:
    """(doc_id, block, start_s, end_s, log_mel) of rows of ``media_columns``: a row for each tensor."""
    size = TENSOR_FRAMES * BANDS
    blocks = media.select("doc_id", "log_mel", "block_end_s", F.posexplode("block_start_s").alias("block", "start_s"))
    return blocks.select("doc_id", "block", "start_s", F.get("block_end_s", "block").alias("end_s"), F.slice("log_mel", F.col("block") * size + 1, F.lit(size)).alias("log_mel"))


def as_tensor_array(column: pa.ChunkedArray | pa.Array) -> pa.ExtensionArray:
    """A ``log_mel`` column, of whole sounds or of blocks, as an Arrow array of all its fixed-shape tensors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    storage = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), TENSOR_FRAMES * BANDS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, BANDS)), storage)

"""Media columns: audio features.

A payload is stored losslessly as 8-bit mono PCM in a RIFF/WAVE file, read back,
resampled with a polyphase filter, turned into overlapped log-mel filterbanks and
cut into energy segments with hysteresis, each with its time span. The filterbanks
are stored as an Arrow table of fixed-shape tensors, one row a window of frames, with
its time span. Frames cover the signal to its last sample, the last one filled up
with silence.

Defined results: a null text counts as empty; an empty text is one unit of padding.
Equal texts give equal bytes in every column, as each text is computed by itself
and its features are rounded. Null ids, repeated rows and further columns pass
through; an empty table gives an empty result. Long texts are computed whole, a
block of frames at a time.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

UNIT = 576
PAD = b"\xff"
RATE = 16_000
#: The signal is resampled by UP / DOWN before the filterbanks.
UP, DOWN, TAPS = 5, 8, 16
FRAME, HOP, FFT, MELS = 250, 100, 256, 24
#: Frames of a tensor.
WINDOW = 64
#: Frames computed at a time.
BLOCK = 4096
#: A segment begins above the upper level and ends below the lower one (log energy).
UPPER, LOWER = -1.6, -1.9


def encode_wave(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM, one sample a byte."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def decode_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono PCM file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM is expected")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _taps(up: int, down: int) -> np.ndarray:
    """A windowed-sinc low-pass at the lower of both rates, of odd length."""
    n = TAPS * max(up, down) + 1
    x = np.arange(n) - n // 2
    cut = 1 / max(up, down)
    taps = np.sinc(x * cut) * cut * np.kaiser(n, 6.0)
    return taps * (up / taps.sum())


@functools.cache
def _phases(up: int, down: int) -> np.ndarray:
    """[up, taps of a phase], each backwards: phase p has the taps p, p + up, ..."""
    taps = _taps(up, down)
    full = np.r_[taps, np.zeros(-len(taps) % up)]
    return np.ascontiguousarray(full.reshape(-1, up).T[:, ::-1])


def resample(signal: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """By up / down. Output k takes one phase of the filter alone: the samples that
    a plain interpolation would insert or drop are never computed."""
    phases = _phases(up, down)
    width, delay = phases.shape[1], len(_taps(up, down)) // 2
    total = -(-len(signal) * up // down)
    reach = delay // up + down + 1
    padded = np.concatenate([np.zeros(width - 1), signal, np.zeros(reach)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width)  # view b ends with sample b
    out = np.empty(total)
    for p in range(min(up, total)):
        at = p * down + delay
        n = len(range(p, total, up))
        out[p::up] = views[at // up :: down][:n] @ phases[at % up]
    return out


@functools.cache
def _mel_bank(rate: int) -> np.ndarray:
    """[FFT bins, MELS] triangles, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    bank = np.minimum((bins[:, None] - left) / (mid - left), (right - bins[:, None]) / (right - mid))
    return np.maximum(bank, 0).astype(np.float32)


@functools.cache
def _hann() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(signal: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """[frames, MELS] rounded log filterbank energies, and each frame's log energy."""
    n = max(0, -(-(len(signal) - FRAME) // HOP)) * HOP + FRAME
    signal = np.concatenate([signal, np.zeros(n - len(signal), signal.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(signal.astype(np.float32), FRAME)[::HOP]
    mels, energy = [], []
    for k in range(0, len(frames), BLOCK):
        part = frames[k : k + BLOCK]
        power = np.abs(np.fft.rfft(part * _hann(), FFT, axis=1)).astype(np.float32) ** 2
        mels.append(np.round(np.log(power @ _mel_bank(rate) + 1e-6), 2).astype(np.float32))
        energy.append(np.round(np.log10((part.astype(np.float64) ** 2).mean(axis=1) + 1e-9), 3))
    return np.concatenate(mels) + np.float32(0), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames, end exclusive: one begins where the energy rises above UPPER
    and goes on until it falls below LOWER."""
    state = np.where(energy > UPPER, 1, np.where(energy < LOWER, 0, -1))
    known = np.flatnonzero(state >= 0)
    last = np.zeros(len(energy), np.int64)
    last[known] = known
    np.maximum.accumulate(last, out=last)
    on = np.where(state[last] == 1, 1, 0)
    edge = np.flatnonzero(np.diff(np.r_[0, on, 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def tensors(mels: np.ndarray, rate: int) -> bytes:
    """An Arrow stream: a row a window of WINDOW frames (the last is filled up with
    zeros), its first and last second, its own number of frames, the tensor."""
    n = len(mels)
    windows = -(-n // WINDOW)
    full = np.zeros((windows * WINDOW, MELS), np.float32)
    full[:n] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS), dim_names=("frame", "mel"))
    data = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), WINDOW * MELS)
    first = np.arange(windows) * WINDOW
    last = np.minimum(first + WINDOW, n)
    batch = pa.record_batch(
        {
            "start_s": pa.array(first * HOP / rate),
            "end_s": pa.array(((last - 1) * HOP + FRAME) / rate),
            "frames": pa.array(last - first, pa.int32()),
            "mel": pa.ExtensionArray.from_storage(kind, data),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def spans(found: list[tuple[int, int]], rate: int, n: int) -> list[tuple[float, float]]:
    """First and last second of runs of frames; ``n``: samples of the signal."""
    return [(a * HOP / rate, min((b - 1) * HOP + FRAME, n) / rate) for a, b in found]


def features(media: bytes) -> tuple[bytes, bytes, list[tuple[float, float]]]:
    """Payload read back, tensors, and energy segments in seconds."""
    payload, rate = decode_wave(media)
    signal = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    low = resample(signal)
    mels, energy = log_mel(low, rate * UP // DOWN)
    return payload, tensors(mels, rate * UP // DOWN), spans(segments(energy), rate * UP // DOWN, len(low))


def payload_of(text: bytes) -> bytes:
    return text + PAD * (-len(text) % UNIT if text else UNIT)


MEDIA = T.StructType([T.StructField(n, k) for n, k in (("media", T.BinaryType()), ("payload", T.BinaryType()), ("tensors", T.BinaryType()), ("segments", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))), ("n_bytes", T.LongType()))])


@F.arrow_udf(MEDIA)
def audio_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = (pa.binary(), pa.binary(), pa.binary(), span, pa.int64())
    for texts in batches:
        for k in range(0, len(texts), 512):  # files are far larger than rows usually are: a few at a time
            out: list[list] = [[], [], [], [], []]
            for x in texts.slice(k, 512).cast(pa.binary()).to_pylist():
                text = x or b""
                media = encode_wave(payload_of(text))
                payload, stored, found = features(media)
                for column, value in zip(out, (media, payload, stored, [{"start_s": a, "end_s": b} for a, b in found], len(text))):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], MEDIA.names)


def audio_features(docs: DataFrame, text_col: str = "text", into: str = "__media") -> DataFrame:
    """``docs`` with a struct named ``into``: the stored file, the payload read back
    from it, the tensors (see read_tensors), the segments and the unpadded length."""
    return docs.withColumn(into, audio_udf(docs[text_col]))


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("__media")
    made = audio_features(docs).select(
        "doc_id",
        m["n_bytes"].alias("n_bytes"),
        F.length(m["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(m["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(m["payload"], -32, 32)).alias("tail_crc32"),
        F.length(m["media"]).cast("long").alias("media_bytes"),
        F.sha2(m["media"], 256).alias("media_sha256"),
        m["tensors"].alias("tensors"),
        m["segments"].alias("segments"),
    )
    # the tensors and spans are stored; what is returned of them is read back
    stored = materialise(made, "audio")
    seconds = F.transform("segments", lambda x: F.concat_ws("-", F.format_number(x["start_s"], 3), F.format_number(x["end_s"], 3)))
    feature = F.concat_ws(":", F.sha2("tensors", 256), F.array_join(seconds, ","))
    return stored.select(*[c for c in stored.columns if c not in ("tensors", "segments")], feature.alias("feature"), F.size("segments").alias("n_segments"))

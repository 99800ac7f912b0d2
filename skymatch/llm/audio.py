"""Media columns: 8-bit audio, stored losslessly and described by fixed-shape tensors.

`encode` wraps bytes as an 8-bit mono WAV in a binary column. `describe` reads
the stored bytes back and computes, per row:

- polyphase resampling from 8000 to 6000 Hz: a windowed-sinc filter split into
  one short filter per output phase, so no sample is computed to be thrown away;
- log-mel energies of overlapped Hann windows (256 samples, every 128);
- voiced spans by hysteresis on the energy: a span opens above the upper
  threshold and closes below the lower one, both relative to the row's own mean;
- a tensor of fixed shape (slots, mels): energies averaged over even slots of time.

A row is worked through in blocks of frames, so memory is a few times its bytes.

Defined results: a null or empty text is 64 zero bytes; a null id stays;
repeated rows give equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

RATE, UP, DOWN, TAPS = 8000, 3, 4, 24
FRAME, HOP, MELS, SLOTS = 256, 128, 24, 8
PAD = 64
#: Frames that are transformed at once.
BLOCK = 4096


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % PAD if raw else PAD)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE with unsigned 8-bit mono PCM; the length is even, as the format asks."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def samples(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono WAV, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _filters() -> np.ndarray:
    """(taps / DOWN, DOWN, UP): each output phase's filter over groups of DOWN input samples."""
    out = np.zeros((TAPS, UP))
    for phase in range(UP):
        centre = phase * DOWN / UP + TAPS / 2 - DOWN
        n = np.arange(TAPS) - centre
        out[:, phase] = np.sinc(n * UP / DOWN) * (0.5 + 0.5 * np.cos(np.pi * np.clip(n / (TAPS / 2), -1, 1)))
    return (out / out.sum(axis=0)).reshape(TAPS // DOWN, DOWN, UP).astype("f4")


def _mels(rate: float) -> np.ndarray:
    """(FRAME / 2 + 1, MELS) triangles, even on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype("f4")


FILTERS, WINDOW, BANK = _filters(), np.hanning(FRAME).astype("f4"), _mels(RATE * UP / DOWN)


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times as many samples, centred on the input; silence beyond its ends."""
    groups = -(-len(x) // DOWN)
    reach = TAPS // DOWN
    held = np.zeros((groups + reach) * DOWN, "f4")
    lead = TAPS // 2 - DOWN
    held[lead : lead + len(x)] = x
    held = held.reshape(-1, DOWN)
    return sum(held[k : k + groups] @ FILTERS[k] for k in range(reach)).reshape(-1)


def log_mels(x: np.ndarray) -> np.ndarray:
    """(frames, MELS): at least one frame; the last is filled with silence."""
    frames = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    held = np.zeros((frames - 1) * HOP + FRAME, "f4")
    held[: len(x)] = x[: len(held)]
    view = np.lib.stride_tricks.sliding_window_view(held, FRAME)[::HOP]
    parts = []
    for k in range(0, frames, BLOCK):
        power = np.abs(np.fft.rfft(view[k : k + BLOCK] * WINDOW, axis=1)) ** 2
        parts.append(np.log10(power.astype("f4") @ BANK + 1e-6))
    return np.concatenate(parts)


def hysteresis(level: np.ndarray, low: float, high: float) -> np.ndarray:
    """(spans, 2): first and last + 1 frames of the spans that open above ``high`` and close below ``low``."""
    mark = np.where(level > high, 1, np.where(level < low, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (known >= 0) & (mark[known] == 1)
    edge = np.diff(np.concatenate([[0], on.astype("i1"), [0]]))
    return np.stack([np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]], axis=1)


def describe_samples(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(SLOTS, MELS) tensor and (spans, 2) times in seconds."""
    mels = log_mels(resample((np.frombuffer(raw, "u1").astype("f4") - 128) / 128))
    level = mels.mean(axis=1)
    spans = hysteresis(level, float(level.mean()) - 0.05, float(level.mean()) + 0.05)
    cuts = np.linspace(0, len(mels), SLOTS + 1).astype(int)
    tensor = np.stack([mels[a : max(b, a + 1)].mean(axis=0) for a, b in zip(np.minimum(cuts[:-1], len(mels) - 1), cuts[1:], strict=True)])
    return tensor, spans * (HOP / (RATE * UP / DOWN))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: the text's bytes as a WAV column."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(1).to_pylist()
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                media = [wav(payload(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return batched(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Figures, tensors and spans of ``(doc_id, n_bytes, media)``, from the stored bytes.

    ``tensor`` holds SLOTS x MELS values by row, the storage of an Arrow tensor
    of that fixed shape, which the column's metadata name and `tensors` restores;
    ``spans`` are (start_s, end_s).
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensor", "spans"]
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                stored = part.column(2).to_pylist()
                raw = [samples(m)[1] for m in stored]
                found = [describe_samples(r) for r in raw]
                shaped = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack([t for t, _ in found]).astype("f4"))
                tensor = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SLOTS * MELS, pa.int32()), shaped.storage.flatten())
                spans = pa.array([[{"start_s": a, "end_s": b} for a, b in s.tolist()] for _, s in found], span)
                sha = lambda all_: pa.array([hashlib.sha256(x).hexdigest() for x in all_], pa.string())
                sizes = lambda all_: pa.array([len(x) for x in all_], pa.int64())
                tail = pa.array([zlib.crc32(r[-PAD:]) for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes(raw), sha(raw), tail, sizes(stored), sha(stored), tensor, spans], names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensor array<float>, spans array<struct<start_s:double,end_s:double>>"
    found = batched(media.select("doc_id", "n_bytes", "media")).mapInArrow(run, schema)
    return found.withMetadata("tensor", {"shape": [SLOTS, MELS]})


def tensors(column: pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """The column ``tensor`` of a described table (``toArrow()``, or read from Parquet) as an Arrow array of tensors of fixed shape."""
    held = column.combine_chunks()
    if len(held) and set(pa.compute.list_value_length(held).unique().to_pylist()) != {SLOTS * MELS}:
        raise ValueError(f"not tensors of shape {SLOTS} x {MELS}")
    storage = pa.FixedSizeListArray.from_arrays(held.flatten(), SLOTS * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [SLOTS, MELS]), storage)


def feature_digest(described: DataFrame) -> DataFrame:
    """``feature``: shape, rounded mean energy by slot, number of spans and voiced seconds, as text."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.format_number(F.aggregate(F.slice("tensor", k * MELS + 1, F.lit(MELS)), F.lit(0.0), lambda a, x: a + x) / MELS, 3))
    voiced = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"])
    text = F.concat_ws(";", F.lit(f"{SLOTS}x{MELS}"), F.array_join(slots, ","), F.size("spans").cast("string"), F.format_number(voiced, 3))
    return described.withColumn("feature", text)

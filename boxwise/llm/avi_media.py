"""Operator 3: AVI motion-JPEG media columns.

A payload of bytes is stored in the format's own unit, the quantised DCT coefficient: each byte is one coefficient of JPEG's size
category 8, whose eight magnitude bits are the byte itself, 64 to a block, each block its own restart interval. So the file is a baseline
JPEG stream that any decoder can open, and reading it back is lossless. Reading parses the RIFF tree and its index, decodes the entropy-coded
data and the pixels of every intra frame, and splits the film where the difference of grey histograms exceeds an adaptive limit.

Edge cases: a null text is an empty text (one block of zeros); equal texts give equal bytes; a file that breaks the format raises
ValueError; repeated rows give equal rows; further columns are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import text_blocks

UNIT = 64
FPS = 25
#: Blocks in a row and in a full frame.
ACROSS, FRAME_BLOCKS = 8, 64
BINS = 32
_BLOCK_BYTES = UNIT * 9 // 8
_ZIGZAG = np.array([8 * r + c for _, _, r, c in sorted((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8))])
_K = np.arange(8)
_DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(height: int, width: int) -> bytes:
    one_symbol = bytes([1] + [0] * 15 + [8])  # a code of one bit for size category 8
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + one_symbol) + _segment(0xC4, b"\x10" + one_symbol) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")


def _scans(blocks: np.ndarray, per_frame: int) -> list[bytes]:
    """Entropy-coded data of each frame of so many blocks of 64 bytes."""
    bits = np.zeros((blocks.size, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(blocks.reshape(-1, 1), axis=1)
    packed = np.packbits(bits.ravel())
    full = packed == 0xFF
    stuffed = np.repeat(packed, 1 + full)
    stuffed[np.flatnonzero(full) + np.cumsum(full)[full]] = 0
    lengths = _BLOCK_BYTES + full.reshape(-1, _BLOCK_BYTES).sum(axis=1)
    out = np.zeros(len(stuffed) + 2 * len(blocks), np.uint8)
    out[np.arange(len(stuffed)) + 2 * np.repeat(np.arange(len(blocks)), lengths)] = stuffed
    ends = np.cumsum(lengths + 2)
    out[ends - 2] = 0xFF
    out[ends - 1] = 0xD0 + np.arange(len(blocks)) % per_frame % 8
    last = ends[per_frame - 1 :: per_frame]
    return [out[a : b - 2].tobytes() for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(parts))


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a positive multiple of 64 bytes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    per_frame = FRAME_BLOCKS if len(blocks) > FRAME_BLOCKS else -(-len(blocks) // ACROSS) * ACROSS
    missing = -len(blocks) % per_frame
    blocks = np.concatenate([blocks, np.zeros((missing, UNIT), np.uint8)]) if missing else blocks
    width, height = 8 * ACROSS, 8 * per_frame // ACROSS
    head = _head(height, width)
    frames = [_chunk(b"00dc", head + scan + b"\xff\xd9") for scan in _scans(blocks, per_frame)]
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", form)))
    note = _list(b"INFO", _chunk(b"ICMT", str(len(payload)).encode() + b"\0"))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, struct.unpack_from("<I", f, 4)[0]))
        at += len(f)
    body = b"AVI " + header + note + _list(b"movi", *frames) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the bodies between two places; a list is named by its kind."""
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, at)
        if at + 8 + n > end:
            raise ValueError("a chunk ends beyond its parent")
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, at + 8 + n
        else:
            yield name, at + 8, at + 8 + n
        at += 8 + n + n % 2


def read_frames(avi: bytes) -> tuple[list[bytes], int]:
    """The frames that the index names, and the payload's length."""
    top = {k: (a, b) for k, a, b in _chunks(avi, 0, len(avi))}
    if b"AVI " not in top:
        raise ValueError("not an AVI file")
    parts = {k: (a, b) for k, a, b in _chunks(avi, *top[b"AVI "])}
    for k in (b"movi", b"idx1", b"INFO"):
        if k not in parts:
            raise ValueError(f"no {k.decode()} in the file")
    note = {k: (a, b) for k, a, b in _chunks(avi, *parts[b"INFO"])}[b"ICMT"]
    base = parts[b"movi"][0] - 4
    frames = []
    for name, _, at, n in struct.iter_unpack("<4sIII", avi[slice(*parts[b"idx1"])]):
        if name == b"00dc":
            frames.append(avi[base + at + 8 : base + at + 8 + n])
    return frames, int(avi[slice(*note)].rstrip(b"\0"))


def decode_frame(jpeg: bytes) -> tuple[int, int, bytes]:
    """(height, width, coefficient bytes in coding order) of a frame."""
    at, height, width = 2, 0, 0
    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("a frame isn't a JPEG image")
    while True:
        mark, n = struct.unpack_from(">xBH", jpeg, at)
        if mark == 0xC0:
            height, width = struct.unpack_from(">HH", jpeg, at + 5)
        at += 2 + n
        if mark == 0xDA:
            break
    scan = jpeg[at:-2]
    for k in range(8):  # after a stuffed byte no 0xFF stands before one of these
        scan = scan.replace(bytes([0xFF, 0xD0 + k]), b"")
    bits = np.unpackbits(np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)).reshape(-1, 9)
    if bits[:, 0].any() or len(bits) != height * width:
        raise ValueError("the scan holds other codes than its tables")
    return height, width, np.packbits(bits[:, 1:], axis=1).tobytes()


def pixels(coded: bytes, height: int, width: int) -> np.ndarray:
    """Grey samples of a frame, by the inverse DCT."""
    values = np.frombuffer(coded, np.uint8).astype(np.float32)
    values = np.where(values >= 128, values, values - 255).reshape(-1, UNIT)
    natural = np.empty_like(values)
    natural[:, _ZIGZAG] = values
    blocks = _DCT.T @ natural.reshape(-1, 8, 8) @ _DCT
    grey = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8)
    return grey.reshape(height // 8, width // 8, 8, 8).swapaxes(1, 2).reshape(height, width)


def shots(histograms: np.ndarray, memory: int = 8, factor: float = 2.5, least: float = 0.02) -> list[int]:
    """Frames that begin a shot: the difference to the frame before exceeds the recent mean by so many deviations."""
    starts, recent = [0], []
    for k in range(1, len(histograms)):
        d = float(np.abs(histograms[k] - histograms[k - 1]).sum() / 2)
        if len(recent) >= 3 and d > max(least, np.mean(recent) + factor * np.std(recent)):
            starts.append(k)
            recent = []
        else:
            recent = (recent + [d])[-memory:]
    return starts


def analyse(avi: bytes) -> tuple[bytes, list[tuple[float, float, int, float]]]:
    """The payload as read back, and (start second, end second, frames, mean grey) of each clip."""
    frames, length = read_frames(avi)
    coded, histograms, greys = [], [], []
    for f in frames:
        height, width, data = decode_frame(f)
        coded.append(data)
        grey = pixels(data, height, width)
        histograms.append(np.bincount(grey.ravel() // (256 // BINS), minlength=BINS) / grey.size)
        greys.append(float(grey.mean()))
    payload = b"".join(coded)
    if length > len(payload):
        raise ValueError("the frames hold less than the payload")
    begins = shots(np.array(histograms))
    ends = [*begins[1:], len(frames)]
    return payload[:length], [(a / FPS, b / FPS, b - a, round(sum(greys[a:b]) / (b - a), 3)) for a, b in zip(begins, ends, strict=True)]


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the AVI file of each text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(b) for b in data], pa.int64()), pa.array([write_avi(pad(b)) for b in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> one row per clip: doc_id, clip, start_s, end_s, n_frames, grey."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), k, *c) for i, m in zip(batch.column(0), batch.column(1), strict=True) if m.as_py() is not None for k, c in enumerate(analyse(m.as_py())[1])]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "clip", "start_s", "end_s", "n_frames", "grey"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, n_frames int, grey double")


def read_back(docs: DataFrame) -> DataFrame:
    """Digests of what is stored and read back, with the clips as the feature; encoding and reading share a pass."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                media = write_avi(pad(data))
                payload, found = analyse(media)
                feature = ";".join(f"{a:.2f}-{b:.2f}:{n}:{g:.3f}" for a, b, n, g in found)
                rows.append((i, len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Media columns: texts stored losslessly as PNG images, read back with checksum tests, hashed by a cosine transform."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payloads fill rows of 64 RGB pixels.
ROW, BPP = 192, 3
IDAT_BYTES = 1 << 15
SIDE, LOW = 32, 8


def padded(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes of the text, the text padded with spaces to a positive multiple of ROW bytes)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit RGB PNG whose samples are the payload (a positive multiple of ROW bytes).

    Each row takes the filter of None, Sub and Up with the least sum of absolute signed residuals.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, BPP:] -= rows[:, :-BPP]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    body = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", ROW // BPP, len(rows), 8, 2, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Undo PNG row filters; runs of None, Sub and Up are undone together, Average and Paeth pixel by pixel."""
    height, width = lines.shape
    out = np.zeros((height, width), np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), height]):
        kind = int(kinds[a])
        if kind == 0:
            out[a:b] = lines[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(lines[a:b].reshape(b - a, width // bpp, bpp), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            out[a:b] = np.cumsum(lines[a:b], axis=0, dtype=np.uint8)
            if a:
                out[a:b] += out[a - 1]
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(np.int16) if y else np.zeros(width, np.int16)
                line, row = lines[y], out[y]
                for x in range(0, width, bpp):
                    left = row[x - bpp : x].astype(np.int16) if x else np.zeros(bpp, np.int16)
                    over = above[x : x + bpp]
                    if kind == 3:
                        guess = (left + over) >> 1
                    else:
                        corner = above[x - bpp : x] if x else np.zeros(bpp, np.int16)
                        p = left + over - corner
                        pa_, pb, pc = np.abs(p - left), np.abs(p - over), np.abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, over, corner))
                    row[x : x + bpp] = line[x : x + bpp] + guess.astype(np.uint8)
        else:
            raise ValueError(f"filter {kind}")
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit, non-interlaced PNG. Raises ValueError on any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("truncated chunk")
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) != size or len(media) < at + 12 + size:
            raise ValueError("truncated chunk")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if head is None or not ended or at != len(media):
        raise ValueError("chunks")
    width, height, depth, colour, *rest = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or any(rest):
        raise ValueError("only 8-bit, non-interlaced images")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("compressed data") from e
    if len(raw) != height * (width * channels + 1):
        raise ValueError("number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return _unfilter(lines[:, 1:], lines[:, 0], channels)


def _cosines() -> np.ndarray:
    """Rows 0..LOW-1 of the SIDE-point cosine transform as integers, so that equal images give equal bits anywhere."""
    x = np.arange(SIDE)
    return np.rint(np.cos(np.pi * (2 * x[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE)) * 4096).astype(np.int64)


def cosine_hash(samples: np.ndarray, channels: int = BPP) -> str:
    """64-bit perceptual hash, 16 hex digits: signs of the low-frequency cosine coefficients against their median."""
    height, width = samples.shape[0], samples.shape[1] // channels
    grey = samples.reshape(height, width, channels).sum(axis=2, dtype=np.int64)
    for axis in (0, 1):
        n = grey.shape[axis]
        at = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            counts = np.diff(np.append(at, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            grey = np.add.reduceat(grey, at, axis=axis) * 64 // counts
        else:
            grey = np.take(grey, at, axis=axis) * 64
    basis = _cosines()
    low = (basis @ grey @ basis.T).ravel()
    middle = int(np.sort(low[1:])[31])
    return np.packbits(low > middle).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a PNG in a binary column; null and empty texts are one blank row."""

    def run(batches):
        for batch in batches:
            sizes, images = [], []
            for text in batch.column(1):
                n, payload = padded(text.as_py())
                sizes.append(n)
                images.append(encode_png(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Decode a media column (doc_id, n_bytes, media) with checksum tests and compute digests and cosine hashes.

    problem is null for sound images; for damaged ones it names the damage and the columns read from them are null.
    The payload comes back in `payload`. A null media value counts as damaged.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, problem string"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                if media is None:
                    rows.append((None,) * 6 + ("no media",))
                    continue
                size, digest = len(media), hashlib.sha256(media).hexdigest()
                try:
                    samples = decode_png(media)
                except ValueError as e:
                    rows.append((None, None, None, size, digest, None, str(e)))
                    continue
                payload = samples.tobytes()
                channels = media[25] in (2, 6) and (3 if media[25] == 2 else 4) or (1 if media[25] == 0 else 2)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, digest, cosine_hash(samples, channels), None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(releasing(run), fields)


def media_payloads(stored: DataFrame) -> DataFrame:
    """(doc_id, text): the texts read back from a media column; null where the image is damaged."""

    def run(batches):
        for batch in batches:
            texts = []
            for n, media in zip(batch.column(1).to_pylist(), batch.column(2)):
                try:
                    texts.append(decode_png(media.as_py() or b"").tobytes()[:n].decode("utf-8", "replace"))
                except ValueError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInArrow(releasing(run), "doc_id long, text string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_media(store_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import media

TEXTS = [None, "", "a", "x" * 191, "x" * 192, "y" * 193, "héllo 漢字 🙂\n\t", "word " * 30000, "same", "same"]


def test_round_trip_and_determinism():
    for t in TEXTS:
        n, payload = media.padded(t)
        assert n == len((t or "").encode()) and len(payload) % 192 == 0 and len(payload) >= 192
        samples = media.decode_png(media.encode_png(payload))
        assert samples.tobytes() == payload
        assert len(media.cosine_hash(samples)) == 16


def naive_filter(rows, kinds, bpp):
    out = []
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else np.zeros_like(row)
        line = []
        for x, v in enumerate(row.tolist()):
            a = int(row[x - bpp]) if x >= bpp else 0
            b = int(above[x])
            c = int(above[x - bpp]) if x >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        out.append(bytes([kinds[y]]) + bytes(line))
    return b"".join(out)


@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (6, 4)])
def test_all_filters(colour, channels):
    rng = np.random.default_rng(colour)
    rows = rng.integers(0, 256, (23, 5 * channels), dtype=np.uint8)
    kinds = [int(k) for k in rng.integers(0, 5, 23)]
    body = zlib.compress(naive_filter(rows, kinds, channels))
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 23, 8, colour, 0, 0, 0)) + media._chunk(b"tEXt", b"note") + media._chunk(b"IDAT", body[:7]) + media._chunk(b"IDAT", body[7:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == rows).all()


def test_damage_is_told():
    png = media.encode_png(media.padded("some text")[1])
    for at in (0, 20, 30, 45, len(png) - 5):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    for cut in (4, 40, len(png) - 1):
        with pytest.raises(ValueError):
            media.decode_png(png[:cut])
    with pytest.raises(ValueError):
        media.decode_png(png + b"x")


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(1)
    ramp = (np.add.outer(np.arange(64) * 2, np.arange(192)) % 256).astype(np.uint8)
    noisy = np.clip(ramp.astype(int) + rng.integers(-2, 3, ramp.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, ramp.shape, dtype=np.uint8)
    bits = lambda s: int(media.cosine_hash(s), 16)
    assert (bits(ramp) ^ bits(noisy)).bit_count() < (bits(ramp) ^ bits(other)).bit_count()


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    stored = media.store_media(docs)
    got = media.read_media(stored).collect()
    assert len(got) == len(rows) and all(g["problem"] is None for g in got)
    by = {g["doc_id"]: g for g in got}
    for i, t in enumerate(TEXTS[1:], 1):
        payload = media.padded(t)[1]
        assert by[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert by[i]["tail_crc32"] == zlib.crc32(payload[-16:]) and by[i]["payload_bytes"] == len(payload)
        assert by[i]["n_bytes"] == len(t.encode()) and len(by[i]["media_sha256"]) == 64 and len(by[i]["feature"]) == 16
    assert by[8]["feature"] == by[9]["feature"] and by[8]["media_sha256"] == by[9]["media_sha256"]
    assert {r["doc_id"]: r["text"] for r in media.media_payloads(stored).collect() if r["doc_id"]} == {i: t for i, t in enumerate(TEXTS) if i}
    bad = stored.withColumn("media", F.when(F.col("doc_id") == 2, F.col("media").substr(1, 50)).when(F.col("doc_id") == 3, None).otherwise(F.col("media")))
    told = {r["doc_id"]: r["problem"] for r in media.read_media(bad).collect()}
    assert told[2] and told[3] == "no media" and told[4] is None
    assert media.read_media(media.store_media(docs.limit(0))).count() == 0


def plain_cosine_hash(samples, channels):
    """The hash by its definition: box means in 64ths, two sums of integer cosines, signs against the 32nd of the 63 others."""
    height, width, side, low = samples.shape[0], samples.shape[1] // channels, media.SIDE, media.LOW
    grey = [[sum(int(samples[y, x * channels + c]) for c in range(channels)) for x in range(width)] for y in range(height)]

    def boxes(lines):
        n = len(lines)
        at = [i * n // side for i in range(side)]
        if n < side:
            return [[64 * v for v in lines[a]] for a in at]
        spans = [lines[a:b] for a, b in zip(at, [*at[1:], n])]
        return [[sum(column) * 64 // len(span) for column in zip(*span)] for span in spans]

    small = boxes(grey)
    small = [list(r) for r in zip(*boxes([list(c) for c in zip(*small)]))]
    cosine = [[round(math.cos(math.pi * (2 * x + 1) * k / (2 * side)) * 4096) for x in range(side)] for k in range(low)]
    found = [sum(cosine[v][y] * cosine[u][x] * small[y][x] for y in range(side) for x in range(side)) for v in range(low) for u in range(low)]
    middle = sorted(found[1:])[31]
    return f"{int(''.join(str(int(f > middle)) for f in found), 2):016x}"


def test_hash_against_plain_transform():
    rng = np.random.default_rng(3)
    for height, width in ((1, 64), (5, 3), (33, 64), (100, 70), (64, 32)):
        for channels in (1, 3):
            samples = rng.integers(0, 256, (height, width * channels), dtype=np.uint8)
            assert media.cosine_hash(samples, channels) == plain_cosine_hash(samples, channels)
    for text in ("", "a", "some words of a text " * 300):
        samples = media.decode_png(media.encode_png(media.padded(text)[1]))
        assert media.cosine_hash(samples) == plain_cosine_hash(samples, media.BPP)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in media.op1_media(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        image = media.encode_png(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.cosine_hash(media.decode_png(image)))
        assert tuple(got[i][c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want

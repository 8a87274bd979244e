"""Token-id output as sorted-string-table shards, and reading or looking them up again.

A shard file holds documents in ascending doc_id order. Its parts, all little-endian but for keys:

    blocks   zstd frames; a block's plain form is a run of entries
             entry: varint shared key bytes, varint other key bytes, varint ids, other key bytes, the ids as unsigned 32-bit
    index    per block: 9-byte last key, uint64 offset, uint32 frame bytes, uint32 entries, uint64 ids
    bloom    uint8 probes, uint32 bits, the bits
    footer   uint64 index offset, uint32 blocks, uint64 bloom offset, uint64 entries, uint64 ids, uint32 crc32 of index and bloom, 8-byte magic

Keys are 9 bytes in sort order: 0 for a null doc_id, else 1, then the id with its sign bit flipped, big-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_cache, releasing, shared_dir, table, text_slices

MAGIC = b"GRITSST1"
INDEX, FOOTER = "<9sQIIQ", "<QIQQQI8s"
BLOCK_BYTES, BLOOM_BITS, PROBES = 1 << 18, 10, 7
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    return [((h & 0xFFFFFFFF) + i * (h >> 32 | 1)) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard to a binary file object; add() takes keys in ascending order."""

    def __init__(self, out):
        import zstandard

        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.pack = zstandard.ZstdCompressor(level=1)
        self.block, self.size, self.last, self.entries, self.ids = [], 0, b"", 0, 0
        self.all_entries = self.all_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        while self.block and shared < 9 and key[shared] == self.last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(9 - shared) + _varint(len(ids)) + key[shared:] + ids.astype("<u4").tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            frame = self.pack.compress(b"".join(self.block))
            self.index.append(struct.pack(INDEX, self.last, self.at, len(frame), self.entries, self.ids))
            self.out.write(frame)
            self.at += len(frame)
            self.all_entries, self.all_ids = self.all_entries + self.entries, self.all_ids + self.ids
            self.block, self.size, self.entries, self.ids = [], 0, 0, 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        field = np.zeros(bits, bool)
        for key in self.keys:
            field[_probes(key, bits)] = True
        bloom = struct.pack("<BI", PROBES, bits) + np.packbits(field).tobytes()
        self.out.write(index + bloom)
        self.out.write(struct.pack(FOOTER, self.at, len(self.index), self.at + len(index), self.all_entries, self.all_ids, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))


class ShardReader:
    """Random access to one shard through read_at(offset, size) of its bytes."""

    def __init__(self, read_at, size: int):
        self.read_at, foot = read_at, struct.calcsize(FOOTER)
        index_at, blocks, bloom_at, self.entries, self.ids, crc, magic = struct.unpack(FOOTER, read_at(size - foot, foot))
        if magic != MAGIC:
            raise ValueError("not a shard")
        tail = read_at(index_at, size - foot - index_at)
        if zlib.crc32(tail) != crc:
            raise ValueError("index or Bloom filter damaged")
        self.blocks = [struct.unpack_from(INDEX, tail, i * struct.calcsize(INDEX)) for i in range(blocks)]
        self.last_keys = [b[0] for b in self.blocks]
        bloom = tail[bloom_at - index_at :]
        self.bits = struct.unpack_from("<BI", bloom)[1]
        self.field = np.unpackbits(np.frombuffer(bloom[5:], np.uint8))

    def entries_of(self, block: int):
        """(key, ids) of a block's documents."""
        import zstandard

        _, at, size, _, _ = self.blocks[block]
        data, i, key = zstandard.ZstdDecompressor().decompress(self.read_at(at, size)), 0, b""
        while i < len(data):
            fields = []
            for _ in range(3):
                n = shift = 0
                while True:
                    c = data[i]
                    i += 1
                    n |= (c & 127) << shift
                    shift += 7
                    if c < 128:
                        break
                fields.append(n)
            shared, other, ids = fields
            key = key[:shared] + data[i : i + other]
            i += other
            yield key, np.frombuffer(data, "<u4", ids, i)
            i += 4 * ids

    def scan(self):
        for block in range(len(self.blocks)):
            yield from self.entries_of(block)

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document under doc_id: Bloom filter, binary search of the sparse index, then its blocks."""
        key = key_of(doc_id)
        if not all(self.field[p] for p in _probes(key, self.bits)):
            return []
        found, block = [], bisect_left(self.last_keys, key)
        while block < len(self.blocks):
            found += [ids for k, ids in self.entries_of(block) if k == key]
            if self.last_keys[block] > key:
                break
            block += 1
        return found


class WordEncoder:
    """text -> unsigned 16-bit ids of a tokenizer file, through a bounded table of the ids of words seen before.

    The tokenizer's normaliser and pre-tokeniser never join characters across ASCII white space, nor across the change
    from an ASCII letter or digit to an ASCII mark, so the ids of a text are those of its pieces between such places in
    turn, and ASCII pieces may be lower-cased first as the normaliser would. Pieces are known by two 64-bit hashes; a
    new one is encoded by the tokenizer. Texts that may hold a special token's string are encoded whole.
    """

    LONGEST, ENTRIES = 256, 2_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        rng = np.random.default_rng(0)
        self.by_byte = rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
        self.by_place = rng.integers(0, 2**64, (2, self.LONGEST), dtype=np.uint64) | np.uint64(1)
        kind = np.full(256, 3, np.uint8)
        kind[:128] = 2
        kind[[9, 10, 11, 12, 13, 32]] = 0
        lower = np.arange(256, dtype=np.uint8)
        for c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            kind[c] = 1
        lower[65:91] += 32
        self.kind, self.lower = kind, lower
        self.reset()

    def reset(self) -> None:
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.store, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each)."""
        parts, sizes = [], []
        for at in range(0, len(words), 20_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[at : at + 20_000]], add_special_tokens=False)]
            sizes += map(len, ids)
            parts.append(np.fromiter(chain.from_iterable(ids), np.uint16, sum(sizes[at:])))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.array(sizes, np.int64)

    def _learn(self, first: np.ndarray, second: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new words, hashes ascending, into the table; their offsets in the store and numbers of ids."""
        ids, sizes = self._encode(words)
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(self.used + len(ids), np.uint16)))
        self.store[self.used : self.used + len(ids)] = ids
        offsets = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.runs.append((first, second, offsets, sizes))
        if len(self.runs) > 8:
            merged = [np.concatenate(c) for c in zip(*self.runs)]
            order = np.argsort(merged[0], kind="stable")
            self.runs = [tuple(c[order] for c in merged)]
        return offsets, sizes

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if sum(len(r[0]) for r in self.runs) > self.ENTRIES:
            self.reset()
        raws = [b"" if t is None or "<|" in t else t.encode("utf-8", "replace") for t in texts]
        doc_ends = np.cumsum([len(r) + 1 for r in raws])
        data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        kind = self.kind[data]
        before = np.concatenate(([0], kind[:-1]))
        opens = (kind != 0) & ((before == 0) | ((before == 1) & (kind == 2)))
        closes = (kind != 0) & np.concatenate(((kind[1:] == 0) | opens[1:], [True]))
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sizes = ends - starts
        ids, counts = np.zeros(0, np.uint16), np.zeros(len(starts), np.int64)
        if len(starts):
            short = np.minimum(sizes, self.LONGEST)
            heads = np.cumsum(short) - short
            place = np.arange(int(short.sum())) - np.repeat(heads, short)
            letters = data[np.repeat(starts, short) + place]
            foreign = np.maximum.reduceat(letters, heads) > 127
            letters = np.where(np.repeat(foreign, short), letters, self.lower[letters])
            h1, h2 = (np.add.reduceat(self.by_byte[k][letters] * self.by_place[k][place], heads) ^ (short.astype(np.uint64) << np.uint64(56 - k)) for k in (0, 1))
            known, at, back = np.unique(h1, return_index=True, return_inverse=True)
            if not (h2[at][back] == h2).all() or (sizes > self.LONGEST).any():
                # pieces that one hash cannot tell apart, or longer than are hashed: each is encoded as it stands
                ids, counts = self._encode([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())])
            else:
                check = h2[at]
                offset, number = np.full(len(known), -1, np.int64), np.zeros(len(known), np.int64)
                for run in self.runs:
                    place = np.minimum(np.searchsorted(run[0], known), len(run[0]) - 1)
                    hit = (run[0][place] == known) & (run[1][place] == check)
                    offset[hit], number[hit] = run[2][place[hit]], run[3][place[hit]]
                new = np.flatnonzero(offset < 0)
                if len(new):
                    flat = letters.tobytes()
                    words = [flat[a : a + n] for a, n in zip(heads[at[new]].tolist(), short[at[new]].tolist())]
                    offset[new], number[new] = self._learn(known[new], check[new], words)
                counts = number[back]
                ids = self.store[np.repeat(offset[back] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        cuts = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, doc_ends)]
        out = np.split(ids, cuts[:-1])
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) if t and "<|" in t else part for t, part in zip(texts, out)]


def _encoder(path: str) -> WordEncoder:
    held = process_cache()
    if ("encoder", path) not in held:
        held["encoder", path] = WordEncoder(path)
    return held["encoder", path]


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, docs_per_shard: int = 8192, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write shards under folder, a URI executors share.

    Returns (shard, path, entries, ids), one row per shard file, in key order. Only doc_id is read to choose the shards'
    bounds; texts are encoded where they are read and 16-bit ids are what is shuffled. A retried task writes its
    shard anew under another name and then renames it, so a lost executor leaves no half file. Rows with one doc_id lie
    side by side, in the order of their ids; rows without doc_id come first.
    """
    counted = docs.agg(F.count("*"), F.count("doc_id")).first()
    shards = max(1, min(100_000, counted[0] // docs_per_shard))
    bounds: list[int] = []
    if shards > 1 and counted[1]:
        cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / shards for i in range(1, shards)], max(10_000, 4 * shards))).first()[0]
        bounds = sorted(set(cuts))
    edges = np.array(bounds, np.int64)

    def encode(batches):
        run = _encoder(tokenizer_path)
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                part = rows.column(0)
                shard = np.where(part.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, part.fill_null(0).to_numpy(zero_copy_only=False), side="left"))
                end = np.array([end_id], np.uint16)
                yield pa.RecordBatch.from_arrays([part, pa.array(shard, pa.int32()), pa.array([np.append(x, end).astype("<u2").tobytes() for x in run(texts)], pa.binary())], ["doc_id", "shard", "ids"])

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(encode), "doc_id long, shard int, ids binary")
    coded = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done, shard, writer, stream, draft = [], None, None, None, ""

        def finish():
            writer.close()
            stream.close()
            system.move(draft, f"{root}/{shard:06d}.sst")
            done.append((shard, f"{folder}/{shard:06d}.sst", writer.all_entries, writer.all_ids))

        for batch in batches:
            for doc_id, at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != shard:
                    if writer:
                        finish()
                    shard, draft = at, f"{root}/.{at:06d}.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(draft)
                    writer = ShardWriter(stream)
                writer.add(key_of(doc_id), np.frombuffer(ids.as_buffer(), "<u2"))
        if writer:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "entries", "ids"])

    return coded.mapInArrow(releasing(write), "shard int, path string, entries long, ids long")


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    handle = system.open_input_file(path)

    def read_at(offset, size):
        handle.seek(offset)
        return handle.read(size)

    return ShardReader(read_at, handle.size())


def read_shards(spark: SparkSession, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files of a manifest (one task a shard).

    The manifest has one entry per shard, so what the driver holds grows with the number of files, not of documents.
    """
    starts, at = [], 0
    for _, path, _, ids in sorted(manifest):
        starts.append((path, at))
        at += ids

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for key, ids in _open(path).scan():
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    files = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return files.mapInArrow(releasing(run), ", ".join(f"{n} long" for n in names))


def look_up(manifest: list[tuple[int, str, int, int]], doc_id: int | None) -> list[list[int]]:
    """Token ids of every document under doc_id, by binary search in each shard that its Bloom filter does not exclude."""
    return [ids.tolist() for _, path, _, _ in sorted(manifest) for ids in _open(path).find(doc_id)]


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder).collect()
    return read_shards(spark, [tuple(r) for r in manifest])

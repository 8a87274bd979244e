"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text with its dummy leading space is a lattice whose edges are the model's pieces; characters without a piece get one edge
of byte pieces. The model file holds ranks, not probabilities, so a piece of rank r weighs (r + 2.7) ** -alpha (Zipf's
law). Forward filtering sums the weights of all segmentations up to every position; backward sampling then draws the
last piece, the one before it, and so on, in proportion. Draws depend only on (seed, doc_id, byte position), so a row gets
the same segmentation in any batch, task or run. No piece spans a change from a non-space to a space or a line
break, so the lattice factors there and each distinct unit between such places is filtered once per batch.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_cache, releasing, table, text_slices

UNIT = re.compile(rb"\n+| *[^ \n]+| +")
OFFSET = 2.7
#: Bytes of text whose lattices are held at once.
SLICE = 1 << 20


class Lattice:
    """The model's pieces as a byte trie with weights."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.surface: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        nodes: list[dict[int, int]] = [{}]
        terminal: list[int] = [-1]
        weight, rank = np.zeros(size), 0
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if re.search(rb"[^ ] |\n", piece):
                raise ValueError(f"piece {i} spans a place where the lattice is cut")
            self.surface[i] = piece
            weight[i] = (rank + OFFSET) ** -alpha
            rank += 1
            at = 0
            for c in piece:
                to = nodes[at].get(c)
                if to is None:
                    to = nodes[at][c] = len(nodes)
                    nodes.append({})
                    terminal.append(-1)
                at = to
            if terminal[at] < 0:
                terminal[at] = i
        self.next = np.zeros((len(nodes), 256), np.int32)
        for at, edges in enumerate(nodes):
            self.next[at, list(edges.keys())] = list(edges.values())
        self.terminal = np.array(terminal, np.int32)
        self.weight, self.byte_weight = weight, (rank + OFFSET) ** -alpha
        self.starts = np.cumsum([0] + [len(s) for s in self.surface])
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.lengths = np.diff(self.starts)


def lattice(path: str, alpha: float) -> Lattice:
    held = process_cache()
    if ("lattice", path, alpha) not in held:
        held["lattice", path, alpha] = Lattice(path, alpha)
    return held["lattice", path, alpha]


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(keys: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """32-bit draws that depend on the row key and the byte position alone."""
    return (_mix(keys + (positions.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def row_key(seed: int, doc_id: int | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed & (2**64 - 1))


def _filtered(model: Lattice, units: list[bytes]):
    """Forward filtering of every unit: per lattice node, its incoming edges and their cumulative shares in 1/2^32.

    Nodes of unit k are base[k] + position. Sums are kept as mantissa and binary exponent, so no unit is too long.
    """
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    data = np.frombuffer(b"".join(units), np.uint8)
    first_byte = np.concatenate(([0], np.cumsum(sizes)))
    base = first_byte[:-1] + np.arange(len(units))
    total = int(first_byte[-1] + len(units))
    small = np.int32 if total < 1 << 31 else np.int64
    owner = np.repeat(np.arange(len(units), dtype=small), sizes)
    first_byte = first_byte.astype(small)
    lead = np.flatnonzero((data & 0xC0) != 0x80).astype(small)
    unit_end = first_byte[1:][owner]
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).astype(np.int8)
    covered = np.zeros(len(data), bool)
    starts, ends, kinds = [], [], []
    at, depth, state = lead, 0, model.next[0][data[lead]]
    while True:
        alive = state > 0
        at, state = at[alive], state[alive]
        depth += 1
        if not len(at):
            break
        piece = model.terminal[state]
        done = piece >= 0
        s = at[done]
        starts.append(s)
        ends.append(s + depth)
        kinds.append(piece[done])
        covered[s[width[s] == depth]] = True
        more = at + depth < unit_end[at]
        at, state = at[more], state[more]
        state = model.next[state, data[at + depth]]
    bare = lead[~covered[lead]]
    starts.append(bare)
    ends.append(bare + width[bare])
    kinds.append(np.full(len(bare), -1, np.int32))
    start, end, kind = np.concatenate(starts), np.concatenate(ends), np.concatenate(kinds)
    unit = owner[start]
    reach = end - first_byte[unit]
    order = np.lexsort((end, reach))
    start, end, kind, unit, reach = start[order], end[order], kind[order], unit[order], reach[order]
    from_node, to_node = start + unit, end + unit
    weight = np.where(kind >= 0, model.weight[kind], model.byte_weight ** (end - start))
    mantissa, exponent = np.zeros(total), np.zeros(total, np.int64)
    mantissa[base] = 1.0
    heads = np.flatnonzero(np.concatenate(([True], to_node[1:] != to_node[:-1]))) if len(to_node) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(to_node)))
    group = np.repeat(np.arange(len(heads), dtype=small), counts)
    share = np.zeros(len(start), np.uint32)
    steps = np.searchsorted(reach, np.arange(1, int(reach[-1]) + 2)) if len(reach) else np.zeros(1, np.int64)
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        if a == b:
            continue
        g0, g1 = int(group[a]), int(group[b - 1]) + 1
        own_heads = heads[g0:g1] - a
        m, e = mantissa[from_node[a:b]] * weight[a:b], exponent[from_node[a:b]]
        top = np.maximum.reduceat(e, own_heads)
        local = group[a:b] - g0
        m = np.ldexp(m, np.maximum(e - top[local], -2000).astype(np.int32))
        # running sums within a group, formed edge by edge so that they do not depend on what else is in the batch
        if int(counts[g0:g1].max()) > 1:
            inner = np.zeros(b - a)
            pending = own_heads.copy()
            left = counts[g0:g1].copy()
            acc = np.zeros(len(pending))
            live = np.arange(len(pending))
            while len(live):
                acc[live] = acc[live] + m[pending[live]]
                inner[pending[live]] = acc[live]
                pending[live] += 1
                left[live] -= 1
                live = live[left[live] > 0]
            running = inner
            sums = running[np.append(own_heads[1:], b - a) - 1]
        else:
            running, sums = m, m
        share[a:b] = np.minimum(np.floor(running / sums[local] * 4294967296.0), 4294967295.0).astype(np.uint32)
        share[a:b][np.append(own_heads[1:], b - a) - 1] = 0xFFFFFFFF
        nodes = to_node[heads[g0:g1]]
        frac, shift = np.frexp(sums)
        mantissa[nodes], exponent[nodes] = frac, top + shift
    first = np.zeros(total, small)
    first[to_node[heads]] = heads
    return base, sizes, first, share, from_node, kind, (end - start)


def encode_batch(model: Lattice, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
    """Sampled ids (int32) of each text; null and empty texts have none."""
    known: dict[bytes, int] = {}
    numbers, per_doc = [], []
    for text in texts:
        units = UNIT.findall(b" " + text.encode("utf-8", "replace")) if text else []
        numbers += [known.setdefault(u, len(known)) for u in units]
        per_doc.append(len(units))
    if not numbers:
        return [np.zeros(0, np.int32) for _ in texts]
    base, sizes, first, share, from_node, kind, span = _filtered(model, list(known))
    occurrence = np.array(numbers, np.int64)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    lengths = sizes[occurrence]
    begins = np.cumsum(lengths) - lengths
    doc_first = np.cumsum([0, *per_doc])[:-1]
    begins = begins - np.append(begins, 0)[doc_first][doc]
    key = np.array(keys, np.uint64)[doc]
    node = base[occurrence] + lengths
    shift = begins - base[occurrence]
    live = np.arange(len(occurrence))
    taken, counts = [], np.zeros(len(occurrence), np.int64)
    while len(live):
        at = node[live]
        u = _draws(key[live], at + shift[live])
        edge = first[at]
        below = np.flatnonzero(share[edge] < u)
        while len(below):
            edge[below] += 1
            below = below[share[edge[below]] < u[below]]
        size = np.where(kind[edge] >= 0, 1, span[edge])
        counts[live] += size
        taken.append((live, edge, size))
        node[live] = from_node[edge]
        live = live[node[live] > base[occurrence[live]]]
    stops = np.cumsum(counts)
    ids, pointer = np.zeros(int(stops[-1]), np.int32), stops.copy()
    data = np.frombuffer(b"".join(known), np.uint8)
    for who, edge, size in taken:
        pointer[who] -= size
        piece = kind[edge]
        plain = piece >= 0
        ids[pointer[who[plain]]] = piece[plain]
        if not plain.all():
            odd = np.flatnonzero(~plain)
            where = from_node[edge[odd]] - occurrence[who[odd]]  # nodes run ahead of bytes by one for each unit before
            for j in range(int(size[odd].max())):
                more = odd[size[odd] > j]
                ids[pointer[who[more]] + j] = model.byte_id[data[where[size[odd] > j] + j]]
    ends = np.concatenate(([0], stops))[np.cumsum([0, *per_doc])]
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def decode_ids(model: Lattice, ids: np.ndarray) -> bytes:
    """The UTF-8 bytes that ids stand for, without the dummy leading space."""
    if not len(ids):
        return b""
    lengths = model.lengths[ids]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths) + np.repeat(model.starts[ids], lengths)
    return model.bytes[at].tobytes()[1:]


def encode_documents(docs: DataFrame, path: str, seed: int = 7, alpha: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, ids array<int>): sampled piece ids of every whole text; null and empty texts get an empty array.

    Rows of one doc_id and text get one segmentation; a null doc_id is a key like any other.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").alias("_text"))

    def run(batches):
        model = lattice(path, alpha)
        for batch in batches:
            for rows, texts in text_slices(batch, batch.num_columns - 1, SLICE):
                ids = encode_batch(model, texts, [row_key(seed, n) for n in rows.column(0).to_pylist()])
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], [*rows.schema.names[:-1], "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(releasing(run), f"{fields}, ids array<int>")


def decode_documents(coded: DataFrame, path: str, alpha: float = 1.0) -> DataFrame:
    """(doc_id, ids_crc32, text) from (doc_id, ids); crc32 is over the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        model = lattice(path, alpha)
        for batch in batches:
            flat, cuts = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            parts = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            texts = [decode_ids(model, p).decode("utf-8", "replace") for p in parts]
            sums = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(texts)], ["doc_id", "ids_crc32", "n_tokens", "text"])

    return coded.select("doc_id", "ids").mapInArrow(releasing(run), "doc_id long, ids_crc32 long, n_tokens long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    text = F.col("text")
    return found.select("doc_id", "n_tokens", "ids_crc32", F.octet_length(text).cast("long").alias("decoded_bytes"), F.sha2(text, 256).alias("decoded_sha256"))

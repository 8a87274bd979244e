import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gritstone.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Lattice(PATH, 1.0)


def texts():
    r = random.Random(5)
    alphabet = "abcdefghij the ing  \n\t▁éß漢字🙂<0x41> .,'1234"
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(80)]
    return [None, "", " ", "  x ", "\n", "hello world, hello", "▁literal", "a" * 3000, "word " * 4000, *made]


def brute(model, text, key):
    """Sampling over the whole text's lattice with exact fractions and the same draws."""
    if not text:
        return []
    data = b" " + text.encode()
    known = {s: i for i, s in enumerate(model.surface) if model.weight[i] > 0}
    longest = max(map(len, known))
    total = {0: Fraction(1)}
    edges = {}
    lead = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80] + [len(data)]
    for a, b in zip(lead, lead[1:]):
        for e in range(a + 1, min(len(data), a + longest) + 1):
            if (i := known.get(data[a:e])) is not None:
                edges.setdefault(e, []).append((a, i, Fraction(model.weight[i])))
        if data[a:b] not in known:
            edges.setdefault(b, []).append((a, -1, Fraction(model.byte_weight) ** (b - a)))
    for e in lead[1:]:
        total[e] = sum(total[a] * w for a, _, w in edges[e])
    out, at = [], len(data)
    while at:
        u = int(pieces._draws(np.array([key], np.uint64), np.array([at]))[0])
        acc, chosen = Fraction(0), None
        ordered = sorted(edges[at], key=lambda x: (x[1] < 0, at - x[0]))
        for a, i, w in ordered:
            acc += total[a] * w
            chosen = (a, i)
            if min(int(acc / total[at] * 2**32), 2**32 - 1) >= u:
                break
        a, i = chosen
        out = ([i] if i >= 0 else [int(model.byte_id[c]) for c in data[a:at]]) + out
        at = a
    return out


def test_against_exact_sampling(model):
    ts = [t for t in texts() if t is None or len(t) < 100]
    keys = [pieces.row_key(3, i) for i in range(len(ts))]
    got = pieces.encode_batch(model, ts, keys)
    for t, k, ids in zip(ts, keys, got):
        assert ids.tolist() == brute(model, t, k)


def test_lossless_and_batch_free(model):
    ts = texts()
    keys = [pieces.row_key(3, i) for i in range(len(ts))]
    got = pieces.encode_batch(model, ts, keys)
    for t, k, ids in zip(ts, keys, got):
        assert pieces.decode_ids(model, ids).decode() == (t or "")
        assert pieces.encode_batch(model, [t], [k])[0].tolist() == ids.tolist()


def test_shares(model):
    """Segmentations of a short word come up as often as their weights say."""
    n = 4000
    got = pieces.encode_batch(model, ["ing"] * n, [pieces.row_key(1, i) for i in range(n)])
    seen = {}
    for ids in got:
        seen[tuple(ids.tolist())] = seen.get(tuple(ids.tolist()), 0) + 1
    weight = {ids: float(np.prod(model.weight[list(ids)])) for ids in seen}
    whole = sum(weight.values())
    assert len(seen) > 2
    for ids, k in seen.items():
        assert abs(k / n - weight[ids] / whole) < 0.04


def test_frames(spark):
    ts = texts()
    rows = [(i, t) for i, t in enumerate(ts)] + [(None, "no id"), (3, ts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = pieces.encode_documents(docs, PATH, keep=())
    got = pieces.decode_documents(coded, PATH).collect()
    assert sorted((g["doc_id"] if g["doc_id"] is not None else -1, g["text"]) for g in got) == sorted((i if i is not None else -1, t or "") for i, t in rows)
    again = pieces.decode_documents(pieces.encode_documents(docs.repartition(3), PATH), PATH)
    assert sorted((str(g["doc_id"]), g["ids_crc32"]) for g in got) == sorted((str(g["doc_id"]), g["ids_crc32"]) for g in again.collect())
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in pieces.op7_pieces(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()

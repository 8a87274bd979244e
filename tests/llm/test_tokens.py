import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gritstone.llm import tokens
from gritstone.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello  World's don't\tstop", "é é é́ ́x", "\x1c\x85a b c", "<|endoftext|> and<|startoftext|>x", "ΑΣ ΣΑΣ.", "漢字🙂 12345 !!??", "word " * 20000, "x" * 5000, "İstanbul ǅ ﬁ", "a\rb\x0bc\x0cd\x00e"]


def test_words_give_the_texts_ids():
    t = Tokenizer.from_file(PATH)
    r = random.Random(1)
    more = ["".join(r.choice("abcXYZ Éé\u0301\u030cJjIıİi\u0307' \u00a0\u2028.,-!'st ll 12ñ\n<|\x1f漢ΣΣ") for _ in range(r.randrange(60))) for _ in range(1500)]
    texts = [*TEXTS, *more]
    encode = tokens.WordEncoder(PATH)
    for part in (texts, texts[::-1], texts[3:9], [], [None], ["", ""]):
        for text, ids in zip(part, encode(part), strict=True):
            assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, text
    encode.LONGEST = 2
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_word_table_stays_bounded():
    encode = tokens.WordEncoder(PATH)
    encode.ENTRIES = 50
    t = Tokenizer.from_file(PATH)
    for k in range(30):
        text = " ".join(f"w{k}x{j}" for j in range(20))
        assert encode([text])[0].tolist() == t.encode(text).ids
        assert sum(len(r[0]) for r in encode.runs) <= 50 + 20


def test_shard_file(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 200)
    rows = [(None, [1, 2]), (-5, []), (-1, [7]), (0, list(range(100))), (3, [65535]), (3, [4]), (2**62, [9, 9])]
    out = io.BytesIO()
    w = tokens.ShardWriter(out)
    for k, ids in rows:
        w.add(tokens.key_of(k), np.array(ids, np.uint32))
    w.close()
    data = out.getvalue()
    r = tokens.ShardReader(lambda at, n: data[at : at + n], len(data))
    assert [(tokens.id_of(k), ids.tolist()) for k, ids in r.scan()] == rows
    assert r.entries == len(rows) and r.ids == sum(len(x) for _, x in rows) and len(r.blocks) > 1
    assert [x.tolist() for x in r.find(3)] == [[65535], [4]] and [x.tolist() for x in r.find(None)] == [[1, 2]]
    assert r.find(12345) == [] and r.find(-5)[0].tolist() == []
    broken = data[:-60] + bytes([data[-60] ^ 1]) + data[-59:]
    with pytest.raises(ValueError):
        tokens.ShardReader(lambda at, n: broken[at : at + n], len(broken))


@pytest.mark.parametrize("per_shard", [4, 8192])
def test_written_and_read(spark, per_shard):
    t = Tokenizer.from_file(PATH)
    rows = [(i * 7 - 20, x) for i, x in enumerate(TEXTS)] + [(None, "null id"), (1, "twice"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("clash"))
    folder = f"{shared_dir(spark)}/t{per_shard}"
    manifest = [tuple(r) for r in tokens.write_shards(docs, PATH, folder, docs_per_shard=per_shard).collect()]
    got = tokens.read_shards(spark, manifest).collect()
    want, start = [], 0
    coded = {}
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        coded.setdefault(i, []).append(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got), key=key) == sorted(want, key=key)
    for g in sorted(got, key=lambda g: g["start"]):
        assert g["start"] == start
        start += g["n_tokens"]
    assert [g["doc_id"] for g in sorted(got, key=lambda g: g["start"])] == [w[0] for w in want]
    assert sorted(tokens.look_up(manifest, 1)) == sorted(coded[1]) and tokens.look_up(manifest, 999) == []
    empty = [tuple(r) for r in tokens.write_shards(docs.limit(0), PATH, folder + "e").collect()]
    assert empty == [] and tokens.read_shards(spark, empty).count() == 0

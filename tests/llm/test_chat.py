import hashlib

from pyspark.sql import functions as F

from gritstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def odd_turns():
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"rules <turn user> & {c}"))
        for t in range(1, 3 + c):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * (c * t % 60) + "</turn>\n<turn x>\n &amp;lt; \\ é🙂"))
    rows += [(50, 0, None, None), (50, None, "assistant", None), (50, 1, "assistant", ""), (50, 1, "assistant", ""), (50, 1, "a<b>", "tie"), (None, 0, "assistant", "no id"), (None, 1, "user", "x")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"reply {t} " + "long " * (t % 40)) for t in range(1500)]
    rows += [(61, 0, "assistant", "huge " * 30000)]
    rows += [(62, 5, "system", "late"), (62, 1, "user", "first"), (62, 6, "assistant", "last")]
    return rows


def key(r):
    return (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())


def test_windows_and_round_trip(spark):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("window", F.lit("clash"))
    got = chat.chat_windows(turns, 64, 16).withColumn("read", chat.read_turns(F.col("text"))).withColumn("target", chat.read_loss(F.col("text"), F.col("loss"))).collect()
    by = {}
    for g in got:
        by.setdefault(g["conv_id"], []).append(g)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        ws = sorted(by[conv], key=lambda g: g["window"])
        new = [(t["role"], t["text"]) for g in ws for t in g["read"][g["n_repeated"] :]]
        assert new == [(r[2] or "", r[3] or "") for r in own]
        assert "".join(g["target"] for g in ws) == "".join(r[3] or "" for r in own if r[2] == "assistant")
        if own[0][2] == "system":
            assert all(g["read"][0]["role"] == "system" and g["read"][0]["text"] == own[0][3] for g in ws)
        before = []
        assert not any(len(g["read"]) == g["n_repeated"] for g in ws)
        for k, g in enumerate(ws):
            repeated = [(t["role"], t["text"]) for t in g["read"][: g["n_repeated"]]]
            if repeated and repeated[0][0] == "system" and own[0][2] == "system":
                repeated = repeated[1:]
            assert not repeated or before[-len(repeated) :] == repeated
            words = [len(t["text"].split()) + chat.MARKS for t in g["read"]]
            head = words[0] if own[0][2] == "system" else 0
            own_words = words[g["n_repeated"] :]
            room = max(1, 64 - 16 - head)
            if own_words and k == 0 and head:
                own_words = own_words[1:]
            assert sum(words) <= 64 or len(own_words) <= 1 and sum(own_words) > room
            assert sum(len(t[1].split()) + chat.MARKS for t in repeated) <= 16
            before += [(t["role"], t["text"]) for t in g["read"][g["n_repeated"] :]]
    assert len(by[60]) > 100
    assert chat.chat_windows(turns.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in chat.op4_chat(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, g in got.items():
        own = sorted((r for r in rows if r[0] == conv), key=key)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert g["n_turns"] == len(own)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.execute(chat.OP4_SQL)
    names = [d[0] for d in found.description]
    want = sorted((dict(zip(names, r)) for r in found.fetchall()), key=lambda r: r["conv_id"])
    assert sorted((r.asDict() for r in chat.op4_chat(spark, sf).collect()), key=lambda r: r["conv_id"]) == want


def test_a_long_system_turn(spark):
    """It leaves no room: every window has one turn beside it; with room, every window keeps the budget."""
    rows = [(c, 0, "system", "rule " * long) for c, long in ((1, 300), (2, 100))] + [(c, t, "user" if t % 2 else "assistant", "word " * 9) for c in (1, 2) for t in range(1, 40)]
    got = chat.chat_windows(spark.createDataFrame(rows, SCHEMA)).withColumn("read", chat.read_turns(F.col("text"))).collect()
    for g in got:
        total = sum(len(t["text"].split()) + chat.MARKS for t in g["read"])
        assert g["read"][0]["role"] == "system"
        assert total <= chat.BUDGET if g["conv_id"] == 2 else len(g["read"]) - g["n_repeated"] <= 1 + (g["window"] == 0)

"""Chat formatting in budgeted, turn-aligned windows (DataFrame functions only).

Prefix sums of turn tokens lay a conversation's turns on a line, cut into cells of `budget - history - system turn` tokens. The turns that lie
wholly in a cell form its span; a turn that crosses a cell's end is a span of its own. A span's window holds the conversation's
leading system turn, then up to `history` tokens of the span before, repeated, then the span's own turns. Loss falls on the texts of
the span's own assistant turns, so each assistant text is a target once.

A turn is written `<turn ROLE>` newline TEXT `</turn>` newline. In roles and texts `&`, `<` and `>` become `&amp;`,
`&lt;` and `&gt;`, so no text can hold a control string, and the escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, running_totals, table
from .simhash import attach

BUDGET, HISTORY = 256, 64
#: Tokens that the marks of a turn count for.
MARKS = 3
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"
TARGET = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, loss, n_repeated) from turns (conv_id, turn, role, text).

    loss is an array of (start, end) code-point offsets into text; the first n_repeated turns of a window repeat earlier
    ones. Null roles and texts count as empty; turns that share a number come in the order of role and text; a null
    conv_id is a conversation of its own. A window exceeds the budget only where a single turn is longer than a cell, or where the
    system turn and history leave no room at all (then each window has one turn); no turn is cut. An empty table gives no
    windows. A conversation of any length is dealt over many tasks: no task needs a whole one, but for its spans' first places.
    """
    if not 0 <= history <= budget - history:
        raise ValueError("history must not be negative or exceed half the budget")
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": (F.regexp_count("text", F.lit(WORD)) + MARKS).cast("long"), "one": F.lit(1).cast("long"), "block": F.floor(F.col("turn") / 256)})
    rows = running_totals(rows, ["conv"], ["block"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"seq": "one", "before": "tokens"})
    lead = (F.col("seq") == 0) & (F.col("role") == "system")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    rows = checkpointed(rows.select("conv", key.alias("key"), "seq", "role", "text", "before", "tokens"))
    convs = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(lead, F.col("tokens"))), F.lit(0)).alias("head")))
    cell = F.greatest(F.lit(budget - history) - F.col("head"), F.lit(1))
    rows = attach(rows, convs, "key").withColumns({"begin": F.greatest(F.col("before") - F.col("head"), F.lit(0)), "cell": cell})
    rows = rows.withColumns({"first_cell": F.expr("begin div cell"), "last_cell": F.expr("(begin + tokens - 1) div cell")})
    span = F.when(lead, 0).otherwise(2 * F.col("first_cell") + F.when(F.col("first_cell") < F.col("last_cell"), 1).otherwise(0))
    rows = checkpointed(rows.select("conv", "seq", "role", "text", "before", span.cast("long").alias("span")))
    spans = rows.groupBy("conv", "span").agg(F.min("before").alias("first"))
    order = Window.partitionBy("conv").orderBy("span")
    spans = spans.withColumns({"next": F.lead("span").over(order), "next_first": F.lead("first").over(order), "nth": F.row_number().over(order)})
    spans = spans.select(F.col("conv").alias("c"), F.col("span").alias("s"), "next", "next_first", "nth")
    placed = rows.join(spans, rows["conv"].eqNullSafe(spans["c"]) & (rows["span"] == spans["s"]))
    again = F.when(~lead & (F.col("next_first") - F.col("before") <= history), F.col("next"))
    places = F.array_compact(F.array(F.struct(F.col("span").alias("window"), F.lit(0).alias("repeated")), F.when(again.isNotNull(), F.struct(again.alias("window"), F.lit(1).alias("repeated")))))
    shown = placed.select("conv", "seq", "role", "text", F.explode(places).alias("at")).select("conv", "at.window", "seq", "at.repeated", "role", "text")
    heads = rows.filter(lead).select(F.col("conv").alias("h"), "seq", "role", "text")
    kept = heads.join(spans.filter("nth > 1").select("c", "s"), heads["h"].eqNullSafe(spans["c"])).select(F.col("c").alias("conv"), F.col("s").alias("window"), "seq", F.lit(1).alias("repeated"), "role", "text")
    # the leading turn lies in the first span, so any other window repeats it
    written = shown.unionByName(kept).withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)))
    written = written.select("conv", "window", F.struct("seq", "repeated", (F.col("role") == TARGET).alias("target"), "head", "body").alias("t"))
    windows = written.groupBy("conv", "window").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def step(acc, t):
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        mine = F.when(t["target"] & (t["repeated"] == 0), F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(acc["loss"], mine).alias("loss"))

    loss = F.aggregate("turns", begin, step, lambda acc: acc["loss"])
    repeated = F.size(F.filter("turns", lambda t: t["repeated"] == 1))
    return windows.select(F.col("conv").alias("conv_id"), "window", text.alias("text"), loss.alias("loss"), repeated.alias("n_repeated"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) read from a window's text, unescaped."""
    parts = F.split(text, CLOSE, -1)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part):
        head = F.substring_index(part, BODY, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(part, F.length(head) + F.lit(len(BODY) + 1))).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    windows = chat_windows(turns.unionByName(odd))
    own = windows.withColumn("turns", read_turns(F.col("text"))).withColumn("turns", F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns"), F.lit(1))))
    own = own.select("conv_id", F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("loss")).alias("w"), F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars"))
    whole = own.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns_text, loss_text = F.array_join("w.turns", ""), F.array_join("w.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(turns_text, 256).alias("turns_sha256"), F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
        length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
        + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 16 AS chars FROM r),
p AS (SELECT *, row_number() OVER w - 1 AS seq,
        coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT *, seq = 0 AND role = 'system' AS head FROM p),
h AS (SELECT *, coalesce(max(tokens) FILTER (WHERE head) OVER (PARTITION BY conv_id), 0) AS kept FROM g),
k AS (SELECT *, greatest(before - kept, 0) AS start, greatest(192 - kept, 1) AS cell FROM h),
q AS (SELECT *, CASE WHEN head THEN 0 ELSE 2 * (start // cell) + (start // cell < (start + tokens - 1) // cell)::BIGINT END AS span FROM k),
s AS (SELECT conv_id, span, lead(first) OVER (PARTITION BY conv_id ORDER BY span) AS next_first
      FROM (SELECT conv_id, span, min(before) AS first FROM q GROUP BY ALL)),
c AS (SELECT conv_id, count(*) - 1 AS later FROM s GROUP BY conv_id)
SELECT q.conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * (1 + CASE WHEN head THEN c.later WHEN s.next_first - before <= 64 THEN 1 ELSE 0 END))::BIGINT AS formatted_chars
FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.span = s.span JOIN c ON q.conv_id IS NOT DISTINCT FROM c.conv_id
GROUP BY q.conv_id
"""

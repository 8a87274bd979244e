"""How the supplied tables stand in for the relations of program triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as instructions: a function per user, an address per event, a mnemonic per type."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    mnem = F.when(F.col("event_type") == "view", "mov").when(F.col("event_type") == "signup", "cmp").when(F.col("event_type") == "click", "je").when(F.col("event_type") == "error", "push").otherwise("call")
    kind = F.when(F.col("event_type") == "click", "near").when(F.col("event_type") == "purchase", F.when(i % 2 == 0, "reg").otherwise("near")).when(i % 3 == 0, "displ").otherwise("imm")
    return e.select(F.col("user_id").alias("func_ea"), i.alias("ea"), mnem.alias("mnem"), kind.alias("op_type"), (i % 4).cast("int").alias("reg"), (i * 7919 % 200003).alias("value"), (i * 31 % 5000).alias("addr"))


INSTRUCTIONS_SQL = """
insn AS (SELECT user_id AS func_ea, event_id AS ea,
  CASE event_type WHEN 'view' THEN 'mov' WHEN 'signup' THEN 'cmp' WHEN 'click' THEN 'je' WHEN 'error' THEN 'push' ELSE 'call' END AS mnem,
  CASE WHEN event_type = 'click' THEN 'near' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'reg' ELSE 'near' END
       WHEN event_id % 3 = 0 THEN 'displ' ELSE 'imm' END AS op_type,
  event_id % 4 AS reg, event_id * 7919 % 200003 AS value, event_id * 31 % 5000 AS addr FROM events)"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as functions; every third keeps a generated name, every tenth is a dispatcher."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("sub_"), F.lower(F.hex(k)))).when(k % 10 == 1, F.concat(F.lit("dispatch_"), k)).otherwise(F.concat(F.lit("fun_"), k % 700))
    return c.select(k.alias("ea"), name.alias("name"), (k % 17).cast("int").alias("n_insn"), (F.col("c_nationkey") == 7).alias("is_library"))


FUNCTIONS_SQL = """
fn AS (SELECT c_custkey AS ea, CASE WHEN c_custkey % 3 = 0 THEN 'sub_' || lower(to_hex(c_custkey)) WHEN c_custkey % 10 = 1 THEN 'dispatch_' || c_custkey
  ELSE 'fun_' || (c_custkey % 700) END AS name, c_custkey % 17 AS n_insn, c_nationkey = 7 AS is_library FROM customer)"""


def call_edges(spark: SparkSession, sf_dir: str, down_only: bool = True) -> DataFrame:
    """urgent orders as calls between the functions; with down_only only from higher to lower addresses, so without cycles."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").crossJoin(F.broadcast(n))  # one row
    e = o.select(F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % F.col("n")).alias("callee"), F.col("o_orderkey").alias("ea"))
    return e.filter("caller > callee") if down_only else e


EDGES_SQL = """
raw AS (SELECT o_custkey AS caller, o_orderkey % (SELECT count(*) FROM customer) AS callee, o_orderkey AS ea FROM orders WHERE o_orderpriority = '1-URGENT'),
edge AS (SELECT DISTINCT caller, callee FROM raw WHERE caller > callee)"""


def review_queue(spark: SparkSession, sf_dir: str, streamed: bool = False) -> DataFrame:
    """customers as review-queue rows of three kinds, with dependencies on the previous functions' pending names."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    if streamed:
        c = spark.readStream.schema(c.schema).parquet(f"{sf_dir}/customer.parquet*")  # a pattern, as the table may be one file
    kind = F.when(k % 5 == 0, "variable_rename").when(k % 7 == 0, "prototype_change").otherwise("function_rename")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "applied").when(F.col("c_mktsegment") == "MACHINERY", "rejected").otherwise("pending")
    dep = lambda d: F.struct((F.floor((k - d) / 2)).alias("ea"), F.concat(F.lit("name_"), k - d).alias("suggested_name"))
    return c.select(
        kind.alias("kind"), F.floor(k / 2).alias("ea"), F.concat(F.lit("sub_"), k).alias("old_name"), F.concat(F.lit("name_"), k).alias("suggested_name"), F.concat(F.lit("v"), k % 3).alias("old_var"), F.concat(F.lit("var_"), k).alias("new_var"), F.concat(F.lit("int f"), k, F.lit("(void);")).alias("new_prototype"),
        F.round(F.pmod(F.col("c_acctbal"), F.lit(1000.0)) / 1000, 2).alias("confidence"), status.alias("status"), (k % 4).cast("int").alias("dependency_level"),
        F.when(k % 4 > 1, F.array(dep(1), dep(2))).otherwise(F.array().cast("array<struct<ea:bigint,suggested_name:string>>")).alias("deps"), F.timestamp_seconds(1_700_000_000 + (k * 37 % 1000)).alias("ts"), k.alias("ord"),
    )


QUEUE_SQL = """
q AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'variable_rename' WHEN c_custkey % 7 = 0 THEN 'prototype_change' ELSE 'function_rename' END AS kind,
  c_custkey // 2 AS ea, 'sub_' || c_custkey AS old_name, 'name_' || c_custkey AS suggested_name, 'v' || (c_custkey % 3) AS old_var, 'var_' || c_custkey AS new_var,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'applied' WHEN 'MACHINERY' THEN 'rejected' ELSE 'pending' END AS status, c_custkey % 4 AS dependency_level,
  CASE WHEN c_custkey % 4 > 1 THEN 2 ELSE 0 END AS n_deps, c_custkey * 37 % 1000 AS ts, c_custkey AS ord, c_acctbal FROM customer)"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' JSON properties wrapped as a model might: fenced, in prose, with single quotes, a trailing comma, or broken."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    body = F.regexp_extract("props", r"(\d+)", 1)
    raw = F.when(i % 6 == 0, F.concat(F.lit("```json\n{\"name\": \"fun "), body, F.lit("\", \"confidence\": 0.75, \"evidence\": [\"calls\"], \"category\": \"util\"}\n```")))
    raw = raw.when(i % 6 == 1, F.concat(F.lit("Sure! {\"name\": \"steal_"), body, F.lit("\", \"confidence\": 0.9, \"category\": \"weird\", \"tags\": [\"file\", \"x\"],}")))
    raw = raw.when(i % 6 == 2, F.concat(F.lit("{'name': 'n"), body, F.lit("', 'confidence': 2}")))
    raw = raw.when(i % 6 == 3, F.concat(F.lit("no json "), body)).when(i % 6 == 4, "").otherwise(F.concat(F.lit("{\"function_name\": \"/"), body, F.lit("\", \"score\": 0.25, \"evidence\": \"one\"}")))
    return e.select(F.col("event_id").alias("id"), raw.alias("raw"), body.alias("k"))

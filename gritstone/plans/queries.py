"""One query for each operator, with the same query in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, names
from ..operators import code, contexts, graphs, indicators, state, triage
from ..settings import Settings
from ..sources import decoded, provider, store
from ..streaming import slots
from . import drivers, reports, runs
from .tables import EDGES_SQL, FUNCTIONS_SQL, INSTRUCTIONS_SQL, QUEUE_SQL, call_edges, functions, instructions, messy, review_queue, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _extract_sql(source: str, column: str, kind: str, test: str = "true") -> str:
    return f"""SELECT DISTINCT trim(v) AS value FROM (SELECT unnest(regexp_extract_all({column}, {_quoted(indicators.PATTERNS[kind])})) AS v FROM {source}) WHERE trim(v) <> '' AND ({test.replace("@", "trim(v)")})"""


IPV4_TEST, DOMAIN_TEST = r"NOT regexp_matches(@, '^(0\.0\.0\.|127\.0\.|255\.255\.|169\.254\.)')", r"NOT regexp_matches(@, '^\d+\.\d+\.')"


# Indicators


@query(_extract_sql("documents", "text", "ipv4", IPV4_TEST))
def ioc_ipv4(spark, sf):
    return indicators.extract(table(spark, sf, "documents"), types=("ipv4",)).select("value")


@query(_extract_sql("documents", "text", "email"))
def ioc_email(spark, sf):
    return indicators.extract(table(spark, sf, "documents"), types=("email",)).select("value")


@query(_extract_sql("pages", "html", "domain", DOMAIN_TEST))
def ioc_domain(spark, sf):
    return indicators.extract(table(spark, sf, "pages"), "html", types=("domain",)).select("value")


@query(_extract_sql("pages", "url", "url"))
def ioc_url(spark, sf):
    return indicators.extract(table(spark, sf, "pages"), "url", types=("url",)).select("value")


@query(r"""SELECT DISTINCT v AS value FROM (SELECT unnest(regexp_extract_all(' ' || replace(text, chr(10), ' ' || chr(10) || ' ') || ' ', '[A-Za-z0-9+/]+={0,9}')) AS v FROM documents)
WHERE regexp_matches(v, '^[A-Za-z0-9+/]{40,}={0,2}$') AND NOT regexp_matches(v, '^(AAAA|////|MMMM)') AND len(list_distinct(string_split(v, ''))) >= 6""")
def ioc_base64(spark, sf):
    return indicators.extract(table(spark, sf, "documents"), types=("base64",)).select("value")


_BASE64_SQL = r"""SELECT DISTINCT v AS value FROM (SELECT unnest(regexp_extract_all(' ' || replace(text, chr(10), ' ' || chr(10) || ' ') || ' ', '[A-Za-z0-9+/]+={0,9}')) AS v FROM every)
WHERE regexp_matches(v, '^[A-Za-z0-9+/]{40,}={0,2}$') AND NOT regexp_matches(v, '^(AAAA|////|MMMM)') AND len(list_distinct(string_split(v, ''))) >= 6"""
_TESTS = {"ipv4": IPV4_TEST, "domain": DOMAIN_TEST}
_ALL_TYPES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS type, value FROM ({_BASE64_SQL if t == 'base64' else _extract_sql('every', 'text', t, _TESTS.get(t, 'true'))})" for t in indicators.PATTERNS)


@query(f"WITH every AS (SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT url FROM pages UNION ALL SELECT text FROM conversations) {_ALL_TYPES_SQL}")
def ioc_all_types(spark, sf):
    """Every type over every text of the corpus."""
    texts = table(spark, sf, "documents").select("text").union(table(spark, sf, "pages").select("html")).union(table(spark, sf, "pages").select("url")).union(table(spark, sf, "conversations").select("text"))
    return indicators.extract(texts)


_SOURCES_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS type, value, '{tag}' AS tag FROM ({_extract_sql(source, column, kind, test)})"
    for source, column, tag in (("documents", "text", "documents"), ("pages", "html", "html"), ("pages", "url", "url"))
    for kind, test in (("ipv4", IPV4_TEST), ("email", "true"), ("domain", DOMAIN_TEST), ("url", "true"))
)
_MERGED_SQL = f"WITH h AS ({_SOURCES_SQL}), m AS (SELECT type, value, list_sort(list(DISTINCT tag)) AS s FROM h GROUP BY type, value)"


def _merged(spark, sf):
    pages = table(spark, sf, "pages")
    return indicators.merge_sources((table(spark, sf, "documents"), "text", "documents"), (pages, "html", "html"), (pages, "url", "url"), types=("ipv4", "email", "domain", "url"))


@query(f"{_MERGED_SQL} SELECT type, value, s[1] AS source, array_to_string(s, ',') AS sources FROM m")
def ioc_multisource(spark, sf):
    return _merged(spark, sf).withColumn("sources", F.array_join("sources", ","))


@query(f"{_MERGED_SQL} SELECT type, count(DISTINCT value) AS n FROM m GROUP BY type")
def ioc_type_counts(spark, sf):
    return indicators.type_counts(_merged(spark, sf))


@query(f"WITH every AS (SELECT url AS text FROM pages) SELECT type, value, 'floss_decoded' AS source FROM ({_ALL_TYPES_SQL})")
def ioc_decoded(spark, sf):
    """Indicators in decoded-string records, under their one source."""
    return indicators.from_records(table(spark, sf, "pages").select(F.col("url").alias("string"))).select("type", "value", "source")


_REPORT_SQL = ", ".join(f"'{t}'" for t in indicators.REPORT_ORDER)


@query(f"""{_MERGED_SQL}, r AS (SELECT *, list_position([{_REPORT_SQL}], type) AS section, row_number() OVER (PARTITION BY type ORDER BY value) AS rn, count(*) OVER (PARTITION BY type) AS n FROM m)
SELECT section, type, rn AS line_no, '  ' || value || '  [' || array_to_string(s, ',') || ']' AS line FROM r WHERE rn <= 30
UNION ALL SELECT DISTINCT section, type, 0, '[' || upper(type) || '] (' || n || ')' FROM r
UNION ALL SELECT DISTINCT section, type, 31, '  ... (' || (n - 30) || ' more)' FROM r WHERE n > 30""")
def ioc_report(spark, sf):
    out = indicators.report_lines(_merged(spark, sf))
    return out.select(F.col("section").cast("long").alias("section"), "type", F.col("line_no").cast("long").alias("line_no"), "line")


# Scalars

_SANITIZE = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(trim(replace({0}, '`', '')), '^([^/#]*)', 1)), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^([0-9])', '_\\1')"


@query(f"""WITH s AS (SELECT p_partkey, {_SANITIZE.format("CASE WHEN p_partkey % 3 = 0 THEN p_partkey || ' ' || p_name || '/x' ELSE '`' || p_name || '-' || p_brand || '`' END")} AS c FROM part)
SELECT p_partkey, CASE WHEN c = '' THEN 'unknown_func' ELSE substr(c, 1, 64) END AS name, 'my_' || substr(c, 1, 64) AS prefixed FROM s""")
def sanitize_names(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_partkey", F.lit(" "), "p_name", F.lit("/x"))).otherwise(F.concat(F.lit("`"), "p_name", F.lit("-"), "p_brand", F.lit("`")))
    return table(spark, sf, "part").select("p_partkey", names.sanitize_name(raw).alias("name"), names.sanitize_name(raw, "my_").alias("prefixed"))


_DEFAULT_SQL = "regexp_matches({0}, '(?i)^(sub_|loc_|nullsub_|j_|unknown_libname_|fn_|func_|_[0-9a-f]{{4,}}|[?@]sub_|wrap_sub_)')"


@query(f"WITH {FUNCTIONS_SQL} SELECT ea, {_DEFAULT_SQL.format('name')} AS is_default, CASE WHEN {_DEFAULT_SQL.format('name')} THEN 'default' WHEN ea % 2 = 0 THEN 'named' ELSE 'force' END AS reason FROM fn")
def default_names(spark, sf):
    f = functions(spark, sf)
    return f.select("ea", names.is_default_name(F.col("name")).alias("is_default"), names.rename_reason(F.col("name"), F.col("ea") % 2 == 0).alias("reason"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 12 THEN substr(p_name, 1, 6) || '...' || right(p_name, 4) ELSE '***' END AS masked FROM part")
def mask_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.mask_key(F.col("p_name")).alias("masked"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(names.escape_html(F.col("html")).cast("binary")).alias("escaped"))


def _codes_sql(column):
    return f"list_transform(string_split({column}, ''), lambda c: ascii(c)::BIGINT)"


@query(f"SELECT p_partkey, list_reduce(list_prepend(5381::BIGINT, {_codes_sql('p_name')}), lambda h, c: (h * 33 + c) & 4294967295) AS h FROM part")
def hash_djb2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.hash_djb2(F.col("p_name")).alias("h"))


@query(f"SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, {_codes_sql('p_name')}), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM part")
def hash_fnv1a(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.hash_fnv1a(F.col("p_name")).alias("h"))


@query(f"SELECT p_partkey, list_reduce(list_append(list_prepend(0::BIGINT, {_codes_sql('p_name')}), 0::BIGINT), lambda h, c: (((h >> 13) | ((h % 8192) << 19)) + c) & 4294967295) AS h FROM part")
def hash_ror13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.hash_ror13(F.col("p_name")).alias("h"))


_HASHED_SQL = f"""nm AS (SELECT unnest([{", ".join(f"'{n}'" for n in code.HASHED_NAMES)}]) AS api),
hs AS (SELECT api, 0 AS family, list_reduce(list_append(list_prepend(0::BIGINT, {_codes_sql('api')}), 0::BIGINT), lambda h, c: (((h >> 13) | ((h % 8192) << 19)) + c) & 4294967295) AS value FROM nm
  UNION ALL SELECT api, 1, list_reduce(list_prepend(5381::BIGINT, {_codes_sql('api')}), lambda h, c: (h * 33 + c) & 4294967295) FROM nm
  UNION ALL SELECT api, 1, list_reduce(list_prepend(2166136261::BIGINT, {_codes_sql('api')}), lambda h, c: (xor(h, c) * 16777619) & 4294967295) FROM nm),
hashed AS (SELECT value, api FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY family, api) AS n FROM hs) WHERE n = 1),
known AS (SELECT list_sort(list(value)) AS v FROM hashed)"""


@query(f"""WITH {INSTRUCTIONS_SQL}, {_HASHED_SQL}, i AS (SELECT func_ea, ea, mnem, op_type, v[ea % len(v) + 1] AS value FROM insn, known)
SELECT func_ea, ea, api FROM i JOIN hashed USING (value) WHERE mnem IN ('mov', 'push') AND op_type = 'imm' AND value > 65535""")
def hash_lookup(spark, sf):
    """Instructions whose immediate is the hash of a known name; here every immediate is made one."""
    known = code.hashed_names(spark).agg(F.sort_array(F.collect_list("value")).alias("v"))
    i = instructions(spark, sf).crossJoin(F.broadcast(known)).withColumn("value", F.element_at("v", (F.col("ea") % F.size("v") + 1).cast("int"))).drop("v")  # one row, three values for each known name
    return code.hash_loads(i, code.hashed_names(spark))


@query("""SELECT doc_id, sha256(concat_ws(chr(31), '0x' || lower(to_hex(doc_id)), 'sub_' || doc_id, text, '', 'a,b', '', '', lang, 'v5', 'm', source)) AS key FROM documents""")
def cache_key(spark, sf):
    none = F.array().cast("array<string>")
    key = names.cache_key(F.col("doc_id"), F.concat(F.lit("sub_"), "doc_id"), F.col("text"), none, F.array(F.lit("b"), F.lit("a")), none, none, F.array("lang"), F.lit("m"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", key.alias("key"))


_ERROR_SQL = " ".join("WHEN " + " OR ".join(f"contains(m, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in names.ERROR_WORDS)


@query(f"""WITH e AS (SELECT event_id, lower(CASE event_id % 8 WHEN 0 THEN 'HTTP 429 ' WHEN 1 THEN 'Billing ' WHEN 2 THEN 'timed out ' WHEN 3 THEN '404 ' WHEN 4 THEN 'Unauthorized ' WHEN 5 THEN 'blocked ' WHEN 6 THEN 'generate ' ELSE '' END || event_type) AS m FROM events)
SELECT event_id, CASE {_ERROR_SQL} ELSE 'unknown_error' END AS kind FROM e""")
def error_classify(spark, sf):
    i = F.col("event_id") % 8
    text = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429 ", "Billing ", "timed out ", "404 ", "Unauthorized ", "blocked ", "generate ", "")]), (i + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", names.classify_error(F.concat(text, "event_type")).alias("kind"))


@query("""SELECT p_partkey, '[AI] ' || concat_ws(' | ', p_name, '[FILE,UTIL]', CASE WHEN p_size > 25 THEN '[!] big; odd' END, printf('conf=%.2f', p_size / 50.0::DOUBLE), CASE WHEN p_type <> 'SMALL' THEN 'cat=' || p_type END) AS comment FROM part""")
def comment_text(spark, sf):
    none = F.array().cast("array<string>")
    tags = F.array(F.lit("FILE"), F.lit("UTIL"))
    warnings = F.when(F.col("p_size") > 25, F.array(F.lit("big"), F.lit("odd"), F.lit("third"))).otherwise(none)
    return table(spark, sf, "part").select("p_partkey", names.result_comment(F.col("p_name"), tags, warnings, F.col("p_size") / 50.0, F.when(F.col("p_type") == "SMALL", "UNKNOWN").otherwise(F.col("p_type"))).alias("comment"))


_CLEAN = lambda text: f"(SELECT CASE WHEN c = '' THEN 'unknown_func' ELSE substr(c, 1, 64) END FROM (SELECT {_SANITIZE.format(text)} AS c))"


@query(f"""SELECT p_partkey, concat_ws(chr(10), printf('// Inferred structure  (confidence=%.2f)', p_size / 50.0::DOUBLE), 'typedef struct _' || {_CLEAN('p_name')} || ' {{',
'    int        ' || {_CLEAN('p_brand')} || ';  // +0x00', '    QWORD      ' || {_CLEAN('p_type')} || ';  // +0x08 size', '}} ' || {_CLEAN('p_name')} || ';') AS text FROM part""")
def struct_texts(spark, sf):
    fields = F.array(F.struct(F.lit(8).alias("offset"), F.col("p_type").alias("name"), F.lit("QWORD").alias("type"), F.lit("size").alias("purpose")), F.struct(F.lit(0).alias("offset"), F.col("p_brand").alias("name"), F.lit("int").alias("type"), F.lit("").alias("purpose")))
    return table(spark, sf, "part").select("p_partkey", names.struct_text(F.col("p_name"), F.col("p_size") / 50.0, fields).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'int ' || f || '(void);' WHEN p_partkey % 4 = 1 THEN 'char *' || f || '(int a);' ELSE '' END AS prototype FROM (SELECT p_partkey, 'f_' || p_partkey AS f FROM part)""")
def check_prototypes(spark, sf):
    f, k = F.concat(F.lit("f_"), "p_partkey"), F.col("p_partkey") % 4
    proto = F.when(k == 0, F.concat(F.lit(" int "), f, F.lit("(void);;"))).when(k == 1, F.concat(F.lit("char *"), f, F.lit("(int a)"))).when(k == 2, F.concat(F.lit("int x"), f, F.lit("(void)"))).otherwise(F.concat(F.lit("typedef int "), f, F.lit("(void)")))
    return table(spark, sf, "part").select("p_partkey", names.check_prototype(proto, f).alias("prototype"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.7::DOUBLE ELSE round(least(0.95::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * (c_custkey % 10 / 10.0::DOUBLE)), 3) END AS confidence FROM customer")
def proposal_conf(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", names.proposal_confidence(F.when(k % 3 == 0, 0.7).otherwise(0.95), F.when(k % 3 != 0, k % 10 / F.lit(10.0))).alias("confidence"))


# Tags, scores and selection


@query(f"""WITH {FUNCTIONS_SQL} SELECT CASE WHEN reason IN ('no_name', 'named') THEN reason WHEN n_insn < 5 THEN 'too_small' WHEN ea % 11 = 0 THEN 'no_code' ELSE 'candidate' END AS reason, count(*) AS n
FROM (SELECT *, CASE WHEN {_DEFAULT_SQL.format('name')} THEN 'default' ELSE 'named' END AS reason FROM fn) GROUP BY 1""")
def skip_reasons(spark, sf):
    reason = triage.skip_reason(F.col("name"), F.col("n_insn"), F.col("ea") % 11 != 0)
    return functions(spark, sf).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_API_LIST = ("VirtualAllocEx", "_memcpy", "recvA", "CreateFileW", "unknown_one", "NtMapViewOfSection", "WinExec", "LoadLibraryExA", "GetTickCount", "RegSetValueExExW", "CryptEncrypt")
_API_SQL = "[" + ", ".join(f"'{a}'" for a in _API_LIST) + "]"
_FLAT = {(n + s).lower(): c for c, ns in triage.API_CATEGORIES.items() for n in ns for s in triage.API_SUFFIXES}
_API_TAGS_SQL = "(VALUES " + ", ".join(f"('{a}', '{_FLAT[a.lower().lstrip('_')]}')" for a in _API_LIST if a.lower().lstrip("_") in _FLAT) + ") AS d(api, category)"


def _api_refs(spark, sf):
    api = F.element_at(F.array(*[F.lit(a) for a in _API_LIST]), (F.col("l_partkey") % len(_API_LIST) + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ea"), api.alias("api")).distinct()


@query(f"SELECT DISTINCT l_suppkey AS ea, category AS tag FROM lineitem JOIN {_API_TAGS_SQL} ON {_API_SQL}[l_partkey % {len(_API_LIST)} + 1] = d.api")
def tag_lookup(spark, sf):
    return triage.api_tags(_api_refs(spark, sf), triage.api_dimension(spark)).select("ea", "tag").distinct()


_WORDS_SQL = " UNION ALL ".join(f"SELECT doc_id AS ea, '{tag}' AS tag FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) for tag, words in triage.STRING_WORDS.items())


@query(_WORDS_SQL)
def tag_keywords(spark, sf):
    return triage.string_tags(table(spark, sf, "documents").select(F.col("doc_id").alias("ea"), "text")).select("ea", "tag")


@query(f"""WITH {INSTRUCTIONS_SQL} SELECT func_ea AS ea, 'DISPATCH' AS tag, 'indirect_calls=' || count(*) FILTER (WHERE mnem = 'call' AND op_type = 'reg') AS reason
FROM insn GROUP BY func_ea HAVING count(*) > 60 AND count(*) FILTER (WHERE mnem = 'call' AND op_type = 'reg') >= 3""")
def tag_dispatch(spark, sf):
    return triage.dispatch_tags(instructions(spark, sf), 60)


_HINT_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in triage.TECHNIQUES.items())


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS value FROM documents) WHERE length(value) >= 6 GROUP BY 1 ORDER BY n DESC, value LIMIT 40")
def top_words(spark, sf):
    """The most frequent words of six characters or more in all texts, rare words never counted one by one."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("value"))
    return triage.heavy_values(words, 40, 6)


@query(f"""WITH t AS (SELECT DISTINCT l_suppkey AS ea, category AS tag FROM lineitem JOIN {_API_TAGS_SQL} ON {_API_SQL}[l_partkey % {len(_API_LIST)} + 1] = d.api)
SELECT ea, string_agg(tag, ',' ORDER BY tag) AS tags, coalesce(string_agg(CASE tag {_HINT_SQL} END, ';' ORDER BY tag), '') AS hints FROM t GROUP BY ea""")
def mitre_hints(spark, sf):
    found = triage.classify(triage.api_tags(_api_refs(spark, sf), triage.api_dimension(spark)))
    return found.select("ea", F.array_join("tags", ",").alias("tags"), F.array_join("hints", ";").alias("hints"))


def _contexts(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    pick = lambda n: F.slice(F.array(*[F.lit(a) for a in _API_LIST]), (k % 9 + 1).cast("int"), (k % n).cast("int"))
    name = F.when(k % 5 == 0, "j_resolve").when(k % 7 == 0, "my_malloc").otherwise(F.concat(F.lit("sub_"), k))
    return d.select(k.alias("ea"), name.alias("name"), pick(4).alias("apis"), F.when(k % 13 == 0, F.array_repeat(F.lit("sub_1"), 16)).otherwise(F.array().cast("array<string>")).alias("callees"), F.when(k % 2 == 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("strings"), F.when(k % 6 == 0, F.array(F.lit("xor key"))).alias("decoded"), F.array().cast("array<string>").alias("pre_tags"), (k % 7).cast("int").alias("n_insn"))


def _any_sql(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_CONTEXT_SQL = f"""
c AS (SELECT doc_id AS ea, CASE WHEN doc_id % 5 = 0 THEN 'j_resolve' WHEN doc_id % 7 = 0 THEN 'my_malloc' ELSE 'sub_' || doc_id END AS name,
  lower(array_to_string(list_concat({_API_SQL}[doc_id % 9 + 1 : doc_id % 9 + doc_id % 4], CASE WHEN doc_id % 13 = 0 THEN list_transform(range(16), lambda x: 'sub_1') ELSE [] END), ' ')) AS calls,
  lower(concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN text END, CASE WHEN doc_id % 6 = 0 THEN 'xor key' END)) AS texts,
  doc_id % 7 AS n, doc_id % 13 = 0 AS wide, doc_id % 6 = 0 AS decoded, doc_id % 2 <> 0 AND doc_id % 6 <> 0 AS no_text FROM documents),
s AS (SELECT *, CASE WHEN {_any_sql('calls', triage.NETWORK_CALLS)} OR regexp_matches(texts, 'https?://|ftp://|\\b[a-z0-9.-]+\\.(com|net|org|ru|cn|io)\\b') THEN 3 ELSE 0 END
  + CASE WHEN {_any_sql('calls', triage.CRYPTO_CALLS)} OR contains(texts, 'xor') THEN 2 ELSE 0 END + CASE WHEN {_any_sql('calls', triage.MEMORY_CALLS)} THEN 3 ELSE 0 END
  + CASE WHEN {_any_sql('calls', triage.PROCESS_CALLS)} THEN 3 ELSE 0 END + CASE WHEN {_any_sql('calls', triage.PERSIST_CALLS)} THEN 3 ELSE 0 END
  + CASE WHEN {_any_sql('calls', triage.EVASION_CALLS)} THEN 2 ELSE 0 END
  + CASE WHEN {_any_sql('calls', triage.FILE_CALLS)} AND regexp_matches(texts, '\\.(exe|dll|sys|ps1|bat|vbs|tmp)|appdata|temp|system32') THEN 2 ELSE 0 END
  + CASE WHEN decoded THEN 2 ELSE 0 END + CASE WHEN wide THEN 2 ELSE 0 END + CASE WHEN name LIKE 'j\\_%' ESCAPE '\\' THEN 1 ELSE 0 END
  + CASE WHEN n BETWEEN 1 AND 4 AND calls = '' AND no_text THEN -2 ELSE 0 END AS points FROM c),
r AS (SELECT ea, name, points - CASE WHEN {_any_sql('name', triage.LIBRARY_NAMES)} AND points <= 2 THEN 1 ELSE 0 END AS score FROM s),
p AS (SELECT *, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS priority FROM r)"""


@query(f"WITH {_CONTEXT_SQL} SELECT ea, score, priority, score >= 3 AS interesting FROM p")
def review_score(spark, sf):
    return triage.review_score(_contexts(spark, sf)).select("ea", "score", "priority", "interesting")


@query(f"WITH {_CONTEXT_SQL} SELECT priority, count(*) AS n FROM p GROUP BY priority")
def priority_buckets(spark, sf):
    return triage.review_score(_contexts(spark, sf)).groupBy("priority").agg(F.count("*").alias("n"))


@query(f"""WITH {_CONTEXT_SQL} SELECT ea, name, score FROM p WHERE (ea < 3 OR score >= 3) AND (name LIKE 'sub\\_%' ESCAPE '\\') ORDER BY score DESC, ea LIMIT 80""")
def ai_topk(spark, sf):
    scored = triage.review_score(_contexts(spark, sf)).withColumns({"is_root": F.col("ea") < 3, "ord": F.col("ea")})
    return triage.top_candidates(scored, 80, 3, include_named=False).select("ea", "name", "score")


@query(f"""WITH {_CONTEXT_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE score >= 6) AS ai_analyzed, count(*) FILTER (WHERE priority IN ('high', 'critical')) AS high_or_critical,
count(*) FILTER (WHERE score >= 9) AS suggestions, count(*) FILTER (WHERE score < 6) AS static_only FROM p""")
def analysis_counts(spark, sf):
    scored = triage.review_score(_contexts(spark, sf)).withColumns({"ai_analyzed": F.col("score") >= 6, "apply": F.col("score") >= 9})
    return triage.analysis_summary(scored)


@query(f"WITH {FUNCTIONS_SQL}, k AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT {_DEFAULT_SQL.format('name')}) AS r FROM fn) SELECT n AS n_funcs, r AS n_renamed, n - r AS n_unnamed, r * 100 // n AS percent FROM k")
def coverage(spark, sf):
    return triage.coverage(functions(spark, sf))


@query(f"SELECT {_API_SQL}[l_partkey % {len(_API_LIST)} + 1] AS value, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_apis(spark, sf):
    return triage.top_values(_api_refs(spark, sf).select(F.col("api").alias("value")), 5)


@query("SELECT p_name AS value, count(*) AS n FROM part WHERE length(p_name) >= 6 GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_strings(spark, sf):
    return triage.top_values(table(spark, sf, "part").select(F.col("p_name").alias("value")), 20, 6)


@query(f"""WITH t AS (SELECT DISTINCT l_suppkey AS ea, category AS tag FROM lineitem JOIN {_API_TAGS_SQL} ON {_API_SQL}[l_partkey % {len(_API_LIST)} + 1] = d.api)
SELECT DISTINCT ea FROM t WHERE tag IN ('INJECT', 'PERSIST', 'EVASION', 'CRYPTO', 'LOADER', 'MEMORY')""")
def high_risk(spark, sf):
    return triage.high_risk(triage.classify(triage.api_tags(_api_refs(spark, sf), triage.api_dimension(spark)))).select("ea")


@query(f"WITH {FUNCTIONS_SQL} SELECT ea, name, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY ea) > 1 THEN name || '_' || lower(to_hex(ea & 1048575)) ELSE name END AS applied FROM fn")
def unique_names(spark, sf):
    return triage.unique_names(functions(spark, sf).select("ea", "name"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'failed_queued' WHEN c_custkey % 5 = 0 THEN 'skipped' WHEN conf >= 0.85 AND c_custkey % 4 > 0 THEN 'renamed' WHEN conf >= 0.6 THEN 'queued' ELSE 'comment' END AS outcome
FROM (SELECT c_custkey, c_custkey % 100 / 100.0::DOUBLE AS conf FROM customer)""")
def decision(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, "").when(k % 5 == 0, "old").otherwise("new")
    return table(spark, sf, "customer").select(k, triage.decision(k % 9 == 0, name, F.lit("old"), k % 100 / F.lit(100.0), k % 4).alias("outcome"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'failed_queued' WHEN c_custkey % 5 = 0 THEN 'skipped' WHEN c_custkey % 100 >= 85 AND c_custkey % 4 > 0 THEN 'renamed' WHEN c_custkey % 100 >= 60 THEN 'queued' ELSE 'comment' END AS outcome FROM customer) GROUP BY outcome""")
def run_counts(spark, sf):
    return state.run_counts(decision(spark, sf))


@query(f"SELECT count(DISTINCT l_suppkey) AS n FROM lineitem JOIN {_API_TAGS_SQL} ON {_API_SQL}[l_partkey % {len(_API_LIST)} + 1] = d.api")
def tagged_functions(spark, sf):
    """How many functions of the program have any tag."""
    return triage.tagged_count(triage.classify(triage.api_tags(_api_refs(spark, sf), triage.api_dimension(spark))))


# Instruction passes and references


@query(f"""WITH {INSTRUCTIONS_SQL} SELECT func_ea, ea, reg, pointer FROM (SELECT *, last_value(CASE WHEN mnem = 'mov' THEN addr END IGNORE NULLS) OVER (PARTITION BY func_ea, reg ORDER BY ea ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pointer FROM insn) WHERE mnem = 'call' AND pointer IS NOT NULL""")
def pass2_lastload(spark, sf):
    return code.last_loads(instructions(spark, sf)).select("func_ea", "ea", F.col("reg").cast("long").alias("reg"), "pointer")


@query(f"""WITH {INSTRUCTIONS_SQL}, {FUNCTIONS_SQL}, r AS (SELECT i.*, count(*) FILTER (WHERE mnem <> 'cmp') OVER (PARTITION BY func_ea ORDER BY i.ea ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM insn i JOIN fn ON i.func_ea = fn.ea WHERE name LIKE 'dispatch%'),
v AS (SELECT *, last_value(CASE WHEN mnem = 'cmp' AND op_type = 'imm' AND value > 65535 THEN value END IGNORE NULLS) OVER (PARTITION BY func_ea, run ORDER BY ea ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
SELECT func_ea, seen AS value, max_by(addr, ea) AS target FROM v WHERE mnem = 'je' AND seen IS NOT NULL GROUP BY func_ea, seen""")
def pass3_cmp_jcc(spark, sf):
    return code.compare_jumps(instructions(spark, sf), functions(spark, sf))


@query(f"WITH {INSTRUCTIONS_SQL}, f AS (SELECT *, min(CASE WHEN mnem = 'call' THEN ea END) OVER (PARTITION BY func_ea) AS first FROM insn) SELECT func_ea, count(*) FILTER (WHERE mnem = 'push' AND ea < first) AS pushes FROM f GROUP BY func_ea")
def pass4_pushcount(spark, sf):
    return code.push_counts(instructions(spark, sf))


@query(f"WITH {EDGES_SQL} SELECT caller, min(callee) AS target, count(*) AS n FROM raw GROUP BY caller HAVING count(DISTINCT callee) = 1")
def single_target(spark, sf):
    return code.single_targets(call_edges(spark, sf, False).select("caller", F.col("callee").alias("target")))


_WRAPPERS_SQL = f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, {INSTRUCTIONS_SQL}, one AS (SELECT caller, min(callee) AS target FROM raw GROUP BY caller HAVING count(DISTINCT callee) = 1),
fc AS (SELECT func_ea, min(ea) FILTER (WHERE mnem = 'call') AS first FROM insn GROUP BY func_ea), ps AS (SELECT insn.func_ea, count(*) AS pushes FROM insn JOIN fc ON fc.func_ea = insn.func_ea WHERE mnem = 'push' AND ea < first GROUP BY insn.func_ea),
w AS (SELECT caller, f.name AS old_name, regexp_replace(t.name, '^(j_|_+)', '') AS bare, coalesce(pushes, 0) AS n FROM one JOIN fn f ON caller = f.ea JOIN fn t ON target = t.ea LEFT JOIN ps ON caller = func_ea
  WHERE ({_DEFAULT_SQL.format('f.name')} OR regexp_matches(f.name, '(?i)(wrapper|indirect|dynamic|dispatch|thunk|sub_)')) AND NOT {_DEFAULT_SQL.format('t.name')}),
v AS (SELECT caller, old_name, CASE WHEN {_DEFAULT_SQL.format('old_name')} THEN 'resolve_and_call_' || bare || CASE WHEN n > 0 THEN '_a' || n ELSE '' END WHEN contains(lower(old_name), 'indirect') THEN 'indirect_call_' || bare ELSE 'wrap_' || bare END AS made FROM w),
m AS (SELECT caller, old_name, substr({_SANITIZE.format('made')}, 1, 64) AS fresh FROM v), tk AS (SELECT name, min(ea) AS owner FROM fn GROUP BY name),
x AS (SELECT m.*, owner, row_number() OVER (PARTITION BY fresh ORDER BY caller) AS nth FROM m LEFT JOIN tk ON fresh = name)
SELECT caller AS ea, old_name, CASE WHEN (owner IS NOT NULL AND owner <> caller) OR nth > 1 THEN fresh || '_' || lower(to_hex(caller & 4095)) ELSE fresh END AS new_name FROM x"""


@query(_WRAPPERS_SQL)
def wrapper_names(spark, sf):
    single = code.single_targets(call_edges(spark, sf, False).select("caller", F.col("callee").alias("target")))
    return code.wrapper_names(single, functions(spark, sf), code.push_counts(instructions(spark, sf)))


_REFS = "r AS (SELECT caller AS src, callee AS dst, ea FROM raw)"


@query(f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, {_REFS}, s AS (SELECT src, name, min(r.ea) AS pos FROM r JOIN fn ON fn.ea = dst WHERE src <> dst GROUP BY src, name),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pos, name) AS n FROM s) SELECT src AS ea, string_agg(name, ',' ORDER BY n) AS names FROM k WHERE n <= 20 GROUP BY src""")
def callee_names(spark, sf):
    edges = call_edges(spark, sf, False).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "ea")
    return code.first_names(edges, functions(spark, sf), 20).select("ea", F.array_join("names", ",").alias("names"))


@query(f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, {_REFS}, s AS (SELECT dst, name, min(r.ea) AS pos FROM r JOIN fn ON fn.ea = src WHERE src <> dst GROUP BY dst, name),
k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY pos, name) AS n FROM s) SELECT dst AS ea, string_agg(name, ',' ORDER BY n) AS names FROM k WHERE n <= 10 GROUP BY dst""")
def caller_names(spark, sf):
    edges = call_edges(spark, sf, False).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "ea")
    return code.first_names(edges, functions(spark, sf), 10, by="dst", of="src").select("ea", F.array_join("names", ",").alias("names"))


@query(f"WITH {EDGES_SQL} SELECT ea, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees FROM (SELECT c_custkey AS ea FROM customer) LEFT JOIN (SELECT callee, count(*) AS n FROM raw GROUP BY 1) i ON ea = callee LEFT JOIN (SELECT caller, count(DISTINCT callee) AS n FROM raw GROUP BY 1) o ON ea = caller")
def xref_counts(spark, sf):
    return code.xref_counts(call_edges(spark, sf, False).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), functions(spark, sf))


@query(f"WITH {INSTRUCTIONS_SQL}, {FUNCTIONS_SQL} SELECT fn.ea, name, count(insn.ea) AS n_insn FROM fn LEFT JOIN insn ON fn.ea = func_ea GROUP BY fn.ea, name")
def function_sizes(spark, sf):
    return code.function_sizes(functions(spark, sf), instructions(spark, sf))


@query(f"""WITH {INSTRUCTIONS_SQL}, s AS (SELECT func_ea, value, min(ea) AS pos FROM insn WHERE op_type = 'imm' AND value > 65535 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY func_ea ORDER BY pos, '0x' || lower(to_hex(value))) AS n FROM s)
SELECT func_ea AS ea, string_agg('0x' || lower(to_hex(value)), ',' ORDER BY n) AS names FROM k WHERE n <= 30 GROUP BY func_ea""")
def constants(spark, sf):
    return code.constants(instructions(spark, sf)).select("ea", F.array_join("names", ",").alias("names"))


@query(f"""WITH {INSTRUCTIONS_SQL}, s AS (SELECT func_ea, list_sort(list(DISTINCT value // 50)) AS l FROM insn WHERE op_type = 'displ' AND value // 50 BETWEEN 1 AND 4095 GROUP BY func_ea)
SELECT func_ea, array_to_string(l[1:24], ',') AS offsets FROM s""")
def struct_offsets(spark, sf):
    small = instructions(spark, sf).withColumn("value", F.expr("value div 50"))
    return code.struct_offsets(code.struct_accesses(small, 10_000)).select("func_ea", F.array_join("offsets", ",").alias("offsets"))


@query("""WITH f AS (SELECT s_suppkey * 1000 AS s, s_suppkey * 1000 + 700 AS e FROM supplier), r AS (SELECT l_orderkey * 8 + l_linenumber AS ord, 'text ' || (l_partkey % 50) AS string, l_partkey * 53 % 101000 AS address, CASE WHEN l_partkey % 9 = 0 THEN l_suppkey * 1000 END AS owner FROM lineitem),
b AS (SELECT s AS ea, ord, string FROM r JOIN f ON owner = s UNION ALL SELECT s, ord, string FROM r JOIN f ON address >= s AND address < e), g AS (SELECT ea, string AS value, min(ord) AS o FROM b GROUP BY 1, 2)
SELECT ea, value FROM (SELECT *, row_number() OVER (PARTITION BY ea ORDER BY o) AS n FROM g) WHERE n <= 30""")
def range_join(spark, sf):
    f = table(spark, sf, "supplier").select((F.col("s_suppkey") * 1000).alias("start"), (F.col("s_suppkey") * 1000 + 700).alias("end"))
    k = F.col("l_partkey")
    r = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("text "), k % 50).alias("string"), (k * 53 % 101000).alias("address"), F.when(k % 9 == 0, F.col("l_suppkey") * 1000).alias("function_ea"), F.lit("x").alias("kind"))
    return code.decoded_for_functions(r, f, width=1024).select("ea", "value")


_PROMPT_SQL = f"""SELECT doc_id AS ea, CASE WHEN doc_id % 5 = 0 THEN 'j_resolve' WHEN doc_id % 7 = 0 THEN 'my_malloc' ELSE 'sub_' || doc_id END AS name,
  {_API_SQL}[doc_id % 9 + 1 : doc_id % 9 + doc_id % 4] AS apis, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS code, doc_id % 6 = 0 AS decoded FROM documents"""


@query(f"""SELECT ea, concat_ws(chr(10), '--- ' || name || ' ---', '// Called by: main', CASE WHEN code <> '' THEN '// Strings: ' || code END, CASE WHEN decoded THEN '// Decoded strings: xor key' END,
  CASE WHEN len(apis) > 0 THEN '// APIs: ' || array_to_string(apis, ', ') END, '// Constants: 0x10000', '```', substr(code, 1, 3000), '```') AS prompt FROM ({_PROMPT_SQL})""")
def prompt_texts(spark, sf):
    c = _contexts(spark, sf).select("ea", F.struct("name", "callees", F.array(F.lit("main")).alias("callers"), "strings", "decoded", "apis", F.array(F.lit("0x10000")).alias("constants"), "pre_tags", F.array().cast("array<string>").alias("hints"), F.element_at(F.concat("strings", F.array(F.lit(""))), 1).alias("code")).alias("item"))
    return c.select("ea", code.prompt_text(F.col("item")).alias("prompt"))


@query(f"""WITH {EDGES_SQL}, k AS (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY callee) AS n FROM edge) SELECT caller, string_agg(substr('summary of function ' || callee, 1, 20), ';' ORDER BY n) AS text FROM k WHERE n <= 12 GROUP BY caller""")
def child_summaries(spark, sf):
    items = call_edges(spark, sf).select("caller", "callee").distinct().select("caller", F.col("callee").alias("ord"), F.concat(F.lit("f"), "callee").alias("name"), F.concat(F.lit("summary of function "), "callee").alias("summary"))
    return triage.cut_summaries(items, 12, 20).select("caller", F.array_join(F.col("summaries.summary"), ";").alias("text"))


# Graphs


def _nodes(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("ea"))


_LEVELS_SQL = f"""WITH RECURSIVE {EDGES_SQL}, walk(ea, level) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT caller FROM edge)
  UNION SELECT edge.caller, walk.level + 1 FROM walk JOIN edge ON edge.callee = walk.ea), lv AS (SELECT ea, max(level)::INT AS level FROM walk GROUP BY ea)"""


@query(f"WITH {EDGES_SQL} SELECT caller, callee FROM edge")
def call_edges_within(spark, sf):
    return graphs.edges_within(call_edges(spark, sf), _nodes(spark, sf))


@query(f"WITH {EDGES_SQL}, b AS (SELECT caller AS ea, callee AS o, NULL AS i FROM edge UNION ALL SELECT callee, NULL, caller FROM edge) SELECT ea, coalesce(string_agg(i, ',' ORDER BY i), '') AS callers, coalesce(string_agg(o, ',' ORDER BY o), '') AS callees FROM b GROUP BY ea")
def neighbours(spark, sf):
    return graphs.neighbours(call_edges(spark, sf)).select("ea", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {FUNCTIONS_SQL}, e2 AS (SELECT DISTINCT caller, callee FROM raw WHERE caller <> callee AND callee NOT IN (SELECT ea FROM fn WHERE is_library)),
w(ea, depth) AS (SELECT ea, 0 FROM fn WHERE ea % 400 = 5 AND NOT is_library UNION SELECT callee, depth + 1 FROM w JOIN e2 ON caller = ea WHERE depth < 3) SELECT ea, min(depth)::INT AS depth FROM w GROUP BY ea""")
def bfs_depth(spark, sf):
    nodes, _, _ = graphs.reach(call_edges(spark, sf, False), _nodes(spark, sf).filter("ea % 400 = 5"), functions(spark, sf), 3, 100_000)
    return nodes.select("ea", "depth")


_REACHED_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {FUNCTIONS_SQL}, lib AS (SELECT ea FROM fn WHERE is_library), e1 AS (SELECT DISTINCT caller, callee FROM raw WHERE caller <> callee),
e2 AS (SELECT * FROM e1 WHERE callee NOT IN (SELECT ea FROM lib)), w(ea, depth) AS (SELECT ea, 0 FROM fn WHERE ea % 400 = 5 AND NOT is_library UNION SELECT callee, depth + 1 FROM w JOIN e2 ON caller = ea WHERE depth < 3)"""


def _reached(spark, sf):
    return graphs.reach(call_edges(spark, sf, False), _nodes(spark, sf).filter("ea % 400 = 5"), functions(spark, sf), 3, 100_000)


@query(f"{_REACHED_SQL} SELECT caller, callee FROM e2 WHERE caller IN (SELECT ea FROM w)")
def bfs_edges(spark, sf):
    """The edges that a traversal took or may take from the functions it accepted."""
    return _reached(spark, sf)[1]


@query(f"{_REACHED_SQL} SELECT 'library_or_thunk' AS reason, count(*) AS n FROM e1 WHERE caller IN (SELECT ea FROM w) AND callee IN (SELECT ea FROM lib) HAVING count(*) > 0")
def bfs_skipped(spark, sf):
    """What a traversal left out, by reason."""
    return _reached(spark, sf)[2]


def _queue_order_sql(depth: int, most: int) -> str:
    """Rounds of a queue, one after the other: a function's place follows its first parent's, then its address."""
    rounds = ["f0 AS MATERIALIZED (SELECT ea, 0 AS depth, row_number() OVER (ORDER BY ea) AS pos FROM fn WHERE ea % 400 = 5 AND NOT is_library), s0 AS MATERIALIZED (SELECT * FROM f0)"]
    for d in range(1, depth + 1):
        rounds.append(f"""f{d} AS MATERIALIZED (SELECT callee AS ea, {d} AS depth, row_number() OVER (ORDER BY parent, callee) + (SELECT count(*) FROM s{d - 1}) AS pos
  FROM (SELECT callee, min(pos) AS parent FROM f{d - 1} JOIN e2 ON caller = ea WHERE callee NOT IN (SELECT ea FROM s{d - 1}) GROUP BY callee)),
s{d} AS MATERIALIZED (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM f{d})""")
    return f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, e2 AS (SELECT DISTINCT caller, callee FROM raw WHERE caller <> callee AND callee NOT IN (SELECT ea FROM fn WHERE is_library)),
{", ".join(rounds)} SELECT ea, depth, pos FROM s{depth} WHERE pos <= {most}"""


@query(_queue_order_sql(5, 300))
def bfs_capped(spark, sf):
    """The first 300 functions in queue order."""
    nodes, _, _ = graphs.reach(call_edges(spark, sf, False), _nodes(spark, sf).filter("ea % 400 = 5"), functions(spark, sf), 5, 300)
    return nodes


@query(f"{_LEVELS_SQL} SELECT ea, level FROM lv")
def bottom_up_levels(spark, sf):
    return graphs.bottom_up_levels(_nodes(spark, sf), call_edges(spark, sf)).select("ea", "level")


@query(f"{_LEVELS_SQL} SELECT ea, row_number() OVER (ORDER BY level, ea) AS ord FROM lv")
def kahn_order(spark, sf):
    return graphs.callees_first(graphs.bottom_up_levels(_nodes(spark, sf), call_edges(spark, sf)))


_SCC_SQL = f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT caller, callee FROM raw WHERE caller <> callee), nd AS (SELECT caller AS ea FROM raw UNION SELECT callee FROM raw),
r(a, b) AS (SELECT caller, callee FROM e UNION SELECT r.a, e.callee FROM r JOIN e ON r.b = e.caller),
mutual AS (SELECT x.a AS ea, min(x.b) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
scc AS (SELECT nd.ea, least(nd.ea, coalesce(low, nd.ea)) AS component FROM nd LEFT JOIN mutual ON nd.ea = mutual.ea),
cyc AS (SELECT ea, component AS group_id FROM scc WHERE component IN (SELECT component FROM scc GROUP BY component HAVING count(*) > 1) OR ea IN (SELECT caller FROM raw WHERE caller = callee))"""


@query(f"{_SCC_SQL} SELECT ea, component FROM scc")
def scc_groups(spark, sf):
    return graphs.strong_components(call_edges(spark, sf, False))


@query(f"{_SCC_SQL} SELECT ea, group_id FROM cyc")
def cycle_split(spark, sf):
    return graphs.cyclic_nodes(call_edges(spark, sf, False))


@query(f"""{_SCC_SQL}, rest AS (SELECT * FROM e WHERE caller NOT IN (SELECT ea FROM cyc) AND callee NOT IN (SELECT ea FROM cyc)),
walk(ea, level) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT caller FROM rest) AND c_custkey NOT IN (SELECT ea FROM cyc) UNION SELECT rest.caller, walk.level + 1 FROM walk JOIN rest ON rest.callee = walk.ea)
SELECT ea, max(level)::INT AS level, false AS is_cycle, NULL::BIGINT AS group_id FROM walk GROUP BY ea UNION ALL SELECT ea, NULL, true, group_id FROM cyc WHERE ea IN (SELECT c_custkey FROM customer)""")
def levels_with_cycles(spark, sf):
    """Levels on a graph that has cycles: their members have a group and no level."""
    return graphs.bottom_up_levels(_nodes(spark, sf), call_edges(spark, sf, False))


@query(f"""{_SCC_SQL}, home AS (SELECT c_custkey AS ea, coalesce(component, c_custkey) AS component FROM customer LEFT JOIN (SELECT * FROM scc2) ON c_custkey = ea),
between AS (SELECT DISTINCT x.component AS caller, y.component AS callee FROM within JOIN home x ON caller = x.ea JOIN home y ON callee = y.ea WHERE x.component <> y.component),
walk(c, height) AS (SELECT DISTINCT component, 0 FROM home UNION SELECT between.caller, walk.height + 1 FROM walk JOIN between ON between.callee = walk.c),
top AS (SELECT c, max(height)::INT AS height FROM walk GROUP BY c)
SELECT ea, component, height, row_number() OVER (ORDER BY height, component, ea) AS ord FROM home JOIN top ON component = c""".replace("cyc AS", """within AS (SELECT caller, callee FROM e WHERE caller IN (SELECT c_custkey FROM customer) AND callee IN (SELECT c_custkey FROM customer)),
r2(a, b) AS (SELECT caller, callee FROM within UNION SELECT r2.a, within.callee FROM r2 JOIN within ON r2.b = within.caller),
mutual2 AS (SELECT x.a AS ea, min(x.b) AS low FROM r2 x JOIN r2 y ON x.a = y.b AND x.b = y.a GROUP BY x.a), scc2 AS (SELECT ea, least(ea, low) AS component FROM mutual2),
cyc AS"""))
def callee_order(spark, sf):
    """Callees first on a graph with cycles: only members of one cycle may come in any order."""
    return graphs.callees_first_with_cycles(_nodes(spark, sf), call_edges(spark, sf, False))


@query(f"{_LEVELS_SQL} SELECT ea FROM lv WHERE level = 1")
def level_members(spark, sf):
    return graphs.level_members(graphs.bottom_up_levels(_nodes(spark, sf), call_edges(spark, sf)), 1)


@query()
def back_edges(spark, sf):
    return graphs.back_edges(call_edges(spark, sf, False).withColumn("program_id", F.col("ea") % 2)).withColumn("path", F.array_join("path", ">"))


@query(f"{_LEVELS_SQL} SELECT ea, level::BIGINT AS group_no, false AS is_cycle, ((row_number() OVER (PARTITION BY level ORDER BY ea) - 1) // 40)::BIGINT AS batch FROM lv")
def level_batches(spark, sf):
    out = graphs.level_batches(graphs.bottom_up_levels(_nodes(spark, sf), call_edges(spark, sf)), graphs.dynamic_batch("strict_bottom_up"))
    return out.select("ea", F.col("group_no").cast("long").alias("group_no"), "is_cycle", F.col("batch").cast("long").alias("batch"))


@query(f"""{_LEVELS_SQL}, g AS (SELECT level, count(*) FILTER (WHERE ea % 3 > 0) AS o, count(*) FILTER (WHERE ea % 3 = 0) AS k FROM lv GROUP BY level)
SELECT sum((o + 39) // 40)::BIGINT AS requests, sum(k)::BIGINT AS cached, sum(o)::BIGINT AS uncached, count(*) AS levels, 0::BIGINT AS cycle_groups, sum((o + 39) // 40) > 25 AS exceeded,
CASE WHEN sum((o + 39) // 40) > 25 THEN 'over budget: take fewer functions, more cached answers, or best_effort_bottom_up' ELSE 'fits the budget' END AS recommendation FROM g""")
def request_estimate(spark, sf):
    levels = graphs.bottom_up_levels(_nodes(spark, sf), call_edges(spark, sf))
    return graphs.request_estimate(levels, _nodes(spark, sf).filter("ea % 3 = 0"), 40)


@query(f"""WITH {EDGES_SQL} SELECT c_custkey AS ea FROM customer ORDER BY c_custkey IN (SELECT caller FROM edge), -(c_custkey % 4 * 10 + c_custkey % 3), c_custkey LIMIT 250""")
def scope_reduce(spark, sf):
    many = lambda n: F.array_repeat(F.lit("x"), (F.col("ea") % n).cast("int"))
    c = _nodes(spark, sf).select("ea", many(4).alias("pre_tags"), many(3).alias("apis"), F.array().cast("array<string>").alias("strings"))
    return graphs.reduced_scope(c, call_edges(spark, sf)).select("ea")


@query("SELECT ea, (n // 20)::BIGINT AS batch FROM (SELECT c_custkey AS ea, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS n FROM customer) WHERE n < 100")
def retry_plan(spark, sf):
    missing = table(spark, sf, "customer").select(F.col("c_custkey").alias("ea"), F.struct("c_acctbal", "c_custkey").alias("ord"))
    return graphs.retry_batches(missing, 40).select("ea", F.col("batch").cast("long").alias("batch"))


@query("""WITH RECURSIVE i AS (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, source, doc_id, n_chars AS c FROM documents),
w(source, n, doc_id, batch, total, k) AS (SELECT source, n, doc_id, 0, c, 1 FROM i WHERE n = 1 UNION ALL SELECT w.source, i.n, i.doc_id, w.batch + CASE WHEN w.total + i.c > 20000 OR w.k >= 12 THEN 1 ELSE 0 END, CASE WHEN w.total + i.c > 20000 OR w.k >= 12 THEN 0 ELSE w.total END + i.c, CASE WHEN w.total + i.c > 20000 OR w.k >= 12 THEN 0 ELSE w.k END + 1 FROM w JOIN i ON i.source = w.source AND i.n = w.n + 1)
SELECT source, doc_id AS ord, batch FROM w""")
def pack_batches(spark, sf):
    items = table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), F.col("n_chars").alias("chars"))
    return graphs.packed_batches(items, 20000, 12, "source")


@query(f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL} SELECT caller AS ea, string_agg(callee, ',' ORDER BY callee) AS children, min(callee % 100 / 100.0::DOUBLE) AS least_confidence FROM edge JOIN fn ON callee = fn.ea WHERE callee % 2 = 0 GROUP BY caller""")
def child_context(spark, sf):
    v = functions(spark, sf).select("ea", F.col("name").alias("idb_name"), F.when(F.col("ea") % 2 == 0, F.concat(F.lit("new_"), "ea")).otherwise(F.col("name")).alias("suggested_name"), (F.col("ea") % 100 / F.lit(100.0)).alias("confidence"), F.when(F.col("ea") % 2 == 0, "pending_review").otherwise("applied").alias("status"), F.array(F.lit("e")).alias("evidence"))
    return graphs.child_context(call_edges(spark, sf), v).select("ea", F.array_join("children", ",").alias("children"), "least_confidence")


# Answers


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '{"name": "fun ' || k || '", "confidence": 0.75, "evidence": ["calls"], "category": "util"}'
WHEN 1 THEN '{"name": "steal_' || k || '", "confidence": 0.9, "category": "weird", "tags": ["file", "x"]}' WHEN 2 THEN '{"name": "n' || k || '", "confidence": 2}' WHEN 3 THEN 'no json ' || k WHEN 4 THEN '{}'
ELSE '{"function_name": "/' || k || '", "score": 0.25, "evidence": "one"}' END AS repaired FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def json_repair(spark, sf):
    return messy(spark, sf).select("id", answers.repair_json(F.col("raw")).alias("repaired"))


@query("""SELECT id, CASE m WHEN 0 THEN 'fun_' || k WHEN 1 THEN 'steal_' || k WHEN 2 THEN 'n' || k ELSE 'sub_' || id END AS name, CASE m WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 5 THEN 0.25 ELSE 0.0 END::DOUBLE AS confidence,
CASE m WHEN 0 THEN 'UTIL' WHEN 1 THEN 'FILE' ELSE 'UNKNOWN' END AS category, CASE WHEN m IN (0, 5) THEN 1 ELSE 0 END AS n_evidence, CASE WHEN m IN (1, 3, 4) THEN 1 ELSE 0 END AS n_warnings, m IN (3, 4) AS error
FROM (SELECT event_id AS id, event_id % 6 AS m, regexp_extract(props, '(\\d+)', 1) AS k FROM events)""".replace("\\\\d", "\\d"))
def normalize_result(spark, sf):
    rows = answers.with_parsed(messy(spark, sf), "raw").select("id", answers.normalize_answer(F.col("parsed"), F.concat(F.lit("sub_"), "id")).alias("r"))
    return rows.select("id", "r.name", "r.confidence", "r.category", F.size("r.evidence").alias("n_evidence"), F.size("r.warnings").alias("n_warnings"), "r.error")


@query("SELECT id, CASE WHEN m IN (0, 5) THEN '' ELSE 'evidence missing or empty' END AS issues FROM (SELECT event_id AS id, event_id % 6 AS m FROM events)")
def validate_result(spark, sf):
    rows = answers.with_parsed(messy(spark, sf), "raw").select("id", answers.normalize_answer(F.col("parsed"), F.concat(F.lit("sub_"), "id")).alias("r"))
    return rows.select("id", F.array_join(answers.answer_issues(F.col("r")), ";").alias("issues"))


@query("""SELECT id, CASE m WHEN 5 THEN 'unknown_func' ELSE 'sub_' || id END AS function_name, CASE m WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE m WHEN 0 THEN 'UTIL' ELSE 'UNKNOWN' END AS category,
'low' AS priority, false AS apply, CASE WHEN m IN (0, 5) THEN '' ELSE 'evidence missing' END AS issues FROM (SELECT event_id AS id, event_id % 6 AS m FROM events)""")
def normalize_analysis(spark, sf):
    rows = answers.with_parsed(messy(spark, sf), "raw").select("id", answers.normalize_analysis(F.col("parsed"), F.concat(F.lit("sub_"), "id")).alias("r"))
    return rows.select("id", "r.function_name", "r.confidence", "r.category", "r.priority", "r.rename_recommendation.apply", F.array_join(answers.analysis_issues(F.col("r")), ";").alias("issues"))


@query("""WITH s AS (SELECT l_orderkey AS ea, l_linenumber AS ord, 'v' || (l_partkey % 3) AS o, CASE WHEN l_partkey % 5 = 0 THEN 'v' || (l_partkey % 3) ELSE 'size_' || (l_partkey % 100) END AS n, l_discount * 10 AS c, l_partkey % 2 = 0 AS why FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY ea, o ORDER BY ord) AS k FROM s WHERE o <> n AND o <> 'v2') SELECT ea, o AS old_name, n AS new_name, round(CASE WHEN why THEN least(1.0::DOUBLE, c) ELSE least(0.5::DOUBLE, c) END, 3) AS confidence, CASE WHEN why THEN 'because' ELSE '' END AS reason FROM g WHERE k = 1""")
def variable_suggestions(spark, sf):
    """Suggestions of a function in the order of their line numbers, those of one number in the order of the table; every function has v0 and v1.

    A suggestion without a line number comes last, one without a confidence is sure.
    """
    k, place = F.col("l_partkey"), F.struct(F.isnull("l_linenumber"), "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ea"), place.alias("ord"), F.concat(F.lit("v"), k % 3).alias("old_name"), F.when(k % 5 == 0, F.concat(F.lit("V"), k % 3)).otherwise(F.concat(F.lit("Size "), k % 100)).alias("new_name"), F.least(F.lit(1.0), F.col("l_discount") * 10).alias("confidence"), F.when(k % 2 == 0, "because").alias("reason"))
    known = s.select("ea").distinct().select("ea", F.explode(F.array(F.lit("v0"), F.lit("v1"))).alias("var"))
    return answers.check_suggestions(s, known)


@query(f"SELECT ea AS id, CASE WHEN len(apis) > 0 THEN regexp_replace('call_' || apis[1], '_+', '_', 'g') ELSE name END AS name, CASE WHEN len(apis) > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence, false AS error FROM ({_PROMPT_SQL})")
def offline_answers(spark, sf):
    """Prompts sent to the offline provider, its answers parsed and normalised."""
    asked = provider.ask(prompt_texts(spark, sf).select(F.col("ea").alias("id"), "prompt"), keys=("a", "b"))
    rows = answers.with_parsed(asked, "raw").select("id", answers.normalize_answer(F.col("parsed"), F.concat(F.lit("sub_"), "id")).alias("r"))
    return rows.select("id", "r.name", "r.confidence", "r.error")


@query("SELECT c_custkey AS id, 'int f_' || c_custkey || '(void)' AS prototype, NULL AS error FROM customer")
def shared_answers(spark, sf):
    """Prototypes asked for every function by tasks that share three keys; one of them is refused, and no answer is lost by it."""

    def refused(prompt, key):
        if key == "bad":
            raise RuntimeError("401 unauthorized")
        return provider.offline(prompt, key)

    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Task: prototype\nFunction: f_"), "c_custkey").alias("prompt"))
    asked = provider.ask_together(requests, refused, keys=("bad", "good", "other"))
    return asked.select("id", F.get_json_object("raw", "$.prototype").alias("prototype"), "error")


@query("""SELECT doc, string, address FROM (SELECT event_id AS doc, unnest([{'string': 'text ' || (event_id % 10), 'address': event_id}, {'string': 'plain ' || event_type, 'address': NULL}]) AS x FROM events WHERE event_id % 2 = 0) t, (SELECT x.string AS string, x.address AS address)
UNION ALL SELECT event_id, 'line ' || event_type, event_id FROM events WHERE event_id % 2 = 1""")
def decoded_strings(spark, sf):
    i = F.col("event_id")
    as_json = F.concat(F.lit('{"strings": {"decoded_strings": [{"string": "text '), i % 10, F.lit('", "va": "0x'), F.lower(F.hex(i)), F.lit('"}, {"string": "text '), i % 10, F.lit('", "va": "0x'), F.lower(F.hex(i)), F.lit('"}, "abc"], "stack_strings": ["plain '), "event_type", F.lit('"]}}'))
    as_text = F.concat(F.lit("# note\nSTRINGS:\n"), i, F.lit(": \"line "), "event_type", F.lit("\"\nabc\n"))
    raw = table(spark, sf, "events").select(i.alias("doc"), F.when(i % 2 == 0, as_json).otherwise(as_text).alias("raw"))
    return decoded.parse_any(raw).select("doc", "string", "address")


@query("""SELECT string, kind, address, function_ea, detail, NULL AS problem FROM (SELECT o_orderpriority || ' ' || o_orderkey AS string, CASE o_orderkey % 3 WHEN 0 THEN 'stack_strings' WHEN 1 THEN 'tight_strings' ELSE 'decoded_strings' END AS kind,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 16 WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS address, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS function_ea, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS detail FROM orders)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'broken_json' FROM nation UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'no_lists' FROM region
UNION ALL SELECT s_name, 'text_output', s_suppkey, NULL, NULL, NULL FROM supplier""")
def decoded_files(spark, sf):
    """Files of every kind, some of them damaged, followed as a stream; all columns of what they hold, and what is wrong with the others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 3 == 0, "stack_strings").when(k % 3 == 1, "tight_strings").otherwise("decoded_strings")
    records = table(spark, sf, "orders").select(F.concat("o_orderpriority", F.lit(" "), k).alias("string"), kind.alias("kind"), F.when(k % 11 != 0, k * 16).alias("address"), F.when(k % 5 != 0, c).alias("function_ea"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("detail"))
    broken = table(spark, sf, "nation").select(F.concat(F.lit('{"stack_strings": ["'), "n_name").alias("value"), F.col("n_nationkey").alias("_part"))
    listless = table(spark, sf, "region").select(F.to_json(F.struct("r_name")).alias("value"), F.col("r_regionkey").alias("_part"))
    lines = table(spark, sf, "supplier").select(F.concat("s_suppkey", F.lit(": '"), "s_name", F.lit("'")).alias("value"))
    with graphs.shared_folder(spark) as root:
        decoded.store_cache(records, f"{root}/in/records")
        for name, texts in (("broken", broken), ("listless", listless)):
            texts.write.partitionBy("_part").text(f"{root}/in/{name}")
        lines.write.text(f"{root}/in/lines")
        decoded.follow_files(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", recursiveFileLookup=True, pathGlobFilter="*.txt").awaitTermination()
        return graphs.saved(spark.read.parquet(f"{root}/out").select("string", "kind", "address", "function_ea", "detail", "problem"))


# State


def _new_rows(queue):
    return queue.filter("ord % 3 = 0").withColumns({"status": F.lit("pending"), "suggested_name": F.concat("suggested_name", F.lit("_b")), "ord": F.col("ord") + 1_000_000})


_SLOT_SQL = "kind || '|' || ea || CASE WHEN kind = 'variable_rename' THEN '|' || old_var ELSE '' END"


@query(f"""WITH {QUEUE_SQL}, n AS (SELECT * FROM (SELECT *, {_SLOT_SQL} AS slot, row_number() OVER (PARTITION BY {_SLOT_SQL} ORDER BY ord DESC) AS k FROM q WHERE ord % 3 = 0) WHERE k = 1)
SELECT kind, ea, suggested_name, status, ord FROM q WHERE status <> 'pending' OR {_SLOT_SQL} NOT IN (SELECT slot FROM n) UNION ALL SELECT kind, ea, suggested_name || '_b', 'pending', ord + 1000000 FROM n""")
def queue_upsert(spark, sf):
    q = review_queue(spark, sf)
    return state.upsert_queue(q, _new_rows(q)).select("kind", "ea", "suggested_name", "status", "ord")


@query(f"""WITH {QUEUE_SQL}, e AS (SELECT kind, ord // 20 AS ea, old_var, 'name_' || (ord % 3) AS suggested_name, status, ts, ord FROM q),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SLOT_SQL} ORDER BY ts DESC, ord DESC) AS k FROM e WHERE status = 'pending') WHERE k = 1)
SELECT kind, ea, suggested_name, status, ord FROM e WHERE status <> 'pending' UNION ALL SELECT kind, ea, suggested_name, status, ord FROM p
WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.status <> 'pending' AND d.kind = p.kind AND d.ea = p.ea AND d.suggested_name = p.suggested_name AND (d.ts > p.ts OR (d.ts = p.ts AND d.ord >= p.ord)))""")
def queue_stream(spark, sf):
    """The queue's events as a stream through keyed state, kept as a table in the shared folder."""
    third = (F.col("ord") % 3).cast("string")
    events = review_queue(spark, sf, streamed=True).withColumns({"ea": F.floor(F.col("ord") / 20), "suggested_name": F.concat(F.lit("name_"), third), "new_var": F.concat(F.lit("var_"), third), "new_prototype": F.concat(F.lit("int f"), third, F.lit("(void);"))})
    with slots.state_store(spark), graphs.shared_folder(spark) as root:
        slots.follow_slots(events, root, f"{root}/checkpoint").awaitTermination()
        return graphs.saved(store.load(spark, root, "queue").select("kind", "ea", "suggested_name", "status", "ord"))


@query(f"WITH {QUEUE_SQL} SELECT ord, row_number() OVER (ORDER BY n_deps > 0, dependency_level, n_deps, ts, ord) AS place FROM q WHERE status = 'pending'")
def queue_sort(spark, sf):
    pending = review_queue(spark, sf).filter("status = 'pending'")
    return graphs.numbered(pending, state.queue_order()).select("ord", "place")


@query(f"WITH {QUEUE_SQL} SELECT ord, CASE WHEN status = 'pending' AND ord % 4 = 1 THEN 'rejected' ELSE status END AS status FROM q")
def queue_reject(spark, sf):
    q = review_queue(spark, sf)
    return state.set_status(q, q.filter("ord % 4 = 1"), "rejected").select("ord", "status")


_WANT_SQL = "w AS (SELECT c.ea AS parent_ea, (c.ord - d) // 2 AS dea, 'name_' || (c.ord - d) AS dname FROM q c, (VALUES (1), (2)) AS x(d) WHERE c.ord % 5 = 3 AND c.kind = 'function_rename' AND c.n_deps > 0 AND c.status = 'pending')"


@query(f"WITH {QUEUE_SQL}, {_WANT_SQL} SELECT parent_ea, q.ea, q.suggested_name FROM w JOIN q ON q.ea = dea AND q.suggested_name = dname AND q.status = 'pending' AND q.kind = 'function_rename' WHERE NOT (q.ord % 5 = 3 AND q.status = 'pending')")
def queue_missing_deps(spark, sf):
    q = review_queue(spark, sf)
    return state.missing_dependencies(q.filter("ord % 5 = 3 AND status = 'pending'"), q).select("parent_ea", "ea", "suggested_name")


@query(f"""WITH {QUEUE_SQL} SELECT count(*) AS requested, count(*) FILTER (WHERE status = 'pending' AND ord % 10 <> 3) AS applied, count(*) FILTER (WHERE status = 'pending' AND ord % 10 = 3) AS failed,
count(*) FILTER (WHERE status <> 'pending') AS skipped FROM q WHERE ord % 5 = 3""")
def queue_apply_counts(spark, sf):
    q = review_queue(spark, sf).filter("ord % 5 = 3")
    return state.apply_counts(q, q.filter("ord % 10 = 3"))


@query(f"""WITH {QUEUE_SQL} SELECT ord, kind, ea, CASE kind WHEN 'variable_rename' THEN old_var WHEN 'prototype_change' THEN 'prototype' ELSE 'name' END AS target,
CASE kind WHEN 'variable_rename' THEN new_var WHEN 'prototype_change' THEN 'int f' || ord || '(void);' ELSE suggested_name END AS value FROM q""")
def queue_changes(spark, sf):
    return state.change_of(review_queue(spark, sf))


@query(f"WITH {QUEUE_SQL}, {_WANT_SQL} SELECT ord FROM q WHERE ord % 5 = 3 AND status = 'pending' UNION SELECT q.ord FROM w JOIN q ON q.ea = dea AND q.suggested_name = dname AND q.status = 'pending' AND q.kind = 'function_rename'")
def queue_apply_plan(spark, sf):
    q = review_queue(spark, sf)
    return state.apply_plan(q.filter("ord % 5 = 3"), q, "include_dependencies").select("ord")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS batch_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 50")
def history_last_batch(spark, sf):
    b = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("batch_id")).agg(F.count("*").alias("n")).withColumn("ts", F.col("batch_id"))
    return state.keep_batches(b).select("batch_id", "n")


@query(f"""WITH {FUNCTIONS_SQL}, l AS (SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) SELECT o_custkey AS ea, 'sub_' || o_orderkey AS restore,
CASE WHEN o_orderkey % 2 = 0 AND name <> 'fun_' || (o_custkey % 700) AND NOT {_DEFAULT_SQL.format('name')} THEN 'manual_skipped' WHEN o_orderkey % 2 = 1 AND NOT {_DEFAULT_SQL.format('name')} THEN 'manual_skipped' ELSE 'restore' END AS outcome FROM l JOIN fn ON o_custkey = ea""")
def rollback_plan(spark, sf):
    k = F.col("o_orderkey")
    items = table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("batch_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("ea"), F.lit("function_rename").alias("kind"), F.concat(F.lit("sub_"), k).alias("old_name"), F.when(k % 2 == 0, F.concat(F.lit("fun_"), F.col("o_custkey") % 700)).otherwise("other").alias("new_name"))
    return state.rollback_plan(items, functions(spark, sf)).select("ea", "restore", "outcome")


@query("""WITH h AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS batch_id, o_orderkey AS ea, round(o_totalprice / 1000000, 3) AS confidence FROM orders)
SELECT batch_id, ea, confidence FROM h WHERE batch_id IN (SELECT DISTINCT batch_id FROM h ORDER BY 1 DESC LIMIT 50)""")
def history_append(spark, sf):
    """A batch for every day, put into an empty history; the newest 50 stay."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("batch_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("ea"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    return state.append_batch(o.filter("false"), o).select("batch_id", "ea", "confidence")


@query("""SELECT c_custkey AS k, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY AND o_orderkey % 10 > 0 GROUP BY c_custkey""")
def cache_ttl(spark, sf):
    cache = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice").cast("string")).alias("result"))
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("k"))
    return state.cache_hits(wanted, cache, F.lit("1998-06-01").cast("timestamp_ntz")).groupBy("k").agg(F.max(F.col("result").cast("double")).alias("best"))


@query("SELECT o_orderkey AS key FROM orders ORDER BY o_orderdate + INTERVAL (CASE WHEN o_orderkey % 50 = 0 THEN 3650 ELSE 0 END) DAY DESC, o_orderkey::VARCHAR LIMIT 5000")
def cache_prune(spark, sf):
    cache = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").alias("ts"))
    new = cache.filter("cast(key as long) % 50 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 3650 DAYS"))
    return state.cache_put(cache, new).select(F.col("key").cast("long").alias("key"))


@query(f"""WITH {QUEUE_SQL}, {FUNCTIONS_SQL}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ea ORDER BY ord DESC) AS k FROM q WHERE status = 'pending' AND kind = 'function_rename') WHERE k = 1)
SELECT fn.ea, coalesce(p.suggested_name, fn.name) AS suggested_name, CASE WHEN p.ea IS NULL THEN 'applied' ELSE 'pending_review' END AS status, coalesce(p.dependency_level, -1)::BIGINT AS level FROM fn LEFT JOIN p ON fn.ea = p.ea""")
def virtual_names(spark, sf):
    return state.virtual_names(functions(spark, sf), review_queue(spark, sf)).select("ea", "suggested_name", "status", F.col("level").cast("long").alias("level"))


@query("SELECT c_custkey AS func_ea, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS value FROM customer")
def blob_upsert(spark, sf):
    blobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("func_ea"), F.lit("summary").alias("kind"), F.col("c_name").alias("value"))
    return state.put_blobs(blobs, blobs.filter("func_ea % 4 = 0").withColumn("value", F.lit("new"))).select("func_ea", "value")


@query("SELECT c_custkey AS func_ea FROM customer WHERE c_custkey % 4 <> 0")
def blob_drop(spark, sf):
    """Functions that have anything saved, once the rows of every fourth are dropped."""
    blobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("func_ea"), F.explode(F.array(F.lit("summary"), F.lit("struct"))).alias("kind"), F.col("c_name").alias("value"))
    return state.saved_functions(state.drop_blobs(blobs, blobs.filter("func_ea % 4 = 0")))


@query("SELECT count(*) AS entries, round(coalesce(sum(strlen(text)), 0) / 1024.0, 1)::DOUBLE AS size_kb FROM documents")
def cache_stats(spark, sf):
    return state.cache_stats(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("result")))


@query("SELECT o_orderkey::VARCHAR AS batch_id, o_totalprice AS confidence FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, batch_id DESC LIMIT 10")
def function_history(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("batch_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("ea"), F.col("o_totalprice").alias("confidence"))
    return state.function_history(items, 7).select("batch_id", "confidence")


@query(f"WITH {QUEUE_SQL} SELECT ord FROM q WHERE status = 'pending' AND ((round(c_acctbal * 100))::BIGINT % 100000 + 100000) % 100000 >= 69500")
def queue_confident(spark, sf):
    """Pending rows whose confidence, in hundredths, is 0.7 or more."""
    return state.confident(review_queue(spark, sf), 0.7).select("ord")


@query(f"WITH {QUEUE_SQL} SELECT ord, CASE WHEN n_deps > 0 THEN printf('0x%X -> name_%d', (ord - 1) // 2, ord - 1) || chr(10) || printf('0x%X -> name_%d', (ord - 2) // 2, ord - 2) ELSE '' END AS text FROM q")
def dependency_texts(spark, sf):
    return review_queue(spark, sf).select("ord", state.dependency_text(F.col("deps")).alias("text"))


@query("SELECT s_suppkey AS ea, 'spa_' || sha256('{\"name\":\"' || s_name || '\",\"ea\":' || s_suppkey || '}') AS key FROM supplier")
def input_hash(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ea"), names.input_hash(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ea"))).alias("key"))


@query("SELECT event_id AS id, printf('0x%X', event_id) AS shown, event_id AS parsed FROM events")
def address_texts(spark, sf):
    """Addresses as shown, and read back from that text or from decimal digits."""
    shown = names.hex_address(F.col("event_id"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), shown.alias("shown"), names.parse_address(F.when(F.col("event_id") % 2 == 0, shown).otherwise(F.concat(F.lit(" "), "event_id"))).alias("parsed"))


@query(f"""WITH {INSTRUCTIONS_SQL}, l AS (SELECT func_ea, ea, pointer FROM (SELECT *, last_value(CASE WHEN mnem = 'mov' THEN addr END IGNORE NULLS) OVER (PARTITION BY func_ea, reg ORDER BY ea ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pointer FROM insn) WHERE mnem = 'call' AND pointer IS NOT NULL)
SELECT func_ea, ea, p_partkey * 16 AS target FROM l JOIN part ON pointer = p_partkey""")
def pass2_targets(spark, sf):
    """Where calls through loaded pointers go, parts being the cells of memory."""
    memory = table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_partkey") * 16).alias("target"))
    return code.dereference(code.last_loads(instructions(spark, sf)), memory)


# Contexts and whole runs


@query(f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, s AS (SELECT caller AS src, 'name_' || callee AS name, min(ea) AS pos FROM raw WHERE callee NOT IN (SELECT ea FROM fn WHERE ea % 2 = 0) AND caller <> callee GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pos, name) AS n FROM s) SELECT src AS ea, string_agg(name, ',' ORDER BY n) AS names FROM k WHERE n <= 30 GROUP BY src""")
def imported_names(spark, sf):
    edges = call_edges(spark, sf, False).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "ea")
    every = functions(spark, sf).select("ea", F.concat(F.lit("name_"), "ea").alias("name"))
    return code.imported_names(edges, every.filter("ea % 2 = 0"), every).select("ea", F.array_join("names", ",").alias("names"))


@query("""WITH s AS (SELECT l_suppkey AS f, l_partkey AS a, min(l_orderkey * 8 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), j AS (SELECT f, pos, substr(p_name, 1, 10) AS t FROM s JOIN part ON a = p_partkey WHERE length(p_name) >= 9),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY pos, t) AS n FROM j) SELECT f AS ea, string_agg(t, ',' ORDER BY n) AS names FROM k WHERE n <= 20 GROUP BY f""")
def referenced_strings(spark, sf):
    refs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("func_ea"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ea"), F.col("l_partkey").alias("addr"))
    strings = table(spark, sf, "part").select(F.col("p_partkey").alias("addr"), F.col("p_name").alias("text"))
    return code.referenced_strings(refs, strings, 20, 9, 10).select("ea", F.array_join("names", ",").alias("names"))


@query(f"""WITH {INSTRUCTIONS_SQL}, s AS (SELECT func_ea, reg, value // 50 AS o, min(ea) AS access_ea FROM insn WHERE op_type = 'displ' AND value // 50 BETWEEN 1 AND 4095 GROUP BY 1, 2, 3)
SELECT func_ea, reg, o AS "offset", access_ea FROM (SELECT *, row_number() OVER (PARTITION BY func_ea ORDER BY access_ea, reg, o) AS n FROM s) WHERE n <= 48""")
def struct_accesses(spark, sf):
    found = code.struct_accesses(instructions(spark, sf).withColumn("value", F.expr("value div 50")))
    return found.select("func_ea", F.col("reg").cast("long").alias("reg"), "offset", "access_ea")


@query(f"""WITH {INSTRUCTIONS_SQL}, l AS (SELECT func_ea, mnem || ' ' || value AS line, row_number() OVER (PARTITION BY func_ea ORDER BY ea) AS n, count(*) OVER (PARTITION BY func_ea) AS c FROM insn),
a AS (SELECT func_ea, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n <= 20) || CASE WHEN max(c) > 20 THEN chr(10) || '...' ELSE '' END AS t FROM l GROUP BY func_ea)
SELECT c_custkey AS ea, md5(CASE WHEN c_custkey % 4 = 0 AND c_custkey * 100 <= 32768 THEN c_name ELSE coalesce(t, '') END) AS code, CASE WHEN c_custkey % 4 = 0 AND c_custkey * 100 <= 32768 THEN 'pseudocode' ELSE 'assembly' END AS code_type FROM customer LEFT JOIN a ON func_ea = c_custkey""")
def code_texts(spark, sf):
    f = table(spark, sf, "customer").select(F.col("c_custkey").alias("ea"), (F.col("c_custkey") * 100).alias("size_bytes"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("pseudo"))
    lines = instructions(spark, sf).select("func_ea", "ea", F.concat("mnem", F.lit(" "), "value").alias("line"))
    return code.code_text(f, lines, most=20).withColumn("code", F.md5(F.col("code").cast("binary")))


@query(f"""SELECT (SELECT count(*) FROM ({ORACLES["hash_lookup"]})) AS hash_loads, (SELECT count(*) FROM ({ORACLES["pass2_lastload"]})) AS indirect_calls,
(SELECT count(DISTINCT func_ea) FROM ({ORACLES["pass3_cmp_jcc"]})) AS dispatchers, (SELECT count(*) FROM ({_WRAPPERS_SQL})) AS wrappers""")
def four_passes(spark, sf):
    insn, fn = instructions(spark, sf), functions(spark, sf)
    single = code.single_targets(call_edges(spark, sf, False).select("caller", F.col("callee").alias("target")))
    return code.pass_summary(hash_lookup(spark, sf), code.last_loads(insn), code.compare_jumps(insn, fn), code.wrapper_names(single, fn, code.push_counts(insn)))


@query("SELECT c_custkey AS ea FROM customer ORDER BY 1 LIMIT 300")
def scope_limited(spark, sf):
    return contexts.scope(functions(spark, sf), "limited_program")


@query("SELECT c_custkey AS ea FROM customer WHERE c_custkey % 37 = 1")
def scope_entry_points(spark, sf):
    return contexts.scope(functions(spark, sf).withColumn("is_entry", F.col("ea") % 37 == 1), "entry_points")


@query("SELECT c_custkey AS ea FROM customer WHERE c_custkey = 42")
def scope_current(spark, sf):
    return contexts.scope(functions(spark, sf).withColumn("is_current", F.col("ea") == 42), "current_function")


@query("SELECT c_custkey AS ea FROM customer ORDER BY 1 LIMIT 300")
def scope_priority(spark, sf):
    return contexts.scope(functions(spark, sf), "review_priority_only")


@query(f"WITH {FUNCTIONS_SQL} SELECT ea FROM fn WHERE NOT (ea % 8 & 4 <> 0)")
def library_filter(spark, sf):
    return functions(spark, sf).filter(~contexts.is_library_or_thunk(F.col("ea") % 8)).select("ea")


def function_context_frame(spark, sf):
    """One wide row per customer-function from all the relations above."""
    f = functions(spark, sf).select("ea", "name", (F.col("ea") * 7).alias("size_bytes"), (F.col("ea") * 1000).alias("start"), (F.col("ea") * 1000 + 700).alias("end"))
    edges = call_edges(spark, sf, False).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "ea")
    refs = table(spark, sf, "orders").select(F.col("o_custkey").alias("func_ea"), F.col("o_orderkey").alias("ea"), (F.col("o_orderkey") % 200).alias("addr"))
    strings = table(spark, sf, "part").select(F.col("p_partkey").alias("addr"), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 9 == 0, F.lit(" http://x.org")).otherwise("")).alias("text"))
    found = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("decoded "), "o_orderkey").alias("string"), (F.col("o_custkey") * 1000 + F.col("o_orderkey") % 900).alias("address"), F.lit(None).cast("long").alias("function_ea"), F.lit("decoded_strings").alias("kind"))
    names_ = f.select("ea", "name")
    full = contexts.function_contexts(f, instructions(spark, sf), edges, names_, refs, strings, found, triage.api_dimension(spark))
    return full.withColumn("code", F.concat(F.lit("int "), "name", F.lit("()")))


_TEXT_TAGS_SQL = " + ".join(f"(text IS NOT NULL AND {_any_sql('text', words)})::INT" for words in triage.STRING_WORDS.values())
_DISPATCH_WORD = "(text IS NOT NULL AND " + (_any_sql("text", triage.STRING_WORDS["DISPATCH"]) if "DISPATCH" in triage.STRING_WORDS else "false") + ")"


@query(f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, {INSTRUCTIONS_SQL},
ins AS (SELECT func_ea AS ea, count(*) AS n, least(30, count(DISTINCT value) FILTER (WHERE op_type = 'imm' AND value > 65535)) AS constants, count(*) > 80 AND count(*) FILTER (WHERE mnem = 'call' AND op_type = 'reg') >= 3 AS dispatch FROM insn GROUP BY 1),
cin AS (SELECT callee AS ea, count(*) AS n FROM raw GROUP BY 1), cout AS (SELECT caller AS ea, count(DISTINCT callee) AS n FROM raw GROUP BY 1),
cn AS (SELECT caller AS ea, least(20, count(DISTINCT name)) AS n FROM raw JOIN fn ON fn.ea = callee WHERE caller <> callee GROUP BY 1),
rn AS (SELECT callee AS ea, least(10, count(DISTINCT name)) AS n FROM raw JOIN fn ON fn.ea = caller WHERE caller <> callee GROUP BY 1),
st AS (SELECT o_custkey AS ea, o_orderkey % 200 AS addr, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2),
sx AS (SELECT st.ea, p_name || CASE WHEN p_partkey % 9 = 0 THEN ' http://x.org' ELSE '' END AS t, row_number() OVER (PARTITION BY st.ea ORDER BY pos, p_name || CASE WHEN p_partkey % 9 = 0 THEN ' http://x.org' ELSE '' END) AS k FROM st JOIN part ON p_partkey = addr),
sl AS (SELECT ea, least(20, count(*)) AS n, lower(string_agg(t, ' ' ORDER BY k) FILTER (WHERE k <= 15)) AS text FROM sx GROUP BY 1),
dc AS (SELECT o_custkey AS ea, least(30, count(*)) AS n FROM orders WHERE o_orderkey % 900 < 700 GROUP BY 1)
SELECT fn.ea, fn.name, coalesce(ins.n, 0) AS n_insn, coalesce(cin.n, 0) AS n_callers, coalesce(cout.n, 0) AS n_callees, coalesce(cn.n, 0)::INT AS callees, coalesce(rn.n, 0)::INT AS callers, 0 AS apis,
  coalesce(sl.n, 0)::INT AS strings, coalesce(dc.n, 0)::INT AS decoded, coalesce(constants, 0)::INT AS constants, ({_TEXT_TAGS_SQL} + (coalesce(dispatch, false) AND NOT {_DISPATCH_WORD})::INT)::INT AS pre_tags
FROM fn LEFT JOIN ins ON ins.ea = fn.ea LEFT JOIN cin ON cin.ea = fn.ea LEFT JOIN cout ON cout.ea = fn.ea LEFT JOIN cn ON cn.ea = fn.ea LEFT JOIN rn ON rn.ea = fn.ea LEFT JOIN sl ON sl.ea = fn.ea LEFT JOIN dc ON dc.ea = fn.ea""")
def function_contexts(spark, sf):
    return function_context_frame(spark, sf).select("ea", "name", "n_insn", "n_callers", "n_callees", *[F.size(c).alias(c) for c in ("callees", "callers", "apis", "strings", "decoded", "constants", "pre_tags")])


@query()
def analyzer_run(spark, sf):
    """The program analyzer over the call graph, with the offline provider."""
    edges = call_edges(spark, sf, False).select("caller", "callee")
    parts = runs.analyze_program(function_context_frame(spark, sf), edges, _nodes(spark, sf).filter("ea % 400 = 5"), functions(spark, sf), Settings(spa_min_priority_score=1))
    return parts["results"].select("ea", "old_name", "mode", "r.function_name", "r.confidence", "r.priority")


def _rename(spark, sf, order):
    return runs.rename_program(function_context_frame(spark, sf), call_edges(spark, sf).select("caller", "callee"), Settings(rename_order=order, review_mode=False))["outcomes"]


@query()
def rename_best_effort(spark, sf):
    return _rename(spark, sf, "best_effort_bottom_up")


@query()
def rename_strict(spark, sf):
    return _rename(spark, sf, "strict_bottom_up")


@query()
def rename_proposal(spark, sf):
    return _rename(spark, sf, "proposal_aware_bottom_up")


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 900 < 700 AS placed, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 900 < 700 ORDER BY o_orderkey) AS k FROM orders)
SELECT 'decoded ' || o_orderkey AS value, 1 + (placed AND k <= 30 AND o_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey))::INT AS n FROM d ORDER BY n DESC, value LIMIT 40""")
def forensic_top_decoded(spark, sf):
    empty = lambda schema: spark.createDataFrame([], schema)
    found = table(spark, sf, "orders").select(F.concat(F.lit("decoded "), "o_orderkey").alias("string"))
    return runs.forensic_report(function_context_frame(spark, sf), _merged(spark, sf), found, empty(store.SCHEMAS["history"]), empty(store.SCHEMAS["queue"]))["top_decoded"]


@query(f"""{_MERGED_SQL}, {FUNCTIONS_SQL}, nm AS (SELECT ea, name FROM fn WHERE NOT {_DEFAULT_SQL.format('name')}),
ln AS (SELECT upper(type) || ': ' || string_agg(value, ', ' ORDER BY value) AS line FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY value) AS n FROM m) WHERE n <= 8 GROUP BY type)
SELECT 'Binary: sample' || chr(10) || 'Total functions: ' || (SELECT count(*) FROM fn) || '  Renamed: ' || (SELECT count(*) FROM nm) || chr(10) || 'Top renamed: ' || (SELECT string_agg(name, ', ' ORDER BY ea) FROM (SELECT * FROM nm ORDER BY ea LIMIT 20))
  || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY line) FROM ln) AS text""")
def program_summary(spark, sf):
    return runs.program_summary(functions(spark, sf), _merged(spark, sf), "sample")


# Reports, candidates' own graphs and names that change between levels


@query("""SELECT doc_id, sha256('0x' || lower(to_hex(doc_id)) || 'sub_' || doc_id || coalesce(text, '') || 'a,b' || coalesce(lang, '') || 'v5.2' || 'm' || coalesce(source, '')) AS key FROM documents""")
def cache_key_joined(spark, sf):
    """Keys of a cache that is filled without a separator."""
    none, lang = F.array().cast("array<string>"), F.filter(F.array("lang"), lambda x: x.isNotNull())
    key = names.cache_key(F.col("doc_id"), F.concat(F.lit("sub_"), "doc_id"), F.col("text"), none, F.array(F.lit("b"), F.lit("a")), none, none, lang, F.lit("m"), F.col("source"), names.JOINED_VERSION, "")
    return table(spark, sf, "documents").select("doc_id", key.alias("key"))


@query("""WITH own AS (SELECT DISTINCT o_custkey AS caller, o_orderkey % (SELECT count(*) FROM customer) AS callee FROM orders WHERE o_custkey % 3 = 0)
SELECT caller, callee FROM own WHERE caller <> callee AND callee % 2 = 0 AND caller % 2 = 0""")
def candidate_calls(spark, sf):
    """Even functions as candidates; every third brings its own list of callees, so the program's call edges do not count."""
    n = table(spark, sf, "customer").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").crossJoin(F.broadcast(n)).select("o_custkey", (F.col("o_orderkey") % F.col("n")).alias("callee"))  # one row
    lists = o.filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("_f")).agg(F.collect_set("callee").alias("callee_eas"))
    f = functions(spark, sf).filter("ea % 2 = 0")
    return graphs.candidate_edges(f.join(lists, F.col("ea") == F.col("_f"), "left"), call_edges(spark, sf, False))


def _calling(spark, sf):
    """(ea, name, callees, code) of functions that call, and their edges: a line of code for each callee."""
    f, e = functions(spark, sf), graphs.edges_within(call_edges(spark, sf, False), functions(spark, sf))
    called = e.join(f.select("ea", "name"), F.col("callee") == F.col("ea")).groupBy(F.col("caller").alias("_c")).agg(F.sort_array(F.collect_list("name")).alias("callees"))
    return f.select("ea", "name").join(called, F.col("ea") == F.col("_c")).withColumn("code", F.concat("name", F.lit(" { "), F.array_join("callees", "(); "), F.lit("(); }"))).drop("_c"), e


@query(f"""WITH {EDGES_SQL}, {FUNCTIONS_SQL}, e AS (SELECT DISTINCT caller, callee FROM raw WHERE caller <> callee AND caller IN (SELECT ea FROM fn) AND callee IN (SELECT ea FROM fn)),
has AS (SELECT DISTINCT caller AS ea FROM e), inn AS (SELECT * FROM e WHERE callee IN (SELECT ea FROM has)),
near AS (SELECT caller AS c, callee AS t FROM inn UNION SELECT callee, caller FROM inn UNION SELECT ea, ea FROM has),
names AS (SELECT c, name AS was, min('new_' || t) AS now FROM near JOIN fn ON t = ea WHERE t % 4 = 0 GROUP BY c, name),
called AS (SELECT caller, fn.name AS was, coalesce(names.now, fn.name) AS now FROM e JOIN fn ON callee = fn.ea LEFT JOIN names ON names.c = caller AND names.was = fn.name)
SELECT caller AS ea, array_to_string(list(now ORDER BY was, now), ',') AS callees, coalesce(any_value(n.now), any_value(fn.name)) || ' {{ ' || array_to_string(list(called.now ORDER BY called.was, called.now), '(); ') || '(); }}' AS code
FROM called JOIN fn ON fn.ea = caller LEFT JOIN names n ON n.c = caller AND n.was = fn.name GROUP BY caller""".replace("list(now ORDER BY was, now)", "list(called.now ORDER BY called.was, called.now)"))
def refreshed_contexts(spark, sf):
    """Functions that call, after every fourth of them got a new name."""
    f, e = _calling(spark, sf)
    now = f.filter("ea % 4 = 0").select("ea", F.concat(F.lit("new_"), "ea").alias("idb_name"))
    return contexts.refreshed(f, graphs.edges_within(e, f), now).select("ea", F.array_join("callees", ",").alias("callees"), "code")


@query(f"""WITH {FUNCTIONS_SQL}, f AS (SELECT fn.*, c_mktsegment AS seg FROM fn JOIN customer ON ea = c_custkey)
SELECT 2 AS section, ea + 2 AS ord, '<tr><td>0x' || to_hex(ea) || '</td><td>' || name || '</td><td>' || CASE WHEN starts_with(name, 'sub_') THEN 'unnamed' ELSE 'renamed' END || '</td><td>' || n_insn || '</td><td>' || n_insn * 4 || '</td><td>' || ea % 5 || '</td><td>' ||
CASE WHEN ea % 11 = 0 THEN 'CRYPTO FILE' ELSE '' END || '</td><td>&lt;' || seg || '&amp;&quot;</td></tr>' AS html FROM f
UNION ALL SELECT 3, ea + 2, '<tr><td>0x' || to_hex(ea) || '</td><td>' || name || '</td><td>CRYPTO FILE</td><td>T1486</td></tr>' FROM f WHERE ea % 11 = 0
UNION ALL SELECT 1, 3, '<tr><td>' || count(*) || '</td><td>' || count(*) FILTER (name NOT LIKE 'sub%') || '</td><td>' || count(*) FILTER (name LIKE 'sub%') || '</td><td>' || (count(*) FILTER (name NOT LIKE 'sub%')) * 100 // count(*) || '%</td></tr>' FROM f""")
def forensic_page(spark, sf):
    """The page's lines on coverage, on every function and on those at risk."""
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("_c"), F.concat(F.lit("<"), "c_mktsegment", F.lit('&"')).alias("comment"))
    risky, none = F.col("ea") % 11 == 0, F.array().cast("array<string>")
    f = functions(spark, sf).join(seg, F.col("ea") == F.col("_c")).withColumns({"size": F.col("n_insn") * 4, "n_callers": F.col("ea") % 5, "pre_tags": F.when(risky, F.array(F.lit("CRYPTO"), F.lit("FILE"))).otherwise(none), "hints": F.when(risky, F.array(F.lit("T1486"))).otherwise(none), **{c: none for c in ("apis", "strings", "decoded")}})
    empty = lambda schema: spark.createDataFrame([], schema)
    iocs = empty("type string, value string, source string, sources array<string>")
    parts = runs.forensic_report(f, iocs, empty("string string"), empty(store.SCHEMAS["history"]), empty(store.SCHEMAS["queue"]))
    page = reports.forensic_page(parts, f, empty(store.SCHEMAS["blobs"]), iocs)
    return page.filter(F.col("section").between(1, 3) & F.col("ord").between(2, 2**61))


@query("""WITH s AS (SELECT doc_id, text FROM documents WHERE trim(coalesce(text, ''), ' ') <> '') SELECT doc_id AS ea, (len(text) - len(replace(text, chr(10), ''))) + 1 AS n_lines FROM s""")
def range_answers(spark, sf):
    """Each document, its whole text, as a piece of code that the offline model counts the lines of."""
    told = drivers.ranges(table(spark, sf, "documents").select(F.col("doc_id").alias("ea"), F.col("text").alias("code")), Settings())
    return told.select("ea", F.regexp_extract("summary", r"^(\d+)", 1).cast("long").alias("n_lines"))

"""Static tags, review scores, priorities, top candidates, report aggregates and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import holds_any, is_default_name
from .graphs import saved

# Library functions by what they are used for; a later line wins for a name listed twice.
API_CATEGORIES = {
    "MEMORY": ("VirtualAlloc", "VirtualAllocEx", "VirtualProtect", "VirtualProtectEx", "HeapAlloc", "LocalAlloc", "GlobalAlloc", "memcpy", "memmove", "RtlDecompressBuffer", "RtlAllocateHeap", "NtAllocateVirtualMemory"),
    "PERSIST": ("RegSetValueEx", "RegCreateKey", "RegCreateKeyEx", "CreateService", "OpenSCManager", "StartService", "sc_create", "NtSetValueKey", "WritePrivateProfileString", "SetFileAttributes"),
    "NETWORK": ("socket", "connect", "send", "recv", "WSAStartup", "closesocket", "InternetOpen", "InternetConnect", "InternetReadFile", "InternetWriteFile", "HttpSendRequest", "HttpOpenRequest", "WinHttpOpen", "WinHttpConnect", "WinHttpSendRequest", "WinHttpReadData", "URLDownloadToFile", "URLDownloadToCacheFile", "FtpPutFile", "FtpGetFile"),
    "CRYPTO": ("CryptEncrypt", "CryptDecrypt", "CryptGenKey", "CryptDeriveKey", "CryptAcquireContext", "CryptCreateHash", "CryptHashData", "BCryptEncrypt", "BCryptDecrypt", "BCryptGenerateSymmetricKey", "BCryptOpenAlgorithmProvider", "BCryptImportKey", "RC4Init", "RC4", "AESInit"),
    "EVASION": ("IsDebuggerPresent", "NtQueryInformationProcess", "CheckRemoteDebuggerPresent", "GetTickCount", "GetTickCount64", "NtSetInformationThread", "DbgBreakPoint", "OutputDebugString", "FindWindow", "NtQuerySystemInformation", "SetThreadContext"),
    "INJECT": ("WriteProcessMemory", "CreateRemoteThread", "NtCreateThreadEx", "VirtualAllocEx", "NtMapViewOfSection", "QueueUserAPC", "SetWindowsHookEx", "NtWriteVirtualMemory", "ZwCreateSection", "RtlCreateUserThread", "NtResumeThread"),
    "RECON": ("GetComputerName", "GetUserName", "GetSystemInfo", "EnumProcesses", "CreateToolhelp32Snapshot", "Process32First", "Process32Next", "GetAdaptersInfo", "GetAdaptersAddresses", "GetVolumeInformation", "RegOpenKeyEx", "RegQueryValueEx", "WNetGetConnection"),
    "FILE": ("CreateFile", "ReadFile", "WriteFile", "DeleteFile", "MoveFile", "CopyFile", "FindFirstFile", "FindNextFile", "GetTempPath", "GetTempFileName", "SetFilePointer", "FlushFileBuffers"),
    "EXEC": ("CreateProcess", "ShellExecute", "ShellExecuteEx", "WinExec", "CreateProcessWithToken", "CreateProcessAsUser", "system", "_popen", "execv"),
    "LOADER": ("LoadLibrary", "LoadLibraryEx", "GetProcAddress", "GetModuleHandle", "LdrLoadDll", "NtMapViewOfSection"),
}
API_SUFFIXES = ("", "A", "W", "Ex", "ExA", "ExW")
# Technique hints by tag.
TECHNIQUES = {
    "INJECT": "T1055 Process Injection", "PERSIST": "T1547 Boot/Logon Autostart | T1543 Create/Modify System Process", "EVASION": "T1497 Virtualization/Sandbox Evasion | T1562 Impair Defenses", "RECON": "T1082 System Information Discovery",
    "CRYPTO": "T1027 Obfuscated Files or Information", "NETWORK": "T1071 Application Layer Protocol", "EXEC": "T1059 Command and Scripting Interpreter", "LOADER": "T1574 Hijack Execution Flow | T1055 Process Injection",
}
# Words in a function's strings that stand for a tag.
STRING_WORDS = {
    "NETWORK": ("http://", "https://", ".onion", "ftp://"),
    "PERSIST": ("software\\", "hklm", "hkcu", "registry"),
    "FILE": (".exe", ".dll", ".bat", ".ps1", ".vbs"),
    "CRYPTO": ("aes", "rc4", "chacha", "salsa", "xor"),
}
HIGH_RISK = ("INJECT", "PERSIST", "EVASION", "CRYPTO", "LOADER", "MEMORY")
RANKS = {"critical": 3, "high": 2, "medium": 1, "low": 0}


def api_dimension(spark: SparkSession) -> DataFrame:
    """(api, category): lower-case names with their A, W and Ex forms; about 700 rows, so fit to be broadcast."""
    flat = {(name + suffix).lower(): category for category, names in API_CATEGORIES.items() for name in names for suffix in API_SUFFIXES}
    return spark.createDataFrame(sorted(flat.items()), "api string, category string")


def api_tags(refs: DataFrame, dimension: DataFrame) -> DataFrame:
    """(ea, tag, reason) for references (ea, api): the name's category, any case, leading underscores aside."""
    dim = F.broadcast(dimension.select(F.col("api").alias("_api"), "category"))
    return refs.join(dim, F.ltrim(F.lower("api"), F.lit("_")) == F.col("_api")).select("ea", F.col("category").alias("tag"), F.concat(F.lit("api:"), F.col("api"), F.lit(">"), F.col("category")).alias("reason"))


def string_tags(texts: DataFrame) -> DataFrame:
    """(ea, tag, reason) for (ea, text), the function's first strings joined."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(holds_any(low, words), tag) for tag, words in STRING_WORDS.items()]))
    return texts.select("ea", F.explode(hits).alias("tag")).withColumn("reason", F.concat(F.lit("string:"), F.lower("tag")))


def dispatch_tags(insns: DataFrame, least_insns: int = 80, least_calls: int = 3) -> DataFrame:
    """(ea, tag, reason) for functions of more than least_insns instructions with least_calls indirect calls or more."""
    indirect = (F.col("mnem") == "call") & F.col("op_type").isin("reg", "phrase", "displ")
    counted = insns.groupBy(F.col("func_ea").alias("ea")).agg(F.count("*").alias("n"), F.count_if(indirect).alias("calls"))
    return counted.filter((F.col("n") > least_insns) & (F.col("calls") >= least_calls)).select("ea", F.lit("DISPATCH").alias("tag"), F.concat(F.lit("indirect_calls="), F.col("calls")).alias("reason"))


def classify(tagged: DataFrame) -> DataFrame:
    """(ea, tags, reasons, hints), sorted, from (ea, tag, reason) rows."""
    hints = F.create_map(*[x for k, v in TECHNIQUES.items() for x in (F.lit(k), F.lit(v))])
    by = tagged.groupBy("ea").agg(F.sort_array(F.collect_set("tag")).alias("tags"), F.sort_array(F.collect_set("reason")).alias("reasons"))
    return by.withColumn("hints", F.array_compact(F.transform("tags", lambda t: F.try_element_at(hints, t))))


# Points, reason and tag of each scoring rule, with the words that a function's calls must hold.
NETWORK_CALLS = ("internet", "winhttp", "socket", "connect", "recv", "send")
CRYPTO_CALLS = ("crypt", "bcrypt", "decompress", "rtlcompress")
MEMORY_CALLS = ("virtualalloc", "virtualprotect", "heapalloc", "memcpy", "memmove", "rtldecompressbuffer")
PROCESS_CALLS = ("openprocess", "writeprocessmemory", "createremotethread", "ntcreatethreadex", "createthread")
PERSIST_CALLS = ("regsetvalue", "regcreatekey", "createservice", "schtasks", "taskschd")
EVASION_CALLS = ("isdebuggerpresent", "checkremotedebuggerpresent", "ntqueryinformationprocess", "gettickcount")
FILE_CALLS = ("createfile", "writefile", "deletefile", "movefile")
LIBRARY_NAMES = ("memcpy", "strlen", "strcmp", "free", "malloc")


# Points, reason and tag of each scoring rule, in the order that reasons come in.
SCORE_RULES = {
    "network": (3, "network-related API or URL-like string", "NETWORK"),
    "crypto": (2, "encryption/compression/static transform hint", "CRYPTO"),
    "memory": (3, "memory allocation/protection/copy API", "MEMORY"),
    "process": (3, "process/thread interaction API", "PROCESS"),
    "persistence": (3, "registry/service/task related API", "PERSISTENCE"),
    "evasion": (2, "anti-debug or environment-check API", "EVASION"),
    "file": (2, "file API with notable path or extension", "FILE"),
    "decoded": (2, "decoded strings available from optional string discovery", "DECODED_STRINGS"),
    "dispatch": (2, "dispatcher-like or high fan-out structure", "DISPATCH"),
    "wrapper": (1, "wrapper/resolver naming hint", "WRAPPER"),
    "tiny": (-2, "tiny function with no useful references", None),
    "library": (-1, "known utility/library-like wrapper", "UTIL"),
}


def review_score(df: DataFrame) -> DataFrame:
    """df (name, apis, callees, strings, decoded, pre_tags, n_insn) plus score, priority, reasons, tags, interesting.

    The rules add up; the last one looks at the sum of the others. Missing lists count as empty.
    """
    none = F.array().cast("array<string>")
    listed = {c: F.coalesce(F.col(c), none) for c in ("apis", "callees", "strings", "decoded", "pre_tags")}
    calls = F.lower(F.array_join(F.concat(listed["apis"], listed["callees"]), " "))
    texts = F.lower(F.array_join(F.concat(listed["strings"], listed["decoded"]), " "))
    name, n = F.lower(F.coalesce("name", F.lit(""))), F.coalesce("n_insn", F.lit(0))
    quiet = (F.size(listed["apis"]) + F.size(listed["callees"]) == 0) & (F.size(listed["strings"]) + F.size(listed["decoded"]) == 0)
    tests = {
        "network": holds_any(calls, NETWORK_CALLS) | texts.rlike(r"https?://|ftp://|\b[a-z0-9.-]+\.(com|net|org|ru|cn|io)\b"),
        "crypto": holds_any(calls, CRYPTO_CALLS) | F.contains(texts, F.lit("xor")),
        "memory": holds_any(calls, MEMORY_CALLS),
        "process": holds_any(calls, PROCESS_CALLS),
        "persistence": holds_any(calls, PERSIST_CALLS),
        "evasion": holds_any(calls, EVASION_CALLS),
        "file": holds_any(calls, FILE_CALLS) & texts.rlike(r"\.(exe|dll|sys|ps1|bat|vbs|tmp)|appdata|temp|system32"),
        "decoded": F.size(listed["decoded"]) > 0,
        "dispatch": F.array_contains(listed["pre_tags"], "DISPATCH") | (F.size(listed["callees"]) >= 15),
        "wrapper": holds_any(name, ("wrapper", "resolve")) | F.startswith(name, F.lit("j_")),
        "tiny": (n > 0) & (n <= 4) & quiet,
    }
    # each test is evaluated once, into a column that no filter or sort key can be traced through
    flagged = df.select("*", F.inline(F.array(F.struct(*[F.coalesce(test, F.lit(False)).alias(f"_is_{rule}") for rule, test in tests.items()]))))
    tests = {rule: F.col(f"_is_{rule}") for rule in tests}
    points = reduce(lambda a, b: a + b, [F.when(test, SCORE_RULES[rule][0]).otherwise(0) for rule, test in tests.items()])
    tests["library"] = holds_any(name, LIBRARY_NAMES) & (points <= 2)
    score = points + F.when(tests["library"], SCORE_RULES["library"][0]).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(test, SCORE_RULES[rule][1]) for rule, test in tests.items()]))
    tags = F.array_compact(F.array(*[F.when(test, SCORE_RULES[rule][2]) for rule, test in tests.items() if SCORE_RULES[rule][2]]))
    out = flagged.withColumns({"score": score.cast("int"), "reasons": reasons, "tags": F.sort_array(F.array_union(listed["pre_tags"], tags))})
    priority = F.when(F.col("score") >= 9, "critical").when(F.col("score") >= 6, "high").when(F.col("score") >= 3, "medium").otherwise("low")
    return out.withColumns({"priority": priority, "interesting": F.col("score") >= 3}).drop(*[f"_is_{rule}" for rule in SCORE_RULES])


def rank_of(priority: Column) -> Column:
    return reduce(lambda w, k: w.when(priority == k, RANKS[k]), ("high", "medium"), F.when(priority == "critical", 3)).otherwise(0)


def by_priority(df: DataFrame, order: str = "ord") -> DataFrame:
    return df.sort(rank_of(F.col("priority")).desc(), F.col("score").desc(), F.col(order))


def top_candidates(df: DataFrame, limit: int = 80, min_score: int = 3, include_named: bool = True, order: str = "ord") -> DataFrame:
    """The functions (ea, name, score, priority, is_root, ord) a model should look at first; roots need no score.

    One row per ea. Top-k without a global sort: each partition keeps its own best.
    """
    wanted = df.filter(F.col("is_root") | (F.col("score") >= min_score))
    if not include_named:
        wanted = wanted.filter(F.col("name").rlike("^(sub_|loc_|fn_|func_)"))
    keys = [rank_of(F.col("priority")).desc(), F.col("score").desc(), F.col(order)]
    once = wanted.withColumn("_n", F.row_number().over(Window.partitionBy("ea").orderBy(*keys))).filter("_n = 1").drop("_n")
    return once.sort(*keys).limit(limit)


def tagged_count(df: DataFrame) -> DataFrame:
    """One row, n: functions with any tag (tags)."""
    return df.agg(F.count_if(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0).alias("n"))


def high_risk(df: DataFrame) -> DataFrame:
    return df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in HIGH_RISK])))


def coverage(names: DataFrame) -> DataFrame:
    """n_funcs, n_renamed, n_unnamed and the whole percent renamed."""
    named = ~is_default_name(F.col("name"))
    out = names.agg(F.count("*").alias("n_funcs"), F.count_if(named).alias("n_renamed"))
    return out.select("n_funcs", "n_renamed", (F.col("n_funcs") - F.col("n_renamed")).alias("n_unnamed"), F.when(F.col("n_funcs") > 0, F.expr("n_renamed * 100 div n_funcs")).otherwise(0).alias("percent"))


def top_values(values: DataFrame, limit: int, least_length: int = 0) -> DataFrame:
    """(value, n): the most frequent values, ties by value."""
    counted = values.filter(F.length("value") >= least_length).groupBy("value").agg(F.count("*").alias("n"))
    return counted.sort(F.col("n").desc(), "value").limit(limit)


def heavy_values(values: DataFrame, limit: int, least_length: int = 0, rows: int = 3, width: int = 1 << 16) -> DataFrame:
    """(value, n): as top_values, where most of very many distinct values are rare: only values that can be among the first are counted one by one.

    Every value falls into one cell of each of `rows` hash tables of `width` cells, and a cell's sum is at least the count of each value
    in it. Values whose cells are all among the largest are counted first; the count of the last of them that would be kept is a floor below
    which no value is kept. Then the values all of whose cells reach the floor are counted, and no others can be in the result, ties
    included. What is shuffled are the cells (at most rows * width a task) and the candidates; the input is read three times, the cells'
    numbers are broadcast (at most rows * width of them). On flat counts everything is a candidate and top_values is cheaper.
    """
    kept = values.filter(F.length("value") >= least_length).select("value", *[F.pmod(F.xxhash64("value", F.lit(i)), F.lit(width)).cast("int").alias(f"_c{i}") for i in range(rows)])
    each = kept.select(F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col(f"_c{i}").alias("cell")) for i in range(rows)])).alias("c"))
    sums = saved(each.groupBy("c.table", "c.cell").agg(F.count("*").alias("sum")))

    def counted(cells: DataFrame) -> DataFrame:
        within = kept
        for i in range(rows):
            within = within.join(F.broadcast(cells.filter(F.col("table") == i).select(F.col("cell").alias(f"_c{i}"))), f"_c{i}", "left_semi")
        return within.groupBy("value").agg(F.count("*").alias("n"))

    place = F.row_number().over(Window.partitionBy("table").orderBy(F.col("sum").desc(), "cell"))  # at most width rows in each
    first = counted(sums.withColumn("_p", place).filter(F.col("_p") <= 4 * limit)).sort(F.col("n").desc()).limit(limit)
    found = first.agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    floor = found["n"] if found["k"] == limit else 1
    return counted(sums.filter(F.col("sum") >= floor)).sort(F.col("n").desc(), "value").limit(limit)


def analysis_summary(df: DataFrame) -> DataFrame:
    """Counts over analyzed functions (priority, ai_analyzed, apply)."""
    out = df.agg(F.count("*").alias("total"), F.count_if("ai_analyzed").alias("ai_analyzed"), F.count_if(F.col("priority").isin("high", "critical")).alias("high_or_critical"), F.count_if("apply").alias("suggestions"))
    return out.withColumn("static_only", F.greatest(F.lit(0), F.col("total") - F.col("ai_analyzed")))


def skip_reason(name: Column, n_insn: Column, has_code: Column, skip_named: bool = True, min_insn: int = 5) -> Column:
    """Why a function is not a candidate: no_name, named, too_small or no_code; candidate if it is one."""
    from ..functions.names import rename_reason

    reason = rename_reason(name, skip_named)
    return F.when(reason.isin("no_name", "named"), reason).when(n_insn < min_insn, "too_small").when(~has_code, "no_code").otherwise("candidate")


def decision(error: Column, name: Column, old: Column, confidence: Column, n_evidence: Column, review_mode: bool = False, auto: float = 0.85, comment: float = 0.60, need_evidence: bool = True) -> Column:
    """failed_queued, skipped, queued, renamed or comment for a normalised answer."""
    sure = (confidence >= auto) & ((n_evidence > 0) | F.lit(not need_evidence))
    out = F.when(error, "failed_queued").when((F.coalesce(name, F.lit("")) == "") | (name == old), "skipped")
    return out.when(F.lit(review_mode), "queued").when(sure, "renamed").when(confidence >= comment, "queued").otherwise("comment")


def unique_names(names: DataFrame) -> DataFrame:
    """(ea, name, applied): a name already taken by a smaller ea gets the low 20 bits of the address as suffix."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ea"))
    return names.withColumn("_n", nth).select("ea", "name", F.when(F.col("_n") > 1, F.concat("name", F.lit("_"), F.lower(F.hex(F.col("ea").bitwiseAND(F.lit(0xFFFFF)))))).otherwise(F.col("name")).alias("applied"))


def cut_summaries(items: DataFrame, limit: int = 12, chars: int = 350) -> DataFrame:
    """(caller, summaries): the first child summaries (caller, ord, name, summary) of each caller, shortened."""
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy("caller").orderBy("ord"))).filter(F.col("_n") <= limit)
    packed = first.groupBy("caller").agg(F.sort_array(F.collect_list(F.struct("_n", "name", F.substring("summary", 1, chars).alias("summary")))).alias("s"))
    return packed.select("caller", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["summary"].alias("summary"))).alias("summaries"))

"""Ordered instruction streams and cross references.

insn rows: func_ea, ea, mnem, op_type, reg, value, addr (of the first operand that matters). Hash names: hashed_names().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import hash_djb2, hash_fnv1a, hash_ror13, hex_address, is_default_name, sanitize_name

# Names whose hashes are looked up.
HASHED_NAMES = (
    "VirtualAlloc", "VirtualAllocEx", "VirtualFree", "VirtualProtect", "VirtualProtectEx", "WriteProcessMemory", "ReadProcessMemory",
    "CreateRemoteThread", "NtCreateThreadEx", "OpenProcess", "CreateProcessA", "CreateProcessW", "ShellExecuteA", "ShellExecuteW", "LoadLibraryA",
    "LoadLibraryW", "GetProcAddress", "GetModuleHandleA", "GetModuleHandleW", "CreateFileA", "CreateFileW", "ReadFile", "WriteFile", "CloseHandle",
    "DeleteFileA", "DeleteFileW", "MoveFileA", "MoveFileW", "CopyFileA", "CopyFileW", "RegOpenKeyExA", "RegOpenKeyExW", "RegQueryValueExA",
    "RegQueryValueExW", "RegSetValueExA", "RegSetValueExW", "RegCreateKeyA", "RegCreateKeyW", "WSAStartup", "socket", "connect", "send", "recv",
    "closesocket", "bind", "listen", "accept", "gethostbyname", "gethostbyaddr", "InternetOpenA", "InternetOpenW", "InternetConnectA",
    "InternetConnectW", "InternetReadFile", "InternetWriteFile", "HttpSendRequestA", "HttpSendRequestW", "HttpOpenRequestA", "HttpOpenRequestW",
    "WinHttpOpen", "WinHttpConnect", "WinHttpSendRequest", "WinHttpReadData", "URLDownloadToFileA", "URLDownloadToFileW", "CreateThread", "ExitProcess",
    "ExitThread", "TerminateProcess", "TerminateThread", "SuspendThread", "ResumeThread", "GetTickCount", "GetTickCount64", "Sleep", "SleepEx",
    "WaitForSingleObject", "WaitForMultipleObjects", "CreateMutexA", "CreateMutexW", "OpenMutexA", "OpenMutexW", "CreateEventA", "CreateEventW",
    "OpenEventA", "OpenEventW", "SetFileAttributesA", "SetFileAttributesW", "GetTempPathA", "GetTempPathW", "CryptAcquireContextA",
    "CryptAcquireContextW", "CryptCreateHash", "CryptHashData", "CryptEncrypt", "CryptDecrypt", "CryptGenKey", "CryptDeriveKey", "CryptGenRandom",
    "BCryptEncrypt", "BCryptDecrypt", "BCryptGenerateSymmetricKey", "BCryptOpenAlgorithmProvider", "NtAllocateVirtualMemory", "NtWriteVirtualMemory",
    "NtMapViewOfSection", "NtQueryInformationProcess", "NtSetInformationThread", "NtResumeThread", "RtlDecompressBuffer", "RtlCompressBuffer",
    "RtlAllocateHeap", "IsDebuggerPresent", "CheckRemoteDebuggerPresent", "DbgBreakPoint", "CreateServiceA", "CreateServiceW", "OpenSCManagerA",
    "OpenSCManagerW", "StartServiceA", "StartServiceW", "DeleteService", "SetWindowsHookExA", "SetWindowsHookExW", "CallNextHookEx",
    "UnhookWindowsHookEx", "EnumProcesses", "Process32First", "Process32Next", "CreateToolhelp32Snapshot", "Module32First", "Module32Next",
    "Thread32First", "Thread32Next", "GetComputerNameA", "GetComputerNameW", "GetUserNameA", "GetUserNameW", "GetSystemInfo", "GetAdaptersInfo",
    "GetAdaptersAddresses", "QueueUserAPC", "ZwCreateSection", "RtlCreateUserThread", "CoCreateInstance", "OleInitialize", "CoInitialize",
)
CONDITIONAL_JUMPS = ("je", "jz", "jne", "jnz", "jg", "jl", "jge", "jle")
DISPATCHER = r"(?i)dispatch|resolver|wrapper|indirect|vtable|thunk|trampoline|gateway"
WRAPPER = r"(?i)(wrapper|indirect|dynamic|dispatch|thunk|sub_)"
BIG = 0xFFFF


def hashed_names(spark: SparkSession) -> DataFrame:
    """(value, api, family): names under three hashes; where a value occurs under two families, the rotating hash wins."""
    names = spark.createDataFrame([(n,) for n in HASHED_NAMES], "api string")
    kinds = F.array(F.struct(F.lit(0).alias("family"), hash_ror13(F.col("api")).alias("value")), F.struct(F.lit(1).alias("family"), hash_djb2(F.col("api")).alias("value")), F.struct(F.lit(1).alias("family"), hash_fnv1a(F.col("api")).alias("value")))
    each = names.select("api", F.explode(kinds).alias("h")).select("h.value", "api", "h.family")
    return each.groupBy("value").agg(F.min(F.struct("family", "api")).alias("m")).select("value", "m.api", "m.family")


def hash_loads(insns: DataFrame, table: DataFrame) -> DataFrame:
    """(func_ea, ea, api): large immediates moved or pushed that are the hash of a known name; the table is broadcast (three rows for each of HASHED_NAMES at most)."""
    low = insns.filter(F.col("mnem").isin("mov", "push") & (F.col("op_type") == "imm")).withColumn("_v", F.col("value").bitwiseAND(F.lit(0xFFFFFFFF)))
    return low.filter(F.col("_v") > BIG).drop("value").join(F.broadcast(table), F.col("_v") == F.col("value")).select("func_ea", "ea", "api")


def last_loads(insns: DataFrame) -> DataFrame:
    """(func_ea, ea, reg, pointer): for each call through a register, the last address loaded into it before in the function."""
    load = F.when(F.col("mnem").isin("mov", "lea"), F.coalesce(F.col("addr"), F.col("value")))
    before = Window.partitionBy("func_ea", "reg").orderBy("ea").rowsBetween(Window.unboundedPreceding, -1)
    return insns.filter(F.col("reg").isNotNull()).withColumn("pointer", F.last(load, ignorenulls=True).over(before)).filter((F.col("mnem") == "call") & F.col("pointer").isNotNull()).select("func_ea", "ea", "reg", "pointer")


def dereference(loads: DataFrame, memory: DataFrame) -> DataFrame:
    """(func_ea, ea, target) of loads whose pointer is a cell of memory (cell, target)."""
    return loads.join(memory, loads["pointer"] == memory["cell"]).select("func_ea", "ea", "target")


def compare_jumps(insns: DataFrame, functions: DataFrame) -> DataFrame:
    """(func_ea, value, target): large compared values and where the conditional jump after them goes, in dispatcher-like functions.

    A value counts while only compares stand between it and the jump; compares without a large immediate keep it. The
    last jump for a value wins.
    """
    wanted = functions.filter(F.col("name").rlike(DISPATCHER)).select(F.col("ea").alias("_f"))
    rows = insns.join(wanted, F.col("func_ea") == F.col("_f"), "left_semi")
    order = Window.partitionBy("func_ea").orderBy("ea")
    run = F.count_if(F.col("mnem") != "cmp").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_run", run)
    imm = F.when((F.col("mnem") == "cmp") & (F.col("op_type") == "imm") & (F.col("value") > BIG), F.col("value"))
    within = Window.partitionBy("func_ea", "_run").orderBy("ea").rowsBetween(Window.unboundedPreceding, -1)
    hits = rows.withColumn("_v", F.last(imm, ignorenulls=True).over(within)).filter(F.col("mnem").isin(*CONDITIONAL_JUMPS) & (F.col("op_type") == "near") & F.col("_v").isNotNull())
    return hits.groupBy("func_ea", F.col("_v").alias("value")).agg(F.max_by("addr", "ea").alias("target"))


def push_counts(insns: DataFrame) -> DataFrame:
    """(func_ea, pushes): pushes before a function's first call; 0 without a call."""
    first = F.min(F.when(F.col("mnem") == "call", F.col("ea"))).over(Window.partitionBy("func_ea"))
    return insns.withColumn("_first", first).groupBy("func_ea").agg(F.count_if((F.col("mnem") == "push") & (F.col("ea") < F.col("_first"))).alias("pushes"))


def single_targets(calls: DataFrame) -> DataFrame:
    """(caller, target, n): callers all of whose resolved calls go to one target."""
    by = calls.groupBy("caller").agg(F.countDistinct("target").alias("_t"), F.first("target").alias("target"), F.count("*").alias("n"))
    return by.filter("_t = 1").select("caller", "target", "n")


def wrapper_names(single: DataFrame, functions: DataFrame, pushes: DataFrame) -> DataFrame:
    """(ea, old_name, new_name) for wrapper-like or unnamed callers of one named target; taken names get an address suffix."""
    f = functions.select(F.col("ea").alias("_e"), F.col("name").alias("old_name"))
    t = functions.select(F.col("ea").alias("_t"), F.col("name").alias("target_name"))
    rows = single.join(f, F.col("caller") == F.col("_e")).join(t, F.col("target") == F.col("_t")).join(pushes.withColumnRenamed("func_ea", "_p"), F.col("caller") == F.col("_p"), "left")
    rows = rows.filter((is_default_name(F.col("old_name")) | F.col("old_name").rlike(WRAPPER)) & ~is_default_name(F.col("target_name")))
    bare, n = F.regexp_replace("target_name", "^(j_|_+)", ""), F.coalesce("pushes", F.lit(0))
    name = F.when(is_default_name(F.col("old_name")), F.concat(F.lit("resolve_and_call_"), bare, F.when(n > 0, F.concat(F.lit("_a"), n)).otherwise("")))
    name = name.when(F.contains(F.lower("old_name"), F.lit("indirect")), F.concat(F.lit("indirect_call_"), bare)).otherwise(F.concat(F.lit("wrap_"), bare))
    rows = rows.withColumn("_new", sanitize_name(name))
    taken = functions.select(F.col("name").alias("_taken"), F.col("ea").alias("_owner")).groupBy("_taken").agg(F.min("_owner").alias("_owner"))
    rows = rows.join(taken, F.col("_new") == F.col("_taken"), "left").withColumn("_nth", F.row_number().over(Window.partitionBy("_new").orderBy("caller")))
    clash = (F.col("_owner").isNotNull() & (F.col("_owner") != F.col("caller"))) | (F.col("_nth") > 1)
    return rows.select(F.col("caller").alias("ea"), "old_name", F.when(clash, F.concat("_new", F.lit("_"), F.lower(F.hex(F.col("caller").bitwiseAND(F.lit(0xFFF)))))).otherwise(F.col("_new")).alias("new_name"))


def first_names(edges: DataFrame, names: DataFrame, limit: int, by: str = "src", of: str = "dst") -> DataFrame:
    """(ea, names): distinct names at the other end of edges (src, dst, ea), first seen first, without the function itself.

    With by=dst and of=src, the callers instead of the callees.
    """
    named = names.select(F.col("ea").alias("_n"), "name").filter(F.coalesce("name", F.lit("")) != "")
    seen = edges.filter(F.col("src") != F.col("dst")).groupBy(F.col(by).alias("_by"), F.col(of).alias("_of")).agg(F.min("ea").alias("_at"))
    seen = seen.join(named, F.col("_of") == F.col("_n")).groupBy("_by", "name").agg(F.min("_at").alias("_at"))
    return _first(seen.select(F.col("_by").alias("ea"), F.struct("_at", "name").alias("item")), limit)


def _first(items: DataFrame, limit: int) -> DataFrame:
    """(ea, names) of the smallest `limit` items (struct ending in `name`) of each ea; Spark cuts groups before it sorts."""
    top = items.withColumn("_k", F.row_number().over(Window.partitionBy("ea").orderBy("item"))).filter(F.col("_k") <= limit)
    return top.groupBy("ea").agg(F.sort_array(F.collect_list("item")).alias("i")).select("ea", F.col("i.name").alias("names"))


def referenced_strings(refs: DataFrame, strings: DataFrame, limit: int = 20, least: int = 3, width: int = 150) -> DataFrame:
    """(ea, names): strings (addr, text) that a function refers to (func_ea, ea, addr), once per address, shortened."""
    once = refs.groupBy("func_ea", "addr").agg(F.min("ea").alias("_at"))
    found = once.join(strings.filter(F.length("text") >= least), "addr")
    return _first(found.select(F.col("func_ea").alias("ea"), F.struct("_at", F.substring("text", 1, width).alias("name")).alias("item")), limit)


def imported_names(refs: DataFrame, functions: DataFrame, names: DataFrame, limit: int = 30) -> DataFrame:
    """(ea, names): named targets of references (src, dst, ea) that have no function of their own."""
    outside = refs.join(functions.select(F.col("ea").alias("_f")), F.col("dst") == F.col("_f"), "left_anti")
    return first_names(outside, names, limit)


def constants(insns: DataFrame, limit: int = 30) -> DataFrame:
    """(ea, names): distinct large immediates as hexadecimal; all-ones words are left out."""
    big = insns.filter((F.col("op_type") == "imm") & (F.col("value") > BIG) & ~F.col("value").isin(0xFFFFFFFF, -1))
    once = big.groupBy("func_ea", "value").agg(F.min("ea").alias("_at"))
    return _first(once.select(F.col("func_ea").alias("ea"), F.struct("_at", F.concat(F.lit("0x"), F.lower(F.hex("value"))).alias("name")).alias("item")), limit)


def struct_accesses(insns: DataFrame, limit: int = 48) -> DataFrame:
    """(func_ea, reg, offset, access_ea): first access of each small displacement off a register."""
    near = insns.filter((F.col("op_type") == "displ") & (F.col("value") > 0) & (F.col("value") < 0x1000))
    once = near.groupBy("func_ea", "reg", F.col("value").alias("offset")).agg(F.min("ea").alias("access_ea"))
    nth = F.row_number().over(Window.partitionBy("func_ea").orderBy("access_ea", "reg", "offset"))
    return once.withColumn("_n", nth).filter(F.col("_n") <= limit).drop("_n")


def struct_offsets(accesses: DataFrame, limit: int = 24) -> DataFrame:
    return accesses.groupBy("func_ea").agg(F.slice(F.sort_array(F.collect_set("offset")), 1, limit).alias("offsets"))


def xref_counts(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(ea, n_callers, n_callees): references in, every one counted, and distinct targets out; 0 for functions without any."""
    into = edges.groupBy(F.col("dst").alias("_i")).agg(F.count("*").alias("n_callers"))
    out = edges.groupBy(F.col("src").alias("_o")).agg(F.countDistinct("dst").alias("n_callees"))
    rows = functions.select("ea").join(into, F.col("ea") == F.col("_i"), "left").join(out, F.col("ea") == F.col("_o"), "left")
    return rows.select("ea", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_callees", F.lit(0)).alias("n_callees"))


def function_sizes(functions: DataFrame, insns: DataFrame) -> DataFrame:
    """(ea, name, n_insn); 0 for functions without a body."""
    counted = insns.groupBy(F.col("func_ea").alias("_f")).agg(F.count("*").alias("n_insn"))
    return functions.select("ea", "name").join(counted, F.col("ea") == F.col("_f"), "left").select("ea", "name", F.coalesce("n_insn", F.lit(0)).alias("n_insn"))


def code_text(functions: DataFrame, lines: DataFrame, gate: int = 0x8000, most: int = 80) -> DataFrame:
    """(ea, code, code_type): pseudocode of functions (ea, size_bytes, pseudo) up to the size gate, else the first assembly lines (func_ea, ea, line)."""
    nth = F.row_number().over(Window.partitionBy("func_ea").orderBy("ea"))
    top = lines.withColumn("_n", nth).filter(F.col("_n") <= most + 1).groupBy(F.col("func_ea").alias("_f")).agg(F.sort_array(F.collect_list(F.struct("_n", "line"))).alias("l"))
    asm = F.concat(F.array_join(F.slice(F.col("l.line"), 1, most), "\n"), F.when(F.size("l") > most, F.lit("\n...")).otherwise(""))
    pseudo = F.when((F.col("size_bytes") <= gate) & (F.coalesce("pseudo", F.lit("")) != ""), F.col("pseudo"))
    rows = functions.join(top, F.col("ea") == F.col("_f"), "left")
    return rows.select("ea", F.coalesce(pseudo, asm, F.lit("")).alias("code"), F.when(pseudo.isNotNull(), "pseudocode").otherwise("assembly").alias("code_type"))


def containing(points: DataFrame, ranges: DataFrame, width: int = 4096) -> DataFrame:
    """Join points (addr, ...) to all ranges (start, end, ...) that hold them, overlapping or not, as an equi-join on address blocks.

    A range is listed under the one or two blocks that it touches of the smallest power of two not below its length and width, so
    its length does not matter. A point is listed under its block of each size that occurs; there are at most 63 of them.
    """
    least = max(0, (width - 1).bit_length())
    long = F.col("end").cast("double") - F.col("start").cast("double")
    sized = ranges.filter("end > start").withColumn("_size", F.least(F.lit(62), F.greatest(F.lit(least), F.ceil(F.log2(long)))).cast("int"))
    block = lambda c: F.expr(f"shiftright({c}, _size)")
    listed = sized.withColumn("_block", F.explode(F.sequence(block("start"), block("end - 1"))))
    sizes = sized.select("_size").distinct()  # at most 63 rows
    placed = points.crossJoin(F.broadcast(sizes)).withColumn("_block", block("addr"))
    return placed.join(listed, ["_size", "_block"]).filter((F.col("addr") >= F.col("start")) & (F.col("addr") < F.col("end"))).drop("_size", "_block")


def decoded_for_functions(records: DataFrame, functions: DataFrame, limit: int = 30, width: int = 4096) -> DataFrame:
    """(ea, value, kind): decoded strings (ord, string, address, function_ea, kind) of each function (start, end), by owner or place.

    One row for each text, first seen first, at most `limit` for a function.
    """
    owned = records.join(functions.select(F.col("start").alias("_s")), F.col("function_ea") == F.col("_s")).select(F.col("_s").alias("ea"), "ord", "string", "kind")
    placed = containing(records.filter("address IS NOT NULL").withColumnRenamed("address", "addr"), functions.select("start", "end"), width).select(F.col("start").alias("ea"), "ord", "string", "kind")
    both = owned.unionByName(placed).filter(F.coalesce("string", F.lit("")) != "").groupBy("ea", F.col("string").alias("value")).agg(F.min(F.struct("ord", "kind")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("ea").orderBy("f.ord"))
    return both.withColumn("_n", nth).filter(F.col("_n") <= limit).select("ea", "value", "f.kind")


def prompt_text(item: Column) -> Column:
    """A request's text for one function: its name, then a line for each kind of context it has, then its code."""

    def line(title, values, sep, most):
        kept = F.slice(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != ""), 1, most)
        return F.when(F.size(kept) > 0, F.concat(F.lit(f"// {title}: "), F.array_join(kept, sep)))

    named = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda v: ~is_default_name(v))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("--- "), item["name"], F.lit(" ---")),
        line("Calls", named(item["callees"]), ", ", 10),
        line("Called by", named(item["callers"]), ", ", 5),
        line("Strings", item["strings"], "; ", 8),
        line("Decoded strings", item["decoded"], "; ", 6),
        line("APIs", item["apis"], ", ", 14),
        line("Constants", item["constants"], ", ", 8),
        line("Static pre-tags", item["pre_tags"], ", ", 50),
        line("Technique hints", item["hints"], "; ", 3),
        F.lit("```"),
        F.substring(F.coalesce(item["code"], F.lit("")), 1, 3000),
        F.lit("```"),
    )


def address_text(df: DataFrame, column: str = "ea") -> DataFrame:
    return df.withColumn(f"{column}_hex", hex_address(F.col(column)))


def pass_summary(hashes: DataFrame, indirect: DataFrame, jumps: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row with how much each of the four passes found."""
    one = lambda df, what, name: df.agg(what.alias(name))
    out = one(hashes, F.count("*"), "hash_loads").crossJoin(one(indirect, F.count("*"), "indirect_calls"))
    return out.crossJoin(one(jumps, F.countDistinct("func_ea"), "dispatchers")).crossJoin(one(wrappers, F.count("*"), "wrappers"))  # one row each

"""Deadlock graphs in log text to one struct per process, by built-in expressions.

An event's text loses its line prefixes and repeated lines, is split at its
process blocks, and each block's lines run through a small state machine (an
``aggregate``) that finds the procedure, the statement on the stack and the one in
the input buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_text, strip

# The log's line prefix, the anchors, and the attributes of a process line.
LINE_PREFIX = r"(?md)^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+spid\S+\s*"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PROCESS = r"(?md)^[\t ]*process id="
VICTIM = r"deadlock victim=(\S+)"
ATTRIBUTES = {
    "spid": r"\bspid=(\d+)\b",
    "kpid": r"\bkpid=(\d+)\b",
    "logused": r"\blogused=(\d+)\b",
    "waitresource": r"\bwaitresource=(.+?)\s+(?:waittime|ownerId)=",
    "waittime": r"\bwaittime=(\d+)\b",
    "lockMode": r"\blockMode=(\S+)",
    "trancount": r"\btrancount=(\d+)\b",
    "transactionname": r"\btransactionname=(\S+)",
    "lasttranstarted": r"\blasttranstarted=(\S+)",
    "isolationlevel": r"\bisolationlevel=([^(]+\(\d+\))",
    "loginname": r"\bloginname=(\S+)",
    "clientapp": r"\bclientapp=(.+?)\s+hostname=",
    "apphost": r"\bhostname=(\S+)",
    "currentdbname": r"\bcurrentdbname=(\w+)",
    "lockTimeout": r"\blockTimeout=(\d+)",
    "status": r"\bstatus=(\S+)",
}
ANY_FRAME = r"^\s*frame procname="
REAL_FRAME = r"frame procname=(?!unknown|adhoc)(\S+)"
PROCEDURE_STUB = r"^\s*Proc \[Database Id"
STATEMENT = r"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|EXEC|WITH|MERGE|@\w)"
AUTO_STATS = "UpdateQPStats (auto-stats deadlock)"
METADATA = [
    "deadlock_id", "deadlock_victim", "pid", "is_victim", "spid", "kpid", "logused", "waitresource", "waittime", "lockMode", "trancount", "transactionname",
    "lasttranstarted", "currentdbname", "isolationlevel", "loginname", "clientapp", "apphost", "lockTimeout", "status", "proc_name", "exec_sql", "inputbuf_sql",
]

# The lines that open a section of a block, and what such a section is called here.
SECTIONS = {"executionStack": "frames", "inputbuf": "input"}
LISTING, AFTER_LISTED = "frames", "statement"  # a section of frames, and the lines after a frame that names a procedure


def _joined(lines: Column) -> Column:
    """The lines as one text: single blanks stay, longer runs of white space and any but blanks become one."""
    return strip(F.regexp_replace(F.array_join(lines, " "), r"\s{2,}|[\r\n\t]", " "))


def _step(acc: Column, line: Column) -> Column:
    """One line of a block: a line that opens a section changes the section, other lines are collected by it."""
    bare = strip(line)
    frame = line.rlike(ANY_FRAME) & acc["section"].isin(LISTING, AFTER_LISTED)
    procedure = F.regexp_extract(line, REAL_FRAME, 1)
    real = frame & (procedure != "")
    ends = (bare == "resource-list") | bare.startswith("process id=")
    plain = ~bare.isin(*SECTIONS) & ~frame & (bare != "") & (bare != "unknown")
    section = F.when(real, AFTER_LISTED).when(frame, LISTING).otherwise(acc["section"])
    for opener, name in SECTIONS.items():
        section = F.when(bare == opener, name).otherwise(section)
    stack = F.when(real, F.array().cast("array<string>")).when(plain & (acc["section"] == AFTER_LISTED), F.concat(acc["stack"], F.array(bare))).otherwise(acc["stack"])
    buffer = F.when(plain & (acc["section"] == SECTIONS["inputbuf"]) & ~line.rlike(PROCEDURE_STUB), F.concat(acc["buffer"], F.array(bare))).otherwise(acc["buffer"])
    name = F.when(real & (acc["name"] == ""), procedure).otherwise(acc["name"])
    done = acc["done"] | ends
    now = {"section": section, "name": name, "stack": stack, "buffer": buffer}
    return F.struct(done.alias("done"), *[F.when(done, acc[k]).otherwise(v).alias(k) for k, v in now.items()])


def _process(block: Column, victims: Column, deadlock_id: Column, time: Column, host: Column) -> Column:
    """Struct of a block given as (pid, lines)."""
    line = F.concat(F.lit("process id="), block["lines"][0])
    found = {k: strip(F.regexp_extract(line, p, 1)) for k, p in ATTRIBUTES.items()}
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("done"), F.lit("").alias("section"), F.lit("").alias("name"), none.alias("stack"), none.alias("buffer"))
    parsed = F.aggregate(F.slice(block["lines"], 2, F.greatest(F.size(block["lines"]) - 1, F.lit(0))), start, _step, lambda acc: F.struct(acc["name"].alias("name"), _joined(acc["stack"]).alias("stack"), _joined(acc["buffer"]).alias("buffer")))
    return F.struct(
        deadlock_id.alias("deadlock_id"), F.array_join(victims, " ").alias("deadlock_victim"), time.alias("time"), host.alias("host"), F.array_contains(victims, block["pid"]).alias("is_victim"), block["pid"].alias("pid"),
        *[c.alias(k) for k, c in found.items()], parsed.alias("parsed"),
    )


def _finished(p: Column) -> Column:
    name, stack, buffer = p["parsed"]["name"], p["parsed"]["stack"], p["parsed"]["buffer"]
    best = (
        F.when((buffer != "") & buffer.rlike(STATEMENT), buffer)
        .when((stack != "") & stack.rlike(STATEMENT), stack)
        .when(buffer != "", buffer)
        .when(stack != "", stack)
        .when(name != "", F.concat(F.lit("Proc: "), name))
        .when(p["transactionname"] == "UpdateQPStats", AUTO_STATS)
        .otherwise("")
    )
    plain = ["deadlock_id", "deadlock_victim", "time", "host", "is_victim", "pid", *ATTRIBUTES]
    values = {k: p[k] for k in plain} | {"proc_name": name, "exec_sql": stack, "inputbuf_sql": buffer}
    meta = json_text({k: values[k] for k in METADATA}, {"is_victim": p["is_victim"]})
    return F.struct(*[p[k].alias(k) for k in plain], name.alias("proc_name"), stack.alias("exec_sql"), buffer.alias("inputbuf_sql"), best.alias("sql_text"), meta.alias("metadata"))


def parse(df: DataFrame, raw: str = "_raw", time: str = "time", host: str = "host", out: str = "processes") -> DataFrame:
    """``df`` with an array of the processes of each event.

    The array is empty where the text is null, doesn't mention a deadlock or names no victim. Of repeated blocks of
    one process the first counts; processes on tempdb, and those without any statement, are left out.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    lines = F.split(F.regexp_replace(text, LINE_PREFIX, ""), LINE_END)
    staged = df.withColumn("__lines", lines)
    # a line that only repeats the one before is an artefact of interleaved logging
    staged = staged.withColumn("__clean", F.array_join(F.filter("__lines", lambda x, i: (i == 0) | (strip(x) != strip(F.get(F.col("__lines"), i - 1)))), "\n"))
    staged = staged.withColumn("__victims", F.array_sort(F.array_distinct(F.regexp_extract_all("__clean", F.lit(VICTIM), F.lit(1)))))
    when, where = F.coalesce(F.col(time), F.lit("")), F.coalesce(F.col(host), F.lit(""))
    key = F.substring(F.md5(F.concat_ws("|", when, where, F.array_join("__victims", "|")).cast("binary")), 1, 16)
    blocks = F.transform(
        F.slice(F.split("__clean", PROCESS), 2, F.greatest(F.size(F.split("__clean", PROCESS)) - 1, F.lit(0))),
        lambda b: F.filter(F.split(b, LINE_END), lambda x: strip(x) != ""),
    )
    named = F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.struct(F.regexp_extract(b[0], r"(?U)^(\S+)", 1).alias("pid"), b.alias("lines")))
    staged = staged.withColumn("__blocks", F.filter(named, lambda b: b["pid"] != ""))
    pids = F.transform("__blocks", lambda b: b["pid"])
    staged = staged.withColumn("__first", F.filter("__blocks", lambda b, i: F.array_position(pids, b["pid"]) == i + 1))
    made = F.transform(F.transform("__first", lambda b: _process(b, F.col("__victims"), key, when, where)), _finished)
    good = F.filter(made, lambda p: (p["currentdbname"] != "tempdb") & (p["sql_text"] != ""))
    usable = F.lower(text).contains("deadlock") & (F.size("__victims") > 0)
    return staged.withColumn(out, F.when(usable, good).otherwise(F.filter(good, lambda p: F.lit(False)))).drop("__lines", "__clean", "__victims", "__blocks", "__first")


def processes(df: DataFrame, raw: str = "_raw", time: str = "time", host: str = "host", out: str = "p") -> DataFrame:
    """A row per process of each event, in column ``out``; events without any give none.

    Empty arrays are dropped after the explode: before it, the test would parse every text once more.
    """
    rows = parse(df, raw, time, host, "__processes").withColumn(out, F.explode_outer("__processes")).drop("__processes")
    return rows.where(F.col(out).isNotNull())

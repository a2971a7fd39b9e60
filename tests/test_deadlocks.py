"""Deadlock graphs: two-way, ad-hoc, automatic statistics, interleaved three-way, and what isn't one."""

import json

from dbpulse.operators import deadlocks
from dbpulse.plans.catalogue import GRAPH


def parsed(spark, raw, time="2025-11-03T08:41:19", host="DB1"):
    df = spark.createDataFrame([(raw, time, host)], "_raw string, time string, host string")
    return deadlocks.parse(df).first().processes


def graph(*processes, victims=("pA",)):
    lines = ["deadlock-list", *[f" deadlock victim={v}" for v in victims], "  process-list"]
    for p in processes:
        lines += p
    return "\n".join([*lines, "   resource-list"])


def process(pid, attrs="", stack=(), buffer=()):
    return [f"   process id={pid} {attrs}", "    executionStack", *stack, "    inputbuf", *buffer]


def test_two_way(spark):
    import hashlib

    a, b = parsed(spark, GRAPH)
    assert (a.pid, a.is_victim, a.proc_name, a.sql_text) == ("processAAA", True, "shop.dbo.pay", "UPDATE accounts SET n = 1")
    assert (a.waitresource, a.waittime, a.lockMode, a.apphost, a.currentdbname) == ("KEY: 5:72 (ab)", "1200", "U", "APP1", "shop")
    assert (b.pid, b.is_victim, b.proc_name, b.sql_text) == ("processBBB", False, "", "SELECT a FROM b")
    assert a.deadlock_id == hashlib.md5(b"2025-11-03T08:41:19|DB1|processAAA").hexdigest()[:16]
    meta = json.loads(a.metadata)
    assert meta["is_victim"] is True and "status" not in meta and list(meta)[:3] == ["deadlock_id", "deadlock_victim", "pid"]
    assert "is_victim" not in json.loads(b.metadata)


def test_automatic_statistics(spark):
    [p] = parsed(spark, graph(process("pA", "transactionname=UpdateQPStats lockMode=Sch-M", buffer=["unknown"])))
    assert p.sql_text == deadlocks.AUTO_STATS and p.lockMode == "Sch-M"


def test_three_way_interleaved(spark):
    block = process("pA", "spid=1", buffer=["SELECT 1"])
    got = parsed(spark, graph(block, process("pG", buffer=["DELETE x"]), block, process("pI", buffer=["SELECT 3"]), victims=("pI", "pG")))
    assert [p.pid for p in got] == ["pA", "pG", "pI"]
    assert [p.is_victim for p in got] == [False, True, True] and got[0].deadlock_victim == "pG pI"


def test_repeated_lines_count_once(spark):
    [p] = parsed(spark, graph(process("pA", buffer=["SELECT a", "   SELECT a", "FROM b"])))
    assert p.sql_text == "SELECT a FROM b"


def test_last_real_frame_wins_and_first_names(spark):
    stack = ["     frame procname=db.dbo.one line=1", "UPDATE a", "     frame procname=unknown", "ignored", "     frame procname=db.dbo.two", "INSERT b"]
    [p] = parsed(spark, graph(process("pA", stack=stack)))
    assert (p.proc_name, p.exec_sql, p.sql_text) == ("db.dbo.one", "INSERT b", "INSERT b")


def test_left_out(spark):
    for raw in (None, "", "nothing here", "deadlock without one", graph(process("pA", "currentdbname=tempdb", buffer=["SELECT 1"])), graph(process("pA", "transactionname=user_transaction"))):
        assert parsed(spark, raw) == []


def test_windows_line_ends(spark):
    got = parsed(spark, GRAPH.replace("\n", "\r\n"))
    assert [p.sql_text for p in got] == ["UPDATE accounts SET n = 1", "SELECT a FROM b"]

"""Column functions on the cases that trip engines up."""

import pytest
from pyspark.sql import functions as F

from dbpulse.functions import kinds, text, times


def values(spark, given, expr):
    rows = [(i, v) for i, v in enumerate(given)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


MONTHS = {
    "2026-02-28T23:55:18.000+0800": "2026-02",
    "2026-01-15T12:30:00+05:30": "2026-01",
    "2025-11-15": "2025-11",
    "2025/11/15 09:30:00": "2025-11",
    "11/15/2025 09:30:00 AM": "2025-11",
    "1/26/2026 8:58:53 AM": "2026-01",
    "Jan 26 2026  9:00AM": "2026-01",
    "2026-02-03T04:05:06.7": "2026-02",
    None: None,
    "": None,
    "   ": None,
    "2026": None,
    "2026-02": None,
    "not-a-date": None,
    "2026-02-30": None,
    "2026-02-03T04:05:06Z": None,
}


def test_months(spark):
    assert values(spark, list(MONTHS), times.month_of) == list(MONTHS.values())


def test_replace_first_only(spark):
    assert values(spark, ["a 1 b 2", "none", "é1", "7.", "x\n3 4"], lambda c: text.replace_first(c, text.NUMBER, "?")) == ["a ? b 2", "none", "é?", "?.", "x\n? 4"]


def test_header_of_any_length(spark):
    long = "(" + ",".join(f"@p{i} nvarchar(4000)" for i in range(30_000)) + ")select 1"
    assert values(spark, [long], text.without_header) == ["select 1"]


def test_clean(spark):
    assert values(spark, ["  a\t\n b @P12 @p3  ", None, " x  y "], text.clean) == ["a b @P? @p3", None, "x y"]


def test_json_text_like_python(spark):
    import json

    given = ['quo"te', "back\\slash", "new\nline", "tab\t", "sl/ash", "é日"]
    got = values(spark, given, lambda c: text.json_text({"k": c, "empty": F.lit(""), "flag": F.lit(True), "no": F.lit(False)}, {"flag": F.lit(True), "no": F.lit(False)}))
    assert got == [json.dumps({"k": v, "flag": True}, ensure_ascii=False) for v in given]
    assert values(spark, [""], lambda c: text.json_text({"k": c})) == [None]


def test_common_hash_skips_blank_metadata(spark):
    import hashlib

    lit = F.lit
    one = lambda meta: kinds.common_hash(lit("sql"), lit(" Host "), lit(None).cast("string"), lit("prod"), lit("blocker"), lit("t"), lit("q"), meta)
    want = hashlib.md5(b"sql|host||prod|blocker|t|q").hexdigest()
    assert values(spark, ["  ", None], one) == [want, want]
    assert values(spark, ["{}"], one) == [hashlib.md5(b"sql|host||prod|blocker|t|q|{}").hexdigest()]


@pytest.mark.parametrize(
    ("name", "category", "environment"),
    [("maxElapsedQueriesProdFeb26.csv", "slow_query_sql", "prod"), ("blockersSatFeb26.csv", "blocker", "sat"), ("DeadLocksX.csv", "deadlock", "unknown"), ("mongodbSlowQueriesSat.csv", "slow_query_mongo", "sat"), ("maxElaspedQueriesProd.csv", "unknown", "prod"), ("dataFileSizeProd.csv", "unknown", "prod")],
)
def test_file_names(spark, name, category, environment):
    assert values(spark, [name], kinds.file_category) == [category]
    assert values(spark, [name], kinds.environment_of) == [environment]


def test_lenient_numbers(spark):
    assert values(spark, ["1,234", "12.0", "x", None, ""], kinds.to_long) == [1234, 12, None, None, None]


def test_mongo_command(spark):
    got = values(spark, ['{"attr": {"command": {"find": "c", "filter": {"a": 1}}}}', '{"attr": {"type": "remove"}}', "broken", "", None], kinds.mongo_command)
    assert got[0] == '{"find":"c","filter":{"a":1}}' and got[1] == '{"type":"remove"}'
    assert "parse_failed" in got[2] and got[3:] == ["", ""]


def test_weeks_of_january_2026(spark):
    weeks = values(spark, ["2026-01"], times.month_weeks)[0]
    assert [(w.week_start.day, w.week_end.day) for w in weeks] == [(1, 4), (5, 11), (12, 18), (19, 25), (26, 31)]

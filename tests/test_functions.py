"""Column functions on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def values(spark, rows, column, ddl="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], ddl).select(column).collect()]


def test_hex(spark):
    rows = ["0x00401C0E", "00401C0E", "0xEXTERNAL:00000001", "0xFFFFFFFFFFFFFFFF", "10000000000000000", "000000000000000001", "", " add ", "0x", "xyz", None]
    assert values(spark, rows, T.parse_hex(F.col("s"))) == [0x401C0E, 0x401C0E, None, -1, None, 1, None, 0xADD, None, None, None]


def test_flags_and_kinds(spark):
    assert values(spark, ["True", "t", "1", "YES", "False", "0", "no", "maybe", None], T.flag(F.col("s"))) == [1, 1, 1, 1, 0, 0, 0, None, None]
    df = spark.createDataFrame([("FUNC", 0), ("Function", 1), ("label", None), ("OBJ", 0), ("x", 0), (None, None)], "t string, e int")
    assert [r[0] for r in df.select(T.symbol_kind(F.col("t"), F.col("e"))).collect()] == ["function", "import", "label", "data", "other", "other"]


@pytest.mark.parametrize(
    ("code", "n"), [("int f()\n{\n  a;\n\n}\n", 2), ("", 0), (None, 0), ("{\r\n x \r\n}", 1)])
def test_effective_lines(spark, code, n):
    assert values(spark, [code], T.effective_lines(F.col("s"))) == [n]


def test_names(spark):
    assert values(spark, ["int *foo(int a)", "bar", "void &g ()", None], T.name_of_signature(F.col("s"))) == ["foo", "", "g", ""]
    assert values(spark, ["v1 = arg_2 + var_1F; xv1 a10"], T.generic_names(F.col("s"))) == [["a10", "arg_2", "v1", "var_1F"]]
    assert values(spark, ["parseAuthPacket_v2"], T.name_tokens(F.col("s"))) == [["auth", "packet", "parse"]]
    assert values(spark, ["0x401000", "401000", "zz"], T.normal_address(F.col("s"))) == ["0x401000", "0x61e68", "zz"]


def test_code_sets(spark):
    assert values(spark, ['if (x) foo(bar(1)); return baz ("s")'], T.callees_of(F.col("s"))) == [["foo", "bar", "baz"]]
    assert values(spark, ['a("x"); b("y", "x")'], T.strings_of(F.col("s"))) == [["x", "y"]]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0]


def test_subsequence(spark):
    df = spark.createDataFrame([([1, 3], [1, 2, 3]), ([3, 1], [1, 2, 3]), ([], [1]), ([1], [])], "e array<int>, a array<int>")
    assert [r[0] for r in df.select(T.is_subsequence(F.col("e"), F.col("a"))).collect()] == [True, False, True, False]


def test_rename_is_sequential_longest_first(spark):
    df = spark.createDataFrame([("v1 + v12 + xv1", {"v1": "v3", "v12": "v1x", "v3": "no good"})], "s string, m map<string,string>")
    assert df.select(T.rename_identifiers(F.col("s"), F.col("m"))).first()[0] == "v3 + v1x + xv1"


def test_comments(spark):
    assert values(spark, ["// reads it", "", "{};()[]=<>{};()[]" + "x" * 60], T.clean_comment(F.col("s"))) == ["reads it", None, None]
    df = spark.createDataFrame([("x = 1;", "set"), ("y; // old", "new"), ("}", "no"), ("z", None)], "l string, c string")
    assert [r[0] for r in df.select(T.with_comment(F.col("l"), F.col("c"))).collect()] == ["x = 1;  // set", "y; // old | new", "}", "z"]


def test_environment(spark):
    assert values(spark, ["if (argc > 1) Sleep(GetTickCount())", "plain"], T.environment_signals(F.col("s"))) == [["command_line", "timing"], []]


def test_variables(spark):
    df = spark.createDataFrame([("int f(char *buf, int n[4], void)", "total = 0;\n__x = 1; if (a == b) sub_10 = 2; y += 3;")], "p string, b string")
    assert df.select(T.variable_names(F.col("p"), F.col("b"))).first()[0] == ["buf", "n", "total", "y"]

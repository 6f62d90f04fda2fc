import pytest

from foliospark.functions import expressions as E

CASES = [
    ("1 + 2 * 3", 7.0), ("(2 + 3) * 4", 20.0), ("-(-5)", 5.0), ('"3" + 4', 7.0), ('"x" + 1', 1.0), ("1 <> 2", 1.0), ("2 >= 3", 0.0), ("1 and 0", 0.0),
    ("not (1 > 2)", 1.0), ('Concat("a", 42, Null())', "a42"), ("Null() + 5", 5.0), ("null", None), ("", None), ("1\n2\n3", 3.0), ("null == null", 1.0), ("null == 0", 0.0),
    ("var x = 10\nx = x + 1\nx", 11.0), ("if 1 > 2 then 1 elseif 2 > 1 then 5 else 3 endif", 5.0), ("Abs(-5)", 5.0), ("ABS(-5)", 5.0), ("Avg(1, 2, 6)", 3.0), ("Ceil(-1.2)", -1.0),
    ("Floor(-1.2)", -2.0), ("Mod(10, 3)", 1.0), ("Round(3.456, 2)", 3.46), ("Round(-2.5, 0)", -3.0), ('At("abcabc", "bc")', 2.0), ('At("a", "x")', 0.0), ('Left("abc", 10)', "abc"),
    ('Right("hello", 2)', "lo"), ('Substr("hello", 2, 3)', "ell"), ('Stuff("abcdef", 3, 2, "XY")', "abXYef"), ("Space(2)", "  "), ("Choose(2, 10, 20)", 20.0), ("If(0, 1, 2)", 2.0),
    ("Oneof(3, 1, 3)", 1.0), ("Within(10, 1, 10)", 1.0), ('HasValue("")', 0.0), ('Date2Num("2003-07-22", "YYYY-MM-DD")', 37823.0), ('Num2Date(37823, "YYYY-MM-DD")', "2003-07-22"),
    ('Time2Num("13:30:00", "HH:MM:SS")', 48600001.0), ('Num2Time(48600001, "HH:MM:SS")', "13:30:00"), ('Len("")', 0.0), ("WordNum(1234)", "One Thousand Two Hundred Thirty Four"),
    ("var s = 0\nfor i = 1 upto 5 do\ns = s + i\nendfor\ns", 15.0), ("var s = 0\nfor i = 3 downto 1 do s = s + i endfor\ns", 6.0),
    ("var i = 0\nwhile 1 do\ni = i + 1\nif i == 4 then break endif\nendwhile\ni", 4.0), ("var s = 0\nforeach x in (1, 2, 4) do s = s + x endfor\ns", 7.0),
    ("func f(n)\nif n <= 1 then return 1 endif\nreturn n * f(n - 1)\nendfunc\nf(6)", 720.0), ('"a""b"', 'a"b'),
]


@pytest.mark.parametrize("script,value", CASES)
def test_value(script, value):
    assert E.evaluate(script) == value


@pytest.mark.parametrize("script", ["1 / 0", "f(", "1 +", "nosuch(1)", "while 1 do endwhile", "func f() f() endfunc f()", "@"])
def test_errors(script):
    with pytest.raises(E.ScriptError):
        E.evaluate(script)


def test_payments():
    assert abs(E.evaluate("Pmt(10000, 0.01, 38)") - 317.6) < 1
    assert E.evaluate("Rate(2000, 1000, 5)") > 0 and E.evaluate("NPV(0.1, 100, 200)") > 0


@pytest.mark.parametrize(
    "script",
    ["a + b", "a / b", 'Concat(s, "-", a)', "if a > 1 then a else b endif", "Round(a * 1.005, 2)", "Substr(s, 2, 2)", "s + 1", "Max(a, b)", "not a", "s == \"x7\"", "a == null", "Len(s)", "Oneof(a, 1, 2)"],
)
def test_columns_agree_with_the_interpreter(spark, script):
    rows = [(1.0, 2.0, "x7"), (2.5, 0.0, "12"), (None, -1.0, None), (0.0, None, "")]
    df = spark.createDataFrame(rows, "a double, b double, s string")
    E._compile(E.parse(script), {"a": "n", "b": "n", "s": "s"})
    got = [r[0] for r in df.select(E.compiled(script, df)).collect()]
    want = []
    for row in rows:
        try:
            v = E.evaluate(script, dict(zip(("a", "b", "s"), row)))
            want.append(None if v is None else E.string(v))
        except E.ScriptError:
            want.append(None)
    assert [g and g[:9] for g in got] == [w and w[:9] for w in want]


def test_loops_run_per_row(spark):
    df = spark.createDataFrame([(3,), (0,), (None,)], "n int")
    got = [r[0] for r in df.select(E.compiled("var s = 0\nfor i = 1 upto n do\ns = s + i\nendfor\ns", df)).collect()]
    assert got == ["6", "0", "0"]


def test_only_named_columns_are_read_and_errors_kept(spark, tmp_path):
    spark.createDataFrame([(1, 5.0, "x"), (2, None, "y")], "a int, b double, c string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    script = "var i = 0 while (i < 3) do i = i + a endwhile i"
    plan = df.select(E.compiled(script, df))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int>" in plan
    assert [r.v for r in df.select(E.compiled(script, df).alias("v")).collect()] == ["3", "4"]
    got = df.select(E.compiled("while (1) do b = 1 endwhile", df, errors=True).alias("v")).first().v
    assert got.value is None and got.error


def test_numbers_run_on_over_sparse_keys(spark):
    from foliospark.operators import search

    rows = spark.createDataFrame([(i * i * 100_003,) for i in range(300, 0, -1)], "k bigint")
    got = sorted((r.k, r.stamp) for r in search.numbered(rows, "k", "N", 5, 4).collect())
    assert [s for _, s in got] == [f"N{i:04d}" for i in range(5, 305)]

import json
import random

from pyspark.sql import functions as F

from tallyveil.functions import coerce, jsontext, money

from .samples import values, variants


def test_relational_values(spark):
    df = variants(spark, {"id": 1, "display_name": "X"}, [2, "Y"], {"id": 7, "name": "N", "display_name": ""}, "s", 5, False, None,
                  [7, "Z", 1], [], [True, "b"], {"id": "7"}, "true")
    assert values(df.select("i", coerce.relational_name(F.col("v")))) == ["X", "Y", "N", None, None, None, None, None, None, "b", None, None]
    assert values(df.select("i", coerce.relational_id(F.col("v")))) == [1, 2, 7, None, 5, None, None, 7, None, None, None, None]
    text = variants(spark, '"plain"', '""', '"false"')
    assert values(text.select("i", coerce.relational_name(F.col("v")))) == ["plain", "", "false"]


def test_to_number_keeps_the_quirks(spark):
    df = variants(spark, "null", "false", '""', "0", "0.0", '"0"', "true", '"x"', '" 12 "', '"1_000"', '"1__0"', '"1d"', '"1e3"', "[]", "{}", "-3.5", '"-.5"', '"5."', '"nan"')
    got = values(df.select("i", coerce.to_number(F.col("v"))))
    assert got[:18] == [None, None, None, None, None, 0.0, 1.0, None, 12.0, 1000.0, None, None, 1000.0, None, None, -3.5, -0.5, 5.0]
    assert got[18] != got[18]


def test_money_rounds_the_binary_value(spark):
    rng = random.Random(7)
    numbers = [round(rng.uniform(-1e6, 1e6), rng.choice([1, 2, 3, 4])) for _ in range(4000)]
    numbers += [0.125, 0.375, 2.675, 1.005, 0.005, -0.015, 122.82000000000001, 1e-13, 1e9 + 0.125]
    df = variants(spark, *[repr(n) for n in numbers])
    got = values(df.select("i", coerce.money(F.col("v")).cast("double")))
    for n, g in zip(numbers, got):
        assert g == (round(n, 2) if n != 0 else None), n


def test_round_money_is_half_up(spark):
    df = spark.createDataFrame([(0, 0.1 + 0.2), (1, 122.82000000000001), (2, None), (3, 2.675), (4, -0.125)], "i INT, x DOUBLE")
    assert values(df.select("i", money.round_money(F.col("x")))) == [0.3, 122.82, None, 2.68, -0.13]


def test_localized_numbers(spark):
    cases = {"1,234.56": 1234.56, "1.234,56 €": 1234.56, "12,5": 12.5, "1,234": 1234.0, "1.234": 1.234, "5-": None, "1,234,56": None,
             "": None, None: None, "-3,20": -3.2, "1.234.567,8": 1234567.8, "USD 7": 7.0, "abc": None, "0,00": 0.0, "1,2,345": 12345.0}
    df = spark.createDataFrame(list(enumerate(cases)), "i INT, t STRING")
    assert values(df.select("i", coerce.parse_localized_number(F.col("t")))) == list(cases.values())


def test_year_only(spark):
    cases = {"2026-05-20": "2026", "20-05-2026": None, "202": None, "": None, None: None, "2026": "2026"}
    df = spark.createDataFrame(list(enumerate(cases)), "i INT, t STRING")
    assert values(df.select("i", coerce.year_only(F.col("t")))) == list(cases.values())


def test_approx_equal_is_inclusive(spark):
    df = spark.createDataFrame([(0, 1.0, 1.01), (1, 1.0, 1.02), (2, None, 1.0), (3, 1.0, None), (4, 5.0, 5.0)], "i INT, a DOUBLE, b DOUBLE")
    exact = df.select("i", money.approx_equal(F.col("a").cast("decimal(18,2)"), F.col("b").cast("decimal(18,2)")))
    assert values(exact) == [True, False, None, None, True]
    assert values(df.select("i", money.approx_equal_double(F.col("a"), F.col("b")))) == [True, False, None, None, True]


def test_pick_takes_the_first_present_key(spark):
    df = variants(spark, {"tax_amount_currency": None, "tax_amount": 2.0}, {"tax_amount_currency": False, "tax_amount": 2.0},
                  {"amount_tax": "3"}, {}, {"tax_amount_currency": 0, "amount_tax": 1})
    got = values(df.select("i", coerce.pick(F.col("v"), "tax_amount_currency", "tax_amount", "amount_tax").cast("double")))
    assert got == [2.0, None, 3.0, None, None]


def test_truthy(spark):
    df = variants(spark, "null", "false", '""', "0", "0.0", "[]", "{}", "true", '"x"', "2", "[0]", '{"a":null}')
    assert values(df.select("i", coerce.truthy(F.col("v")))) == [False] * 7 + [True] * 5


def test_float_text_is_the_shortest(spark):
    rng = random.Random(3)
    numbers = [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 14) for _ in range(3000)]
    numbers += [0.0, -0.0, 1.0, 1e16, 1.5e-5, 1e22, 0.0001, 123456789012345.6, 9999999999999998.0]
    df = spark.createDataFrame(list(enumerate(numbers)), "i INT, x DOUBLE")
    bad = [(n, t) for n, t in zip(numbers, values(df.select("i", money.float_text(F.col("x"))))) if float(t) != n]
    assert not bad
    plain = [n for n in numbers if 1e-3 <= abs(n) < 1e12]
    df = spark.createDataFrame(list(enumerate(plain)), "i INT, x DOUBLE")
    assert values(df.select("i", money.float_text(F.col("x")))) == [json.dumps(n) for n in plain]
    fixed = {0.0: "0.0", 1e16: "1e+16", 1.5e-05: "1.5e-05", 1e22: "1e+22", 0.0001: "0.0001", 10000000.0: "10000000.0"}
    df = spark.createDataFrame(list(enumerate(fixed)), "i INT, x DOUBLE")
    assert values(df.select("i", money.float_text(F.col("x")))) == list(fixed.values())


def test_json_string_is_ascii(spark):
    texts = ["abc", 'q"\\', "tab\t", "é", "日本", "😀x", "\x7f", "", None, " ", "\b\f\r\n\x01", "a😀é\"b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    assert values(df.select("i", jsontext.json_string(F.col("t")))) == [json.dumps(t) for t in texts]


def test_money_of_plain_text_is_read_as_it_stands(spark):
    rng = random.Random(3)
    texts = [f"{rng.randrange(10 ** rng.randrange(1, 13))}{rng.choice(['', '.5', '.05', '.99', '.125', '.'])}" for _ in range(400)]
    texts += ["0", "-0", "-0.00", "999999999999.99", "1234567890123.45", "12.345", "1_0.5", " 7.25 ", "1.5\n", "x", "", "1e2", "\u0661"]
    df = variants(spark, *[json.dumps(t) for t in texts])
    got = values(df.select("i", coerce.money(F.col("v"))))
    assert got == values(df.select("i", money.money_of_double(coerce.to_number(F.col("v")))))

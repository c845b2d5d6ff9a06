import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyveil.functions.surrogate import Surrogates
from tallyveil.operators import deid, integrity, lookup, matcher, redact
from tallyveil.schema import CHECKS, HEADER, LINE, METADATA

from .samples import values

DOCUMENT = f"k INT, metadata {METADATA.simpleString()}, invoice {HEADER.simpleString()}, lines ARRAY<{LINE.simpleString()}>, checks {CHECKS.simpleString()}"


def document(spark, *descriptions, customer="Harbor Mill", number="BIL/2031/00417"):
    d = Decimal
    lines = [(i, "Field Tent", text, 1.0, 100.0, [], d("100.00"), d("119.00"), None, "json-rpc", d("19.00")) for i, text in enumerate(descriptions)]
    n = len(lines)
    row = (1, ("tool", "1.0.0", "2026-05-29T00:00:00Z", "json-rpc", None, None, False, None), (number, customer, "2031-02-11", "posted", None, None, None, d("238.00"), "json-rpc"),
           lines, (n, d(19 * n), d(119 * n), None, None))
    return integrity.with_fingerprint(spark.createDataFrame([row], DOCUMENT))


NOTE = "Tent hired by Ira Moss, ira@moss.example.org"


def test_surrogates_equal_hmac(spark):
    texts = ["Harbor Mill", "é", "", "日本", "(unknown)", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for salt in ("k", "", "é-salt", "x" * 64, "x" * 80):
        want = [t if t is None else "CUST-" + hmac.new(salt.encode(), t.encode(), hashlib.sha256).hexdigest()[:12] for t in texts]
        assert values(df.select("i", Surrogates(spark, salt).of(F.col("t"), "CUST"))) == want


def test_identifiers_go_and_the_rest_stays(spark):
    source = document(spark, NOTE, None, "")
    out = deid.deidentify(source, Surrogates(spark, "one-salt")).first()
    assert out.invoice.customer.startswith("CUST-") and out.invoice.invoice_number.startswith("INV-") and out.invoice.invoice_date == "2031"
    assert out.metadata.deidentified and out.lines[0].product == "Field Tent"
    assert [l.description for l in out.lines] == ["Tent hired by Ira Moss, [REDACTED:EMAIL]", None, ""]
    assert source.first().invoice.customer == "Harbor Mill" and out.checks == source.first().checks


def test_salts(spark):
    keys = lambda salt: deid.deidentify(document(spark, NOTE), Surrogates(spark, salt)).first().invoice.customer
    assert keys("a") == keys("a") and keys("b") != keys("c")


def test_a_new_fingerprint_verifies(spark):
    source = document(spark, NOTE)
    out = deid.deidentify(source, Surrogates(spark, "k"))
    assert out.first().metadata.integrity_sha256 != source.first().metadata.integrity_sha256
    checked = integrity.verify_documents(out).first()
    assert checked.sha_ok
    assert deid.deidentify(document(spark, NOTE, number=None), Surrogates(spark, "k")).first().invoice.invoice_number is None


def sweep_by_own_tokens(spark, docs, names, min_len=3):
    """The stated rule: every token of the invoice, then the patterns, description by description."""
    from tallyveil.functions.patterns import redact_patterns, redact_row_tokens

    found = deid.invoice_tokens(docs, "k", names, min_len).groupBy("k").agg(F.collect_list("token").alias("tokens"))
    rows = docs.select("k", F.posexplode("lines.description").alias("i", "t")).join(found, "k")
    return values(rows.select("i", redact_patterns(redact_row_tokens(F.col("t"), F.col("tokens")))))


@pytest.mark.parametrize("min_len", [1, 3, 12])
def test_own_descriptions_are_masked_as_the_rule_says(spark, min_len):
    texts = ["Field Tent, green", "  large tent\t", "ab", " x ", "a@b.co.uk", "for Harbor Mill", "Tent\nfor two", "ab\u00a0", "1.2.3.4", "日本"]
    docs = document(spark, *texts)
    out = deid.deidentify_lines(docs, own_tokens=True, min_len=min_len)
    got = [l.description for l in out.first().lines]
    assert got == sweep_by_own_tokens(spark, docs, ["Harbor Mill", "Orchard"], min_len)


def test_deny_list_sweeps_agree(spark):
    docs = document(spark, NOTE, "ira moss", None, "")
    few = spark.createDataFrame([("Ira Moss",)], "token STRING")
    many = few.unionByName(spark.createDataFrame([(f"name {i}",) for i in range(100)], "token STRING"))
    for deny in (few, many):
        for key in ("k", None):
            out = deid.deidentify_lines(docs, deny, key=key)
            assert out.columns == docs.columns
            assert [l.description for l in out.first().lines] == ["Tent hired by [REDACTED:PHI], [REDACTED:EMAIL]", "[REDACTED:PHI]", None, ""]


def test_own_tokens_and_a_deny_list_together(spark):
    docs = document(spark, "a longer text", "by Al", "b@c.de", None)
    out = deid.deidentify_lines(docs, spark.createDataFrame([("al",)], "token STRING"), own_tokens=True, min_len=9).first()
    assert [l.description for l in out.lines] == ["[REDACTED:PHI]", "by [REDACTED:PHI]", "[REDACTED:EMAIL]", None]


def test_names_do_not_stand_in_the_plan(spark):
    tokens = deid.invoice_tokens(document(spark, "x"), "k", ["Very Secret Name"])
    assert "Very Secret Name" in {r.token for r in tokens.collect()}
    assert "Very Secret" not in tokens._jdf.queryExecution().toString()


def test_the_salt_does_not_stand_in_the_plan(spark):
    salt = "very-secret-salt"
    out = deid.deidentify(document(spark, NOTE), Surrogates(spark, salt))
    out.collect()
    text = out._jdf.queryExecution().toString()
    inner = bytes(b ^ 0x36 for b in salt.encode()).hex()
    outer = bytes(b ^ 0x5C for b in salt.encode()).hex()
    for secret in (salt, salt.encode().hex(), inner, outer):
        assert secret.lower() not in text.lower()


def test_join_needs_the_same_salt(spark):
    people = spark.createDataFrame([("Ann", 1), ("Bob", 2)], "name STRING, n INT")
    side = lambda salt, salt_id: people.select(Surrogates(spark, salt, salt_id).column(F.col("name"), "CUST", "who"), "n")
    joined = lookup.join_on_surrogate(side("a", "2026"), side("a", "2026").withColumnRenamed("n", "m"), "who")
    assert sorted((r.n, r.m) for r in joined.collect()) == [(1, 1), (2, 2)]
    for other in (side("b", "2027"), people.withColumnRenamed("name", "who")):
        with pytest.raises(ValueError):
            lookup.join_on_surrogate(side("a", "2026"), other, "who")


def test_collisions(spark):
    df = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s1", "b"), ("s2", "c")], "s STRING, o STRING")
    assert [tuple(r) for r in deid.surrogate_collisions(df, "s", "o").collect()] == [("s1", 2)]


@pytest.fixture
def long_lists(monkeypatch):
    """Deny-lists of more than ten tokens pass the bounds; ``held`` tokens of such a list go to the tasks at most."""
    def bound(held):
        monkeypatch.setattr(redact, "SMALL_ROWS", 10)
        monkeypatch.setattr(matcher, "SMALL_ROWS", held)
        monkeypatch.setattr(matcher, "is_small", lambda df: False)
    return bound


def odd_documents(spark):
    """Documents of null and repeated keys, without lines, with null and empty descriptions."""
    one = [(None, "ask IRA MOSS"), (1, "ira moss, a@b.co.uk"), (1, "ira moss, a@b.co.uk"), (2, None), (3, ""), (4, "10.0.0.1 and Al Ma")]
    rows = [(k, [(0, t), (1, t)]) for k, t in one] + [(5, []), (6, None)]
    return spark.createDataFrame(rows, "k INT, lines ARRAY<STRUCT<line_index: INT, description: STRING>>")


SWEPT = sorted([
    ("None", ["ask [REDACTED:PHI]"] * 2), ("1", ["[REDACTED:PHI], [REDACTED:EMAIL]"] * 2), ("1", ["[REDACTED:PHI], [REDACTED:EMAIL]"] * 2),
    ("2", [None] * 2), ("3", [""] * 2), ("4", ["[REDACTED:IP] and [REDACTED:PHI]"] * 2), ("5", []), ("6", None)], key=str)


@pytest.mark.parametrize("held", [10, 1])
def test_a_long_deny_list_sweeps_lines_where_they_lie(spark, long_lists, held):
    """Two of its tokens stand in the texts: where they may go to the tasks, documents are not joined by key."""
    deny = spark.createDataFrame([("Ira Moss",), ("al ma",), *[(f"name {i}",) for i in range(100)]], "token STRING")
    long_lists(held)
    out = deid.deidentify_lines(odd_documents(spark), deny, key="k")
    assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == (held == 1)
    assert sorted(((str(r.k), r.lines and [l.description for l in r.lines] if r.lines is not None else None) for r in out.collect()), key=str) == SWEPT
    flat = out.select(F.explode("lines").alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert held == 1 or flat.count("cover(") == 1


def test_tokens_found_do_not_stand_in_the_plan(spark, long_lists):
    long_lists(10)
    deny = spark.createDataFrame([("Ira Moss",), *[(f"name {i}",) for i in range(100)]], "token STRING")
    out = deid.deidentify_lines(odd_documents(spark).filter("k > 1"), deny, key="k")
    assert "ira moss" not in out._jdf.queryExecution().toString().lower()


def test_each_pattern_on_arrays_as_on_columns(spark):
    from tallyveil.functions.patterns import redact_each, redact_patterns

    texts = ["a@b.co.uk INV/2026/00001", "123-45-6789", "4316522678525456", "10.0.0.1 https://x.y/z", "+1 415 555 0123 (212) 555 0100", "", None, "plain"]
    df = spark.createDataFrame([(texts,), (None,), ([],)], "a ARRAY<STRING>")
    for allow in (None, ["10.0.0.1", ""]):
        rows = df.select(redact_each(F.col("a"), allow).alias("x"), F.transform("a", lambda t: redact_patterns(t, allow)).alias("y")).collect()
        assert [r.x for r in rows] == [r.y for r in rows] and rows[1].x is None and rows[2].x == []


def test_hits_are_counted_before_they_are_confirmed(spark, long_lists):
    long_lists(10)
    texts = spark.createDataFrame([("ira moss and ann",), ("IRA MOSS",), (None,)], "t STRING")
    found = matcher.matched_tokens(texts, "t", spark.createDataFrame([("Ira Moss",), ("bo",)], "token STRING"), F.count("*"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("count(1)") and "count(1)" not in plan[: plan.index("Join LeftSemi")]
    assert [tuple(r) for r in found.collect()] == [("ira moss", 2)]

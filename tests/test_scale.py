import os

import pytest
from pyspark.sql import functions as F

from tallyveil.functions.money import let
from tallyveil.operators import extract, redact
from tallyveil.plans import extraction, scale
from tallyveil.sources import capture as exchanges

from .samples import MOVE, captured, exchange, shared_names


def plan(df):
    return df._jdf.queryExecution().toString().split("== Optimized Logical Plan ==")[1]


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "capture")
    captured(spark, *[exchange(i, "read", {"result": [MOVE]}) for i in range(8)]).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_size_checks(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("token"))
    assert scale.is_small(df) and not scale.is_small(df, max_rows=99) and not scale.is_small(df, max_bytes=10)
    assert "ResolvedHint" in scale.broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert scale.measure(df.limit(0)) == (0, 0)


def test_answers_are_parsed_once(stored):
    ok, _ = exchanges.split_errors(exchanges.moves_from_result(exchanges.result_of(exchanges.move_reads(stored))))
    optimized = plan(ok.select("seq", "move")).split("== Physical Plan ==")[0]
    assert optimized.count("parseJson(response") == 1
    plain = exchanges.with_reject_reason(exchanges.moves_from_result(exchanges.result_of(exchanges.move_reads(stored))))
    assert plan(plain.filter("reject_reason IS NULL").select("seq", "move")).split("== Physical Plan ==")[0].count("parseJson(response") > 1


def test_lines_are_made_once_when_inlined(stored):
    done = extract.extract_lines(exchanges.moves_from_result(exchanges.result_of(exchanges.move_reads(stored))))
    flat = extract.explode_lines(done, "seq")
    made = lambda df: plan(df).split("== Physical Plan ==")[0].count("StructField(price_subtotal")
    assert made(flat) == made(done.select("lines")) < made(done.select(F.inline("lines")))
    assert flat.count() == 24


def test_filters_and_columns_reach_the_files(stored):
    reads = exchanges.move_reads(stored).select("seq")
    text = plan(reads)
    assert "StringContains(url,/web/dataset/call_kw)" in text
    assert "ReadSchema: struct<seq:bigint,url:string,request:string>" in text


def test_few_files_are_dealt_out(spark, stored):
    assert scale.spread(stored).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(64).repartition(8).withColumn("x", F.lit(1))
    many.write.mode("overwrite").parquet(f"{stored.inputFiles()[0].rsplit('/', 2)[0]}/many")
    back = spark.read.parquet(f"{stored.inputFiles()[0].rsplit('/', 2)[0]}/many")
    assert scale.spread(back) is back


def test_written_tables_start_from_files(spark):
    df = scale.written(spark.range(3), "numbers")
    assert "FileScan parquet" in plan(df) and df.count() == 3


def test_written_tables_are_packed_tightly(spark):
    table = scale.written(spark.range(10), "packed")
    assert all(f.endswith(".zstd.parquet") for f in table.inputFiles())


def test_one_pass_serves_every_output(spark, stored, tmp_path):
    """Documents, rejects, codes and what waits come from one reading of the capture."""
    def seen(batches):
        for batch in batches:
            with open(tmp_path / "seen", "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    rows = stored.unionByName(captured(spark, exchange(90, "read", {"error": 1}), exchange(91, "search_read", {"result": []}), exchange(92, "write", {})))
    done = extraction.extract_documents(rows.mapInArrow(seen, rows.schema), extraction.RunInfo(extracted_at="t"))
    assert done.documents.count() == 8 and [r.seq for r in done.rejects.collect()] == [90] and done.unresolved.count() == 8
    assert sum(map(int, open(tmp_path / "seen"))) == rows.count() == 11


def test_tagging_parses_once_and_moves_nothing(stored):
    for mode in ("first", "all"):
        logical, physical = plan(extraction.tagged_records(stored, mode)).split("== Physical Plan ==")
        assert logical.count("parseJson(response") == logical.count("parseJson(request") == 1
        assert logical.count("StructField(price_subtotal") == 1 and "Exchange" not in physical


def test_tagging_reads_items_where_they_lie(stored):
    """A list of items is read into its fields by one step, and no value bound by ``let`` is an element of an array."""
    for mode in ("first", "all"):
        logical = plan(extraction.tagged_records(stored, mode)).split("== Physical Plan ==")[0]
        assert logical.count("ArrayType(StructType(StructField(display_type") == 1
        assert logical.count("transform(") < 10 and "get(transform" not in str(let(F.col("x"), lambda x: x + x))


def test_numbers_within_hot_and_missing_keys(spark, monkeypatch):
    """A key with most of the rows lies in several tasks, and its numbers have no gap."""
    rows = [(("hot" if i % 3 else None) if i % 10 else f"k{i % 70}", i * 7919 % 4001, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k STRING, x INT, i INT").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    real, kept = scale.written, []
    monkeypatch.setattr(scale, "written", lambda *a: kept.append(real(*a)) or kept[-1])
    try:
        got = scale.numbered_within(df, "k", ["x", "i"], "n")
        tasks = kept[0].filter("k = 'hot'").select("__task").distinct().count()
        found = sorted((r.k or "", r.n, r.i) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want, seen = [], {}
    for k, x, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want.append((k or "", seen.setdefault(k, 0), i))
        seen[k] += 1
    assert found == want and got.columns == ["k", "x", "i", "n"] and tasks > 1
    assert scale.numbered_within(df.limit(0), "k", ["x"], "n").count() == 0


def test_intermediate_tables_go_with_the_work(spark):
    before = shared_names(spark)
    with scale.intermediates_removed(spark):
        assert scale.own_key(spark.range(10).toDF("x")).count() == 10
        with scale.intermediates_removed(spark):
            inner = scale.own_key(spark.range(3).toDF("x"))
            assert os.listdir(inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
            inner.count()
        assert shared_names(spark) != before
    with pytest.raises(ZeroDivisionError), scale.intermediates_removed(spark):
        scale.own_key(spark.range(10).toDF("x"))
        raise ZeroDivisionError
    assert shared_names(spark) == before


def test_no_plain_text_stays_after_masking(spark, monkeypatch):
    monkeypatch.setattr(redact, "measure", lambda df: (1 << 40, 1 << 40))
    monkeypatch.setattr(redact.matcher, "is_small", lambda df: False)
    monkeypatch.setattr(redact.matcher, "FILTER_TOKENS", 4)
    before = shared_names(spark)
    texts = spark.createDataFrame([(i, f"for Customer {i}") for i in range(20)], "i INT, text STRING")
    deny = spark.createDataFrame([(f"Customer {i}",) for i in range(10, 20)], "token STRING")
    with scale.intermediates_removed(spark):
        got = {r.i: r.text for r in redact.redact_tokens(texts, "text", deny).collect()}
        assert shared_names(spark) != before
    assert got[3] == "for Customer 3" and "Customer" not in got[13]
    assert shared_names(spark) == before


def test_tables_of_few_parts_are_written_unsorted(spark, stored, monkeypatch):
    """A task keeps a file for each outcome and reads small splits; the session's settings come back."""
    names = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.files.maxPartitionBytes")
    settings = lambda: [spark.conf.get(name) for name in names]
    before, seen, write = settings(), [], type(stored.write).parquet
    monkeypatch.setattr(type(stored.write), "parquet", lambda *a, **k: (seen.append(settings()), write(*a, **k)))
    extraction.read_once(stored)
    rows = scale.written(spark.range(100).withColumn("p", F.col("id") % 12), "many", ["p"])
    assert seen == [[str(scale.PARTS), f"{scale.SPLIT}b"], [str(scale.PARTS), before[1]]] and settings() == before
    assert {(r.p, r.n) for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()} == {(p, 9 if p < 4 else 8) for p in range(12)}

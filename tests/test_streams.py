import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyveil.operators import redact
from tallyveil.plans.extraction import RunInfo, extract_documents
from tallyveil.sources import html, versions
from tallyveil.streaming import jobs, waiting

from .samples import EUR_ID, MOVE, SEARCH, captured, exchange, shared_names

LOGS = "i INT, msg STRING, args ARRAY<STRING>, exc_text STRING, stack_info STRING"
MASK = "[REDACTED:PHI]"


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_logs_are_clean_before_the_sink(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    add(spark.createDataFrame([(1, "for %s", ["Harbor Mill"], None, "a@b.co")], LOGS), source)
    deny = spark.createDataFrame([("Harbor Mill",)], "token STRING")
    stream = lambda: spark.readStream.schema(LOGS).parquet(source)
    done(jobs.scrub_stream(stream(), out, progress, deny))
    add(spark.createDataFrame([(2, "100%", [], "Harbor Mill", None)], LOGS), source)
    done(jobs.scrub_stream(stream(), out, progress, deny))
    got = {r.i: r for r in spark.read.parquet(out).collect()}
    assert got[1].msg == f"for {MASK}" and got[1].stack_info == "[REDACTED:EMAIL]" and got[1].args == []
    assert got[2].msg == "100%" and got[2].exc_text == MASK and len(got) == 2


def test_logs_with_a_deny_list_that_is_joined(spark, tmp_path, monkeypatch):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    add(spark.createDataFrame([(i, "for %s", [f"Customer {i}"], None, None) for i in range(20)], LOGS), source)
    deny = spark.createDataFrame([(f"customer {i}",) for i in range(10)], "token STRING")
    done(jobs.scrub_stream(spark.readStream.schema(LOGS).parquet(source), out, progress, deny))
    # The list outgrows the bound between two starts; readers find the rows of both.
    add(spark.createDataFrame([(i, "for %s", [f"Customer {i}"], None, None) for i in range(20, 40)], LOGS), source)
    monkeypatch.setattr(redact, "measure", lambda df: (1 << 40, 1 << 40))
    more = deny.unionByName(spark.createDataFrame([("customer 33",)], "token STRING"))
    done(jobs.scrub_stream(spark.readStream.schema(LOGS).parquet(source), out, progress, more))
    got = {r.i: r.msg for r in spark.read.parquet(out).collect()}
    assert len(got) == 40 and got[3] == f"for {MASK}" and got[12] == f"for {MASK}2" and got[33] == f"for {MASK}"


def test_a_stream_takes_the_callers_trigger(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    add(spark.createDataFrame([(1, "a@b.co", [], None, None)], LOGS), source)
    running = jobs.scrub_stream(spark.readStream.schema(LOGS).parquet(source), out, progress, trigger={"processingTime": "1 second"})
    try:
        running.processAllAvailable()
        assert running.isActive and spark.read.parquet(out).first().msg == "[REDACTED:EMAIL]"
    finally:
        running.stop()


def test_currencies_follow_the_capture_not_the_arrival(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    code = lambda text: {"records": [{"currency_id": {"id": EUR_ID, "display_name": text}}]}
    for batch in ([exchange(5, "search_read", {"result": code("new")})], [exchange(2, "search_read", {"result": code("old")}), exchange(3, "search_read", "{")]):
        add(captured(spark, *batch), source)
        stream = spark.readStream.schema(captured(spark, *batch).schema).parquet(source)
        done(jobs.start_currency_stream(stream, out, progress))
    assert [tuple(r) for r in jobs.current_codes(spark, out).collect()] == [(EUR_ID, "new")]


def test_tokens_registered_later_apply_later(spark, tmp_path):
    source, deny, out, progress = (str(tmp_path / n) for n in ("in", "deny", "out", "progress"))
    schema = "i INT, kind STRING, t STRING"
    tokens = lambda batch: batch.filter("kind = 'token'").select(F.col("t").alias("token"))
    for rows in ([(1, "log", "Ann and Bob")], [(2, "token", "Ann"), (3, "log", "Ann and Bob")], [(4, "token", "Bob"), (5, "log", "ann and BOB")]):
        add(spark.createDataFrame(rows, schema), source)
        stream = spark.readStream.schema(schema).parquet(source)
        done(jobs.scrub_with_growing_list(stream, tokens, deny, out, progress, ["t"]))
    got = {r.i: r.t for r in spark.read.parquet(out).collect()}
    assert (got[1], got[3], got[5]) == ("Ann and Bob", f"{MASK} and Bob", f"{MASK} and {MASK}")


def test_documents_wait_for_their_currency(spark, tmp_path):
    """Whatever the cut into batches, the documents are those of the batch form."""
    bare = dict(MOVE, invoice_line_ids=[dict(l, currency_id=False) for l in MOVE["invoice_line_ids"]])
    never = dict(bare, currency_id={"id": 999})
    rows = [exchange(1, "read", {"result": bare}), exchange(2, "read", {"error": 1}), exchange(3, "search_read", {"result": SEARCH}),
            exchange(4, "read", {"result": bare}), exchange(5, "read", {"result": never})]
    whole = extract_documents(captured(spark, *rows), RunInfo(extracted_at="t"))
    want = {r.seq: (r.invoice.currency, r.lines[0].currency) for r in whole.documents.collect()}
    assert want == {1: ("EUR", "EUR"), 4: ("EUR", "EUR"), 5: (None, None)}
    for name, cuts in (("one", [rows]), ("two", [rows[:2], rows[2:]]), ("each", [[r] for r in (rows[4], *rows[:4])])):
        source, out, codes, progress = (str(tmp_path / name / n) for n in ("in", "out", "codes", "progress"))
        shared = shared_names(spark)
        for batch in cuts:
            add(captured(spark, *batch), source)
            stream = spark.readStream.schema(captured(spark, *batch).schema).parquet(source)
            done(jobs.extract_stream(stream, out, codes, progress, RunInfo(extracted_at="t")))
        assert shared_names(spark) == shared
        got = [(r.seq, (r.invoice.currency, r.lines[0].currency)) for r in jobs.extracted_documents(spark, out).collect()]
        assert dict(got) == want and len(got) == 3
        assert [r.seq for r in spark.read.parquet(f"{out}/rejects").collect()] == [2]
        assert len([p for p in (tmp_path / name / "codes").iterdir() if p.name.startswith("slot=")]) <= 2


@pytest.mark.parametrize("cuts", [[5], [2, 3], [1, 1, 1, 1, 1]])
def test_keyed_waiting_equals_the_batch_form(spark, tmp_path, cuts, monkeypatch):
    bare = dict(MOVE, invoice_line_ids=[dict(l, currency_id=False) for l in MOVE["invoice_line_ids"]])
    never = dict(bare, currency_id={"id": 999})
    rows = [exchange(5, "read", {"result": never}), exchange(1, "read", {"result": bare}), exchange(2, "read", {"error": 1}),
            exchange(3, "search_read", {"result": SEARCH}), exchange(4, "read", {"result": bare})]
    whole = extract_documents(captured(spark, *rows), RunInfo(extracted_at="t"))
    want = sorted(map(str, whole.documents.filter("seq <> 5").collect()))
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for n in cuts:
        batch, rows = rows[:n], rows[n:]
        add(captured(spark, *batch), source)
        stream = spark.readStream.schema(captured(spark, *batch).schema).parquet(source)
        done(waiting.extract_keyed_stream(stream, out, progress, RunInfo(extracted_at="t"), salts=2))
    # What no search names waits, and is written by no batch.
    assert sorted(map(str, waiting.keyed_documents(spark, out).collect())) == want
    assert [r.seq for r in versions.committed(spark, f"{out}/rejects").collect()] == [2]


class Store(dict):
    """A map state, and a count of what is read and written."""

    work = 0

    def containsKey(self, key):
        Store.work += 1
        return key in self

    getValue = dict.__getitem__

    def updateValue(self, key, value):
        Store.work += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        Store.work += len(self)
        return iter(list(self.items()))


def test_a_batch_does_not_touch_what_waits(monkeypatch):
    """With ten thousand waiting records, a batch works as with ten, until a code that was unknown comes."""
    def frame(*rows):
        return iter([pd.DataFrame(rows, columns=["seq", "record_pos", "record", "asks", "codes"])])

    def code(seq, currency, name):
        return (seq, 0, None, None, json.dumps([{"pos": 0, "currency_id": currency, "code": name}]))

    costs = []
    for n in (10, 10_000):
        keyed = waiting.WaitingRecords(None)
        keyed.codes, keyed.records = Store({(1,): ("EUR", 5, 0)}), Store({(i, 0): (f"r{i}", "[7]", 0) for i in range(n)})
        Store.work = 0
        rows = [(90_000, 0, "a", "[1]", None), (90_001, 0, "b", "[]", None), (90_002, 0, "c", "[7, 1]", None), code(4, 1, "OLD"), code(6, 1, "EUX")]
        out = [tuple(r) for f in keyed.handleInputRows(None, frame(*rows), None) for r in f.itertuples(index=False)]
        costs.append(Store.work)
        assert out == [("a", '[{"currency_id": 1, "code": "EUX"}]'), ("b", "[]")]
        monkeypatch.setattr(waiting, "HELD", 4)
        late = [tuple(r) for f in keyed.handleInputRows(None, frame(code(9, 7, "SEK"), *[(91_000 + i, 0, "d", "[7]", None) for i in range(9)]), None) for r in f.itertuples(index=False)]
        monkeypatch.undo()
        assert len(late) == n + 1 + 9 and not keyed.records
    assert costs[0] == costs[1]


def test_a_new_checkpoint_adds_to_what_is_there(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, progress in enumerate(("first", "second")):
        add(spark.createDataFrame([(i, f"record {i}", [], None, None)], LOGS), f"{source}{i}")
        stream = spark.readStream.schema(LOGS).parquet(f"{source}{i}")
        done(jobs.scrub_stream(stream, out, str(tmp_path / progress)))
    assert sorted(r.i for r in versions.committed(spark, out).collect()) == [0, 1]
    assert sorted(r.i for r in spark.read.parquet(out).collect()) == [0, 1]


def test_readers_see_whole_commits_only(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "i INT")
    versions.commit(rows(1, 2), out, "a", 0)
    # An attempt that was stopped half way left rows; they are no commit, and the next attempt replaces them.
    rows(77).write.parquet(f"{out}/run=a/batch=1")
    assert sorted(r.i for r in versions.committed(spark, out).collect()) == [1, 2]
    versions.commit(rows(3), out, "a", 1)
    versions.commit(rows(99), out, "a", 1)
    versions.commit(rows(), out, "b", 0)
    assert sorted(r.i for r in versions.committed(spark, out).collect()) == [1, 2, 3]
    assert versions.newest(spark, out).count() == 0 and versions.before(spark, out, "b", 0).count() == 1
    assert versions.before(spark, str(tmp_path / "none"), "a", 0) is None
    for n in range(2, 6):
        versions.commit(rows(n), out, "a", n)
        versions.keep_newest(spark, out, "a", n)
    assert not versions.exists(spark, f"{out}/run=a/batch=2") and versions.newest(spark, out).first().i == 5


def test_a_new_checkpoint_takes_over_what_waits(spark, tmp_path):
    out, codes = str(tmp_path / "out"), str(tmp_path / "codes")
    bare = dict(MOVE, invoice_line_ids=[dict(l, currency_id=False) for l in MOVE["invoice_line_ids"]])
    for i, rows in enumerate(([exchange(1, "read", {"result": bare})], [exchange(2, "search_read", {"result": SEARCH})])):
        add(captured(spark, *rows), str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(captured(spark, *rows).schema).parquet(str(tmp_path / f"in{i}"))
        done(jobs.extract_stream(stream, out, codes, str(tmp_path / f"progress{i}"), RunInfo(extracted_at="t")))
        got = [(r.seq, r.invoice.currency) for r in jobs.extracted_documents(spark, out).collect()]
        assert got == [(1, "EUR" if i else None)]


@pytest.mark.parametrize("start", [jobs.extract_stream, waiting.extract_keyed_stream])
def test_a_batch_reads_the_pages_it_asks_for_once(spark, tmp_path, monkeypatch, start):
    read, lines_from_html = [], html.lines_from_html
    monkeypatch.setattr(html, "lines_from_html", lambda pages: (read.append(pages.count()), lines_from_html(pages))[1])
    page = "<tr class='o_data_row'><td name='product_id'>a</td><td name='quantity'>2</td></tr>"
    pages = spark.createDataFrame([(i, page) for i in range(1, 9)], "seq BIGINT, html STRING")
    bare = dict(MOVE, invoice_line_ids=[1, 2], currency_id=[EUR_ID, "EUR"])
    rows = [exchange(1, "read", {"result": bare}), exchange(2, "read", {"result": MOVE | {"currency_id": [EUR_ID, "EUR"]}}),
            exchange(3, "search_read", {"result": SEARCH}), exchange(5, "read", {"result": bare}), exchange(9, "read", {"result": bare})]
    source, out, codes, progress = (str(tmp_path / n) for n in ("in", "out", "codes", "progress"))
    add(captured(spark, *rows), source)
    stream = spark.readStream.schema(captured(spark, *rows).schema).parquet(source)
    named = {"codes_path": codes} if start is jobs.extract_stream else {"salts": 2}
    done(start(stream, out, checkpoint=progress, run_info=RunInfo(extracted_at="t"), pages=pages, **named))
    documents = versions.committed(spark, f"{out}/documents")
    assert {r.seq: (r.metadata.source, len(r.lines)) for r in documents.collect() if r.seq != 2} == {i: ("dom-fallback", 1) for i in (1, 5)}
    assert [(r.seq, r.reject_reason) for r in versions.committed(spark, f"{out}/rejects").collect()] == [(9, "no lines")]
    assert read == [2]

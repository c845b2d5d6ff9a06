"""Documents that wait in keyed state for the codes of their currencies.

The capture is read and parsed once, as a stream. Each record goes to one of SALTS keys, so no currency gathers its
documents in one task; the few codes of a search go to every key. The state of a key holds its codes and the records that
still ask for one: a batch reads and writes what arrived and what it releases, however many batches or waiting records there
are, and nothing is rewritten. A record leaves with the codes it asked for, those of the latest place in the capture; with
``patience`` it leaves after that time without the codes that no search has named.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyveil import schema
from tallyveil.operators import lookup
from tallyveil.plans.extraction import BARE, CODES, DOCUMENT, RunInfo, documents_of, pages_of, tagged_records
from tallyveil.plans.scale import written
from tallyveil.sources import versions
from tallyveil.streaming.jobs import AT_ONCE, start_batches

SALTS = 16
#: Records of a key that a batch holds in memory; further ones go through the state.
HELD = 5_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "record string, codes string"
_KNOWN = "array<struct<currency_id:bigint,code:string>>"

#: A tagged record as it waits, without the codes of a search.
RECORD = T.StructType([
    T.StructField("outcome", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("record_pos", T.IntegerType()),
    T.StructField("url", T.StringType()), T.StructField("invoice", schema.HEADER), T.StructField("invoice_currency_id", T.LongType()),
    T.StructField("lines", T.ArrayType(schema.RAW_LINE)), T.StructField("reject_reason", T.StringType()),
])


class WaitingRecords(StatefulProcessor):
    """The codes of a key, and its records that ask for one that is not known yet."""

    def __init__(self, patience: int | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.codes = handle.getMapState("codes", "currency_id long", "code string, seq long, pos long")
        self.records = handle.getMapState("records", "seq long, record_pos long", "record string, asks string, since long")

    def _learn(self, seen: dict) -> set:
        """Take over the latest codes; the currencies that had none before."""
        new = set()
        for currency, (seq, pos, code) in seen.items():
            old = self.codes.getValue((currency,)) if self.codes.containsKey((currency,)) else None
            if old is None:
                new.add(currency)
            if old is None or (seq, pos) > (old[1], old[2]):
                self.codes.updateValue((currency,), (code, seq, pos))
        return new

    def _known(self, cache: dict, currency: int):
        if currency not in cache:
            cache[currency] = self.codes.getValue((currency,))[0] if self.codes.containsKey((currency,)) else None
        return cache[currency]

    def _released(self, cache: dict, record: str, asks: list) -> tuple:
        known = [{"currency_id": a, "code": self._known(cache, a)} for a in asks]
        return record, json.dumps([k for k in known if k["code"] is not None])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else 0
        seen, fresh, spilled = {}, [], False
        for frame in rows:
            for seq, pos, record, asks, codes in zip(frame["seq"], frame["record_pos"], frame["record"], frame["asks"], frame["codes"]):
                if record is None:
                    for c in json.loads(codes):
                        place = (int(seq), c["pos"], c["code"])
                        if place > seen.get(c["currency_id"], (-1,)):
                            seen[c["currency_id"]] = place
                elif len(fresh) < HELD:
                    fresh.append((int(seq), int(pos), record, asks))
                else:
                    self.records.updateValue((int(seq), int(pos)), (record, asks, now))
                    spilled = True
        new, cache, out, kept = self._learn(seen), {}, [], False
        for seq, pos, record, asks in fresh:
            wanted = json.loads(asks)
            if all(self._known(cache, a) is not None for a in wanted):
                out.append(self._released(cache, record, wanted))
            else:
                self.records.updateValue((seq, pos), (record, asks, now))
                kept = True
        yield pd.DataFrame(out, columns=["record", "codes"], dtype=object)
        if (kept or spilled) and self.patience is not None:
            self.handle.registerTimer(now + self.patience)
        if new or spilled:
            # Only a currency without a code before, or an overflow, is a reason to look through what waits.
            yield from self._leaving(cache, lambda asks, since: all(self._known(cache, a) is not None for a in asks))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._leaving({}, lambda asks, since: since + self.patience <= now)

    def _leaving(self, cache: dict, free) -> Iterator[pd.DataFrame]:
        gone, out = [], []
        for key, (record, asks, since) in self.records.iterator():
            wanted = json.loads(asks)
            if free(wanted, since):
                gone.append(key)
                out.append((record, wanted))
            if len(out) >= HELD:
                yield pd.DataFrame([self._released(cache, *o) for o in out], columns=["record", "codes"], dtype=object)
                out = []
        for key in gone:
            self.records.removeKey(tuple(key))
        yield pd.DataFrame([self._released(cache, *o) for o in out], columns=["record", "codes"], dtype=object)

    def close(self) -> None:
        pass


def released_records(capture: DataFrame, patience: int | None = None, salts: int = SALTS) -> DataFrame:
    """(record, codes) of a capture stream: records as JSON, as soon as every code they ask for is known."""
    tagged = tagged_records(capture)
    is_codes = F.col("outcome") == CODES
    whole = F.col("outcome").isin(DOCUMENT, BARE)
    asks = F.when(whole, lookup.asked_currencies()).otherwise(F.array().cast("array<bigint>"))
    own = F.pmod(F.xxhash64("seq", "record_pos"), F.lit(salts)).cast("int")
    rows = tagged.filter(~is_codes | (F.size("codes") > 0)).select(
        "seq", F.col("record_pos").cast("bigint").alias("record_pos"),
        F.when(~is_codes, F.to_json(F.struct(*RECORD.fieldNames()))).alias("record"),
        F.to_json(asks).alias("asks"), F.to_json("codes").alias("codes"),
        F.explode(F.when(is_codes, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(own))).alias("salt"),
    )
    mode = "none" if patience is None else "processingTime"
    return rows.groupBy("salt").transformWithStateInPandas(WaitingRecords(patience), _OUT, "append", mode)


def extract_keyed_stream(
    capture: DataFrame, out: str, checkpoint: str, run_info: RunInfo, pages: DataFrame | None = None, patience: int | None = None,
    trigger: dict | None = None, salts: int = SALTS,
) -> StreamingQuery:
    """Documents out of a capture stream, each written once, when the codes it asks for are known.

    ``patience`` is in milliseconds; without it a document waits for as long as a code is missing. With it the default
    trigger is one batch, in which also ends what has waited long enough before it.
    ``salts`` stays the same over restarts: about as many as there are cores. Documents and rejects are commits below ``out`` (see ``sources.versions``).
    ``pages`` has (seq, html), of which a batch reads those that it asks for, or (seq, dom_lines).
    """
    spark = capture.sparkSession

    def work(batch: DataFrame, run: str, batch_id: int) -> None:
        # Written first: what is read again must not run the stateful step again.
        rows = written(batch, "released")
        tagged = written(rows.select(F.from_json("record", RECORD).alias("r")).select("r.*"), "tagged", ["outcome"])
        known = rows.select(F.explode(F.from_json("codes", _KNOWN)).alias("c")).select("c.*").distinct()
        done = documents_of(tagged, run_info, pages_of(tagged, pages), known)
        versions.commit(done.documents, f"{out}/documents", run, batch_id)
        versions.commit(done.rejects, f"{out}/rejects", run, batch_id)

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        # With timers a stream that works off what there is finds no end; it takes one batch instead.
        trigger = trigger or (AT_ONCE if patience is None else {"once": True})
        return start_batches(released_records(capture, patience, salts), work, checkpoint, trigger)
    finally:
        spark.conf.set(_STORE, before)


def keyed_documents(spark: SparkSession, out: str) -> DataFrame:
    """All documents that ``extract_keyed_stream`` has written."""
    return versions.committed(spark, f"{out}/documents")

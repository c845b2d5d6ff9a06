"""The whole way from captured exchanges to documents."""

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil import __version__
from tallyveil.operators import extract, integrity, lookup
from tallyveil.plans.scale import keep_where, small_splits, spread, written
from tallyveil.sources import capture as exchanges
from tallyveil.sources import html


@dataclass(frozen=True)
class RunInfo:
    """What a run writes into every document's metadata."""

    tool: str = "tallyveil"
    tool_version: str = __version__
    extracted_at: str = field(default_factory=extract.utc_now)
    instance_url: str | None = None
    modern_path: str | None = None


class Extracted(NamedTuple):
    documents: DataFrame
    rejects: DataFrame
    unresolved: DataFrame


#: What became of an exchange's record: a document with its own lines, one without, none, or a search's codes.
DOCUMENT, BARE, REJECT, CODES = "document", "bare", "reject", "codes"
_TAGGED = ("outcome", "seq", "record_pos", "url", "invoice", "invoice_currency_id", "lines", "reject_reason", "codes")


def tagged_records(capture: DataFrame, mode: str = "first") -> DataFrame:
    """Every record of the capture's reads, and every search, with its ``outcome`` and what later steps need of it.

    Requests and answers are parsed once, and nothing moves.
    """
    parsed = exchanges.result_of(exchanges.calls(capture))
    is_read = F.col("kind") == "read"
    parsed = parsed.withColumn("codes", F.when(~is_read, lookup.codes_of(F.col("result"))))
    parsed = parsed.withColumn("body", F.when(is_read, F.col("body"))).drop("result")
    marked = exchanges.with_reject_reason(exchanges.moves_from_result(parsed, mode))
    ok = is_read & F.col("reject_reason").isNull()
    made = marked.withColumn("move", F.when(ok, F.col("move")))
    made = extract.extract_lines(made.withColumns(extract.header_columns()))
    outcome = F.when(~is_read, CODES).when(~ok, REJECT).when(F.size("lines") > 0, DOCUMENT).otherwise(BARE)
    return made.withColumns({"outcome": outcome, "reject_reason": F.when(is_read, F.col("reject_reason"))}).select(*_TAGGED)


def read_once(capture: DataFrame, mode: str = "first") -> DataFrame:
    """``tagged_records`` written to the shared folder, one partition for each outcome: a branch reads its files only."""
    with small_splits(capture.sparkSession):
        return written(tagged_records(capture, mode), "records", ["outcome"])


def pages_of(tagged: DataFrame, pages: DataFrame | None) -> DataFrame | None:
    """(seq, dom_lines) of the pages that records without lines ask for, written to the shared folder.

    Of pages as (seq, html) only these are read, once for all outputs; lines that are given with them are taken over.
    """
    if pages is None:
        return None
    asked = tagged.filter(F.col("outcome") == BARE).select("seq").distinct()
    found = pages.join(asked, "seq", "left_semi")
    if "dom_lines" not in pages.columns:
        found = html.lines_from_html(spread(found))
    return written(found.select("seq", "dom_lines"), "page-lines")


def codes_seen(tagged: DataFrame) -> DataFrame:
    """(seq, pos, currency_id, code) of the searches among the tagged records."""
    rows = tagged.filter(F.col("outcome") == CODES)
    return rows.select("seq", F.explode_outer("codes").alias("c")).filter(F.col("c").isNotNull()).select("seq", "c.*")


def documents_of(
    tagged: DataFrame, run: RunInfo, pages: DataFrame | None = None, codes: DataFrame | None = None, mode: str = "first",
) -> Extracted:
    """The outputs of ``extract_documents`` from tagged records."""
    if codes is None:
        codes = lookup.latest_codes(codes_seen(tagged)).drop("place")
    columns = ("seq", "record_pos", "url", "invoice", "invoice_currency_id", "lines", "used_source", "reject_reason")
    none = F.lit(None).cast("string")
    whole = tagged.filter(F.col("outcome") == DOCUMENT)
    chosen = whole.withColumns({"used_source": F.lit(extract.RPC_SOURCE), "reject_reason": none}).select(*columns)
    bare = tagged.filter(F.col("outcome") == BARE)
    if pages is None:
        lost = bare.withColumn("reject_reason", F.lit(extract.NO_LINES))
    else:
        if mode == "all":
            # A page shows one invoice. Where several records of an answer lack lines, it is nobody's.
            alone = bare.groupBy("seq").agg(F.count("*").alias("n")).filter(F.col("n") == 1).select("seq")
            pages = pages.join(alone, "seq", "left_semi")
        filled = extract.fill_from_pages(bare.select(*columns[:6]), pages, ["seq"])
        chosen = chosen.unionByName(keep_where(filled, F.col("reject_reason").isNull()).select(*columns))
        lost = keep_where(filled, F.col("reject_reason").isNotNull())
    rejected = tagged.filter(F.col("outcome") == REJECT)
    rejects = rejected.select("seq", "reject_reason").unionByName(lost.select("seq", "reject_reason"))
    kept = lookup.resolve_currency(chosen, codes, key=["seq", "record_pos"])
    checked = integrity.build_checks(kept)
    tagged_out = extract.with_metadata(
        checked, run.tool, run.tool_version, run.extracted_at, "url", run.instance_url, run.modern_path
    )
    documents = extract.assemble(integrity.with_fingerprint(tagged_out), "seq", "record_pos")
    return Extracted(documents, rejects, lookup.unresolved_currencies(chosen, codes).select("seq"))


def extract_documents(
    capture: DataFrame, run: RunInfo, pages: DataFrame | None = None, codes: DataFrame | None = None, mode: str = "first",
) -> Extracted:
    """Documents (seq, record_pos, metadata, invoice, lines, checks), rejects (seq, reject_reason) and
    the exchanges (seq) of documents with a currency id that ``codes`` does not have.

    The capture is read and parsed once, into a table in the shared folder from which all outputs branch.
    ``pages`` has (seq, dom_lines) for exchanges whose payload held no lines. ``codes`` defaults to
    the currency codes of the searches in the same capture. Only records without lines of their
    own meet the pages; all others go from payload to document without moving.
    """
    return documents_of(read_once(capture, mode), run, pages, codes, mode)

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyveil.functions import patterns
from tallyveil.operators import matcher, redact

from .samples import values

MASK = patterns.TOKEN_MASK

# The patterns stated once more for a regex engine with Unicode word edges.
PLAIN = [
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0, "[REDACTED:EMAIL]"),
    (r"\b[A-Z]{1,5}[/\-]\d{4}[/\-]\d{3,}\b", 0, "[REDACTED:INVOICE_NO]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", 0, "[REDACTED:SSN]"),
    (r"\b(?:\d[ \-]?){13,19}\b", 0, "[REDACTED:CARD]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0, "[REDACTED:IP]"),
    (r"\bhttps?://[^\s<>\"')]+", re.I, "[REDACTED:URL]"),
    (r"(?<!\w)\+\d[\d .\-]{6,}\d(?!\w)", 0, "[REDACTED:PHONE]"),
    (r"\(\d{2,4}\)[ .\-]?\d{2,4}[ .\-]?\d{2,4}", 0, "[REDACTED:PHONE]"),
]


def plain_scrub(text):
    for pattern, flags, mask in PLAIN:
        text = re.sub(pattern, mask, text, flags=flags)
    return text


def texts(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "i INT, t STRING")


def tokens(spark, *items):
    return spark.createDataFrame([(t,) for t in items], "token STRING")


def scrubbed(spark, items, deny=None, **more):
    return values(redact.scrub(texts(spark, *items), ["t"], deny, **more).select("i", "t"))


HARD = [
    "card 4316522678525456 erorsh on", "+49 170 1234567890 z", "http://10.0.0.1/x y", "ssn ١٢٣-٤٥-٦٧٨٩ x", "é123-45-6789", "123-45-6789é",
    "a@b.co é.x@y.org.", "4316 5226 7852 5456 4316 5226 7852 5456 1", "1-2-3-4-5-6-7-8-9-0-1-2-3 4", "x+49 170 1234567", "INV/2026/00001-1 RINV-2026-123",
    "call +1 415 555 0123 now", "(415) 555-0123 (12)3456", "HTTPS://A.b/c'd\" hTTp://<x http://é http\u017f://q.r", "+1 (415) 555-0123", "a.b@c.d@e.fg", "..x@y.zz",
    "w..x@y.zz", "1.2.3.4.5", "+1234567890+1234567890", "2026-05-29", "dc149831b8a07a77", "", "²1.2.3.4 ½123-45-6789 a_1.2.3.4", "http://a\u00a0b\u2003c\x1cd",
    "4316522678525456\n4316522678525456", "x\u0301123-45-6789 \u0301@a.bc",
]


def test_patterns_equal_the_unicode_engine(spark):
    rng = random.Random(11)
    pieces = ["1", "23", "456", "7890", "-", " ", ".", "/", "+", "(", ")", "@", "a", "Z", "é", "INV", "http://", "HTTPS://", "_", "\n", "٣", "x.com", "://", "  ", "²"]
    noise = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    items = HARD + noise
    want = [plain_scrub(t) for t in items]
    assert scrubbed(spark, items) == want
    one = texts(spark, *items).select("i", patterns.redact_patterns(F.col("t")))
    assert values(one) == want


def test_structured_identifiers(spark):
    got = scrubbed(spark, ["write to ira@moss.example.org", "number 078-05-1120", "see BIL/2031/00417 again", "dial +44 20 7946 0958 or", "card 4316522678525456 on"])
    assert got == ["write to [REDACTED:EMAIL]", "number [REDACTED:SSN]", "see [REDACTED:INVOICE_NO] again", "dial [REDACTED:PHONE] or", "card [REDACTED:CARD]on"]


def test_allow_list_spares_infrastructure(spark):
    got = scrubbed(spark, ["moved https://acme.example.org over http://clinic.example.net/x?y", "at 10.0.0.1 and 10.0.0.2", "https://acme.example.org/deep x@y.org"],
                   allow=["https://acme.example.org", "10.0.0.1", ""])
    assert got == ["moved https://acme.example.org over [REDACTED:URL]", "at 10.0.0.1 and [REDACTED:IP]", "https://acme.example.org/deep [REDACTED:EMAIL]"]


def test_values_that_are_no_text(spark):
    df = spark.createDataFrame([(1, 12345, 1e16, True, None)], "i INT, n INT, d DOUBLE, b BOOLEAN, t STRING")
    assert tuple(redact.scrub(df, ["n", "d", "b", "t"]).first()) == (1, "12345", "1e+16", "True", "")


def test_deny_list(spark):
    df = spark.createDataFrame([("\t Harbor Mill\u00a0", ["AB", None, "abc"]), (None, []), ("Harbor Mill", ["ABC"])], "name STRING, more ARRAY<STRING>")
    deny = redact.deny_list(df, ["name", "more"])
    assert sorted(r.token for r in deny.collect()) == ["ABC", "Harbor Mill", "abc"]
    assert redact.secret_count(deny).first()[0] == 3
    assert [r.token for r in redact.matcher_order(deny).collect()] == ["Harbor Mill", "ABC"]
    assert redact.deny_list(df, ["more"], min_len=0).count() == 3


FORMS = {
    "chosen": lambda df, deny: redact.redact_tokens(df, "t", deny),
    "matcher": lambda df, deny: matcher.gathered_layer(deny, MASK)(df, "t"),
    "join": lambda df, deny: matcher.joined_layer(deny, MASK)(df, "t"),
}


@pytest.mark.parametrize("form", FORMS)
def test_deny_list_forms(spark, form):
    df = texts(spark, "a bill went to Harbor Mill at noon", "three FIELD TENTS left", "ABABAB", "", None, "xharbor millx", "PHI [REDACTED:PHI]", "a.c abc a+c \\E")
    deny = tokens(spark, "Harbor Mill", "Field Tent", "Field", "PHI", "a.c", "a+c", "\\E", "")
    assert values(FORMS[form](df, deny).select("i", "t")) == [
        f"a bill went to {MASK} at noon", f"three {MASK}S left", "ABABAB", "", None, f"x{MASK}x", f"{MASK} [REDACTED:{MASK}]", f"{MASK} abc {MASK} {MASK}"]
    assert values(FORMS[form](df, tokens(spark, "zzz").limit(0)).select("i", "t"))[:3] == ["a bill went to Harbor Mill at noon", "three FIELD TENTS left", "ABABAB"]


def test_all_forms_agree_on_random_tokens(spark):
    rng = random.Random(5)
    letters = "abcAB éİıſßK日😀 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [word(rng.randint(0, 80)) for _ in range(300)]
    deny = [t for t in {word(rng.randint(1, 9)).strip() for _ in range(60)} if t]
    pattern = re.compile("|".join(re.escape(t) for t in sorted(deny, key=len, reverse=True)), re.I)
    want = [pattern.sub(MASK, t) for t in items]
    for form in FORMS.values():
        assert values(form(texts(spark, *items), tokens(spark, *deny)).select("i", "t")) == want


def test_scoped_tokens(spark):
    df = spark.createDataFrame([(0, "a", "Ann met Bob"), (1, "b", "Ann met Bob"), (2, None, "Ann met Bob"), (3, "a", "Ann met Bob")], "i INT, s STRING, t STRING")
    deny = spark.createDataFrame([("a", "Ann"), ("b", "bob"), ("c", "met")], "s STRING, token STRING")
    assert values(redact.redact_tokens(df, "t", deny, by="s").select("i", "t")) == [f"{MASK} met Bob", f"Ann met {MASK}", "Ann met Bob", f"{MASK} met Bob"]


def scoped_rows():
    """Scopes of very different sizes, among them one with half of the texts, and texts without a scope."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    items = [(i, rng.choice(["hot", f"s{rng.randrange(30)}", None]), " ".join(word() for _ in range(12)) if i % 17 else None) for i in range(400)]
    deny = [(s, word()) for s in ["hot", "none", None, *(f"s{n}" for n in range(0, 30, 2))] for _ in range(rng.randint(1, 9))]
    own = {}
    for s, t in deny:
        own.setdefault(s, set()).add(t)
    want = {}
    for i, s, t in items:
        listed = sorted(own.get(s, ()) if s else (), key=len, reverse=True)
        want[i] = re.sub("|".join(map(re.escape, listed)), MASK, t, flags=re.I) if listed and t else t
    return items, deny, want


@pytest.mark.parametrize("busy, most", [(100_000, 100_000), (7, 100_000), (50, 4), (100_000, 0)])
def test_each_scope_has_its_own_matcher(spark, monkeypatch, busy, most):
    items, deny, want = scoped_rows()
    monkeypatch.setattr(matcher, "SCOPE_ROWS", busy)
    monkeypatch.setattr(matcher, "SMALL_ROWS", most)
    df = spark.createDataFrame(items, "i INT, s STRING, t STRING").withColumn("more", F.array("s"))
    out = redact.redact_tokens(df, "t", spark.createDataFrame(deny + [("s1", ""), ("s1", None)], "s STRING, token STRING"), by="s")
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == len(items) and {r.i: r.t for r in rows} == want
    assert all(r.more == [r.s] for r in rows)


def test_candidates_of_a_scope_do_not_grow_with_other_scopes(spark):
    """Tokens of a thousand other scopes stand in every text; a scope's matcher never meets them."""
    shared = " ".join(f"tok{n}" for n in range(1000))
    df = spark.createDataFrame([(i, f"s{i}", shared) for i in range(4)], "i INT, s STRING, t STRING")
    deny = spark.createDataFrame([(f"s{n}", f"tok{n}") for n in range(1000)], "s STRING, token STRING")
    plan = matcher.scoped_layer(deny, MASK, "s")(df, "t")
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    # tok1 stands in tok10 to tok19 and tok100 to tok199, too.
    assert {r.i: r.t.count(MASK) for r in plan.collect()} == {0: 1, 1: 111, 2: 111, 3: 111}


def test_token_tables_of_several_filters(spark, monkeypatch):
    """Tokens dealt to several filters by hash are found and counted like those of one."""
    monkeypatch.setattr(matcher, "is_small", lambda df: False)
    deny = tokens(spark, *[f"item {i}" for i in range(90)], "abc", "bc d", "é")
    df = texts(spark, *[f"item {i} and ITEM {i + 60}, abc d É" for i in range(40)], None, "none", *["item 3 twice"] * 5)
    one = values(matcher.joined_layer(deny, MASK)(df, "t").select("i", "t"))
    counts = sorted(tuple(r) for r in matcher.matched_tokens(df, "t", deny, F.count("*")).collect())
    monkeypatch.setattr(matcher, "FILTER_TOKENS", 20)
    assert len(matcher._filters_of_table(matcher.folded_tokens(deny))) == 5
    assert values(matcher.joined_layer(deny, MASK)(df, "t").select("i", "t")) == one
    assert sorted(tuple(r) for r in matcher.matched_tokens(df, "t", deny, F.count("*")).collect()) == counts


def test_filter_of_a_large_token_table_equals_the_gathered_one(spark):
    deny = tokens(spark, *[f"Customer#{i:09d}" for i in range(300)], "x", "yz", "日本語")
    known = sorted(r.folded for r in matcher.folded_tokens(deny).collect())
    batch = ["CUSTOMER#000000007 and customer#000000299, Customer#000000300", "yz 日本語", ""]

    def found(token_filter):
        number, at, lengths, folded = token_filter.candidates(batch)
        spans = zip(number.tolist(), at.tolist(), lengths.tolist())
        return sorted(s for s in spans if folded[s[0]][s[1] : s[1] + s[2]] in known)

    want = [(0, 0, 18), (0, 23, 18), (1, 0, 2), (1, 3, 3)]
    assert found(matcher._filter_of_table(matcher.folded_tokens(deny))) == want
    assert found(matcher._filter_of_tokens(known)) == want


def test_row_tokens(spark):
    df = spark.createDataFrame([(0, "Ann met Annabel", ["Ann", "annabel"]), (1, "x", []), (2, "x", None), (3, "a\\Eb", ["a\\Eb"]), (4, "abc Miss", ["Miss", "", None]), (5, "abc", [""])], "i INT, t STRING, k ARRAY<STRING>")
    assert values(df.select("i", patterns.redact_row_tokens(F.col("t"), F.col("k")))) == [f"{MASK} met {MASK}", "x", "x", MASK, f"abc {MASK}", "abc"]


def test_a_hot_text_and_a_hot_token(spark):
    """A third of the rows are copies of one text that holds the commonest token."""
    items = [f"Ann paid {i % 3 and i}" for i in range(3000)]
    got = values(FORMS["join"](texts(spark, *items), tokens(spark, "ann", *[f"paid {i}" for i in range(1, 50)])).select("i", "t"))
    pattern = re.compile("ann|" + "|".join(f"paid {i}" for i in range(49, 0, -1)), re.I)
    assert got == [pattern.sub(MASK, t) for t in items]


def test_tokens_do_not_stand_in_the_plan(spark):
    df = redact.scrub(texts(spark, "Opened for Harbor Mill"), ["t"], tokens(spark, "Harbor Mill"))
    assert "Harbor" not in df._jdf.queryExecution().toString().replace("Opened for Harbor", "")
    assert df.first().t == f"Opened for {MASK}"


def find_capitals():
    word = re.compile("[A-Z]{3,}")
    return lambda text: [m.span() for m in word.finditer(text)] + ([(0, 2), (1, 3)] if text.startswith("ab") else [])


def broken_detector():
    raise RuntimeError("no model")


def broken_call():
    def find(text):
        raise RuntimeError("no answer")

    return find


def test_entity_layer_degrades_open(spark):
    assert scrubbed(spark, ["met JANE at a@b.co", "abcd", None], ner=find_capitals) == [
        "met [REDACTED:NER] at [[REDACTED:NER]:[REDACTED:NER]]", "[REDACTED:NER]d", ""]
    for detector in (broken_detector, broken_call):
        assert scrubbed(spark, ["met JANE"], ner=detector) == ["met JANE"]


def test_a_failing_scrubber_masks(spark):
    def scrubber(text):
        return {"a": "A"}[text]

    assert values(redact.scrub_with(texts(spark, "a", "b", None), "t", scrubber).select("i", "t")) == ["A", "[REDACTION-ERROR]", "[REDACTION-ERROR]"]


def log(i, msg, args, exc=None, stack=None):
    return (i, "INFO", "t", msg, args, exc, stack)


def test_logs_are_rendered_once_and_cleared(spark):
    rows = [
        log(0, "%s sent back %d tents", ["Harbor Mill", "3"]), log(1, "boom", [], "KeyError: no row of Harbor Mill left", "at 10.0.0.1"),
        log(2, "100%% of %s", ["a %s $1 \\ %d"]), log(3, "100%%", []), log(4, "%s and %s", ["one"]), log(5, "%d", ["x"], "Harbor Mill", "Harbor Mill"),
        log(6, "%5.2f", ["1"]), log(7, "%%%s%%", ["v"]), log(8, "%d|%i", ["-007", "3.9"]), log(9, "%s", [None]), log(10, None, []), log(11, "plain", None),
        log(12, "%s", ["Harbor"] * 1), log(13, "%", ["x"]), log(14, "x %s %%", ["a\0b"]), log(15, "%r|%04x|%+.1e|%-4s|", ["q", "255", "12.5", "z"]),
    ]
    logs = spark.createDataFrame(rows, "i INT, level STRING, logger STRING, msg STRING, args ARRAY<STRING>, exc_text STRING, stack_info STRING")
    got = {r.i: r for r in redact.scrub_logs(logs, tokens(spark, "Harbor Mill")).collect()}
    lost = "[REDACTION-ERROR: log content suppressed]"
    assert [got[i].msg for i in range(16)] == [
        f"{MASK} sent back 3 tents", "boom", "100% of a %s $1 \\ %d", "100%%", lost, lost, " 1.00", "%v%", "-7|3", "None", "None", "plain", "Harbor", lost,
        "x a\0b %", "'q'|00ff|+1.2e+01|z   |"]
    assert got[1].exc_text == f"KeyError: no row of {MASK} left" and got[1].stack_info == "at [REDACTED:IP]"
    assert got[5].exc_text is None and got[5].stack_info is None and got[0].exc_text is None
    assert all(r.args == [] for r in got.values()) and len(got) == 16


def test_leak_audit_counts_rows(spark):
    df = texts(spark, "Ann and ann and Bob", "annabel", "none")
    deny = tokens(spark, "Ann", "Bob", "Annabel", "zzz")
    assert {r.token: r.rows for r in redact.leak_audit(df, "t", deny).collect()} == {"ann": 2, "bob": 1, "annabel": 1}
    assert redact.leak_audit(redact.redact_tokens(df, "t", deny), "t", deny).count() == 0


def test_audit_with_a_token_table_too_large_to_gather(spark, monkeypatch):
    monkeypatch.setattr(matcher, "is_small", lambda *a, **k: False)
    df = texts(spark, "Ann and ann and Bob", "annabel", "none")
    deny = tokens(spark, "Ann", "Bob", "Annabel", "zzz")
    assert {r.token: r.rows for r in redact.leak_audit(df, "t", deny).collect()} == {"ann": 2, "bob": 1, "annabel": 1}
    assert values(matcher.joined_layer(deny, MASK)(df, "t").select("i", "t")) == [f"{MASK} and {MASK} and {MASK}", MASK, "none"]


def test_formatting_equals_pythons(spark):
    rng = random.Random(9)
    forms = ["%s", "%d", "%i", "%5d", "%-6s|", "%r", "%x", "%#o", "%.3f", "%08.2f", "%e", "%g", "%%", "%+d", "%c"]
    rows, want = [], []
    for _ in range(400):
        marks = [rng.choice(forms) for _ in range(rng.randint(1, 4))]
        values_ = [rng.choice(["7", "-12", "3"]) if m[-1] not in "sr|" else rng.choice(["a", "x%sy", "é"]) for m in marks if m != "%%"]
        if not values_:
            continue
        kinds = [m for m in marks if m != "%%"]
        read = lambda m, v: float(v) if m[-1] in "feg" else v if m[-1] in "sr|" else v[0] if m == "%c" else int(v)
        if "%c" in kinds and any(v == "-12" for m, v in zip(kinds, values_) if m == "%c"):
            continue
        typed = tuple(chr(int(v)) if m == "%c" else read(m, v) for m, v in zip(kinds, values_))
        msg = " / ".join(marks)
        rows.append((len(rows), msg, values_))
        want.append(msg % typed)
    logs = spark.createDataFrame(rows, "i INT, msg STRING, args ARRAY<STRING>")
    assert values(logs.select("i", redact.rendered(F.col("msg"), F.col("args")))) == want


def test_a_failing_matcher_masks(spark, monkeypatch):
    def work(rows):
        if "bad" in rows:
            raise RuntimeError("broken")
        return [r.upper() for r in rows]

    assert matcher.fail_closed(work, ["a", "bad", "c"]) == ["A", "[REDACTION-ERROR]", "C"]


def test_a_detector_is_loaded_once_in_a_worker(tmp_path):
    made = []

    def detector():
        made.append(1)
        return lambda text: []

    assert redact.loaded("test-key", detector) is redact.loaded("test-key", detector) and made == [1]
    assert redact.loaded("test-broken", broken_detector) is None


def test_no_token_is_left_on_disk(spark, tmp_path, monkeypatch):
    import glob

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    monkeypatch.setattr(redact, "measure", lambda df: (1 << 40, 1 << 40))
    before = set(glob.glob(f"{folder}/../**/*", recursive=True))
    assert redact.redact_tokens(texts(spark, "Ann"), "t", tokens(spark, "ann")).first().t == MASK
    assert not [f for f in set(glob.glob(f"{folder}/../**/*", recursive=True)) - before if "token" in f]


def test_a_batch_is_searched_in_bounded_slices(monkeypatch):
    hashed, plain = [], matcher._window_hashes
    monkeypatch.setattr(matcher, "_window_hashes", lambda points, sizes: hashed.append(len(points)) or plain(points, sizes))
    texts = ["", "a harbor and a mill", "x" * 50, "harbor", "y" * 5000] * 40
    token_filter = matcher._filter_of_tokens(["harbor", "mill", "xxxxx"])
    whole = [c.tolist() if hasattr(c, "tolist") else c for c in token_filter.candidates(texts)]
    monkeypatch.setattr(matcher, "SLICE", 200)
    hashed.clear()
    parts = token_filter.candidates(texts)
    assert max(hashed) <= 5001 and len(hashed) >= 80
    assert sorted(zip(*whole[:3])) == sorted(zip(*[c.tolist() for c in parts[:3]])) and parts[3] == whole[3]
    assert [sorted(c["folded"] for c in row) for row in matcher._spans_of(texts[:4], token_filter).to_pylist()] == [
        [], ["harbor", "mill"], ["xxxxx"] * 46, ["harbor"]]
    assert list(matcher.slices([])) == [] and token_filter.candidates([])[3] == []

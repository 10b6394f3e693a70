"""Hand-made cases for operators that the driver tables don't exercise."""

import datetime as dt
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerwood.functions import text as T
from ledgerwood.functions import values as V
from ledgerwood.operators import compliance as C
from ledgerwood.operators import services
from ledgerwood.operators import documents as D
from ledgerwood.operators import relations as R
from ledgerwood.operators import retrieval as S
from ledgerwood.plans import registry
from ledgerwood.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark,
        squeeze=T.squeeze(lit("  a \t b\n\n\n c ")), fold=T.fold(lit("“It’s”  A–B")), number=T.clause_number(lit("020.01.) ")), parent=T.clause_parent(lit("20.2.1")),
        roman=T.roman_value(lit("MCMXCIV")), no_roman=T.roman_value(lit("house")), digits=T.repair_digits(lit("2O.l.III")), name=T.safe_filename(lit("/x/..a:b?.pdf")),
        lines=T.without_lines(lit("Page 3\nbody\nPAGE 4"), F.array(lit("page #"))), absent=T.absent_to_null(lit(" N/A ")), under=T.clause_under(lit("200.1"), "20"), cut=T.excerpt(lit("x" * 500), lit(250), 10),
    )
    assert (r["squeeze"], r["fold"], r["number"], r["parent"]) == ("a b\n\n c", "\"it's\" a-b".replace('"', '"'), "20.1", "20.2")
    assert (r["roman"], r["no_roman"], r["digits"], r["name"]) == (1994, None, "20.l.III", "a_b_.pdf")
    assert (r["lines"], r["absent"], r["under"], len(r["cut"])) == ("body", None, False, 23)


def test_values(spark):
    lit, day = F.lit, lambda s: F.lit(s).cast("date")
    r = one(
        spark,
        d1=V.parse_date(lit("3rd March 2024")), d2=V.parse_date(lit("31/12/2023")), d3=V.parse_date(lit("soon")), cal=V.add_days(day("2024-01-01"), 28),
        work=V.add_days(day("2024-12-20"), 3, True, F.array(day("2024-12-25"))), back=V.count_days(day("2024-01-10"), day("2024-01-01"), True), a=V.amount(lit("USD 1,250,000")), b=V.amount(lit("about 2.5 million")),
        c=V.amount(lit("10 or 20")), cur=V.currency(lit("Pounds")), band=V.quality_band(lit(0.7)), pts=V.piecewise(lit(15.0), [(10, 0), (20, 50)]), size=V.size_in_billions(lit("560M")),
    )
    assert (r["d1"], r["d2"], r["d3"], r["cal"]) == (dt.date(2024, 3, 3), dt.date(2023, 12, 31), None, dt.date(2024, 1, 29))
    assert (r["work"], r["back"]) == (dt.date(2024, 12, 26), -7)
    assert (r["a"], r["b"], r["c"], r["cur"], r["band"], r["pts"], r["size"]) == (1250000, 2500000, None, "GBP", "usable", 25.0, 0.56)


def test_scope_is_checked_and_only_narrows():
    with pytest.raises(ValueError):
        R.Scope(())
    with pytest.raises(ValueError):
        R.Scope(("knowledge",))
    with pytest.raises(PermissionError):
        R.Scope(("project",), (1, 2), project=3)
    scope = R.Scope(("project", "knowledge"), (1,), edition="e")
    assert scope.narrowed(["project"]).sources == ("project",)
    with pytest.raises(ValueError):
        scope.narrowed(["project"]).narrowed(["knowledge"])


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert {tuple(r) for r in R.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert {tuple(r) for r in R.insert_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    R.replace_partition(spark.createDataFrame([(1, 1), (2, 2)], "x int, v int"), path, "v")
    R.replace_partition(spark.createDataFrame([(9, 2)], "x int, v int"), path, "v")
    assert {(r["x"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 1), (9, 2)}


def lists(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, document_id string, is_complete boolean, char_count int, score double, method string")


def test_fusion_and_budget(spark):
    exact = lists(spark, [(1, "a", True, 10, 1.0, "clause_exact")])
    lexical = lists(spark, [(2, "a", False, 10, 9.0, "lexical"), (1, "a", True, 10, 8.0, "lexical")])
    got = {r["chunk_id"]: r["fused_score"] for r in S.fuse([exact, lexical]).collect()}
    assert got[1] == pytest.approx((1 / 61 + 1 / 62) * 1.15 * 2.0 * 1.10)
    assert got[2] == pytest.approx(1 / 61)
    rows = [(i, "abc"[i % 3], False, n, float(-i), "lexical") for i, n in enumerate([20000, 5000, 3000, 100])]
    kept = S.assemble(S.fuse([lists(spark, rows)]), max_chars=24000)
    assert [(r["ref"], r["chunk_id"]) for r in kept.collect()] == [("S1", 0), ("S2", 2), ("S3", 3)]


def test_diversify_keeps_the_best(spark):
    rows = [(i, "one", False, 1, float(-i), "lexical") for i in range(7)]
    assert sorted(r["chunk_id"] for r in S.diversify(S.fuse([lists(spark, rows)])).collect()) == [0, 1, 2, 3]


def loop_chunks(text, target=D.TARGET, largest=D.LARGEST):
    """Chunks by a plain loop over the units: 150 characters at most of each go into the next."""
    import re

    end = re.compile(r"(?<=[.;:!?])[ \t]+(?=[A-Z\"'(])")
    if not text.strip(" "):
        return []
    if len(text) <= largest:
        return [text]
    units = []
    for p in (p.strip(" ") for p in re.split(r"\n[ \t]*\n", text)):
        for s in [p] if len(p) <= largest else end.split(p):
            units += [s[i : i + largest] for i in range(0, len(s), largest)]
    out, held = [], ""
    for u in [*units, None]:
        if u is not None and held and len(held) + 2 + len(u) <= target:
            held += "\n\n" + u
            continue
        if held.strip(" ") and (len(held.strip(" ")) >= 60 or not out):
            out.append(held.strip(" "))
        tail = ""
        if len(held) > 150:
            tail = held[-150:]
            tail = end.split(tail, 1)[1] if end.search(tail) else tail[tail.find(" ") + 1 :]
        held = "\n\n".join(x for x in (tail.strip(" "), u) if x)
    return out


def test_chunks_against_a_loop(spark):
    texts = ["", "one", "a b.\n\n c", "\n\n".join(f"Part {i}: " + "word " * (i % 70) + "end." for i in range(90)), " ".join(f"Words of sentence {i}." for i in range(300)), ". ".join("word" * (i % 50 + 1) for i in range(200)) + "\nend", "x" * 4500 + "\n" + "y" * 1190 + "\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in D.chunks(df, "doc_id").orderBy("doc_id", "sequence").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: c for i, t in enumerate(texts) if (c := loop_chunks(t))}


def test_pages_of_paragraphs_against_a_loop(spark):
    text = "\n\n".join("p" * (i * 37 % 900 + 1) for i in range(40))
    want = []
    for p in text.split("\n\n"):
        if want and len(want[-1]) + 2 + len(p) <= 1000:
            want[-1] += "\n\n" + p
        else:
            want.append(p)
    got = D.pack_paragraphs(spark.createDataFrame([(1, text), (2, "")], "k int, text string"), "k", 1000).orderBy("page_number").collect()
    assert [r["text"] for r in got] == want


def test_running_lines_and_contents(spark):
    pages = [("d", i, f"Contract {i}\nunlike {'abcdefg'[i]}\nbody") for i in range(6)] + [("e", 9, "1 Scope ....... 3\n2 Terms ..... 5\n3 Price .... 7\n4 End ..... 9")]
    df = spark.createDataFrame(pages, "document string, page int, text string")
    assert {r["key"] for r in D.running_lines(df, "document", "page").collect()} == {"contract #", "body"}
    assert {r["page"]: r["is_content"] for r in D.content_pages(df, "page").collect()}[9] is False


def test_notice_compliance_cases(spark):
    d = lambda s: dt.date.fromisoformat(s)
    claims = spark.createDataFrame([(1, "red-book-2017", "both", d("2024-01-01")), (2, "red-book-2017", "both", None), (3, "red-book-1987", "money", d("2024-01-01"))], "claim_id int, edition string, seeks string, awareness date")
    notices = spark.createDataFrame(
        [(1, 10, "20.2.1", None, d("2024-01-29")), (1, 11, "20.2.4", None, d("2024-03-26")), (3, 30, "", None, d("2024-01-10")), (3, 31, "53.3", None, d("2024-02-20"))],
        "claim_id int, notice_id int, clause string, obligation string, effective date",
    )
    got = {(r["claim_id"], r["clause"]): r for r in C.notice_compliance(claims, notices, C.requirements(spark)).collect()}
    assert got[1, "20.2.1"]["status"] == "compliant"  # on its last day
    assert (got[1, "20.2.4"]["status"], got[1, "20.2.4"]["days_late"], got[1, "20.2.4"]["time_barred"]) == ("late", 1, False)
    assert got[2, "20.2.1"]["status"] == "indeterminate"
    assert got[3, "53.1"]["status"] == "compliant"  # a notice under no clause counts
    assert (got[3, "53.3"]["starts"], got[3, "53.3"]["notice_id"], got[3, "53.3"]["status"]) == (d("2024-01-10"), 31, "late")


def test_amendments(spark):
    changes = [("red-book-2017", "20.2.1", "notice_of_claim", "amend", 14, None), ("red-book-2017", "20.2.4", "detailed_claim", "remove", None, None), ("red-book-2017", "9.9", "notice_of_claim", "add", 7, True)]
    df = spark.createDataFrame(changes, "edition string, clause string, obligation string, action string, period_days int, precedent boolean")
    got = {r["clause"]: r["period_days"] for r in C.amended(C.requirements(spark), df).where("edition = 'red-book-2017'").collect()}
    assert got == {"20.2.1": 14, "9.9": 7}


@pytest.mark.parametrize(
    "change, code, outcome",
    [
        ({}, None, "ready"), ({"has_respondent": False}, "CB4", "ready_with_queries"), ({"description": " "}, "EV2", "ready_with_queries"), ({"n_records": 0}, "RC1", "ready_with_queries"),
        ({"n_basis": 0}, "CB2", "not_ready"), ({"event_date": None}, "EV1", "not_ready"), ({"n_without_notice": 1}, "NC3", "not_ready"), ({"amount": None, "days_claimed": None}, "QR1", "not_ready"),
        ({"n_barred": 1}, "NC4", "barred"), ({"n_detailed": 1, "n_lapsing": 1, "n_expired": 1}, "DC3", "lapsed"), ({"n_late_open": 1}, "NC5", "ready_with_queries"),
    ],
)
def test_screening_outcomes(spark, change, code, outcome):
    day = dt.date(2024, 1, 10)
    facts = {"edition": "red-book-2017", "n_basis": 1, "published": True, "n_basis_missing": 0, "has_claimant": True, "has_respondent": True, "awareness": day, "registered": True, "event_date": day, "today": dt.date(2024, 6, 1), "description": "x", "instructed": False, "instruction_linked": False, "n_records": 1, "days_claimed": 5, "amount": 10.0, "currency": "EUR", "seeks_money": True, "seeks_time": True}
    facts |= {c: 0 for c in ("n_without_notice", "n_barred", "n_late_open", "n_misaddressed", "n_unreceived", "n_unconfirmed", "n_detailed", "n_detailed_missing", "n_detailed_late", "n_lapsing", "n_expired", "n_expired_on_record")} | change
    kind = lambda v, k: "date" if k in ("awareness", "event_date", "today") else "double" if k == "amount" else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "int"
    df = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {kind(v, k)}" for k, v in facts.items()))
    r = C.outcome(C.screen(df)).first()
    assert r["outcome"] == outcome
    assert code is None or r[code] in ("incomplete", "barred", "lapsed")


def test_every_edition_has_its_requirements(spark):
    got = {(r["edition"], r["clause"], r["period_days"]) for r in C.requirements(spark).collect()}
    assert len(got) == 15 and {e for e, _, _ in got} == {f"{b}-book-{y}" for b in ("red", "yellow", "silver") for y in (1999, 2017)} | {"red-book-1987"}


def test_screening_gates(spark):
    columns = "edition string, n_basis int, published boolean, n_basis_missing int, has_claimant boolean, has_respondent boolean, awareness date, registered boolean"
    df = spark.createDataFrame([("", 1, True, 0, True, True, None, False)], columns)
    zero = ["n_without_notice", "n_barred", "n_late_open", "n_misaddressed", "n_unreceived", "n_unconfirmed", "n_detailed", "n_detailed_missing", "n_detailed_late", "n_lapsing", "n_expired", "n_expired_on_record"]
    df = df.withColumns({c: F.lit(0) for c in zero} | {c: F.lit(None).cast("date") for c in ("event_date",)} | {"today": F.current_date(), "description": F.lit("x"), "instructed": F.lit(False), "instruction_linked": F.lit(False), "n_records": F.lit(1), "days_claimed": F.lit(5), "amount": F.lit(None).cast("double"), "currency": F.lit(""), "seeks_money": F.lit(True), "seeks_time": F.lit(True)})
    r = C.outcome(C.screen(df)).first()
    assert (r["CB1"], r["CB3"], r["NC2"], r["NC3"], r["QR2"], r["EV5"], r["outcome"]) == ("indeterminate", "indeterminate", "indeterminate", "indeterminate", "not_applicable", "not_applicable", "not_ready")


def test_sources(spark, tmp_path):
    (tmp_path / "legacy.json").write_text(json.dumps({"contracts": {"a": {"filename": "a.pdf", "pages": [{"page": 1, "text": "x"}]}}, "claims": {"b": {"filename": "b.pdf"}}}))
    got = {r["document_id"]: r["section"] for r in tables.id_map_json(spark, str(tmp_path / "legacy.json")).collect()}
    assert got == {"a": "contracts", "b": "claims"}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "f" / "b.txt").write_text("one\n\ntwo")
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in tables.sniffed_files(spark, str(tmp_path / "f")).collect()}
    assert kinds == {"a.bin": "pdf", "b.txt": "text"}
    assert [(r["page_number"], r["text"]) for r in tables.text_files(spark, str(tmp_path / "f" / "b.txt")).collect()] == [(1, "one\n\ntwo")]
    assert tables.live(spark.createDataFrame([(1, None), (2, "x")], "k int, deleted_at string")).count() == 1


def test_chunks_keep_what_paragraphs_end_in(spark, tmp_path):
    """Paragraphs lose spaces alone, not the digits of their number; U+0001 cuts long ones. Held against the SQL."""
    rows = [(0, "0 begins\n\n1 of 1\n\n 2 ends in 2 \n\n" + "word " * 500), (1, ("left \x01 right. " * 200).strip()), (2, "10\n\n" * 800)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.load()
    got = sorted(tuple(r) for r in registry.QUERIES["d10_chunks"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLES["d10_chunks"]).fetchall())
    assert got[0][2] == "0 begins\n\n1 of 1\n\n2 ends in 2"


def test_chunks_overlap(spark):
    sentences = [f"Sentence number {i} of the long document says something plain." for i in range(80)]
    rows = [(1, " ".join(sentences)), (2, "short"), (3, None), (4, " "), (5, "x" * 5000), (6, "\n\n".join(sentences))]
    got = {}
    for r in D.chunks(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id").orderBy("doc_id", "sequence").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert set(got) == {1, 2, 5, 6} and got[2] == ["short"]
    for k in (1, 6):
        assert all(len(c) <= 1400 for c in got[k]) and all(any(s in c for c in got[k]) for s in sentences)
        for a, b in zip(got[k], got[k][1:]):
            tail = b.split("\n\n")[0]
            assert a.endswith(tail) and tail in a[-150:]


def test_items_within_documents(spark):
    docs = spark.createDataFrame([(1, "He said: one two  three four five six seven"), (2, "one two three four five six"), (3, "xone two"), (4, None), (5, "one two")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "two three four five six seven"), (2, "One Two"), (3, " ")], "item_id int, text string")
    assert sorted(map(tuple, D.containing(docs, items).collect())) == [(1, 1), (1, 2), (2, 2), (5, 2)]


def test_services(spark, tmp_path):
    assert [tuple(r) for r in services.skeleton(spark, "CLAUSES = {'1.1': 'Definitions', 'x': 'no'}\nraise SystemExit", "s.py").collect()] == [("1.1", "Definitions", 1)]
    with pytest.raises(KeyError):
        services.rendered("{missing}", {})
    types = [(d, k, e) for d, k, e in (("application/pdf", "pdf", True), ("application/pdf", "text", False), (None, "zip", True), ("TEXT/CSV; charset=x", "text", True), ("x/y", "pdf", False))]
    df = spark.createDataFrame(types, "declared string, kind string, want boolean")
    assert all(r[0] == r[1] for r in df.select(services.compatible(F.col("declared"), F.col("kind")), "want").collect())


def test_rows_of_a_hot_key_are_numbered_in_spans(spark):
    places = [None, *range(-7, 30, 2)]
    rows = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in places], "k string, i int")
    got = sorted(map(tuple, R.numbered(rows, "k", "i", span=5).collect()), key=repr)
    assert got == sorted([(k, i, n + 1) for k in ("a", None, "b") for n, i in enumerate(places)], key=repr)


def test_word_bounds_are_ascii_as_in_sql(spark):
    from ledgerwood.operators import headings as H

    texts = ["plain page", "see Höref: 12 and so on", "plain", "Tabät stands here", "an éclaim, we refer to it", "the reclaim"]
    pages = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "page long, bundle string, text string")
    want = duckdb.sql("SELECT i FROM (SELECT unnest(range(0, 6)) AS i, unnest(?) AS t) WHERE " + " OR ".join(f"regexp_matches(t, '{p}')" for p in H.STARTS), params=[texts]).fetchall()
    got = H.bundle_split(pages, "bundle", "page").orderBy("first_page").collect()
    assert [r["first_page"] for r in got] == sorted({0, *[r[0] for r in want]}) == [0, 1, 3]
    assert got[2]["kind"] == "claim_letter"  # after an accented letter the word claim begins


def test_share_of_letters_is_exact(spark):
    from ledgerwood.operators import knowledge as K

    # 55 letters of 100: not under 0.55, though 0.55 * 100 is more than 55 as a double.
    rows = [(1, "ab1" * 10 + "a" * 35 + "1" * 35), (2, "ab1" * 10 + "a" * 34 + "1" * 36)]
    chunks = spark.createDataFrame([(i, t, "e", 1, "1.1", "s") for i, t in rows], "chunk_id long, text string, edition string, page_number int, clause_number string, source_document string")
    assert [tuple(r) for r in K.hits(chunks, "e").collect()] == [(2, "malformed_chunk")]
    out, left, last = K.validated(chunks, "e")
    assert [tuple(r) for r in out.collect()] == [(2, "malformed_chunk", 1)] and [r["chunk_id"] for r in left.collect()] == [1] and last.collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_theta_join_meets_all_of_a_contract(spark):
    from ledgerwood.plans import relations

    sf = "/root/testdata/sf0.01"
    want = duckdb.sql(f"SELECT count(*), sum(l_orderkey * 7 + l_linenumber + p_partkey) FROM '{sf}/lineitem.parquet' JOIN '{sf}/part.parquet' ON p_partkey % 500 = l_partkey % 500 AND p_size % 10 IN (0, l_suppkey % 10) AND p_partkey % 3 IN (0, l_linenumber % 3)").fetchall()[0]
    assert tuple(relations.j13_theta(spark, sf).selectExpr("count(*)", "sum(l_orderkey * 7 + l_linenumber + p_partkey)").first()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_claims_are_dealt_by_their_number(spark, monkeypatch):
    from ledgerwood.plans import analytics as A

    sf = "/root/testdata/sf0.001"
    names = ["g04_notice_compliance", "a25_deadline_tallies", "a19_completeness"]
    usual = [getattr(A, n)(spark, sf).collect() for n in names]
    monkeypatch.setattr(C, "CLAIMS_PER_TASK", 100)
    monkeypatch.setattr(R.parts_of, "__defaults__", (500,))
    for n, want in zip(names, usual, strict=True):
        got = getattr(A, n)(spark, sf)
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_claims_are_dealt_below_the_sessions_partitions(spark, monkeypatch):
    """With 200 partitions that the planner may join, no claims' join or aggregate is left to it."""
    registry.load()
    monkeypatch.setattr(C, "CLAIMS_PER_TASK", 100)
    monkeypatch.setattr(R.parts_of, "__defaults__", (500,))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for name in ["g04_notice_compliance", "a25_deadline_tallies", "g13_screening", "g14_outcome", "g16_checklist", "g17_notice_register"]:
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
            assert "REPARTITION_BY_NUM" in plan and ", 200), ENSURE_REQUIREMENTS" not in plan and not re.search(r"BroadcastHashJoin \[l_orderkey", plan), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_matches_are_handed_on_a_few_at_a_time():
    import re

    import pyarrow as pa

    from ledgerwood.operators import spans as P

    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["a " * 250, None, "b c"])], names=["k", "t"])
    made = list(P.matches(iter([batch]), {"w": (re.compile(r"\w+"), None), "b": (re.compile("b"), None)}, "id", 100))
    assert [b.num_rows for b in made] == [100, 100, 53]
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["id"], r["kind"], r["n"], r["start"]) for r in rows] == [(7, "w", i, 2 * i) for i in range(250)] + [(9, "w", 0, 0), (9, "w", 1, 2), (9, "b", 0, 0)]


def test_working_days_are_counted_without_a_list(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=a), dt.date(2024, 1, 1) + dt.timedelta(days=b)) for a in range(-9, 9) for b in range(-20, 30)]
    days = spark.createDataFrame(rows, "a date, b date")
    free = F.array(*[F.lit(x).cast("date") for x in ("2024-01-06", "2024-01-03", "2024-01-03", "2023-12-29")])
    got = days.select("a", "b", V.count_days(F.col("a"), F.col("b"), True).alias("n"), V.count_days(F.col("a"), F.col("b"), True, free).alias("h"))
    out = {dt.date(2024, 1, 3), dt.date(2023, 12, 29)}

    def walked(a, b, holidays=()):
        own = [min(a, b) + dt.timedelta(days=k + 1) for k in range(abs((b - a).days))]
        return sum(d.weekday() < 5 and d not in holidays for d in own) * (1 if b >= a else -1)

    assert [(r["n"], r["h"]) for r in got.collect()] == [(walked(r["a"], r["b"]), walked(r["a"], r["b"], out)) for r in got.collect()]
    far = spark.createDataFrame([(dt.date(1, 1, 1), dt.date(9999, 12, 31), None)], "a date, b date, c date")
    assert tuple(far.select(V.count_days(F.col("a"), F.col("b"), True), V.count_days(F.col("a"), F.col("c"), True)).first()) == (2608614, None)
    assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_folded_before_the_lines_meet_them(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 19 + "Some  quoted\ttext of a source, which goes on."), (2, None), (3, "y" * 30)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 3, 2), (2, 5, 2), (3, 3, 7)], "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    registry.load()
    found = registry.QUERIES["j18_quotation"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 3, True, True), (1, 4, True, True), (1, 5, True, False), (2, 3, False, False), (2, 5, False, False), (3, 3, False, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Join")].count("regexp_replace") <= 2  # those of the quotation


def test_theta_join_makes_no_pair_to_drop(spark, tmp_path, monkeypatch):
    from ledgerwood.plans import relations

    rng = random.Random(13)
    odd = lambda f: None if rng.random() < 0.1 else f()
    lines = [(odd(lambda: rng.randrange(99)), odd(lambda: rng.choice([7, 507, -3, 12])), odd(lambda: rng.randint(-15, 15)), odd(lambda: rng.randint(-4, 4))) for _ in range(600)]
    parts = [(odd(lambda: rng.choice([7, 1007, 2507, -3, -503, 12])), odd(lambda: rng.randint(-12, 12))) for _ in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    # A contract of some 200 notices is dealt in parts of about 40.
    monkeypatch.setattr(relations, "NOTICES_PER_TASK", 40)
    made = relations.j13_theta(spark, str(tmp_path))
    got = sorted(map(repr, map(tuple, made.collect())))
    assert got and got == sorted(map(repr, con.execute(registry.ORACLES["j13_theta"]).fetchall()))
    # All conditions are keys of the join that meets notices and requirements: no condition stands after them.
    last = re.search(r"SortMergeJoin \[(.*?)\], \[(.*?)\], Inner(.*)", made._jdf.queryExecution().executedPlan().toString())
    assert last and "," not in last[3] and [re.sub(r"#.*", "", c.strip()) for c in last[1].split(",")] == ["contract", "kind", "part"]
    assert made.rdd.getNumPartitions() == 600 // 40 + 1

import datetime

import pytest
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.functions import text
from tessera.operators import analytics, chunking, filters, html_tables, insider, planning, rendering, retrieval, sections, tables, transcripts, understanding
from tessera.plans import index
from tessera.plans.search import Search, search
from tessera.sources import files
from tessera.streaming import ingest


def value(spark, column, **given):
    row = spark.range(1)
    for name, x in given.items():
        row = row.withColumn(name, F.lit(x))
    return row.select(column.alias("v")).first()["v"]


def words(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


def brute_pack(parts, target, overlap):
    done, cur, size = [], [], 0
    for p in parts:
        n = len(p.split())
        if n > target:  # one sentence here: a chunk of its own
            done += [cur, [p]]
            cur, size = [], 0
            continue
        if cur and size + n > target:
            done.append(cur)
            kept, total = [], 0
            for q in reversed(cur):
                if not overlap or total + len(q.split()) > overlap:
                    break
                kept.insert(0, q)
                total += len(q.split())
            cur, size = kept, total
        cur, size = [*cur, p], size + n
    return ["\n\n".join(c) for c in [*done, cur] if c]


@pytest.mark.parametrize("overlap", [0, 12])
def test_packing(spark, overlap):
    parts = [words(n, chr(97 + k)) for k, n in enumerate([5, 9, 3, 30, 2, 8, 8, 1, 19])]
    got = value(spark, chunking.pack(chunking.paragraphs(F.col("t")), 20, overlap=overlap), t="\n".join([*parts, "", "  "]))
    assert got == brute_pack(parts, 20, overlap)


def test_blocks_keep_tables_whole(spark):
    t = "one\n two \n\n \nthree\n[TABLE: a]\nr  1\n\nr 2\n[/TABLE] tail\nmore\n\n[TABLE: open\nx"
    assert value(spark, chunking.blocks(F.col("t")), t=t) == ["one two", "three", "[TABLE: a]\nr  1\n\nr 2\n[/TABLE]", "tail more", "[TABLE: open\nx"]
    assert value(spark, chunking.blocks(F.col("t")), t=None) == []


def test_chunks_of_sections(spark):
    table = "[TABLE: t]\nhead\n" + "\n".join(f"r{i} x" for i in range(9)) + "\n[/TABLE]"
    long = " ".join(f"{words(7, 's')}." for _ in range(6))
    t = f"{words(10, 'a')}\n\n{words(5, 'b')}\n\n{table}\n\n{words(4, 'c')}\n\n{long}\n\n{words(3, 'd')}"
    got = value(spark, chunking.pack_chunks(chunking.blocks(F.col("t")), 16, overlap=6, table_size=12), t=t)
    assert got[0]["text"] == words(10, "a") + "\n\n" + words(5, "b")
    tables = [c for c in got if c["text"].startswith("[TABLE: t]\nhead\n")]
    assert [c["continues"] for c in tables] == [False, True, True] and got[1:4] == tables
    assert got[4]["text"] == words(4, "c") and [len(c["text"].split()) for c in got[5:8]] == [14, 14, 14]
    assert " ".join(c["text"] for c in got[5:8]) == long and got[8]["text"] == words(3, "d") and len(got) == 9
    assert value(spark, chunking.target_size(F.col("t")), t="Item 8") == 800 and value(spark, chunking.target_size(F.col("t")), t="Item 99") == 1000


def brute_chars(text, most):
    if len(text) <= most:
        return [text]
    done, cur, size = [], [], 0
    for p in (p.strip(" ") for p in text.split("\n")):
        if not p:
            continue
        pieces = [(x, len(x), k == 0) for k, x in enumerate(p.replace(". ", ".\0").split("\0"))] if len(p) + 2 > most else [(p, len(p) + 2, False)]
        for x, n, opens in pieces:
            if opens or size + n > most:
                if cur:
                    done.append("\n\n".join(cur))
                cur, size = [], 0
            cur.append(x)
            size += n
    return [*done, "\n\n".join(cur)]


@pytest.mark.parametrize("most", [20, 60, 100, 1000])
def test_split_by_characters(spark, most):
    t = "\n".join([words(3, "a"), ". ".join(words(n, "b") for n in (4, 2, 9, 1, 30)) + ".", "", words(8, "c"), words(8, "d") + ". e"])
    assert value(spark, chunking.split_by_chars(F.col("t"), most), t=t) == brute_chars(t, most)


def test_sentences_and_tables(spark):
    assert value(spark, chunking.sentences(F.col("t")), t="One. Two! Three? Four 1.5 five") == ["One.", "Two!", "Three?", "Four 1.5 five"]
    whole = "[TABLE: t]\nhead row\n" + "\n".join(f"r{i} x" for i in range(5)) + "\n[/TABLE]"
    parts = value(spark, chunking.split_table(F.col("t"), 9), t=whole)
    assert [p["is_continuation"] for p in parts] == [False, True, True]
    assert all(p["text"].startswith("[TABLE: t]\nhead row\n") and p["text"].endswith("\n[/TABLE]") for p in parts)
    assert value(spark, chunking.split_table(F.col("t"), 3), t="[TABLE: t]\n[/TABLE]")[0]["text"] == "[TABLE: t]\n[/TABLE]"


def test_text_functions(spark):
    assert value(spark, text.custom_id(F.col("t")), t="Item 7, R&D (new)/x") == "Item-7-R-and-D-new-x"
    assert value(spark, text.canonical_section(F.col("t")), t=" Item-1A &  more ") == "item 1a and more"
    assert value(spark, text.display_width(F.col("t")), t="**bold** _it_ x") == len("bold it x")
    assert value(spark, text.parse_date(F.col("t")), t="03/31/2024") == datetime.date(2024, 3, 31)
    assert value(spark, text.parse_date(F.col("t")), t="soon") is None
    assert str(value(spark, text.parse_decimal(F.col("t")), t="1,234.5")) == "1234.5000"
    assert value(spark, text.parse_decimal(F.col("t")), t="") is None
    assert value(spark, text.n_words(F.col("t")), t="  ") == 0
    assert value(spark, text.safe_name(F.col("t")), t="Q1 2024 (final).pdf") == "Q1_2024_final_pdf"
    assert value(spark, text.preview(F.col("t"), 3), t="abcd") == "abc..."


def test_understanding(spark):
    kind = lambda q: value(spark, understanding.classify(F.col("q")), q=q)
    assert kind("hello there")["kind"] == "default" and kind("hello there")["confidence"] == 0.5
    assert kind("What was total revenue in Q2?")["kind"] == "exact_metric"
    assert kind("explain the strategy")["kind"] == "conceptual"
    assert kind("Who is the CEO of Acme Holdings?")["kind"] == "entity"
    assert value(spark, understanding.expand(F.col("q")), q="FCF and cash flow risk")[0] == "free cash flow"
    given = {"acronyms": {"FCF": "free cash flow"}, "synonyms": {"risk": ["exposure", "uncertainty"], "cash flow": ["liquidity"]}}
    assert value(spark, understanding.expand(F.col("q"), **given), q="FCF and cash flow risk") == ["free cash flow", "exposure", "uncertainty", "liquidity"]
    assert value(spark, understanding.expand(F.col("q"), {}, {}), q="FCF and cash flow risk") == []
    assert len(lexicon.ACRONYMS) >= 163 and len(lexicon.SYNONYMS) >= 57 and len(lexicon.SECTION_WEIGHTS) >= 73 and lexicon.ACRONYMS["M&A"] == "mergers and acquisitions"
    assert value(spark, understanding.text_query(F.col("q"), understanding.expand(F.col("q"))), q="EPS") == 'EPS OR "earnings per share"'
    refs = value(spark, understanding.temporal_refs(F.col("q")), q="Q2 2024 and FY23 against 2021")
    assert [(r["year"], r["quarter"], r["kind"]) for r in refs] == [(2023, None, "fiscal"), (2024, None, "calendar"), (2021, None, "calendar"), (2024, 2, "quarter")]
    attached = lambda q: [tuple(r) for r in value(spark, understanding.temporal_refs(F.col("q")), q=q)]
    assert attached("Q3 of FY24") == [(2024, 3, "fiscal")] and attached("Q3") == [] and attached("2022 Q4 and Q1 2023") == [(2022, None, "calendar"), (2023, 4, "calendar"), (2023, 1, "quarter")]
    period = lambda t: tuple(value(spark, understanding.fiscal_period(F.col("t")), t=t))
    assert [period(t) for t in ("FY25", "fy2025Q3", "Q3FY25", "2025")] == [(2025, None), (2025, 3), (2025, 3), (None, None)]
    assert tuple(value(spark, understanding.quarter_range(F.lit(2024), F.lit(1)))) == (datetime.date(2024, 1, 1), datetime.date(2024, 3, 31))


def test_tables(spark):
    row = lambda *cells: value(spark, tables.readable(F.array(*map(F.lit, cells))))
    assert row("Cash", "Cash", "", "$", "1,200", "%") == "Cash  $1,200  %"
    assert row("A", "", "A") == "A  A"
    assert row("", " ") == ""
    assert row("$", "n/a") == "$  n/a"
    assert value(spark, tables.classify(F.lit("Balance sheet"), F.lit("total assets"))) == "financial_statement"
    assert value(spark, tables.classify(F.lit(""), F.lit("words"))) == "other"
    assert value(spark, tables.markdown(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit(" x ")))))== "| a | b\\|c |\n| --- | --- |\n| x |  |"


def test_sections(spark):
    body = words(40)
    filing = f"Item 1. Business\nItem 1A. Risk Factors\nItem 1. Business\n{body}\nItem 1A. Risk Factors\n{body} more\nItem 2. Properties\nshort"
    texts = spark.createDataFrame([(1, filing), (2, None)], "doc_id long, text string")
    best = sections.longest_sections(texts, sections.headers(texts, "doc_id", "text"), "doc_id", "text")
    assert {(r["key"], r["content"].strip()) for r in best.collect()} == {("Item 1", body), ("Item 1A", f"{body} more")}


def test_filters(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b'c"), (3, "d")], "x int, y string")
    assert filters.where(frame, {"y": ["b'c", "d"], "x": 2}).count() == 1
    assert filters.where(frame, {"y": []}).count() == filters.where(frame, None).count() == 3
    with pytest.raises(ValueError):
        filters.where(frame, {"z": 1})
    assert filters.given_only(a="", b=0, c="x") == {"c": "x"}


FORM = """<?xml version="1.0"?><!DOCTYPE x><ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Doe Jo</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-02-01</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>1,000</value></transactionShares><transactionPricePerShare><value>12.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>500</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_form4(spark):
    xml = """<?xml version="1.0"?><!DOCTYPE x><ownershipDocument><issuer><issuerName>Acme</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerName> Ann </rptOwnerName></reportingOwnerId>
    <reportingOwnerRelationship><isDirector>1</isDirector><isTenPercentOwner>true</isTenPercentOwner></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>
    <nonDerivativeTransaction><securityTitle><value>Common</value><footnoteId id="F1"/></securityTitle><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>1,000.5</value></transactionShares></transactionAmounts></nonDerivativeTransaction>
    <nonDerivativeTransaction><securityTitle><value>No date</value></securityTitle></nonDerivativeTransaction>
    <nonDerivativeTransaction><transactionDate><value>20240103</value></transactionDate><transactionAmounts><transactionPricePerShare><value>2</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>
    <nonDerivativeHolding><securityTitle><value>Held</value></securityTitle></nonDerivativeHolding></nonDerivativeTable>
    <derivativeTable><derivativeTransaction><securityTitle><value>Option</value></securityTitle><conversionOrExercisePrice><value>7.5</value></conversionOrExercisePrice><transactionDate><value>01/04/2024</value></transactionDate><transactionCoding><transactionCode>M</transactionCode></transactionCoding><ownershipNature><directOrIndirectOwnership><value>I</value></directOrIndirectOwnership></ownershipNature></derivativeTransaction></derivativeTable></ownershipDocument>"""
    forms = spark.createDataFrame([(1, xml), (2, "<ownershipDocument/>"), (3, "no form"), (4, None)], "id long, xml string")
    rows = {(r["derivative"], r["nth"]): r for r in insider.parse_form4(forms, "id", "xml").collect()}
    assert set(rows) == {(False, 0), (False, 2), (True, 0)} and {r["owner"] for r in rows.values()} == {"Ann"}
    plain, bare, option = rows[False, 0], rows[False, 2], rows[True, 0]
    assert (plain["security"], plain["code"], float(plain["shares"]), plain["price"], plain["sign"]) == ("Common", "S", 1000.5, None, "A")
    assert (bare["security"], bare["code"], bare["shares"], float(bare["price"]), str(bare["date"])) == ("", "", 0, 2.0, "2024-01-03")  # fields stay with their transaction
    assert (option["security"], float(option["price"]), option["ownership"], str(option["date"])) == ("Option", 7.5, "D", "2024-01-04")
    read = insider.read_form4(forms, "id", "xml")
    assert [(r["id"], r["security"], r["shares"], r["ownership"], r["nature"]) for r in insider.holdings(read, "id").collect()] == [(1, "Held", 0, "D", "")]
    filed = {r["id"]: r for r in insider.filings(read, "id").collect()}
    assert (filed[1]["issuer"], filed[1]["is_director"], filed[1]["is_ten_percent_owner"], filed[1]["role"]) == ("Acme", True, False, "Director") and filed[2]["owner"] == ""
    assert value(spark, insider.role(F.lit(""), F.lit(True), F.lit(True), F.lit(False))) == "Officer, Director"
    assert value(spark, insider.code_name(F.lit("Q"))) == "Other (Q)" and value(spark, insider.code_name(F.lit("K"))) == "Equity Swap"


def test_merges(spark):
    old = spark.createDataFrame([("Item-1A", "old"), ("Item 2", "old")], "section string, text string")
    new = spark.createDataFrame([("item 1a", "new"), ("Item 3", "new")], "section string, text string")
    assert {tuple(r) for r in planning.merge_sections(old, new, "section").collect()} == {("Item 2", "old"), ("item 1a", "new"), ("Item 3", "new")}
    assert [r["section"] for r in planning.missing(old, new, "section").collect()] == ["Item 2"]
    assert {tuple(r) for r in analytics.upsert(old, new, "section").collect()} >= {("Item-1A", "old"), ("item 1a", "new")}
    assert value(spark, planning.token_limit(F.lit(800), F.lit(10_000), 1.5)) == 2250


def test_packing_context_and_neighbours(spark):
    chunks = spark.createDataFrame([("s", i, f"t{i}" * 10) for i in range(5)], "section string, pos int, text string")
    hits = spark.createDataFrame([("s", 0, 1), ("s", 3, 2)], "section string, pos int, hit_rank int")
    around = retrieval.neighbours(hits, chunks, "section", "pos")
    assert sorted((r["hit_rank"], r["pos"]) for r in around.collect()) == [(1, 0), (1, 1), (2, 2), (2, 3), (2, 4)]
    packed = retrieval.pack_context(chunks.withColumnRenamed("pos", "rank"), 12)
    assert [r["rank"] for r in packed.orderBy("rank").collect()] == [0, 1]


def test_index_and_search(spark, tmp_path):
    texts = spark.createDataFrame([("a", "h1", "apples and pears\nred apples"), ("b", "h2", "pears alone"), ("c", "h3", "trucks")], "path string, hash string, text string")
    chunks, manifest = index.index_changed(texts, spark.createDataFrame([("b", "h2"), ("c", "old")], "path string, hash string"), target=3)
    assert {r["path"] for r in chunks.collect()} == {"a", "c"} and manifest.count() == 3
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert rows["h1_0"]["next_chunk_id"] == "h1_1" and rows["h1_1"]["prev_chunk_id"] == "h1_0" and rows["h1_1"]["is_section_end"]
    vector = list(rows["h1_1"]["vector"])
    found = search(chunks, Search("red apples", k=2), vector).collect()
    assert found[0]["chunk_id"] == "h1_1"
    assert [r["chunk_id"] for r in search(chunks, Search("apples", mode="text", rerank=True, k=1), given={"path": "a"}).collect()] == ["h1_1"]
    assert search(chunks, Search("apples", mode="text", postfilter=True), given={"path": "c"}).count() == 0


def test_feedback_round_trip(spark, tmp_path):
    at = str(tmp_path / "log")
    row = ("2024-01-01T00:00:00", "X", None, "q", "hybrid", "trend", 2, "q", 0, [(0.123456, "10-K", "2024", "Item 1", "p" * 300)] * 12, None, None)
    rating = ("2024-01-01T00:00:01", "X", "user_feedback", "q", *[None] * 6, 5, [1])
    files.log_searches(spark.createDataFrame([row, rating], files.FEEDBACK), at)
    (got,) = files.feedback(spark, at).collect()
    assert len(got["top_results"]) == 10 and got["top_results"][0]["preview"] == "p" * 200 + "..." and got["top_results"][0]["score"] == 0.1235
    query = ingest.feedback_windows(spark, at).writeStream.format("memory").queryName("fb").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["mode"], r["searches"], r["low_results"]) for r in spark.sql("select * from fb").collect()] == [("hybrid", 1, 1)]


def test_files_questions_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "q.md").write_text("---\nsection: Risk\nsources: sec\n---\n## Q1.1\n**Depth:** deep\n**Question:** Why?\n**Answer:** Because.\n---\n## Q1.2\n<!-- **Question:** no -->\n**Question:** How?\n---\n## Q1.3\nnothing\n")
    read = files.texts(files.files(spark, str(folder)))
    found = files.questions(read).orderBy("id").collect()
    assert [(r["id"], r["depth"], r["status"], r["question"], r["answer"]) for r in found] == [("Q1.1", "deep", "pending", "Why?", "Because."), ("Q1.2", "medium", "pending", "How?", None)]
    read.select("path", "hash", "text").write.parquet(str(tmp_path / "texts"))
    stream = spark.readStream.schema("path string, hash string, text string").parquet(str(tmp_path / "texts"))
    ingest.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
    assert files.manifest(spark, str(tmp_path / "none")).count() == 0


def test_to_fetch(spark):
    rows = [("X", "10-K", datetime.date(2020 + k, 1, 1), f"a{k}") for k in range(5)]
    offered = spark.createDataFrame(rows, "ticker string, filing_type string, filing_date date, accession string")
    known = spark.createDataFrame([("a4",)], "accession string")
    assert sorted(r["accession"] for r in files.to_fetch(offered, known).collect()) == ["a2", "a3"]
    assert sorted(r["accession"] for r in files.to_fetch(offered, known, start="2021-01-01", end="2022-12-31").collect()) == ["a1", "a2"]


def test_page_tables(spark):
    page = "<div>Intro</div><p>Lead &amp; more</p><table><tr><td>a<td>b</tr><tr><td>1</td><td></td></tr><tr><td> </td></tr></table>tail<table><tr><td>x</td></tr></table><div style='display:none'><p>gone</p></div>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<table>")], "id long, html string")
    text = {r["id"]: r["text"] for r in pages.select("id", html_tables.parse(F.col("html"))["text"].alias("text")).collect()}
    assert text == {1: "Intro\nLead & more\n[TABLE: Lead & more]\na  b\n1\n[/TABLE]\ntail\nx", 2: "", 3: ""}
    found = html_tables.page_tables(pages, "id", "html")
    assert [(r["position"], r["n_rows"], r["n_cols"]) for r in found.orderBy("position").collect()] == [(0, 2, 2), (1, 1, 1)]
    chunks = spark.createDataFrame([(1, "[TABLE: Lead & more]\na\n[/TABLE]"), (1, "plain")], "id long, text string")
    assert sorted((r["has_table"], r["table_kind"]) for r in html_tables.mark_chunks(chunks, found, "id").collect() if r["has_table"]) == [(True, "other")]


def test_rendering(spark):
    parts = lambda t: tuple(value(spark, rendering.answer_parts(F.col("t")), t=t))
    assert parts("Answer.\n## Confidence: HIGH\n**Missing information:** none.") == ("high", None)
    assert parts("no headings") == ("medium", None)
    assert parts("Confidence: low\nMissing information: the 2023 report") == ("low", "the 2023 report")
    assert value(spark, rendering.sub_queries(F.col("t")), t='```json\n["a", "b"]\n```') == ["a", "b"]
    assert value(spark, rendering.sub_queries(F.col("t")), t="sorry") == []
    assert value(spark, rendering.fiscal_year_end(F.col("t")), t="FY") == "FY"
    facts = '<ix:hidden><ix:nonNumeric name="dei:DocumentFiscalYearFocus" x="1">2024</ix:nonNumeric></ix:hidden>'
    assert tuple(value(spark, rendering.fiscal_facts(F.col("t")), t=facts)) == ("2024", None, None)
    files_ = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(30)))], "id long, text string")
    (row,) = rendering.excerpt(files_, "id", "text", F.lit("line 12"), lines=7).collect()
    assert row["excerpt"].split("\n") == [f"line {i}" for i in range(7, 14)]
    text = "# " + "x " * 80 + "\n- " + "word " * 30 + "\n| " + "c " * 80
    wrapped = value(spark, rendering.wrap(F.col("t"), 40), t=text).split("\n")
    assert wrapped[0].startswith("# x") and wrapped[-1].startswith("| c") and all(len(x) <= 40 for x in wrapped[1:-1]) and wrapped[2].startswith("  word")


def brute_wrap(text, width):
    """Words of long lines, filled greedily; headings, tables, rules and code stay."""
    out, code = [], False
    for line in text.split("\n"):
        code ^= line.lstrip().startswith("```")
        if code or len(line) <= width or line.lstrip().startswith(("#", "|", "```", "---")):
            out.append(line)
            continue
        hang = len(line) - len(line.lstrip()) + (2 if line.lstrip()[:2] in ("- ", "* ") else 0)
        cur = line[: len(line) - len(line.lstrip())]
        filled = False
        for word in line.split():
            if filled and len(cur) + 1 + len(word) > width:
                out.append(cur)
                cur, filled = " " * hang, False
            cur, filled = cur + (" " if filled else "") + word, True
        out.append(cur)
    return "\n".join(out)


@pytest.mark.parametrize("width", [20, 80])
def test_wrapping(spark, width):
    long = words(30, "word")
    t = "\n".join(["# " + long, "short", long, "- " + long, "  * " + long, "| " + long, "```", long, "```", "", "---" + long, "x" * 100, "a " + "y" * 100 + " b"])
    got = value(spark, rendering.wrap(F.col("t"), width), t=t)
    assert got == brute_wrap(t, width)
    assert value(spark, rendering.wrap(F.col("t"), width), t=None) is None


def test_duplicates_and_upserts(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "id long, k string")
    assert {r["id"]: r["first_id"] for r in analytics.exact_duplicates(rows, F.col("k"), "id").collect()} == {3: 1, 1: 1, 2: 2, 5: 2, 4: 4}
    new = spark.createDataFrame([(7, "a"), (8, "a")], "id long, k string")
    assert {(r["id"], r["k"]) for r in analytics.upsert(rows.where("k is not null and id <> 3"), new, "k", F.desc("id")).collect()} == {(8, "a"), (4, "b")}


def test_changed_files_replace_their_chunks(spark, tmp_path):
    files_ = spark.createDataFrame([("a", "h2"), ("b", "h"), ("c", "h")], "path string, hash string")
    known = spark.createDataFrame([("a", "h1"), ("b", "h")], "path string, hash string")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("z", 0)], "path string, n int")
    assert sorted(map(tuple, index.without_changed(chunks, files_, known).collect())) == [("b", 0), ("z", 0)]
    assert files.manifest(spark, str(tmp_path / "none")).collect() == []


def test_transcript(spark):
    call = "Acme (ACME)\nParticipants\nAnn Lee - CEO\nBob O'Neil - Analyst\nPresentation\nintro\nAnn Lee\nhello\nPage 2\nthere\nQuestions and Answers\nBob O'Neil\nwhy?\nAnn Lee\nbecause"
    calls = spark.createDataFrame([(1, call), (2, None)], "id long, text string")
    blocks = transcripts.speaker_blocks(calls, "id", "text").orderBy("block").collect()
    assert [(r["part"], r["name"], r["title"], r["text"].replace("\n\n", "\n")) for r in blocks] == [("presentation", "Ann Lee", "CEO", "hello\nthere"), ("qa", "Bob O'Neil", "Analyst", "why?"), ("qa", "Ann Lee", "CEO", "because")]


BOTH_LAYOUTS = """Acme (ACME)
Presentation
....... 4
Call Participants
EXECUTIVES
Ann B. User
Chief Executive Officer
and President
Bob O'Neil - Chief Financial Officer
Page 2
ANALYSTS
Cy Lee
Dee Ray, Morgan Research LLC
Presentation
Operator
Welcome.
Ann B. User
Chief Executive Officer and President
Hello.

There.
Eve Nobody
is not listed.
Question and Answer
Cy Lee
Why?
Bob O'Neil
Because."""


def test_both_layouts_of_participants(spark):
    calls = spark.createDataFrame([(1, BOTH_LAYOUTS)], "id long, text string")
    people = {(r["name"], r["title"], r["role"]) for r in transcripts.participants(calls, "id", "text").collect()}
    assert people == {("Ann B. User", "Chief Executive Officer and President", "executive"), ("Bob O'Neil", "Chief Financial Officer", "executive"), ("Cy Lee", None, "analyst"), ("Dee Ray", "Morgan Research LLC", "analyst")}
    blocks = transcripts.speaker_blocks(calls, "id", "text").orderBy("block").collect()
    assert [(r["part"], r["name"], r["text"]) for r in blocks] == [
        ("presentation", "Operator", "Welcome."), ("presentation", "Ann B. User", "Hello.\n\nThere.\nEve Nobody\nis not listed."), ("qa", "Cy Lee", "Why?"), ("qa", "Bob O'Neil", "Because."),
    ]
    assert "Exchange" not in transcripts.speaker_blocks(calls, "id", "text")._jdf.queryExecution().executedPlan().toString()


def test_metadata_and_sections_of_reports(spark):
    pages = [["Goldman Sachs\nNYSE: ACME\nMarch 5, 2024\nWe reiterate Overweight; price target: $1,250.50"], ["J.P. Morgan Equity Research (ABC)\n5 March 2024 strong-buy PT 30"], ["nothing"], None]
    found = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, p array<string>").select("k", transcripts.report_metadata(F.col("p")).alias("m")).orderBy("k").collect()
    assert [(r["m"]["firm"], r["m"]["ticker"], str(r["m"]["date"]), r["m"]["rating"], r["m"]["price_target"]) for r in found] == [
        ("Goldman Sachs", "ACME", "2024-03-05", "Overweight", 1250.5), ("J.P. Morgan", "ABC", "2024-03-05", "Strong Buy", 30.0), (None, None, "None", None, None), (None, None, "None", None, None),
    ]
    long = "Words of the section that make it long enough to be kept, and some more words to be on the safe side of it."
    report = spark.createDataFrame([(1, [f"Cover\nNear-term catalysts\n{long}\nSector Outlook\n{long}\n2. Leadership\n{long}\nRisky words that start no section\nValuation\nshort"])], "id int, pages array<string>")
    assert {(r["title"], r["page"]) for r in transcripts.report_sections(report, "id", "pages").collect()} == {("Catalysts", 1), ("Industry", 1), ("Management", 1)}


def test_headers_without_a_dot(spark):
    text = "Item 1 - Business\na\nItem 1A Risk Factors\nb\nItem 7 of this report says more about the matter, and so on.\nItem 7\nItem 8: Data\nItem 9 Changes in Accountants."
    found = sections.headers(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("start").collect()
    assert [r["key"] for r in found] == ["Item 1", "Item 1A", "Item 7", "Item 8"]
    assert chunking.target_size(F.lit("x")) is not None and value(spark, chunking.target_size(F.lit("Compensation Discussion and Analysis"))) == 1200


def test_captions_by_place(spark):
    page = "<h2>Item 8. Data</h2><p>Near title</p><table><tr><td>a<td>b<tr><td>1<td>2</table><p>one</p><p>two</p><p>three</p><div>four</div><div>five</div><div>six</div><table title='Attr title'><tr><td>a<td>b<tr><td>1<td>2</table>"
    found = html_tables.page_tables(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h").orderBy("position").collect()
    assert [(r["caption"], r["title"], r["section"]) for r in found] == [("Near title", "Untitled table", "Item 8. Data"), ("Table 2", "Attr title", "Item 8. Data")]


def test_conditions(spark):
    assert filters.fiscal("FY25") == {"fiscal_year": 2025} and filters.fiscal("q3fy2024") == {"fiscal_year": 2024, "fiscal_quarter": 3} and filters.fiscal("Q1FY24Q2") == {"fiscal_year": 2024, "fiscal_quarter": 2}
    assert filters.fiscal("2024") == filters.fiscal(None) == {}
    assert filters.content_kind(False, "metrics") == {"content_type": "table", "table_type": "metrics"} and filters.content_kind(False) == {"content_type": "text"} and filters.content_kind() == {}
    assert filters.doc_types(["transcripts", "no such", "sec"]) == ["transcript", "10-K", "10-Q", "8-K", "DEF 14A"] and filters.doc_types([]) == []
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    assert [(r["n"], r["score"]) for r in filters.by_id(chunks, "b").collect()] == [(2, 1.0)] and filters.by_id(chunks, "z").collect() == []
    assert [r["n"] for r in filters.by_ids(chunks, spark.createDataFrame([("a",), ("a",), ("x",)], "chunk_id string")).collect()] == [1]


def test_days_of_results(spark):
    days = ["2023-12-31", "2024", "2024-02-01", "", None, "soon", "2024-06-30", "2025-01-01", "2024-03-03", "2024-03-04", "2024-03-05"]
    results = spark.createDataFrame(list(enumerate(days)), "rank int, filing_date string")
    kept = lambda *a: [r["rank"] for r in filters.between(results, *a).orderBy("rank").collect()]
    assert kept("2024-02-02", "2024-06-30") == [1, 5, 6, 8, 9] and kept(None, "2023-12-31", 9) == [0, 5]


def test_questions_to_run(spark):
    asked = spark.createDataFrame([(k, s) for k, s in enumerate(["pending", "answered", "error", "needs_deeper"])], "id int, status string")
    ids = lambda **o: sorted(r["id"] for r in filters.runnable(asked, **o).collect())
    assert ids() == [0] and ids(retry_errors=True) == [0, 2] and ids(retry_errors=True, retry_needs_deeper=True) == [0, 2, 3] and len(ids(retry_errors=True, sample=1)) == 1
    filed = spark.createDataFrame([("10-K", "2023-02-01", "a"), ("10-K", "2024-02-01", "b"), ("8-K", "2025-01-01", "c")], "filing_type string, filing_date string, accession string")
    assert filters.latest_matching(filed, "10-K").first()["accession"] == "b" and filters.latest_matching(filed, "10-K", "2023-02-01").first()["accession"] == "a"


def test_prompts_and_notes(spark):
    assert value(spark, rendering.section_prompt(F.lit("high"), F.lit(None).cast("string"))) == rendering.PROMPTS["high"]
    assert value(spark, rendering.section_prompt(F.lit("odd"), F.lit("x"))) == rendering.PROMPTS["medium"] + "\n\nFor this section: x"
    assert value(spark, rendering.marked_note(F.col("t"), "**Fiscal"), t="a\n**Fiscal year** ends\nin June\n\nmore") == "**Fiscal year** ends\nin June"
    assert value(spark, rendering.marked_note(F.col("t"), "**Fiscal", 10), t="x **Fiscal year") == "**Fiscal y"
    assert value(spark, rendering.marked_note(F.col("t"), "none"), t="text") == ""
    assert "Question: why?" in value(spark, rendering.user_message(F.lit("ACME"), F.lit("ctx"), F.lit("why?")))


def test_results_as_json(spark):
    import json

    rows = spark.createDataFrame([(1, 2, "8-K", None, "s", 0.5, "t2", False, "<x>", "c"), (1, 1, "10-K", "2024", "s", 0.7, "t1", True, "<x>", "c")], "q int, rank int, filing_type string, filing_date string, section string, score double, text string, has_table boolean, table_html string, table_caption string")
    (row,) = rendering.results_json(rows, "q", "rank", {"query": F.lit("why"), "top_k": F.lit(5)}).collect()
    got = json.loads(row["json"])
    assert (got["query"], got["top_k"], got["result_count"]) == ("why", 5, 2) and [r["text"] for r in got["results"]] == ["t1", "t2"]
    assert got["results"][0]["table_html"] == "<x>" and got["results"][1]["table_html"] is None


def test_summaries_are_read_again(spark):
    parts = [("k", "Item 1", "Business: all of it", "high", "one\n\ntwo", False), ("k", "Item 2", "Properties", "low", "# no head", True), ("k", "Item 7", "MD&A", "high", "", False)]
    text = rendering.summary(spark.createDataFrame(parts, "key string, section string, title string, weight string, summary string, truncated boolean"), "key", F.lit("# Acme 10-K"))
    got = rendering.read_summary(text, "key", "text").orderBy("at").collect()
    assert [(r["head"], r["section"], r["title"], r["weight"], r["truncated"]) for r in got] == [("Acme 10-K", "Item 1", "Business: all of it", "high", False), ("Acme 10-K", "Item 7", "MD&A", "high", False), ("Acme 10-K", "Item 2", "Properties", "low", True)]
    assert got[0]["summary"] == "one\n\ntwo" and got[1]["summary"] == ""


def test_tables_for_a_corpus(spark):
    assert value(spark, tables.corpus_label(F.lit("Director Option Awards"), F.lit(""))) == "compensation" and value(spark, tables.corpus_label(F.lit("x"), F.lit("<td>2024"))) == "comparison" and value(spark, tables.corpus_label(F.lit("x"), F.lit("y"))) == "other"
    page = "<p>before</p><table><tr><th colspan=2>a<th>b</tr><tr><td>1<td>2<td>3</tr></table><p>after</p>"
    read = value(spark, html_tables.parse(F.col("t")), t=page)
    assert read["tables"][0]["rows"] == [["a", "", "b"], ["1", "2", "3"]]
    shown = spark.createDataFrame([(page,)], "t string").select(html_tables.parse(F.col("t")).alias("p")).select(tables.with_markdown(F.col("p.text"), F.col("p.tables")).alias("v")).first()["v"]
    assert shown == "before\n| a |  | b |\n| --- | --- | --- |\n| 1 | 2 | 3 |\nafter"


def test_records_and_index_tables(spark, tmp_path):
    chunks = spark.createDataFrame([("t", "transcript", None, 3)], "text string, doc_type string, fiscal_year int, chunk_index int")
    row = index.records(chunks).first()
    assert (row["filing_type"], row["fiscal_year"], row["chunk_index"], row["prev_chunk_id"], row["content_type"]) == ("transcript", 0, 3, None, "text") and '"doc_type":"transcript"' in row["metadata_json"]
    at = str(tmp_path / "index")
    assert index.count(spark, at) == 0
    index.create(index.records(chunks), at)
    index.write(index.records(chunks), at)
    assert index.count(spark, at) == 2
    index.clear(spark, at)
    assert index.count(spark, at) == 0


def test_chunks_of_calls_and_reports(spark):
    call = "Acme (ACME)\nPresentation\n..... 3\nParticipants\nAnn Lee - CEO\nPresentation\nAnn Lee\nhello\nQuestions and Answers\nAnn Lee\nyes"
    blocks = transcripts.speaker_blocks(spark.createDataFrame([(1, call)], "id int, t string"), "id", "t")
    got = transcripts.speaker_chunks(blocks, "id").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["section"], r["speaker"], r["text"]) for r in got] == [(0, "presentation", "Ann Lee - CEO", "hello"), (1, "qa", "Ann Lee - CEO", "yes")]
    cut = spark.createDataFrame([(1, "Valuation", 2, "b"), (1, "Risks", 1, "a")], "id int, title string, page int, content string")
    told = spark.createDataFrame([(1, "Firm", "Buy")], "id int, firm string, rating string")
    assert [(r["chunk_index"], r["section"], r["firm"]) for r in transcripts.report_chunks(cut, told, "id").orderBy("chunk_index").collect()] == [(0, "Risks", "Firm"), (1, "Valuation", "Firm")]


def test_fetch_since(spark):
    offered = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01")], "id int, d string").selectExpr("id", "cast(d as date) as filing_date")
    known = spark.createDataFrame([("2024-02-01 10:00:00",)], "t string").selectExpr("cast(t as timestamp) as last_updated")
    assert [r["id"] for r in files.since(offered, known).collect()] == [2] and files.since(offered, known.limit(0)).count() == 2


def test_text_index(spark, tmp_path):
    from tessera.plans import text_index

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["cash flow rose", "cash", "", None, "Flow of cash and cash", "other words"])], "doc_id long, text string")
    made = text_index.create(docs, str(tmp_path / "i"))
    for query in ("cash flow", "words", "none of these", ""):
        assert made.bm25(query, 3).collect() == retrieval.bm25(docs, query, 3).collect()
    assert text_index.create(docs.limit(0), str(tmp_path / "none")).bm25("cash").collect() == []
    asked = spark.createDataFrame([(1, "cash flow"), (2, "words"), (3, "zzz")], "query_id long, query string")
    many = made.bm25_many(asked, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in many] == [(q["query_id"], r["doc_id"], r["score"]) for q in asked.collect() for r in made.bm25(q["query"], 3).collect()]


def test_vectors_for_many_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    import random

    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(60)] + [(60, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.where("vec_id % 6 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got = {}
    for r in retrieval.vector_topk_many(frame, asked, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in rows:
        if q % 6 == 0 and v:
            best = sorted(((round(sum(a * b for a, b in zip(v, w)), 6), k) for k, w in rows if w), key=lambda x: (-x[0], x[1]))[:4]
            assert sorted(got[q]) == [(n + 1, k, s) for n, (s, k) in enumerate(best)]


def test_indexes_of_filings_calls_and_reports(spark):
    body = "\n\n".join(words(40, "p") for _ in range(3))
    filing = f"Item 1. Business\n{body}\n\n[TABLE: Sales]\nhead\nrow 1\n[/TABLE]\nItem 1A. Risks\n{words(30, 'r')}\n"
    stored, chunks = index.index_filings(spark.createDataFrame([("f1", filing)], "hash string, text string"))
    assert {r["section_id"]: r["title"] for r in stored.collect()} == {"f1_Item-1": "Business", "f1_Item-1A": "Risk Factors"}
    rows = chunks.orderBy("section_id", "chunk_index").collect()
    assert [(r["section_id"], r["chunk_index"], r["content_type"], r["table_caption"], r["next_chunk_id"]) for r in rows] == [("f1_Item-1", 0, "text", "", "f1_Item-1_1"), ("f1_Item-1", 1, "table", "Sales", None), ("f1_Item-1A", 0, "text", "", None)]
    whole = {r["chunk_id"]: r["section_content"] for r in index.section_of(chunks, stored).collect()}
    assert whole["f1_Item-1_1"].startswith("p0") or body in whole["f1_Item-1_1"]
    call = "Acme (ACME)\nQ1 2024 Call\nJanuary 5, 2024\nParticipants\nAnn Lee - CEO\nPresentation\nAnn Lee\nhello\nQuestions and Answers\nAnn Lee\nyes"
    spoken = index.index_calls(spark.createDataFrame([("c1", call)], "hash string, text string")).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["ticker"], r["filing_date"], r["next_chunk_id"]) for r in spoken] == [("c1_0", "ACME", "2024-01-05", "c1_1"), ("c1_1", "ACME", "2024-01-05", None)]
    page = "Morgan Stanley Research\nNYSE: ACME\nRating: Buy\nValuation\n" + words(30)
    made = index.index_reports(spark.createDataFrame([("r1", [page])], "hash string, pages array<string>"))
    (row,) = made.collect()
    assert (row["chunk_id"], row["section"], row["rating"], row["firm"], row["doc_type"]) == ("r1_0", "Valuation", "Buy", "Morgan Stanley", "analyst_report")
    assert index.records(made).first()["filing_type"] == "analyst_report"


def test_listing_inventory_and_written_texts(spark, tmp_path):
    for name, data in (("a/x.pdf", b"12"), ("a/y.pdf", b"123"), ("b/z.pdf", b"1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = files.listing(spark, {"calls": f"{tmp_path}/a/*.pdf", "reports": f"{tmp_path}/b/*.pdf"})
    assert sorted((r["source"], r["name"], r["bytes"]) for r in listed.collect()) == [("calls", "x.pdf", 2), ("calls", "y.pdf", 3), ("reports", "z.pdf", 1)]
    assert {r["source"]: (r["files"], r["bytes"]) for r in files.inventory(listed).collect()} == {"calls": (2, 5), "reports": (1, 1), None: (3, 6)}
    files.write_texts(spark.createDataFrame([("q1", "# a\n\nb"), ("q2", "c")], "path string, text string"), str(tmp_path / "out"))
    back = files.texts(files.files(spark, f"{tmp_path}/out/path=*/*.txt")).select("path", "text").collect()
    assert sorted(r["text"].strip("\n") for r in back) == ["# a\n\nb", "c"]

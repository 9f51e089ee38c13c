"""Readers over small files."""

import json
import zipfile
from datetime import date

import pytest

from ledgerline.sources import filings, tables
from ledgerline.streaming.ingest import advance, ingest


def test_master_index_skips_noise_and_repeats(spark, tmp_path):
    good = "123|Corp|4|2026-06-15|edgar/data/123/0000000123-26-000001.txt"
    bad = ["header", "x|Corp|4|2026-06-15|edgar/data/1/0000000001-26-000001.txt", "1|Corp|4|soon|edgar/data/1/0000000001-26-000002.txt", "1|Corp|4|2026-06-15|etc/passwd", "1|2|3|4"]
    (tmp_path / "m.idx").write_text("\n".join([*bad, good, good.replace("Corp", "Other")]))
    rows = filings.read_master_index(spark, str(tmp_path / "m.idx")).collect()
    assert [(r["cik"], r["company"], r["filing_date"]) for r in rows] == [("0000000123", "Corp", date(2026, 6, 15))]


XML = """<?xml version="1.0"?><ownershipDocument><documentType>4</documentType><issuer><issuerCik>1</issuerCik><issuerName>Corp</issuerName>
<issuerTradingSymbol>abc</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Doe J</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2026-06-01-05:00</value></transactionDate>
<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares>
<transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>
<footnotes><footnote id="F1">a <b>b</b></footnote></footnotes></ownershipDocument>"""


def test_ownership_documents_and_hostile_ones(spark, tmp_path):
    (tmp_path / "0000000001-26-000001.txt").write_text(f"<SEC-DOCUMENT><TEXT><XML>{XML}</XML></TEXT>")
    (tmp_path / "0000000001-26-000002.txt").write_text("<!DOCTYPE x [<!ENTITY e 'v'>]>" + XML)
    (tmp_path / "0000000001-26-000003.txt").write_text("<ownershipDocument>" + "<a>" * 100 + "</a>" * 100 + "</ownershipDocument>")
    docs = filings.read_ownership_documents(spark, str(tmp_path))
    errors = {r["accession"]: r["error"] for r in docs.collect()}
    assert errors["0000000001-26-000001"] is None and all(errors[f"0000000001-26-00000{i}"] for i in (2, 3))
    row = filings.explode_filings(docs).collect()
    assert [(r["ticker"], r["trade_type"], r["value"], r["trade_date"]) for r in row] == [("ABC", "Buy", 25.0, date(2026, 6, 1))]


def test_bulk_submissions_pad_short_arrays(spark, tmp_path):
    recent = {"accessionNumber": ["a-1", "a-2", ""], "filingDate": ["2026-01-02", "2026-01-03"], "form": ["4", "10-K", "4"], "primaryDocument": ["x.xml"]}
    (tmp_path / "CIK0000000001.json").write_text(json.dumps({"filings": {"recent": recent}}))
    (tmp_path / "CIK0000000001-submissions-001.json").write_text(json.dumps(recent | {"accessionNumber": ["b-1"]}))
    (tmp_path / "CIK0000000002.json").write_text("not json")
    rows = filings.read_bulk_submissions(spark, str(tmp_path)).collect()
    assert sorted(r["accession"] for r in rows) == ["a-1", "b-1"]


def test_dataset_archive(spark, tmp_path):
    def tsv(table, *rows):
        head = filings.DATASET_TABLES[table].split()
        return "\t".join(head) + "\n" + "".join("\t".join(r.get(c, "") for c in head) + "\n" for r in rows)

    acc = {"ACCESSION_NUMBER": "1"}
    content = {
        "SUBMISSION": tsv("SUBMISSION", acc | {"FILING_DATE": "15-JUN-2026", "DOCUMENT_TYPE": "4", "ISSUERCIK": "7", "ISSUERTRADINGSYMBOL": "NONE"}),
        "REPORTINGOWNER": tsv("REPORTINGOWNER", acc | {"RPTOWNERCIK": "9", "RPTOWNERNAME": "Doe"}),
        "NONDERIV_TRANS": tsv("NONDERIV_TRANS", acc | {"NONDERIV_TRANS_SK": "5", "TRANS_CODE": "S", "TRANS_SHARES": "3"}, {"ACCESSION_NUMBER": "2"}),
        "DERIV_TRANS": tsv("DERIV_TRANS", acc | {"DERIV_TRANS_SK": "6", "TRANS_CODE": "M"}), "FOOTNOTES": tsv("FOOTNOTES"),
    }
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        for name, text in content.items():
            z.writestr(f"{name}.tsv", text)
    parts = filings.read_dataset(spark, filings.stage_dataset(str(tmp_path / "q.zip"), str(tmp_path / "out")))
    rows = {r["sec_row_id"]: r for r in filings.dataset_transactions(parts).collect()}
    assert rows["non-derivative:5"]["trade_type"] == "Sell" and rows["derivative:6"]["trade_type"] == "Other"
    assert rows["non-derivative:5"]["filing_date"] == date(2026, 6, 15) and rows["non-derivative:5"]["ticker"] is None
    assert [tuple(r) for r in filings.orphans(parts).collect()] == [("NONDERIV_TRANS", "2")]
    assert filings.archive_fingerprint(str(tmp_path / "q.zip")) == filings.archive_fingerprint(str(tmp_path / "q.zip"))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.tsv", "")
    with pytest.raises(ValueError):
        filings.stage_dataset(str(tmp_path / "bad.zip"), str(tmp_path / "out2"))


def test_prices(spark, tmp_path):
    quote = {"open": [1.0, None], "high": [2.0, 2.0], "low": [0.5, 1.0], "close": [1.5, 1.0], "volume": [10, 11]}
    chart = {"chart": {"result": [{"meta": {"symbol": "ABC", "exchangeTimezoneName": "America/New_York"}, "timestamp": [1717250400, 1717336800], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [1.4, 1.0]}]}}]}}
    (tmp_path / "a.json").write_text(json.dumps(chart))
    (row,) = tables.read_columnar_prices(spark, str(tmp_path / "a.json")).collect()
    assert (row["symbol"], row["price_date"], row["adjusted_close"]) == ("ABC", date(2024, 6, 1), 1.4)
    (tmp_path / "b.json").write_text(json.dumps([{"date": "2024-06-01T00:00:00Z", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3}, {"date": "2024-06-02", "open": 9, "high": 2, "low": 1, "close": 2, "volume": 3}]))
    assert [r["price_date"] for r in tables.read_row_prices(spark, str(tmp_path / "b.json"), "X").collect()] == [date(2024, 6, 1)]


def test_directories_lists_and_legacy(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "a", "title": "A"}, "1": {"cik_str": 2, "ticker": "a", "title": "B"}, "2": {"ticker": ""}}))
    assert [tuple(r) for r in tables.read_ticker_directory(spark, str(tmp_path / "t.json")).collect()] == [("A", "0000000002", "B")]
    (tmp_path / "w.txt").write_text("# list\nabc # x\n\n def\n")
    assert [r[0] for r in tables.read_watchlist(spark, str(tmp_path / "w.txt")).collect()] == ["ABC", "DEF"]
    (tmp_path / "l.json").write_text(json.dumps([{"isin": "X"}, {"official_name": "Y"}, {"ticker": "T", "insider_name": "N"}, {"z": 1}]))
    got = tables.read_legacy_json(spark, str(tmp_path / "l.json")).collect()
    assert [(r["kind"], r["error"]) for r in got] == [("european", None), ("congress", None), ("us", None), (None, "unknown record")]


def test_html_tables_and_sinks(spark, tmp_path):
    html = "<table class='t x'><tr><th>Ticker<th>Insider Name</th><th>Trade Type</th><th>Trade Date</th><th>Value</th></tr><tr><td><a href='/q'>abc</a></td><td>Doe<br>J</td><td>P - Purchase</td><td>2024-01-02</td><td>$1,000</td></tr><tr><td>short</td></tr></table>"
    pages = spark.createDataFrame([("1", html), ("2", None)], "page_id string, html string")
    # A heading cell that is not closed swallows the next: the rows have more cells than headings, and are left out.
    assert tables.html_table_rows(pages, css="t").count() == 0
    html2 = html.replace("<th>Ticker<th>", "<th>Ticker</th><th>")
    rows = tables.html_table_rows(spark.createDataFrame([("1", html2)], "page_id string, html string"), css="t")
    (trade,) = tables.screener_trades(rows).collect()
    assert (trade["ticker"], trade["value"], trade["insider_name"]) == ("ABC", 1000.0, "Doe\nJ")
    csv, js = tables.write_results(spark.range(3), str(tmp_path), "a b/../c")
    assert ".." not in csv.rsplit("/", 1)[-1].replace("_.._", "") and spark.read.json(js).count() == 3


def test_store_and_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string").coalesce(1).write.parquet(src)
    store = tables.AppendStore(spark, str(tmp_path / "store"))
    run = lambda: ingest(spark, src, "k long, v string", store, "k", str(tmp_path / "cp")).awaitTermination()
    run()
    assert store.read("rows").count() == 2
    spark.createDataFrame([(2, "z"), (3, "d")], "k long, v string").coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["k"] for r in store.read("rows").collect()) == [1, 2, 3]
    assert advance({"a": 5}, {"a": 3, "b": 1}) == {"a": 5, "b": 1}

import argparse
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.compare import assert_same
from verbascope.operators import encoders, indices, stats
from verbascope.plans import catalog, cli, reports
from verbascope.sources import files, workbooks
from verbascope.streaming.indices import follow, latest
from tests.test_indices import HITS, hits, levels


def test_workbook_round_trip(tmp_path, spark):
    lines = [["词条", "释义序号", "释义", "释义", "等级"], ["go on", 1, "old", "to <go> & \"on\"", "B1"], ["x", 2.5, None, None, None], [None, 3, "a", " b ", True]]
    path = tmp_path / "a.xlsx"
    path.write_bytes(workbooks.workbook({"one": lines, "two": [["other"], ["y"]]}))
    got = [r.asDict() for r in workbooks.read_workbook(spark, str(path), {k: workbooks.INVENTORY[k] for k in ("term", "sense_no", "definition", "level")}).orderBy("row_no").collect()]
    assert got == [
        {"row_no": 1, "term": "go on", "sense_no": "1", "definition": 'to <go> & "on"', "level": "B1"},
        {"row_no": 2, "term": "x", "sense_no": "2.5", "definition": None, "level": None},
        {"row_no": 3, "term": None, "sense_no": "3", "definition": " b ", "level": "True"},
    ]
    assert workbooks.read_inventory(spark, str(path)).where("term = 'go on'").first()["sense_no"] == "1"


SHEETS = [
    [["a", "b", "a"], ["1", None, "<x> & 'y' &amp;"], ["", " s ", "two\nlines"], [1, 2.5, -0.0], [float("inf"), 1e300, True], [None, None, None], ["é\U0001f600", "a\rb", "]]>"]],
    [["a", "b"], ["only"], [], ["x", "y", "z"]],
    [["a"]],
    [],
]


@pytest.mark.parametrize("lines", SHEETS, ids=range(len(SHEETS)))
def test_plain_sheets_read_like_any_others(monkeypatch, lines):
    """A sheet as it is written here is read without a parser, and gives what the parser gives."""
    book = workbooks.workbook({"one": lines})
    fast = list(workbooks.rows(book)), workbooks.columns_of(book, ["a", "b", "c"]) if lines else None
    called = workbooks.plain_lines(workbooks.sheet_of(map(workbooks._cell, x) for x in lines).encode())
    assert (called is None) == any("\r" in str(x) for line in lines for x in line)
    monkeypatch.setattr(workbooks, "plain_lines", lambda sheet: None)
    assert fast == (list(workbooks.rows(book)), workbooks.columns_of(book, ["a", "b", "c"]) if lines else None)
    if lines:
        assert fast[1] == [[r.get(c) for r in fast[0]] for c in "abc"]


def test_other_sheets_need_a_parser():
    plain = workbooks.sheet_of([["<c><v>1</v></c>", "<c/>"]])
    assert workbooks.plain_lines(plain.encode()) == [["1", None]]
    for a, b in (("<c/>", '<c r="B1"/>'), ("<row>", '<row r="1">'), ("<c/>", "<!-- x --><c/>"), ("1</v>", "&#49;</v>"), ("</row>", "</row><row/>"), ("<c/>", "<c><v></v></c>"), ("</sheetData>", "</sheetData><x/>")):
        assert workbooks.plain_lines(plain.replace(a, b).encode()) is None


def test_csv(tmp_path, spark):
    path = str(tmp_path / "x.csv")
    rows = indices.phrase_indices(indices.resolved(hits(spark), levels(spark)))
    reports.save_phrase_indices(rows, path)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfessay_id,total_score,n_phrases,PH_level_coverage,PH_ratio_A1") and b",nan," in raw
    assert {tuple(r) for r in files.read_indices(spark, path).collect()} == {tuple(r) for r in rows.collect()}
    files.write_indices(rows, str(tmp_path / "folder"))
    assert {tuple(r) for r in files.read_indices(spark, str(tmp_path / "folder")).collect()} == {tuple(r) for r in rows.collect()}


def test_the_last_csv_row_holds(tmp_path, spark):
    path = tmp_path / "x.csv"
    path.write_text("essay_id,a\ne,1\nf,nan\ne,2\n", encoding="utf-8-sig")
    assert {tuple(r) for r in files.read_indices(spark, str(path), "essay_id string, a double").collect()} == {("e", 2.0), ("f", None)}


def test_essays(tmp_path, spark):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xml").write_text("<r><essay><essay_id>1_A1</essay_id><paragraph>Dear Sir</paragraph><paragraph>two</paragraph><total_score>30</total_score></essay><essay><essay_id>2</essay_id><total_score>x</total_score></essay></r>")
    (tmp_path / "deep" / "b.xml").write_text("<r><essay><essay_id>1_A1</essay_id><paragraph>later</paragraph><total_score>31</total_score></essay><essay><essay_id>3</essay_id></essay></r>")
    (tmp_path / "c.txt").write_text("<essay><essay_id>9</essay_id></essay>")
    essays, broken = files.read_essays(spark, str(tmp_path))
    got = {r["essay_id"]: (r["paragraphs"], r["total_score"]) for r in essays.collect()}
    assert got == {"1_A1": (["later"], 31.0), "3": ([], None)} and broken.count() == 1


def test_phrase_command(tmp_path, spark):
    header = list(workbooks.HITS.values())
    order = ["essay_id", "phrase", "is_poly", "sense", "cefr", "pos", "total_score"]
    lines = [[r[c] for c in order] for r in hits(spark).orderBy("row_no").collect()]
    (tmp_path / "h.xlsx").write_bytes(workbooks.workbook({"h": [header, *lines]}))
    (tmp_path / "s.xlsx").write_bytes(workbooks.workbook({"s": [list(workbooks.INVENTORY.values()), ["poly", 1, "", "", "", "A1"], ["poly", 1, "", "", "", "B2"]]}))
    args = cli.parser().parse_args(["phrase-indices", "--hit-detail", str(tmp_path / "h.xlsx"), "--ambig", str(tmp_path / "s.xlsx"), "--out-indices", str(tmp_path / "i.csv"), "--out-corr", str(tmp_path / "c.csv")])
    rows = {r["essay_id"]: r for r in cli.phrase_indices(spark, args).collect()}
    assert set(rows) == {"S1_A1", "S1_A2"} and rows["S1_A1"]["PH_score_var"] == 2.5
    saved = (tmp_path / "c.csv").read_text(encoding="utf-8-sig").splitlines()
    assert saved[0] == "index,mean,sd,n,r_senseaware,p,r_v12_fixed,r_docx_v6" and len(saved) == 17
    assert saved[1] == "PH_ratio_A1,0.1250,0.1250,2,nan,nan,-0.109,-0.132"


def test_regression_command(tmp_path, spark, capsys):
    words = [f"{a}{b}" for a in "abcdef" for b in "ghij"]
    (tmp_path / "e.xml").write_text("<r>" + "".join(f"<essay><essay_id>e{i}</essay_id><paragraph>{'Dear ' if i % 2 else ''}{' '.join(words[(i * k) % 24] for k in range(1, 9))}</paragraph><total_score>{1 + i % 7}</total_score></essay>" for i in range(80)) + "</r>")
    spark.createDataFrame([(w, indices.LEVELS[k % 6]) for k, w in enumerate(words)], "word string, min_level string").write.parquet(str(tmp_path / "d"))
    lines = ["essay_id," + ",".join(indices.PHRASE_COLUMNS[1:])] + [f"e{i},1,3," + ",".join(str((i * (k + 3)) % 11 / 11) for k in range(17)) for i in range(78)]
    (tmp_path / "p.csv").write_text("\n".join(lines), encoding="utf-8-sig")
    capsys.readouterr()
    args = argparse.Namespace(essays=str(tmp_path / "e.xml"), dictionary=str(tmp_path / "d"), phrase_indices=str(tmp_path / "p.csv"), out=str(tmp_path / "w.csv"), survival=False)
    got = {r["grp"]: r for r in cli.regression(spark, args, encoders.PlainAnalyzer).collect()}
    assert "体裁分布: {'书信': 39, '议论·文章': 39}" in capsys.readouterr().out
    assert got["overall"]["n"] == 78 and got["letter"]["status"] == "ok" and 0 <= got["overall"]["r2_word"] <= got["overall"]["r2_both"] <= 1
    assert len((tmp_path / "w.csv").read_text(encoding="utf-8-sig").splitlines()) == 79


@pytest.mark.parametrize("encoder", ["tfidf", "bert", "bert_sentence", "bert_phrase"])
def test_wsd_command(tmp_path, spark, capsys, encoder):
    """The command over a workbook with text sense numbers, its console and the workbook that it writes; stand-ins for models."""
    lines = [
        list(workbooks.INVENTORY.values()), ["go on", 10, "continue an activity", "The show will go on; We go on", "They go on working", "B1"], ["go on", 2, "happen in a place", "What is going on", "Something must go on here", "B2"],
        ["go on", "2a", "light up", "The lights went on", "Lamps go on at night", "C1"], ["go on", 2, "a repeat", "x", "y", "A1"], ["alone", 1, "one sense", "x", "alone", "A1"],
    ]
    (tmp_path / "s.xlsx").write_bytes(workbooks.workbook({"s": lines}))
    args = cli.parser().parse_args(["wsd", "--encoder", encoder, "--data", str(tmp_path / "s.xlsx"), "--out", str(tmp_path / "o.xlsx")])
    details = cli.evaluate(spark, args, encoders.HashingEncoder, encoders.HashingEncoder, encoders.PlainAnalyzer)
    shown = capsys.readouterr().out
    assert details.count() == 3 and "总体 Accuracy" in shown and ("[匹配方式]" in shown) == (encoder == "bert_phrase")
    sheet = list(workbooks.rows((tmp_path / "o.xlsx").read_bytes()))
    assert [r["金标序号"] for r in sheet] == ["2", "10", "2a"] and all(r["预测序号"] in ("2", "10", "2a") for r in sheet)


def test_reports(spark):
    table = stats.correlation_table(stats.correlations(indices.phrase_indices(indices.resolved(hits(spark), levels(spark)))))
    assert "n.s." in reports.correlation_console(table) and reports.number(None, ".3f") == "nan" and reports.number(0.1235, "+.3f") == f"{0.1235:+.3f}"
    assert not math.isnan(reports.correlation_lines(table)[0][3])


@pytest.mark.parametrize("unit", ["answer", "script"])
def test_stream(tmp_path, spark, unit):
    folder = str(tmp_path / "hits")
    parts = hits(spark)
    parts.where("row_no < 4").write.mode("append").parquet(folder)
    query = follow(spark, folder, HITS, levels(spark), str(tmp_path / "live"), unit)
    try:
        query.processAllAvailable()
        parts.where("row_no >= 4").write.mode("append").parquet(folder)
        query.processAllAvailable()
        whole = indices.phrase_indices(indices.resolved(parts, levels(spark)), unit)
        assert {tuple(r) for r in latest(spark, str(tmp_path / "live")).collect()} == {tuple(r) for r in whole.collect()}
        # a score that goes missing takes its group out
        gone = parts.limit(1).selectExpr("* EXCEPT (row_no, total_score)", "999L AS row_no", "CAST(NULL AS DOUBLE) AS total_score").select(*parts.columns)
        gone.write.mode("append").parquet(folder)
        query.processAllAvailable()
        whole = indices.phrase_indices(indices.resolved(parts.union(gone), levels(spark)), unit)
        assert {tuple(r) for r in latest(spark, str(tmp_path / "live")).collect()} == {tuple(r) for r in whole.collect()}
    finally:
        query.stop()


def test_essays_of_any_characters(tmp_path, spark):
    """White space at the ends, carriage returns, controls, marks, repeated ids and missing texts come back from XML as SQL has them."""
    texts = ["a\rb", "a\r\nb", " lead", "trail ", "\n", "", "  ", "a\n\nb\n", "\t", " \n ", "\x00\x01\x0b\x1e\x7f\x85\x9f", "﻿bom", "￾￿", "%", "%41", "50 % + 1", "a+b", " ls\xa0", "<b>&amp;]]></b>", "</essay>", "null", "\U0001f600", None, "same", "same"]
    ids = [*range(len(texts) - 2), 7, 7]
    rows = {"doc_id": ids, "text": pa.array(texts, pa.string())}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert_same(catalog.source_essays(spark, str(tmp_path)), con, catalog.ORACLES["source_essays"])

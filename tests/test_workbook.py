"""Workbooks that are read and made by tasks, and the journal of model calls."""

import datetime as dt
import io
import json
import os
import re
import zipfile

import pytest

from riskflow.config import Review
from riskflow.operators import review
from riskflow.sources import ledger, sinks, workbook

SPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(sheet, shared=None, styles=None):
    """A workbook as other programs write it: shared strings, own styles, the sheet under another name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SPACE}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" sheetId="3" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="other.xml"/><Relationship Id="rId9" Target="/xl/worksheets/data.xml"/></Relationships>')
        z.writestr("xl/worksheets/data.xml", f'<worksheet xmlns="{SPACE}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SPACE}">{"".join(f"<si>{x}</si>" for x in shared)}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{SPACE}">{styles}</styleSheet>')
    return out.getvalue()


def test_foreign_workbook():
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;dm&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    sheet = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"/><row r="5"><c r="AB5" s="2"><v>7.5</v></c><c r="A5" s="1"><v>45292.5</v></c><c r="B5" t="str"><v>a&amp;b</v></c><c r="C5" t="b"><v>1</v></c></row>'
    rows = list(workbook.sheet_rows(book(sheet, ["<t>da</t>", "<r><t>am</t></r><r><t> ount</t></r>"], styles)))
    assert rows[0] == (2, ["da", None, "am ount"], ["s", None, "s"]) and rows[1][0] == 5 and len(rows) == 2
    assert rows[1][1][:3] == ["2024-01-01 12:00:00", "a&b", "1"] and rows[1][2][:3] == ["d", "s", "b"] and (rows[1][1][27], rows[1][2][27]) == ("7.5", "n")


@pytest.mark.parametrize("rows", [3, 1000])
def test_round_trip(spark, tmp_path, rows):
    day = dt.datetime(2024, 2, 29, 13, 45, 7)
    data = [(f"id{k}", 1.5 * k, k, day + dt.timedelta(days=k), day.date(), k % 2 == 0, [None, "", "a<b>&\x01 c", " é\n汉 "][k % 4]) for k in range(10)] + [(None,) * 7, ("last", *(None,) * 6)]
    df = spark.createDataFrame(data, "id string, x double, n int, t timestamp, d date, b boolean, `odd name` string").repartition(2)
    made = workbook.write_workbooks(df, str(tmp_path / "w"), rows)
    assert len(made) >= (4 if rows == 3 else 1)
    got = workbook.read_workbook(spark, str(tmp_path / "w"))
    assert got.dtypes == [("id", "string"), ("x", "double"), ("n", "double"), ("t", "timestamp"), ("d", "timestamp"), ("b", "boolean"), ("odd name", "string")]
    clean = lambda x: re.sub("\x01", "", x) or None if isinstance(x, str) else x  # noqa: E731  an empty text is an empty cell or text
    want = [(r[0], r[1], r[2], r[3], r[4] and dt.datetime(2024, 2, 29), r[5], clean(r[6])) for r in data if any(v is not None for v in r)]
    assert sorted(((*r[:6], r[6] or None) for r in map(tuple, got.collect())), key=str) == sorted(want, key=str)


def test_several_workbooks_with_columns_in_another_order(spark, tmp_path):
    a, b = (spark.createDataFrame([row], names) for row, names in (((1, "x"), "n int, s string"), (("y", 2.0, "z"), "s string, n double, more string")))
    workbook.write_workbooks(a, str(tmp_path / "a"))
    os.rename(tmp_path / "a" / "part-00000-00000.xlsx" if os.path.exists(tmp_path / "a" / "part-00000-00000.xlsx") else next((tmp_path / "a").glob("*.xlsx")), tmp_path / "1.xlsx")
    workbook.write_workbooks(b, str(tmp_path / "b"))
    os.rename(next((tmp_path / "b").glob("*.xlsx")), tmp_path / "2.xlsx")
    got = workbook.read_workbook(spark, str(tmp_path / "*.xlsx"))
    assert sorted(map(tuple, got.collect())) == [(1.0, "x"), (2.0, "y")]
    assert ledger.load_statement(spark, str(tmp_path / "2.xlsx")).columns == ["s", "n", "more"]


def test_empty_table_and_limit(spark, tmp_path):
    none = spark.createDataFrame([], "a string, b int")
    assert sinks.write_excel(none, str(tmp_path / "e")) == ["part-00000-00000.xlsx"]
    got = workbook.read_workbook(spark, str(tmp_path / "e"))
    assert got.columns == ["a", "b"] and got.count() == 0
    with pytest.raises(ValueError):
        sinks.write_excel(spark.range(20), str(tmp_path / "x"), limit=10)


def counting(at):
    class Counting:  # in here, so that tasks get it by value
        """Notes each call in a folder; fails for what stands in its file ``bad``, and leaves out what stands in ``silent``."""

        def generate(self, prompt):
            ids = re.findall(r'"txn_id":"(\w+)"', prompt)
            with open(f"{at}/calls", "a") as f:
                f.write(" ".join(ids) + "\n")
            listed = lambda name: open(f"{at}/{name}").read().split() if os.path.exists(f"{at}/{name}") else []  # noqa: E731, SIM115
            if set(ids) & set(listed("bad")):
                raise RuntimeError("no line")
            return json.dumps({"transactions": [{"txn_id": i, "risk_level": "yellow"} for i in ids if i not in listed("silent")]})

    return Counting


def test_journal(spark, tmp_path):
    at = str(tmp_path)
    rows = lambda n: spark.createDataFrame([(f"t{k}", float(k), "text") for k in range(n)] + [("t1", 1.0, "text")], "txn_id string, amount double, purpose string")
    client, s = counting(at), Review(batch_size=1, attempts=3, pause=(0.0, 0.01))
    (tmp_path / "bad").write_text("t3")
    (tmp_path / "silent").write_text("t4")
    calls = lambda: (tmp_path / "calls").read_text().split()
    got = review.journalled_replies(rows(8), f"{at}/journal", client, s, waves=3).collect()
    assert sorted(r["txn_id"] for r in got) == sorted([*(f"t{k}" for k in range(8)), "t1"])
    assert {r["txn_id"] for r in got if r["llm_risk_level"] is None} == {"t3", "t4"}
    assert sorted(calls()) == sorted([*(f"t{k}" for k in range(8)), "t3", "t3"])  # equal payloads once, failures three times
    (tmp_path / "bad").write_text("")
    (tmp_path / "silent").write_text("")
    before = len(calls())
    got = review.journalled_replies(rows(10), f"{at}/journal", client, s, waves=3).collect()
    assert sorted(calls()[before:]) == ["t3", "t4", "t8", "t9"] and all(r["llm_risk"] == 0.6 for r in got) and len(got) == 11
    review.journalled_replies(rows(10), f"{at}/journal", client, s, waves=3).collect()
    assert len(calls()) == before + 4  # nothing is asked again
    review.journalled_replies(rows(1), f"{at}/journal", client, s, prompt="another prompt", waves=3).collect()
    assert len(calls()) == before + 6


def test_rate_and_error_rows(spark, tmp_path):
    (tmp_path / "bad").write_text("t0")
    df = spark.createDataFrame([("t0", 1.0), ("t1", 2.0)], "txn_id string, amount double").coalesce(1)
    got = {r["txn_id"]: r for r in review.replies(df, counting(str(tmp_path)), Review(batch_size=1, attempts=2, pause=(0.0, 0.0)), per_second=20).collect()}
    assert got["t0"]["notes_for_audit"] == "no line" and got["t0"]["llm_risk"] is None and got["t1"]["llm_risk"] == 0.6

"""IO4 workbooks, and J11 / J12 / IO8 corrections of a stored table."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusgauge.sources import upsert as UP
from corpusgauge.sources import workbooks as WB


def test_rater_workbooks_equal_the_long_table(spark, tmp_path):
    rows = {"A": [["C1", "Negative", "Anger"], ["C2", None, " Grief "], ["C3", "  ", "a <b> & \"c\"\nd"]],
            "B": [["C1", "Positive", None], ["C2", "কষ্ট", "😀"]]}
    for rater, body in rows.items():
        extra = [["n", "comment_id", "emotion", "note", "polarity"]] + [[i, r[0], r[2], "x", r[1]] for i, r in enumerate(body)]
        extra.insert(2, [7, None, None, "only a note", None])
        (tmp_path / f"annotator_{rater}.xlsx").write_bytes(WB.workbook_bytes(extra, "Annotate"))
    got = sorted(tuple(r) for r in WB.read_rater_workbooks(spark, str(tmp_path / "*.xlsx")).collect())
    assert got == sorted((rater, r[0], (r[1] or "").strip(), (r[2] or "").strip()) for rater, body in rows.items() for r in body)


def sheet(cells: str, shared: str | None = None, name="Annotate", target="/xl/worksheets/other.xml") -> bytes:
    """A workbook written by hand, the wanted sheet second."""
    main = WB.MAIN[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{WB.REL_ID[1:-3]}"><sheets><sheet name="Guide" r:id="a"/>'
                                      f'<sheet name="{name}" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{WB.PACKAGE_REL[1:].split("}")[0]}"><Relationship Id="a" Target="worksheets/sheet1.xml"/>'
                                                 f'<Relationship Id="b" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')
    return out.getvalue()


def test_kinds_of_cells(spark):
    shared = "<si><t>comment_id</t></si><si><t>p</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si>"
    cells = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row>'
             '<row r="3"><c r="AB3" t="s"><v>2</v></c><c r="A3"><v>12</v></c></row>'
             '<row><c r="A4" t="b"><v>1</v></c><c r="AB4" t="str"><f>A1</f><v>formula</v></c></row>'
             '<row r="9"><c r="A9" t="e"><v>#N/A</v></c><c r="AB9"/></row><row r="10"><c r="A10"><v>1.5</v></c></row>')
    files = spark.createDataFrame([("f", bytearray(sheet(cells, shared)))], "path string, content binary")
    got = [tuple(r) for r in WB.workbook_rows(files, "Annotate", ["p", "comment_id"]).collect()]
    assert got == [("f", 3, "two runs", "12"), ("f", 4, "formula", "True"), ("f", 10, None, "1.5")]
    assert WB.workbook_rows(files.limit(0), "Annotate", ["p"]).count() == 0
    for bad in (sheet(cells, shared, name="Other"), b"no archive", sheet("")):
        wrong = spark.createDataFrame([("name.xlsx", bytearray(bad))], "path string, content binary")
        with pytest.raises(Exception, match="name.xlsx"):
            WB.workbook_rows(wrong, "Annotate", ["p"]).collect()


def test_many_rows_are_dealt_over_workbooks(spark):
    rows = spark.range(500).select(F.lit("dir/annotator_A.xlsx").alias("path"), F.col("id").cast("string").alias("comment_id"), F.lit("x").alias("p"))
    books = WB.workbooks(rows, "path", "comment_id", ["comment_id", "p"], "S", per_book=100)
    assert books.count() == 5
    assert {r["comment_id"] for r in WB.workbook_rows(books, "S", ["comment_id"]).collect()} == {str(i) for i in range(500)}


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, i % 3 if i != 7 else None, ["train", "val", "test", None][i % 4], f"text {i}") for i in range(40)] + [(3, 0, None, "again")]
    spark.createDataFrame(rows, "id long, v int, split string, t string").write.partitionBy("split").parquet(path)
    return path


def state(spark, path):
    return sorted(((r["id"], r["v"], r["split"], r["t"]) for r in spark.read.parquet(path).collect()), key=str)


def fixes(spark, rows):
    return spark.createDataFrame(rows, "id long, old int, new int")


def test_only_touched_partitions_are_rewritten(spark, table):
    before, times = state(spark, table), {tuple(r) for r in UP.file_times(spark, table).collect()}
    done = UP.correct_partitions(spark, table, fixes(spark, [(4, 1, 9), (8, 2, 8), (7, None, 5), (3, 0, 6), (None, 0, 0)]), "id", "v", ["split"])
    assert (done.n_fixes, done.n_applied, done.n_rows) == (4, 5, 21) and done.partitions == [("train",), (None,)]
    new = {4: 9, 8: 8, 7: 5, 3: 6}
    assert state(spark, table) == sorted(((i, new.get(i, v), s, t) for i, v, s, t in before), key=str)
    kept = times & {tuple(r) for r in UP.file_times(spark, table).collect()}
    assert {p.split("split=")[1].split("/")[0] for p, _ in kept} == {"val", "test"}
    # again: the rows hold the new values already
    again = UP.correct_partitions(spark, table, fixes(spark, [(4, 1, 9), (8, 2, 8)]), "id", "v", ["split"])
    assert again.n_applied == 2 and state(spark, table) == sorted(((i, new.get(i, v), s, t) for i, v, s, t in before), key=str)


def test_a_failed_precondition_changes_nothing(spark, table):
    before, times = state(spark, table), UP.file_times(spark, table).collect()
    for rows, said in (([(4, 0, 9), (8, 2, 8)], "another value"), ([(4, 1, 9), (1000, 1, 2)], "without a row"), ([(4, 1, 9), (4, 1, 8)], "twice")):
        with pytest.raises(ValueError, match=said):
            UP.correct_partitions(spark, table, fixes(spark, rows), "id", "v", ["split"])
        assert state(spark, table) == before and sorted(UP.file_times(spark, table).collect()) == sorted(times)
    done = UP.correct_partitions(spark, table, fixes(spark, [(4, 0, 9), (8, 2, 8), (1000, 1, 2)]), "id", "v", ["split"], strict=False)
    assert done.n_applied == 1 and sum(r[1] == 8 for r in state(spark, table)) == 1
    assert UP.correct_partitions(spark, table, fixes(spark, []), "id", "v", ["split"]).partitions == []

"""Readers, writers and retention."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.session import fresh_path
from brindle.sources import files, tables


def workbook(sheet, strings=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        if strings:
            z.writestr("xl/sharedStrings.xml", strings)
    return out.getvalue()


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_shared_strings_gaps_and_header(spark):
    strings = f"<sst {NS}><si><t>Name</t></si><si><t>Rate</t></si><si><t>City</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>"
    sheet = (
        f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="n"><v>2024</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="C3" t="inlineStr"><is><t>Rome</t></is></c></row></sheetData></worksheet>'
    )
    df = spark.createDataFrame([("b.xlsx", bytearray(workbook(sheet, strings)))], "path string, content binary")
    rows = files.sheet_rows(df)
    assert files.header_rows(rows).first()["header_row"] == 1
    assert [tuple(r) for r in files.sheet_table(rows).collect()] == [("Anna", None, "Rome")]


def test_no_header_means_row_zero(spark):
    sheet = f'<worksheet {NS}><sheetData><row r="1"><c><v>1</v></c></row><row r="2"><c><v>2</v></c></row></sheetData></worksheet>'
    df = spark.createDataFrame([("b.xlsx", bytearray(workbook(sheet)))], "path string, content binary")
    assert files.header_rows(files.sheet_rows(df)).first()["header_row"] == 0


def book_of(rows, names=None):
    styles = f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    cells = "".join("<row>" + "".join(r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/styles.xml", styles)
        for name in names or ["sheet1"]:
            z.writestr(f"xl/worksheets/{name}.xml", f"<worksheet {NS}><sheetData>{cells if name == (names or ['sheet1'])[-1] else ''}</sheetData></worksheet>")
        if names:
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets><sheet name="first" r:id="r9"/><sheet name="other" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r1" Target="worksheets/{names[0]}.xml"/><Relationship Id="r9" Target="worksheets/{names[-1]}.xml"/></Relationships>')
    return bytearray(out.getvalue())


def text_cells(*values):
    return [f'<c t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else "<c/>" for v in values]


def test_each_workbook_has_its_own_header_dates_and_booleans(spark):
    one = book_of([text_cells("Key", "City", "Since"), [*text_cells("1", "Oslo"), '<c s="1"><v>45292.5</v></c>']])
    two = book_of([text_cells("City", "Key", "City", None), [*text_cells("Rome", "2", "x"), '<c t="b"><v>1</v></c>']], ["sheet1", "sheet2"])
    df = spark.createDataFrame([("a.xlsx", one), ("b.xlsx", two)], "path string, content binary")
    table = files.sheet_table(files.sheet_rows(df))
    assert table.columns == ["Key", "City", "Since", "City_2", "column_3"]
    assert sorted(map(tuple, table.collect())) == [("1", "Oslo", "2024-01-01 12:00:00", None, None), ("2", "Rome", None, "x", "true")]


def test_quotes_and_line_breaks_in_csv(spark):
    rows = [(1, 'say "hi", you'), (2, "two\nlines, really"), (3, " kept ")]
    path = fresh_path(spark, "quoted") + ".csv"
    df = spark.createDataFrame(rows, "k int, v string")
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert sorted((int(r["k"]), r["v"]) for r in files.read_csv(spark, path).collect()) == rows


def test_readers_refuse(spark):
    path = fresh_path(spark, "empty") + ".csv"
    spark.createDataFrame([], "a string").write.csv(path, header=True)
    with pytest.raises(ValueError):
        files.read_table(spark, path)
    with pytest.raises(ValueError):
        files.read_table(spark, "table.pdf")


def test_decoding(spark):
    rows = [("u", bytearray("é".encode())), ("l", bytearray("é".encode("latin-1"))), ("b", bytearray(b" \n"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert {r["path"]: r["text"] for r in files.text_documents(df).collect()} == {"u": "é", "l": "é"}


def test_stored_schema_wins(spark):
    path = fresh_path(spark, "frozen")
    first = spark.createDataFrame([("1", "2.5")], "Key string, Rate string")
    schema = tables.create_table(first, path)
    assert [f.dataType.simpleString() for f in schema] == ["string", "bigint", "double", "timestamp", "string"]
    again = tables.create_table(spark.createDataFrame([("x",)], "Key string"), path)
    assert [f.name for f in again] == [f.name for f in schema]


def test_retention(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-03-02",), ("2024-05-30",)], "d string")
    kept = tables.retained(df, "d", 3, F.lit("2024-05-31"))
    assert [r["d"] for r in kept.orderBy("d").collect()] == ["2024-03-02", "2024-05-30"]


def test_admission(spark):
    rows = [("", 1, "no_name"), ("a" * 300 + ".txt", 1, "name_too_long"), ("a.txt", 60 * 1024 * 1024, "too_large"), ("a.exe", 1, "bad_type"), ("../b/c.TXT", 1, "ok")]
    df = spark.createDataFrame(rows, "n string, s bigint, e string")
    got = df.select(files.admission(F.col("n"), F.col("s")).alias("a"), "e").select("a.*", "e").collect()
    assert all(r["verdict"] == r["e"] for r in got) and got[-1]["safe_name"] == "_b_c.TXT"


PLAIN_CSV = 'k,v\r\n1,"a ""quoted"" word"\r\n2,"x, y"\r\n\r\n3,\r\n4,plain\r\n'


@pytest.mark.parametrize("text, breaks", [
    (PLAIN_CSV, False), (PLAIN_CSV + '5,"two\nlines"\n', True), (PLAIN_CSV + '5,"two ""q""\n""lines"""\n', True), ("k,v\n1,a\rb\n", True), ("k,v\r1,a\r2,b\r", True), ("k,v\n1,5\" pipe\n", True),
])
def test_line_breaks_in_quotes_are_found(spark, tmp_path, text, breaks):
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    assert files.has_quoted_breaks(spark, path) == breaks
    assert files.read_csv(spark, path).collect() == files.read_csv(spark, path, multi_line=True).collect()


def test_a_file_without_them_is_split(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("k,v\n" + "".join(f'{i},"row ""{i}"", whole"\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = files.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
        assert df.filter(F.col("v") != F.concat(F.lit('row "'), F.col("k"), F.lit('", whole'))).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sheets_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def parse(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    cell = lambda v: (v, True)
    rows = [("a", i, [cell(x) for x in ("one", "two", "three")] if i == 0 else [cell(str(i)), None, cell("x")]) for i in range(20)]
    parsed = spark.createDataFrame(rows, files.SHEET_ROWS).mapInPandas(lambda batches: parse(batches), files.SHEET_ROWS)
    table = files.sheet_table(parsed)
    assert table.columns == ["one", "two", "three"] and table.count() == 19
    assert {tuple(r) for r in table.collect()} == {(str(i), None, "x") for i in range(1, 20)}
    assert seen.value == 20

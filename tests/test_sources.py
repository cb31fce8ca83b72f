import io
import os
import zipfile
from decimal import Decimal

from pyspark.sql import Row

from metreur.functions.codes import safe_original_name
from metreur.plans.extract import extract_lines
from metreur.sources import bills, contract, docx, layout, manifest
from metreur.streaming.ingest import ingest_new

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None, bold=False, size=None):
    props = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size}"/>' if size else "")
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{head}<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def word_file(*parts):
    styles = "".join(
        f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>'
        for i, n in [("Titre1", "heading 1"), ("Titre2", "heading 2"), ("TM1", "toc 1")]
    )
    default = '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(parts)}</w:body></w:document>")
        archive.writestr("word/styles.xml", f"<w:styles {W}>{default}{styles}</w:styles>")
    return out.getvalue()


SPEC = word_file(
    paragraph("LOT 06 — SERRURERIE", "Titre1"),
    paragraph("3 Description des ouvrages 11", "TM1"),
    paragraph("3 Description des ouvrages", "Titre1"),
    paragraph("3.1 Garde-corps à barreaudage", "Titre2", bold=True, size=28),
    paragraph("  "),
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>"
    "<w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
)


def test_word_blocks(spark):
    files = spark.createDataFrame([("s", bytearray(SPEC)), ("bad", bytearray(b"not a zip"))], "source_id string, content binary")
    blocks, failures = docx.read_docx_blocks(files)
    rows = blocks.orderBy("pos").collect()
    assert [r["text"] for r in rows] == [
        "LOT 06 — SERRURERIE", "3 Description des ouvrages", "3.1 Garde-corps à barreaudage", "a | b | b",
    ]
    assert [r["style"] for r in rows] == ["Heading 1", "Heading 1", "Heading 2", "Table"]
    assert rows[2]["bold"] and rows[2]["font_size"] == 14.0 and not rows[1]["bold"] and rows[3]["source_kind"] == "table_row"
    assert [r["source_id"] for r in failures.collect()] == ["bad"]


def span(page, line, text, size, y, x=50.0, n=1):
    return ("pdf", page, line, n, text, size, 0, "Arial", x, float(y), x + 200, y + size, 595.0, 842.0)


SPANS = "source_id string, page int, line_no int, span_no int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def test_printed_pages(spark):
    spans = [
        span(1, 1, "BATIMENT TEST", 16.0, 70), span(1, 2, "Architecte", 12.0, 110),
        span(2, 1, "SOMMAIRE", 16.0, 60), span(2, 2, "3. DESCRIPTION DES OUVRAGES ........ 3", 11.0, 100),
        span(3, 1, "3.", 14.0, 70), span(3, 2, "DESCRIPTION DES OUVRAGES", 14.0, 70, 105.0),
        span(3, 3, "3.1", 12.0, 115), span(3, 4, "ESCALIER EXTERIEUR", 12.0, 115, 105.0),
        span(3, 5, "Epaisseur 12 mm ", 10.0, 145), span(3, 5, "et hauteur 4.1 m.", 10.0, 145, 150.0, 2),
        span(3, 6, "3.2", 12.0, 190), span(3, 7, "OPTION : GARDE-CORPS", 12.0, 190, 105.0),
    ]
    blocks = layout.read_pdf_blocks(spark.createDataFrame(spans, SPANS)).persist()
    texts = [r["text"] for r in blocks.orderBy("pos").collect()]
    assert "3.1 ESCALIER EXTERIEUR" in texts and "Epaisseur 12 mm et hauteur 4.1 m." in texts
    documents = spark.createDataFrame([("pdf", "LOT 06 SERRURERIE.pdf", ".pdf", 3)], "source_id string, original_name string, extension string, page_count int")
    found = extract_lines(documents, blocks)
    lines = {r["code"]: r for r in found.lines.collect()}
    assert lines["3.1"]["designation"] == "ESCALIER EXTERIEUR" and lines["3.1"]["quantity"] is None and lines["3.1"]["unit"] == "U"
    assert not lines["3.2"]["included"] and lines["3.1"]["source_page"] == 3
    p = found.perimeters.first()
    assert p["method"] == "explicit_anchor" and p["ignored_toc_pages"] == [2]


def test_running_headers_go(spark):
    rows = [span(p, 1, f"DCE - page {p}", 9.0, 20) for p in range(1, 6)] + [span(p, 2, f"Texte {p}", 10.0, 300) for p in range(1, 6)]
    texts = {r["text"] for r in layout.read_pdf_blocks(spark.createDataFrame(rows, SPANS)).collect()}
    assert texts == {f"Texte {p}" for p in range(1, 6)}


def sheet(rows):
    letters = "ABCDEF"
    body = "".join(
        f'<row r="{n}">' + "".join(f'<c r="{letters[i]}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row) if v) + "</row>"
        for n, row in enumerate(rows, 1)
    )
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="x" sheetId="1" r:id="rId1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_delivered_bill(spark):
    rows = [
        ("", "1.1", "titre avant", "u"), ("", "Code", "Désignation", "Unité"), ("", "2", "TRAVAUX", ""), ("", "2.1", "Marquage  au sol", ""),
        ("", "", "- A - Marquage place PMR", "u"), ("", "2.2", "Sous-total 2", "u"), ("1", "2.3", "Clôture", "ml"), ("", "2.4", "ab", "u"),
    ]
    files = spark.createDataFrame([("p", bytearray(sheet(rows))), ("q", bytearray(b"no workbook"))], "pair string, content binary")
    cells, failures = bills.read_workbook_cells(files)
    assert [r.pair for r in failures.collect()] == ["q"]
    got = [(r["ref_index"], r["code"], r["designation"], r["unit"], r["kind"]) for r in bills.read_reference_bill(cells).orderBy("ref_index").collect()]
    assert got == [
        (0, "2", "TRAVAUX", "", "section"), (1, "2.1", "Marquage au sol", "", "section"), (2, "", "A - Marquage place PMR", "u", "item"),
        (3, "2.3", "Clôture", "ml", "item"),
    ]


def test_manifest(spark, tmp_path):
    folder = tmp_path / "d1"
    folder.mkdir()
    for n in range(32):
        (folder / f"f{n:02}.docx").write_bytes(b"x")
    (folder / "note.txt").write_bytes(b"y")
    accepted, refused = manifest.read_manifest(spark, str(tmp_path))
    assert accepted.count() == 30
    assert sorted(r["reject_reason"] for r in refused.collect()) == ["count", "count", "format"]
    assert all((r["sha256"] is None) == (r["reject_reason"] == "format") for r in refused.collect())
    (folder / "f00.docx").write_bytes(b"x" * 50)
    accepted, refused = manifest.read_manifest(spark, str(tmp_path), max_bytes=10, max_documents=None)
    assert accepted.count() == 31
    assert sorted((r["reject_reason"], r["sha256"]) for r in refused.collect()) == [("format", None), ("size", None)]
    assert spark.createDataFrame([Row(p='x/a<b>:c?.pdf')]).select(safe_original_name("p")).first()[0] == "a_b__c_.pdf"


def test_output_names_are_unique_whatever_the_case(spark):
    lots = [("d", n, "", "P", "1", title) for n, title in enumerate(["Gros", "GROS", "gros", "Gros_2", "Autre"])]
    df = spark.createDataFrame(lots, "dossier_id string, lot_order int, project_reference string, project_name string, lot_code string, lot_title string")
    names = [r["lot_file"] for r in contract.output_names(df).orderBy("lot_order").collect()]
    assert names[0] == "DPGF_P_LOT_1_Gros.xlsx" and names[3] == "DPGF_P_LOT_1_Gros_2.xlsx"
    assert len({n.lower() for n in names}) == 5
    lots = [("d", n, "", "P", "1", title) for n, title in enumerate(["X", "X", "X_2", "X_3", "X_4", "x"])]
    names = [r["lot_file"] for r in contract.output_names(spark.createDataFrame(lots, df.schema)).orderBy("lot_order").collect()]
    assert names[1] == "DPGF_P_LOT_1_X_5.xlsx" and names[5] == "DPGF_P_LOT_1_x_6.xlsx" and len(set(names)) == 6
    titles = [r["sheet_title"] for r in contract.sheet_titles(df).orderBy("lot_order").collect()]
    assert titles[:3] == ["LOT 1 Gros", "LOT 1 GROS (2)", "LOT 1 gros (3)"]


def test_new_files_are_processed_once(spark, tmp_path):
    source, output, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    (source / "d1").mkdir(parents=True)
    (source / "d1" / "LOT 06 SERRURERIE.docx").write_bytes(SPEC)
    (source / "d1" / "broken.docx").write_bytes(b"zip?")
    (source / "d1" / "plan.dwg").write_bytes(b"dwg")
    (source / "d1" / "printed.pdf").write_bytes(b"%PDF")
    run = lambda: ingest_new(spark, str(source), str(output), str(state)).awaitTermination()
    run()
    lines = spark.read.parquet(str(output / "lines"))
    assert {r["code"] for r in lines.collect() if r["code"]} == {"3", "3.1"}
    messages = [r["message"] for r in spark.read.parquet(str(output / "warnings")).collect()]
    assert sum(m.startswith("Document non traité") for m in messages) == 2 and "format" in messages
    (source / "d1" / "LOT 07 AUTRE.docx").write_bytes(SPEC)
    run()
    assert spark.read.parquet(str(output / "lots")).count() == 2
    run()
    assert spark.read.parquet(str(output / "lots")).count() == 2


def test_refused_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "d1"
    folder.mkdir()
    (folder / "a.docx").write_bytes(b"x")
    (folder / "B.PDF").write_bytes(b"y")
    (folder / "note.txt").write_bytes(b"z" * 500)
    (folder / "large.docx").write_bytes(b"w" * 400)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # the reader fails on whatever larger file it opens
    try:
        accepted, refused = manifest.read_manifest(spark, str(tmp_path), max_bytes=50)
        assert sorted(r["original_name"] for r in accepted.collect()) == ["B.PDF", "a.docx"]
        assert sorted((r["original_name"], r["reject_reason"]) for r in refused.collect()) == [("large.docx", "size"), ("note.txt", "format")]
        (folder / "large.docx").unlink()
        accepted, refused = manifest.read_manifest(spark, str(tmp_path), max_bytes=None)
        assert accepted.count() == 2 and refused.count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_batches_hold_the_same_however_files_are_dealt(spark, tmp_path):
    source = tmp_path / "in"
    folder = source / "d1"
    folder.mkdir(parents=True)
    for n, name in enumerate(["LOT 06 SERRURERIE.docx", "printed.pdf", "LOT 01 VOIRIE.docx"]):
        file = folder / name
        file.write_bytes(b"%PDF" if name == "printed.pdf" else SPEC)
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    spans = [
        span(1, 1, "3.", 14.0, 70), span(1, 2, "DESCRIPTION DES OUVRAGES", 14.0, 70, 105.0), span(1, 3, "3.1", 12.0, 115), span(1, 4, "ESCALIER EXTERIEUR", 12.0, 115, 105.0),
        span(2, 1, "texte " * 60, 10.0, 145),
    ]
    path = f"file:{source}/d1/printed.pdf"
    spark.createDataFrame([(path, *s[1:]) for s in spans], SPANS.replace("source_id", "path")).write.parquet(str(tmp_path / "spans"))

    def run(name, many):
        out = tmp_path / name
        for _ in range(2):  # the second start finds nothing new
            ingest_new(spark, str(source), str(out), str(tmp_path / f"{name}-state"), many, str(tmp_path / "spans"), max_documents=2).awaitTermination()
        return {t: sorted(str(r.asDict()) for r in spark.read.parquet(str(out / t)).drop("batch").collect()) for t in ("documents", "lots", "lines", "warnings")}

    one, three = run("one", 100), run("three", 1)
    assert one == three
    rows = {r["original_name"]: r for r in spark.read.parquet(str(tmp_path / "three" / "documents")).collect()}
    assert {n: r["status"] for n, r in rows.items()} == {"LOT 06 SERRURERIE.docx": "ready", "printed.pdf": "ready", "LOT 01 VOIRIE.docx": "refused"}
    printed = rows["printed.pdf"]
    assert printed["page_count"] == 2 and printed["character_count"] > 350


def test_one_output_per_lot_is_replaced_as_a_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"lot {n % 3}.xlsx", n, f"row {n}") for n in range(1, 3001)], "lot_file string, row_no long, designation string")
    listed = contract.export_lots(rows, str(tmp_path / "o"))
    assert {r["lot_file"]: r["n"] for r in listed.groupBy("lot_file").agg({"rows": "sum"}).withColumnRenamed("sum(rows)", "n").collect()} == {f"lot {k}.xlsx": 1000 for k in range(3)}
    back = contract.read_lots(spark, str(tmp_path / "o"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    contract.export_lots(rows.where("row_no <= 30"), str(tmp_path / "o"))
    assert contract.read_lots(spark, str(tmp_path / "o"), rows.schema).count() == 30
    contract.export_lots(rows.where("false"), str(tmp_path / "o"))
    assert contract.read_lots(spark, str(tmp_path / "o"), rows.schema).count() == 0


def test_many_lots_are_written_without_a_rename_each(spark, tmp_path):
    names = [f"lot {n} é%'=.xlsx" for n in range(400)]
    rows = spark.createDataFrame([(name, n, Decimal(n) / 8, None if n % 2 else 0.5) for name in names for n in range(1, 4)], "lot_file string, row_no int, amount decimal(38,8), quantity double")
    wide = tmp_path / "o"
    listed = {r["lot_file"]: r for r in contract.export_lots(rows, str(wide)).collect()}
    assert set(listed) == set(names) and all((r["rows"], r["first_row"], r["last_row"]) == (3, 1, 3) for r in listed.values())
    back = contract.read_lots(spark, "file:" + str(wide), rows.schema)
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    # an output of its own for each lot, none of which Spark moved out of a temporary folder or wrote a checksum for
    [version] = (wide / "rows").iterdir()
    for r in listed.values():
        assert [f.name for f in (version / r["file"]).parent.iterdir()] == [os.path.basename(r["file"])]


def test_contract_reads_in_order(spark, tmp_path):
    dossiers = spark.createDataFrame([("d1", "P", "R", "C", "DCE", "", "2024")], "dossier_id string, project_name string, project_reference string, client_name string, phase string, due_date string, updated_at string")
    lots = spark.createDataFrame([("d1", "s1", "01", "VRD"), ("d2", "s2", "02", "Toiture")], "dossier_id string, source_id string, lot_code string, lot_title string")
    rows = [(s, n, f"{s}{n}", "item", 3, "1", "x", "U", 1.0, None, 1) for s in ("s1", "s2") for n in range(12000, 0, -1)]
    lines = spark.createDataFrame(rows, "source_id string, pos bigint, line_id string, kind string, level int, code string, designation string, unit string, quantity double, included boolean, source_page int")
    contract.write_contract(contract.export_contract(dossiers, lots, lines), str(tmp_path / "c"))
    got = [(r["record"], r["dossier_id"], r["pos"]) for r in spark.read.json(str(tmp_path / "c")).collect()]
    assert len(got) == 24003
    of = {d: [r for r in got if r[1] == d] for d in ("d1", "d2")}
    assert [r[0] for r in of["d1"]][:3] == ["dossier", "lot", "line"] and of["d2"][0][0] == "lot"
    assert [r[2] for r in of["d1"][2:]] == list(range(1, 12001))

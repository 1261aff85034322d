import io
import zipfile

import pytest
from factloom.sources import manifest as M
from factloom.sources.parsers import extract, parsed
from pyspark.sql import functions as F

W = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> 1</w:t></w:r></w:p><w:p/></w:body></w:document>'
TYPES = "<Types/>"


def archive(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def docx(**more) -> bytes:
    return archive(**({"[Content_Types].xml": TYPES, "word/document.xml": W} | more))


def xlsx(sheet: str, target="worksheets/s.xml", **more) -> bytes:
    parts = {
        "[Content_Types].xml": TYPES,
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Target="{target}"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>sha</t><r><t>red</t></r></si></sst>",
        "xl/worksheets/s.xml": sheet,
    }
    return archive(**(parts | more))


@pytest.mark.parametrize(
    "name, content, kind, anchors, warnings",
    [
        ("a.txt", "x\r\n\x85y".encode(), "UTF8_TEXT", [("line:1", "x"), ("line:2", ""), ("line:3", "y")], ""),
        ("a.md", b"", "UTF8_TEXT", [], ""),
        ("A.CSV", '\ufeffa,"b\n""c"\nd'.encode(), "CSV", [("R1C1", "a"), ("R1C2", 'b\n"c'), ("R2C1", "d")], ""),
        ("a.bin", docx(), "DOCX", [("word/document.xml#paragraph:1", "one 1"), ("word/document.xml#paragraph:2", "")], ""),
        (
            "a.xlsx",
            xlsx('<s><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c><c r="D1"><v>7</v></c></s>'),
            "XLSX",
            [("sheet:S1!A1", "shared"), ("sheet:S1!B1", "=1+1"), ("sheet:S1!C1", "in"), ("sheet:S1!D1", "7")],
            "SPREADSHEET_FORMULA_PRESENT_NOT_EVALUATED",
        ),
        ("a", b"Subject: hi\nMIME-Version: 1.0\n\nl1\nl2", "EML", [("header:subject", "hi"), ("part:1:line:1", "l1"), ("part:1:line:2", "l2")], ""),
        (
            "m.eml",
            b'From: a@b.test\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/html\n\n<b>\n--q\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--q\n\nyes\n--q--',
            "EML",
            [("header:from", "a@b.test"), ("part:4:line:1", "yes")],
            "EMAIL_ATTACHMENTS_NOT_RECURSIVELY_PARSED,EMAIL_HTML_NOT_RENDERED",
        ),
        ("z.zip", archive(b="1", a__c="2"), "ZIP", [("entry:1", "a/c"), ("entry:2", "b")], "ARCHIVE_CONTENT_NOT_RECURSIVELY_PARSED"),
    ],
)
def test_formats(name, content, kind, anchors, warnings):
    got = extract(content, name)
    assert (got[0], got[1], [(c, t) for _, c, t in got[2]], got[3]) == (kind, None, anchors, warnings)


@pytest.mark.parametrize(
    "name, content, code",
    [
        ("a.pdf", b"%PDF-1.4", "PDF_ADAPTER_NOT_IMPLEMENTED"),
        ("a.jpg", b"\xff\xd8\xff", "IMAGE_OCR_NOT_IMPLEMENTED"),
        ("a.xyz", b"plain", "FORMAT_UNSUPPORTED"),
        ("a.txt", b"a\0", "TEXT_NUL_REFUSED"),
        ("a.txt", b"\xff", "TEXT_NOT_UTF8"),
        ("a.csv", b'"a"b', "CSV_INVALID"),
        ("a.txt", b"x" * 10_001, "ANCHOR_TEXT_TOO_LARGE"),
        ("a.txt", b"x\n" * 10_001, "ANCHOR_LIMIT_EXCEEDED"),
        ("a.txt", (b"x" * 9000 + b"\n") * 230, "EXTRACTED_TEXT_LIMIT_EXCEEDED"),
        ("a", archive(**{"../x": "1"}), "ARCHIVE_PATH_UNSAFE"),
        ("a", archive(a="0" * 100_000), "ARCHIVE_COMPRESSION_RATIO_REFUSED"),
        ("a", docx(**{"word/vbaProject.bin": "x"}), "OOXML_ACTIVE_CONTENT_REFUSED"),
        ("a", docx(**{"[Content_Types].xml": "<T a='x.macroEnabled.y'/>"}), "OOXML_MACRO_REFUSED"),
        ("a", docx(**{"word/_rels/d.rels": "<R><Relationship Target='http://x.test'/></R>"}), "OOXML_EXTERNAL_RELATIONSHIP_REFUSED"),
        ("a", docx(**{"word/document.xml": "<!DOCTYPE x><w/>"}), "XML_ACTIVE_DECLARATION_REFUSED"),
        ("a", docx(**{"word/document.xml": "<w>"}), "XML_INVALID"),
        ("a", archive(**{"word/document.xml": W}), "OOXML_STRUCTURE_INVALID"),
        ("a", xlsx("<s/>", target="../../x.xml"), "XLSX_RELATIONSHIP_INVALID"),
        ("a", xlsx('<s><c r="A1" t="s"><v>9</v></c></s>'), "XLSX_SHARED_STRING_INVALID"),
        ("a", xlsx("<s><c/></s>"), "XLSX_CELL_INVALID"),
    ],
)
def test_refusals(name, content, code):
    got = extract(content, name)
    assert got[1] == f"PARSER_{code}" and got[2] == []


def test_parsed_files(spark):
    rows = [("1", "a.txt", b"x\ny"), ("2", "a.txt", None), ("3", "b", b"q"), ("4", None, b""), ("5", "e.txt", b"")]
    out = parsed(spark.createDataFrame(rows, "file_id string, name string, content binary").withColumn("idx", F.lit("clash")))
    got = sorted((r.file_id, r.idx, r.refusal_code, r.text) for r in out.collect())
    assert got == [("1", 1, None, "x"), ("1", 2, None, "y"), ("2", 0, "PARSER_OBJECT_UNREADABLE", None), ("3", 0, "PARSER_FORMAT_UNSUPPORTED", None), ("4", 0, "PARSER_FORMAT_UNSUPPORTED", None), ("5", 0, None, None)]


def test_manifest_and_store(spark, tmp_path):
    tree = tmp_path / "in"
    (tree / "sub").mkdir(parents=True)
    (tree / "a.txt").write_bytes(b"same")
    (tree / "sub" / "b.pdf").write_bytes(b"same")
    (tree / "sub" / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    found = M.files(spark, str(tree))
    rows = M.manifest(found, F.col("relative_path"), F.col("content")).cache()
    got = {r.relative_path: (r.extension, r.detected_media_type, r.extension_media_type_mismatch, r.size_bytes) for r in rows.collect()}
    assert got == {"a.txt": (".txt", "text/plain", False, 4), "sub/b.pdf": (".pdf", "text/plain", True, 4), "sub/c.png": (".png", "image/png", False, 8)}
    assert tuple(M.summary(rows).first()) == (3, 16) and M.summary(rows.limit(0)).first().total_bytes == 0
    assert {r.code for r in M.limit_findings(rows, max_files=2, max_depth=1).collect()} == {"FILE_COUNT_EXCEEDED", "TREE_TOO_DEEP"}
    store = str(tmp_path / "store")
    objects = found.select(F.sha2("content", 256).alias("content_sha256"), "content")
    M.store_objects(objects, store)
    M.store_objects(objects, store)
    stored = spark.read.parquet(store)
    assert stored.count() == 2 and M.store_differences(objects, stored).count() == 0
    changed = stored.withColumn("content", F.when(F.length("content") == 4, F.lit(b"evil")).otherwise(F.col("content")))
    assert [r.code for r in M.store_differences(objects, changed).collect()] == ["OBJECT_HASH_MISMATCH"]
    assert [r.code for r in M.store_differences(objects.where("length(content) = 4"), stored).collect()] == ["OBJECT_UNKNOWN"]
    assert [r.code for r in M.store_differences(objects, stored.limit(0)).collect()] == ["OBJECT_MISSING"] * 2


def test_bound_anchors(spark):
    from factloom.functions.canonical import snapshot_id
    from factloom.sources.parsers import bound_anchors

    files = spark.createDataFrame([("W", "r1", "c1"), ("W", "r2", "c2"), ("W", "r2", "c3")], "workspace_id string, raw_id string, content_sha256 string")
    out = bound_anchors(parsed(spark.createDataFrame([(r, "a.txt", b"x") for r in ("r1", "r2", "r9")], "file_id string, name string, content binary")), files)
    got = {r.file_id: r.anchor_id for r in out.collect()}
    sha = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    assert got == {"r1": snapshot_id("ANCHOR", {"content_sha256": "c1", "coordinate": "line:1", "kind": "TEXT_LINE", "raw_id": "r1", "text_sha256": sha, "workspace_id": "W"}), "r2": None, "r9": None}

"""Names, edits and document files: nulls, ties, broken files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import names as N
from lodestone.operators import edits as D
from lodestone.sources import files as W

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(body, rels=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        if rels:
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
    return out.getvalue()


def p(*texts):
    return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def test_docx():
    row = "<w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("a", "", "b")) + "</w:tr>"
    link = '<w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>x</w:t></w:r></w:p>'
    rels = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{t}" Target="https://a.org/{i}"{m}/>' for i, (t, m) in enumerate([("hyperlink", ' TargetMode="External"'), ("image", ' TargetMode="External"'), ("hyperlink", "")]))
    got = W.docx_text(docx(p("Ann", " Lee") + p(" ") + f"<w:tbl>{row}</w:tbl>" + link, rels))
    assert got == ("Ann Lee\na | b\nsite\tx", ["https://a.org/0"])


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.txt": b"one \r\n\r\n\r\n\r\n\r\ntwo\xff\n", "b.docx": docx(p("hi")), "sub/c.docx": b"no zip", "d.pdf": b"%PDF", "e": b"x", "f.txt": b" "}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in W.read_files(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in got.items()} == {"a.txt": "one\n\n\ntwo�", "b.docx": "hi", "c.docx": None, "d.pdf": None, "e": None, "f.txt": ""}
    assert {k for k, r in got.items() if r.error} == {"c.docx", "d.pdf", "e"}


@pytest.mark.parametrize("contact, text, want", [(None, None, None), ("", "", None), ("Ann Lee Ann Lee Ann Lee", "", None), ("ÉMILE\nZOLA", None, "Émile Zola"), (None, "x\nANN\nLEE", "Ann Lee")])
def test_names(spark, contact, text, want):
    df = spark.createDataFrame([(contact, text)], "c string, t string")
    assert df.select(N.person_name(F.col("c"), F.col("t")).alias("n")).first().n == want


def test_edits_in_order(spark):
    docs = spark.createDataFrame([(1, "cv", None), (2, "letter", None), (3, None, None)], f"doc_id int, kind string, source {D.STATE}")
    empty = (None,) * 9
    edits = spark.createDataFrame(
        [(1, 2, ("add_skill", "Go", *empty[1:])), (1, 1, ("set_summary", " s ", *empty[1:])), (1, 3, ("remove_skill", "go", *empty[1:])), (1, 4, ("reorder_experience", *empty)), (2, 1, ("set_recipient", "Ms X", *empty[1:])), (2, 2, (None, *empty))],
        f"doc_id int, seq int, edit {D.EDIT}",
    )
    got = {r.doc_id: r for r in D.apply_edits(docs, edits).collect()}
    assert got[1].refused == [None] * 4 and got[1].source.professional_summary == "s" and got[1].source.skills == []
    assert got[2].source.recipient == "Ms X" and got[2].refused == [None, "operation"]
    assert got[3].refused == []

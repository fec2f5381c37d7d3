"""Queries of document readers: Word and PDF files are made of the parts' names, and read again."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import workflow
from ..sources import uploads
from .tables import query, read

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(title: str, item: str, cells: list[str]) -> bytes:
    """A heading, a bold numbered line, a list item and a table of one row and its head."""
    para = lambda text, style="", run="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{escape(text)}</w:t></w:r></w:p>'
    row = "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = para(title, "H1") + para(f"1.1 {item}", run="<w:b/>") + para(item, "L") + f"<w:tbl>{row * 2}</w:tbl>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("L", "List Bullet")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {SPACE}>{styles}</w:styles>")
    return out.getvalue()


def pdf_file(title: str, item: str, cells: list[str]) -> bytes:
    """The same on one page: the numbered title, the item, and the cells in one line."""
    shown = lambda t: b"(" + t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj"
    page = b"BT /F1 12 Tf 72 700 Td " + shown(f"1. {title}") + b" 0 -20 Td " + shown(item) + b" T* " + b" T* ".join(map(shown, cells)) + b" ET"
    body = zlib.compress(page)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


def made(number: Column, title: Column, item: Column, a: Column, b: Column) -> Column:
    """A Word file for numbers that three divides, a PDF for the next ones, else plain bytes."""

    @F.pandas_udf("binary")
    def run(numbers: pd.Series, titles: pd.Series, items: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.Series:
        make = (word_file, pdf_file, lambda t, i, c: t.encode())
        return pd.Series([make[n % 3](t, i, [x, y]) for n, t, i, x, y in zip(numbers, titles, items, lefts, rights, strict=True)], dtype=object)

    return run(number, title, item, a, b)


def files(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'a.docx' WHEN 1 THEN 'b' ELSE 'c.txt' END")
    kind = F.expr("CASE p_partkey % 3 WHEN 1 THEN 'application/pdf' ELSE 'text/plain' END")
    content = made(F.col("p_partkey"), F.initcap("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string"))
    return rows.select("p_partkey", name.alias("name"), kind.alias("content_type"), content.alias("content"))


NAME = "array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(p_name, ' ')], ' ')"


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN sha256('# ' || {NAME} || chr(10) || '1.1 ' || p_type || chr(10) || ' - ' || p_type || chr(10) || chr(10) || '| ' || p_brand || ' | ' || p_size || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' | ' || p_size || ' |')
WHEN 1 THEN sha256('1. ' || {NAME} || chr(10) || p_type || chr(10) || p_brand || chr(10) || p_size) END AS digest, CASE p_partkey % 3 WHEN 0 THEN {NAME} WHEN 1 THEN '1. ' || {NAME} END AS first_heading,
CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS level, p_partkey % 3 = 2 AS failed FROM part""")
def upload_texts(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("d", uploads.documents(F.col("content"), F.col("name"), F.col("content_type")))
    first = F.get("d.headings", F.lit(0))
    return rows.select("p_partkey", ids.text_hash(F.col("d.text")).alias("digest"), first["text"].alias("first_heading"), first["level"].cast("long").alias("level"), F.col("d.error").isNotNull().alias("failed"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 202 ELSE 400 END::BIGINT AS code, CASE WHEN p_partkey % 3 = 0 THEN 'pending' END AS status, count(*) AS n FROM part GROUP BY ALL")
def submitted_jobs(spark, sf_dir):
    jobs = workflow.submitted(files(spark, sf_dir).withColumn("mode", F.lit("both")), "extract")
    return jobs.groupBy(F.col("code").cast("long").alias("code"), "status").agg(F.count("*").alias("n"))

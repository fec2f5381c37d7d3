"""Uploaded documents of any kind that is read: text and headings by the kind of file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.validate import upload_kind
from . import pdf, word


def documents(content: Column, name: Column, content_type: Column) -> Column:
    """struct<text, headings, error>: of Word and PDF files, told by extension, else by content type; other kinds are an error."""
    kind = upload_kind(name, content_type)
    docx, own = word.documents(F.when(kind == "docx", content)), pdf.documents(F.when(kind == "pdf", content))
    unknown = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<struct<level:int,text:string>>").alias("headings"), F.concat(F.lit("only .docx and .pdf are read: "), F.coalesce(name, F.lit(""))).alias("error"))
    shape = lambda x: F.struct(x["text"].alias("text"), x["headings"].cast("array<struct<level:int,text:string>>").alias("headings"), x["error"].alias("error"))
    return F.when(kind == "docx", shape(docx)).when(kind == "pdf", shape(own)).otherwise(unknown)

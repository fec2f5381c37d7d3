"""Sections, bounds, headings, Word files, the indentation format and answers of models, against hand-made cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import coercion, indented, sections, syntax
from corpusgraph.sources import word


@pytest.mark.parametrize(
    "value, want",
    [
        ({"a": []}, "a[0]:"),
        ({"a": [1, True, None, "x"], "b c": "-y"}, 'a[4]: 1,true,null,x\n"b c": "-y"'),
        ({"t": [{"k": 1, "v": "a,b"}, {"k": 2, "v": "true"}]}, 't[2]{k,v}:\n  1,"a,b"\n  2,"true"'),
        ({"t": [{"k": 1}, {"v": [1, 2]}, 3, {}]}, "t[4]:\n  - k: 1\n  - v[2]: 1,2\n  - 3\n  -"),
        ({"o": {"p": {"q": 1.0}}, "e": {}}, "o:\n  p:\n    q: 1\ne:"),
        ({"l": [{"n": "a", "s": [{"x": 1}, {"y": 2}], "m": {"z": 0}}]}, "l[1]:\n  - n: a\n    s[2]:\n      - x: 1\n      - y: 2\n    m:\n      z: 0"),
        ([1e20, float("nan"), -0.0, 0.5, "007", "True", "1e5"], '[7]: 100000000000000000000,null,0,0.5,"007",True,"1e5"'),
        ("plain", "plain"),
    ],
)
def test_indentation_format(value, want):
    assert indented.encode(value) == want


def test_module_record():
    inner = {"name": "n", "screens": [1], "enums": [{"name": "e", "values": [1]}], "business_rules": ["r"]}
    for m in (inner, {"name": "n", "frontend": inner}, {"module": inner}):
        got = indented.module_record(m, 2, {"e": [9], "f": [3]}, ["r", "s"])
        assert got["business_rules"] == ["r", "s"] and [e["name"] for e in got["enums"]] == ["e", "f"] and got["enums"][0]["values"] == [1]
        assert (got["name"], got["dep_priority"], got["order"], got["screens"]) == ("n", 2, 1, [1])


def test_size_bounds():
    tiny, fit = "t" * 10, "f" * 100
    assert sections.bounded([(tiny, "a", "x"), (fit, "b", "y"), (tiny, "c", "z")]) == [(f"{tiny}\n\n{fit}", "b", "y"), (tiny, "c", "z")]
    blank, line = "a" * 4000 + "\n\n" + "b" * 4000, "a" * 4000 + "\n" + "b" * 4000
    for text in (blank, line):
        assert [t for t, _, _ in sections.bounded([(text, "n", "k")])] == ["a" * 4000, "b" * 4000]
    assert sections.bounded([("c" * 9000, "n", "k")]) == [("c" * 9000, "n", "k")]
    assert sections.bounded([]) == []


def test_parts_to_a_budget():
    words = lambda n, c="x": " ".join([c * 3] * n)  # noqa: E731  n approximate tokens
    text = f"intro\n## A\n{words(400, 'a')}\n1. B\n{words(500, 'b')}\n2.1 C\n{words(20, 'c')}"
    parts = sections.module_parts(text, 600, "m")
    assert [p.split("\n\n", 1)[0] for p in parts] == ["[Part 1/2 of module 'm']", "[Part 2/2 of module 'm']"]
    assert "## A" in parts[0] and "1. B" in parts[1] and "2.1 C" in parts[1]
    long = ". ".join(["S" * 399] * 6) + "."
    assert all(sections.quarter(p) <= 210 for p in sections.packed(f"# T\n{long}\n# U\nu", 205))
    assert "".join("".join(sections.packed(long, 205)).split()) == "".join(long.split())
    assert len(sections.module_parts("\n\n".join([words(900)] * 5), 901, "m", most=3)) == 3
    assert sections.packed("", 10) == [""]


def test_text_headings():
    text = "# One\n\n8. Two Words\nTitle\n===\n---\nALL CAPS LINE\na short line\n\nnot a heading.\n\nChapter 3 is\nlast short line"
    assert sections.text_headings(text) == [(1, "One"), (2, "8. Two Words"), (1, "Title"), (1, "ALL CAPS LINE"), (2, "a short line"), (2, "Chapter 3 is")]
    assert sections.text_headings("Top\n---\n---\n---") == [(1, "Top"), (1, "---")] and sections.text_headings("") == []


def test_source_chunks():
    code = "import a from 'a'\n\nexport const useThing = 1 // " + "x" * 80 + "\n  const inner = 2\nexport default function Page() {" + "y" * 80 + "}\nclass K {" + "z" * 80 + "}\n"
    got = sections.code_chunks(code, "f")
    assert [c[1:] for c in got] == [("useThing", "hook"), ("Page", "function_component"), ("K", "class")] and got[0][0].startswith("import a")
    assert sections.code_chunks("x = 1\n", "f") == [("x = 1", "f", "module")]
    assert [c[1] for c in sections.type_chunks("export interface A {" + "a" * 90 + "}\ntype B = 1" + " " * 9, "f")] == ["A", "B"] and sections.type_chunks("x", "f") == []
    css = ".a { color: red; " + "x" * 80 + "}\n@media x { .b { c: d } " + "y" * 80 + "}"
    assert [c[1] for c in sections.style_chunks(css, "f")] == [".a", "@media"]
    big = json.dumps({"k": "v" * 2000, "l": "w" * 2000})
    assert [c[1] for c in sections.json_chunks(big, "f")] == ["k", "l"]
    assert sections.json_chunks("{no", "f") == [("{no", "f", "json_config")] and len(sections.json_chunks('{"a": 1}', "f")) == 1


def test_answers():
    raw = '```json\n{"plan": [{"title": "T", "screens": [{"components": [{"fields": [{"default_value": false, "options": [1, "a"]}], "columns": [{"color_logic": {"a": 1}}]}]}]}]}\n```'
    (m,) = coercion.modules(coercion.parsed(raw))
    item = m["screens"][0]["components"][0]
    assert m["module_name"] == "T" and item["columns"] == [{"color_logic": '{"a": 1}'}]
    assert item["fields"] == [{"default_value": None, "options": ["1", "a"], "visible_when": None, "required_when": None, "disabled_when": None}]
    assert [coercion.text_or_null(v) for v in (None, False, "", True, 0, [1], "x")] == [None, None, None, "true", "0", "[1]", "x"]
    assert list(coercion.modules({"name": "n"})) == [{"name": "n", "module_name": "n"}] and list(coercion.modules([])) == []
    with pytest.raises(ValueError):
        list(coercion.modules(3))


def docx(body: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in {"T": "Title", "H2": "heading 2", "L": "List Bullet"}.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
    return out.getvalue()


def para(text: str, style: str = "", run: str = "", more: str = "") -> str:
    named = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{named}{more}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def cell(text: str, merged: str = "") -> str:
    return f"<w:tc><w:tcPr>{merged}</w:tcPr>{para(text)}</w:tc>"


def test_word_files(spark):
    table = f'<w:tbl><w:tr>{cell("a", "<w:gridSpan w:val=\"2\"/>")}{cell("b", "<w:vMerge w:val=\"restart\"/>")}</w:tr><w:tr>{cell("c")}{cell("d")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    body = para("Name", "T") + para("Part", "H2") + para("item", "L") + para("8.1 Bold", run="<w:b/>") + para("8.2 Not bold", run='<w:b w:val="0"/>')
    body += para("Large", run='<w:b/><w:sz w:val="28"/>') + para("Outlined", more='<w:outlineLvl w:val="2"/>') + table
    text, headings = word.read_document(docx(body))
    assert headings == [(0, "Name"), (2, "Part"), (3, "8.1 Bold"), (2, "Large"), (3, "Outlined")]
    assert text == "# Name\n\n## Part\n - item\n8.1 Bold\n8.2 Not bold\nLarge\nOutlined\n\n| a | b |\n| --- | --- |\n| c | d | b |"
    assert word.read_document(docx(para("# Plain") + para("words")))[1] == [(1, "Plain")]
    df = spark.createDataFrame([(1, docx(body)), (2, b"no archive"), (3, None)], "k int, content binary")
    rows = {r["k"]: r["x"] for r in df.select("k", word.documents(F.col("content")).alias("x")).collect()}
    assert rows[1]["text"] == text and len(rows[1]["headings"]) == 5 and rows[1]["error"] is None
    assert rows[2]["text"] is None and "BadZipFile" in rows[2]["error"] and tuple(rows[3]) == (None, None, None)


def test_column_forms(spark):
    df = spark.createDataFrame([("# A\nx", "code"), (None, "code"), ("", "other")], "t string, k string")
    got = df.select(sections.headings_of(F.col("t")), sections.parts_of(F.col("t"), 5, F.col("k")), sections.file_chunks(F.col("t"), F.col("k"), F.col("k")), indented.encoded(F.col("t")), coercion.plan_modules(F.col("t"))).collect()
    assert [[x is None for x in r] for r in got] == [[False, False, False, True, True], [True] * 5, [False, False, True, True, True]]


def test_file_pieces(spark):
    long = "\n\n".join(["p" * 1000, "q" * 1000, "r" * 5000])
    df = spark.createDataFrame([(1, "small"), (2, long), (3, None)], "k int, t string")
    got = {r["k"]: r["x"] for r in df.select("k", syntax.parts(F.col("t"), F.lit("n.md")).alias("x")).collect()}
    assert [x["text"] for x in got[1]] == ["small"] and [x["text"] for x in got[2]] == ["p" * 1000, "q" * 1000, "r" * 5000]


def test_long_texts_are_taken_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from corpusgraph.functions import batches

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 40, None, "y" * 90, "", "z" * 300, "w"]})
    parts = [p.column("t").to_pylist() for p in batches.slices(batch, "t", 100)]
    assert sum(parts, []) == batch.column("t").to_pylist() and max(len(p) for p in parts) <= 3 and len(parts) >= 3
    df = spark.createDataFrame([(1, "a b", "n"), (2, None, "m"), (None, "c", None), (3, "", "k")], "id long, t string, s string")
    got = batches.items(df, "id", "t", ["s"], lambda t, s: [(x, s) for x in t.split()], "word string, s string").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, "a", "n"), (1, 1, "b", "n"), (None, 0, "c", None)], key=str)

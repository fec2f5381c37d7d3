"""Stores, the workflow around a model, checks of answers, the scanner of declarations."""

import json

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import syntax, validate
from corpusgraph.operators import buckets, loads, store, workflow

POINTS = "point_id string, file_path string, file_id string, chunk_index int, text string"


def points_of(files):
    made = files.withColumn("chunk_index", F.lit(0)).withColumn("point_id", F.sha2(F.concat("file_path", "file_id"), 256))
    return made.select("point_id", "file_path", "file_id", "chunk_index", "text")


def test_a_collection_follows_its_files(spark, tmp_path):
    at = str(tmp_path / "c")
    disk = lambda *rows: spark.createDataFrame([(p, h, f"{p}{h}") for p, h in rows], "file_path string, file_id string, text string")
    run = lambda files, **how: store.synchronise(spark, at, files, points_of, POINTS, **how)
    assert store.current(spark, at) is None and store.ensure(spark, at, POINTS) and not store.ensure(spark, at, POINTS)
    first = disk(("a", "1"), ("b", "1"), ("c", "1"))
    assert run(first, dry_run=True) == {"added": 3, "updated": 0, "deleted": 0, "upserted": 0}
    assert store.current(spark, at).count() == 0
    assert run(first)["upserted"] == 3
    assert run(first) == {"added": 0, "updated": 0, "deleted": 0, "upserted": 0}
    assert run(disk(("a", "1"), ("b", "2"), ("d", "1"))) == {"added": 1, "updated": 1, "deleted": 1, "upserted": 2}
    assert {(r["file_path"], r["file_id"]) for r in store.current(spark, at).collect()} == {("a", "1"), ("b", "2"), ("d", "1")}
    nothing = disk(("a", "1")).limit(0)
    assert run(nothing, keep_if_empty=True)["deleted"] == 0 and store.current(spark, at).count() == 3
    assert run(nothing)["deleted"] == 3 and store.current(spark, at).count() == 0
    assert len(store.versions(spark, at)) <= 2
    jobs = {"one": {"path": str(tmp_path / "x"), "files": first, "points_of": points_of, "schema": POINTS}, "two": {"path": str(tmp_path / "y"), "files": first, "points_of": points_of, "schema": POINTS}}
    assert set(store.synchronise_all(spark, jobs, ["two"])) == {"two"} and store.current(spark, str(tmp_path / "x")) is None
    assert store.ensure_all(spark, str(tmp_path), {"k": "name"}, {"k": POINTS}) == {"k": f"{tmp_path}/name"}


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    at = str(tmp_path / "c")
    rows = lambda n: spark.range(n).selectExpr("id", "id AS k")
    assert buckets.create(spark, at, "id long, k long", "k", buckets=2) and buckets.change(spark, at, rows(3)).number == 2
    (tmp_path / "c" / "manifest" / ".half").write_text('{"files": {')
    (tmp_path / "c" / "data" / "v3").mkdir()
    assert store.current(spark, at).count() == 3 and store.versions(spark, at) == [1, 2]
    assert buckets.change(spark, at, rows(5)).number == 3 and store.current(spark, at).count() == 5


def test_equal_files_share_a_digest(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "file_path string, file_id string")
    gone = spark.createDataFrame([("1",)], "file_id string")
    assert store.delete_by_digest(p, gone, dry_run=True).first()["n"] == 2 and store.delete_by_digest(p, gone).count() == 1


def test_folder_plans(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "example_id string, file_path string, file_id string")
    disk, stored = rows(("a", "a/1", "x"), ("b", "b/1", "y")), rows(("a", "a/1", "x"), ("c", "c/1", "z"))
    ops = lambda **how: {r["example_id"]: r["op"] for r in store.folder_plan(disk, stored, **how).collect()}
    assert ops() == {"a": "keep", "b": "write", "c": "delete"} and ops(only="b") == {"b": "write"}


def test_vectors(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    v = [r[0] for r in df.select(store.embedded(F.col("t"), 16)).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[1] is None and not any(v[2])
    seen = df.select(store.embedded(F.col("t"), 2, "q", backend=lambda texts: [[len(t), 0] for t in texts])).collect()
    assert seen[0][0] == [1.0, 0.0]
    with pytest.raises(Exception, match="vectors for"):
        df.select(store.embedded(F.col("t"), 2, backend=lambda texts: [])).collect()


def test_jobs_and_records(spark, tmp_path):
    log = [("j", 1, "pending", "extract", None, None), ("j", 2, "completed", "extract", "early", None), ("j", 3, "processing", "extract", None, None), ("j", 4, "completed", "extract", "r", None), ("j", 5, "failed", "extract", None, "late"), ("k", 1, "processing", "plan", None, None), ("m", 1, "pending", "plan", None, None), ("m", 2, "failed", "plan", None, "e")]
    df = spark.createDataFrame(log, "id string, updated_at int, status string, job_type string, result string, error_message string")
    kept = store.job_events(df)
    assert sorted((r["id"], r["updated_at"]) for r in kept.collect()) == [("j", 1), ("j", 3), ("j", 4), ("m", 1), ("m", 2)]
    from corpusgraph.operators.aggregate import latest

    states = latest(kept, "id", [F.col("updated_at")])
    ask = lambda job, kind: tuple(store.job_answer(states, job, kind).first())[1:]
    assert ask("j", "extract") == (200, "completed", "r", None) and ask("j", "plan")[0] == 400 and ask("zz", "plan")[0] == 404 and ask("m", "plan") == (200, "failed", None, "e")
    store.saved(store.record({"story": F.lit("ü"), "body": F.struct(F.lit("é").alias("x"))}, spark), f"{tmp_path}/r")
    r = spark.read.parquet(f"{tmp_path}/r").first()
    assert len(r["id"]) == 36 and r["body"] == '{"x":"é"}' and r["created_at"] is not None
    children = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None)], "id string, parent string")
    assert sorted(x["id"] for x in store.cascaded(children, spark.createDataFrame([("1",)], "id string"), "parent").collect()) == ["p", "r"]


SCHEMA = {"type": "object", "required": ["module"], "properties": {"module": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}, "screens": {"type": "array", "items": {"$ref": "#/$defs/screen"}}}}}, "$defs": {"screen": {"type": "object", "properties": {"components": True, "kind": {"enum": ["a", "b"]}, "n": {"anyOf": [{"type": "null"}, {"type": "integer", "minimum": 1}]}}, "additionalProperties": False}}}


def test_schemas():
    fault = lambda v, s=SCHEMA: validate.first_fault(v, s, "x")
    assert fault({"module": {"name": "m", "screens": [{"kind": "a", "n": None}, {"n": 2}]}}) is None
    assert fault({}) == "'x' at '<root>': 'module' is a required property"
    assert fault({"module": {"name": "", "screens": [{"kind": "z"}]}}).startswith("'x' at 'module.name'")
    assert fault({"module": {"name": "m", "screens": [{}, {"kind": "z"}]}}).startswith("'x' at 'module.screens.1.kind'")
    assert "not allowed" in fault({"module": {"name": "m", "screens": [{"more": 1}]}}) and "anyOf" in fault({"module": {"name": "m", "screens": [{"n": 0}]}})
    for value, schema, ok in ((True, {"type": "integer"}, False), (2.0, {"type": "integer"}, True), ([1, 1], {"uniqueItems": True}, False), ([1], {"minItems": 2}, False), ("ab", {"pattern": "^a"}, True), (3, {"const": 3}, True), (3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, False), (1, {"allOf": [{"type": "number"}, {"maximum": 0}]}, False), (1, True, True), (1, False, False), ({"a": 1}, {"additionalProperties": {"type": "string"}}, False), (None, {"type": ["string", "null"]}, True)):
        assert (fault(value, schema) is None) == ok, (value, schema)


def test_answers_are_mended():
    got = validate.mended({"module": {"screens": [{"components": [{"GRID": {"id": "g"}, "TOOLBAR": {"id": "t", "type": "bar"}}, {"type": "tabs", "children": [{"components": [{"FORM": {"id": "f"}}]}]}, "text"]}], "enums": [{"name": "e", "values": []}, {"name": "f", "values": ["x"]}], "frontend": {"enums": [{"values": []}]}}})
    assert got["module"]["screens"][0]["components"] == [{"type": "bar", "id": "t"}, {"type": "grid", "id": "g"}, {"type": "tabs", "children": [{"components": [{"type": "form", "id": "f"}]}]}]
    assert got["module"]["enums"] == [{"name": "f", "values": ["x"]}] and got["module"]["frontend"]["enums"] == []
    assert validate.mended({"module": 3}) == {"module": 3}


def test_calls_are_tried_again():
    waits, calls = [], []

    def failing(codes):
        todo = iter(codes)

        def call():
            code = next(todo)
            calls.append(code)
            if code:
                raise workflow.CallFailed("no", code)
            return "ok"

        return call

    assert workflow.tried(failing([429, 503, 0]), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    for codes, n in (([400, 0], 1), ([500, 500, 500, 0], 3)):
        calls.clear()
        with pytest.raises(workflow.CallFailed):
            workflow.tried(failing(codes), sleep=waits.append)
        assert len(calls) == n
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        return ["not JSON", "{}", '```json\n{"module": {"name": "m"}}\n```'][len(prompts) - 1]

    got, n = workflow.valid_answer(model, "ask", SCHEMA, "x")
    assert got == {"module": {"name": "m"}} and n == 3 and "required property" in prompts[2] and prompts[2].startswith("ask")
    with pytest.raises(RuntimeError, match="no valid answer"):
        workflow.valid_answer(lambda p: "{}", "ask", SCHEMA, "x")


def test_merging_parts():
    one = lambda **m: {"module": m}
    assert workflow.merged([], "both", "n") == {"module": {"name": "n"}} and workflow.merged([one(x=1)], "both", "n") == one(x=1)
    got = workflow.merged([one(screens=[{"name": "a"}, {"x": 1}], business_rules=["r", {"t": "s"}], description=""), one(screens=[{"name": "a", "y": 2}, {"x": 2}, {"name": "b"}], business_rules=["r", {"u": "s"}, {"v": 1}, {"v": 1}], description="d")], "frontend", "n")["module"]
    assert got["screens"] == [{"name": "a"}, {"x": 1}, {"x": 2}, {"name": "b"}] and got["business_rules"] == ["r", {"t": "s"}, {"v": 1}] and got["description"] == "d" and got["enums"] == []
    both = workflow.merged([one(backend={"api_endpoints": [{"method": "get", "path": "/a"}]}), one(backend={"api_endpoints": [{"method": "GET", "path": "/a"}, {"method": "GET", "path": "/b"}]})], "both", "n")["module"]
    assert [e["path"] for e in both["backend"]["api_endpoints"]] == ["/a", "/b"] and both["frontend"]["screens"] == []


def test_a_document_from_headings_to_plans(spark):
    body = "Title\n1. Stock\nkeeps items\n2.  Sales\nsells\nRules\nnone"
    headings = spark.createDataFrame([("d", 0, 1, "Title"), ("d", 1, 2, "1. Stock"), ("d", 2, 2, "2. Sales"), ("d", 3, 3, "Rules"), ("e", 0, 1, " ")], "document string, pos int, level int, text string")
    told = [("d", "2. Sales", "MODULE", "Sales", "", 1), ("d", "1. Stock", "MODULE", "", "about", 2), ("d", "Rules", "IGNORE", "", "", 3), ("d", "1. Stock", "MODULE", "again", "", 4), ("d", "Ghost", "MODULE", "a name of far more than eight words in all", "", 5)]
    mods = workflow.segments(headings, spark.createDataFrame(told, "document string, heading string, type string, module_name string, description string, n int"))
    got = [tuple(r) for r in mods.orderBy("document", "position").select("document", "name", "heading", "level", "description", "position").collect()]
    assert got == [("d", "Stock", "1. Stock", 2, "about", 0), ("d", "Sales", "2. Sales", 2, "Requirements for Sales", 1), ("d", "Ghost", "Ghost", 2, "Requirements for Ghost", 2), ("e", "Application", "", 1, "Full document", 0)]
    docs = spark.createDataFrame([("d", body), ("e", "whole")], "document string, text string")
    parts = {(r["document"], r["name"]): r["text"] for r in workflow.slices(mods, docs).collect()}
    assert parts == {("d", "Stock"): "1. Stock\nkeeps items", ("d", "Sales"): "2.  Sales\nsells\nRules\nnone", ("d", "Ghost"): body, ("e", "Application"): "whole"}

    def model(prompt):
        name, _, text = prompt.partition("|")
        if name == "Ghost":
            raise workflow.CallFailed("gone", 400)
        return json.dumps({"module": {"name": name.upper(), "screens": [{"kind": "a"}]}})

    found = workflow.extracted(workflow.slices(mods, docs), model, "{module_name}|{module_text}", SCHEMA, "frontend")
    rows = found.collect()
    assert {r["name"]: (r["part"], r["calls"], r["error"]) for r in rows} == {"Stock": (0, 1, None), "Sales": (0, 1, None), "Ghost": (0, 0, "gone"), "Application": (0, 1, None)}
    merged = workflow.merged_parts(spark.createDataFrame(rows, found.schema).where("error IS NULL"), "frontend")
    done = workflow.finished(merged, mods).orderBy("document", "number").collect()
    assert [(r["document"], r["number"], r["name"]) for r in done] == [("d", 1, "STOCK"), ("d", 2, "SALES"), ("e", 1, "APPLICATION")]
    assert merged.select(workflow.screen_count(F.col("extraction"))).first()[0] == 1
    assert workflow.budget(11_500) == 1000 and workflow.budget(2000) == 10_000
    context = spark.createDataFrame([("d", "shared")], "document string, rules string")
    assert workflow.shared_context(mods, context).count() == 3


def test_screens_that_nothing_defines(spark):
    m = {"module": {"screens": [{"name": "a", "components": [{"type": "toolbar", "actions": [{"opens_screen": "b"}, {"opens_screen": "zz"}, {}]}, {"type": "tabs", "children": [{"components": [{"type": "grid", "row_actions": [{"opens_screen": "yy"}]}]}]}]}, {"name": "b"}]}}
    df = spark.createDataFrame([(json.dumps(m),), (json.dumps({"module": {"frontend": m["module"]}}),), ("no",), (None,)], "x string")
    want = [("a", "zz"), ("a", "yy")]
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(workflow.unknown_screens(F.col("x"))).collect()] == [want, want, None, None]


def test_plans_and_submissions(spark):
    rows = spark.createDataFrame([("d", "a", "text a", 3, "shared"), ("d", "b", "text b", 1, None)], "document string, name string, module string, priority int, context string")

    def model(prompt):
        if "text b" in prompt:
            raise workflow.CallFailed("no", 401)
        return json.dumps({"asked": prompt})

    got = {r["name"]: r for r in workflow.planned(rows, model, "{module}|{context}|{priority}", {"type": "object"}, parallel=2).collect()}
    assert json.loads(got["a"]["plan"]) == {"priority": 3, "asked": "text a|shared|3"} and got["b"]["error"] == "no" and got["b"]["plan"] is None
    from tests.test_sources import PAGE, made_pdf

    ups = spark.createDataFrame([("a.pdf", None, "both", made_pdf([PAGE])), ("b.pdf", None, "sideways", made_pdf([PAGE])), ("c.txt", None, "both", b"x"), ("d.pdf", None, "both", b"x"), (None, None, "both", b"x")], "name string, content_type string, mode string, content binary")
    jobs = {r["name"]: (r["code"], r["status"]) for r in workflow.submitted(ups, "extract").collect()}
    assert jobs == {"a.pdf": (202, "pending"), "b.pdf": (400, None), "c.txt": (400, None), "d.pdf": (422, None), None: (400, None)}


def test_exact_names_only(spark):
    from corpusgraph.operators.loads import component_ids

    c = spark.createDataFrame([("p::Card", "Card"), ("q::Card", "Card")], "id string, name string")
    got = component_ids(spark.createDataFrame([("Card",), ("ard",)], "name string"), c)
    assert {r["name"]: r["id"] for r in got.collect()} == {"Card": "q::Card", "ard": None}


def test_exact_token_counts(spark):
    import base64

    from corpusgraph.functions.text import exact_tokens

    with open("/tmp/corpusgraph-ranks.tiktoken", "wb") as f:
        f.write(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([bytes([b]) for b in range(256)] + [b"ab"])))
    df = spark.createDataFrame([("abab c",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(exact_tokens(F.col("t"), "/tmp/corpusgraph-ranks.tiktoken", r"\w+|\s+")).collect()] == [4, None, 0]


def test_declarations():
    source = """// note
import { a } from "b";
import "./s.css"

/** doc */
export const Card: React.FC<Props> = ({ title, size = 1, kind: k, ...rest }) => {
  const s = `}${`{`}`;
  return <p>don't</p>
}
export default function useThing({ x }, y) { return /[}]/.test(x) }
const plain = memo(() => 1),
  other = 2
async function* gen() {}
export abstract class Base extends X { m() { if (a) { } } }
interface A extends B<C, D>, E { readonly id: string; run?(x: number): void, deep: { inner: 1 } }
export type T = { a: string; b?: number }
type U = | 'x'
  | 'y';
declare enum K { One = 1, Two }
export const enum L { P }
let { p, q } = z
export { Card }
export default Card
stray()
"""
    found, imports, exports = syntax.read(source)
    assert [(d.name, d.kind, d.exported) for d in found] == [("Card", "function", True), ("useThing", "function", True), ("plain", "variable", False), ("gen", "function", False), ("Base", "class", True), ("A", "interface", False), ("T", "type_alias", True), ("U", "type_alias", False), ("K", "enum", False), ("L", "enum", True), ("{ p, q }", "variable", False)]
    by = {d.name: d for d in found}
    assert by["Card"].props == ["title", "size", "kind", "...rest"] and by["useThing"].props == ["x"]
    assert by["A"].fields == ["id", "run", "deep"] and by["A"].extends == ["B<C,D>", "E"] and by["T"].fields == ["a", "b"] and by["K"].fields == ["One", "Two"] and by["U"].fields == []
    assert imports == ['import { a } from "b";', 'import "./s.css"'] and exports == ["Card", "useThing", "Base", "Card"]
    assert source[by["plain"].start : by["plain"].end] == "const plain = memo(() => 1),\n  other = 2" and source[by["U"].start : by["U"].end].endswith("'y';")
    chunks = syntax.declared_chunks(source, "file")
    assert chunks[0][0].startswith("// note\nimport") and chunks[1][0].startswith('import { a } from "b";\nimport "./s.css"\n\nexport default function') and chunks[1][2] == "hook"
    assert not any("stray" in c[0] for c in chunks) and syntax.component_chunks(source, "f")[-1].text.endswith("stray()")
    assert [c.type for c in syntax.component_chunks(source, "f")][:3] == ["function_component", "hook", "utility"]
    assert syntax.declared_chunks("just()", "f") == [("just()", "f", "module")] and syntax.read("") == ([], [], [])


def test_chunks_of_a_file():
    big = "\n\n".join(f"export function f{i}() {{\n  {'x' * 900}\n}}" for i in range(4))
    parts = syntax.file_parts(big, "a.ts")
    assert [p[1] for p in parts] == ["f0", "f1", "f2", "f3"] and syntax.file_parts("tiny", "a.b.ts") == [("tiny", "a.b", "module")]
    assert [p[1:] for p in syntax.file_parts("\n\n".join(["y" * 1000] * 3), "n.md")] == [("", "module")] * 3
    assert syntax.file_parts("", "x") == [("", "x", "module")]


def test_graph_tables_are_written_apart(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    loads.write_graph({"a": one, "source_file": one}, str(tmp_path))
    loads.write_graph({"a": two, "source_file": two}, str(tmp_path), loads.CODE_TABLES)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 1 and spark.read.parquet(f"{tmp_path}/source_file").count() == 2
    with pytest.raises(ValueError, match="query: SELECT nope"):
        loads.expressions({"v": one}, "SELECT nope FROM v")
    nodes = spark.createDataFrame([("e", []), ("f", ["old"])], "example_id string, chunk_ids array<string>")
    got = loads.with_chunk_ids(nodes, spark.createDataFrame([("e", "2"), ("e", "1")], "example_id string, chunk_id string"))
    assert {r["example_id"]: r["chunk_ids"] for r in got.collect()} == {"e": ["1", "2"], "f": ["old"]}
    m = spark.createDataFrame([("x/packages/ui/package.json", '{"name": "@x/ui"}'), ("packages/no/package.json", "{")], "path string, content string")
    assert [tuple(r) for r in loads.packages(m).collect()] == [("x/packages/ui", "@x/ui")]
    files = spark.createDataFrame([(f"packages/{p}", "c") for p in ("a/src/x.ts", "a/y.ts", "b/z.ts", "b/z.test.ts", "b/dist/q.ts")], "path string, content string")
    known = spark.createDataFrame([("packages/a", "A"), ("packages/b", "B")], "folder string, package_name string")
    assert sorted((r["package_name"], r["rel_path"]) for r in loads.package_files(files, known).collect()) == [("A", "src/x.ts"), ("B", "z.ts")]


def test_hygiene_broadcasts_nothing_and_sorts_no_edges(spark):
    from corpusgraph.operators import graph

    ids = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1, "A"), (1, 2, "B"), (3, 9, "A"), (2, 1, "A")], "src long, dst long, kind string")
    nodes, sound, first = graph.hygiene(ids.where("id < 3"), edges, ids, ["A"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan
    assert {r[0] for r in nodes.collect()} == set(range(5)) and sound.count() == 3 and {r[0] for r in first.collect()} == {0, 2, 3, 4}

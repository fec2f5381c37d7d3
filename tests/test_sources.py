import zlib

from pyspark.sql import functions as F

from corpusgraph.operators import buckets, store
from corpusgraph.sources import files, pdf, uploads
from corpusgraph.streaming import jobs


def lay(root, tree):
    for name, body in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(root)


def test_scan_of_a_tree(spark, tmp_path):
    root = lay(tmp_path / "build here", {"g/e1/Page.tsx": "export const Page = 1", "g/e1/types.ts": "export type T = 1", "g/e1/a.test.ts": "x", "node_modules/x/y.ts": "x", "g/e1/empty.ts": "", "g/e2/readme.md": "# A\nü", "h/z.json": "{}"})
    got = {r["rel_path"]: r for r in files.scan(spark, root).collect()}
    assert sorted(got) == ["g/e1/Page.tsx", "g/e1/types.ts", "g/e2/readme.md", "h/z.json"]
    assert got["g/e1/Page.tsx"]["category"] == "component" and got["g/e2/readme.md"]["content"] == "# A\nü"
    own = {r["rel_path"]: (r["namespace"], r["module_layer"]) for r in files.scan(spark, root, {"g": "@x/g", "g/e2": "@x/e2"}, {"@x/g": "ui"}).collect()}
    assert own == {"g/e1/Page.tsx": ("@x/g", "ui"), "g/e1/types.ts": ("@x/g", "ui"), "g/e2/readme.md": ("@x/e2", "infra")}
    sets = {r["path"]: r["related_files"] for r in files.example_files(spark, root).collect()}
    assert sets == {"g/e1/Page.tsx": ["a.test.ts", "types.ts"], "g/e1/types.ts": ["Page.tsx", "a.test.ts"], "g/e1/a.test.ts": ["Page.tsx", "types.ts"], "node_modules/x/y.ts": []}
    assert files.paths_on_disk(files.example_files(spark, root)).count() == 4


def test_skipped_folders_are_not_opened(spark, tmp_path):
    plan = files.scan(spark, lay(tmp_path, {"a.ts": "x", "node_modules/y.ts": "x"}))._jdf.queryExecution().toString()
    assert "Filter" in plan and "_metadata" in plan


def test_workspace(spark, tmp_path):
    root = lay(tmp_path, {
        "packages/ui/package.json": '{"name":"@x/ui","version":"1","description":"d","dependencies":{"b":"2","a":"workspace:*"},"scripts":{"t":"x","b":"y"}}', "packages/ui/src/deep/Button.tsx": "b", "packages/ui/README.md": "r", "packages/ui/vite.config.ts": "v",
        "packages/bad/package.json": "no", "packages/bad/src/a.ts": "a", "book/intro.md": "i", "tsconfig.json": "{}", "packages/ui/node_modules/z.ts": "z",
    })
    got = {r["rel_path"]: r for r in files.workspace(spark, root, {"@x/ui": "atomic"}, extra={"book": "book"}).collect()}
    assert sorted(got) == ["__synthetic__/@x/ui", "book/intro.md", "packages/bad/package.json", "packages/bad/src/a.ts", "packages/ui/README.md", "packages/ui/package.json", "packages/ui/src/deep/Button.tsx", "packages/ui/vite.config.ts", "tsconfig.json"]
    b = got["packages/ui/src/deep/Button.tsx"]
    assert (b["package_name"], b["package_layer"], b["module_path"], b["file_category"], b["collection_targets"]) == ("@x/ui", "atomic", "deep", "component", ["code"])
    assert got["__synthetic__/@x/ui"]["content"] == "Package: @x/ui v1\nDescription: d\n\nDependencies:\n  - a (workspace)\n  - b 2\n\nScripts: b, t"
    assert got["packages/ui/vite.config.ts"]["file_category"] == "build_config" and got["tsconfig.json"]["package_name"] == "monorepo-root"


def test_manifest_and_ranked_union(spark):
    df = spark.createDataFrame([('{"name":"p","version":"1","dependencies":{"b":"2","a":"1"},"peerDependencies":{"c":"3"}}',), ("no",), ("{}",)], "m string")
    assert [r[0] for r in df.select(files.manifest_text(F.col("m"), F.lit("q"))).collect()] == ["Package: p v1\n\nDependencies:\n  - a 1\n  - b 2\n\nPeer Dependencies:\n  - c 3\n", None, "Package: q vunknown\n"]
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {tuple(r) for r in files.ranked_union([a, b], "k").collect()} == {("x", 1), ("y", 3)}


JOB_LOG = [
    ("a", "pending", 1), ("a", "completed", 3), ("b", "pending", 2), ("c", "processing", 1), ("c", "pending", 4), ("c", "failed", 5), ("c", "processing", 6),
    ("a", "processing", 11), ("a", "completed", 12), ("a", "failed", 13), ("b", "failed", 11), ("d", "pending", 14), ("d", "processing", 15), ("d", "pending", 16),
]


def test_job_stream_equals_the_fold_also_after_a_restart(spark, tmp_path):
    log = spark.createDataFrame(JOB_LOG, "id string, status string, s int").withColumn("ts", F.timestamp_seconds("s"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    run = lambda: jobs.keep_states(jobs.states(stream(), ("ts",)), f"{tmp_path}/t", f"{tmp_path}/c", ("ts",), n=4).awaitTermination()
    for part in ("s < 10", "s >= 10"):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        run()  # the second run goes on from the first one's states
        seen = log.where("s < 10") if part == "s < 10" else log
        want = store.job_events(seen, at=("ts",)).groupBy("id").agg(F.max_by(F.struct("status", "s"), "ts").alias("x")).select("id", "x.*")
        assert {tuple(r) for r in store.current(spark, f"{tmp_path}/t").select("id", "status", "s").collect()} == {tuple(r) for r in want.collect()}
    before = store.versions(spark, f"{tmp_path}/t")
    run()  # nothing new
    assert store.versions(spark, f"{tmp_path}/t") == before
    v = buckets.version(spark, f"{tmp_path}/t")
    again = buckets.change(spark, f"{tmp_path}/t", log.limit(1), batch=(f"{tmp_path}/c", v.batches[f"{tmp_path}/c"]))  # a batch that comes once more
    assert again.number == v.number and again.rewritten == []


def test_stuck_jobs_fail_by_a_timer(spark, tmp_path):
    log = spark.createDataFrame([("a", "pending", 1), ("a", "processing", 2), ("b", "pending", 1)], "id string, status string, s int")
    later = spark.createDataFrame([("b", "processing", 5000), ("a", "completed", 5001)], "id string, status string, s int")
    last = spark.createDataFrame([("z", "pending", 9000)], "id string, status string, s int")
    kind = log.withColumn("ts", F.timestamp_seconds("s")).schema
    for part in (log, later, last):
        part.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/log")
        jobs.keep_states(jobs.states(stream, ("ts",), late="1 second", limit=600_000), f"{tmp_path}/t", f"{tmp_path}/c", ("ts",), n=2).awaitTermination()
    got = {r["id"]: r["status"] for r in store.current(spark, f"{tmp_path}/t").collect()}
    assert got["b"] == "failed" and got["z"] == "pending" and got["a"] in ("failed", "completed")


def made_pdf(streams, packed=True, fonts=b"", tree=True):
    """A small PDF of one page for each content stream."""
    n = len(streams)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>" if tree else b"<< >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(n)) + b"] /Count %d >>" % n]
    for i, s in enumerate(streams):
        body = zlib.compress(s) if packed else s
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (3 + 2 * n, 4 + 2 * i))
        objects.append(b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream")
    objects.append(b"<< /Type /Font /Subtype /Type1 " + (b"/ToUnicode %d 0 R " % (4 + 2 * n) if fonts else b"") + b">>")
    objects.append(b"<< /Length %d >>\nstream\n" % len(fonts) + fonts + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


PAGE = rb"BT /F1 12 Tf 72 700 Td (1. Stock Ledger) Tj 0 -20 Td [(Keeps \(all\) ) -300 (items\056)] TJ T* (caf\351) Tj ET"


def test_text_of_pdf_files():
    want = "1. Stock Ledger\nKeeps (all) items.\ncafé"
    for packed in (True, False):
        assert pdf.text_of(made_pdf([PAGE, b"BT (Second page) Tj ET"], packed)) == want + "\n\nSecond page"
    assert pdf.text_of(made_pdf([PAGE], tree=False)) == want  # the second reader
    fonts = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0062> endbfrange"
    assert pdf.text_of(made_pdf([b"BT /F1 9 Tf <01020304> Tj ET"], fonts=fonts)) == "Abcd"


def test_uploads_by_kind(spark):
    rows = [("a.pdf", None, made_pdf([PAGE])), ("scan.pdf", None, made_pdf([b"q Q"])), ("x.bin", "application/pdf", made_pdf([PAGE])), ("x.txt", None, b"hi"), ("broken.docx", None, b"no"), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, type string, content binary").select("name", uploads.documents(F.col("content"), F.col("name"), F.col("type")).alias("d")).select("name", "d.*")
    got = {r["name"]: r for r in df.collect()}
    assert got["a.pdf"]["text"] == got["x.bin"]["text"] and [h["text"] for h in got["a.pdf"]["headings"]][0] == "1. Stock Ledger"
    assert got["scan.pdf"]["error"] == pdf.NO_TEXT and got["broken.docx"]["text"] is None and "only .docx" in got["x.txt"]["error"] and got[None]["text"] is None

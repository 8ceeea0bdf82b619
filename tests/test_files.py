"""The row-file sink, listings, manifests' observations, orders, arms."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import arms, gates, order, reports
from tessera.sources import files, readers, writers


def test_files_for_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.range(300).select(F.concat(F.lit("a/"), F.col("id") % 7, F.lit("/"), "id", F.lit(".txt")).alias("path"), F.concat(F.lit("é\n"), "id").alias("value")).repartition(5)
    files.write_row_files(rows, folder)
    for r in rows.collect():
        assert (tmp_path / "out" / r["path"]).read_text() == r["value"]
    assert json.loads((tmp_path / "out/_SUCCESS").read_text()) == {"files": 300, "bytes": sum(len(r["value"].encode()) for r in rows.collect())}
    assert not (tmp_path / "out/_staging").exists()
    # A second write replaces files by name and leaves the others.
    files.write_row_files(spark.createDataFrame([("a/0/0.txt", "new"), ("empty", None)], "path string, value string"), folder)
    assert (tmp_path / "out/a/0/0.txt").read_text() == "new" and (tmp_path / "out/empty").read_text() == "" and (tmp_path / "out/a/1/1.txt").exists()
    listed = {r["name"]: r["length"] for r in files.file_listing(spark, folder, ".txt").collect()}
    assert len(listed) == 300 and listed["a/0/0.txt"] == 3
    files.write_row_files(rows.filter("false"), f"file://{tmp_path}/none")
    assert json.loads((tmp_path / "none/_SUCCESS").read_text())["files"] == 0


def test_a_failed_write_leaves_no_halves(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    files.write_row_files(spark.createDataFrame([("x", "old")], "path string, value string"), folder)
    for bad in ("../x", "/x", "_staging/x", None):
        with pytest.raises(Exception, match="not a path below"):
            files.write_row_files(spark.createDataFrame([("x", "new"), (bad, "y")], "path string, value string").coalesce(1), folder)
        assert (tmp_path / "out/x").read_text() == "old"
        assert sorted(os.listdir(tmp_path / "out")) == ["x"]  # neither staged files nor the marker of the write before


def test_listing_of_all_files(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/a.md").write_text("abc")
    (tmp_path / "d/b.rs").write_text("")
    listing = files.file_listing(spark, str(tmp_path / "d"))
    assert files.file_listing(spark, str(tmp_path / "d"), ".md", ".txt").count() == 1
    assert {(r["name"], r["length"]) for r in listing.collect()} == {("e/a.md", 3), ("b.rs", 0)}
    tasks = spark.createDataFrame([(1, "e/a.md"), (2, "no.md"), (3, None)], "id long, p string")
    assert [r["id"] for r in gates.missing_files(tasks, "p", listing.select(F.col("name").alias("path"))).collect()] == [2]


def test_dereference_strips_line_ends(spark, tmp_path):
    (tmp_path / "f.rs").write_text("\n\tcode \r\n\n")
    (tmp_path / "g.rs").write_text("\n")
    tasks = spark.createDataFrame([(i, f"{tmp_path}/{n}.rs") for i, n in enumerate("fgh")], "id long, p string")
    found, missing = readers.dereference(tasks, readers.whole_files(spark, str(tmp_path)), "p", "t")
    assert sorted((r["id"], r["t"]) for r in found.collect()) == [(0, "code"), (1, "")]
    assert [r["id"] for r in missing.collect()] == [2]


RECORD = {"id": "a", "split": "train", "family": "f", "prompt_path": "p", "rust_path": "r"}


@pytest.mark.parametrize(("lines", "figures", "tasks"), [
    ([json.dumps(RECORD), "\t", "{bad", json.dumps(RECORD)], {"records": 3, "with_errors": 1}, 1),
    (["", " \t "], {"records": 0, "with_errors": 0}, 0), ([], {"records": 0, "with_errors": 0}, 0),
    (["[1]", json.dumps(RECORD | {"deps": None})], {"records": 2, "with_errors": 2}, 0),
])
def test_a_manifest_in_one_pass(spark, tmp_path, lines, figures, tasks):
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    seen = Observation("manifest")
    rows = gates.parse_manifest(readers.numbered_lines(spark, str(tmp_path / "m.jsonl")), seen).collect()
    assert gates.observed(seen) == figures and len(rows) == figures["records"]
    assert sum(not r["errors"] for r in rows) == tasks
    assert gates.manifest_problems(seen) == ([] if tasks else ["manifest contains no task records"])


def test_places_and_fixed_order(spark):
    df = spark.range(5_000).select(F.xxhash64("id").alias("x"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a").alias("g"), "id")
    placed = order.with_place(df, order.fixed_order("g", ["b", "a"]), "x").collect()
    assert [r["id"] for r in sorted(placed, key=lambda r: r["place"])] == [r["id"] for r in sorted(df.collect(), key=lambda r: ({"b": 0, "a": 1}.get(r["g"], 2), r["x"]))]
    assert [r["place"] for r in sorted(placed, key=lambda r: r["place"])] == list(range(1, 5_001))
    assert order.with_place(df.filter("false"), "x").count() == 0


def test_files_keep_an_order(spark, tmp_path):
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"))
    writers.write_in_order(df, str(tmp_path / "o"), "x")
    read = [json.loads(line)["x"] for f in sorted(p for p in (tmp_path / "o").iterdir() if p.name.startswith("part-")) for line in f.read_text().splitlines()]
    assert read == sorted(read) and len(read) == 20_000


def test_a_converter_runs_once_and_on_one_arm_only(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "base", "a"), (2, "wordy", "b"), (3, "wordy", None), (4, None, "d"), (5, "wordy", "e")], "id long, arm string, prediction string")

    def convert(batches):
        for pdf in batches:
            ran.add(len(pdf))
            yield pdf.assign(ok=[None if i == 5 else x is not None for i, x in zip(pdf["id"], pdf["prediction"], strict=True)], output="code", error="Error: Bad\n  input: x")

    def converter(rows):
        return rows.mapInPandas(convert, "id long, arm string, prediction string, ok boolean, output string, error string")

    done = arms.convert_arm(df, "wordy", converter, str(tmp_path / "converted"))
    for _ in range(2):
        got = {r["id"]: (r["transform_ok"], r["code"], r["transform_error"], r["kind"]) for r in done.withColumn("kind", arms.error_kind(F.col("transform_error"))).collect()}
    assert ran.value == 3
    failed = (False, "", "Error: Bad input: x", "bad_input")
    assert got == {1: (True, "a", "", None), 2: (True, "code", "", None), 3: failed, 4: (True, "d", "", None), 5: failed}
    empty = arms.convert_arm(df.filter("false"), "wordy", converter, str(tmp_path / "empty"))
    assert empty.count() == 0


def test_error_kinds(spark):
    df = spark.createDataFrame([("Error: Parse error: x",), ("Oxidation failed: y",), ("",), (None,), ("12 things",)], "e string")
    assert [r[0] for r in df.select(arms.error_kind(F.col("e"))).collect()] == ["parse_error", "oxidation_failed", None, None, "other"]


def test_rows_without_a_language_are_counted(spark):
    df = spark.createDataFrame([(None, "train"), (None, "val"), (None, "train"), ("de", "other")], "language string, split string")
    got = {(r["language"], r["split"]): r["rows"] for r in writers.export_summary(df).collect()}
    assert got == {(None, "train"): 2, (None, "val"): 1, (None, "test"): 0, ("de", "train"): 0, ("de", "val"): 0, ("de", "test"): 0}


def test_documents_with_their_rows(spark, tmp_path):
    rows = [(i, "f", a, s, i % 2 == 0, i % 3 == 0, False, "Parse error", "cannot find x", "assertion failed") for i in range(12) for a, s in (("base", i % 2), ("wordy", 0))]
    results = spark.createDataFrame(rows, "id long, family string, arm string, seed long, transform_ok boolean, compile_ok boolean, test_ok boolean, transform_error string, compile_error string, test_error string")
    docs = reports.documents_with_rows(results.withColumn("id", F.col("id").cast("string")), "base", "wordy", "seed")
    files.write_row_files(reports.document_files(docs, F.concat("seed", F.lit(".json"))), f"file://{tmp_path}/r")
    back = readers.json_documents(spark, f"seed long, {readers.report_schema('base', 'wordy')}", f"{tmp_path}/r/*.json").collect()
    assert {r["seed"]: (r["base"]["total"], r["wordy"] and len(r["wordy"]["rows"])) for r in back} == {0: (6, 12), 1: (6, None)}
    assert json.loads((tmp_path / "r/0.json").read_text())["base"]["rows"][0]["transform_error"] == "Parse error"


def test_documents_move_rows_once(spark):
    """Counts and rows of a document come from one pass over the results, dealt out once."""
    results = spark.range(100).select(
        "id", F.lit("f").alias("family"), F.when(F.col("id") % 2 == 0, "base").otherwise("wordy").alias("arm"), (F.col("id") % 5).alias("seed"), *[F.lit(True).alias(f"{p}_ok") for p in ("transform", "compile", "test")],
        *[F.lit("").alias(f"{p}_error") for p in ("transform", "compile", "test")],
    )
    plan = reports.documents_with_rows(results, "base", "wordy", "seed")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Range (") == 1

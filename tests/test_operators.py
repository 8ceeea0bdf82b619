import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate, chat, gates, marts, score, taskgen
from tessera.sources import readers, writers

GOOD = {"id": "a", "split": "train", "family": "f", "prompt_path": "p", "rust_path": "r"}


def parsed(spark, *lines):
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, value string")
    return {r["line"]: r for r in gates.parse_manifest(df).collect()}


def test_manifest_rules(spark):
    rows = [
        json.dumps(GOOD), "", "{bad", "[1]", json.dumps(GOOD | {"id": ""}), json.dumps(GOOD | {"id": 7}), json.dumps(GOOD | {"id": "b", "split": "dev"}),
        json.dumps(GOOD | {"id": "c", "deps": None}), json.dumps(GOOD | {"id": "d", "deps": ["x", 1]}), json.dumps(GOOD | {"id": "e", "unsafe": None}),
        json.dumps(GOOD), json.dumps(GOOD | {"id": "g", "tests_path": None, "deps": ["x"], "unsafe": True}), json.dumps(GOOD | {"id": "", "split": 1}),
        json.dumps(GOOD | {"id": "h", "deps": []}), json.dumps(GOOD | {"id": "i", "tests_path": 3}),
    ]
    found = parsed(spark, *rows)
    assert 2 not in found and len(found) == 14
    assert found[1]["errors"] == [] and found[1]["deps"] == [] and found[1]["unsafe"] is False
    assert found[3]["errors"] == ["line 3: invalid JSON"]
    assert found[4]["errors"] == ["line 4: each JSONL record must be an object"]
    assert found[5]["errors"] == found[6]["errors"][:0] + ["line 5: 'id' must be a non-empty string"]
    assert found[6]["errors"] == ["line 6: 'id' must be a non-empty string"]
    assert "split" in found[7]["errors"][0]
    assert found[8]["errors"] == ["line 8: 'deps' must be a string list"]
    assert found[9]["errors"] == ["line 9: 'deps' must be a string list"]
    assert found[10]["errors"] == ["line 10: 'unsafe' must be boolean"]
    assert found[11]["errors"] == ["line 11: duplicate id 'a'"]
    assert found[12]["errors"] == [] and found[12]["deps"] == ["x"] and found[12]["unsafe"] is True
    assert len(found[13]["errors"]) == 2
    assert found[14]["errors"] == []
    assert found[15]["errors"] == ["line 15: 'tests_path' must be a string when present"]


def test_policy_and_files(spark):
    tasks = spark.createDataFrame([("a", ["x"], False, [], "p1"), ("b", [], True, [], "p2")], "id string, deps array<string>, unsafe boolean, errors array<string>, prompt_path string")
    assert [len(r["errors"]) for r in gates.policy_errors(tasks).orderBy("id").collect()] == [1, 1]
    assert [len(r["errors"]) for r in gates.policy_errors(tasks, allow_deps=True).orderBy("id").collect()] == [0, 1]
    assert [r["id"] for r in gates.missing_files(tasks, "prompt_path", spark.createDataFrame([("p1",)], "path string")).collect()] == ["b"]


def test_split_hygiene(spark):
    tasks = spark.createDataFrame([("f", "val"), ("f", "train"), ("g", "val")], "family string, split string")
    assert [tuple(r) for r in gates.split_hygiene(tasks, "family", "split").collect()] == [("f", "train, val")]


RESULTS = "run_key string, seed int, arm string, id string, family string, transform_ok boolean, compile_ok boolean, test_ok boolean, transform_error string, compile_error string, test_error string"


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    for seed, passes in ((1, 1), (2, 3)):
        for arm, more in (("base", 0), ("wordy", 1)):
            for i in range(4):
                ok = i < passes + more
                rows.append(("r1", seed, arm, f"t{i}", "f" if i else "g", True, ok, ok, "", "" if ok else "mismatched types", ""))
    return spark.createDataFrame(rows, RESULTS)


def test_mean_of_rates_not_pooled(results):
    got = {r["arm"]: r for r in aggregate.summary_over_seeds(results, "seed", "arm").collect()}
    assert got["base"]["test_at_1_mean"] == pytest.approx(0.5) and got["base"]["test_at_1_std"] == pytest.approx(0.25)
    assert got["wordy"]["test_at_1_mean"] == pytest.approx(0.75)
    one = aggregate.summary_over_seeds(results.filter("seed = 1"), "seed", "arm").first()
    assert one["test_at_1_std"] == 0.0


def test_marts(results):
    row = marts.metrics_by_run(results, "base", "wordy").first()
    assert row["num_reports"] == 2 and row["delta_test"] == 0.25 and row["wordy_compile_at_1_std"] == 0.25
    assert marts.failure_rows(results).count() == 3 + 2 + 1 + 0
    assert marts.seed_metrics(results).count() == 4
    assert marts.family_metrics_by_run(results).count() == 4
    tax = {(r["arm"], r["failure_class"]): r["count"] for r in aggregate.report_taxonomy(results, "arm").collect()}
    assert tax == {("base", "type_mismatch"): 4, ("wordy", "type_mismatch"): 2}


def test_most_common_ties_by_first(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "pos int, x string")
    assert [r["x"] for r in score.most_common(df, "x", "pos").collect()] == ["b", "a", "c"]


def test_parity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, status string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "y")], "id int, status string")
    assert {(r["id"], r["side"]) for r in score.one_sided(a, b, "id").collect()} == {(1, "left"), (4, "right")}
    assert {r["id"] for r in score.mismatches(a, b, "id", "status").collect()} == {1, 2, 4}


def test_split_counts_and_order(spark):
    tasks = spark.createDataFrame([("v1", "train"), ("v1", "odd"), ("v1", "test")], "dataset_version string, split string")
    row = marts.split_counts(tasks, "dataset_version").first()
    assert (row["train_count"], row["val_count"], row["test_count"], row["total_count"]) == (1, 0, 1, 2)
    df = spark.createDataFrame([("wordy",), ("zzz",), ("base",)], "arm string")
    assert [r["arm"] for r in marts.in_order(df, "arm", ["base", "wordy"]).collect()] == ["base", "wordy", "zzz"]


def test_dataset_overview(spark):
    tasks = spark.createDataFrame([("v1", "f", "train"), ("v1", "", "val"), ("v2", "g", "test")], "dataset_version string, family string, split string")
    gate = spark.createDataFrame([("v1", True)], "dataset_version string, all_pass boolean")
    exports = spark.createDataFrame([("v1", "rust", "train", 1)], "dataset_version string, language string, split string, rows long")
    generation = spark.createDataFrame([("v2", 160, ["a", "b"])], "dataset_version string, added_tasks long, families_added array<string>")
    got = {r["dataset_version"]: r for r in marts.dataset_overview(tasks, gate, exports, generation).collect()}
    assert got["v1"]["family_count"] == 1 and got["v1"]["all_pass"] == "true" and got["v1"]["families_added"] == ""
    assert got["v2"]["families_added"] == "a;b" and got["v2"]["export_rust_train"] == ""


def test_task_grid_counts(spark):
    tasks = taskgen.extend(taskgen.task_grid(spark), taskgen.task_grid(spark, taskgen.ADDED_FAMILIES))
    assert tasks.count() == 380
    assert tasks.filter("id = 'vec_pop_007'").first()["split"] == "test"
    assert tasks.filter("id = 'mul_const_004'").first()["code"] == "pub fn mul_const_004(x: i32) -> i32 {\n    x * 5\n}"
    assert json.loads(taskgen.manifest_rows(tasks.filter("id = 'vec_pop_007'")).first()["value"])["rust_path"] == "rust/vec_pop_007.rs"
    summary = taskgen.generation_summary(tasks, "v1").first()
    assert (summary["total_tasks"], summary["added_tasks"], len(summary["families_added"])) == (380, 160, 3)
    with pytest.raises(ValueError):
        taskgen.extend(tasks, tasks)


def test_chat_rows_and_writers(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "f", "train", "Task", "code"), ("b", "f", "extra", "Task", "code")], "id string, family string, split string, prompt string, code string")
    rows = chat.chat_rows(tasks, "rust", "prompt", "code", F.lit("pub fn a()"), "src")
    assert rows.first()["conversations"][1]["content"] == "code"
    writers.write_chat_rows(rows, str(tmp_path / "chat"))
    assert spark.read.json(str(tmp_path / "chat")).count() == 1
    assert sorted(p.name for p in (tmp_path / "chat").iterdir() if p.is_dir()) == ["split=test", "split=train", "split=val"]
    summary = {(r["language"], r["split"]): r["rows"] for r in writers.export_summary(rows).collect()}
    assert summary == {("rust", "train"): 1, ("rust", "val"): 0, ("rust", "test"): 0}
    writers.write_csv_table(tasks, ["split", "id"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["split", "id"]


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps(GOOD) + "\n\n{bad\n")
    lines = readers.numbered_lines(spark, str(tmp_path / "m.jsonl"))
    assert [(r["line"], r["value"]) for r in lines.filter("value <> ''").orderBy("line").collect()][1] == (3, "{bad")
    arm = {"arm": "base", "total": 1, "transform_pass": 1, "compile_pass": 0, "test_pass": 0, "compile_at_1": 0.0, "test_at_1": 0.0, "per_family": {"f": {"total": 1, "compile": 0, "test": 0}},
           "rows": [{"id": "a", "family": "f", "arm": "base", "transform_ok": True, "compile_ok": False, "test_ok": False, "transform_error": "", "compile_error": "cannot find x", "test_error": ""}]}
    (tmp_path / "r.json").write_text(json.dumps({"inputs": {}, "base": arm, "wordy": arm | {"arm": "wordy"}}, indent=2))
    with pytest.warns(UserWarning, match="none.json"):
        reports = readers.optional_documents(spark, readers.report_schema("base", "wordy"), str(tmp_path / "r.json"), str(tmp_path / "none.json"))
    rows = aggregate.result_rows(reports, ("base", "wordy"), "path")
    assert rows.count() == 2 and {r["arm"] for r in rows.collect()} == {"base", "wordy"}
    assert reports.first()["base"]["failure_taxonomy"] is None
    with pytest.raises(FileNotFoundError):
        readers.optional_documents(spark, "a int", str(tmp_path / "none.json"))
    files = readers.whole_files(spark, str(tmp_path / "m.jsonl"))
    tasks = spark.createDataFrame([("a", str(tmp_path / "m.jsonl")), ("b", str(tmp_path / "no"))], "id string, p string")
    with_text, missing = readers.dereference(tasks, files, "p", "t")
    assert [r["id"] for r in with_text.collect()] == ["a"] and [r["id"] for r in missing.collect()] == ["b"]
    assert readers.first_complete(spark, [str(tmp_path / "x"), str(tmp_path)], ["m.jsonl", "r.json"]) == str(tmp_path)


def test_reports_as_json(spark):
    counts = spark.createDataFrame([("base", "x", 2), ("base", "a", 1)], "arm string, failure_class string, count long")
    doc = writers.json_report(writers.counts_as_map(counts, ["arm"], "failure_class", "count"), "arm", "counts").first()["value"]
    assert json.loads(doc) == {"arm": "base", "counts": {"a": 1, "x": 2}}
    assert writers.console_lines(counts, "%s %s %3d", "arm", "failure_class", "count").count() == 2


def test_lines_are_numbered_across_ranges(spark, tmp_path):
    """A file that several tasks read is numbered as one."""
    texts = [f"line {i}" if i % 7 else "" for i in range(1, 20_001)]
    (tmp_path / "big.txt").write_text("\n".join(texts) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in sorted(got, key=lambda r: r["line"])] == texts and {r["line"] for r in got} == set(range(1, 20_001))


def test_settings_and_names(spark):
    from tessera.functions.classify import evaluation_class
    from tessera.operators import reports

    assert json.loads(reports.settings_document(spark, model="m", seeds=2).first()["value"]) == {"model": "m", "seeds": 2}
    df = spark.createDataFrame([("parse error", "transform"), ("mismatched types", "compile")], "m string, p string")
    named = evaluation_class(F.col("m"), F.col("p"), {"wordy_parse_error": "other_name"})
    assert sorted(r[0] for r in df.select(named).collect()) == ["other_name", "type_mismatch"]

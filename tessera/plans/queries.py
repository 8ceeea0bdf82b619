"""Registered queries on the driver's tables, each with the same query in DuckDB's SQL.

Each applies an operator of this package to the columns at hand: `source` or
`event_type` stands for a family, `lang` for a split, a day for a seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.classify import failure_phase
from tessera.operators import aggregate, chat, gates, marts, reports, score, taskgen
from tessera.plans import sources
from tessera.plans.tables import COLLAPSED, RATES, RESERVED, RESULTS_SQL, TASKS_SQL, results, table, tasks
from tessera.sources import readers, writers
from tessera.sources.scratch import scratch_folder


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def split_hygiene(spark, d):
    return gates.split_hygiene(table(spark, d, "documents"), "source", "lang")


def dup_first_wins(spark, d):
    return gates.first_by_key(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


def pass_rates(spark, d):
    return score.pass_counts(results(spark, d), "arm", "family")


def seed_mean_std(spark, d):
    measures = [f"{m}_{s}" for m in ("transform_rate", "compile_at_1", "test_at_1") for s in ("mean", "std")]
    return _rounded(aggregate.summary_over_seeds(results(spark, d), "seed", "arm"), *measures)


def family_mean_std(spark, d):
    found = aggregate.summary_over_seeds(results(spark, d), "seed", "arm", "family")
    return _rounded(found.select("arm", "family", "compile_at_1_mean", "compile_at_1_std", "test_at_1_mean", "test_at_1_std"), "compile_at_1_mean", "compile_at_1_std", "test_at_1_mean", "test_at_1_std")


def arm_delta(spark, d):
    rates = score.pass_counts(results(spark, d), "seed", "arm")
    return _rounded(aggregate.arm_delta(rates, ["seed"], "arm", "base", "wordy", "compile_at_1", "test_at_1"), "delta_compile_at_1", "delta_test_at_1")


def failure_rows(spark, d):
    return score.failures(results(spark, d)).select("id", "seed", "arm", "family", "failure_phase", "failure_class")


def phase_histogram(spark, d):
    flags = failure_phase(F.col("transform_ok"), F.col("compile_ok"), F.col("test_ok"))
    rows = results(spark, d).withColumn("failure_phase", flags).filter("failure_phase is not null")
    return score.histogram(rows, "family", "failure_phase")


def taxonomy_topk(spark, d):
    counts = score.histogram(score.failures(results(spark, d)), "family", "failure_class")
    return score.top_per_group(counts, "family", "failure_class", "count", 3)


def two_level_histogram(spark, d):
    found = score.two_level_histogram(score.failures(results(spark, d)), "arm", "family", "failure_class")
    return found.select("arm", "family", "failure_class", "count")


def report_taxonomy(spark, d):
    return aggregate.report_taxonomy(results(spark, d), "arm")


def zero_filled_days(spark, d):
    counts = score.histogram(score.failures(results(spark, d)), "arm", "failure_class")
    return marts.zero_filled(counts, "count", arm=["base", "wordy", "other"], failure_class=["name_resolution", "type_mismatch", "parse_error"])


def metrics_by_run(spark, d):
    found = results(spark, d).withColumn("run_key", F.concat(F.lit("run"), (F.col("id") % 3).cast("string")))
    return marts.metrics_by_run(found, "base", "wordy")


def strict_attribution(spark, d):
    found = results(spark, d).withColumn("protocol", F.when(F.col("id") % 3 == 0, "old").otherwise("new"))
    return score.pass_counts(aggregate.recombined(found, "protocol", "arm", {"base": "old", "wordy": "new"}), "arm").select("arm", "total", "test_pass")


def validate_symbols(spark, d):
    """Pages as they are, and without their tags and entities."""
    bare = F.regexp_replace("html", r"<[^>]*>|&[a-z]+;|&#[0-9]+;", " ")
    return table(spark, d, "pages").select("page_id", T.has_only_words(F.col("html")).alias("valid"), T.has_only_words(bare).alias("bare_valid"))


def single_line(spark, d):
    return table(spark, d, "documents").select("doc_id", T.single_line(F.col("text")).alias("line"))


def compact(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compact(F.col("text")).alias("line"))


def crate_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.crate_name(F.col("url")).alias("name"))


def first_user_prompt(spark, d):
    chats = chat.collect_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return chats.select("conv_id", T.first_message(F.col("conversations"), "user").alias("prompt"))


def chat_rows(spark, d):
    chats = chat.collect_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return chats.select("conv_id", chat.render(F.col("conversations")).alias("rendered"))


def clean_generation(spark, d):
    fenced = F.concat(F.lit("```rust\n"), "text", F.lit("\n```"))
    raw = F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.concat(F.lit("  "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_generation(raw).alias("clean"))


def split_pivot(spark, d):
    return marts.split_counts(table(spark, d, "documents"), "source", split="lang", names=("de", "en", "es", "fr"))


def missing_labels(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def arm_parity(spark, d):
    return score.one_sided(table(spark, d, "documents"), table(spark, d, "labels").withColumn("doc_id", F.col("doc_id") + 3), "doc_id")


def label_mismatches(spark, d):
    labels = table(spark, d, "labels")
    return score.mismatches(labels.select("doc_id", F.col("quality").alias("value")), labels.select("doc_id", F.col("toxic").alias("value")), "doc_id", "value")


def _gated(spark, d):
    """Labels as task results; a family whose tasks differ in quality is in two splits."""
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    results = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 7).cast("string").alias("family"), F.when(good, "train").otherwise("val").alias("split"), (~clean).alias("used_verbatim"),
        (good | clean).alias("reduce_ok"), good.alias("restore_ok"), clean.alias("reduce_deterministic"), good.alias("roundtrip_compile_ok"),
        F.when(good, F.array()).otherwise(F.array(F.lit("bad"))).alias("errors"),
    )
    return results, gates.gate_report(results, gates.split_hygiene(results, "family", "split"), 0.9)


def purity_gate(spark, d):
    return _gated(spark, d)[1]


def gate_lines(spark, d):
    return reports.gate_lines(_gated(spark, d)[1], 0.9)


def gate_documents(spark, d):
    results, report = _gated(spark, d)
    docs = reports.gate_documents(report, gates.split_hygiene(results, "family", "split"), results)
    fields = {"id": "id", "family": "family", "total": "total_tasks", "purity": "purity_ratio", "all_pass": "all_pass", "reduce_ok": "reduce_ok", "errors": "errors[0]"}
    return docs.select("kind", *[F.get_json_object("value", f"$.{path}").alias(name) for name, path in fields.items()])


def sanitize(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word"))
    return words.groupBy("word", T.sanitize_identifier(F.col("word")).alias("name")).agg(F.count("*").alias("n"))


def round6(spark, d):
    price = T.round6(F.col("l_extendedprice") * F.col("l_discount") / 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", price.alias("value")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def task_code(spark, d):
    return tasks(spark, d).select("id", "family", "number", "prompt", "code")


def signatures(spark, d):
    """Every fourth task has no public function; of others the return type stands on the next line, or another function comes first."""
    code = F.when(F.col("number") % 4 == 0, F.replace("code", F.lit("pub fn"), F.lit("fn"))).when(F.col("number") % 4 == 1, F.replace("code", F.lit(" -> "), F.lit("\n\t-> ")))
    code = code.when(F.col("number") % 4 == 2, F.concat("code", F.lit("\n\npub fn other(a: u8)  ->  u8 {\n  a\n}"))).otherwise(F.col("code"))
    return tasks(spark, d).select("id", T.function_name(code).alias("name"), T.code_signature(code, F.col("id")).alias("signature"))


def expected_values(spark, d):
    values = T.expected_value(F.col("family"), F.col("prompt"))
    return tasks(spark, d).select("id", F.array_join(F.transform(values, lambda v: F.concat(v["call"], F.lit("="), v["value"])), ", ").alias("expected"))


def contract_prompts(spark, d):
    """Prompts with their contract; those that have one stay as they are."""
    once = T.with_contract(F.concat(F.lit("\t\n"), "prompt", F.lit(" \r\n\n")), T.code_signature(F.col("code"), F.col("id")))
    return tasks(spark, d).select("id", T.with_contract(once, F.lit("x")).alias("prompt"))


def wordy_signatures(spark, d):
    source = F.concat(F.lit("note that\nfunction other\nbegin\nend\n\tfunction "), "id", F.lit("\t\n\t takes "), "p_brand", F.lit("\n\t\n  returns integer\n\tbegin\n  return\nend"))
    return tasks(spark, d).select("id", T.wordy_signature(source, F.col("id")).alias("signature"))


def generation_summary(spark, d):
    found = taskgen.generation_summary(tasks(spark, d), "part")
    return found.withColumn("families_added", F.array_join("families_added", ", "))


def task_files(spark, d):
    named = tasks(spark, d).withColumns({"prompt_path": F.concat(F.lit("prompts/"), "id"), "rust_path": F.concat(F.lit("rust/"), "id")})
    return taskgen.task_files(named.withColumn("code", F.concat("code", F.lit("\n\t\n"))))


def task_prompts(spark, d):
    named = tasks(spark, d)
    old = F.concat(F.lit("# Task\n\nUse brand "), "p_brand", F.lit(".\n\n" + T.CONTRACT_MARKER + "\n`old`\nKeep it.\n"))
    return named.select("id", T.user_prompt(old, "Rust", T.code_signature(F.col("code"), F.col("id"))).alias("prompt"))


def manifest_errors(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_id") % 6
    record = F.concat(
        F.lit('{"id":"'), F.pmod(F.col("event_id"), F.lit(5000)).cast("string"), F.lit('","split":"'), F.when(kind == 1, "dev").otherwise("train"),
        F.lit('","family":"'), F.col("event_type"), F.lit('","prompt_path":'), F.when(kind == 2, "7").otherwise('"p.md"'), F.lit(',"rust_path":"r.rs"'),
        F.when(kind == 3, ',"deps":null').otherwise(""), F.when(kind == 4, ',"unsafe":"no"').otherwise(""), F.when(kind == 5, "").otherwise("}"),
    )
    blank = e.select((-F.col("event_id") - 1).alias("line"), F.lit("\t \r").alias("value"))
    lines = e.select((F.col("event_id") + 1).alias("line"), F.concat(F.lit("\t"), record, F.lit("\r")).alias("value")).unionByName(blank)
    return gates.parse_manifest(lines).select("line", "id", F.array_join("errors", "; ").alias("errors"))


def seed_reports(spark, d):
    """Report documents of each seed and arm, their maps written out."""
    docs = reports.seed_documents(results(spark, d), "base", "wordy", "seed")
    arms = docs.select("seed", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("r")) for a in ("base", "wordy")])).alias("x")).select("seed", "x.arm", "x.r")

    def pairs(column, value=lambda v: v.cast("string")):
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ", ")

    families = pairs(F.col("r.per_family"), lambda v: F.concat(v["total"].cast("string"), F.lit("/"), v["compile"].cast("string"), F.lit("/"), v["test"].cast("string")))
    return arms.filter("r is not null").select("seed", "arm", "r.total", "r.transform_pass", families.alias("families"), pairs(F.col("r.failure_phase_counts")).alias("phases"), pairs(F.col("r.failure_taxonomy")).alias("classes"))


def run_rows(spark, d):
    """Runs joined to their reports by path, as flat rows; one run's report is missing."""
    found = results(spark, d)
    aggregates = reports.aggregate_documents(found.withColumn("report_path", F.concat(F.lit("agg/"), (F.col("id") % 3).cast("string"))), "seed", "base", "wordy", "report_path")
    seeds = reports.seed_documents(found.withColumn("report_path", F.concat(F.lit("seed/"), "seed")), "base", "wordy", "report_path")
    paths = aggregates.select("report_path", F.lit("aggregate").alias("kind")).unionByName(seeds.select("report_path", F.lit("seed").alias("kind")))
    specs = paths.unionByName(reports.run_specs(spark, [("none", "none", "seed", "gone/1")]).select("report_path", "kind"))
    specs = specs.select(F.concat(F.lit("run "), "report_path").alias("run_key"), F.upper("report_path").alias("run_label"), "kind", "report_path")
    return reports.run_rows(specs, aggregates, seeds, "base", "wordy")


def summary_lines(spark, d):
    return reports.summary_lines(results(spark, d), "seed")


def aggregate_lines(spark, d):
    return reports.aggregate_lines(reports.aggregate_documents(results(spark, d).withColumn("run", F.col("id") % 3), "seed", "base", "wordy", "run"), "base", "wordy", "run")


def top_classes(spark, d):
    return reports.top_classes(results(spark, d), 5, "arm")


def seed_metrics(spark, d):
    return marts.seed_metrics(results(spark, d))


def enough_successes(spark, d):
    return reports.at_least(table(spark, d, "documents"), T.uses_verbatim(F.col("text")) | (F.length("text") > 1000), 3)


def restored_names(spark, d):
    names = table(spark, d, "customer").select(F.concat(F.lit("user_"), F.lower("c_mktsegment")).alias("word")).unionByName(table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")))
    return names.groupBy("word", T.restore_identifier(T.sanitize_identifier(F.col("word"))).alias("name")).agg(F.count("*").alias("n"))


def export_summary(spark, d):
    split = F.element_at(F.array(*[F.lit(x) for x in ("train", "val", "extra", "train")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return writers.export_summary(table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("language"), split.alias("split")))


def dereferenced(spark, d):
    """Documents that name a page by path, with its text, and those whose page is missing."""
    manifest = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/pages/"), (F.col("doc_id") * 2).cast("string")).alias("p"))
    files = table(spark, d, "pages").select(F.concat(F.lit("file:///pages/"), F.col("page_id").cast("string")).alias("path"), F.concat(F.lit("\t"), "url", F.lit(" \n\r\n")).alias("value"))
    found, missing = readers.dereference(manifest, files, "p", "text")
    return found.unionByName(missing.withColumn("text", F.lit(None).cast("string"))).select("doc_id", "text")


def resolved_paths(spark, d):
    number = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../a/./b/../c//d"), number)).otherwise(F.concat(F.lit("../a/../../../d"), number))
    return table(spark, d, "pages").select("page_id", T.resolve_path(F.lit("/data/x"), path).alias("path"))


def unique_union(spark, d):
    one = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return taskgen.extend(one, table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")))


def missing_paths(spark, d):
    """Documents whose page file is missing."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("pages/"), (F.col("doc_id") * 3).cast("string")).alias("p"))
    return gates.missing_files(rows, "p", table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"))).select("doc_id", "p")


def policy_errors(spark, d):
    none = F.expr("cast(array() as array<string>)")
    deps = F.when(F.col("toxic") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    rows = table(spark, d, "labels").select("doc_id", deps.alias("deps"), (F.col("quality") == 0).alias("unsafe"), none.alias("errors"))
    strict = gates.policy_errors(rows).withColumn("strict", F.array_join("errors", "; ")).withColumn("errors", none)
    lax = gates.policy_errors(strict, allow_deps=True)
    return lax.select("doc_id", F.col("strict").alias("errors"), F.array_join("errors", "; ").alias("with_deps"))


def task_rows(spark, d):
    """Training rows of tasks, their conversations rendered."""
    split = F.element_at(F.array(*[F.lit(x) for x in ("train", "val", "test")]), (F.col("number") % 3 + 1).cast("int"))
    rows = chat.chat_rows(tasks(spark, d).withColumn("split", split), "rust", "prompt", "code", T.code_signature(F.col("code"), F.col("id")), "part")
    return rows.withColumn("conversations", chat.render(F.col("conversations")))


def _versions(spark, d):
    """Documents as tasks of a dataset version, their language."""
    split = F.element_at(F.array(*[F.lit(x) for x in ("train", "val", "extra", "test")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("dataset_version"), F.col("source").alias("family"), split.alias("split"))


def dataset_overview(spark, d):
    """Dataset versions with what side tables say about some of them."""
    rows = _versions(spark, d)
    gated = rows.filter("dataset_version < 'f'").join(table(spark, d, "labels"), "doc_id").groupBy("dataset_version").agg((F.count_if(F.col("toxic") == 1) == 0).alias("all_pass"))
    exports = rows.filter("split <> 'extra'").groupBy("dataset_version", F.lit("rust").alias("language"), "split").agg(F.count("*").alias("rows"))
    generation = rows.filter("split = 'extra'").groupBy("dataset_version").agg(F.count("*").alias("added_tasks"), F.array_sort(F.collect_set("family")).alias("families_added")).filter("added_tasks % 2 = 0")
    return marts.dataset_overview(rows, gated, exports, generation)


def family_metrics_by_run(spark, d):
    return marts.family_metrics_by_run(results(spark, d).withColumn("run_key", F.concat(F.lit("run"), (F.col("id") % 3).cast("string"))))


def exported_rows(spark, d):
    """Turns written as JSON rows by split and language, and read back by split."""
    split = F.element_at(F.array(*[F.lit(x) for x in ("train", "val", "test", "extra")]), (F.col("conv_id") % 4 + 1).cast("int"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", split.alias("split"), F.when(F.col("turn") % 2 == 0, "rust").otherwise("wordy").alias("language"))
    path = scratch_folder(spark, "exported-rows")
    writers.write_chat_rows(turns, path)
    return readers.splits(spark, "conv_id long, turn long, role string, text string, language string", **{s: f"{path}/split={s}" for s in writers.SPLITS})


def written_lines(spark, d):
    """Page addresses written as text files, read back as numbered lines and as whole files."""
    path = scratch_folder(spark, "written-lines")
    writers.write_texts(table(spark, d, "pages").filter("url is not null"), "url", path)
    files = readers.numbered_lines(spark, path).groupBy("path").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.count_distinct("line").alias("numbers"), F.sum(F.length("value")).alias("chars"))
    whole = readers.whole_files(spark, path).select("path", F.length("value").alias("whole"))
    checked = files.join(whole, "path").agg(F.sum("n").alias("lines"), F.sum("chars").alias("chars"), F.sum("whole").alias("whole_chars"), F.bool_and((F.col("n") == F.col("last")) & (F.col("n") == F.col("numbers"))).alias("gapless"))
    return checked


def metrics_csv(spark, d):
    """Seed metrics written as a CSV table and read back."""
    path, metrics = scratch_folder(spark, "metrics-csv"), marts.seed_metrics(results(spark, d))
    writers.write_csv_table(metrics, metrics.columns, path)
    return spark.read.schema(metrics.schema).csv(path, header=True)


QUERIES = {
    f.__name__: f
    for f in (
        split_hygiene, dup_first_wins, pass_rates, seed_mean_std, family_mean_std, arm_delta, failure_rows, phase_histogram, taxonomy_topk,
        two_level_histogram, report_taxonomy, zero_filled_days, metrics_by_run, strict_attribution, validate_symbols, single_line,
        compact, crate_name, first_user_prompt, chat_rows, clean_generation, split_pivot, missing_labels, arm_parity, label_mismatches, purity_gate,
        sanitize, round6, task_code, signatures, task_prompts, manifest_errors, gate_lines, gate_documents, expected_values, contract_prompts,
        wordy_signatures, generation_summary, task_files, seed_reports, run_rows, summary_lines, aggregate_lines, top_classes, seed_metrics,
        enough_successes, restored_names, export_summary, dereferenced, resolved_paths, unique_union,
        missing_paths, policy_errors, task_rows, dataset_overview, family_metrics_by_run, exported_rows, written_lines, metrics_csv,
    )
} | sources.QUERIES

_RUN_STATS = ", ".join(
    f"round_even(max({m}) FILTER (arm = '{a}'), 6) AS {a}_{name}_mean, round_even(max({m}d) FILTER (arm = '{a}'), 6) AS {a}_{name}_std"
    for a in ("base", "wordy") for m, name in (("co", "compile_at_1"), ("te", "test_at_1"), ("tr", "transform_rate"))
)
_STATS = "avg(co) AS co, stddev_pop(co) AS cod, avg(te) AS te, stddev_pop(te) AS ted, avg(tr) AS tr, stddev_pop(tr) AS trd"
_DELTAS = "round_even(max(co) FILTER (arm = 'wordy') - max(co) FILTER (arm = 'base'), 6) AS delta_compile, round_even(max(te) FILTER (arm = 'wordy') - max(te) FILTER (arm = 'base'), 6) AS delta_test"
_GATED_SQL = """gated AS (SELECT *, stable_count = total_tasks AS gate_pipeline_stability, deterministic_count = total_tasks AS gate_determinism, compile_count = total_tasks AS gate_data_quality,
        purity_ratio >= 0.9 AS gate_purity, split_errors = 0 AS gate_split_hygiene FROM (SELECT count(*) AS total_tasks, count(*) FILTER (quality = 0) AS tasks_with_errors,
        count(*) FILTER (quality = 1) AS stable_count, count(*) FILTER (toxic = 0) AS deterministic_count, count(*) FILTER (quality = 1) AS compile_count, count(*) FILTER (toxic = 0) AS non_verbatim_count,
        count(DISTINCT doc_id % 7) AS families, count(*) FILTER (toxic = 0) / count(*)::DOUBLE AS purity_ratio,
        (SELECT count(*) FROM (SELECT doc_id % 7 FROM labels GROUP BY 1 HAVING count(DISTINCT quality) > 1)) AS split_errors FROM labels)),
      decided AS (SELECT *, gate_pipeline_stability AND gate_determinism AND gate_data_quality AND gate_purity AND gate_split_hygiene AS all_pass FROM gated)"""
_SEED_METRICS_SQL = f"""WITH {RESULTS_SQL} SELECT seed, arm, count(*) AS total, count(*) FILTER (transform_ok) AS transform_pass, count(*) FILTER (compile_ok) AS compile_pass, count(*) FILTER (test_ok) AS test_pass,
    round_even(count(*) FILTER (transform_ok) / count(*)::DOUBLE, 6) AS transform_rate, round_even(count(*) FILTER (compile_ok) / count(*)::DOUBLE, 6) AS compile_at_1,
    round_even(count(*) FILTER (test_ok) / count(*)::DOUBLE, 6) AS test_at_1 FROM results GROUP BY ALL"""

SQL = {
    "split_hygiene": "SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1",
    "dup_first_wins": "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1",
    "pass_rates": f"""WITH {RESULTS_SQL} SELECT arm, family, count(*) AS total, count(*) FILTER (transform_ok) AS transform_pass, count(*) FILTER (compile_ok) AS compile_pass,
        count(*) FILTER (test_ok) AS test_pass, count(*) FILTER (transform_ok) / count(*)::DOUBLE AS transform_rate, count(*) FILTER (compile_ok) / count(*)::DOUBLE AS compile_at_1,
        count(*) FILTER (test_ok) / count(*)::DOUBLE AS test_at_1 FROM results GROUP BY arm, family""",
    "seed_mean_std": f"""WITH {RESULTS_SQL}, rates AS (SELECT arm, seed, {RATES} FROM results GROUP BY arm, seed)
        SELECT arm, round(avg(tr), 6) AS transform_rate_mean, round(stddev_pop(tr), 6) AS transform_rate_std, round(avg(co), 6) AS compile_at_1_mean,
        round(stddev_pop(co), 6) AS compile_at_1_std, round(avg(te), 6) AS test_at_1_mean, round(stddev_pop(te), 6) AS test_at_1_std FROM rates GROUP BY arm""",
    "family_mean_std": f"""WITH {RESULTS_SQL}, rates AS (SELECT arm, family, seed, {RATES} FROM results GROUP BY arm, family, seed)
        SELECT arm, family, round(avg(co), 6) AS compile_at_1_mean, round(stddev_pop(co), 6) AS compile_at_1_std, round(avg(te), 6) AS test_at_1_mean,
        round(stddev_pop(te), 6) AS test_at_1_std FROM rates GROUP BY arm, family""",
    "arm_delta": f"""WITH {RESULTS_SQL}, rates AS (SELECT seed, arm, {RATES} FROM results GROUP BY seed, arm)
        SELECT seed, round(max(co) FILTER (arm = 'wordy') - max(co) FILTER (arm = 'base'), 6) AS delta_compile_at_1,
        round(max(te) FILTER (arm = 'wordy') - max(te) FILTER (arm = 'base'), 6) AS delta_test_at_1 FROM rates GROUP BY seed""",
    "failure_rows": f"WITH {RESULTS_SQL} SELECT id, seed, arm, family, failure_phase, failure_class FROM failed",
    "phase_histogram": f"WITH {RESULTS_SQL} SELECT family, failure_phase, count(*) AS count FROM failed GROUP BY family, failure_phase",
    "taxonomy_topk": f"""WITH {RESULTS_SQL}, counts AS (SELECT family, failure_class, count(*) AS count FROM failed GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY family ORDER BY count DESC, failure_class)::INTEGER AS rank FROM counts QUALIFY rank <= 3""",
    "two_level_histogram": f"WITH {RESULTS_SQL} SELECT arm, family, failure_class, count(*) AS count FROM failed GROUP BY GROUPING SETS ((arm, failure_class), (arm, family, failure_class))",
    "report_taxonomy": f"""WITH {RESULTS_SQL} SELECT arm, CASE WHEN failure_phase = 'transform' THEN 'wordy_parse_or_convert' WHEN failure_class = 'behavior_assertion' THEN 'other'
        ELSE failure_class END AS failure_class, count(*) AS count FROM failed GROUP BY ALL""",
    "zero_filled_days": f"""WITH {RESULTS_SQL}, grid AS (SELECT * FROM (VALUES ('base'), ('wordy'), ('other')) a(arm), (VALUES ('name_resolution'), ('type_mismatch'), ('parse_error')) c(failure_class))
        SELECT g.arm, g.failure_class, count(f.id) AS count FROM grid g LEFT JOIN failed f ON g.arm = f.arm AND g.failure_class = f.failure_class GROUP BY ALL""",
    "metrics_by_run": f"""WITH {RESULTS_SQL}, rates AS (SELECT 'run' || id % 3 AS run_key, arm, seed, {RATES} FROM results GROUP BY ALL), s AS (SELECT run_key, arm, {_STATS} FROM rates GROUP BY ALL)
        SELECT run_key, (SELECT count(DISTINCT seed) FROM rates r WHERE r.run_key = s.run_key) AS num_reports, {_RUN_STATS}, {_DELTAS} FROM s GROUP BY run_key""",
    "strict_attribution": f"""WITH {RESULTS_SQL} SELECT arm, count(*) AS total, count(*) FILTER (test_ok) AS test_pass FROM results
        WHERE (arm = 'base' AND id % 3 = 0) OR (arm = 'wordy' AND id % 3 <> 0) GROUP BY arm""",
    "validate_symbols": r"""SELECT page_id, length(translate(html, '&><*-', '')) = length(html) AND NOT contains(html, '::') AS valid, length(translate(bare, '&><*-', '')) = length(bare) AND NOT contains(bare, '::') AS bare_valid
        FROM (SELECT page_id, html, regexp_replace(html, '<[^>]*>|&[a-z]+;|&#[0-9]+;', ' ', 'g') AS bare FROM pages)""",
    "single_line": f"SELECT doc_id, CASE WHEN length(l) > 220 THEN substr(l, 1, 217) || '...' ELSE l END AS line FROM (SELECT doc_id, {COLLAPSED} AS l FROM documents)",
    "compact": f"SELECT doc_id, CASE WHEN length(l) > 300 THEN substr(l, 1, 300) || '...' ELSE l END AS line FROM (SELECT doc_id, {COLLAPSED} AS l FROM documents)",
    "crate_name": """SELECT page_id, CASE WHEN n = '' THEN 'task' WHEN regexp_matches(n, '^[0-9]') THEN 'task_' || n ELSE n END AS name
        FROM (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS n FROM pages)""",
    "first_user_prompt": "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS prompt FROM conversations GROUP BY conv_id",
    "chat_rows": "SELECT conv_id, string_agg('<' || role || '>' || chr(10) || text || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id",
    "clean_generation": r"""SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(regexp_replace(t, '^```[^\n]*\n?', ''), '\n?```\s*$', ''), '^\s+|\s+$', '', 'g') ELSE t END AS clean
        FROM (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN '```rust' || chr(10) || text || chr(10) || '```' ELSE '  ' || text END, '^\s+|\s+$', '', 'g') AS t FROM conversations)""",
    "split_pivot": """SELECT source, count(*) FILTER (lang = 'de') AS de_count, count(*) FILTER (lang = 'en') AS en_count, count(*) FILTER (lang = 'es') AS es_count,
        count(*) FILTER (lang = 'fr') AS fr_count, count(*) FILTER (lang IN ('de', 'en', 'es', 'fr')) AS total_count FROM documents GROUP BY source""",
    "missing_labels": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "arm_parity": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
        FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id + 3 AS doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""",
    "label_mismatches": "SELECT doc_id, quality AS expected, toxic AS actual FROM labels WHERE quality IS DISTINCT FROM toxic",
    "purity_gate": f"WITH {_GATED_SQL} SELECT * FROM decided",
    "gate_lines": f"""WITH {_GATED_SQL} SELECT unnest([0, 1, 2, 3, 4, 5])::INTEGER AS part, unnest([
        '- Pipeline stability: ' || if(gate_pipeline_stability, 'PASS', 'FAIL'), '- Determinism: ' || if(gate_determinism, 'PASS', 'FAIL'), '- Data quality: ' || if(gate_data_quality, 'PASS', 'FAIL'),
        '- Purity: ' || if(gate_purity, 'PASS', 'FAIL') || printf(' (%.3f %s 0.900)', purity_ratio, if(gate_purity, '>=', '<')), '- Split hygiene: ' || if(gate_split_hygiene, 'PASS', 'FAIL'),
        '- Overall: ' || if(all_pass, 'PASS', 'FAIL')]) AS line FROM decided""",
    "gate_documents": f"""WITH {_GATED_SQL} SELECT 'gates' AS kind, NULL::VARCHAR AS id, NULL::VARCHAR AS family, total_tasks::VARCHAR AS total, purity_ratio::VARCHAR AS purity, all_pass::VARCHAR AS all_pass, NULL::VARCHAR AS reduce_ok, NULL::VARCHAR AS errors FROM decided
        UNION ALL SELECT 'split_error', NULL, (doc_id % 7)::VARCHAR, NULL, NULL, NULL, NULL, NULL FROM labels GROUP BY doc_id % 7 HAVING count(DISTINCT quality) > 1
        UNION ALL SELECT 'task', doc_id::VARCHAR, (doc_id % 7)::VARCHAR, NULL, NULL, NULL, CASE WHEN quality = 1 OR toxic = 0 THEN 'true' ELSE 'false' END, CASE WHEN quality <> 1 THEN 'bad' END FROM labels""",
    "sanitize": f"""SELECT word, CASE WHEN word IN ('Some', 'None', 'Ok', 'Err') THEN word WHEN lower(word) IN ({RESERVED}) THEN 'user_' || word ELSE word END AS name, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY ALL""",
    "round6": "SELECT l_orderkey, count(*) AS n, max(round_even(l_extendedprice * l_discount / 7, 6)) AS top FROM lineitem GROUP BY l_orderkey",
    "task_code": f"WITH {TASKS_SQL} SELECT id, family, number, prompt, code FROM tasks",
    "signatures": f"""WITH {TASKS_SQL} SELECT id, CASE WHEN number % 4 <> 0 THEN id WHEN family = 'helper_call_inc' THEN 'inc_' || lpad(number::VARCHAR, 3, '0') ELSE id END AS name,
        CASE WHEN number % 4 <> 0 THEN signature END AS signature FROM tasks""",
    "expected_values": f"""WITH {TASKS_SQL} SELECT id, CASE family WHEN 'closure_shift_const' THEN '7=' || (number + 9) WHEN 'vec_pop_basic' THEN '=Some(' || (number + 2) || ')'
        WHEN 'result_unwrap_or_const' THEN 'Ok(123)=123, Err(String::from("x"))=' || number END AS expected FROM tasks""",
    "contract_prompts": f"""WITH {TASKS_SQL} SELECT id, prompt || repeat(chr(10), 2) || '{T.CONTRACT_MARKER}' || chr(10) || '`' || signature || '`' || chr(10)
        || 'Do not change the function name, parameters, or return type.' AS prompt FROM tasks""",
    "wordy_signatures": f"WITH {TASKS_SQL} SELECT id, 'function ' || id || ' | takes ' || p_brand || ' | returns integer' AS signature FROM tasks",
    "generation_summary": f"""WITH {TASKS_SQL} SELECT 'part' AS base_source, count(*) AS total_tasks, count(*) FILTER (family LIKE '%_train') AS added_tasks,
        'result_unwrap_or_train, vec_pop_train, option_unwrap_or_train' AS families_added FROM tasks""",
    "task_files": f"""WITH {TASKS_SQL} SELECT 'rust/' || id AS path, code || chr(10) AS value FROM tasks UNION ALL
        SELECT 'prompts/' || id, prompt || repeat(chr(10), 2) || '{T.CONTRACT_MARKER}' || chr(10) || '`' || signature || '`' || chr(10) || 'Do not change the function name, parameters, or return type.' || chr(10) FROM tasks""",
    "seed_reports": f"""WITH {RESULTS_SQL}, k AS (SELECT seed, arm, count(*) AS total, count(*) FILTER (transform_ok) AS transform_pass FROM results GROUP BY ALL),
        f AS (SELECT seed, arm, string_agg(family || '=' || n || '/' || c || '/' || t, ', ' ORDER BY family) AS families FROM
          (SELECT seed, arm, family, count(*) AS n, count(*) FILTER (compile_ok) AS c, count(*) FILTER (test_ok) AS t FROM results GROUP BY ALL) GROUP BY ALL),
        p AS (SELECT seed, arm, string_agg(failure_phase || '=' || n, ', ' ORDER BY failure_phase) AS phases FROM (SELECT seed, arm, failure_phase, count(*) AS n FROM failed GROUP BY ALL) GROUP BY ALL),
        c AS (SELECT seed, arm, string_agg(failure_class || '=' || n, ', ' ORDER BY failure_class) AS classes FROM (SELECT seed, arm, failure_class, count(*) AS n FROM failed GROUP BY ALL) GROUP BY ALL)
        SELECT k.*, families, coalesce(phases, '') AS phases, coalesce(classes, '') AS classes FROM k JOIN f USING (seed, arm) LEFT JOIN p USING (seed, arm) LEFT JOIN c USING (seed, arm)""",
    "run_rows": f"""WITH {RESULTS_SQL}, rates AS (SELECT 'agg/' || id % 3 AS report_path, arm, seed, {RATES} FROM results GROUP BY ALL UNION ALL SELECT 'seed/' || seed, arm, seed, {RATES} FROM results GROUP BY ALL),
        s AS (SELECT report_path, arm, {_STATS} FROM rates GROUP BY ALL)
        SELECT 'run ' || report_path AS run_key, upper(report_path) AS run_label, report_path, (SELECT count(DISTINCT seed)::INTEGER FROM rates r WHERE r.report_path = s.report_path) AS num_reports,
        {_RUN_STATS}, {_DELTAS} FROM s GROUP BY report_path""",
    "summary_lines": f"""WITH {RESULTS_SQL}, k AS (SELECT seed, arm, count(*) AS n, count(*) FILTER (transform_ok) AS tr, count(*) FILTER (compile_ok) AS co, count(*) FILTER (test_ok) AS te FROM results GROUP BY ALL),
        f AS (SELECT seed, arm, family, count(*) AS n, count(*) FILTER (compile_ok) AS co, count(*) FILTER (test_ok) AS te FROM results GROUP BY ALL),
        c AS (SELECT seed, arm, failure_class, count(*) AS n FROM failed GROUP BY ALL), fc AS (SELECT seed, arm, family, failure_class, count(*) AS n FROM failed GROUP BY ALL)
        SELECT seed, arm, 0 AS part, '- total: ' || n AS line FROM k UNION ALL SELECT seed, arm, 1, '- transform pass: ' || tr || '/' || n FROM k
        UNION ALL SELECT seed, arm, 2, printf('- compile@1: %d/%d = %.3f', co, n, co / n::DOUBLE) FROM k UNION ALL SELECT seed, arm, 3, printf('- test@1: %d/%d = %.3f', te, n, te / n::DOUBLE) FROM k
        UNION ALL SELECT seed, arm, 10, '  - ' || family || ': compile ' || co || '/' || n || ', test ' || te || '/' || n FROM f
        UNION ALL (SELECT seed, arm, 20 + row_number() OVER (PARTITION BY seed, arm ORDER BY n DESC, failure_class)::INTEGER AS part, '  - ' || failure_class || ': ' || n FROM c QUALIFY part <= 25)
        UNION ALL SELECT seed, arm, 30, '  - ' || family || ': ' || string_agg(failure_class || '=' || n, ', ' ORDER BY n DESC, failure_class) FROM
          (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY seed, arm, family ORDER BY n DESC, failure_class) <= 3) GROUP BY seed, arm, family""",
    "aggregate_lines": f"""WITH {RESULTS_SQL}, rates AS (SELECT id % 3 AS run, arm, seed, {RATES} FROM results GROUP BY ALL), s AS (SELECT run, arm, {_STATS} FROM rates GROUP BY ALL),
        w AS (SELECT b.run, b.co AS bco, b.cod AS bcod, b.te AS bte, b.ted AS bted, b.tr AS btr, b.trd AS btrd, o.co, o.cod, o.te, o.ted, o.tr, o.trd,
          (SELECT count(DISTINCT seed) FROM rates r WHERE r.run = b.run) AS n FROM s b JOIN s o ON b.run = o.run AND b.arm = 'base' AND o.arm = 'wordy')
        SELECT run, unnest(range(9))::INTEGER AS part, unnest(['Reports aggregated: ' || n, printf('base: compile@1 mean±std: %.3f ± %.3f', bco, bcod), printf('base: test@1 mean±std: %.3f ± %.3f', bte, bted),
          printf('base: transform mean±std: %.3f ± %.3f', btr, btrd), printf('wordy: compile@1 mean±std: %.3f ± %.3f', co, cod), printf('wordy: test@1 mean±std: %.3f ± %.3f', te, ted),
          printf('wordy: transform mean±std: %.3f ± %.3f', tr, trd), printf('compile@1 mean delta: %+.3f', co - bco), printf('test@1 mean delta: %+.3f', te - bte)]) AS line FROM w""",
    "top_classes": f"""WITH {RESULTS_SQL}, c AS (SELECT arm, failure_class, count(*) AS count FROM failed GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY arm ORDER BY count DESC, failure_class)::INTEGER AS rank FROM c QUALIFY rank <= 5""",
    "seed_metrics": _SEED_METRICS_SQL,
    "enough_successes": """SELECT count(*) FILTER (contains(text, 'verbatim item "') OR length(text) > 1000) AS successes, count(*) FILTER (contains(text, 'verbatim item "') OR length(text) > 1000) >= 3 AS enough FROM documents""",
    "restored_names": """SELECT word, CASE WHEN starts_with(word, 'user_') THEN substr(word, 6) ELSE word END AS name, count(*) AS n FROM (SELECT 'user_' || lower(c_mktsegment) AS word FROM customer UNION ALL
        SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) FROM documents) GROUP BY ALL""",
    "export_summary": """WITH x AS (SELECT CASE WHEN doc_id % 7 > 0 THEN lang END AS language, ['train', 'val', 'extra', 'train'][doc_id % 4 + 1] AS split FROM documents)
        SELECT l.language, s.split, (SELECT count(*) FROM x WHERE x.language IS NOT DISTINCT FROM l.language AND x.split = s.split) AS rows FROM (SELECT DISTINCT language FROM x) l CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)""",
    "dereferenced": "SELECT d.doc_id, trim(p.url) AS text FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id * 2",
    "resolved_paths": """SELECT page_id, CASE page_id % 3 WHEN 1 THEN '/data/a/c/d' || page_id WHEN 2 THEN '/d' || page_id
        ELSE '/' || array_to_string(list_filter(string_split(CASE WHEN starts_with(url, '/') THEN url ELSE '/data/x/' || url END, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path FROM pages""",
    "missing_paths": "SELECT doc_id, 'pages/' || doc_id * 3 AS p FROM documents d WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages WHERE page_id = d.doc_id * 3)",
    "policy_errors": """SELECT doc_id, concat_ws('; ', CASE WHEN toxic = 1 THEN 'task declares dependencies' END, CASE WHEN quality = 0 THEN 'task is marked unsafe' END) AS errors,
        CASE WHEN quality = 0 THEN 'task is marked unsafe' ELSE '' END AS with_deps FROM labels""",
    "task_rows": f"""WITH {TASKS_SQL} SELECT id, family, ['train', 'val', 'test'][number % 3 + 1] AS split, 'rust' AS language, 'part' AS source, '<user>' || chr(10) || prompt || repeat(chr(10), 2)
        || '{T.CONTRACT_MARKER}' || chr(10) || '`' || signature || '`' || chr(10) || 'Do not change the function name, parameters, or return type. You may add helper functions only if needed.' || repeat(chr(10), 2)
        || 'Write only valid Rust code for this task. Do not include explanations.' || chr(10) || '<assistant>' || chr(10) || code || chr(10) AS conversations FROM tasks""",
    "dataset_overview": """WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS dataset_version, source AS family, ['train', 'val', 'extra', 'test'][doc_id % 4 + 1] AS split FROM documents),
        c AS (SELECT dataset_version, count(*) AS total_tasks, count(DISTINCT nullif(family, '')) AS family_count, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count,
          count(*) FILTER (split = 'test') AS test_count FROM t GROUP BY ALL),
        g AS (SELECT dataset_version, count(*) FILTER (toxic = 1) = 0 AS all_pass FROM t JOIN labels USING (doc_id) WHERE dataset_version < 'f' GROUP BY ALL),
        a AS (SELECT dataset_version, count(*) AS added_tasks, string_agg(DISTINCT family, ';' ORDER BY family) AS families_added FROM t WHERE split = 'extra' GROUP BY ALL HAVING count(*) % 2 = 0)
        SELECT c.*, coalesce(all_pass::VARCHAR, '') AS all_pass, coalesce(added_tasks::VARCHAR, '') AS added_tasks, coalesce(families_added, '') AS families_added,
          coalesce(nullif(train_count, 0)::VARCHAR, '') AS export_rust_train, coalesce(nullif(val_count, 0)::VARCHAR, '') AS export_rust_val, coalesce(nullif(test_count, 0)::VARCHAR, '') AS export_rust_test
        FROM c LEFT JOIN g USING (dataset_version) LEFT JOIN a USING (dataset_version)""",
    "family_metrics_by_run": f"""WITH {RESULTS_SQL}, rates AS (SELECT 'run' || id % 3 AS run_key, arm, family, seed, {RATES} FROM results GROUP BY ALL)
        SELECT run_key, arm, family, round_even(avg(co), 6) AS compile_mean, round_even(stddev_pop(co), 6) AS compile_std, round_even(avg(te), 6) AS test_mean, round_even(stddev_pop(te), 6) AS test_std FROM rates GROUP BY ALL""",
    "exported_rows": """SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 'rust' ELSE 'wordy' END AS language, ['train', 'val', 'test'][conv_id % 4 + 1] AS split FROM conversations WHERE conv_id % 4 < 3""",
    "written_lines": "SELECT count(*) AS lines, sum(length(url))::BIGINT AS chars, sum(length(url) + 1)::BIGINT AS whole_chars, count(*) = count(url) AS gapless FROM pages WHERE url IS NOT NULL",
    "metrics_csv": _SEED_METRICS_SQL,
    "unique_union": "SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier",
    "task_prompts": f"""WITH {TASKS_SQL} SELECT id, '# Task' || repeat(chr(10), 2) || 'Use brand ' || p_brand || '.' || repeat(chr(10), 2) || '{T.CONTRACT_MARKER}' || chr(10) || '`' || signature || '`' || chr(10)
        || 'Do not change the function name, parameters, or return type. You may add helper functions only if needed.' || repeat(chr(10), 2)
        || 'Write only valid Rust code for this task. Do not include explanations.' AS prompt FROM tasks""",
    "manifest_errors": """WITH e AS (
          SELECT event_id + 1 AS line, (event_id % 5000)::VARCHAR AS rid, CASE event_id % 6 WHEN 1 THEN '''split'' must be one of [''test'', ''train'', ''val'']' WHEN 2 THEN '''prompt_path'' must be a non-empty string'
            WHEN 3 THEN '''deps'' must be a string list' WHEN 4 THEN '''unsafe'' must be boolean' WHEN 5 THEN 'invalid JSON' END AS err FROM events
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY rid, err IS NULL ORDER BY line) AS k FROM e)
        SELECT line, CASE WHEN err IS NULL THEN rid END AS id,
          CASE WHEN err IS NOT NULL THEN 'line ' || line || ': ' || err WHEN k > 1 THEN 'line ' || line || ': duplicate id ''' || rid || '''' ELSE '' END AS errors FROM ranked""",
} | sources.SQL

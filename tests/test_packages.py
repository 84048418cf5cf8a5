"""Sources, sinks, packages, validation, reports and streams."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tabshift.functions.names import POS, data_columns
from tabshift.operators.checks import duplicated_values, null_counts
from tabshift.operators.metrics import Scoring
from tabshift.operators.order import placed_in_order
from tabshift.operators.summary import summarize
from tabshift.plans.build import build_package
from tabshift.plans.evaluate import MetricResult, EvaluationResult, evaluate, failed_run
from tabshift.plans.report import render_markdown, report
from tabshift.plans.validate import (
    check_metadata,
    check_schemas,
    check_structure,
    is_valid,
    validate,
)
from tabshift.sources.bundle import load_package
from tabshift.sources.csv import header_names, read_table, sniff_delimiter, write_table
from tabshift.sources.parquet import read_parquet_table, write_parquet_table
from tabshift.sources.results import (
    read_result_log,
    read_results,
    results_frame,
    write_results,
)
from tabshift.specs import SpecError
from tabshift.streaming.stateless import migrate_stream, noise_stream
from workloads.specs import noise, rule, schema, task


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


# --- CSV --------------------------------------------------------------------


def test_csv_dialect(spark, rows, tmp_path):
    text = 'id;"a ""b""";part no.\n007;"x;y"; lead\n\n008;N/A;""\n009;"NULL";nan\n010;none; NA\n'
    df = read_table(spark, put(tmp_path, "t.csv", text))
    assert data_columns(df) == ["id", 'a "b"', "part no."]
    assert rows(df) == [("007", "x;y", " lead"), ("008", None, None), ("009", None, None), ("010", "none", " NA")]


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_delimiters(delimiter):
    assert sniff_delimiter(f"a{delimiter}b{delimiter}c\n1{delimiter}2{delimiter}3\n") == delimiter


def test_headers():
    assert sniff_delimiter("single\nvalue\n") == ","
    assert header_names("a,b,a,a\n", ",") == ["a", "b", "a.1", "a.2"]
    assert header_names("", ",") == []


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))


def test_multi_line_cells(spark, rows, tmp_path):
    path = put(tmp_path, "m.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows(read_table(spark, path, multi_line=True)) == [("1", "x\ny"), ("2", "z")]


def test_csv_keeps_order_over_files_and_splits(spark, rows, tmp_path):
    """Small files come first in a scan whatever their name; positions follow
    the names and the places in the files."""
    folder = tmp_path / "many"
    put(folder, "a.csv", "n\n" + "".join(f"{i}\n" for i in range(5)))
    put(folder, "b.csv", "n\n" + "".join(f"{i}\n" for i in range(5, 30_000)))
    put(folder, "c.csv", "n\n" + "".join(f"{i}\n" for i in range(30_000, 30_010)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert [int(r[0]) for r in rows(read_table(spark, str(folder)))] == list(range(30_010))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_sink_round_trip(spark, table, rows, tmp_path):
    cells = [["1", 'say "hi"', " a "], ["2", None, "x,y"], ["3", "ü\\", None]]
    df = table(["id", "part no.", "c;d"], cells)
    for _ in range(2):  # overwrites
        write_table(df, str(tmp_path / "out"))
    back = read_table(spark, str(tmp_path / "out"))
    assert data_columns(back) == ["id", "part no.", "c;d"]
    assert rows(back) == [tuple(c) for c in cells]
    part = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="utf-8").splitlines()
    assert part[0] == "id,part no.,c;d"


def test_parquet_round_trip(spark, table, rows, tmp_path):
    df = table(["a.b"], [["x"], [None]])
    write_parquet_table(df, str(tmp_path / "p"))
    assert rows(read_parquet_table(spark, str(tmp_path / "p"))) == [("x",), (None,)]


# --- packages ---------------------------------------------------------------

TASK = """
task_id: T1
objective: migrate suppliers
input: {source_dataset: data/dataset.csv, source_schema: schemas/source.yaml, target_schema: schemas/target.yaml}
business_rules:
  filtering: {field: seen on, operator: ">=", value: 2023-01-01, field_format: DD.MM.YYYY}
  mappings:
    - {source_field: "no", target_field: account, transformation: {type: sequential_number, start: 20, digits: 4}}
    - {source_field: name, target_field: name, transformation: {type: copy}}
    - {source_field: country, target_field: country, transformation: {type: value_mapping, mapping: {deu: de, aut: at}}}
output: {format: csv}
constraints: []
"""
SOURCE_SCHEMA = """
table: SRC
description: source
attributes:
  - {name: "no", type: string, required: true, unique: true}
  - {name: name, type: string, required: true}
  - {name: country, type: string, required: true}
  - {name: seen on, type: date, required: false}
"""
TARGET_SCHEMA = """
table: BP
description: target
attributes:
  - {name: account, type: string, required: true, unique: true}
  - {name: name, type: string, required: true}
  - {name: email, type: string, required: false}
  - {name: country, type: string, required: true}
"""
NOISE = """
seed: 61
excluded_columns: ["no", seen on]
noise_types:
  - {type: typo, probability: 0.3}
  - {type: duplicate, probability: 0.2}
  - {type: missing_value, probability: 0.1}
"""
SYNTHESIS = """
seed: 5
columns:
  - {column: "no", strategy: unique_sequence, format: "{:05d}", start: 100}
  - {column: name, strategy: faker, provider: company}
  - {column: country, strategy: categorical_resample}
  - {column: seen on, strategy: date_distribution, field_format: DD.MM.YYYY}
"""
METADATA = """
scenario_id: S1
task_id: T1
version: 1.0
author: a
created: today
task_complexity: basic
specification_completeness: explicit
data_quality: noisy
seed: 61
"""
SCENARIO = """
scenario_id: S1
name: n
domain: d
description: d
business_objects: [Supplier]
systems: {source: {name: a, description: a}, target: {name: b, description: b}}
"""


def lay_out(root):
    lines = ["no,name,country,seen on"]
    lines += [f"{i},Real Name {i},{'deu' if i % 3 else 'aut'},{i % 28 + 1:02d}.0{i % 9 + 1}.20{20 + i % 5}" for i in range(60)]
    put(root, "source_data/source_data.csv", "\n".join(lines) + "\n")
    for name, text in (
        ("task.yaml", TASK), ("schemas/source.yaml", SOURCE_SCHEMA), ("schemas/target.yaml", TARGET_SCHEMA),
        ("noise_configuration.yaml", NOISE), ("synthesis_configuration.yaml", SYNTHESIS),
        ("metadata.yaml", METADATA), ("scenario.yaml", SCENARIO),
    ):
        put(root, name, text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("package")
    lay_out(root)
    return root, build_package(spark, str(root))


def copy_of(built, tmp_path):
    import shutil

    root = tmp_path / "copy"
    shutil.copytree(built[0], root)
    return root


# without deriving the tables again
LIGHT = [check_schemas, check_structure, check_metadata]


def codes(spark, root, checks=None):
    return sorted(r["code"] for r in validate(spark, str(root), checks).collect())


def test_build_gives_a_valid_package(spark, built, rows):
    root, package = built
    assert package.clean_dataset.count() == 60
    assert package.dataset.count() > 60
    truth = rows(package.ground_truth)
    assert truth[0][0] == "0020" and truth[-1][0] == f"{20 + len(truth) - 1:04d}"
    assert data_columns(package.ground_truth) == ["account", "name", "country"]
    issues = validate(spark, str(root))
    assert issues.count() == 0 and is_valid(issues)


def test_building_again_gives_the_same_tables(spark, built, rows, tmp_path):
    lay_out(tmp_path)
    again = build_package(spark, str(tmp_path))
    for name in ("clean_dataset", "dataset", "ground_truth"):
        assert rows(getattr(again, name)) == rows(getattr(built[1], name))


def test_names_are_not_published(spark, built, rows):
    assert not any("Real Name" in (cell or "") for row in rows(built[1].dataset) for cell in row)


def test_no_synthesis_no_package(spark, tmp_path):
    lay_out(tmp_path)
    (tmp_path / "synthesis_configuration.yaml").unlink()
    with pytest.raises(FileNotFoundError, match="must not be published"):
        build_package(spark, str(tmp_path))


def test_without_noise_the_dataset_is_clean(spark, rows, tmp_path):
    lay_out(tmp_path)
    (tmp_path / "noise_configuration.yaml").unlink()
    package = build_package(spark, str(tmp_path))
    assert rows(package.dataset) == rows(package.clean_dataset)
    assert codes(spark, tmp_path) == ["data_quality_mismatch"]


def test_underspecified_package(spark, built, tmp_path):
    """A target example takes the place of the schemas."""
    root = copy_of(built, tmp_path)
    text = TASK.replace("source_schema: schemas/source.yaml, target_schema: schemas/target.yaml", "target_example: data/example.csv")
    put(root, "task.yaml", text)
    put(root, "data/example.csv", "account,name,country\n0001,X,de\n")
    package = load_package(spark, str(root))
    assert package.target_schema is None and package.target_example.count() == 1
    assert codes(spark, root) == []
    with pytest.raises(SpecError):
        build_package(spark, str(root))


TAMPERED = {
    "missing_file": lambda root: (root / "scenario.yaml").unlink(),
    "invalid_task": lambda root: put(root, "task.yaml", "task_id: T1\n"),
    "package_load_failed": lambda root: put(root, "metadata.yaml", METADATA.replace("basic", "hard")),
    "scenario_id_mismatch": lambda root: put(root, "scenario.yaml", SCENARIO.replace("S1", "S9")),
    "task_id_mismatch": lambda root: put(root, "metadata.yaml", METADATA.replace("T1", "T9")),
    "seed_mismatch": lambda root: put(root, "metadata.yaml", METADATA.replace("seed: 61", "seed: 1")),
    "data_quality_mismatch": lambda root: put(root, "metadata.yaml", METADATA.replace("noisy", "clean")),
    "clean_dataset_schema_mismatch": lambda root: put(root, "schemas/source.yaml", SOURCE_SCHEMA.replace("country", "land")),
    "dataset_not_reproducible": lambda root: put(root, "noise_configuration.yaml", NOISE.replace("0.3", "0.4")),
    "missing_required_column": lambda root: put(root, "schemas/target.yaml", TARGET_SCHEMA + "  - {name: vat, type: string, required: true}\n"),
}


@pytest.mark.parametrize("code", TAMPERED)
def test_tampering_is_reported(spark, built, tmp_path, code):
    root = copy_of(built, tmp_path)
    TAMPERED[code](root)
    if code == "missing_required_column":
        # the expected table cannot be derived with such a schema either
        with pytest.raises(SpecError):
            validate(spark, str(root)).collect()
        return
    checks = None if code == "dataset_not_reproducible" else LIGHT
    assert codes(spark, root, checks) == [code]
    warning = code in ("seed_mismatch", "clean_dataset_schema_mismatch")
    if checks:
        assert is_valid(validate(spark, str(root), checks)) == warning


def test_tampered_truth(spark, built, rows, tmp_path, table):
    truth = rows(built[1].ground_truth)
    names = ["account", "name", "country"]

    def tampered(sub, columns, cells, checks=LIGHT):
        root = copy_of(built, tmp_path / sub)
        write_table(table(columns, cells), str(root / "ground_truth/ground_truth.csv"))
        return set(codes(spark, root, checks))

    emptied = [[n, None, c] for n, _, c in truth]
    assert tampered("a", names, emptied, None) == {"required_value_missing", "ground_truth_not_reproducible"}
    repeated = [[truth[0][0], m, c] for _, m, c in truth]
    assert tampered("b", names, repeated) == {"uniqueness_violation"}
    turned = [[m, n, c] for n, m, c in truth]
    assert tampered("c", ["name", "account", "country"], turned) == {"column_order_mismatch"}
    wider = [[*r, "x"] for r in truth]
    assert tampered("d", [*names, "extra"], wider, None) == {
        "unexpected_column", "column_order_mismatch", "ground_truth_not_reproducible",
    }
    root = copy_of(built, tmp_path / "e")
    put(root, "empty.csv", "account,name,country\n")
    import shutil

    shutil.rmtree(root / "ground_truth/ground_truth.csv")
    shutil.copy(root / "empty.csv", root / "ground_truth/ground_truth.csv")
    assert codes(spark, root, LIGHT) == ["empty_csv"]


def test_every_missing_file_is_listed(spark, built, tmp_path):
    root = copy_of(built, tmp_path)
    text = TASK.replace("source_dataset:", "additional_documents: [docs/a.pdf, docs/b.pdf], source_dataset:")
    put(root, "task.yaml", text)
    (root / "metadata.yaml").unlink()
    (root / "schemas/source.yaml").unlink()
    assert codes(spark, root) == ["missing_file"] * 4


def test_value_checks(table):
    df = table(["a", "b"], [["1", None], ["1", None], ["2", "x"]])
    found = {(r["column"], r["value"], r["n"]) for r in duplicated_values(df, ["a", "b"]).collect()}
    assert found == {("a", "1", 2), ("b", None, 2)}
    assert tuple(null_counts(df).first()) == (0, 2)


def test_scoring_a_package(built):
    p = built[1]
    s = Scoring(p.ground_truth, p.ground_truth, p.task, p.noise, p.clean_dataset, p.dataset)
    result = evaluate(s, "perfect", 1.0)
    assert result.passed
    correction = result.metrics[-1].details
    assert correction["applicable"] == "true" and int(correction["checked"]) > 0


# --- results and reports ----------------------------------------------------


def document(agent, passed=True, error=None, metrics=(), metadata=None, again=None, duration=10.0):
    return {
        "task_id": "T", "agent_name": agent, "passed": passed, "error": error,
        "metrics": [{"name": n, "score": s, "details": {"k": 1}} for n, s in metrics],
        "timestamp": "2026-01-01T00:00:00Z", "duration_seconds": duration,
        "reproducibility": None if again is None else {"name": "reproducibility", "score": again, "details": None},
        "metadata": metadata or {},
    }


@pytest.fixture
def log(tmp_path):
    docs = {
        "a/1": document("zeta", metrics=[("row_accuracy", 1.0), ("schema_accuracy", 0.5)], again=0.5,
                        metadata={"steps": 3, "cost": 0.5, "model": "7", "ok": True}),
        "a/2": document("zeta", passed=False, error="timeout", duration=20.0, metadata={"steps": 6}),
        "b/1": document("alpha", passed=False, metrics=[("row_accuracy", 0.0)]),
    }
    for name, doc in docs.items():
        put(tmp_path, f"{name}/evaluation_result.json", json.dumps(doc, indent=2))
    put(tmp_path, "a/other.json", "{}")
    return tmp_path


def test_summary_of_documents(spark, log):
    summary = summarize(read_results(spark, str(log))).orderBy("first")
    names = summary.select(F.map_keys("average_metric_scores")).first()[0]
    assert names == ["row_accuracy", "schema_accuracy", "reproducibility"]
    zeta, alpha = summary.collect()
    assert (zeta["agent_name"], alpha["agent_name"]) == ("zeta", "alpha")  # as first seen
    assert (zeta["total_tasks"], zeta["passed_tasks"], zeta["failed_tasks"]) == (2, 1, 1)
    assert (zeta["pass_rate"], zeta["success_rate"], zeta["average_duration_seconds"]) == (0.5, 0.5, 15.0)
    assert zeta["average_metric_scores"] == {
        "row_accuracy": 1.0, "schema_accuracy": 0.5, "reproducibility": 0.5,
    }
    assert zeta["average_metadata"] == {"steps": 4.5, "cost": 0.5}
    assert alpha["average_metadata"] == {} and alpha["success_rate"] == 1.0


def test_markdown_and_report_files(spark, log, tmp_path):
    text = report(spark, str(log), str(tmp_path / "report"))
    assert text.startswith("# Evaluation Report\n\nGenerated: ")
    assert "Total results: 3\n" in text
    assert text.index("## zeta") < text.index("## alpha")
    assert "- Tasks: 2 (1 passed, 1 failed) - pass rate: 50.0%, success rate: 50.0%" in text
    assert "- Average duration: 15.0s\n- Average scores:\n  - row_accuracy: 1.000" in text
    assert "- Average metadata:" not in text[text.index("## alpha") :]
    assert spark.read.json(str(tmp_path / "report/report_json")).count() == 2
    assert "# Evaluation Report" in [r[0] for r in spark.read.text(str(tmp_path / "report/report_md")).collect()]


def test_no_results_no_report(spark, tmp_path):
    put(tmp_path, "x.txt", "")
    with pytest.raises(FileNotFoundError):
        report(spark, str(tmp_path))


def test_result_log_round_trip(spark, tmp_path):
    done = EvaluationResult(
        "T", "agent", [MetricResult("row_accuracy", 1.0, {"a": "b"})], True,
        failed_run("T", "x", "e", 1.0).timestamp, 3.0, metadata='{"tokens": 12, "model": "m"}',
    )
    path = str(tmp_path / "log")
    for r in (done, failed_run("T", "agent", "crash", 1.0)):
        write_results(results_frame(spark, [r]), path)
    row = summarize(read_result_log(spark, path)).first()
    assert (row["total_tasks"], row["passed_tasks"], row["success_rate"]) == (2, 1, 0.5)
    assert row["average_metadata"] == {"tokens": 12.0}
    assert render_markdown(summarize(read_result_log(spark, path))).count("## agent") == 1


# --- streams ----------------------------------------------------------------


def test_stream_equals_batch(spark, table, tmp_path):
    source = table(["k", "c", "n"], [[str(i), "DE" if i % 2 else "AT", str(i)] for i in range(40)]).drop(POS)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    rules = task(
        "T",
        {"field": "n", "operator": ">=", "value": 5},
        [rule("k", "k", "copy"), rule("c", "c", "value_mapping", mapping={"DE": "DEU", "AT": "AUT"}), rule(["k", "n"], "kn", "concatenate", separator="-")],
    )
    layout = schema("S", "k", "c", "kn")
    config = noise(3, ["k", "c"], ("typo", 0.5), ("duplicate", 0.5), ("missing_value", 0.2))

    def derive(df):
        return noise_stream(migrate_stream(df, rules, layout), config, ["k"])

    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = (
        derive(stream).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    read = lambda df: sorted(map(str, df.collect()))
    assert read(spark.read.parquet(str(tmp_path / "out"))) == read(derive(source))


def test_streams_cannot_be_numbered(spark, table):
    rules = task("T", None, [rule("k", "n", "sequential_number", start=1)])
    with pytest.raises(SpecError, match="stream"):
        migrate_stream(table(["k"], [["1"]]), rules, schema("S", "n"))


def test_csv_keeps_line_breaks_lone_columns_and_refuses_long_rows(spark, table, rows, tmp_path):
    lines = table(["a", "b"], [["x\ny", '"q"'], [None, "z"], ["", "1"]])
    write_table(lines, f"{tmp_path}/lines")
    assert rows(read_table(spark, f"{tmp_path}/lines")) == [("x\ny", '"q"'), (None, "z"), (None, "1")]
    lone = table(["a"], [["x"], [None], ["y"]])
    write_table(lone, f"{tmp_path}/lone")
    assert rows(read_table(spark, f"{tmp_path}/lone")) == [("x",), (None,), ("y",)]
    (tmp_path / "short.csv").write_text('a,b\n1\n2,"3,4"\n')
    assert rows(read_table(spark, f"{tmp_path}/short.csv")) == [("1", None), ("2", "3,4")]
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    for read in (lambda df: df.count(), lambda df: df.select("a").collect()):
        with pytest.raises(Exception, match="more than 2 fields"):
            read(read_table(spark, f"{tmp_path}/long.csv"))


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tabshift.session import shared_base

    no_folder = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://m:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: no_folder)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_base(session)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [30, 150])
def test_split_files_read_as_whole_ones(spark, rows, tmp_path, end, split):
    """Records over several lines and splits are put together, whatever the cells hold."""
    cells = ["a\nb", '"', "\n", '\n\n"x",', "é;\n ", "\r\n", ",", '""\n""', "plain", " ", 'x"\n"y']
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    lines = [f'"first{end}line",b', "", *(f"{quoted(a)},{quoted(b)}" for a in cells for b in cells), "only one", "", ","]
    for name in ("0.csv", "1.csv"):
        (tmp_path / name).write_bytes((end.join(lines) + end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", str(split))
    try:
        whole, parts = (read_table(spark, str(tmp_path), split=s, delimiter=",") for s in (False, True))
        assert parts.columns == whole.columns
        assert rows(parts) == rows(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_files_are_split(spark, rows, tmp_path):
    """A file of several splits with line breaks in every second row, by many tasks."""
    want = [(str(i), f'line "{i}"\nnext' if i % 2 else f"plain {i}") for i in range(4000)]
    text = "n,t\n" + "".join('%s,"%s"\n' % (n, t.replace('"', '""')) for n, t in want)
    (tmp_path / "large.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "4000")
    try:
        found = read_table(spark, str(tmp_path / "large.csv"))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "large.csv")).rdd.getNumPartitions() > 5
        assert rows(found) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_are_written_in_order_without_a_sort_of_all(spark, table, rows, tmp_path, monkeypatch):
    import tabshift.sources.csv as source

    monkeypatch.setattr(source, "FILE_ROWS", 3)
    shuffled = table(["a"], [[str(i)] for i in range(50)]).withColumn(POS, (F.col(POS) * 70_001) % 65_537 * 65_536)
    write_table(shuffled.repartition(4), str(tmp_path / "t"))
    want = [r["a"] for r in shuffled.orderBy(POS).collect()]
    assert [r[0] for r in rows(read_table(spark, str(tmp_path / "t")))] == want
    plan = placed_in_order(shuffled, 3)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_report_document_is_one_json_document(spark, tmp_path, monkeypatch):
    """Part files put together by name; metadata keys stay in their order everywhere."""
    import tabshift.sources.results as sink

    monkeypatch.setattr(sink, "FILE_ROWS", 2)
    log = spark.createDataFrame(
        [(k, f"agent {k % 2}", "T", [("m", 0.5)], True, None, None, 1.0, '{"z": 1,\n "a": "2", "m": %d}' % k) for k in range(5)],
        f"{POS} bigint, agent_name string, task_id string, metrics array<struct<name: string, score: double>>, passed boolean, "
        "error string, reproducibility struct<name: string, score: double>, duration_seconds double, metadata string",
    )
    made = summarize(log)
    sink.write_report_document(log, made, str(tmp_path), datetime(2024, 1, 2, tzinfo=timezone.utc))
    parts = sorted((tmp_path / "report_document").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert document["generated_at"].startswith("2024-01-02")
    assert [r["metadata"]["m"] for r in document["results"]] == [0, 1, 2, 3, 4]
    assert [list(r["metadata"]) for r in document["results"]] == [["z", "a", "m"]] * 5
    assert [s["agent_name"] for s in document["summaries"]] == ["agent 0", "agent 1"]
    assert list(document["summaries"][0]["average_metadata"]) == ["z", "m"]
    write_results(log, str(tmp_path / "log"))
    text = "".join(p.read_text() for p in (tmp_path / "log").glob("part-*"))
    assert len(text.splitlines()) == 5 and all(list(json.loads(x)["metadata"]) == ["z", "a", "m"] for x in text.splitlines())


def test_value_issues_in_one_pass(table):
    from tabshift.operators.checks import value_issues

    rules = schema("S", "k", "v", required=("k", "v"), unique=("k",))
    found = lambda rows_: sorted((r["code"], r["message"], r["rows"]) for r in value_issues(table(["k", "v"], rows_), rules, "t").collect())
    assert found([["1", "a"], ["2", "b"]]) == []
    assert found([]) == [("empty_csv", "table has no rows", None)]
    assert found([[None, "a"], [None, None], ["1", "x"], ["1", "y"], ["1", None]]) == [
        ("required_value_missing", "required column 'k' has missing values", 2),
        ("required_value_missing", "required column 'v' has missing values", 2),
        ("uniqueness_violation", "unique column 'k' has repeated values", 5),
    ]


def test_only_differing_rows_are_found(table, rows, monkeypatch):
    import tabshift.operators.compare as compare

    monkeypatch.setattr(compare, "BLOCK_BITS", 2)
    left = [[str(k), None if k == 3 else "x"] for k in range(40)]
    right = [list(r) for r in left]
    right[3][1], right[17][0] = "", "other"
    found = compare.positional_diff(table(["a", "b"], left), table(["a", "b"], right + [["new", None]]))
    assert sorted((r["row_index"], r["missing_side"], tuple(r["columns"])) for r in found.collect()) == [(3, None, ("b",)), (17, None, ("a",)), (40, "left", ())]
    assert compare.positional_diff(table(["a"], []), table(["a"], [])).collect() == []
    assert [r["missing_side"] for r in compare.positional_diff(table(["a"], [["1"]]), table(["a"], [])).collect()] == ["right"]


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString().splitlines()


def test_first_entries_are_found_without_a_sort_of_all_entries(spark, tmp_path):
    docs = [
        '{"agent_name": "b", "metrics": [], "passed": true, "duration_seconds": 1.0, "metadata": {"z": 1, "a": 2}}',
        '{"agent_name": "a", "metrics": [], "passed": true, "duration_seconds": 2.0, "metadata": {"a": 4}}',
        '{"agent_name": "b", "metrics": [], "passed": false, "duration_seconds": 3.0, "metadata": {"m": 3, "a": 5}}',
    ]
    for k, doc in enumerate(docs):
        (tmp_path / f"part-{k}").write_text(doc + "\n")
    read = read_result_log(spark, str(tmp_path))
    placed = read.drop("_order").withColumn(POS, F.when(F.col("duration_seconds") > 1, F.col("duration_seconds").cast("bigint") - 9))
    for log in (read, placed):
        summary = summarize(log)
        lines = _plan(summary)
        generate = next(i for i, x in enumerate(lines) if "Generate" in x)
        above = next(x for x in reversed(lines[:generate]) if "Aggregate" in x or "Sort " in x)
        assert "HashAggregate" in above and "ObjectHash" not in above
        got = [(r["agent_name"], r["average_duration_seconds"], r["average_metadata"]) for r in summary.orderBy("first").collect()]
        assert got == [("b", 2.0, {"z": 1.0, "a": 3.5, "m": 3.0}), ("a", 2.0, {"a": 4.0})]
        keys = summary.orderBy("first").select(F.map_keys("average_metadata")).first()[0]
        assert keys == ["z", "a", "m"]
    first = summarize(placed).select("agent_name", "first.order", "first.place").collect()
    assert sorted(map(tuple, first)) == [("a", -7, 0), ("b", None, 0)]

"""Validation of a package: all issues, as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions.names import data_columns
from tabshift.operators.checks import (
    Issue,
    difference_issue,
    issue_frame,
    metadata_issues,
    source_column_issues,
    structure_issues,
    target_column_issues,
    value_issues,
)
from tabshift.operators.compare import differing_rows
from tabshift.operators.order import dense_positions
from tabshift.plans.build import derive_dataset
from tabshift.plans.migrate import migrate
from tabshift.session import cut_lineage
from tabshift.sources.bundle import CLEAN_TABLE, TRUTH_TABLE, Package, load_package, path_exists, read_spec
from tabshift.specs import Task

# package -> issue rows
Check = Callable[[Package], DataFrame]


def _merge(parts: list[DataFrame]) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def check_schemas(package: Package) -> DataFrame:
    """Nothing to check for a task without formal schemas."""
    spark = package.dataset.sparkSession
    issues: list[Issue] = []
    frames = []
    if package.target_schema is not None:
        truth, schema = package.ground_truth, package.target_schema
        issues += target_column_issues(truth, schema, "ground_truth")
        # an empty truth table is reported by the structure check
        frames.append(value_issues(truth, schema, "ground_truth").filter("code <> 'empty_csv'"))
    if package.source_schema is not None:
        issues += source_column_issues(package.clean_dataset, package.source_schema, "clean_dataset")
    return _merge([issue_frame(spark, issues), *frames])


def check_structure(package: Package) -> DataFrame:
    issues: list[Issue] = []
    for name in ("dataset", "clean_dataset", "ground_truth"):
        issues += structure_issues(getattr(package, name), name)
    return issue_frame(package.dataset.sparkSession, issues)


def check_metadata(package: Package) -> DataFrame:
    issues = metadata_issues(package.scenario, package.task, package.metadata, package.noise)
    return issue_frame(package.dataset.sparkSession, issues)


def compare_rederived(expected: DataFrame, stored: DataFrame, code: str, table: str) -> DataFrame:
    """Issue if a stored table is not what the specs give."""
    message = f"{table} is not what the specs derive from the clean table"
    if data_columns(expected) != data_columns(stored):
        spark = stored.sparkSession
        return issue_frame(spark, [("error", code, table, f"{message} (columns differ)", None)])
    return difference_issue(differing_rows(expected, stored), code, table, message)


def check_reproducible(package: Package) -> DataFrame:
    """Derive the dataset and the expected table again (VAL-11, VAL-12)."""
    clean = cut_lineage(dense_positions(package.clean_dataset))
    parts = [
        compare_rederived(
            derive_dataset(clean, package.noise), package.dataset, "dataset_not_reproducible", "dataset"
        )
    ]
    if package.target_schema is not None:
        parts.append(
            compare_rederived(
                migrate(clean, package.task, package.target_schema),
                package.ground_truth,
                "ground_truth_not_reproducible",
                "ground_truth",
            )
        )
    return _merge(parts)


CHECKS: list[Check] = [check_schemas, check_structure, check_metadata, check_reproducible]


def completeness_issues(spark: SparkSession, root: str) -> list[Issue]:
    """Every missing file, not only the first one (VAL-1)."""
    issues: list[Issue] = []

    def need(label: str, relative: str) -> bool:
        if path_exists(spark, f"{root}/{relative}"):
            return True
        issues.append(("error", "missing_file", label, f"{label} is missing: {relative}", None))
        return False

    present = {name: need("required file", name) for name in ("scenario.yaml", "task.yaml", "metadata.yaml")}
    if not present["task.yaml"]:
        return issues
    try:
        task = read_spec(spark, f"{root}/task.yaml", Task)
    except Exception as exc:  # whatever is wrong with the file is an issue
        return [*issues, ("error", "invalid_task", "task.yaml", f"task.yaml is invalid: {exc}", None)]
    for label, relative in (
        ("source_dataset", task.input.source_dataset),
        ("clean dataset", CLEAN_TABLE),
        ("ground truth", TRUTH_TABLE),
        ("source_schema", task.input.source_schema),
        ("target_schema", task.input.target_schema),
        ("target_example", task.input.target_example),
        *[("additional document", d) for d in task.input.additional_documents or []],
    ):
        if relative is not None:
            need(label, relative)
    return issues


def validate_package(package: Package, checks: list[Check] | None = None) -> DataFrame:
    """Issue rows of a loaded package."""
    return _merge([check(package) for check in (CHECKS if checks is None else checks)])


def validate(spark: SparkSession, root: str, checks: list[Check] | None = None) -> DataFrame:
    """Issue rows of the package at `root` (VAL-13). Missing files end the
    validation, since nothing else can be read then."""
    root = root.rstrip("/")
    issues = completeness_issues(spark, root)
    if issues:
        return issue_frame(spark, issues)
    try:
        package = load_package(spark, root)
    except Exception as exc:
        text = f"package cannot be loaded: {exc}"
        return issue_frame(spark, [("error", "package_load_failed", "package", text, None)])
    return validate_package(package, checks)


def is_valid(issues: DataFrame) -> bool:
    """No errors; warnings do not count."""
    return issues.filter(F.col("severity") == "error").isEmpty()

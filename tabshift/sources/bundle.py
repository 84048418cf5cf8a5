"""Packages: a folder with specs and the tables that belong together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tabshift.sources.csv import read_table
from tabshift.specs import (
    Metadata,
    NoiseConfiguration,
    Scenario,
    Schema,
    SynthesisConfiguration,
    Task,
    load_text,
    parse,
)

CLEAN_TABLE = "ground_truth/clean_dataset.csv"
TRUTH_TABLE = "ground_truth/ground_truth.csv"
SOURCE_TABLE = "source_data/source_data.csv"
NOISE_SPEC = "noise_configuration.yaml"
SYNTHESIS_SPEC = "synthesis_configuration.yaml"


def path_exists(spark: SparkSession, path: str) -> bool:
    """On any file system the session can read; resolves the path, no job."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def read_spec(spark: SparkSession, path: str, cls: type):
    """Spec object of a small YAML or JSON file."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as exc:
        raise FileNotFoundError(path) from exc
    return parse(cls, load_text(row[0] if row else ""))


def read_optional_spec(spark: SparkSession, path: str, cls: type):
    return read_spec(spark, path, cls) if path_exists(spark, path) else None


def required_table(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return read_table(spark, path)


@dataclass
class Package:
    root: str
    scenario: Scenario
    task: Task
    metadata: Metadata
    dataset: DataFrame
    clean_dataset: DataFrame
    ground_truth: DataFrame
    source_schema: Schema | None = None
    target_schema: Schema | None = None
    target_example: DataFrame | None = None
    noise: NoiseConfiguration | None = None


def load_package(spark: SparkSession, root: str) -> Package:
    """Specs and lazy tables of a package (SRC-3). Files must exist; columns are
    not compared with the schemas here, that is what validation does."""
    root = root.rstrip("/")
    task = read_spec(spark, f"{root}/task.yaml", Task)
    schemas: dict[str, Schema] = {}
    if task.input.source_schema and task.input.target_schema:
        schemas["source_schema"] = read_spec(spark, f"{root}/{task.input.source_schema}", Schema)
        schemas["target_schema"] = read_spec(spark, f"{root}/{task.input.target_schema}", Schema)
    example = None
    if task.input.target_example:
        example = required_table(spark, f"{root}/{task.input.target_example}")
    return Package(
        root=root,
        scenario=read_spec(spark, f"{root}/scenario.yaml", Scenario),
        task=task,
        metadata=read_spec(spark, f"{root}/metadata.yaml", Metadata),
        dataset=required_table(spark, f"{root}/{task.input.source_dataset}"),
        clean_dataset=required_table(spark, f"{root}/{CLEAN_TABLE}"),
        ground_truth=required_table(spark, f"{root}/{TRUTH_TABLE}"),
        target_example=example,
        noise=read_optional_spec(spark, f"{root}/{NOISE_SPEC}", NoiseConfiguration),
        **schemas,
    )


def synthesis_spec(spark: SparkSession, root: str) -> SynthesisConfiguration:
    """Private data is never published without a synthesis spec (PIP-2)."""
    path = f"{root}/{SYNTHESIS_SPEC}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} is required: source data must not be published as it is")
    return read_spec(spark, path, SynthesisConfiguration)

"""Building a package: source -> clean -> dataset and expected table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabshift.operators.noise import apply_noise
from tabshift.operators.order import dense_positions
from tabshift.operators.synth import synthesize
from tabshift.plans.migrate import migrate
from tabshift.session import cut_lineage
from tabshift.sources.bundle import (
    CLEAN_TABLE,
    NOISE_SPEC,
    SOURCE_TABLE,
    TRUTH_TABLE,
    Package,
    load_package,
    read_optional_spec,
    read_spec,
    required_table,
    synthesis_spec,
)
from tabshift.sources.csv import write_table
from tabshift.specs import NoiseConfiguration, Schema, SpecError, SynthesisConfiguration, Task


@dataclass
class Bundle:
    clean: DataFrame
    dataset: DataFrame
    truth: DataFrame


def derive_dataset(clean: DataFrame, noise: NoiseConfiguration | None) -> DataFrame:
    """What a candidate gets to see: the clean table, damaged if noise is
    configured. Positions of `clean` must be dense to be reproducible."""
    return clean if noise is None else apply_noise(clean, noise)


def derive_bundle(
    source: DataFrame,
    synthesis: SynthesisConfiguration | None,
    noise: NoiseConfiguration | None,
    task: Task,
    target_schema: Schema,
) -> Bundle:
    """The three tables. Ranked source and clean table are written in between: fits,
    labels, sequence numbers, dataset and truth each read them again."""
    if synthesis is None:
        raise SpecError("a synthesis configuration is required to publish source data")
    clean = cut_lineage(synthesize(cut_lineage(dense_positions(source)), synthesis))
    return Bundle(clean, derive_dataset(clean, noise), migrate(clean, task, target_schema))


def build_package(spark: SparkSession, root: str) -> Package:
    """Derive and write the three tables of the package at `root` (PIP-1). The
    clean table is written first and read back for the other two, so that it is
    computed once and a lost executor costs no recomputation of it."""
    root = root.rstrip("/")
    task = read_spec(spark, f"{root}/task.yaml", Task)
    if task.input.target_schema is None:
        raise SpecError("building a package needs a target schema")
    target_schema = read_spec(spark, f"{root}/{task.input.target_schema}", Schema)
    synthesis = synthesis_spec(spark, root)
    noise = read_optional_spec(spark, f"{root}/{NOISE_SPEC}", NoiseConfiguration)

    source = cut_lineage(dense_positions(required_table(spark, f"{root}/{SOURCE_TABLE}")))
    write_table(synthesize(source, synthesis), f"{root}/{CLEAN_TABLE}")
    clean = cut_lineage(dense_positions(required_table(spark, f"{root}/{CLEAN_TABLE}")))
    write_table(derive_dataset(clean, noise), f"{root}/{task.input.source_dataset}")
    write_table(migrate(clean, task, target_schema), f"{root}/{TRUTH_TABLE}")
    return load_package(spark, root)

"""Declarative table migration and scoring on Spark."""

from tabshift.operators.metrics import METRICS, Scoring
from tabshift.operators.noise import NOISE_MODELS, apply_noise
from tabshift.operators.synth import STRATEGIES, synthesize
from tabshift.plans.build import build_package, derive_bundle
from tabshift.plans.evaluate import evaluate, failed_run, score
from tabshift.plans.migrate import migrate, migrate_with_quarantine
from tabshift.plans.report import render_markdown, report
from tabshift.plans.validate import is_valid, validate, validate_package
from tabshift.session import configure
from tabshift.sources.bundle import Package, load_package
from tabshift.sources.csv import read_table, write_table
from tabshift.sources.results import read_results, results_frame, write_results

__all__ = [
    "METRICS", "NOISE_MODELS", "STRATEGIES", "Package", "Scoring", "apply_noise", "build_package",
    "configure", "derive_bundle", "evaluate", "failed_run", "is_valid", "load_package", "migrate",
    "migrate_with_quarantine", "read_results", "read_table", "render_markdown", "report",
    "results_frame", "score", "synthesize", "validate", "validate_package", "write_results",
    "write_table",
]

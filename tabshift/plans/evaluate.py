"""Scoring of candidate tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tabshift.operators.metrics import METRICS, Metric, Scoring, reproduction_score

# one row per scored run; metadata and details stay open
RESULT_SCHEMA = (
    "task_id string, agent_name string, "
    "metrics array<struct<name: string, score: double, details: map<string,string>>>, "
    "passed boolean, timestamp timestamp, error string, "
    "reproducibility struct<name: string, score: double, details: map<string,string>>, "
    "duration_seconds double, metadata string"
)


@dataclass
class MetricResult:
    name: str
    score: float
    details: dict


@dataclass
class EvaluationResult:
    task_id: str
    agent_name: str
    metrics: list[MetricResult]
    passed: bool
    timestamp: datetime
    duration_seconds: float
    error: str | None = None
    reproducibility: MetricResult | None = None
    metadata: str = "{}"

    def row(self) -> tuple:
        as_tuple = lambda m: (m.name, m.score, m.details)
        return (
            self.task_id, self.agent_name, [as_tuple(m) for m in self.metrics], self.passed,
            self.timestamp, self.error,
            as_tuple(self.reproducibility) if self.reproducibility else None,
            self.duration_seconds, self.metadata,
        )


def score(scoring: Scoring, metrics: dict[str, Metric] | None = None) -> list[MetricResult]:
    """All metrics of one candidate. The tables and the best-row match are kept
    for the time of the call; what reaches the driver is one row per metric."""
    metrics = METRICS if metrics is None else metrics
    shared = [scoring.truth, scoring.output]
    for df in shared:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if scoring.comparable:
            shared.append(scoring.matches.persist(StorageLevel.MEMORY_AND_DISK))
        scores: DataFrame | None = None
        for metric in metrics.values():
            one = metric(scoring)
            scores = one if scores is None else scores.unionByName(one)
        rows = [] if scores is None else scores.collect()
    finally:
        for df in shared:
            df.unpersist()
    return [MetricResult(r["name"], r["score"], r["details"]) for r in rows]


def evaluate(
    scoring: Scoring,
    agent_name: str,
    duration_seconds: float,
    reproduced: DataFrame | None = None,
    metadata: str = "{}",
    metrics: dict[str, Metric] | None = None,
) -> EvaluationResult:
    """Scores and pass flag of one run (MET-9). Reproduction does not count
    towards passing."""
    results = score(scoring, metrics)
    again = None
    if reproduced is not None:
        row = reproduction_score(scoring.output, reproduced).first()
        again = MetricResult(row["name"], row["score"], row["details"])
    return EvaluationResult(
        task_id=scoring.task.task_id if scoring.task else "",
        agent_name=agent_name,
        metrics=results,
        passed=all(m.score == 1.0 for m in results),
        timestamp=datetime.now(timezone.utc),
        duration_seconds=duration_seconds,
        reproducibility=again,
        metadata=metadata,
    )


def failed_run(
    task_id: str, agent_name: str, error: str, duration_seconds: float, metadata: str = "{}"
) -> EvaluationResult:
    """A run without an output: an error and no metrics."""
    return EvaluationResult(
        task_id, agent_name, [], False, datetime.now(timezone.utc), duration_seconds, error,
        metadata=metadata,
    )

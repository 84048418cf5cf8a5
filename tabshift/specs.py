"""Declarative specs that drive the operators.

Plain dataclasses filled from dictionaries (YAML or JSON on disk). Unknown keys
are rejected, except in the three open parameter bags (transformation, noise
step, synthesized column), whose extra keys end up in `params`.
"""

from __future__ import annotations

import datetime as dt
import json
import typing
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any


class SpecError(ValueError):
    """A spec does not have the required shape."""


def _unwrap(hint: Any) -> Any:
    """Strip `| None` from a type hint."""
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    if type(None) in typing.get_args(hint) and len(args) == 1:
        return args[0]
    return hint


def _convert(where: str, hint: Any, value: Any) -> Any:
    optional = type(None) in typing.get_args(hint)
    hint = _unwrap(hint)
    if value is None:
        if optional:
            return None
        raise SpecError(f"{where} must not be empty")
    if hint is Any:
        return iso_text(value)
    if is_dataclass(hint):
        return parse(hint, value, where)
    if typing.get_origin(hint) is list:
        if not isinstance(value, (list, tuple)):
            raise SpecError(f"{where} must be a list")
        (item,) = typing.get_args(hint)
        return [_convert(f"{where}[{i}]", item, v) for i, v in enumerate(value)]
    if typing.get_origin(hint) is dict:
        return {k: iso_text(v) for k, v in value.items()}
    if hint is str:
        value = iso_text(value)
    if hint is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if isinstance(hint, type) and (
        not isinstance(value, hint) or (isinstance(value, bool) and hint is not bool)
    ):
        raise SpecError(f"{where} must be {hint.__name__}, got {value!r}")
    return value


def iso_text(value: Any) -> Any:
    """YAML turns unquoted dates into date objects; specs compare texts."""
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def parse(cls: type, data: Any, where: str | None = None) -> Any:
    """Build a spec object from a dictionary."""
    where = where or cls.__name__
    if isinstance(data, cls):
        return data
    if not isinstance(data, dict):
        raise SpecError(f"{where} must be a mapping, got {data!r}")
    if hasattr(cls, "normalize"):
        data = cls.normalize(data)
    hints = typing.get_type_hints(cls)
    known = {f.name: f for f in fields(cls)}
    extra = {k: v for k, v in data.items() if k not in known or k == "params"}
    is_open = "params" in known
    if extra and not is_open:
        raise SpecError(f"{where} has unknown keys {sorted(map(str, extra))}")
    values = {}
    for name, spec in known.items():
        if name == "params":
            values[name] = {k: iso_text(v) for k, v in extra.items()}
        elif name in data:
            values[name] = _convert(f"{where}.{name}", hints[name], data[name])
        elif spec.default is MISSING and spec.default_factory is MISSING:
            raise SpecError(f"{where}.{name} is required")
    return cls(**values)


# --- task -------------------------------------------------------------------


@dataclass
class FilterRule:
    field: str
    operator: str
    value: Any
    field_format: str | None = None


@dataclass
class FilteringRules:
    rules: list[FilterRule]
    description: str | None = None

    @staticmethod
    def normalize(data: dict) -> dict:
        """A single rule may be written in place of the list."""
        if "rules" in data or "field" not in data:
            return data
        rule = {k: v for k, v in data.items() if k != "description"}
        return {"description": data.get("description"), "rules": [rule]}


@dataclass
class Transformation:
    type: str
    params: dict = field(default_factory=dict)


@dataclass
class MappingRule:
    target_field: str
    transformation: Transformation
    source_field: str | None = None
    source_fields: list[str] | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        if (self.source_field is None) == (self.source_fields is None):
            raise SpecError(
                f"mapping to '{self.target_field}' needs exactly one of "
                "source_field and source_fields"
            )

    @property
    def sources(self) -> list[str]:
        return [self.source_field] if self.source_field is not None else list(self.source_fields)


@dataclass
class BusinessRules:
    filtering: FilteringRules | None = None
    mappings: list[MappingRule] | None = None


@dataclass
class TaskInput:
    source_dataset: str
    source_schema: str | None = None
    target_schema: str | None = None
    target_example: str | None = None
    additional_documents: list[str] | None = None

    def __post_init__(self) -> None:
        if (self.source_schema is None) != (self.target_schema is None):
            raise SpecError("source_schema and target_schema go together")
        if (self.target_schema is None) == (self.target_example is None):
            raise SpecError("give either both schemas or a target_example")


@dataclass
class TaskOutput:
    format: str
    schema_reference: str | None = None


@dataclass
class Task:
    task_id: str
    objective: str
    input: TaskInput
    business_rules: BusinessRules
    output: TaskOutput
    constraints: list[str]
    required_operations: list[str] | None = None
    ignored_source_fields: list[str] | None = None


# --- schemas ----------------------------------------------------------------


@dataclass
class Attribute:
    name: str
    type: str
    required: bool
    unique: bool = False
    description: str | None = None
    format: str | None = None
    allowed_values: list[str] | None = None


@dataclass
class SchemaConstraint:
    id: str
    description: str


@dataclass
class Schema:
    table: str
    description: str
    attributes: list[Attribute]
    entity: str | None = None
    constraints: list[SchemaConstraint] | None = None
    used_by: list[str] | None = None

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]


# --- descriptive records ----------------------------------------------------


@dataclass
class SystemInfo:
    name: str
    description: str


@dataclass
class Systems:
    source: SystemInfo
    target: SystemInfo


@dataclass
class Scenario:
    scenario_id: str
    name: str
    domain: str
    description: str
    business_objects: list[str]
    systems: Systems


_LABELS = {
    "task_complexity": ("basic", "realistic"),
    "specification_completeness": ("explicit", "underspecified"),
    "data_quality": ("clean", "noisy"),
}


@dataclass
class Metadata:
    scenario_id: str
    task_id: str
    version: str
    author: str
    created: str
    task_complexity: str
    specification_completeness: str
    data_quality: str
    seed: int | None = None

    @staticmethod
    def normalize(data: dict) -> dict:
        version = data.get("version")
        if isinstance(version, (int, float)) and not isinstance(version, bool):
            data = {**data, "version": str(version)}
        return data

    def __post_init__(self) -> None:
        for axis, allowed in _LABELS.items():
            if getattr(self, axis) not in allowed:
                raise SpecError(f"Metadata.{axis} must be one of {allowed}")


# --- noise and synthesis ----------------------------------------------------


@dataclass
class NoiseStep:
    type: str
    probability: float
    params: dict = field(default_factory=dict)


@dataclass
class NoiseConfiguration:
    seed: int
    noise_types: list[NoiseStep]
    excluded_columns: list[str] = field(default_factory=list)


@dataclass
class SynthesizedColumn:
    column: str
    strategy: str
    params: dict = field(default_factory=dict)


@dataclass
class SynthesisConfiguration:
    seed: int
    columns: list[SynthesizedColumn]
    locale: str = "de_DE"


def load_text(text: str) -> dict:
    """Dictionary of a YAML or JSON document; an empty document is empty."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise SpecError("reading YAML specs needs PyYAML; JSON works without") from exc
    return yaml.safe_load(text) or {}

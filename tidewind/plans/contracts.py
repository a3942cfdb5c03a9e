"""Stage contracts: what went into a stage, what came out, and whether that still holds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from tidewind.operators.quality import fingerprint
from tidewind.plans.store import Store


class StaleOutputError(RuntimeError):
    """Outputs that don't belong to the present configuration, inputs or files."""


@dataclass
class StageContract:
    stage: str
    config_hash: str
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    records: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    generated_at_utc: str = ""


def content_hash(df: DataFrame) -> str:
    return fingerprint(df).first()["fingerprint"]


def json_safe(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else repr(value)


def text(contract: StageContract) -> str:
    contract.generated_at_utc = datetime.now(UTC).isoformat()
    contract.params = json_safe(contract.params)
    return json.dumps(asdict(contract), indent=2, sort_keys=True)


def load(store: Store, name: str) -> StageContract | None:
    found = store.read(name)
    return StageContract(**json.loads(found)) if found is not None else None


def check_inputs(kept: StageContract, config_hash: str, inputs: dict[str, str]) -> None:
    if kept.config_hash != config_hash:
        raise StaleOutputError(f"{kept.stage}: the configuration has changed")
    for name, value in inputs.items():
        if name not in kept.inputs:
            raise StaleOutputError(f"{kept.stage}: input {name} is new")
        if kept.inputs[name] != value:
            raise StaleOutputError(f"{kept.stage}: input {name} has changed")


def check_outputs(store: Store, kept: StageContract) -> None:
    for name, value in kept.outputs.items():
        if not store.exists(name):
            raise StaleOutputError(f"{kept.stage}: output {name} is missing")
        if content_hash(store.spark.read.parquet(store.path(name))) != value:
            raise StaleOutputError(f"{kept.stage}: output {name} was changed")
    for name in kept.records:
        if not store.exists(name):
            raise StaleOutputError(f"{kept.stage}: record {name} is missing")


def check_source(maker: StageContract | None, stage: str, current: dict[str, str]) -> None:
    """A table made by another stage must come from the same source tables as are in use now."""
    if maker is None:
        raise StaleOutputError(f"{stage}: no contract of the stage that made an input")
    for name, value in current.items():
        if maker.inputs.get(name, value) != value:
            raise StaleOutputError(f"{stage}: {maker.stage} was made from another {name}")

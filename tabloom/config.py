"""Settings: call-time overrides first, then the configuration, then the default."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import fixed


@dataclass(frozen=True)
class TrainingSettings:
    """Batch shape and order are used here; the rest is for the external trainer and kept with the run."""

    output_dir: str = "training_output"
    batch_size: int = 2
    gradient_accumulation_steps: int = 4
    num_epochs: int = 1
    learning_rate: float = 2e-4
    optimizer: str = "adamw_8bit"
    weight_decay: float = 0.01
    warmup_steps: int = 5
    lr_scheduler_type: str = "linear"
    seed: int = fixed.SEED
    max_steps: int | None = None
    max_length: int | None = fixed.MAX_LENGTH
    lora_r: int = 8
    lora_alpha: int = 16
    lora_dropout: float = 0.0
    target_modules: tuple[str, ...] = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")


@dataclass(frozen=True)
class EvaluationSettings:
    """How generators and judges are called; ``rounds`` None cuts rounds by size, ``attempts`` calls failed rows again. What a model itself takes, such as its token limit or
    sampling, is given to the plug-in when it is built."""

    cpu_workers: int | None = None
    io_workers: int = 25
    cpu_batch_size: int | None = None
    io_batch_size: int | None = None
    calls_per_second: float | None = None
    rounds: int | None = 1
    attempts: int = 1
    stop: tuple[str, ...] = ()
    system_message: str | None = None

    @property
    def judge_batch(self) -> int:
        """Judge calls handed over together, never more than twenty unless set."""
        return min(self.io_workers, 20) if self.io_batch_size is None else self.io_batch_size


def resolve(settings: type, config: Mapping[str, Any] | None = None, **overrides: Any):
    """Build ``settings``; a key it does not know is an error rather than silently ignored."""
    known = {f.name for f in fields(settings)}
    given = {**(config or {}), **overrides}
    unknown = sorted(set(given) - known)
    if unknown:
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return settings(**given)


def as_text(settings: Any) -> dict[str, str]:
    """Settings as the flat string map kept with a run."""
    return {f.name: str(getattr(settings, f.name)) for f in fields(settings)}


def resolved(overrides: Column, config: Column, defaults: Mapping[str, str]) -> Column:
    """The same precedence over map columns, for a table of runs."""
    entries: list[Column] = []
    for name, default in defaults.items():
        value = F.coalesce(F.try_element_at(overrides, F.lit(name)), F.try_element_at(config, F.lit(name)), F.lit(default))
        entries += [F.lit(name), value]
    return F.create_map(*entries)


def unknown_keys(overrides: Column, defaults: Mapping[str, str]) -> Column:
    """Override names that no setting answers to, sorted."""
    return F.sort_array(F.array_except(F.map_keys(overrides), F.array(*[F.lit(n) for n in defaults])))

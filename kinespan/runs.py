"""Runs of a long study: settings, fingerprints, isolation and resuming."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What a study is run with. `execution` (workers, resuming, folders) does not change results and is not part of the fingerprint."""

    grid: tuple[int, ...] = (3, 5, 8, 10, 12, 15, 20, 25, 30)
    repetitions: int = 200
    seed: int = 20260715
    held_out: int = 3
    ks: tuple[int, ...] = (1, 2, 3, 4, 5)
    starts: int = 5
    execution: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings from a JSON object; unknown keys are refused, absent ones keep their defaults."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON of all settings that bear on results."""
        content = {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "execution"}
        return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def open_run(folder: str, run_id: str, settings: Settings, resume: bool = False) -> Path:
    """The run's folder. An existing one needs `resume`, and the same id and fingerprint."""
    target = Path(folder) / run_id
    note = target / "run.json"
    said = {"run_id": run_id, "fingerprint": settings.fingerprint()}
    if target.exists():
        if not resume:
            raise FileExistsError(f"{target} exists; resume it or choose another id")
        if json.loads(note.read_text(encoding="utf-8")) != said:
            raise ValueError(f"{target} belongs to another run or to other settings")
        return target
    target.mkdir(parents=True)
    note.write_text(json.dumps(said), encoding="utf-8")
    return target


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """The tasks without a row in `done` (`keys`, `fingerprint`) made with the same settings."""
    same = done.where(F.col("fingerprint") == settings.fingerprint()).select(*keys)
    return tasks.join(same, keys, "left_anti")

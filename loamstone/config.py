"""Settings with validation, kept in a properties file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from loamstone.functions.coords import parse_dimension

DEFAULTS = {
    "output-directory": "", "interval-minutes": "60", "checkpoint-interval": "32", "retention-days": "0", "retention-snapshots": "0", "threads": "0",
    "backup-on-stop": "true", "compression-level": "4", "dimensions": "",
}
RESTART_REQUIRED = {"output-directory", "threads"}


def _whole(key: str, raw: str, low: int, high: int | None = None) -> str:
    try:
        n = int(raw)
    except ValueError:
        raise ValueError(f"{key} must be a whole number, got {raw!r}") from None
    if n < low or (high is not None and n > high):
        raise ValueError(f"{key} must be {low} or more" + (f" and {high} or less" if high is not None else "") + f", got {n}")
    return str(n)


def canonical(key: str, value: str | None) -> str:
    """The form in which a value is kept; ValueError for unknown keys and bad values."""
    raw = (value or "").strip()
    if key not in DEFAULTS:
        raise ValueError(f"unknown setting: {key}")
    if key in ("interval-minutes", "checkpoint-interval"):
        return _whole(key, raw, 1)
    if key in ("retention-days", "retention-snapshots", "threads"):
        return _whole(key, raw, 0)
    if key == "compression-level":
        return _whole(key, raw, 1, 22)
    if key == "backup-on-stop":
        if raw.lower() not in ("true", "false"):
            raise ValueError(f"{key} must be true or false, got {raw!r}")
        return raw.lower()
    if key == "dimensions":
        return ",".join(dict.fromkeys(parse_dimension(x) for x in raw.split(",") if x.strip()))
    return raw


@dataclass
class Config:
    """set() and reset() change a value only if the file can be written."""

    path: Path
    values: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS))

    @classmethod
    def load(cls, path: str | Path) -> Config:
        out = cls(Path(path))
        out.reload()
        return out

    def reload(self) -> None:
        found = dict(DEFAULTS)
        if self.path.is_file():
            for line in self.path.read_text().splitlines():
                key, eq, value = line.partition("=")
                if eq and not line.lstrip().startswith("#") and key.strip() in DEFAULTS:
                    try:
                        found[key.strip()] = canonical(key.strip(), value)
                    except ValueError:
                        pass  # a bad value in the file leaves the default
        self.values = found

    def set(self, key: str, value: str) -> str:
        new = canonical(key, value)
        draft = self.path.with_name(self.path.name + ".tmp")
        draft.write_text("".join(f"{k}={v}\n" for k, v in {**self.values, key: new}.items()))
        os.replace(draft, self.path)
        self.values[key] = new
        return new

    def reset(self, key: str) -> str:
        if key not in DEFAULTS:
            raise ValueError(f"unknown setting: {key}")
        return self.set(key, DEFAULTS[key])

    def show(self) -> dict[str, str]:
        spelled = {"output-directory": "(default)", "dimensions": "(all)"}
        return {k: v or spelled.get(k, v) for k, v in self.values.items()}

    def number(self, key: str) -> int:
        return int(self.values[key])

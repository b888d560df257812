"""Settings of a catalogue, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    roots: list[str] = field(default_factory=list)
    quarantine_dir: str = ""
    scan_threads: int = 16
    similar_threshold: int = 8
    gray_threshold: float = 8.0
    thumb_edge: int = 256
    cache_mb: int = 1024

    RANGES = {"scan_threads": (1, 64), "similar_threshold": (0, 16), "gray_threshold": (0, 100), "thumb_edge": (32, 2048), "cache_mb": (16, None)}  # noqa: RUF012

    def problems(self) -> list[str]:
        """The settings outside their range."""
        bad = []
        for name, (low, high) in self.RANGES.items():
            v = getattr(self, name)
            if v < low or (high is not None and v > high):
                bad.append(name)
        return bad


def load(path: str) -> Settings:
    """Settings of a file; missing entries, or a file that can't be read, leave the defaults."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        return Settings(**{f.name: data[f.name] for f in fields(Settings) if f.name in data})
    except (OSError, ValueError, TypeError):
        return Settings()


def save(settings: Settings, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(settings), ensure_ascii=False, indent=1), encoding="utf-8")

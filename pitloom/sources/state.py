"""Small JSON documents: what has been ingested, and manifests of artefacts."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path


def write_json(path: str | Path, payload: dict) -> None:
    """Through a file beside it, which then takes its name."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}")
    beside.write_text(json.dumps(payload, indent=2, sort_keys=True, default=str, ensure_ascii=False))
    beside.replace(path)


def read_json(path: str | Path) -> dict:
    path = Path(path)
    return json.loads(path.read_text()) if path.exists() else {}


class IngestionState:
    """Table -> what its last successful run left."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def load(self) -> dict:
        return read_json(self.path)

    def get(self, table: str) -> dict:
        return self.load().get(table, {})

    def mark_success(self, table: str, **payload) -> None:
        """Replaces what the table had."""
        write_json(self.path, {**self.load(), table: {**payload, "updated_at": datetime.now(UTC).isoformat()}})

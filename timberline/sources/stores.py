"""Small stores on the driver: read offsets, file checkpoints, and cached time indexes."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame


def _replace(path: Path, data: object) -> None:
    """Writes JSON beside the file and renames it over it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(data, f)
    os.replace(name, path)


class NoOffset(KeyError):
    """No offset is stored under that key."""


class OffsetStore:
    """key -> (offset, file_size) in one JSON file; a missing file is empty, a corrupt one raises ValueError."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self._lock = threading.Lock()
        self._data: dict[str, dict] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, key: str) -> tuple[int, int]:
        with self._lock:
            if key not in self._data:
                raise NoOffset(key)
            return self._data[key]["offset"], self._data[key]["file_size"]

    def put(self, key: str, offset: int, file_size: int) -> None:
        with self._lock:
            self._data[key] = {"offset": offset, "file_size": file_size}
            _replace(self.path, self._data)

    def delete(self, key: str) -> None:
        with self._lock:
            self._data.pop(key, None)
            _replace(self.path, self._data)


@dataclass
class Checkpoint:
    file_path: str
    offset: int
    mod_time: str = ""
    saved_at: str = ""


class CheckpointStore:
    """One JSON file a log file, named by a digest of its full path, so that equal base names don't collide."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _at(self, file_path: str) -> Path:
        full = os.path.abspath(file_path)
        return self.folder / f"{os.path.basename(full)}.{hashlib.sha256(full.encode()).hexdigest()[:16]}.json"

    def save(self, entry: Checkpoint) -> None:
        if entry is None:
            raise ValueError("no checkpoint")
        entry.saved_at = datetime.now(timezone.utc).isoformat()
        _replace(self._at(entry.file_path), asdict(entry))

    def load(self, file_path: str) -> Checkpoint | None:
        at = self._at(file_path)
        return Checkpoint(**json.loads(at.read_text())) if at.exists() else None

    def delete(self, file_path: str) -> None:
        self._at(file_path).unlink(missing_ok=True)


@dataclass
class _Entry:
    size: int
    mtime: float
    built_at: float
    payload: DataFrame


class IndexCache:
    """Persisted index DataFrames by path; an entry counts while it is young and the file's size and time are the same."""

    def __init__(self, ttl_seconds: float, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl_seconds, clock
        self._data: dict[str, _Entry] = {}
        self._lock = threading.Lock()

    def put(self, key: str, size: int, mtime: float, payload: DataFrame) -> None:
        with self._lock:
            was, self._data[key] = self._data.get(key), _Entry(size, mtime, self.clock(), payload)
        if was is not None and was.payload is not payload:
            was.payload.unpersist()

    def get(self, key: str, size: int, mtime: float) -> DataFrame | None:
        with self._lock:
            e = self._data.get(key)
            return e.payload if e and self.clock() - e.built_at <= self.ttl and (e.size, e.mtime) == (size, mtime) else None

    def invalidate(self, key: str) -> None:
        with self._lock:
            e = self._data.pop(key, None)
        if e is not None and hasattr(e.payload, "unpersist"):
            e.payload.unpersist()

    def __len__(self) -> int:
        return len(self._data)


class Warmer:
    """Gives a file's index from the cache, or builds, persists and stores it; a failed build leaves the cache as it was."""

    def __init__(self, cache: IndexCache, build: Callable[[str], DataFrame]):
        self.cache, self.build = cache, build

    def warm(self, path: str) -> DataFrame:
        s = os.stat(path)
        found = self.cache.get(path, s.st_size, s.st_mtime)
        if found is None:
            found = self.build(path).persist()
            found.count()
            self.cache.put(path, s.st_size, s.st_mtime, found)
        return found

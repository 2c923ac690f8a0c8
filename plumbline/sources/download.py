"""Fetching raw files, whole or not at all."""

from __future__ import annotations

import shutil
import urllib.request
from pathlib import Path

from ..errors import DataError


def fetch(url: str, path: str | Path, size: int | None = None, timeout: float = 60) -> Path:
    """The file at a URL. One that is there in the right size is used again; a new one is written beside, checked and renamed."""
    path = Path(path)
    if path.exists() and (size is None or path.stat().st_size == size):
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as target:
            announced = source.headers.get("Content-Length")
            shutil.copyfileobj(source, target, 1 << 20)
        for wanted in (size, int(announced) if announced else None):
            if wanted is not None and part.stat().st_size != wanted:
                raise DataError(f"{url}: {part.stat().st_size} bytes instead of {wanted}")
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)
    return path


def fetch_all(files: dict[str, tuple[str, int | None]], folder: str | Path) -> dict[str, Path]:
    """By name of a file its URL and size; the paths."""
    return {name: fetch(url, Path(folder) / name, size) for name, (url, size) in files.items()}

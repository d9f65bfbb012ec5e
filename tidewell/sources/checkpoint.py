"""The fetcher's checkpoint file: a height and a hash, a line each."""

from __future__ import annotations

import os


def parse(text: str | None) -> tuple[int, str] | None:
    """(height, hash); None if the text is missing, blank or lacks the hash; ValueError for a bad height."""
    lines = [x.strip() for x in (text or "").strip().splitlines()]
    if not lines or not lines[0]:
        return None
    height = int(lines[0])
    return (height, lines[1]) if len(lines) > 1 and lines[1] else None


def load(path: str) -> tuple[int, str] | None:
    try:
        with open(path) as f:
            return parse(f.read())
    except FileNotFoundError:
        return None


def save(path: str, height: int, text: str) -> None:
    """Written beside the file and renamed, so a reader sees the old or the new checkpoint."""
    with open(f"{path}.tmp", "w") as f:
        f.write(f"{height}\n{text}\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)

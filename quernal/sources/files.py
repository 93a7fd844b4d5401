"""File-system helpers of the driver."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path


def file_exists(path: str) -> bool:
    return Path(path).exists()


def regular_file_exists(path: str) -> bool:
    return Path(path).is_file()


def dir_exists(path: str) -> bool:
    return Path(path).is_dir()


def dir_empty(path: str) -> bool:
    return not any(Path(path).iterdir())


def remove_dir(path: str) -> None:
    shutil.rmtree(path)


def make_dirs(path: str, mode: int = 0o700) -> None:
    """With all parents; an existing folder is no error."""
    Path(path).mkdir(mode=mode, parents=True, exist_ok=True)


def temp_file(prefix: str = "") -> str:
    return tempfile.mkstemp(prefix=prefix)[1]


def temp_dir(prefix: str = "") -> str:
    return tempfile.mkdtemp(prefix=prefix)

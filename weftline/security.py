"""Paths and file names from outside."""

from __future__ import annotations

import os
import re
from pathlib import Path


def safe_path(path: str, base: str | None = None) -> str:
    """The normal form of a path; with ``base`` a ValueError if it leads outside of it."""
    if "\0" in path:
        raise ValueError("path holds a null character")
    full = os.path.realpath(path if base is None else os.path.join(base, path))
    if base is not None and not Path(full).is_relative_to(os.path.realpath(base)):
        raise ValueError(f"path {path} leads outside of {base}")
    return full


def safe_name(name: str, default: str = "file") -> str:
    """A plain file name: no folders, no leading dots, odd characters as _."""
    base = re.sub(r"[^\w.\- ]+", "_", os.path.basename(name.replace("\\", "/"))).strip(" .")
    return base[:200] or default


def resolve(path: str, workspace: str) -> str:
    """Where an input lies: an absolute path, else below inputs/, the workspace, or data/inputs/."""
    if os.path.isabs(path) or "://" in path:
        return path
    for place in ("inputs", "", "data/inputs"):
        full = os.path.join(workspace, place, path)
        if os.path.exists(full):
            return full
    return os.path.join(workspace, "inputs", path)

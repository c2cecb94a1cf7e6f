"""Configuration files and paths relative to a workspace (S16). Driver only."""

from __future__ import annotations

import json
from pathlib import Path


def read_config(path: str | Path) -> dict:
    """A mapping from a JSON file, or from a YAML one where a YAML reader is installed; anything else raises."""
    text, suffix = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if suffix == ".json":
        found = json.loads(text)
    elif suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: no YAML reader is installed; JSON is read without one") from e
        found = yaml.safe_load(text)
    else:
        raise ValueError(f"unsupported configuration type: {path}")
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def workspace_path(root: str | Path, path: str) -> str:
    """`path` itself if it is absolute or has a scheme, else under the root."""
    return path if "://" in path or path.startswith("/") else f"{str(root).rstrip('/')}/{path}"

"""Registered projects and the directory a command works on."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

STORE_NAME = ".graphloom"


def config_path() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return Path(base) / "graphloom" / "config.toml"


def load(path: Path | None = None) -> dict[str, str]:
    """Project names and their directories."""
    try:
        held = tomllib.loads((path or config_path()).read_text("utf-8"))
    except FileNotFoundError:
        return {}
    return {name: entry["path"] for name, entry in held.get("projects", {}).items()}


def save(projects: dict[str, str], path: Path | None = None) -> None:
    path = path or config_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "".join(f"[projects.{json.dumps(n)}]\npath = {json.dumps(p)}\n\n" for n, p in sorted(projects.items()))
    path.write_text(text, "utf-8")


def add(name: str, folder: str | Path, path: Path | None = None) -> None:
    save(load(path) | {name: str(Path(folder).resolve(strict=True))}, path)


def remove(name: str, path: Path | None = None) -> bool:
    projects = load(path)
    if name not in projects:
        return False
    del projects[name]
    save(projects, path)
    return True


def registered_for(folder: str | Path, path: Path | None = None) -> str | None:
    """The project whose directory is the longest textual prefix of folder."""
    text = str(Path(folder).resolve(strict=True))
    fits = [(len(p), n) for n, p in sorted(load(path).items()) if text.startswith(p)]
    return max(fits, key=lambda f: f[0])[1] if fits else None


def resolve_dir(explicit: str | None = None, cwd: str | Path | None = None, path: Path | None = None) -> Path:
    """Explicit; else registered (unless outside the git root); else the nearest
    ancestor with a store or .git; else the current directory."""
    if explicit is not None:
        return Path(explicit).resolve(strict=True)
    cwd = Path(cwd or os.getcwd()).resolve()
    above = [cwd, *cwd.parents]
    git = next((p for p in above if (p / ".git").exists()), None)
    name = registered_for(cwd, path)
    if name is not None:
        folder = Path(load(path)[name]).resolve(strict=True)
        if git is None or folder == git or git in folder.parents:
            return folder
    return next((p for p in above if (p / STORE_NAME).exists() or (p / ".git").exists()), cwd)

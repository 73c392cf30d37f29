"""Settings from an env file and the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from siltstone.operators.chunks import DEFAULT_BYTES
from siltstone.sources.extract import MAX_BYTES

# Folders and suffixes that are left out by default.
EXCLUDED_DIRECTORIES = (".git", ".hg", ".svn", ".omx", "__pycache__", ".venv", "build", "dist", "download", "downloads", "env", "node_modules", "site-packages", "third-party", "third_party", "vendor", "venv")
EXCLUDED_GLOBS = ("*.git",)
EXCLUDED_SUFFIXES = (".csv",)


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    root: str
    home: str
    max_file_bytes: int = MAX_BYTES
    excluded_directories: tuple[str, ...] = EXCLUDED_DIRECTORIES
    excluded_globs: tuple[str, ...] = EXCLUDED_GLOBS
    excluded_suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES
    chunk_bytes: int = DEFAULT_BYTES

    @classmethod
    def load(cls, env_file: str | None = None, environ: dict[str, str] | None = None) -> Settings:
        """Values of the env file, those of the environment before them. Lists add to the defaults; relative paths are relative to the env file's folder.

        The root must be a folder and the home another one: a catalog of a root that isn't there would lose all its entries.
        """
        values, base = {}, Path.cwd()
        if env_file:
            path = Path(env_file)
            if not path.is_file():
                raise SettingsError(f"no such env file, so SILTSTONE_ROOT is not set: {path}")
            values, base = parsed(path.read_text(encoding="utf-8-sig")), path.resolve().parent
        values |= {k: v for k, v in (os.environ if environ is None else environ).items() if k.startswith("SILTSTONE_")}
        get = lambda k: values.get(f"SILTSTONE_{k}", "").strip()
        if not get("ROOT"):
            raise SettingsError("SILTSTONE_ROOT is not set")
        root, home = resolved(get("ROOT"), base), resolved(get("HOME") or ".siltstone", base)
        if not root.is_dir():
            raise SettingsError(f"SILTSTONE_ROOT is {'no folder' if root.exists() else 'not there'}: {root}")
        if home == root:
            raise SettingsError("SILTSTONE_HOME must be another folder than SILTSTONE_ROOT")
        return cls(
            root=str(root),
            home=str(home),
            max_file_bytes=positive("SILTSTONE_MAX_FILE_BYTES", get("MAX_FILE_BYTES"), MAX_BYTES),
            excluded_directories=merged(EXCLUDED_DIRECTORIES, listed(get("EXCLUDED_DIRECTORIES"))),
            excluded_globs=merged(EXCLUDED_GLOBS, listed(get("EXCLUDED_GLOBS"))),
            excluded_suffixes=merged(EXCLUDED_SUFFIXES, ["." + s.lstrip("*.").lower() for s in listed(get("EXCLUDED_EXTENSIONS"))]),
            chunk_bytes=positive("SILTSTONE_CHUNK_BYTES", get("CHUNK_BYTES"), DEFAULT_BYTES),
        )


def parsed(text: str) -> dict[str, str]:
    """Values of lines like NAME=value, `export` and quotes taken off; empty lines and comments say nothing, other lines are refused."""
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"\s*(?:export\s+)?([^=]*?)\s*=\s*(.*?)\s*$", line)
        if not m:
            raise SettingsError(f"line {number} of the env file is not NAME=value")
        value = m[2]
        out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def resolved(value: str, base: Path) -> Path:
    path = Path(os.path.expandvars(value)).expanduser()
    return (path if path.is_absolute() else base / path).resolve()


def listed(value: str) -> list[str]:
    return [v.strip() for v in re.split(r"[,;\n]", value) if v.strip()]


def merged(defaults, more) -> tuple[str, ...]:
    return tuple({v.casefold(): v for v in reversed([*defaults, *more])}.values())[::-1]


def positive(name: str, value: str, default: int) -> int:
    if not value:
        return default
    if not re.fullmatch(r"\d+", value) or not int(value):
        raise SettingsError(f"{name} must be a whole number above 0")
    return int(value)

"""Credentials on the driver: the environment before the file, blank means unset; a token is never shown."""

from __future__ import annotations

import os
import tempfile
import tomllib
from pathlib import Path

ENVIRONMENT = "FOLIOSPARK_TOKEN"


def config_path() -> Path:
    return Path(os.environ.get("FOLIOSPARK_CONFIG") or Path.home() / ".config" / "foliospark" / "config.toml")


def load(path: Path | None = None) -> dict:
    path = path or config_path()
    return tomllib.loads(path.read_text("utf-8")) if path.is_file() else {}


def load_env_file(path: Path) -> dict[str, str]:
    """Puts NAME=value lines into the environment where they aren't set yet."""
    found = {}
    for line in path.read_text("utf-8").splitlines() if path.is_file() else ():
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            found[name.strip()] = os.environ.setdefault(name.strip(), value.strip().strip("\"'"))
    return found


def token(path: Path | None = None) -> tuple[str | None, str | None]:
    """The token and where it is from."""
    for value, source in ((os.environ.get(ENVIRONMENT), "environment"), (load(path).get("token"), "config")):
        if value and value.strip():
            return value.strip(), source
    return None, None


def _quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def save_token(value: str, path: Path | None = None) -> Path:
    value, path = value.strip(), path or config_path()
    if not value:
        raise ValueError("the token is empty")
    path.parent.mkdir(parents=True, exist_ok=True)
    rest = "".join(f"{k} = {_quoted(str(v))}\n" for k, v in load(path).items() if k != "token")
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        f.write(f"token = {_quoted(value)}\n{rest}")
    os.chmod(f.name, 0o600)
    os.replace(f.name, path)
    return path


def clear_token(path: Path | None = None) -> bool:
    path = path or config_path()
    if path.is_file():
        path.unlink()
        return True
    return False


def status(path: Path | None = None) -> dict:
    """Whether the file and the environment hold a token, and which of them counts."""
    in_file, in_environment = bool(str(load(path).get("token") or "").strip()), bool(os.environ.get(ENVIRONMENT, "").strip())
    return {"config_path": str(path or config_path()), "config_set": in_file, "environment_set": in_environment, "effective_source": token(path)[1], "environment": ENVIRONMENT}

"""Settings: environment over a ``.env`` file over defaults, read once."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path

#: What a setting may be, where only some values are known.
CHOICES = {
    "environment": ("development", "staging", "production"),
    "log_level": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"),
    "storage_backend": ("local",),
    "embedding_backend": ("deterministic", "remote"),
    "reranker_backend": ("deterministic", "cross_encoder"),
    "chat_backend": ("echo", "remote"),
}


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    log_level: str = "INFO"
    #: Root folder of the tables.
    warehouse: str = "warehouse"
    #: Sent with each request to the filing archive, which refuses anonymous ones.
    archive_user_agent: str = ""
    storage_backend: str = "local"
    storage_path: str = "blobs"
    embedding_backend: str = "deterministic"
    embedding_dim: int = 384
    embedding_url: str = ""
    embedding_key: str = ""
    reranker_backend: str = "deterministic"
    chat_backend: str = "echo"
    chat_model: str = "echo"
    chat_url: str = ""
    chat_key: str = ""

    def __post_init__(self):
        for name, known in CHOICES.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {getattr(self, name)!r}")
        if self.embedding_dim <= 0:
            raise ValueError("embedding_dim must be positive")


def _file(path: Path) -> dict[str, str]:
    out = {}
    for line in path.read_text().splitlines() if path.is_file() else ():
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#"):
            out[name.strip().lower()] = value.strip().strip("'\"")
    return out


def load(env: dict[str, str] | None = None, dotenv: str = ".env") -> Settings:
    """The settings of an environment; names count in any case, unknown ones are ignored."""
    found = _file(Path(dotenv)) | {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    made = {}
    for f in fields(Settings):
        if f.name in found:
            made[f.name] = int(found[f.name]) if f.type == "int" else found[f.name]
    return Settings(**made)


@lru_cache(maxsize=1)
def settings() -> Settings:
    return load()

"""Settings as immutable values: defaults, deep merge with overrides, typed assignment, TOML round trip."""

import tomllib
from dataclasses import dataclass, replace
from pathlib import Path

#: Path parts that keep a file out of the index (substring test on the whole path).
EXCLUDED = (".git", "node_modules", "__pycache__", "venv", "env", ".env", "build", "dist")
INDEX_FOLDER = ".quillon"


@dataclass(frozen=True)
class Config:
    embedding_model: str = "jina"
    max_results: int = 5
    similarity_threshold: float = 0.3
    excluded: tuple[str, ...] = (*EXCLUDED, INDEX_FOLDER)


def to_dict(config: Config) -> dict:
    return {
        "models": {"EMBEDDING_MODEL": config.embedding_model},
        "search": {"MAX_RESULTS": config.max_results, "SIMILARITY_THRESHOLD": config.similarity_threshold},
        "indexing": {"EXCLUDED_DIRS": list(config.excluded)},
    }


def merged(defaults: dict, overrides: dict) -> dict:
    """overrides over defaults, section by section; keys that defaults don't have are dropped."""
    both = {k: overrides.get(k, v) for k, v in defaults.items()}
    return {k: merged(defaults[k], v) if isinstance(defaults[k], dict) and isinstance(v, dict) else v for k, v in both.items()}


def from_dict(values: dict) -> Config:
    v = merged(to_dict(Config()), values)
    return Config(v["models"]["EMBEDDING_MODEL"], v["search"]["MAX_RESULTS"], v["search"]["SIMILARITY_THRESHOLD"], tuple(v["indexing"]["EXCLUDED_DIRS"]))


def parsed(value: str, like):
    """A setting's text as the type its default has."""
    if isinstance(like, bool):
        low = value.lower()
        if low not in ("true", "false", "yes", "no", "1", "0"):
            raise ValueError(f"not a boolean: {value}")
        return low in ("true", "yes", "1")
    if isinstance(like, (int, float)):
        return type(like)(value)
    if isinstance(like, (list, tuple)):
        return [x.strip() for x in value.split(",") if x.strip()]
    return value


def assigned(config: Config, key: str, value: str) -> Config:
    """config with ``section.KEY`` or ``KEY`` set; KeyError for a key that defaults don't have."""
    values = to_dict(config)
    section, _, name = key.rpartition(".")
    for s in [section] if section else values:
        if name.upper() in values.get(s, {}):
            values[s][name.upper()] = parsed(value, values[s][name.upper()])
            return from_dict(values)
    raise KeyError(key)


def ignoring(config: Config, *patterns: str) -> Config:
    return replace(config, excluded=(*config.excluded, *(p for p in dict.fromkeys(patterns) if p not in config.excluded)))


def not_ignoring(config: Config, pattern: str) -> Config:
    return replace(config, excluded=tuple(p for p in config.excluded if p != pattern))


def load(path: str | Path) -> Config:
    p = Path(path)
    return from_dict(tomllib.loads(p.read_text())) if p.exists() else Config()


def save(config: Config, path: str | Path) -> None:
    def literal(v):
        return "[" + ", ".join(map(literal, v)) + "]" if isinstance(v, list) else str(v) if not isinstance(v, str) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'

    text = "\n".join(f"[{s}]\n" + "".join(f"{k} = {literal(v)}\n" for k, v in keys.items()) for s, keys in to_dict(config).items())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)

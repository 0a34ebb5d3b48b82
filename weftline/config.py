"""Settings: frozen dataclasses, a YAML file, and overrides WEFTLINE__SECTION__FIELD from the environment."""

from __future__ import annotations

import dataclasses
import functools
import os
from pathlib import Path

PREFIX = "WEFTLINE__"


@dataclasses.dataclass(frozen=True)
class Paths:
    subtitles_dir: str = "data/raw/subtitles"
    transcript_csv: str = "data/raw/transcript.csv"
    articles_jsonl: str = "data/raw/articles.jsonl"
    articles_fallback_jsonl: str = "data/reference/articles.jsonl"
    processed_dir: str = "data/processed"
    outputs_dir: str = "outputs"


@dataclasses.dataclass(frozen=True)
class Subtitles:
    song_min_episodes: int = 5
    song_window_seconds: float = 150.0


@dataclasses.dataclass(frozen=True)
class Themes:
    hypothesis_template: str = "This dialogue is about {}."
    labels: tuple[str, ...] = ("friendship", "hope", "sacrifice", "battle", "self development", "betrayal", "love", "loneliness", "revenge", "family")
    model_name: str = "lexical"
    chunk_max_tokens: int = 320
    batch_size: int = 32
    batches: int = 8


@dataclasses.dataclass(frozen=True)
class Characters:
    model_name: str = "names"
    window_lines: int = 10
    decay_tau: float = 4.0
    min_mentions: int = 8
    top_edges: int = 250


@dataclasses.dataclass(frozen=True)
class Articles:
    labels: tuple[str, ...] = ("Genjutsu", "Ninjutsu", "Taijutsu")
    model_name: str = "tfidf_logreg"
    seed: int = 42
    folds: int = 5
    wiki: str = ""
    category: str = ""


@dataclasses.dataclass(frozen=True)
class Persona:
    base_model: str = ""
    embedding_model: str = "hashed_grams"
    retrieved_examples: int = 4
    scenes: int = 3
    name_boost: float = 0.08
    history_turns: int = 6
    demo_turns: int = 2
    adapter_dir: str = "outputs/persona/adapters"


@dataclasses.dataclass(frozen=True)
class Settings:
    paths: Paths = Paths()
    subtitles: Subtitles = Subtitles()
    themes: Themes = Themes()
    characters: Characters = Characters()
    articles: Articles = Articles()
    persona: Persona = Persona()
    root: str = "."

    def path(self, value: str) -> str:
        """A configured path; relative ones start at ``root``, addresses with a scheme stay as they are."""
        return value if "://" in value or os.path.isabs(value) else str(Path(self.root) / value)

    def out(self, *parts: str) -> str:
        """Where an output goes, below the outputs folder."""
        return "/".join([self.path(self.paths.outputs_dir), *parts])


def _with(section, values: dict):
    known = {f.name for f in dataclasses.fields(section)}
    changed = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return dataclasses.replace(section, **changed)


@functools.lru_cache(maxsize=4)
def settings(path: str | None = None) -> Settings:
    """Defaults, then the YAML file where one is given, then the environment; values are parsed as YAML."""
    import yaml

    raw: dict[str, dict] = {}
    if path:
        raw = yaml.safe_load(Path(path).read_text()) or {}
    for key, value in os.environ.items():
        section, _, field = key.removeprefix(PREFIX).lower().partition("__")
        if key.startswith(PREFIX) and field:
            raw.setdefault(section, {})[field] = yaml.safe_load(value)
    base = Settings(root=str(Path(path).parent) if path else ".")
    return dataclasses.replace(base, **{f.name: _with(getattr(base, f.name), raw[f.name]) for f in dataclasses.fields(base) if f.name in raw and f.name != "root"})

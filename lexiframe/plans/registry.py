"""Query registry: key -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn

    return deco


MODULES = ["q_corpus", "q_text", "q_lexicon", "q_rules", "q_panel", "q_keystrokes", "q_filings",
           "q_answers", "q_features", "q_models", "q_scalars"]


def load_all() -> dict[str, tuple[Callable, str | None]]:
    import importlib

    for m in MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    return REGISTRY

"""Pluggable stages chosen by name; every stage maps columns or DataFrames to the same."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.constants import EMBEDDING_DIM, MAX_QUARTERS
from trendloom.operators import assess, topics
from trendloom.operators.vectors import hashing_embedder

logger = logging.getLogger(__name__)

EMBEDDERS: dict[str, Callable[[], Callable[[Column], Column]]] = {"hashing": lambda: hashing_embedder(EMBEDDING_DIM)}
MODELERS: dict[str, Callable[..., DataFrame]] = {"simple": topics.kmeans_labels}
DESCRIBERS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "template": lambda keywords, titles: (assess.template_title(keywords), assess.template_summary(keywords, titles)),
}
CLASSIFIERS: dict[str, Callable[[DataFrame], DataFrame]] = {"heuristic": assess.assess, "offline": assess.assess}
TRANSLATORS: dict[str, Callable[[Column, str], Column]] = {"none": lambda text, language: text}
FALLBACK = {"embedder": "hashing", "modeler": "simple", "describer": "template", "classifier": "heuristic", "translator": "none"}
REGISTRIES = {
    "embedder": EMBEDDERS, "modeler": MODELERS, "describer": DESCRIBERS, "classifier": CLASSIFIERS, "translator": TRANSLATORS,
}


def pick(kind: str, name: str):
    """Registered stage by name; unknown names are an error."""
    registry = REGISTRIES[kind]
    if name.lower() not in registry:
        raise ValueError(f"unknown {kind} {name!r}")
    return registry[name.lower()]


def pick_embedder(name: str) -> tuple[str, Callable[[Column], Column]]:
    """Embedder and the name it runs under; one that cannot be set up falls back to the offline one."""
    build = pick("embedder", name)
    try:
        return name.lower(), build()
    except Exception:  # noqa: BLE001 - a missing model must not stop the run
        logger.warning("embedder %s unavailable, using %s", name, FALLBACK["embedder"], exc_info=True)
        return FALLBACK["embedder"], EMBEDDERS[FALLBACK["embedder"]]()


@dataclass(frozen=True)
class RunOptions:
    embedder: str = "hashing"
    revision: str = "default"
    modeler: str = "simple"
    describer: str = "template"
    classifier: str = "heuristic"
    translator: str = "none"
    language: str = "en"
    max_topics: int = 12
    restarts: int = 10
    seed: int = 42
    max_new_trends: int | None = None
    quarters: int | None = MAX_QUARTERS  # newest quarters that growth and maturity see, all if None


def other_language(language: str) -> str:
    return "de" if language == "en" else "en"


def translated(texts: DataFrame, translator: str, language: str) -> DataFrame:
    """Own-language rows plus the rows of the other language."""
    translate, target = pick("translator", translator), other_language(language)
    parts = ("title", "summary", "rationale")
    own = texts.select("trend_id", F.lit(language).alias("language"), *parts)
    rest = texts.select("trend_id", F.lit(target).alias("language"), *[translate(F.col(p), target).alias(p) for p in parts])
    return own.unionByName(rest)

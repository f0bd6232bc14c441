"""A tenant's settings: activities, product attributes, windows, weights and decays."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timezone

ATTRIBUTE_KINDS = ("fixed", "list", "numeric", "date", "text")
ATTRIBUTE_FLAGS = ("required", "persisted", "default", "context_filter", "similarity_filter", "similarity_weight")


@dataclass(frozen=True)
class Activity:
    """What an activity type says of a user's liking (rating 1 to 5), and its side effects."""

    rating: int
    blocking: bool = False
    in_boost: float = 1.0
    out_boost: float = 1.0


@dataclass(frozen=True)
class Attribute:
    """A declared product attribute; column is its path in the products table (dots reach into structs)."""

    name: str
    kind: str
    column: str = ""
    required: bool = False
    persisted: bool = True
    default: object = None
    context_filter: bool = True
    similarity_filter: bool = False
    similarity_weight: float = 0.0

    def __post_init__(self):
        if self.kind not in ATTRIBUTE_KINDS:
            raise AttributeError(f"attribute {self.name}: unknown kind {self.kind}")
        if not isinstance(self.similarity_weight, (int, float)) or self.similarity_weight < 0:
            raise AttributeError(f"attribute {self.name}: similarity_weight must be a number of 0 or more")

    @property
    def path(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Decay:
    """A decay function by name and parameters: none, linear(ttl), rational, exponential(halflife) or step(ttl)."""

    kind: str = "none"
    parameter: float = 0.0


#: The catalogue over the event types of the bundled tables.
EVENT_ACTIVITIES = {
    "purchase": Activity(5, blocking=True),
    "signup": Activity(4, in_boost=1.5),
    "click": Activity(3),
    "error": Activity(2, out_boost=1.2),
}

CATALOGUE = (
    Attribute("language", "fixed", required=True, default="en", similarity_filter=True),
    Attribute("category", "fixed", similarity_weight=0.1),
    Attribute("source", "list", similarity_weight=0.1),
    Attribute("title", "text", similarity_weight=0.1),
    Attribute("full_content", "text", required=True, persisted=False, similarity_weight=0.6),
    Attribute("date", "date", required=True),
    Attribute("expiration_date", "date"),
    Attribute("price", "numeric", default=100.0, similarity_weight=0.1),
)


@dataclass(frozen=True)
class EngineConfig:
    activities: dict = field(default_factory=lambda: dict(EVENT_ACTIVITIES))
    attributes: tuple = CATALOGUE
    present: datetime = datetime(2024, 1, 31, tzinfo=timezone.utc)
    date_attribute: str = "date"
    impressions: bool = False
    filter_strategy: str = "AFTER_SCORING"
    user_templates: int = 50
    product_templates: int = 50
    top_terms: int = 200
    recent_products: int = 5
    popularity_window: int = 5
    short_term_window: int = 30
    uu_window: int | None = None
    pp_window: int | None = None
    tfidf_window: int | None = None
    min_rating_conservative: int = 3
    min_rating_aggressive: int = 5
    min_rating_from_user: int = 4
    min_rating_from_product: int = 3
    risk: float = 0.8
    min_numerator: int = 1
    min_strength: float = 1e-4
    age_decay: Decay = Decay("exponential", 4.0)
    history_decay: Decay = Decay("step", 2.0)
    previous_consumption: float = 0.0
    date_halflife: float | None = 2.0
    near_identical_field: str | None = "title"
    near_identical_threshold: int | None = 2
    page_size: int | None = 10
    fill_in: str | None = "POP"
    weights: dict = field(
        default_factory=lambda: {
            "HRChunks": [("UBCF", 0.25, True), ("PBCF", 0.25, True), ("CB", 0.5, True)],
            "HRRandom": [("UBCF", 0.25, True), ("PBCF", 0.25, True), ("CB", 0.5, True)],
            "HRVoting": [("UBCF", 0.25, False), ("PBCF", 0.25, True), ("CB", 0.5, False)],
        }
    )
    anonymous_prefix: str = "hmrtmp"  # fixed value: ids of anonymous users begin so
    seed: int = 17

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if "language" not in names:
            raise AttributeError("the attribute language is mandatory")
        if len(set(names)) < len(names):
            raise AttributeError("attributes must have different names")
        if self.filter_strategy not in ("BEFORE_SCORING", "AFTER_SCORING"):
            raise AttributeError(f"unknown filter strategy {self.filter_strategy}")
        for kind, activity in self.activities.items():
            if not 1 <= activity.rating <= 5:
                raise AttributeError(f"activity {kind}: a rating is 1 to 5")

    def attribute(self, name: str) -> Attribute:
        for a in self.attributes:
            if a.name == name:
                return a
        raise KeyError(name)

    def of_kind(self, kind: str) -> list[Attribute]:
        return [a for a in self.attributes if a.kind == kind]

    @property
    def blocking(self) -> list[str]:
        return sorted(k for k, a in self.activities.items() if a.blocking)

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)


def from_mapping(settings: dict) -> EngineConfig:
    """A config from plain nested settings, as a JSON or YAML file gives them. The string "none", in any case, means unset."""

    def plain(x):
        if isinstance(x, str) and x.lower() == "none":
            return None
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x

    settings = plain(settings)
    known = {f.name for f in fields(EngineConfig)}
    if unknown := sorted(set(settings) - known):
        raise AttributeError(f"unknown settings: {', '.join(unknown)}")
    if "activities" in settings:
        settings["activities"] = {k: Activity(**v) for k, v in settings["activities"].items()}
    if "attributes" in settings:
        for a in settings["attributes"]:
            if extra := sorted(set(a) - {"name", "kind", "column", *ATTRIBUTE_FLAGS}):
                raise AttributeError(f"attribute {a.get('name')}: unknown properties {', '.join(extra)}")
        settings["attributes"] = tuple(Attribute(**a) for a in settings["attributes"])
    for k in ("age_decay", "history_decay"):
        if k in settings:
            settings[k] = Decay(**settings[k]) if settings[k] else Decay()
    if isinstance(settings.get("present"), str):
        settings["present"] = datetime.fromisoformat(settings["present"]).replace(tzinfo=timezone.utc)
    if "weights" in settings:
        settings["weights"] = {k: [tuple(x) if len(x) == 3 else (*x, True) for x in v] for k, v in settings["weights"].items()}
    return EngineConfig(**settings)


def load(path: str) -> EngineConfig:
    """A config from a JSON file, or a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("reading YAML needs the yaml package; JSON needs none") from error
            return from_mapping(yaml.safe_load(f))
        return from_mapping(json.load(f))


class Registry:
    """Configs by environment name, each read once."""

    def __init__(self):
        self._found: dict[str, EngineConfig] = {}

    def register(self, environment: str, config: EngineConfig | str) -> None:
        self._found[environment] = load(config) if isinstance(config, str) else config

    def get(self, environment: str) -> EngineConfig:
        if environment not in self._found:
            raise KeyError(f"unknown environment {environment}")
        return self._found[environment]

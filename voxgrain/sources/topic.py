"""Parameters of a collection run."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

# Communities with a raised quota, communities whose posts must pass the
# language test, and the numbers of the quota rule.
PRIORITY_COMMUNITIES = ("brasil", "brasilivre", "politica", "worldnews", "politics")
LANGUAGE_TESTED = ("politics", "worldnews", "news", "economics", "geopolitics", "conservative", "liberal")
PRIORITY_SHARE_PCT = 15
SMALLEST_QUOTA = 10
TOP_UP_SCAN = 100

# How far back a search looks, in hours; "all" has no bound.
SEARCH_HOURS = {"hour": 1, "day": 24, "week": 7 * 24, "month": 30 * 24, "year": 365 * 24, "all": None}


@dataclass(frozen=True)
class Topic:
    """What to collect and how much of it."""

    name: str
    keywords: tuple[str, ...]
    communities: tuple[str, ...]
    limit: int = 200
    methods: tuple[str, ...] = ("hot", "top", "new")
    min_length: int = 15
    max_length: int = 500
    min_score: float = 0
    language: str = "pt"
    priority: tuple[str, ...] = PRIORITY_COMMUNITIES
    language_tested: tuple[str, ...] = LANGUAGE_TESTED
    time_filter: str = "month"

    def __post_init__(self) -> None:
        if self.time_filter not in SEARCH_HOURS:
            raise ValueError(f"time_filter must be one of {', '.join(SEARCH_HOURS)}")

    @classmethod
    def from_mapping(cls, config: dict[str, Any]) -> "Topic":
        """Build from the nested topic settings (topic, keywords, limits, filters, reddit)."""
        filters, site = config.get("filters", {}), config.get("reddit", {})
        given = {
            "name": config.get("topic", ""),
            "keywords": tuple(config.get("keywords", ())),
            "communities": tuple(site.get("subreddits", ())),
            "methods": tuple(site.get("search_methods", ("hot", "top", "new"))),
            "limit": config.get("limits", {}).get("reddit", 200),
            "time_filter": site.get("time_filter", "month"),
        }
        known = {f.name for f in fields(cls)}
        given.update({name: value for name, value in filters.items() if name in known})
        return cls(**given)

    def quota(self, community: str) -> int:
        """Posts wanted from one community."""
        share = self.limit * PRIORITY_SHARE_PCT // 100
        if community in self.priority:
            return share
        others = sum(1 for name in self.communities if name not in self.priority)
        return max(SMALLEST_QUOTA, (self.limit - len(self.priority) * share) // max(1, others))

    def most_found(self) -> int:
        """Rows that all searches together return at most."""
        return len(self.methods) * len(self.keywords) * sum(self.per_search(name) for name in self.communities)

    def per_search(self, community: str) -> int:
        """Posts taken from one search, that is one method and keyword in one community."""
        return max(1, self.quota(community) // len(self.methods))

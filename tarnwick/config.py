"""Limits, defaults and validated settings."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults and limits of the service's API.
DEFAULT_COUNT, MAX_COUNT, MAX_CANDIDATES = 10, 100, 100
MAX_BATCH, MAX_PROPERTIES_BYTES, MAX_STRING_BYTES, MAX_TAGS = 100, 2560, 2048, 10
MAX_INDEXED_PROPERTIES, MAX_LIST_ITEMS, MAX_FILTER_CHILDREN = 11, 500, 10
MAX_HISTORY, MAX_HISTORY_FOR_INTERESTS, MAX_INTERESTS_FOR_KNN = 200, 20, 10
RECOMMENDATION_WEIGHTS, SEARCH_WEIGHTS = (1.0, 1.0, 0.0), (1.0, 1.0, 0.5)
RRF_K, BM25_K1, BM25_B = 60.0, 1.2, 0.75


@dataclass(frozen=True)
class InterestConfig:
    """How centres of interest move, appear and age."""

    shift: float = 0.1
    threshold: float = 0.67
    min_interests: int = 1
    horizon_days: int = 30

    def __post_init__(self):
        if not 0 <= self.shift <= 1:
            raise ValueError("shift must lie in [0, 1]")
        if not -1 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [-1, 1]")
        if self.min_interests < 1 or self.horizon_days < 0 or int(self.horizon_days) != self.horizon_days:
            raise ValueError("min_interests must be at least 1 and horizon_days a whole number of days")


@dataclass(frozen=True)
class SplitConfig:
    chunk_size: int = 500
    hard_limit: int = 520


@dataclass(frozen=True)
class EngineConfig:
    interests: InterestConfig = field(default_factory=InterestConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    store_user_history: bool = True
    max_count: int = MAX_COUNT
    max_candidates: int = MAX_CANDIDATES

    def checked_count(self, count: int | None, candidates: int | None = None) -> int:
        """count, if 1 <= count <= min(most results, candidates)."""
        count = DEFAULT_COUNT if count is None else count
        most = min(self.max_count, self.max_candidates if candidates is None else candidates)
        if not 1 <= count <= most:
            raise InvalidCount(count=count, most=most)
        return count


class EngineError(Exception):
    """An error with a kind and details, as the API reports it."""

    def __init__(self, **details):
        super().__init__(f"{type(self).__name__}: {details}")
        self.kind, self.details = type(self).__name__, details


class InvalidCount(EngineError): ...


class InvalidFilter(EngineError): ...


class UnindexedId(EngineError): ...


class IncompatibleType(EngineError): ...


class IncompatibleUpdate(EngineError): ...


class NotEnoughInteractions(EngineError): ...


class BatchTooLarge(EngineError): ...


class InvalidUser(EngineError): ...


class DocumentNotFound(EngineError): ...


class PropertyNotFound(EngineError): ...


class InvalidProperties(EngineError): ...


class InvalidTenant(EngineError): ...

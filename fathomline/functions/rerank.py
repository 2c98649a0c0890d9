"""Driver-side helpers around a reranking service: cache, circuit breaker and scores from log probabilities."""

from __future__ import annotations

import math
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence


class RerankCache:
    """The scores of the last ``size`` (query, set of ids) pairs."""

    def __init__(self, size: int = 256) -> None:
        self._size, self._kept = size, OrderedDict()

    def get(self, query: str, ids: Sequence[int]) -> dict[int, float] | None:
        key = (query, tuple(sorted(ids)))
        if key in self._kept:
            self._kept.move_to_end(key)
        return self._kept.get(key)

    def put(self, query: str, scores: dict[int, float]) -> None:
        self._kept[query, tuple(sorted(scores))] = scores
        self._kept.move_to_end((query, tuple(sorted(scores))))
        while len(self._kept) > self._size:
            self._kept.popitem(last=False)


class Unreachable(Exception):
    """The service did not answer."""


class CircuitBreaker:
    """After three unreachable calls in a row no call is made for 30 seconds; other errors do not count."""

    def __init__(self, failures: int = 3, pause: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self._limit, self._pause, self._clock = failures, pause, clock
        self._failed, self._until = 0, 0.0

    @property
    def is_open(self) -> bool:
        return self._clock() < self._until

    def call(self, fn: Callable[[], object]) -> object:
        if self.is_open:
            raise Unreachable("the breaker is open")
        try:
            result = fn()
        except Unreachable:
            self._failed += 1
            if self._failed >= self._limit:
                self._until, self._failed = self._clock() + self._pause, 0
            raise
        self._failed = 0
        return result


def yes_probability(yes: float | None, no: float | None) -> float:
    """The chance of yes from the log probabilities of the two answers, either of which may be missing."""
    if yes is None and no is None:
        return 0.5
    if yes is None:
        return 0.0
    if no is None:
        return min(math.exp(yes), 1.0)
    return 1.0 / (1.0 + math.exp(no - yes))


def judged_by_chat(ask: Callable[[str, str], tuple[float | None, float | None]]) -> Callable[[str, Sequence[str]], list[float]]:
    """A reranker from a chat model: ``ask(query, text)`` gives the log probabilities of the answers yes and no."""
    return lambda query, texts: [yes_probability(*ask(query, text)) for text in texts]

"""Bounded look-ahead inside a task: calls finish in any order, results come in the order of the rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import local
from typing import TypeVar

T, R, C = TypeVar("T"), TypeVar("R"), TypeVar("C")


def in_order(items: Iterable[T], connect: Callable[[], C], call: Callable[[C, T], R], workers: int = 8) -> Iterator[R]:
    """call(client, item) for each item, first in, first out. At most 2 * workers items are taken ahead of the one that is
    waited for, however long the input; each worker has a client of its own. An error of a call is raised in its turn."""
    mine = local()

    def run(item: T) -> R:
        if not hasattr(mine, "client"):
            mine.client = connect()
        return call(mine.client, item)

    waiting: deque = deque()
    pool = ThreadPoolExecutor(max(1, workers))
    try:
        for item in items:
            waiting.append(pool.submit(run, item))
            if len(waiting) >= 2 * max(1, workers):
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)

"""Reaching definitions and strongly connected parts of one graph in memory."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator, Mapping

import numpy as np


def reaching(
    edges: Iterable[tuple[int, int]], defs: Mapping[int, Collection[str]], uses: Mapping[int, Collection[str]], entry: int = 1
) -> Iterator[tuple[int, int, str]]:
    """(definition, use, variable) for each definition that the entry reaches.

    A definition stops at a redefinition, whose own use it still reaches; a node
    is not its own target; nodes without facts are passed through.
    """
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def walk(start: int, ends: Callable[[int], bool]) -> list[int]:
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                if not ends(n):
                    todo += after.get(n, ())
        return sorted(seen - {start})

    for d in [entry, *walk(entry, lambda n: False)]:
        for name in defs.get(d, ()):
            for n in walk(d, lambda n: n == d or name in defs.get(n, ())):  # noqa: B023
                if name in uses.get(n, ()):
                    yield d, n, name


def strong_parts(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes one node of its strongly connected part, the same for all of a part (Tarjan, without recursion)."""
    order = np.argsort(src, kind="stable")
    after, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    place, low, part, at = [-1] * n, [0] * n, [-1] * n, first[:]
    held, count = [], 0
    for start in range(n):
        path = [start] if place[start] < 0 else []
        while path:
            v = path[-1]
            if place[v] < 0:
                place[v] = low[v] = count
                count += 1
                held.append(v)
            if at[v] < first[v + 1]:
                w = after[at[v]]
                at[v] += 1
                if place[w] < 0:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], place[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == place[v]:
                while part[v] < 0:
                    part[held.pop()] = v
    return np.array(part, dtype=np.int64)

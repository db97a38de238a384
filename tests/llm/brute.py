"""Plain Python versions of the operators' rules, for small fixtures."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def linked(a: set, b: set, percent: int = 80) -> bool:
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def components(ids, edges) -> dict:
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs: list[tuple], n: int, percent: int = 80) -> dict:
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, n))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    edges = [(a, b) for (a, x), (b, y) in combinations(flat, 2) if linked(x, y, percent)]
    return components(sets, edges)


def fold(text: str, parts: int) -> bool:
    """Whether a text's hash puts it into the part that the first fit does not see."""
    first = xxhash.xxh64_intdigest(text.encode(), seed=42)
    signed = xxhash.xxh64_intdigest(b"fold", seed=first)
    return (signed - ((signed >> 63) << 64)) % parts == 0


def logistic(x: np.ndarray, y: np.ndarray, ridge: list[float]) -> np.ndarray:
    """Weights of the penalised logistic fit, by small steps uphill instead of the library's own solver."""
    w, r = np.zeros(x.shape[1]), np.array(ridge)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - r * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(r)
        step = np.linalg.lstsq(bend, slope, rcond=None)[0]
        w = w + step
        if np.abs(step).max() < 1e-12:
            break
    return w

"""Hashed character n-grams of whole texts, counted with numpy inside tasks."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of 2 ** bits) of the character n-grams of a text, and how often each occurs."""
    points = code_points(text)
    rolled, found = points, []
    for order in range(1, max(orders) + 1):
        if order > 1:
            if len(points) < order:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + points[order - 1 :]  # wraps
        if order in orders:
            mixed = (rolled + np.uint32(order)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            found.append((mixed >> np.uint32(32 - bits)).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(np.concatenate(found), minlength=1 << bits)
    used = np.flatnonzero(counts)
    return used, counts[used]

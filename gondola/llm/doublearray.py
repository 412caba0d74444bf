"""Double-array tries over bytes, built in tasks and read by numpy for many positions at once.

A trie has numbered roots; a key is a root and a string of bytes. The child of a state s by
byte b is the slot base[s] + b, if check of that slot is s; value is the number of the key
that ends there, or -1. Roots stand outside the slots: root r is the state -(r + 2) and its
base is root_base[r]. The slots begin and end with 256 unused ones, so no step leaves the arrays.
"""

from __future__ import annotations

import numpy as np

PAD = 256
#: Slots that are searched for a place at once.
WINDOW = 8192
FIELDS = ("root_base", "base", "check", "value")


def _places(masks: list[list[int]]) -> list[int]:
    """Bases for nodes with the given bytes (most bytes first), first fit within a moving window of slots."""
    out, low, used, every = [], PAD, 0, (1 << WINDOW) - 1
    for labels in masks:
        while True:
            clash = 0
            for b in labels:
                clash |= used >> b
            free = ~clash & every
            if free:
                at = (free & -free).bit_length() - 1
                break
            low += WINDOW
            used >>= WINDOW
        for b in labels:
            used |= 1 << (at + b)
        out.append(low + at)
    return out


def build(root: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray, roots: int) -> dict[str, np.ndarray]:
    """The trie of distinct keys in order of root and bytes; key i is root[i] and buf[start[i] : start[i] + size[i]], never empty."""
    node = root.astype(np.int64)
    n, parents, labels = roots, [], []
    ends = np.full(len(root), -1, np.int64)
    rows, depth = np.arange(len(root)), 0
    while len(rows):
        label = buf[start[rows] + depth]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (node[rows[1:]] != node[rows[:-1]]) | (label[1:] != label[:-1])
        parents.append(node[rows[fresh]])
        labels.append(label[fresh])
        node[rows] = n + np.cumsum(fresh) - 1
        n += int(fresh.sum())
        depth += 1
        done = size[rows] == depth
        ends[rows[done]] = node[rows[done]]
        rows = rows[~done]
    parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
    label = np.concatenate(labels).astype(np.int64) if labels else np.empty(0, np.int64)
    order = np.argsort(parent, kind="stable")
    by, by_label = parent[order], label[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.empty(0, np.int64)
    width = np.diff(np.append(first, len(by)))
    base = np.zeros(n, np.int64)  # by node; 0 leads to unused slots
    many = np.flatnonzero(width > 1)
    many = many[np.argsort(-width[many], kind="stable")]
    flat = by_label.tolist()
    base[by[first[many]]] = _places([flat[a : a + w] for a, w in zip(first[many].tolist(), width[many].tolist(), strict=True)])
    wide = np.repeat(width > 1, width)
    taken = base[by[wide]] + by_label[wide]
    slots = max(int(taken.max()) + 1 if len(taken) else PAD, PAD + len(by))
    used = np.zeros(slots, bool)
    used[:PAD] = used[taken] = True
    free = np.flatnonzero(~used)
    single = first[width == 1]
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(slots, slots + len(single) - len(free))])
    base[by[single]] = free[: len(single)] - by_label[single]
    slot = np.zeros(n, np.int64)
    slot[roots + order] = base[by] + by_label
    slots = max(slots, int(slot.max(initial=0)) + 1) + PAD
    out = {k: np.full(slots, -1 if k != "base" else 0, np.int32) for k in FIELDS[1:]}
    out["root_base"] = base[:roots].astype(np.int32)
    inner = np.arange(roots, n)
    out["base"][slot[inner]] = base[inner]
    out["check"][slot[inner]] = np.where(parent < roots, -(parent + 2), slot[parent])
    out["value"][slot[ends]] = np.arange(len(ends))
    return out


def step(trie: dict[str, np.ndarray], base: np.ndarray, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots reached from states (with their bases) by labels, and whether there is such a child."""
    slot = base + label
    return slot, trie["check"][slot] == state


def pack(trie: dict[str, np.ndarray]) -> list[bytes]:
    return [trie[k].astype("<i4").tobytes() for k in FIELDS]


def unpack(parts) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(p, "<i4") for k, p in zip(FIELDS, parts, strict=True)}

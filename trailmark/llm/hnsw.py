"""A hierarchical navigable small-world graph in flat numpy arrays.

Nodes go in by batches: the batch's neighbours are sought by beams that advance
together, one gather and one product per step for all of them. Layer k holds the
nodes of level k or more, as a prefix of the node order, and one array of neighbour
places with -1 for none.
"""

from __future__ import annotations

import math

import numpy as np

#: Steps that each beam opens at once, and nodes put in at once.
OPENED = 4
BATCH = 1024


def levels(n: int, links: int) -> np.ndarray:
    """Level of each of ``n`` nodes, highest first: counts fall by ``links`` from level to level."""
    u = np.random.default_rng(9).random(n)
    return np.sort(np.floor(-np.log(1 - u) / math.log(links)).astype(np.int64))[::-1]


def beam(vectors: np.ndarray, layer: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest places found on a layer, best first, -1 for none.

    ``entry`` has one or more starting places for each query. A query is done when all
    places that it holds are opened.
    """
    b, n = len(queries), len(layer)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n), bool)
    start = entry.shape[1]
    place = np.full((b, width + start), -1, np.int64)
    score = np.full((b, width + start), -np.inf, np.float32)
    place[:, :start] = entry
    score[:, :start] = np.where(entry >= 0, np.einsum("bd,bkd->bk", queries, vectors[np.maximum(entry, 0)]), -np.inf)
    np.put_along_axis(seen, np.maximum(entry, 0), True, axis=1)
    order = np.argsort(-score, axis=1)[:, :width]
    place, score = place[rows, order], score[rows, order]
    opened = place < 0
    live = np.arange(b)
    while len(live):
        at = np.arange(len(live))[:, None]
        waiting = np.where(opened[live], -np.inf, score[live])
        best = np.argpartition(-waiting, min(OPENED, width) - 1, axis=1)[:, :OPENED]
        go = np.isfinite(waiting[at, best])
        source = np.where(go, place[live[:, None], best], -1)
        mark = opened[live]
        mark[at, best] = True
        opened[live] = mark
        near = np.where(source[:, :, None] >= 0, layer[np.maximum(source, 0)], -1).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("kd,kd->k", queries[live[r]], vectors[near[r, c]])
        both = np.concatenate([score[live], found], axis=1)
        names = np.concatenate([place[live], np.where(fresh, near, -1)], axis=1)
        done = np.concatenate([opened[live], ~fresh], axis=1)
        top = np.argpartition(-both, width - 1, axis=1)[:, :width]
        score[live], place[live], opened[live] = both[at, top], names[at, top], done[at, top]
        live = live[~opened[live].all(axis=1)]
    order = np.argsort(-score, axis=1, kind="stable")
    return place[rows, order], score[rows, order]


def choose(vectors: np.ndarray, places: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's places (best first): those nearer to the row's node
    than to any place chosen before, then the best of the rest.
    """
    b, k = places.shape
    own = vectors[np.maximum(places, 0)]
    # In parts so small that the library for products keeps to this thread.
    turned = own.transpose(0, 2, 1)
    among = np.concatenate([own[:, at : at + 32] @ turned for at in range(0, k, 32)], axis=1)
    taken = np.zeros((b, k), bool)
    number = np.zeros(b, np.int64)
    for j in range(k):
        blocked = (taken[:, :j] & (among[:, j, :j] > scores[:, j : j + 1])).any(axis=1) if j else np.zeros(b, bool)
        taken[:, j] = (places[:, j] >= 0) & ~blocked & (number < most)
        number += taken[:, j]
    order = np.argsort(np.where(places < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(places, order, axis=1)


def _receive(vectors: np.ndarray, layer: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Adds ``new[k]`` to the neighbours of ``to[k]``; full lists are chosen anew."""
    if not len(to):
        return
    most = layer.shape[1]
    order = np.lexsort((-np.einsum("kd,kd->k", vectors[to], vectors[new]), to))
    to, new = to[order], new[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, count)
    keep = rank < most  # more than these can't be kept
    extra = np.full((len(nodes), most), -1, np.int64)
    extra[np.repeat(np.arange(len(nodes)), count)[keep], rank[keep]] = new[keep]
    for at in range(0, len(nodes), BATCH):
        part = slice(at, at + BATCH)
        own = nodes[part]
        places = np.concatenate([layer[own], extra[part]], axis=1)
        scores = np.where(places >= 0, np.einsum("bd,bkd->bk", vectors[own], vectors[np.maximum(places, 0)]), -np.inf)
        best = np.argsort(-scores, axis=1, kind="stable")
        layer[own] = choose(vectors, np.take_along_axis(places, best, axis=1), np.take_along_axis(scores, best, axis=1), most)


def build(vectors: np.ndarray, links: int, width: int) -> list[np.ndarray]:
    """The layers over unit-scale ``vectors``, base first; node k is row k."""
    n = len(vectors)
    level = levels(n, links)
    sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)] if n else []
    layers = [np.full((size, 2 * links if k == 0 else links), -1, np.int64) for k, size in enumerate(sizes)]
    put = min(n, 2)
    for layer in layers:
        if len(layer) >= 2:
            layer[0, 0], layer[1, 0] = 1, 0
    while put < n:
        batch = np.arange(put, min(n, put + min(BATCH, max(16, put // 2))))
        entry = np.zeros((len(batch), 1), np.int64)
        for k in range(len(layers) - 1, -1, -1):
            layer = layers[k]
            there = min(put, len(layer))  # nodes of this layer that are in
            if not there:
                continue
            own = batch[batch < len(layer)]
            rest = len(batch) - len(own)
            found, score = beam(vectors, layer[:there], vectors[batch], entry, width if len(own) else 1)
            if len(own):
                # Nodes of one batch may be each other's neighbours.
                # (not by @, whose library would wait in threads of its own beside the task's)
                mutual = np.einsum("id,jd->ij", vectors[own], vectors[own])
                np.fill_diagonal(mutual, -np.inf)
                near = np.argsort(-mutual, axis=1)[:, : min(width, len(own) - 1)]
                places = np.concatenate([found[: len(own)], own[near]], axis=1)
                scores = np.concatenate([score[: len(own)], np.take_along_axis(mutual, near, axis=1)], axis=1)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :width]
                chosen = choose(vectors, np.take_along_axis(places, best, axis=1), np.take_along_axis(scores, best, axis=1), links)
                layer[own, : chosen.shape[1]] = chosen
                r, c = np.nonzero(chosen >= 0)
                _receive(vectors, layer, chosen[r, c], own[r])
            entry = found[:, :1] if rest or not len(own) else found[:, : min(8, found.shape[1])]
        put = int(batch[-1]) + 1
    return layers


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int) -> np.ndarray:
    """Places of the ``width`` nearest nodes found for each query, best first, -1 for none."""
    entry = np.zeros((len(queries), 1), np.int64)
    for layer in layers[:0:-1]:
        entry = beam(vectors, layer, queries, entry, 8)[0][:, :1]
    return beam(vectors, layers[0], queries, entry, max(width, OPENED))[0]

"""Hierarchical navigable small-world graphs in NumPy, built and searched for many queries in lockstep.

Layer l holds the nodes whose level is l or more; levels fall off geometrically and come from a hash of the node's id, so a rebuilt
graph is the same graph. Layers are built from the top: a node's neighbours are found by descending through the layers above and a beam
search in its own, then thinned so that no neighbour is closer to another neighbour than to the node. Nodes join in batches, and those
of a batch also see each other. Similarity is the dot product of unit vectors.
"""

from __future__ import annotations

import io

import numpy as np

#: Neighbours kept in upper layers; the lowest layer keeps twice as many. Width of the beam when building.
NEIGHBOURS, BUILD_BEAM = 16, 64
#: Queries that are searched in lockstep, and nodes that each expands in a step, as a part of its beam's width.
QUERIES, EXPANDED = 512, 16
FIRST, BATCH = 512, 1024


def _levels(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    unit = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(unit, 1e-18)) / np.log(NEIGHBOURS)).astype(np.int64)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


class Graph:
    """vectors: unit vectors, one a row. layers[l]: neighbours of each node in layer l, -1 where there are fewer."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float32)
        n = len(ids)
        levels = _levels(ids)
        self.order = np.lexsort((ids, -levels))  # upper nodes first: layer l is a prefix
        held = [int((levels >= l).sum()) for l in range(int(levels.max(initial=0)) + 1)]
        self.layers: list[np.ndarray] = [np.empty(0)] * len(held)
        for layer in range(len(held) - 1, -1, -1):
            self._build(layer, held[layer], n)
        self._undirect()

    def _undirect(self) -> None:
        """The lowest layer as neighbour lists that go both ways, so that every node can be met from those it knows."""
        table = self.layers[0]
        n = len(table)
        a, b = np.repeat(np.arange(n), table.shape[1]), table.reshape(-1)
        a, b = a[b >= 0].astype(np.int64), b[b >= 0].astype(np.int64)
        keys = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.targets = (keys % n).astype(np.int32)
        self.offsets = np.searchsorted(keys, np.arange(n + 1) * n)

    def _around(self, nodes: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, neighbour) of all neighbours."""
        if layer or not hasattr(self, "targets"):
            found = self.layers[layer][nodes]
            place, column = np.nonzero(found >= 0)
            return place, found[place, column]
        first, count = self.offsets[nodes], self.offsets[nodes + 1] - self.offsets[nodes]
        place = np.repeat(np.arange(len(nodes)), count)
        return place, self.targets[np.arange(len(place)) + np.repeat(first - np.cumsum(count) + count, count)]

    def _build(self, layer: int, size: int, n: int) -> None:
        most = NEIGHBOURS * (1 + (layer == 0))
        self.layers[layer] = np.full((n, most), -1, dtype=np.int32)
        members = self.order[:size]
        first = members[:FIRST]
        self._join(layer, first, np.tile(first, (len(first), 1)), self.vectors[first] @ self.vectors[first].T)
        done = len(first)
        while done < size:
            new = members[done : done + min(done, BATCH)]
            ids, sims = [], []
            for at in range(0, len(new), QUERIES):
                part = new[at : at + QUERIES]
                i, s = self._beam(self.vectors[part], layer, BUILD_BEAM, self._descend(self.vectors[part], layer))
                ids.append(i)
                sims.append(s)
            mutual = self.vectors[new] @ self.vectors[new].T
            near = _top(mutual, min(len(new), most + 1))
            ids = np.hstack([np.concatenate(ids), new[near]])
            sims = np.hstack([np.concatenate(sims), np.take_along_axis(mutual, near, 1)])
            self._join(layer, new, ids, sims)
            done += len(new)

    def _join(self, layer: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links nodes with the best of their candidates, both ways."""
        table = self.layers[layer]
        for at in range(0, len(nodes), QUERIES):
            part = slice(at, at + QUERIES)
            table[nodes[part]] = self._thinned(nodes[part], ids[part], sims[part], table.shape[1])
        links = table[nodes]
        source = np.repeat(nodes, links.shape[1])
        target = links.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else []
        full = []
        for a, b in zip(heads, [*heads[1:], len(target)][: len(heads)], strict=True):
            t = target[a]
            old = table[t][table[t] >= 0]
            both = np.concatenate([old, np.setdiff1d(source[a:b], old)])
            if len(both) <= table.shape[1]:
                table[t, : len(both)] = both
            else:
                full.append((t, both))
        for at in range(0, len(full), QUERIES):
            part = full[at : at + QUERIES]
            width = max(len(x) for _, x in part)
            wide = np.full((len(part), width), -1, dtype=np.int64)
            for i, (_, x) in enumerate(part):
                wide[i, : len(x)] = x
            who = np.array([t for t, _ in part])
            near = np.where(wide >= 0, np.einsum("qkd,qd->qk", self.vectors[wide], self.vectors[who]), -np.inf)
            table[who] = self._thinned(who, wide, near, table.shape[1])

    def _thinned(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each node up to `most` candidates, nearest first; those closer to one already taken come only after all others."""
        sims = np.where((ids < 0) | (ids == nodes[:, None]), -np.inf, sims)
        pick = _top(sims, min(sims.shape[1], 3 * most))
        ids, sims = np.take_along_axis(ids, pick, 1), np.take_along_axis(sims, pick, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        again = np.zeros(ids.shape, dtype=bool)
        sorted_ids = np.take_along_axis(ids, by_id, 1)
        np.put_along_axis(again, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        sims = np.where(again, -np.inf, sims)
        x = self.vectors[ids]
        closest = np.full(ids.shape, -np.inf, dtype=np.float32)  # to any taken one
        taken = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            take = (sims[:, j] > closest[:, j]) & (sims[:, j] > -np.inf) & (taken.sum(axis=1) < most)
            taken[:, j] = take
            if take.any():
                near = np.einsum("qkd,qd->qk", x[take], x[take, j])
                closest[take] = np.maximum(closest[take], near)
        rank = np.where(taken, 0, np.where(sims > -np.inf, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(rank, best, 1) < 2 * ids.shape[1], np.take_along_axis(ids, best, 1), -1)
        if out.shape[1] < most:
            out = np.hstack([out, np.full((len(out), most - out.shape[1]), -1)])
        return out

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """A node of the layer for each query, by greedy search through the layers above."""
        at = np.full((len(queries), 1), self.order[0])
        for upper in range(len(self.layers) - 1, layer, -1):
            at = self._beam(queries, upper, 1, at)[0]
        return at

    def _beam(self, queries: np.ndarray, layer: int, width: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes that a beam search meets, and their similarities; -1 where there are fewer."""
        n, q = len(self.ids), len(queries)
        ids = np.full((q, width), -1, dtype=np.int64)
        sims = np.full((q, width), -np.inf, dtype=np.float32)
        opened = np.ones((q, width), dtype=bool)  # expanded, or empty
        seen = np.zeros(q * n, dtype=bool)
        stamp = np.empty(q * n, dtype=np.int32)
        keys = (np.arange(q)[:, None] * n + entries).reshape(-1)
        step = max(2, width // EXPANDED) if width > 1 else 1
        while len(keys):
            keys = keys[~seen[keys]]
            stamp[keys] = np.arange(len(keys), dtype=np.int32)
            keys = keys[stamp[keys] == np.arange(len(keys))]
            seen[keys] = True
            row, node = keys // n, keys % n
            near = np.empty(len(keys), dtype=np.float32)
            for a in range(0, len(keys), 1 << 16):
                near[a : a + (1 << 16)] = np.einsum("kd,kd->k", self.vectors[node[a : a + (1 << 16)]], queries[row[a : a + (1 << 16)]])
            good = near > sims.min(axis=1)[row]
            row, node, near = row[good], node[good], near[good]
            if len(row):
                rows, count = np.unique(row, return_counts=True)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                wide = int(count.max())
                new_ids = np.full((len(rows), wide), -1, dtype=np.int64)
                new_sims = np.full((len(rows), wide), -np.inf, dtype=np.float32)
                slot = np.searchsorted(rows, row)
                new_ids[slot, place], new_sims[slot, place] = node, near
                all_ids, all_sims = np.hstack([ids[rows], new_ids]), np.hstack([sims[rows], new_sims])
                all_opened = np.hstack([opened[rows], new_ids < 0])
                best = _top(all_sims, width)
                ids[rows], sims[rows], opened[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_opened))
            closed = np.where(opened, -np.inf, sims)
            live = np.flatnonzero(closed.max(axis=1) > -np.inf)
            if not len(live):
                break
            pick = _top(closed[live], min(step, width))
            valid = np.take_along_axis(closed[live], pick, 1) > -np.inf
            rows = np.repeat(live, pick.shape[1])[valid.reshape(-1)]
            cols = pick.reshape(-1)[valid.reshape(-1)]
            opened[rows, cols] = True
            place, around = self._around(ids[rows, cols], layer)
            keys = rows[place] * n + around  # rows stay together
        return ids, sims

    def within(self, queries: np.ndarray, least: float, width: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the nodes at least so similar that the search meets.

        The beam is widened without bound where that similar nodes are: every one met is expanded. start: a node to begin at as well, for each query.
        """
        n = len(self.ids)
        entries = self._descend(queries, 0)
        if start is not None:
            entries = np.hstack([entries, start[:, None]])
        ids, sims = self._beam(queries, 0, min(width, n), entries)
        row, col = np.nonzero(sims >= least)
        keys = row * n + ids[row, col]
        seen = np.zeros(len(queries) * n, dtype=bool)
        stamp = np.empty(len(seen), dtype=np.int32)
        seen[keys] = True
        found = [keys]
        while len(keys):
            fresh = []
            for at in range(0, len(keys), 1 << 13):
                part = keys[at : at + (1 << 13)]
                place, around = self._around(part % n, 0)
                near = (part // n * n)[place] + around
                near = near[~seen[near]]
                stamp[near] = np.arange(len(near), dtype=np.int32)
                near = near[stamp[near] == np.arange(len(near))]
                seen[near] = True
                close = np.empty(len(near), dtype=np.float32)
                for i in range(0, len(near), 1 << 15):
                    k = near[i : i + (1 << 15)]
                    close[i : i + (1 << 15)] = np.einsum("kd,kd->k", self.vectors[k % n], queries[k // n])
                fresh.append(near[close >= least])
            keys = np.concatenate(fresh)
            found.append(keys)
        found = np.concatenate(found)
        return found // n, found % n

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, order=self.order, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.ids, self.vectors, self.order = held["ids"], held["vectors"], held["order"]
        self.layers = [held[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in held.files))]
        self._undirect()
        return self

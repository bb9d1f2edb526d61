"""A hierarchical navigable small-world graph over one shard of vectors, in memory.

One such graph is built and searched inside one task; `tessel.operators.hnsw` spreads shards over a
cluster. Distances are doubles and smaller is nearer; equal distances fall to the smaller position.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

L2, INNER_PRODUCT = "l2", "inner_product"
HEURISTIC, NEAREST = "heuristic", "nearest"
#: Queries whose beams advance together.
QUERY_BLOCK = 256


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42
    selection: str = HEURISTIC
    metric: str = L2

    def __post_init__(self) -> None:
        if self.m < 2 or self.ef_construction < 1 or self.ef_search < 1:
            raise ValueError("m must be 2 or more, the beams 1 or more")
        if self.selection not in (HEURISTIC, NEAREST) or self.metric not in (L2, INNER_PRODUCT):
            raise ValueError("unknown selection or metric")

    def max_degree(self, layer: int) -> int:
        return 2 * self.m if layer == 0 else self.m

    def short_name(self) -> str:
        return f"M={self.m},efC={self.ef_construction},ef={self.ef_search}" + (",sel=nearestM" if self.selection == NEAREST else "")


class HnswGraph:
    """Vectors [n, dim] with their layered links; positions are the nodes."""

    def __init__(self, vectors: np.ndarray, config: HnswConfig):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.config = config
        n = len(self.vectors)
        self.levels = np.zeros(n, np.int32)
        self.base = np.full((n, config.max_degree(0)), -1, np.int32)
        self.degree = np.zeros(n, np.int32)
        self.upper: list[dict[int, list[int]]] = []  # by layer from 1
        self.entry, self.top, self.count = -1, -1, 0
        self.distances = 0
        self._stamp = np.zeros(n, np.int64)
        self._round = 0
        self._above: np.ndarray | None = None

    @classmethod
    def build(cls, vectors: np.ndarray, config: HnswConfig) -> HnswGraph:
        graph = cls(vectors, config)
        draws = np.random.default_rng(config.seed).random(len(graph.vectors))
        graph.levels[:] = np.floor(-np.log1p(-draws) / math.log(config.m))
        for node in range(len(graph.vectors)):
            graph._add(node)
        return graph

    def neighbours(self, layer: int, node: int) -> np.ndarray:
        if layer == 0:
            return self.base[node, : self.degree[node]]
        return np.array(self.upper[layer - 1].get(node, ()) if layer <= len(self.upper) else (), np.int32)

    def _far(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.distances += len(nodes)
        v = self.vectors[nodes]
        if self.config.metric == L2:
            v = v - query
            return np.einsum("ij,ij->i", v, v)
        return -(v @ query)

    def _descend(self, query: np.ndarray, start: int, top: int, bottom: int) -> int:
        """The node that greedy steps reach from start, over the layers above bottom."""
        now, best = start, float(self._far(query, np.array([start]))[0])
        for layer in range(top, bottom, -1):
            while True:
                near = self.neighbours(layer, now)
                if not len(near):
                    break
                d = self._far(query, near)
                k = int(d.argmin())
                if d[k] >= best:
                    break
                now, best = int(near[k]), float(d[k])
        return now

    def _beam(self, query: np.ndarray, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """At most `width` nearest nodes found from the starts, nearest first."""
        self._round += 1
        stamp, turn = self._stamp, self._round
        nodes = np.array(starts, np.int64)
        stamp[nodes] = turn
        frontier = list(zip(self._far(query, nodes).tolist(), starts, strict=True))
        heapq.heapify(frontier)
        kept = [(-d, -node) for d, node in frontier]
        heapq.heapify(kept)
        while len(kept) > width:
            heapq.heappop(kept)
        while frontier:
            d, node = heapq.heappop(frontier)
            if len(kept) >= width and (d, node) > (-kept[0][0], -kept[0][1]):
                break
            near = self.neighbours(layer, node)
            near = near[stamp[near] != turn]
            if not len(near):
                continue
            stamp[near] = turn
            far = self._far(query, near)
            if len(kept) >= width:
                closer = far < -kept[0][0]
                near, far = near[closer], far[closer]
            for x, e in zip(far.tolist(), near.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (-x, -e))
                elif x < -kept[0][0]:
                    heapq.heapreplace(kept, (-x, -e))
                else:
                    continue
                heapq.heappush(frontier, (x, e))
        return sorted((-d, -node) for d, node in kept)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Links out of candidates that stand nearest first: the nearest, or those that no kept one is
        nearer to than the node itself."""
        if self.config.selection == NEAREST:
            return [node for _, node in found[:most]]
        nodes = np.array([node for _, node in found], np.int64)
        far = np.array([d for d, _ in found])
        open_ = np.ones(len(nodes), bool)
        kept: list[int] = []
        for k in range(len(nodes)):
            if open_[k]:
                kept.append(int(nodes[k]))
                if len(kept) == most:
                    break
                rest = np.nonzero(open_[k + 1 :])[0] + k + 1
                open_[rest] = self._far(self.vectors[nodes[k]], nodes[rest]) >= far[rest]
        return kept

    def _set(self, layer: int, node: int, links: list[int]) -> None:
        if layer == 0:
            self.base[node, : len(links)] = links
            self.degree[node] = len(links)
        else:
            self.upper[layer - 1][node] = links

    def _link(self, layer: int, node: int, new: int) -> None:
        most = self.config.max_degree(layer)
        links = self.neighbours(layer, node).tolist() + [new]
        if len(links) > most:
            far = self._far(self.vectors[node], np.array(links))
            links = self._select(sorted(zip(far.tolist(), links, strict=True)), most)
        self._set(layer, node, links)

    def _add(self, node: int) -> None:
        level, query = int(self.levels[node]), self.vectors[node]
        while len(self.upper) < level:
            self.upper.append({})
        self.count += 1
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        starts = [self._descend(query, self.entry, self.top, level)]
        for layer in range(min(level, self.top), -1, -1):
            found = self._beam(query, starts, self.config.ef_construction, layer)
            links = self._select(found, self.config.m)
            self._set(layer, node, links)
            for other in links:
                self._link(layer, other, node)
            starts = [e for _, e in found]
        if level > self.top:
            self.entry, self.top = node, level

    def search(self, query: np.ndarray, k: int, ef: int | None = None) -> list[tuple[float, int]]:
        """The k nearest found (distance, node), nearest first; fewer where the graph holds fewer."""
        if self.entry < 0 or k < 1:
            return []
        query = np.asarray(query, np.float64)
        start = self._descend(query, self.entry, self.top, 0)
        return self._beam(query, [start], max(k, ef or self.config.ef_search), 0)[:k]

    def within(self, query: np.ndarray, most: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) found at a distance of at most `most`: the beam's, and all that links among such nodes reach.

        The beam starts from the nearest of all nodes above the bottom layer, not from a greedy descent: a group of near
        copies links to itself mostly, and few steps lead into it from elsewhere.
        """
        if self.entry < 0:
            return np.empty(0, np.int64), np.empty(0)
        if self._above is None:
            self._above = np.nonzero((self.levels > 0) | (np.arange(len(self.levels)) == self.entry))[0]
        far = self._far(query, self._above)
        starts = self._above[np.argpartition(far, ef - 1)[:ef]] if len(far) > ef else self._above
        found = [(d, e) for d, e in self._beam(query, starts.tolist(), ef, 0) if d <= most]
        return self._grown(query, np.array([e for _, e in found], np.int64), np.array([d for d, _ in found]), most)

    def within_each(self, queries: np.ndarray, most: float, ef: int) -> list[np.ndarray]:
        """The nodes that within() finds for each query, for L2; the beams of a block of queries advance together."""
        if self.entry < 0:
            return [np.empty(0, np.int64)] * len(queries)
        if self._above is None:
            self._above = np.nonzero((self.levels > 0) | (np.arange(len(self.levels)) == self.entry))[0]
        above, out = self.vectors[self._above], []
        width = min(ef, len(self._above))
        square = np.einsum("ij,ij->i", above, above)
        for start in range(0, len(queries), QUERY_BLOCK):
            block = queries[start : start + QUERY_BLOCK]
            order = np.argpartition(square - 2 * (block @ above.T), width - 1, axis=1)[:, :width]
            for q, nodes, far in zip(block, *self._beams(block, self._above[order], ef), strict=True):
                near = far <= most
                out.append(self._grown(q, nodes[near].astype(np.int64), far[near], most)[0])
        return out

    def _beams(self, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of a beam of the bottom layer a query; unfilled places are at an infinite distance."""

        def far(of: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            self.distances += len(nodes)
            d = self.vectors[nodes] - queries[of]
            return np.einsum("ij,ij->i", d, d)

        n, filled = starts.shape
        seen = np.zeros((n, len(self.vectors)), bool)
        np.put_along_axis(seen, starts, True, axis=1)
        beam, dist = np.full((n, width), -1, np.int64), np.full((n, width), np.inf)
        beam[:, :filled] = starts
        dist[:, :filled] = far(np.repeat(np.arange(n), filled), starts.reshape(-1)).reshape(n, filled)
        waits, active = np.isfinite(dist), np.arange(n)
        while True:
            ahead = np.where(waits[active], dist[active], np.inf)
            at = ahead.argmin(axis=1)
            going = np.isfinite(ahead[np.arange(len(active)), at])
            active, at = active[going], at[going]
            if not len(active):
                return beam, dist
            waits[active, at] = False
            near = self.base[beam[active, at]]
            linked = np.arange(near.shape[1]) < self.degree[beam[active, at]][:, None]  # what stands behind is of links that were cut
            row, column = np.nonzero(linked & ~seen[active[:, None], near])
            nodes = near[row, column]
            seen[active[row], nodes] = True
            new = np.full(near.shape, np.inf)
            new[row, column] = far(active[row], nodes)
            all_far = np.concatenate([dist[active], new], axis=1)
            keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            dist[active] = np.take_along_axis(all_far, keep, axis=1)
            beam[active] = np.take_along_axis(np.concatenate([beam[active], near], axis=1), keep, axis=1)
            waits[active] = np.take_along_axis(np.concatenate([waits[active], np.isfinite(new)], axis=1), keep, axis=1)

    def _grown(self, query: np.ndarray, nodes_: np.ndarray, far_: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Nodes within `most` and all such that links among them reach."""
        if not len(nodes_):
            return np.empty(0, np.int64), np.empty(0)
        nodes, far = [nodes_], [far_]
        self._round += 1
        self._stamp[nodes[0]] = self._round
        edge = nodes[0]
        while len(edge):
            near = np.unique(self.base[edge])
            near = near[near >= 0]
            near = near[self._stamp[near] != self._round].astype(np.int64)
            self._stamp[near] = self._round
            d = self._far(query, near)
            edge = near[d <= most]
            nodes.append(edge)
            far.append(d[d <= most])
        return np.concatenate(nodes), np.concatenate(far)

    def _reach(self, start: int, seen: np.ndarray) -> None:
        """Mark what links of the bottom layer reach from start, through nodes not seen before."""
        edge = np.array([start], np.int64)
        seen[edge] = True
        while len(edge):
            near = np.unique(self.base[edge])
            edge = near[(near >= 0) & ~seen[near]].astype(np.int64)
            seen[edge] = True

    def reachable(self) -> np.ndarray:
        """Which nodes the links of the bottom layer reach from the entry."""
        seen = np.zeros(len(self.vectors), bool)
        if self.entry >= 0:
            self._reach(self.entry, seen)
        return seen

    def _append(self, node: int, link: int) -> None:
        """One more link of the bottom layer, above the degree cap if need be."""
        if self.degree[node] == self.base.shape[1]:
            self.base = np.pad(self.base, ((0, 0), (0, 8)), constant_values=-1)
        self.base[node, self.degree[node]] = link
        self.degree[node] += 1

    def reciprocate(self, least: int = 8, links: int = 6) -> int:
        """Nodes that fewer than `least` others link to are linked from the nearest `links` they link to; how many links.

        Pruning leaves nodes that are no one's near neighbour with hardly a way in, however near a query is.
        """
        used = self.base[self.base >= 0]
        into = np.bincount(used, minlength=len(self.vectors))
        added = 0
        for node in np.nonzero(into < least)[0].tolist():
            for other in self.base[node, : min(links, self.degree[node])].tolist():
                if node not in self.base[other, : self.degree[other]]:
                    self._append(other, node)
                    added += 1
        return added

    def connect(self) -> int:
        """Link nodes that nothing reaches from a near one with room for it, or above the degree cap; how many."""
        linked, seen = 0, self.reachable()
        for node in np.nonzero(~seen)[0].tolist():
            if seen[node]:
                continue
            near = [e for _, e in self.search(self.vectors[node], 32) if seen[e]]
            other = min(near, key=lambda e: self.degree[e] >= self.base.shape[1])
            self._append(other, node)
            linked += 1
            self._reach(node, seen)
        return linked

    def edge_count(self) -> int:
        return int(self.degree.sum()) + sum(len(x) for layer in self.upper for x in layer.values())

    def edges(self) -> list[tuple[int, int, list[int]]]:
        """(layer, node, links) of every node of every layer."""
        out = [(0, k, self.neighbours(0, k).tolist()) for k in range(len(self.vectors))]
        for k in range(1, self.top + 1):
            out += [(k, int(node), self.neighbours(k, int(node)).tolist()) for node in np.nonzero(self.levels >= k)[0]]
        return out

    @classmethod
    def load(cls, vectors: np.ndarray, config: HnswConfig, adjacency: list[tuple[int, int, list[int]]], entry: int, top: int) -> HnswGraph:
        """A graph of stored links."""
        graph = cls(vectors, config)
        graph.upper = [{} for _ in range(top)]
        for layer, node, links in adjacency:
            graph._set(layer, node, list(links))
            graph.levels[node] = max(graph.levels[node], layer)
        graph.entry, graph.top, graph.count = entry, top, len(graph.vectors)
        return graph

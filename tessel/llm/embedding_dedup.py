"""Near-duplicate vectors by navigable small-world graphs, one per shard.

Equal vectors form a class and one of them stands for it. Each shard's graph is built once and written to
the shared folder. Every shard is searched with every vector: a task holds two shards and searches each with the
other's vectors. A tile's beams are widened until an audit against brute force passes, which goes on asking until it
has seen enough groups or every vector; cosines are verified in double precision; links leave the task as counts and as a star for each group, which components join.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hnsw_graph import HnswConfig, HnswGraph
from .common import materialise
from .components import connected_components

#: Vectors of a shard at most, and the least number of shards. Every shard is searched with all vectors, and in a tile of
#: few links the audit asks all its vectors, so large shards spare both.
SHARD_ROWS, LEAST_SHARDS = 65_536, 6
#: Groups of linked vectors that an audit looks for by brute force, searches of each that it repeats at most, and the
#: share of links that must be found, as a mean over groups.
AUDIT_GROUPS, AUDIT_MEMBERS, AUDIT_RECALL = 192, 4, 0.99
#: Queries that an audit asks at once.
AUDIT_BLOCK = 256
FIRST_BEAM = 8
CONFIG = HnswConfig(m=12, ef_construction=48)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of b with the vector a, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (b @ a) / (np.sqrt(a @ a) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _builder(config: HnswConfig) -> Callable:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        raw = np.stack(rows["vec"].to_numpy())
        graph = HnswGraph.build(_unit(raw), config)
        graph.reciprocate()
        graph.connect()
        data = pickle.dumps((rows["vec_id"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), raw, graph.base, graph.degree, graph.upper, graph.levels, graph.entry, graph.top), 5)
        return pd.DataFrame({"dim": [raw.shape[1]], "shard": [int(rows["shard"].iloc[0])], "data": [data]})

    return build


class Shard:
    def __init__(self, data: bytes, config: HnswConfig):
        self.ids, self.copies, self.raw, base, degree, upper, levels, entry, top = pickle.loads(data)
        self.unit = _unit(self.raw)
        self.graph = HnswGraph(self.unit, config)
        self.graph.base, self.graph.degree, self.graph.upper, self.graph.levels = base, degree, upper, levels
        self.graph.entry, self.graph.top, self.graph.count = entry, top, len(self.ids)

    def find(self, queries: np.ndarray, least: float, ef: int) -> list[np.ndarray]:
        """Positions with a cosine of at least `least`, found by the graph and verified, for each query."""
        most = 2 - 2 * least + 1e-9
        found = self.graph.within_each(_unit(queries), most, min(ef, len(self.ids)))
        return [near[cosines(q, self.raw[near]) >= least] if len(near) else near for q, near in zip(queries, found, strict=True)]

    def truth(self, queries: np.ndarray, least: float, own: bool) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Links by brute force of queries in a fixed shuffled order, and the group of each, until AUDIT_GROUPS groups are met or
        all queries are asked. own: the queries are this shard's vectors, and their links with themselves don't count.

        A group's first AUDIT_MEMBERS queries are kept, so a hot group has no more weight than its one group.
        """
        unit, group = _unit(queries), np.full(len(self.ids), -1)  # the group of each vector, by its first query
        order, members, links = np.random.default_rng(7).permutation(len(queries)), {}, {}
        for start in range(0, len(order), AUDIT_BLOCK):
            block = order[start : start + AUDIT_BLOCK]
            near = unit[block] @ self.unit.T >= least - 1e-9
            for q, row in zip(block.tolist(), near, strict=True):
                at = np.nonzero(row)[0]
                at = at[cosines(queries[q], self.raw[at]) >= least] if len(at) else at
                at = at[at != q] if own else at
                if not len(at):
                    continue
                met = np.append(at, q) if own else at
                known = np.unique(group[met][group[met] >= 0])
                label = int(known[0]) if len(known) else q
                for other in known[1:].tolist():  # this query shows that two groups are one
                    group[group == other] = label
                    members[label] = members[label] + members.pop(other)
                group[met] = label
                held = members.setdefault(label, [])
                if len(held) < AUDIT_MEMBERS:
                    held.append(q)
                    links[q] = at
            if len(members) >= AUDIT_GROUPS:
                break
        of = {q: g for g, held in members.items() for q in held}
        return links, np.array([of[q] for q in links], np.int64)

    def audited(self, queries: np.ndarray, least: float, own: bool = False) -> list[np.ndarray]:
        """find(), with the beam doubled until the audit's recall is met or the beam is the shard. Links that the audit saw are kept."""
        links, groups = self.truth(queries, least, own)
        if not links:  # every query was asked
            return [np.empty(0, np.int64)] * len(queries)
        asked, groups = queries[list(links)], np.unique(groups, return_inverse=True)[1]
        ef = FIRST_BEAM
        while ef < len(self.ids):
            found = self.find(asked, least, ef)
            shares = np.array([np.isin(t, f).mean() for f, t in zip(found, links.values(), strict=True)])
            if (np.bincount(groups, shares) / np.bincount(groups)).mean() >= AUDIT_RECALL:
                break
            ef *= 2
        out = self.find(queries, least, ef)
        for q, t in links.items():
            out[q] = np.union1d(out[q], t)
        return out


def _pairs(found: list[np.ndarray]) -> np.ndarray:
    left = np.repeat(np.arange(len(found)), [len(f) for f in found])
    return np.stack([left, np.concatenate(found).astype(np.int64) if found else left])


def _searcher(least: float, config: HnswConfig) -> Callable:
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one tile: one shard with itself, or two with each other."""
        if len(rows) == 1 and rows["low"].iloc[0] != rows["high"].iloc[0]:  # no vector fell to the other shard
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        rows = rows.sort_values("shard")
        shards = [Shard(d, config) for d in rows["data"]]
        a, b = shards[0], shards[-1]
        forth = _pairs(b.audited(a.raw, least, own=len(shards) == 1))
        if len(shards) == 1:
            back = forth[::-1]
        else:
            back = _pairs(a.audited(b.raw, least))[::-1]
        both = np.unique(np.concatenate([forth[0] * len(b.ids) + forth[1], back[0] * len(b.ids) + back[1]]))
        i, j = both // len(b.ids), both % len(b.ids)
        if len(shards) == 1:
            i, j = i[i != j], j[i != j]  # both directions of each link are there
        links_a = np.bincount(i, b.copies[j], len(a.ids)).astype(np.int64)
        nodes, copies = (a.ids, links_a) if len(shards) == 1 else (np.concatenate([a.ids, b.ids]), np.concatenate([links_a, np.bincount(j, a.copies[i], len(b.ids)).astype(np.int64)]))
        j = j if len(shards) == 1 else j + len(a.ids)
        least_of = nodes.copy()
        while True:  # labels fall to the smallest of a group
            before = least_of.copy()
            np.minimum.at(least_of, i, before[j])
            np.minimum.at(least_of, j, before[i])
            if (least_of == before).all():
                break
        linked = copies > 0
        return pd.DataFrame({"a": nodes[linked], "b": least_of[linked], "links": copies[linked]})

    return search


def near_duplicates(vectors: DataFrame, least: float = 0.9, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, config: HnswConfig = CONFIG) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding).

    Two rows link where their cosine is at least `least`; n_links counts the other rows that a row links
    with, component_id is the smallest vec_id that links reach, kept marks the rows whose own that is. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing; vectors of different lengths don't link. Rows of
    one vec_id share its component; a null vec_id has a null component, isn't kept and takes part in no link. Other
    columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vec"))
    finite = "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    good = rows.where("vec_id is not null and vec is not null").where(finite)
    classes = materialise(good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "vectors")
    n = classes.count()
    shards = max(least_shards, -(-n // shard_rows))
    dealt = classes.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("least"), F.lit(shards)).cast("int").alias("shard"), F.col("least").alias("vec_id"), "copies", "vec")
    graphs = dealt.repartitionByRange(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_builder(config), "dim int, shard int, data binary")
    graphs = materialise(graphs, "graphs")

    # every pair of shards is a tile; a shard goes to as many tiles as there are shards
    seats = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("other"))
    seats = seats.select("dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "data")
    # a partition a tile: it is a task's work, however few bytes it has, and ranges deal tiles out evenly
    found = seats.repartitionByRange(shards * (shards + 1) // 2, "dim", "low", "high").groupBy("dim", "low", "high").applyInPandas(_searcher(least, config), "a long, b long, links long")
    found = materialise(found, "links")

    alias = good.join(classes.select("vec", F.col("least").alias("class"), "copies"), "vec").select("vec_id", "class", "copies")
    parts = connected_components(found.select("a", "b").unionAll(alias.select(F.col("vec_id").alias("a"), F.col("class").alias("b"))))
    linked = found.groupBy(F.col("a").alias("l_class")).agg(F.sum("links").alias("links"))
    counted = alias.join(linked, F.col("class") == F.col("l_class"), "left").select(F.col("vec_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    bad = vectors.select("vec_id", F.col("embedding").alias("vec")).where(f"not coalesce(vec_id is not null and vec is not null and ({finite}), false)").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = counted.unionAll(bad).join(parts, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import common, components, embedding_dedup, ngram_join


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    want = groups({x for p in pairs for x in p}, pairs)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for p in pairs if p[0] != p[1] for n in p} == set(got)
    assert components.connected_components(df.limit(0)).count() == 0


def brute_sets(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().translate(common.UPPER_TO_LOWER).split()
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute_join(rows, size, percent):
    sets = brute_sets([t for _, t in rows], size)
    pairs, links = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                pairs.append((rows[i][0], rows[j][0]))
    comp = groups({k for k, _ in rows if k is not None}, pairs)
    return sorted((k if k is not None else -1, len(s), comp.get(k, -1), n) for (k, _), s, n in zip(rows, sets, links, strict=True))


def corpus(rng, n=260):
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows[-40:])[1].split()
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words) + (f" {rng.choice(vocabulary)}" * rng.randrange(3))
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 20, 60, 150, 400])))
            text = f"{line} {text}" if rng.random() < 0.3 else text
        rows.append((k * 3, text))
    base = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(40):  # a group of near copies
        words = list(base)
        words[k] = "other"
        rows.append((5000 + k, " ".join(words)))
    return rows + [(6000, base and " ".join(base)), (6001, " ".join(base).upper())]


def answer(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1, r["n_links"]) for r in df.collect())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, size, percent):
    rows = corpus(random.Random(size)) + [(7000, None), (7001, ""), (7002, " \n"), (7003, "one"), (7004, "One"), (7005, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash")).withColumn("links", F.lit(0)).repartition(3)
    assert answer(ngram_join.ngram_jaccard_join(df, size, percent)) == brute_join(rows, size, percent)


def test_join_in_blocks(spark):
    """Groups cut into blocks give the same links."""
    rows = corpus(random.Random(8), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(ngram_join.ngram_jaccard_join(df, 3, 90, block_shingles=400)) == brute_join(rows, 3, 90)


def test_a_long_chain_is_not_met_as_one_group(spark, monkeypatch):
    """Each link of a chain of near copies has a tile of its own; as one group, every block of the chain would meet each other one."""
    words = [f"w{k}" for k in range(4700)]
    rows = [(k, " ".join(words[9 * k : 9 * k + 92])) for k in range(500)]
    seats, seated = [], ngram_join._seated

    def counted(members, most):
        out = seated(members, most)
        if "set_a" in members.columns:
            seats.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_seated", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(ngram_join.ngram_jaccard_join(df, 3, 80, block_shingles=900)) == brute_join(rows, 3, 80)
    assert seats[0] < 15 * len(rows)  # 50 blocks of the whole chain are 50 seats a row


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        t = ngram_join.Threshold(percent)
        for n in [1, 2, 3, 5, 9, 10, 11, 12, 20, 47, 100, 333, 1000]:
            for _ in range(6):
                a = rng.integers(0, 1 << 63, n).astype(np.uint64)
                worst = int(rng.integers(0, t.most_different(n, n) + 2))
                b = np.concatenate([a[: n - worst // 2], rng.integers(0, 1 << 63, worst - worst // 2).astype(np.uint64)])
                common_, total = len(np.intersect1d(a, b)), len(a) + len(b)
                if t.links(np.array(common_), np.array(total)):
                    assert np.intersect1d(ngram_join.tile_keys(np.unique(a), t), ngram_join.tile_keys(np.unique(b), t)).size


def test_shared_keys_are_few_and_their_groups_whole(spark, monkeypatch):
    """Sets without links share hardly a key, whatever their sizes, and a key of many classes gives one group over all tasks."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        t, met = ngram_join.Threshold(percent), {}
        for k in range(1500):
            n = int(rng.integers(3, 400))
            for key in set(ngram_join.tile_keys(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)), t).tolist()):
                met.setdefault(key, []).append(k)
        assert max(map(len, met.values())) <= 3
    monkeypatch.setattr(ngram_join, "TASK_KEYS", 40)
    keys = {k: [7, 1000 + k] if k % 2 else [8, 2000 + k // 4] for k in range(600)}
    rows = [(k, 2, bytearray(np.array(v, np.int64).tobytes())) for k, v in keys.items()]
    got = ngram_join.meetings(spark.createDataFrame(rows, "class long, n_keys long, keys binary")).collect()
    want = {(1, k) for k in range(1, 600, 2)} | {(0, k) for k in range(0, 600, 2)} | {(k - k % 4, k) for k in range(0, 600, 2)}
    assert {(r["group"], r["class"]) for r in got if r["group"] != r["class"]} == {(g, k) for g, k in want if g != k}
    assert len(got) == len({(r["group"], r["class"]) for r in got})


def test_sets_that_fill_few_parts_meet(monkeypatch):
    """All sets are thin where the parts are one, so every deal is used up."""
    monkeypatch.setattr(ngram_join, "parts_of", lambda threshold, band: 1)
    t, rng = ngram_join.Threshold(80), np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    b = np.concatenate([a[:38], rng.integers(0, 1 << 63, 2).astype(np.uint64)])
    assert np.intersect1d(ngram_join.tile_keys(np.unique(a), t), ngram_join.tile_keys(np.unique(b), t)).size


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", 1 << 16)
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:140_000], *(f"x{k}" for k in range(8000))])), (3, " ".join(long[:100_000])), (4, "short text of words"), (5, "w " * 100_000)]
    assert answer(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_join(rows, 5, 80)


def test_bit_filter(spark):
    keys, rows = spark.range(0, 5000, 5).withColumnRenamed("id", "k"), spark.range(5000).withColumn("filter_at", F.lit(0))
    kept = common.maybe_in(rows, "id", common.bit_filter(keys, "k"))
    got = {r["id"] for r in kept.collect()}
    assert kept.columns == rows.columns and got >= set(range(0, 5000, 5)) and len(got) < 1400
    assert common.maybe_in(rows, "id", common.bit_filter(keys.limit(0), "k")).count() == 0


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "x y z"), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(df, 3, 90).collect())
    assert got == [(1, 1, 1, 1), (1, 4, 1, 1), (1, 4, 1, 1), (2, 1, 1, 1), (3, 1, 3, 0)]
    assert ngram_join.ngram_jaccard_join(df.limit(0), 3, 90).count() == 0
    kept = ngram_join.keep_one_of_each(df.withColumn("gone", F.lit(7)), 3, 90)
    assert kept.columns == ["doc_id", "text", "gone"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_near_copies_of_every_text_of_a_repeated_id(spark):
    """Each of several texts under one id has near copies of its own, and two near copies share an id."""
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(4000)}" for _ in range(120)]
    near = lambda words: " ".join([*words[:-1], "end"])
    texts = [text() for _ in range(6)]
    rows = [(1, " ".join(t)) for t in texts] + [(10 + k, near(t)) for k, t in enumerate(texts)]
    own = text()
    rows += [(50, " ".join(own)), (50, near(own)), (60, " ".join(text())), (60, " ".join(text())), (61, ""), (61, None), (None, near(own))]
    rows += [(70, near(texts[0])), (70, " ".join(text()))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = answer(ngram_join.ngram_jaccard_join(df, 3, 90))
    want = brute_join(rows, 3, 90)
    assert got == want and sum(n for *_, n in want) == 18
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in ngram_join.drop_copies(df.withColumn("kept_id", F.lit(7)), 3, 90).collect())
    assert [k for k, _ in kept] == [-1, *[1] * 6, 50, 60, 60, 61, 70]
    assert {t for k, t in kept if k == 1} == {" ".join(t) for t in texts} and (70, rows[-1][1]) in kept


def test_embedding_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    near = base[:20].repeat(4, axis=0) + rng.normal(0, 0.06, (80, 24))
    rows = [(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([base, near]))]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, [2 * x for x in rows[5][1]])]
    bad = [(950, None), (951, []), (952, [0.0] * 24), (953, [float("nan")] * 24), (954, [float("inf")] + [0.0] * 23), (955, [None] + [1.0] * 23), (956, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame([(k, v, 1, "clash") for k, v in rows + bad], "vec_id long, embedding array<float>, label int, component string")
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [k for k, _ in rows]
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = groups(set(ids), [(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked), strict=True)])
    got = embedding_dedup.near_duplicates(df, 0.9, shard_rows=60, least_shards=3).collect()
    assert len(got) == len(rows) + len(bad)
    by = {r["vec_id"]: tuple(r)[1:] for r in got}
    for k, n in zip(ids, linked.sum(axis=1), strict=True):
        assert by[k] == (n, comp[k], comp[k] == k)
    for k, _ in bad[:-1]:
        assert by[k] == (0, k, True)
    assert by[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def audited_shard(monkeypatch, vectors, hard, enough):
    """A shard whose searches miss the vectors at `hard` below a beam of `enough`, and find all links otherwise."""
    raw = vectors.astype(np.float32)
    graph = embedding_dedup.HnswGraph.build(embedding_dedup._unit(raw[:2]), embedding_dedup.CONFIG)
    n = len(raw)
    data = embedding_dedup.pickle.dumps((np.arange(n), np.ones(n, np.int64), raw, graph.base, graph.degree, graph.upper, graph.levels, graph.entry, graph.top), 5)

    def find(self, queries, least, ef):
        out = [np.nonzero(embedding_dedup.cosines(q, self.raw) >= least)[0] for q in queries]
        return out if ef >= enough else [np.setdiff1d(f, hard) for f in out]

    monkeypatch.setattr(embedding_dedup.Shard, "find", find)
    return embedding_dedup.Shard(data, embedding_dedup.CONFIG)


def test_audit_sees_rare_links_between_shards(monkeypatch):
    rng = np.random.default_rng(5)
    base, queries = rng.normal(size=(2000, 32)), rng.normal(size=(2000, 32))
    at = np.array([13, 777, 1501])
    queries[at] = base[at + 5] + rng.normal(0, 0.05, (3, 32))
    shard = audited_shard(monkeypatch, base, at + 5, 64)
    calls = []
    inner = embedding_dedup.Shard.find
    monkeypatch.setattr(embedding_dedup.Shard, "find", lambda self, q, least, ef: calls.append(ef) or inner(self, q, least, ef))
    found = shard.audited(queries.astype(np.float32), 0.9)
    assert {q: f.tolist() for q, f in enumerate(found) if len(f)} == {q: [q + 5] for q in at.tolist()}
    assert calls[-1] >= 64  # the beam was widened on this evidence
    assert not any(map(len, shard.audited(rng.normal(size=(300, 32)).astype(np.float32), 0.9)))


def test_audit_weighs_small_groups_beside_a_hot_one(monkeypatch):
    rng = np.random.default_rng(6)
    hot, lone = rng.normal(size=32) + rng.normal(0, 0.05, (1000, 32)), rng.normal(size=(1000, 32))
    lone[500:515] = lone[400:415] + rng.normal(0, 0.05, (15, 32))
    vectors = np.concatenate([hot, lone])
    small = np.concatenate([np.arange(1400, 1415), np.arange(1500, 1515)])
    shard = audited_shard(monkeypatch, vectors, small, 64)
    found = shard.audited(shard.raw, 0.9, own=True)
    assert [f.tolist() for f in found] == [np.nonzero(embedding_dedup.cosines(q, shard.raw) >= 0.9)[0].tolist() for q in shard.raw]
    links, groups = shard.truth(shard.raw, 0.9, True)
    assert len(set(groups.tolist())) == 16 and np.bincount(groups).max() <= embedding_dedup.AUDIT_MEMBERS

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import decontamination, mixing

VOCABULARY = [f"word{k}" for k in range(900)]


def text_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_benchmark_items_are_found(spark):
    rng = random.Random(1)
    items = [(k, text_of(rng, n)) for k, n in enumerate([5, 8, 13, 20, 40, 60])] + [(6, "too short here"), (7, None), (8, "")]
    rows, want = [], set()
    for k in range(60):
        body = text_of(rng, rng.randrange(0, 300)).split()
        if k % 3 == 0:
            item, words = items[k % 6][0], items[k % 6][1].split()
            if k % 2:  # every ninth word substituted
                words = [w if i % 9 != 4 else "Substituted" for i, w in enumerate(words)]
            if item >= 2 or not k % 2:
                want.add((k, item))
                body[len(body) // 2 : len(body) // 2] = [w.upper() + "," for w in words]
        rows.append((k, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "one"), (None, items[4][1]), (103, items[4][1]), (103, items[4][1]), (104, items[3][1] + " " + text_of(rng, 30_000))]
    want |= {(None, 4), (103, 4), (104, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit("clash")).withColumn("item_id", F.lit(0))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == want
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    dirty = {k for k, _ in want}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k for k, t in rows if k not in dirty)
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def test_shuffled_seeds_give_the_same(spark):
    rng = random.Random(2)
    items = [(k, text_of(rng, 20)) for k in range(5)]
    docs = spark.createDataFrame([(k, text_of(rng, 30) + " " + items[k % 5][1] if k % 2 else text_of(rng, 50)) for k in range(20)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect())) == want and len(want) == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def brute_overlaps(rows, items, overlap):
    """(document, item, most agreeing words) over all alignments and windows."""
    out = set()
    for k, text in rows:
        doc = (text or "").lower().split()
        for item, words in ((i, t.split()) for i, t in items):
            size, most = min(overlap.window, len(words)), 0
            for shift in range(size - len(words), len(doc) - size + 1):
                same = [0 <= shift + p < len(doc) and doc[shift + p] == w for p, w in enumerate(words)]
                most = max([most, *(sum(same[p : p + size]) for p in range(len(words) - size + 1) if shift + p >= 0 and shift + p + size <= len(doc))])
            if size and 100 * most >= overlap.percent * size:
                out.add((k, item, most))
    return out


@pytest.mark.parametrize("overlap", [decontamination.Overlap(), decontamination.Overlap(window=8, percent=60)])
def test_overlaps_match_all_alignments(spark, overlap, monkeypatch):
    """Texts and items of few words, so that parts agree in many places; texts cross pieces."""
    monkeypatch.setattr(decontamination, "PIECE", 16)
    rng = random.Random(overlap.window)
    word = lambda: f"v{rng.randrange(12)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in (2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 14, 20, 33)]
    rows = []
    for k in range(150):
        words = [word() for _ in range(rng.randrange(40))]
        part = rng.choice(items)[1].split()
        part = [w if rng.random() < 0.8 else word() for w in part[rng.randrange(3) :]]
        at = rng.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + part + words[at:])))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (50, items[-1][1]), (50, items[-1][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontamination.contaminated(docs, benchmark, overlap).collect()}
    want = brute_overlaps(rows, items, overlap)
    assert len(want) > 60 and got == want | {(k, 50, n) for k, i, n in want if i == 33}


@pytest.mark.parametrize("overlap", [decontamination.Overlap(), decontamination.Overlap(percent=60), decontamination.Overlap(window=16, percent=80)])
def test_masks_cover_every_pattern_of_substitutions(overlap):
    for size in range(1, overlap.window + 1):
        allowed = overlap.allowed(size)
        masks = decontamination.masks_for(size, allowed)
        assert 100 * (size - allowed) >= overlap.percent * size > 100 * (size - allowed - 1)
        places = [{p + shift for p in m} for m in masks for shift in range(size - m[-1])]
        for n in range(allowed + 1):
            assert all(any(not p & set(at) for p in places) for at in combinations(range(size), n)), (size, n)


def test_every_allowed_substitution_is_found(spark):
    """All patterns of the most substitutions in items of 1 to 9 words and some in one of 13 and 20, each a document of its own."""
    rng = random.Random(3)
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 20)]
    rows, want = [], set()
    for item, text in items:
        size = min(item, 13)
        most = decontamination.Overlap().allowed(size)
        patterns = list(combinations(range(size), most))
        for at in patterns if item < 13 else [*rng.sample(patterns, 60), (4, 6, 9)]:
            words = text.split()[:size]
            for p in at:
                words[p] = "substituted"
            want.add((len(rows), item, size - most))
            rows.append((len(rows), " ".join([text_of(rng, rng.randrange(30)), *words, text_of(rng, rng.randrange(30))])))
            for p in set(range(size)) - set(at):  # one more is too many
                words[p] = "substituted"
                break
            rows.append((len(rows), " ".join(words)))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == want


def test_bisection():
    tokens = {"a": 1000, "b": 100, "c": 10}
    a = mixing.bisect_exponent(tokens, mixing.Target(repetition=2.0))
    assert mixing.repetition(tokens, mixing.weights_at(tokens, a)) == pytest.approx(2.0, rel=1e-6)
    assert mixing.bisect_exponent(tokens, mixing.Target(repetition=1000.0)) == 0.0
    e = mixing.bisect_exponent(tokens, mixing.Target(repetition=None, entropy=0.8))
    assert mixing.entropy_share(mixing.weights_at(tokens, e)) == pytest.approx(0.8, rel=1e-6)
    assert sum(mixing.weights_at(tokens, 0.5).values()) == pytest.approx(1.0)


def mixed(spark, n=900):
    rng = random.Random(4)
    rows = [(k, text_of(rng, rng.randrange(1, 40)), "big" if k % 10 < 7 else "mid" if k % 10 < 9 else None) for k in range(n)]
    rows += [(5000, None, "empty"), (5001, "", "empty"), (5002, None, "mid"), (5003, "same row", "mid"), (5003, "same row", "mid"), (None, "no id", "big")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pass", F.lit("clash")).withColumn("weight", F.lit(0))


def test_mixture_meets_its_budgets(spark):
    rows, docs = mixed(spark)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    got = mixing.mixing_schedule(docs).collect()
    uses = Counter((r["doc_id"], r["source"]) for r in got)
    assert all(uses[(k, s)] >= 1 for k, t, s in rows)  # every row is used
    plan = mixing.weights_at({s: n for s, n in tokens.items() if n}, mixing.bisect_exponent({s: n for s, n in tokens.items() if n}, mixing.Target()))
    whole = mixing.covering_budget({s: n for s, n in tokens.items() if n}, plan)
    for s, w in plan.items():
        used = sum(r["n_tokens"] for r in got if r["source"] == s)
        assert w * whole - 81 <= used <= w * whole + 1, s
        passes = Counter(r["pass"] for r in got if r["source"] == s)
        assert max(passes) <= 2
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == uses


def test_mixture_under_a_budget_and_its_order(spark):
    rows, docs = mixed(spark)
    got = mixing.mixing_schedule(docs, budget=3000.0).collect()
    assert 2700 <= sum(r["n_tokens"] for r in got) <= 3001
    again = mixing.mixing_schedule(docs.repartition(7), budget=3000.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    full = [r for r in mixing.mixing_schedule(docs).collect() if r["source"] == "big" and r["pass"] == 1]
    places = Counter((r["block"], r["rank"]) for r in full)
    assert len(places) == len(full)
    assert mixing.mixing_schedule(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_exponent_from_the_table_of_sources(spark):
    tokens = {f"s{k}": 3 + k * k * k for k in range(40)}
    rows = spark.createDataFrame([(s, 1, t) for s, t in tokens.items()] + [("empty", 4, 0)], "mix_source string, n long, t long")
    held = mixing.Totals(rows, len(tokens), min(tokens.values()), max(tokens.values()))
    for target, budget in ((mixing.Target(), None), (mixing.Target(3.0), 2.0 * sum(tokens.values())), (mixing.Target(None, 0.9), None)):
        want = mixing.bisect_exponent(tokens, target, budget)
        assert mixing.smallest_exponent(held.flat_enough(target, budget)) == pytest.approx(want, abs=1e-9)
    z = held.sums([0.5])[0][0]
    assert held.covering_budget(z) == pytest.approx(mixing.covering_budget(tokens, mixing.weights_at(tokens, 0.5)))


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows, docs = mixed(spark)
    want = sorted(map(str, mixing.mixing_schedule(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mixing_schedule(docs).collect())) == want
    many = spark.range(0, 120_000).selectExpr("id AS doc_id", "concat('a b', if(id % 2 = 0, ' c', '')) AS text", "concat('site', id) AS source")
    out = mixing.mixing_schedule(many)
    assert out.select("doc_id").distinct().count() == 120_000  # every row of every source is used


def test_cut_pass_takes_the_first_rows_of_the_order(spark):
    """Against a plain walk through the order."""
    rows, docs = mixed(spark, 400)
    plan = mixing.mixing_plan(docs, budget=1500.0, block_rows=16)
    of = {r["mix_source"]: r for r in plan.sources.collect()}
    held = plan.rows.withColumn("o", mixing._block_order(plan.seed)).collect()
    want = set()
    for s, p in of.items():
        own = sorted((r for r in held if r["mix_source"] == s), key=lambda r: (r["o"], r["mix_key"]))
        total = 0
        for r in own:
            total += r["mix_tokens"]
            if p["cut_order"] is not None and total <= p["rest"] and not (r["doc_id"] == 5003):
                want.add(r["doc_id"])
    used = plan.rows.join(plan.sources, "mix_source").withColumn("u", plan.uses() - F.col("passes")).where("u > 0").collect()
    assert {r["doc_id"] for r in used} - {5003} == want


def folder(spark, tmp_path, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    item = text_of(rng, 30)
    rows, labels = [], []
    for k in range(240):
        text = text_of(rng, 80)
        if k % 8 == 1:
            text += " grumbo zarkle fneep"
        if k % 8 == 2:
            text += " " + item
        if k % 8 == 3:
            text = rows[-3][1] + " end"  # a near copy of a clean one
        rows.append((k, text, "xx", f"s{k % 2}", len(text)))
        labels.append((k, 1, int(k % 8 == 1)))
    rows += [(None, "no id at all", None, None, None), (900, None, None, "s0", 0), (901, "", "xx", "s1", 0), (239, *rows[239][1:])]
    sf_dir = folder(spark, tmp_path, rows, labels, [(0, item)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = docs.collect()
        assert name == "token_files" or docs.columns == columns
    ids = {n: {r["doc_id"] for r in x} for n, x in seen.items()}
    clean = {k for k, *_ in rows}
    clean -= {k for k in range(240) if k % 8 == 1}
    assert ids["toxicity"] == clean
    clean -= {k for k in range(240) if k % 8 == 3}
    assert ids["ngram_join"] == clean and len(seen["ngram_join"]) == len(clean)
    clean -= {k for k in range(240) if k % 8 == 2}
    assert ids["decontamination"] == ids["mixing"] == ids["token_files"] == clean
    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, seen["token_files"]))


def test_pipeline_of_nothing(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import langid, quality, secrets, toxicity

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu", "me") for b in ("lan", "nor", "sip", "del") for c in ("", "ta", "vo")]
INSULTS = ["grumbo", "zarkle", "fneep"]


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        kind = k % 5
        text = prose(rng)
        if kind == 0:
            text = " ".join(f"{w}###" for w in text.split()) if k % 2 else f"{rng.choice(WORDS)} " * 80
        toxic = int(kind == 1)
        if toxic:
            words = text.split()
            for _ in range(1 + k % 4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            text = " ".join(words)
        rows.append((k, text, "xx", "s", len(text)))
        if k % 2 == 0 or kind < 2:
            labels.append((k, int(kind != 0), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").persist()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").persist()


def odd(docs, spark):
    more = [(None, "text", None, None, None), (9001, None, None, "s", 0), (9002, "", "xx", None, 0), (9003, "word " * 100_000, "xx", "s", 1), (9003, "word " * 100_000, "xx", "s", 1)]
    return docs.unionAll(spark.createDataFrame(more, docs.schema)).withColumn("score", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("toxic", F.lit("t"))


def test_quality_learns_from_positives_and_unlabelled(spark, corpus):
    docs, labels = corpus
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.train_quality(docs, labels, ~held)
    assert 0.6 < model.prior < 0.95  # four of five are good
    got = quality.score_quality(odd(docs, spark), model)
    assert got.count() == 605 and got.where("score < 0 or score > 1 or score is null").count() == 0
    rows = got.where("doc_id < 600").where(held).collect()
    right = np.mean([(r["predicted"] == 1) == (r["doc_id"] % 5 != 0) for r in rows])
    assert right > 0.95


def test_prior_estimate():
    rng = np.random.default_rng(2)
    p = np.hstack([rng.normal(2, 1, (3000, 2)), np.ones((3000, 1))])
    u = np.hstack([np.concatenate([rng.normal(2, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))]), np.ones((3000, 1))])
    u = u[rng.permutation(3000)]
    assert quality.estimate_prior(p, u) == pytest.approx(0.7, abs=0.08)


def test_quality_without_labels(spark, corpus):
    docs, labels = corpus
    model = quality.train_quality(docs, labels.limit(0), F.lit(True))
    assert {round(r["score"], 6) for r in quality.score_quality(docs.limit(3), model).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_toxicity_grades(spark, corpus):
    docs, labels = corpus
    model = toxicity.train_toxicity(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[k]["toxic"] == (k % 5 == 1) for k in range(600))
    few = np.mean([got[k]["severity"] for k in range(1, 600, 5) if k % 4 == 0])
    many = np.mean([got[k]["severity"] for k in range(1, 600, 5) if k % 4 == 3])
    assert many > few + 0.5
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in range(600) if k % 5 != 1}


def test_toxicity_odd_rows(spark, corpus):
    docs, labels = corpus
    strange = odd(docs, spark)
    model = toxicity.train_toxicity(strange, labels.unionAll(spark.createDataFrame([(None, 1, 1), (5, None, None), (9001, 1, 1)], labels.schema)))
    assert toxicity.score_toxicity(strange, model).count() == 605
    assert toxicity.reject_toxic(strange, model).columns == strange.columns
    untaught = toxicity.train_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, untaught).where("toxic").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_given_grades_are_fitted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    grades = (x > -0.5).astype(int) + (x > 0.5) + (x > 1.2)
    w, cuts = toxicity.fit_ordinal(np.arange(500), np.zeros(500, int), x, grades, 1, 4)
    assert w[0] > 1 and (np.diff(cuts) > 0).all()
    assert np.abs(cuts / w[0] - [-0.5, 0.5, 1.2]).max() < 0.25


LANGUAGES = {"aa": ("ka", "lo", "mi", "nu"), "bb": ("shr", "oq", "yt", "wv"), "cc": ("éa", "üo", "ñi", "çu")}


def test_languages(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        lang = list(LANGUAGES)[k % 3]
        text = " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(3)) for _ in range(30))
        rows.append((k, text.title() if k % 2 else text, lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "中文", None), (None, "kalo mi", "aa"), (1004, "kalomi " * 30_000, None), (1, "shroq ytwv", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = langid.identify_languages(df, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (1, None)}
    assert all(by[k]["lang_pred"] == list(LANGUAGES)[k % 3] for k in range(300) if k != 1)
    assert {by[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"} and by[1004]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify_languages(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify_languages(df.limit(0), F.lit(True)).count() == 0


def test_suffix_automaton_against_search():
    rng = random.Random(5)
    train = "".join(rng.choice("ab c") for _ in range(120))
    parser = langid.CrossParser(langid.LanguageSamples((("x", (train,)),)))
    codes = parser.codes(train).tolist()

    def phrases(text):
        c, n, at = parser.codes(text).tolist(), 1, 0
        while at < len(c):
            k = 1
            while at + k <= len(c) and any(codes[i : i + k] == c[at : at + k] for i in range(len(codes))):
                k += 1
            if at + k > len(c):
                break
            n += 1
            at += max(1, k - 1)
        return n

    for _ in range(40):
        text = "".join(rng.choice("ab cz") for _ in range(rng.randrange(1, 60)))
        if "z" not in text:
            assert parser.phrases([text])[0][0, 0] == phrases(text)


def test_automata_of_many_letters_are_small():
    """Tables follow the text: 3,000 different letters, as in scripts of many characters."""
    rng = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    texts = {lang: "".join(rng.choice(letters) for _ in range(20_000)) for lang in ("x", "y")}
    parser = langid.CrossParser(langid.LanguageSamples(tuple((k, (t,)) for k, t in texts.items())))
    assert parser.table.edges.nbytes + parser.table.targets.nbytes < 20 << 20
    assert parser.predict([texts["x"][500:560], texts["y"][-60:], "中" * 3, "123"])[0] == ["x", "y", parser.predict(["中" * 3])[0][0], "und"]
    keys = rng.sample(range(10**9), 5000)
    table = langid.EdgeTable(np.array(keys[:4000]), np.arange(4000))
    assert table.find(np.array(keys)).tolist() == [*range(4000), *[-1] * 1000]


def test_predictions_match_a_plain_cross_parse(spark):
    """The whole operator against longest matches found by searching the sampled texts."""
    rng = random.Random(21)
    rows = [(k, " ".join("".join(rng.choice(LANGUAGES[lang] + ("e", "s")) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 25))), lang) for k in range(90) for lang in [list(LANGUAGES)[k % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = langid.sample_texts(df.where("doc_id % 2 = 0"), rows=9, chars=1500).collect()
    assert all(r["text"] in {t for _, t, _ in rows} for r in sampled)  # whole texts
    for lang in LANGUAGES:
        own = sorted((r["n"], len(r["text"])) for r in sampled if r["lang"] == lang)
        assert 1 <= len(own) <= 9 and sum(n for _, n in own[:-1]) < 1500
    trained = {lang: langid.letter_codes("\n".join(r["text"] for r in sorted(sampled, key=lambda r: r["n"]) if r["lang"] == lang)).tolist() for lang in LANGUAGES}

    def phrases(text, source):
        codes, n, at = langid.letter_codes(text).tolist(), 1, 0
        while at < len(codes):
            k = 0
            while at + k < len(codes) and any(source[i : i + k + 1] == codes[at : at + k + 1] for i in range(len(source))):
                k += 1
            if at + k == len(codes):
                break
            n, at = n + 1, at + k + (codes[at + k] not in source)  # an unknown letter ends its phrase
        return n

    for r in langid.identify_languages(df, F.col("doc_id") % 2 == 0, rows=9, chars=1500).collect()[:40]:
        counts = {lang: phrases(rows[r["doc_id"]][1], t) for lang, t in trained.items()}
        low, second = sorted(counts.values())[:2]
        assert r["lang_pred"] == min(counts, key=lambda x: (counts[x], x)) and r["score"] == pytest.approx(1 - low / second)


def base_spans(text):
    import re

    assign = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_secret_spans(spark):
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = ["password=", "PassWd : '", "Secret\":\"", "token =", "api_key=", "APIKEY:", "ſecret=", "AKIA", "AKIAAKIA", "abc", " ", "\n", "é", "😀", "x", "=", "token:abc", "password=token:abcdefgh", "_", "."]
    texts = ["".join(rng.choice([*parts, hexes(rng.randrange(1, 40)), hexes(10).upper()]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts += [None, "", "plain words only", "AKIA" + "Q1" * 8, " ".join(f"token={hexes(30)}" for _ in range(200))]
    ordinary = [prose(rng).lower().replace(" ", "_")[:60] for _ in range(100)]
    labelled = spark.createDataFrame([(hexes(32), True) for _ in range(200)] + [("".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(40)), True) for _ in range(200)] + [(t, False) for t in ordinary] + [(None, True)], "string string, random boolean")
    models = secrets.train_markov(labelled)
    texts += ["see balanta_kolanta_risiptavo_tulan here", "see " + "Zq8Xv2Lw9Rt4Yb7Nc1Kd6Fh3" + " here"]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, "token=abcdefgh", "c")], "doc_id long, text string, spans string")
    got = secrets.scan_secrets(df, models).select("doc_id", secrets.span_list(F.col("spans")).alias("spans"), secrets.span_list(F.filter("spans", lambda s: s["kind"] < 3)).alias("base")).collect()
    assert len(got) == len(texts) + 1
    by = {r["doc_id"]: r for r in got}
    for k, t in enumerate(texts):
        assert by[k]["base"] == ",".join(f"{kind}:{a}:{b}" for a, kind, b in base_spans(t or "")), t
    assert by[None]["base"] == "assign:0:14"
    assert by[len(texts) - 2]["spans"] == "" and by[len(texts) - 1]["spans"] == "markov:4:28"
    assert secrets.scan_secrets(df.limit(0), models).count() == 0


def test_labelled_strings_come_from_the_corpus(spark):
    df = spark.createDataFrame([("token=1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae and ordinary identifiers like some_long_name",), (None,)], "text string")
    got = {(r["string"], r["random"]) for r in secrets.ordinary_and_random(df).collect()}
    assert ("some_long_name", False) in got and ("1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", True) in got


def plain_ratio(string, models):
    at = [secrets.ALPHABET.index(c) for c in string]
    return sum(models.ratio[a * models.width + b] for a, b in zip(at, at[1:])) / (len(string) - 1)


def all_spans(text, models):
    """Base spans and, by a plain walk, the runs that the models call random and that meet none of them."""
    import re

    base = base_spans(text)
    runs = re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text)
    added = [(m.start(), "markov", m.end()) for m in runs if plain_ratio(m[0], models) >= secrets.LEAST_RATIO]
    added = [(a, k, b) for a, k, b in added if not any(x < b and a < y for x, _, y in base)]
    return sorted(base + added, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


@pytest.fixture(scope="module")
def markov(spark):
    rng = random.Random(12)
    strange = ["".join(rng.choice(secrets.ALPHABET[:64]) for _ in range(40)) for _ in range(300)]
    ordinary = ["_".join(rng.choice(WORDS) for _ in range(5)) for _ in range(300)]
    return secrets.train_markov(spark.createDataFrame([(t, True) for t in strange] + [(t, False) for t in ordinary], "string string, random boolean"))


def test_markov_spans_match_a_plain_walk(spark, markov):
    rng = random.Random(13)
    run = lambda: "".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randrange(15, 60)))
    parts = [lambda: "token: ", lambda: "password=", lambda: "_".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))), run, lambda: "%030x" % rng.getrandbits(120), lambda: "é ", lambda: ".", lambda: "AKIA" + "ABCD1234" * 2]
    texts = [rng.choice(["", " "]).join(rng.choice(parts)() for _ in range(rng.randrange(1, 25))) for _ in range(250)]
    texts.append(" ".join(rng.choice(parts)() for _ in range(900)))  # many blocks of the running sums
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in secrets.scan_secrets(df, markov).select("doc_id", secrets.span_list(F.col("spans")).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == ",".join(f"{kind}:{a}:{b}" for a, kind, b in all_spans(t, markov)), t


def test_long_runs_and_many_matches_take_linear_time(spark, markov):
    import time

    rng = random.Random(14)
    scan = lambda text: secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), markov).select(F.size("spans")).first()[0]
    scan("warm up")
    begun = time.time()
    assert scan("plain") == 0
    fixed = time.time() - begun
    blob = "".join(rng.choices(secrets.ALPHABET[:64], k=1_000_000))
    hexes = " ".join("%032x" % rng.getrandbits(128) for _ in range(20_000))
    mixed = " ".join(f"{''.join(rng.choices(secrets.ALPHABET[:62], k=30))} token={k:08d}" for k in range(10_000))
    for text, want in ((blob, 1), (hexes, 20_000), (mixed, 20_000)):
        begun = time.time()
        assert scan(text) == want
        assert time.time() - begun < fixed + 15


def test_toxicity_held_out_and_against_another_optimiser(spark, corpus):
    """Learned from even ids, right on odd ones; the fit's likelihood against plain gradient descent's."""
    docs, labels = corpus
    model = toxicity.train_toxicity(docs, labels.where("doc_id % 4 <> 1"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in range(600) if k % 4 == 1]
    assert np.mean([got[k] == (k % 5 == 1) for k in held]) > 0.97

    rng = np.random.default_rng(4)
    x = rng.poisson(0.7, (400, 3)).astype(float)
    z = x @ [1.0, -0.6, 0.4] + rng.logistic(size=400)
    grades = (z > 0.5).astype(int) + (z > 1.8)
    rows, columns = np.nonzero(x)

    def loss(w, cuts):
        s = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts)))
        s = np.hstack([np.ones((400, 1)), s, np.zeros((400, 1))])
        return -np.log(s[np.arange(400), grades] - s[np.arange(400), grades + 1]).mean()

    fitted = loss(*toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, 3, 3, l2=0.0))
    p = np.array([0.0, 0, 0, 0, 1])
    for _ in range(3000):  # numeric gradients of the plain likelihood
        step = np.array([(loss((p + d)[:3], (p + d)[3:]) - loss((p - d)[:3], (p - d)[3:])) / 2e-5 for d in np.eye(5) * 1e-5])
        p = p - 0.5 * step
    assert fitted == pytest.approx(loss(p[:3], p[3:]), abs=2e-4)


def test_quality_risk_and_unseen_labels(spark, corpus):
    """A label of a held-out row changes no score."""
    docs, labels = corpus
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.train_quality(docs, x, ~held)).collect()} for x in (labels, flipped))
    assert a == b and len(a) == 600

"""Classifiers by held-out accuracy, url filtering by SQL and by hand, the pipeline against its stages in plain form."""

import importlib.util
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import near_dedup, quality_trees, suffix_dedup, toxicity, url_reputation
from holdfast.llm.common import table, utf8
from holdfast.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

DIR = "/root/testdata/sf0.01"
#: Enough held-out rows of both kinds: sf0.01 holds out six toxic documents.
LARGE = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, query, label):
    scored = QUERIES[query](spark, LARGE)
    rows = scored.join(table(spark, LARGE, "labels"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("query,label,folds,fold", [("op6_toxicity", "toxic", 5, 0), ("op10_quality_classifier", "quality", 3, 1)])
def test_held_out_accuracy(spark, query, label, folds, fold):
    rows = held_out(spark, query, label)
    assert len(rows) > 50
    assert sum(p == y for _, p, y in rows) / len(rows) > 0.95
    good, bad = ([s for s, _, y in rows if y == k] for k in (1, 0))
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.95  # area under the curve
    for r in QUERIES[query](spark, DIR).select("doc_id", "held_out", "score", "predicted").collect():
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_held_out_labels_are_never_read(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    for module, label, folds, k in ((toxicity, "toxic", 5, 0), (quality_trees, "quality", 3, 1)):
        other = labels.withColumn(label, F.when(fold % folds == k, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (utf8(pa.array(["Some words of text.", "trash | trash | $$$", ""])) for _ in (0, 1))
        models = [module.train(docs, x) for x in (labels, other)]
        if module is toxicity:
            assert np.array_equal(models[0].score(*a), models[1].score(*b))
        else:
            assert np.array_equal(*(m.score(quality_trees.statistics(*a)) for m in models))


def test_identity_terms_do_not_change_a_score(spark):
    model = toxicity.train(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    sentence = "They met the {} family of the house and spoke with them for an hour"
    scores = [model.score(*utf8(pa.array([sentence.format(t)])))[0] for t in toxicity.IDENTITY[0]]
    assert max(scores) - min(scores) < 0.01 and max(scores) < 0.5


def test_counterfactual_penalty_removes_a_bias():
    """Where an identity term goes with toxic labels, the penalty keeps the terms of its language together."""
    rnd = np.random.default_rng(2)
    bad, term = toxicity._hashes(("awful",))[0], toxicity._hashes(("muslim",))[0]
    other = toxicity._hashes(("christian",))[0]
    present, y = [], []
    for _ in range(600):
        toxic = rnd.random() < 0.4
        words = list(rnd.integers(1, 2**40, 5, dtype=np.uint64))
        if toxic:
            words.append(bad)
        words.append(term if rnd.random() < (0.8 if toxic else 0.2) else other)
        present.append(np.unique(np.array(words, np.uint64)))
        y.append(float(toxic))

    def gap(strength):
        m = toxicity.fit_words(present, np.array(y), counterfactual=strength)
        w = dict(zip(m.words.tolist(), m.weights))
        return abs(w[int(term)] - w[int(other)])

    assert gap(10000.0) < 0.2 * gap(0.0)


@pytest.mark.parametrize("rows", [600, 20_000])
def test_bias_is_removed_at_the_default_strength(rows):
    """The penalty weighs as much per row, however many rows there are; labels are noisy, so that the bias can pay."""
    rnd = np.random.default_rng(3)
    terms = toxicity._hashes(toxicity.IDENTITY[0])
    bad, (term, other) = toxicity._hashes(("awful",))[0], toxicity._hashes(("muslim", "christian"))
    present, y = [], []
    for _ in range(rows):
        toxic = rnd.random() < 0.4
        words = list(rnd.integers(1, 2**40, 5, dtype=np.uint64))
        if rnd.random() < (0.7 if toxic else 0.1):
            words.append(bad)
        words.append(term if rnd.random() < (0.8 if toxic else 0.2) else other)
        present.append(np.unique(np.array(words, np.uint64)))
        y.append(float(toxic))

    def gap(**strength):
        m = toxicity.fit_words(present, np.array(y), **strength)
        w = m.weights[np.searchsorted(m.words, terms)]
        return w.max() - w.min(), m.weights[np.searchsorted(m.words, bad)]

    (without, _), (default, weight) = gap(counterfactual=0.0), gap()
    assert without > 2 and default < 0.05 and weight > 1


def test_swaps_equal_those_of_changed_texts():
    """Features that a swap changes, against the features of the text with the words replaced."""
    features = lambda words: set(next(toxicity.studied(*utf8(pa.array([" ".join(words)]))))[0].tolist())
    for text in ("", "plain words", "black blackness and blackish birds with white whitening women", "men and men and old men met women",
                 "muslim muslims " + "far " * 20 + "muslims christians christian", "frauen und weiß weißes christliche christlich",
                 "american americans americana europeans immigrants immigrant blackest blackbird whitest"):
        words = text.split()
        present, others = next(toxicity.studied(*utf8(pa.array([text]))))
        want = {}
        pairs = [(words, x, [w if w != x else o for w in words], o) for g in toxicity.IDENTITY for x in g if x in words for o in g if o != x]
        middle = len(words) // 2
        for g, x, o in toxicity.inserted(present):
            x, o = toxicity.IDENTITY[g][x], toxicity.IDENTITY[g][o]
            pairs.append((words[:middle] + [x] + words[middle:], x, words[:middle] + [o] + words[middle:], o))
        for group in toxicity.IDENTITY:
            pairs += [([x], x, [o], o) for x in group for o in group if o != x]
        for before, _, after, _ in pairs:
            a, b = features(before), features(after)
            key = tuple(sorted(a - b)), tuple(sorted(b - a))
            want[key] = want.get(key, 0) + 1
        got = {k: n for k, n in toxicity.swaps([present], [others]).items() if n}
        assert got == want


def plain_fit(docs, labels, **more):
    """The same model from all features in memory."""
    found = {}
    for i, y, text in sorted((i, y, t or "") for i, t, y in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
                             if i is not None and y in (0, 1) and crc32(str(i).encode()) % 5):
        words, others = next(toxicity.studied(*utf8(pa.array([text]))))
        found.setdefault((y, words.tobytes()), (words, others))
    present, others = zip(*found.values())
    return toxicity.fit_words(list(present), np.array([y for y, _ in found], float), others=list(others), **more)


@pytest.mark.parametrize("most", [toxicity.MOST, 5])
def test_model_equals_that_of_all_features_in_memory(spark, most):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    got, want = toxicity.train(docs, labels, most=most), plain_fit(docs, labels, most=most)
    assert np.array_equal(got.words, want.words) and len(got.words) > len(toxicity._named())
    assert np.allclose(got.weights, want.weights, rtol=0, atol=1e-9) and abs(got.start - want.start) < 1e-9


def test_driver_gets_no_more_of_longer_texts(spark, monkeypatch):
    """What is collected to fit: chosen columns only, however many words the texts have."""
    sizes = []
    plain = toxicity.solve
    monkeypatch.setattr(toxicity, "solve", lambda chosen, rows, cols, *more: sizes.append(len(cols)) or plain(chosen, rows, cols, *more))
    for words in (10, 3000):
        rnd = np.random.default_rng(7)
        rows = [(i, " ".join(["awful" if i % 2 else "fine", *(f"w{w}" for w in rnd.integers(0, 10**9, words))])) for i in range(80)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], LABELS)
        toxicity.train(docs, labels)
    assert sizes[0] == sizes[1] > 0


def test_penalty_covers_stems_of_names():
    """Toxic texts say a name's stem twice, which is a feature of its own: a swap must not change the score by it either."""
    rnd = np.random.default_rng(4)
    found, y = [], []
    for _ in range(600):
        toxic = rnd.random() < 0.5
        name = ("muslim", "christian")[int(rnd.random() < (0.15 if toxic else 0.85))]
        found.append(f"we met the {name} and other {name}s " + " ".join(f"w{i}" for i in rnd.integers(0, 500, 6)))
        y.append(float(toxic))
    words, others = zip(*toxicity.studied(*utf8(pa.array(found))))
    model = toxicity.fit_words(list(words), np.array(y), others=list(others))
    sentences = [f"the {x} and the muslims" for x in ("muslim", "christian", "old")]
    scores = model.logits(*utf8(pa.array(sentences)))
    assert max(scores) - min(scores) < 0.1


def test_trees_flattened_equal_a_walk():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_trees.fit_trees(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95

    def walk(row):
        z = model.start
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            z += value[node - len(feature)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


@pytest.mark.parametrize("module", [toxicity, quality_trees])
def test_labels_that_teach_nothing(spark, module):
    docs = spark.createDataFrame([(2, "a b"), (3, None), (None, "c")], "doc_id long, text string")
    for rows in ([], [(2, 1, 1), (3, 1, 1)], [(2, None, None), (2, 7, 7), (None, 1, 1)], [(2, 0, 0), (2, 1, 1)]):
        model = module.train(docs, spark.createDataFrame(rows, LABELS))
        found = module.score_documents(docs, model).collect()
        assert len(found) == 3 and len({r["score"] for r in found}) == 1
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [None]


@pytest.mark.parametrize("module,fit", [(toxicity, "fit_words"), (quality_trees, "fit_trees")])
def test_sample_is_bounded_by_rows(spark, monkeypatch, module, fit):
    """A labelled id with many rows: copies are merged before the driver sees them, different texts are bounded."""
    collected, fitted, plain, train = [], [], type(spark.range(0)).toPandas, getattr(module, fit)

    def to_pandas(df):
        collected.append(len(out := plain(df)))
        return out

    monkeypatch.setattr(type(spark.range(0)), "toPandas", to_pandas)
    monkeypatch.setattr(module, fit, lambda x, y, **more: fitted.append(len(y)) or train(x, y, **more))
    ids = 1, 7  # held out by neither
    labels = spark.createDataFrame([(ids[0], 1, 1), (ids[1], 0, 0)], LABELS)
    copies = [(ids[0], "some words")] * 300 + [(ids[1], "others")] * 200
    copies = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    module.train(copies, labels)
    texts = (" ".join(f"w{k}" for k in range(i)) for i in range(200))
    many = spark.createDataFrame([(ids[i % 2], t) for i, t in enumerate(texts)], "doc_id long, text string")
    module.train(many, labels, bound=20)
    assert collected == [2, 20] and fitted[0] == 2 and fitted[1] <= 20


@pytest.mark.parametrize("module", [toxicity, quality_trees])
def test_empty_table_and_clashing_columns(spark, module):
    schema = "doc_id long, text string, label int, words string, score double, held_out string"
    labels = table(spark, SMALL, "labels")
    model = module.train(table(spark, SMALL, "documents"), labels)
    keep = toxicity.drop_toxic if module is toxicity else quality_trees.keep_good
    empty = spark.createDataFrame([], schema)
    assert module.score_documents(empty, model).collect() == [] and keep(empty, model).collect() == []
    module.train(empty, labels)
    rows = [(1, "Some plain words here.", 1, "w", 0.1, "h"), (1, "Some plain words here.", 1, "w", 0.1, "h"), (None,) * 6]
    df = spark.createDataFrame(rows, schema)
    assert module.score_documents(df, model).count() == 3
    assert keep(df, model).columns == df.columns


def test_long_texts_are_scored_whole(spark):
    model = toxicity.train(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    clean = "the of and to " * 2_000_000
    scores = model.score(*utf8(pa.array([clean, clean + "trash scum idiot"])))
    assert scores[0] < 0.5 <= scores[1]


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host):]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_by_hand(spark):
    urls = ["https://www.example.com/en/1", "http://example.com/en/", "http://EXAMPLE.com/EN/x", "http://a.net/es/x?y=/fr/",
            "http://a.net/fr", "http://anet/es/", "http://com", "http://x.com?u=http://b.net/es/", "ftp://net/fr/#", None, "", "no url",
            "http:///en/", "http://É.com/é/", "a://b://c.com/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, good int")
    out = url_reputation.judge_urls(pages, outcomes, URL_RULES)
    kind = {r: k for k, r in URL_RULES}
    for r in out.collect():
        host, path, rule = rule_of(urls[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (kind[rule] if rule else "allow")
    assert out.count() == len(urls) + 1
    assert url_reputation.judge_urls(pages.limit(0), outcomes, URL_RULES).collect() == []


def test_hosts_shrink_towards_their_domain(spark):
    pages, outcomes, k = [], [], 0
    for d, share in (("bad.org", 0.05), ("good.org", 0.95)):
        for h in range(6):
            for i in range(40):
                pages.append((k, f"http://h{h}.{d}/{i}"))
                outcomes.append((k, int((i + 0.5) / 40 < share)))
                k += 1
        pages.append((k, f"http://new.{d}/"))
        k += 1
    out = url_reputation.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int"), [])
    verdict = {r["host"]: r["verdict"] for r in out.collect()}
    assert verdict["h0.bad.org"] == verdict["new.bad.org"] == "block"
    assert verdict["h0.good.org"] == verdict["new.good.org"] == "allow"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    from tools.check import compare
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = compare(QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name]))
    assert got.startswith("ok") and "nearly" not in got, got


def test_pipeline_equals_its_steps_in_memory(spark):
    """Each stage's result, from the whole tables in one process."""
    docs = table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        assert docs.columns == table(spark, SMALL, "documents").columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    schema = table(spark, SMALL, "documents").schema
    for name, module in (("quality_classifier", quality_trees), ("toxicity", toxicity)):
        model = module.train(spark.createDataFrame([(i, t, "", "", 0) for i, t in left.items()], schema), table(spark, SMALL, "labels"))
        ids, column = list(left), utf8(pa.array(list(left.values())))
        score = model.score(quality_trees.statistics(*column)) if module is quality_trees else model.score(*column)
        good = score >= 0.5 if module is quality_trees else score < 0.5
        left = {i: left[i] for i, g in zip(ids, good) if g}
        assert kept[name] == left and left
    texts = kept["toxicity"]
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    label = {i: i for i in texts}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert set(kept["near_dedup"]) == set(label.values())
    left = kept["near_dedup"]
    count = {}
    for t in left.values():
        raw = t.encode()
        for k in range(len(raw) - 399):
            count[raw[k:k + 400]] = count.get(raw[k:k + 400], 0) + 1
    for i, t in left.items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 399):
            if count[raw[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        assert kept["suffix_dedup"][i] == bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(kept["suffix_dedup"])


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "near_dedup", "suffix_dedup", "packing"]
    assert importlib.util.find_spec("holdfast.llm.queries") and suffix_dedup.LEAST == 400 and near_dedup.REGISTERS == 128

"""Plain versions of the classifiers' parts, very long texts, and the pipeline on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import fingerprints, near_dedup, piece_codec, quality_rules, quality_trees, toxicity
from holdfast.llm.common import utf8

SCHEMA = "doc_id long, text string"


def plain_statistics(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    lines = [x for x in raw.split(b"\n") if x]
    n, count = len(words), Counter(raw)
    white = sum(count[c] for c in b" \t\n\x0b\x0c\r")
    upper, wide = sum(count[c] for c in range(65, 91)), sum(count[c] for c in range(128, 256))
    letters = upper + wide + sum(count[c] for c in range(97, 123))
    per = lambda a, b: a / b if b else 0.0
    return [math.log1p(len(raw)), math.log1p(n), per(len(raw) - white, n), per(len(set(lower)), n), per(upper, letters),
            per(wide, len(raw)), per(white, len(raw)), per(len(lines), n), 1 - len(set(lines)) / len(lines) if lines else 0.0,
            *(per(sum(count[c] for c in g.encode()), n) for g in quality_trees.GROUPS)]


def test_statistics_equal_the_plain_version():
    rnd = random.Random(1)
    signs = "abcABC de\n\t #*$%&|<>!.,?;:'()[]{}=/\\@_~^+-019éß日\x00"
    found = ["", " ", "\n\n", "word", "Two two TWO", "a\na\nb"]
    found += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 300))) for _ in range(80)]
    got = quality_trees.statistics(*utf8(pa.array(found)))
    assert np.allclose(got, [plain_statistics(t) for t in found], rtol=0, atol=1e-12)


def plain_trees(x, y, rounds, depth, bins=64, rate=0.15, ridge=1.0, least=2.0):
    """Every split of every node tried over all its rows."""
    share = (sum(y) + 1) / (len(y) + 2)
    z = [math.log(share / (1 - share))] * len(y)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in z]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        nodes, splits = {0: list(range(len(y)))}, {}
        for node in range(2**depth - 1):
            rows, best = nodes.get(node, []), (0.0, 0, math.inf)
            total = sum(g[i] for i in rows), sum(h[i] for i in rows)
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    left = [i for i in rows if x[i, f] <= cut]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gr, hr = total[0] - gl, total[1] - hl
                    if hl >= least and hr >= least:
                        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total[0]**2 / (total[1] + ridge)
                        if gain > best[0] + 1e-9:
                            best = gain, f, cut
            splits[node] = best[1:]
            nodes[2 * node + 1] = [i for i in rows if x[i, best[1]] <= best[2]]
            nodes[2 * node + 2] = [i for i in rows if x[i, best[1]] > best[2]]
        for leaf in range(2**depth - 1, 2**(depth + 1) - 1):
            rows = nodes[leaf]
            value = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                z[i] += value
        trees.append([splits[k] for k in range(2**depth - 1)])
    return trees, [1 / (1 + math.exp(-v)) for v in z]


def test_trees_equal_splits_tried_one_by_one():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(120, 3))
    x[:, 1] = np.round(x[:, 1])
    y = (x[:, 0] + x[:, 1] + 0.3 * rnd.normal(size=120) > 0).astype(float)
    model = quality_trees.fit_trees(x, y, rounds=4, depth=3, bins=12)
    trees, score = plain_trees(x, y, 4, 3, 12)
    assert np.allclose(model.score(x), score, atol=1e-9)
    for feature, cut, plain in zip(model.feature, model.cut, trees):
        for f, c, (pf, pc) in zip(feature, cut, plain):
            assert math.isinf(c) and math.isinf(pc) or (f, c) == (pf, pc)


def plain_features(text):
    """Words, and beginnings that two or three words near each other share."""
    words = re.findall(r"[0-9A-Za-z]+", text)
    words = [w.lower() for w in words]
    out = {("word", w) for w in words}
    for k in toxicity.STEMS:
        places = {}
        for i, w in enumerate(words):
            if len(w) > k:
                places.setdefault(w[:k], []).append(i)
        for stem, at in places.items():
            out |= {(times, stem) for times in (2, 3) if any(b - a <= toxicity.NEAR for a, b in zip(at, at[times - 1:]))}
    return out


def hashed(feature):
    kind, text = feature
    h = toxicity._hashes((text,))[0]
    return int(h if kind == "word" else toxicity.mixed(np.array([h ^ np.uint64(kind)]))[0])


def test_features_equal_the_plain_version():
    rnd = random.Random(3)
    stems = ["black", "blackness", "blacker", "white", "whitest", "walk", "walking", "walked", "a", "it"]
    found = ["", "one", "Walk WALKING walked"] + [" ".join(rnd.choices(stems, k=rnd.randint(1, 60))) for _ in range(40)]
    for text, (words, _) in zip(found, toxicity.studied(*utf8(pa.array(found)))):
        assert set(words.tolist()) == {hashed(f) for f in plain_features(text)}


def test_chosen_words_equal_a_plain_ratio():
    rnd = random.Random(4)
    y = np.array([float(i % 3 == 0) for i in range(300)])
    sets = [{f"w{rnd.randrange(80)}" for _ in range(6)} | ({"bad"} if v and rnd.random() < 0.8 else set()) for v in y]
    names = sorted(set().union(*sets))
    code = {w: np.uint64(i + 1) for i, w in enumerate(names)}
    rows = np.concatenate([[i] * len(s) for i, s in enumerate(sets)]).astype(int)
    words = np.concatenate([[code[w] for w in sorted(s)] for s in sets]).astype(np.uint64)

    def loglik(k, n):
        return k * math.log(k / n) + (n - k) * math.log((n - k) / n) if 0 < k < n else 0.0

    n1, chosen = int(y.sum()), set()
    for w in names:
        k1, k = sum(w in s for s, v in zip(sets, y) if v), sum(w in s for s in sets)
        ratio = 2 * (loglik(k1, n1) + loglik(k - k1, 300 - n1) - loglik(k, 300))
        if ratio > 2 * math.log(len(names)) + 2 and k >= 3:
            chosen.add(w)
    assert "bad" in chosen
    assert toxicity._telling(words, rows, y, 2000).tolist() == sorted(int(code[w]) for w in chosen)


def test_the_fit_minimises_what_it_says():
    rnd = np.random.default_rng(5)
    chosen = np.arange(1, 9, dtype=np.uint64)
    dense = rnd.random((200, 8)) < 0.3
    y = (dense[:, 0] | (rnd.random(200) < 0.2)).astype(float)
    rows, cols = np.nonzero(dense)
    changes = {(1, ~2): 30, (2, ~1): 10, (3, 4, ~5): 7, (): 53}
    model = toxicity.solve(chosen, rows, cols, y, changes, ridge=0.3, counterfactual=4.0, rounds=3000)

    def objective(w, b):
        z = dense @ w + b
        out = sum(math.log1p(math.exp(v)) - t * v for v, t in zip(z, y)) + 0.15 * w @ w
        total = sum(changes.values())
        for key, times in changes.items():
            change = sum(-w[i] if i >= 0 else w[~i] for i in key)
            out += 4.0 / 2 * len(y) * times / total * change**2
        return out

    best = objective(model.weights, model.start)
    for i in range(8):
        for step in (1e-3, -1e-3):
            w = model.weights.copy()
            w[i] += step
            assert objective(w, model.start) > best
    assert all(objective(model.weights, model.start + step) > best for step in (1e-3, -1e-3))


LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(300_000)) + "\n" + "é" * 100_000


@pytest.fixture(scope="module")
def long_texts(spark):
    return spark.createDataFrame([(1, LONG), (2, "short text of few words"), (3, LONG)], SCHEMA)


def test_rules_count_long_texts_whole(long_texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(long_texts).collect()}
    words = LONG.split()
    assert got[1]["n_words"] == len(words) == 300_001 and got[1]["word_chars"] == sum(map(len, words))
    assert got[1]["n_repeat_words"] == got[3]["n_repeat_words"] == 300_000  # the words repeat with a period of 5003


def test_pieces_of_long_texts_equal_the_library(long_texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = piece_codec.encode_documents(long_texts, path)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(out, path).collect()}
    assert back[1] == library.decode(library.encode(LONG))
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3}


def test_fingerprints_of_long_texts(long_texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(long_texts).collect()}
    n = len(LONG)
    edited = LONG[:n - n // 2] + "short text of few words"
    assert got[1]["n_chars"] == n and got[1]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1]["fingerprint"] == got[3]["fingerprint"] != got[2]["fingerprint"]


def test_shingles_of_long_texts(long_texts):
    got = {r["doc_id"]: r for r in near_dedup.components(long_texts, width=2).collect()}
    words = LONG.split()
    assert got[1]["n_shingles"] == len(set(zip(words, words[1:])))
    assert got[3]["component_id"] == 1 and not got[3]["kept"] and got[2]["component_id"] == 2


def test_statistics_of_long_texts():
    got = quality_trees.statistics(*utf8(pa.array([LONG, "x"])))
    assert np.allclose(got, [plain_statistics(LONG), plain_statistics("x")])


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_pipeline_of_empty_tables(spark, folder):
    empty = tables(spark, folder("empty"), spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_pipeline_of_odd_rows(spark, folder):
    """Null ids and texts, repeated rows, a very long text, columns whose names the stages use, no labels at all."""
    rnd = random.Random(6)
    said = lambda n: " ".join(f"word{rnd.randrange(4000)}" for _ in range(n))
    rows = [(i, said(60), "en", "s", i) for i in range(20)]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None), (None, None, None, None, None), (21, None, "en", "s", 0), (22, "", "en", "s", 0),
             (23, said(100_000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns(
        {"label": F.lit(1), "kind": F.lit("k"), "part": F.lit(0), "key": F.lit("x"), "score": F.lit(0.1), "component_id": F.lit(5)})
    odd = tables(spark, folder("odd"), docs, spark.createDataFrame([], LABELS))
    stage = corpus_pipeline.one_of_near_duplicates(spark, docs, odd)
    assert stage.columns == docs.columns
    packed = corpus_pipeline.run(spark, odd).collect()
    found = {r["doc_id"] for r in packed}
    assert set(range(20)) <= found and {21, 22, 23} <= found
    ends = Counter(r["doc_id"] for r in packed if r["start"] + r["length"] == r["doc_tokens"])
    assert ends[3] == 1 and ends[5] == 1  # copies of a row, and of a text under another id, are dropped

"""Operators on whole texts against plain versions: near duplicates, repeated passages, fingerprints, quality rules."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import fingerprints, near_dedup, quality_rules, suffix_dedup
from holdfast.llm.links import connected

SCHEMA = "doc_id long, text string"
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in "".join("\n" if c in WHITE else c for c in text or "").split("\n") if w]


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = words(ascii_lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[top(i)], rows[i][0] == least[top(i)]) for i in range(len(rows))]


def near_rows(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            t = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, max(1, len(t) // 12))):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 8, 30, 120, 400])))))
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_all_pairs(spark, width):
    rows = near_rows(350, width) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (None, "w1 w2 w3"),
                                    (2, near_rows(350, width)[2][1])]
    got = collected(near_dedup.components(spark.createDataFrame(rows, SCHEMA).repartition(5), width))
    assert got == sorted(brute_components(rows, width), key=repr)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Groups above the bound for all pairs go by centres, then by what their bands split."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        t = list(base)
        for _ in range(rnd.randint(0, 16)):
            t[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = collected(near_dedup.components(spark.createDataFrame(rows, SCHEMA), 2))
    assert got == sorted(brute_components(rows, 2), key=repr)


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", "x", 9), (2, "A b c d e f", "y", 9), (1, "a b c d e f", "x", 9), (3, None, "z", 0), (4, "", "z", 0),
            (None, "q r s", "n", 5), (None, "q r s", "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, h int")
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert collected(out) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)


def test_estimates_follow_the_similarity():
    rnd = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        both = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(len(both) * share)
        a, b = (np.unique(np.r_[both[:n], rnd.integers(0, 2**63, (4000 - n) // 2, dtype=np.uint64)]) for _ in (0, 1))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        size = np.array([len(a)], float), np.array([len(b)], float)
        got, _ = near_dedup.estimate(near_dedup.signature(a)[None], near_dedup.signature(b)[None], *size)
        errors.append(abs(got[0] - j))
    assert max(errors) < 0.15


def test_connected_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(100, 101)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def brute_repeats(texts, least):
    count = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeat_rows(n=70, seed=3):
    rnd = random.Random(seed)
    some = lambda k: " ".join(rnd.choice(["alpha", "beta", "de", "é", "the"]) + str(rnd.randint(0, 99)) for _ in range(k))
    passages = [some(120) for _ in range(3)]
    rows = []
    for i in range(n):
        t = some(rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 3)):
            p, a, j = rnd.choice(passages), rnd.randint(0, 200), rnd.randint(0, len(t))
            t = t[:j] + p[a:a + rnd.randint(200, 700)] + t[j:]
        if rnd.random() < 0.1 and rows:
            t = rnd.choice(rows)[1]
        rows.append((i if i % 17 else None, t))
    return rows + [(3, None), (500, ""), (501, "x" * 1500), (502, "ab" * 700), rows[5]]


@pytest.mark.parametrize("least,most", [(400, 4096), (100, 3)])
def test_repeated_passages_equal_counting_all_strings(spark, least, most):
    """The second case splits every gram with more than three spans by halves."""
    rows = repeat_rows()
    got = collected(suffix_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(4), least, most))
    want = brute_repeats([(t or "").encode() for _, t in rows], least)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)


def test_stretches_of_a_long_text_hold_every_string(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 50)
    data = np.random.default_rng(1).integers(97, 100, 1000, dtype=np.uint8)
    starts = []
    for _, i, j in suffix_dedup._stretches(np.array([0, 1000]), 60):
        _, first, last, _ = suffix_dedup.anchors(data[i:j], 60)
        starts += [i + s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert sorted(starts) == list(range(1000 - 60 + 1))


def test_deep_shallow_sorts():
    rnd = random.Random(5)
    for n in range(60):
        base = bytes(rnd.choice(b"ab") for _ in range(300))
        s = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 200))) if rnd.random() < 0.4 else base[:rnd.randint(0, 300)]
             for _ in range(rnd.randint(2, 25))]
        order, depths = suffix_dedup.deep_shallow(s)
        assert [s[i] for i in order] == sorted(s)
        assert depths[1:] == [suffix_dedup.common_prefix(s[a], s[b]) for a, b in zip(order, order[1:])]


def test_without_repeats_keeps_columns_and_whole_characters(spark):
    passage = "é" * 300
    rows = [(1, "a" + passage + "b", 302, "u"), (2, passage + "c", 301, "v"), (3, None, 0, "w"), (4, "short", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, h string")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert collected(out) == [(1, "ab", 2, "u"), (2, "c", 1, "v"), (3, None, 0, "w"), (4, "short", 5, "x")]


def generalised_jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def test_fingerprints_against_plain_version(spark):
    rnd = random.Random(2)
    # a word of its own every six texts: texts of one vocabulary share the samples' error, so that their mean says little
    rows = [(i * 3, " ".join(f"{i // 6}w{min(int(rnd.expovariate(0.05)), 90)}" for _ in range(rnd.randint(0, 300))))
            for i in range(120)]
    rows += [(5, "é日 x"), (7, None), (8, ""), (10, rows[4][1]), (None, "first of all")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    near = []
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        t, following, r = t or "", following or "", got[i]
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        near += [r["near_edited"] - generalised_jaccard(t, changed), r["near_next"] - generalised_jaccard(t, following)]
    assert np.mean(np.abs(near)) < 0.06 and abs(np.mean(near)) < 0.02
    assert got[10]["fingerprint"] == got[12]["fingerprint"]
    sampler = fingerprints.Sampler()
    assert sampler.fingerprints(*fingerprints._packed([ordered[3][1]])) == [got[ordered[3][0]]["fingerprint"]]


def test_fingerprints_of_one_id_in_many_tasks(spark, monkeypatch):
    """Rows without an id are dealt to several tasks, and each still meets the next text."""
    dealt, plain = [], fingerprints.stored
    monkeypatch.setattr(fingerprints, "stored", lambda df, name: dealt.append(out := plain(df, name)) or out)
    found = sorted(f"{i * 7919 % 1000} some words of text {i}" for i in range(400))
    df = spark.createDataFrame([(None, t) for t in found], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        got = Counter(r["edited_sha256"] for r in fingerprints.fingerprint_documents(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    share = [r["count"] for r in dealt[0].where("kind != 'head'").groupBy("part").count().collect()]
    assert len(share) > 1 and max(share) < 300
    want = [fingerprints.edited(t, n) for t, n in zip(found, found[1:] + found[:1])]
    assert got == Counter(hashlib.sha256(t.encode()).hexdigest() for t in want)


def test_fingerprints_of_a_single_row(spark):
    r = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "a b c d")], SCHEMA)).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0


def brute_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts_equal_plain_version(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["the", "a", "b\n", "c", "#d", "É"], k=rnd.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "\n\n \t"), (903, " ".join(f"u{i}" for i in range(50)) * 2), (None, "x " * 40), rows[0],
             (904, " ".join(f"u{i % 5000}" for i in range(12000)))]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_rules.judge(df)
    assert collected(out.select(*names)) == sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_accuracies_find_the_weak_rule(spark):
    rnd = random.Random(7)
    accuracy = [0.95, 0.9, 0.85, 0.55]
    rows, truth = [], []
    for i in range(4000):
        good = rnd.random() < 0.7
        truth.append(good)
        votes = [0 if rnd.random() < 0.2 else (1 if (rnd.random() < a) == good else -1) for a in accuracy]
        rows.append((i, sum((v + 1) * 3**k for k, v in enumerate(votes)), votes))
    df = spark.createDataFrame(rows, "id long, code int, votes array<int>")
    found = {r["code"]: r["posterior"] for r in quality_rules.fit_accuracies(df, 4).collect()}
    right = sum((found[c] >= 0.5) == t for (_, c, _), t in zip(rows, truth)) / len(rows)
    # an exact posterior with the true accuracies
    def known(votes):
        odds = np.log(0.7 / 0.3) + sum(v * np.log(a / (1 - a)) for v, a in zip(votes, accuracy))
        return odds >= 0
    best = sum(known(v) == t for (_, _, v), t in zip(rows, truth)) / len(rows)
    assert right > best - 0.01


@pytest.mark.parametrize("run", [
    near_dedup.components, near_dedup.keep_one, suffix_dedup.digest, suffix_dedup.without_repeats,
    fingerprints.fingerprint_documents, quality_rules.judge,
])
def test_empty_table_and_clashing_columns(spark, run):
    schema = "doc_id long, text string, h long, cls string, id long, part int, score double, words string, label int"
    assert run(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "some words of text that is here", 1, "a", 2, 3, 0.5, "w", 1), (None, None, None, None, None, None, None, None, None)]
    assert run(spark.createDataFrame(rows, schema)).count() == 2


def test_rows_are_the_same_for_any_partitioning(spark):
    rows = near_rows(80, 9)
    one, many = (spark.createDataFrame(rows, SCHEMA).repartition(n, F.col("doc_id")) for n in (1, 7))
    for run in (near_dedup.components, suffix_dedup.digest, fingerprints.fingerprint_documents, quality_rules.judge):
        assert collected(run(one)) == collected(run(many))

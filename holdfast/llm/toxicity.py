"""Toxicity classifier that treats identity terms alike.

A logistic model over the presence of words, and of words that begin alike close to one another (compounds of one
stem), fitted on labelled documents. Labelled texts that name a group are copied with every other group's name of the
language in its place (and, as few texts name one, names are also put into the middle of each labelled text); the fit
penalises every change of the score between the two, in all features that change, and as much per labelled row however many
there are. Neutral mentions then add nothing to a score.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null texts count as empty and score as the
intercept does; without labels the score is 1/2, with labels of one kind their smoothed share; repeated rows and ties
score alike (0.5 counts as 1); a null ``doc_id`` is never trained on and its ``held_out`` is null; an empty table gives
no rows. Texts are scored whole, however long. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import (
    blocks, bounded, held_out_rows, labelled_sample, mixed, stored, texts, utf8, word_classes, word_hashes,
)

FOLDS, HELD_OUT = 5, 0
#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
#: Names of groups that may stand for one another, by language.
IDENTITY = (
    ("women", "men", "gay", "straight", "lesbian", "transgender", "black", "white", "asian", "african", "american",
     "european", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee", "disabled",
     "deaf", "blind", "old", "young"),
    ("frauen", "männer", "schwul", "lesbisch", "schwarz", "weiß", "muslimisch", "christlich", "jüdisch", "einwanderer"),
    ("femmes", "hommes", "gais", "lesbiennes", "noirs", "blancs", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "gays", "lesbianas", "negros", "blancos", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
CLASSES = word_classes(bytes(i for i in range(128) if not chr(i).isalnum()), True)


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return word_hashes(*utf8(pa.array([" ".join(words)])), CLASSES)[0]


#: Bytes that close words have in common, and the words within which two or three of them count.
STEMS, NEAR = (4, 5, 6, 7), 16


def _present(h: np.ndarray, first: np.ndarray, *stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of a block of texts, with repeats: hashes of words and of stems that occur close together."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, features = [row], [h]
    for stem in stems:
        long = np.flatnonzero(stem)
        order = long[np.lexsort((long, stem[long], row[long]))]
        s, r = stem[order], row[order]
        for times in (2, 3):
            k = times - 1
            close = np.flatnonzero((s[k:] == s[:-k]) & (r[k:] == r[:-k]) & (order[k:] - order[:-k] <= NEAR)) if len(s) > k else []
            rows.append(r[close])
            features.append(mixed(s[close] ^ np.uint64(times)))
    return np.concatenate(rows), np.concatenate(features)


@dataclass(frozen=True)
class Term:
    word: int
    stems: tuple[int, ...]


def _terms(group: tuple[str, ...]) -> list[Term]:
    h, _, *stems = word_hashes(*utf8(pa.array([" ".join(group)])), CLASSES, STEMS)
    return [Term(w, tuple(x for x in s if x)) for w, *s in zip(h.tolist(), *(x.tolist() for x in stems))]


TERMS = [_terms(group) for group in IDENTITY]
_WORDS = np.array([t.word for terms in TERMS for t in terms], np.uint64)
_STEMS = np.unique(np.array([s for terms in TERMS for t in terms for s in t.stems], np.uint64))
_CLOSE = {times: dict(zip(_STEMS.tolist(), mixed(_STEMS ^ np.uint64(times)).tolist())) for times in (2, 3)}


def inserted(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(group, term, other)`` per language: the names that are put into a text with these features, by their hash."""
    seed, out = int(np.bitwise_xor.reduce(words)) if len(words) else 0, []
    for g, terms in enumerate(TERMS):
        seed, x = divmod(seed, len(terms))
        seed, step = divmod(seed, len(terms) - 1)
        out.append((g, x, (x + 1 + step) % len(terms)))
    return out


def _with(term: Term, other: Term, at: list[int], named: set[int], places: dict[int, list[int]]) -> set[int]:
    """Of the features that two terms can make, those of a text where ``term`` stands at the positions ``at``."""
    out = {term.word} | ({other.word} & named)
    for s in {*term.stems, *other.stems}:
        p = sorted([*places.get(s, ()), *(at if s in term.stems else ())])
        out.update(f[s] for times, f in _CLOSE.items() if any(b - a <= NEAR for a, b in zip(p, p[times - 1:])))
    return out


def altered(words: np.ndarray, h: np.ndarray, stems: list[np.ndarray]) -> list[int]:
    """The swaps of a text, given its features and its words in order, that change more or less than one name for another:
    for each ``term, other``, the numbers of features lost and gained, and these features."""
    named: dict[int, list[int]] = {}
    places: dict[int, list[int]] = {}
    for known, found, column in ((_WORDS, named, h), *((_STEMS, places, s) for s in stems)):
        for i in np.flatnonzero(np.isin(column, known)).tolist():
            found.setdefault(int(column[i]), []).append(i)
    if not named and not places:
        return []
    out: list[int] = []

    def swap(x: Term, other: Term, at: list[int], names: set[int], rest: dict[int, list[int]]) -> None:
        before, after = _with(x, other, at, names, rest), _with(other, x, at, names, rest)
        lost, gained = sorted(before - after), sorted(after - before)
        if (lost, gained) != ([x.word], [other.word]):
            out.extend((x.word, other.word, len(lost), len(gained), *lost, *gained))

    for terms in TERMS:
        for x in terms:
            at = named.get(x.word)
            if at:
                rest = {s: [p for p in found if p not in at] if s in x.stems else found for s, found in places.items()}
                for other in terms:
                    if other != x:
                        swap(x, other, at, named.keys() - {x.word}, rest)
    middle = len(h) // 2
    moved = {s: [p + (p >= middle) for p in found] for s, found in places.items()}
    for g, x, other in inserted(words):
        swap(TERMS[g][x], TERMS[g][other], [middle], set(named), moved)
    return out


def studied(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes of the different features of each text, and its ``altered`` swaps."""
    for a, b in blocks(offsets):
        h, first, *stems = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], CLASSES, STEMS)
        row, feature = _present(h, first, *stems)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(b - a + 1))
        feature = feature[order]
        for i, j, u, v in zip(ends[:-1], ends[1:], first[:-1], first[1:]):
            words = np.unique(feature[i:j])
            yield words, np.array(altered(words, h[u:v], [s[u:v] for s in stems]), np.uint64)


@dataclass
class WordModel:
    start: float
    words: np.ndarray  # sorted hashes
    weights: np.ndarray

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.start)
        if not len(self.words):
            return out
        for a, b in blocks(offsets):
            row, h = _present(*word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], CLASSES, STEMS))
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == h)
            pair = np.unique(row[hit] * len(self.words) + at[hit])
            out[a:b] += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], b - a)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(data, offsets)))


def _ratio(with1: np.ndarray, with_: np.ndarray, n1: float, n: float) -> np.ndarray:
    """Likelihood ratio of a feature's presence in ``with1`` of ``n1`` rows of label 1 and ``with_`` of all ``n`` rows."""
    with0, n0, share = with_ - with1, n - n1, with_ / n
    term = lambda k, n, p: k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9))
    return 2 * (term(with1, n1, share) + term(with0, n0, share) + term(n1 - with1, n1, 1 - share)
                + term(n0 - with0, n0, 1 - share))


def _least_ratio(vocabulary: int) -> float:
    """What chance explains among so many features."""
    return 2 * np.log(max(vocabulary, 2)) + 2


#: Rows that hold a feature, at least.
LEAST_ROWS = 3
#: Most features, besides the names of groups.
MOST = 2000


def _telling(words: np.ndarray, rows: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Words whose presence goes with the label more than chance explains among so many words (likelihood ratio)."""
    vocabulary, column = np.unique(words, return_inverse=True)
    with1 = np.bincount(column, y[rows], len(vocabulary))
    with_ = np.bincount(column, minlength=len(vocabulary)).astype(float)
    ratio = _ratio(with1, with_, y.sum(), len(y))
    enough = np.flatnonzero((ratio > _least_ratio(len(vocabulary))) & (with_ >= LEAST_ROWS))
    return np.sort(vocabulary[enough[np.argsort(-ratio[enough], kind="stable")][:most]])


def _named() -> np.ndarray:
    return np.concatenate([_hashes(g) for g in IDENTITY])


def swaps(present: list[np.ndarray], others: list[np.ndarray] | None = None, alone: int = 1) -> dict[tuple[tuple, tuple], int]:
    """How often features ``(lost, gained)`` change where a name takes another's place: for each labelled text, each term it
    names and the one put into it per language, and ``alone`` times for each term alone; ``others`` are the texts' ``altered``
    swaps."""
    out: dict[tuple[tuple, tuple], int] = {}

    def add(lost: tuple, gained: tuple, times: int = 1) -> None:
        out[lost, gained] = out.get((lost, gained), 0) + times

    put = [x for words in present for x in inserted(words)]
    for g, terms in enumerate(TERMS):
        h = np.array([t.word for t in terms], np.uint64)
        naming = alone + sum((np.isin(h, words) for words in present), np.zeros(len(h), np.int64))
        for x, times in zip(h.tolist(), naming.tolist()):
            for other in h.tolist():
                if other != x and times:
                    add((x,), (other,), times)
    for g, x, other in put:
        add((TERMS[g][x].word,), (TERMS[g][other].word,))
    for found in others or ():
        i, found = 0, found.tolist()
        while i < len(found):
            x, other, lost, gained = found[i:i + 4]
            middle, i = i + 4 + lost, i + 4 + lost + gained
            add((x,), (other,), -1)
            add(tuple(found[middle - lost:middle]), tuple(found[middle:i]))
    return out


#: Columns lost (``i``) and gained (``~i``) where a name takes another's place, as far as the model has them: how often.
Changes = dict[tuple[int, ...], int]


def _start(y: np.ndarray) -> float:
    share = (y.sum() + 1) / (len(y) + 2)
    return float(np.log(share / (1 - share)))


def _at(chosen: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the features that are chosen, and which ones these are."""
    at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
    hit = chosen[at] == features
    return at[hit], hit


def _change(chosen: np.ndarray, lost: tuple, gained: tuple) -> tuple[int, ...]:
    return (*_at(chosen, np.array(lost, np.uint64))[0].tolist(), *(~_at(chosen, np.array(gained, np.uint64))[0]).tolist())


def solve(chosen: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, changes: Changes, ridge: float = 0.2,
          counterfactual: float = 10.0, rounds: int = 300) -> WordModel:
    """Gradient descent on logistic loss + ridge + counterfactual penalty, steps scaled by the curvature's diagonal.

    The penalty is ``counterfactual / 2`` times the number of rows times the mean over all swaps of the squared change of
    the score, so it keeps its weight against the loss, which is a sum over rows.
    """
    start = _start(y)
    keys = sorted(changes)
    sizes = np.array([len(k) for k in keys])
    swap = np.repeat(np.arange(len(sizes)), sizes)
    signed = np.array([i for k in keys for i in k], np.int64)
    place, sign = np.where(signed < 0, ~signed, signed), np.where(signed < 0, 1.0, -1.0)
    strength = np.array([changes[k] for k in keys], float) * (counterfactual * len(y) / sum(changes.values()))
    degree = np.bincount(place, (strength * sizes)[swap], len(chosen))
    w, b = np.zeros(len(chosen)), start
    step = 1 / (np.bincount(cols, minlength=len(chosen)) * 0.25 * 8 + ridge + degree)
    mw, mb, momentum = w.copy(), b, 1.0
    for _ in range(rounds):  # accelerated
        p = 1 / (1 + np.exp(-(mb + np.bincount(rows, mw[cols], len(y)))))
        change = np.bincount(swap, mw[place] * sign, len(sizes)) * strength
        g = np.bincount(cols, (p - y)[rows], len(chosen)) + ridge * mw + np.bincount(place, change[swap] * sign, len(chosen))
        w2, b2 = mw - step * g, mb - (p - y).sum() / (0.25 * len(y))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        mw, mb = w2 + (momentum - 1) / following * (w2 - w), b2 + (momentum - 1) / following * (b2 - b)
        w, b, momentum = w2, b2, following
    return WordModel(float(b), chosen, w)


def fit_words(present: list[np.ndarray], y: np.ndarray, most: int = MOST, others: list[np.ndarray] | None = None,
              chosen: np.ndarray | None = None, changes: Changes | None = None, **strengths) -> WordModel:
    """The model of rows given by all their features and ``altered`` swaps or, where the ``chosen`` features and the ``changes``
    of the swaps are known, by their columns."""
    if not len(y) or y.min() == y.max():
        return WordModel(_start(y), np.zeros(0, np.uint64), np.zeros(0))
    rows = np.repeat(np.arange(len(present)), [len(p) for p in present])
    cols = np.concatenate(present)
    if chosen is None:
        chosen = np.union1d(_telling(cols, rows, y, most), _named())
        cols, hit = _at(chosen, cols)
        rows, changes = rows[hit], {}
        for (lost, gained), times in swaps(present, others).items():
            key = _change(chosen, lost, gained)
            changes[key] = changes.get(key, 0) + times
    return solve(chosen, rows, cols.astype(np.int64), y, changes, **strengths)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _chosen(kept: DataFrame, n1: int, n: int, most: int) -> np.ndarray:
    """The telling features, counted and ranked by Spark: only those chosen reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _arrays(b.column("words"))
            label = np.repeat(b.column("label").to_numpy(zero_copy_only=False), [len(w) for w in words])
            feature, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(feature.view(np.int64)), pa.array(np.bincount(column, minlength=len(feature))),
                 pa.array(np.bincount(column, label, len(feature)).astype(np.int64))], names=["feature", "n", "n1"])

    sums = kept.select("label", "words").mapInArrow(counted, "feature long, n long, n1 long")
    found = stored(sums.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")), "toxicity_features")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with_, with1 = (b.column(c).to_numpy().astype(float) for c in ("n", "n1"))
            yield pa.RecordBatch.from_arrays([b.column("feature"), pa.array(_ratio(with1, with_, float(n1), n))],
                                             names=["feature", "ratio"])

    enough = found.where(F.col("n") >= LEAST_ROWS).mapInArrow(rated, "feature long, ratio double")
    best = enough.where(F.col("ratio") > _least_ratio(found.count())).orderBy(
        F.desc("ratio"), F.col("feature").bitwiseXOR(F.lit(-(1 << 63)))).limit(most)  # equal ones as unsigned numbers
    return np.union1d(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64), _named())


def _changes(kept: DataFrame, chosen: np.ndarray) -> Changes:
    """What ``swaps`` counts over all rows, restricted to the chosen features and summed by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Changes = {}
        for b in batches:
            for words, others in zip(_arrays(b.column("words")), _arrays(b.column("others"))):
                for (lost, gained), times in swaps([words], [others], alone=0).items():
                    key = _change(chosen, lost, gained)
                    sums[key] = sums.get(key, 0) + times
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.array(k, np.int32).tobytes() for k in sums], pa.binary()), pa.array(list(sums.values()), pa.int64())],
            names=["change", "times"])

    met = kept.select("words", "others").mapInArrow(counted, "change binary, times long").groupBy("change").agg(F.sum("times"))
    out = {tuple(np.frombuffer(r[0], np.int32).tolist()): r[1] for r in met.collect()}
    for (lost, gained), times in swaps([], alone=1).items():  # each pair of names once by itself
        key = _change(chosen, lost, gained)
        out[key] = out.get(key, 0) + times
    return out


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT,
          most: int = MOST) -> WordModel:
    """Fit on at most ``bound`` labelled rows outside the held-out fold; copies of a text's set of words count once.

    The driver gets the chosen features' columns of each row, ``most`` and the names of groups at most, however long the texts.
    """

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w.tobytes(), o.tobytes()) for w, o in studied(*utf8(b.column("text")))]
            words, others = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(words, pa.binary()), pa.array(others, pa.binary())],
                names=["doc_id", "label", "words", "others"])

    sample = labelled_sample(docs, labels, "toxic", folds, held_out, bound)
    read = sample.mapInArrow(words_of, "doc_id long, label int, words binary, others binary")
    merged = read.groupBy("label", "words").agg(F.min(F.struct("doc_id", "others")).alias("first"))
    kept = bounded(merged.select("label", "words", "first.doc_id", "first.others"), bound, "toxicity_sample")
    by_label = dict(tuple(r) for r in kept.groupBy("label").count().collect())
    n1, n = by_label.get(1, 0), sum(by_label.values())
    if not n1 or n1 == n:
        return WordModel(_start(np.repeat([0.0, 1.0], [n - n1, n1])), np.zeros(0, np.uint64), np.zeros(0))
    chosen = _chosen(kept, n1, n, most)

    def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [_at(chosen, w)[0].astype(np.int32).tobytes() for w in _arrays(b.column("words"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(cols, pa.binary())], names=["doc_id", "label", "cols"])

    found = kept.select("doc_id", "label", "words").mapInArrow(columns_of, "doc_id long, label int, cols binary").toPandas()
    found["cols"] = found["cols"].map(bytes)
    found = found.sort_values(["doc_id", "label", "cols"])
    cols = [np.frombuffer(c, np.int32) for c in found["cols"]]
    return fit_words(cols, found["label"].to_numpy(float), chosen=chosen, changes=_changes(kept, chosen))


def score_documents(docs: DataFrame, model: WordModel, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), held_out_rows(b.column("doc_id"), folds, held_out), pa.array(s),
                 pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return texts(docs).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: WordModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 1/2; a model that has learned nothing, for want of labels of both
    kinds, rejects none."""
    if not len(model.words):
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(*utf8(b.column("text"))) < 0.5))

    return docs.mapInArrow(keep, docs.schema)

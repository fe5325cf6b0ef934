"""Weakly supervised quality: rules vote good, bad or abstain, expectation-maximisation estimates how often each
rule is right, and the posterior probability of good quality decides. Columns and SQL functions only.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
Null and empty texts have no words, fail the base check, and every rule abstains on them; a null ``doc_id`` stays
null; repeated rows are judged row by row and alike; ties of the posterior with the threshold count as kept; an
empty table gives no rows. Texts are counted whole, however long. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored, texts

WHITE_RUN = "[ \\t-\\r]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_LETTERS = "0123456789!\"'()+,-./:;=?@[\\]^_`{}~" + SYMBOLS
#: All but capital letters, digits and ASCII marks.
RARE = "[^!-`{-~]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "der", "die", "und", "das", "ist", "de", "la", "le", "les", "et",
              "des", "que", "el", "en", "los", "y")
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains (also on null)."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0).cast("int")


def default_rules() -> list[Rule]:
    """Rules over the columns of ``text_statistics``; each abstains between its two bounds."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    lines = F.when(F.col("n_lines") > 0, F.col("n_lines"))
    length, symbols, repeats = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_repeat_words") / words
    dups, upper, other = F.col("n_dup_lines") / lines, F.col("n_upper") / chars, F.col("n_other") / chars
    marks = F.col("n_exclaims") / words
    return [
        Rule("word_length", (length < 2.5) | (length > 12), (length >= 3.5) & (length <= 9)),
        Rule("symbols", symbols > 0.3, symbols <= 0.1),
        Rule("duplicate_lines", dups > 0.3, dups <= 0.1),
        Rule("repeats", repeats > 0.25, repeats <= 0.1),
        Rule("letters", other > 0.3, other <= 0.15),
        Rule("upper_case", upper > 0.4, upper <= 0.2),
        Rule("exclamations", marks > 0.3, marks <= 0.1),
        Rule("stop_words", (F.col("n_words") >= 40) & (F.col("n_stop_words") == 0), F.col("n_stop_words") >= 2),
    ]


def _keyed_windows(windows: Column, words: Column) -> Column:
    """Windows in the order of their hash and words, each with its place."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(
        h.alias("h"), F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("t"), i.alias("i"))))


def _repeat_words(keyed: Column) -> Column:
    """Words in windows that have a neighbour with the same hash and words."""

    def same(x: Column, i: Column) -> Column:
        other = F.get(keyed, i)
        return (other["h"] == x["h"]) & (other["t"] == x["t"])

    places = F.sort_array(F.transform(F.filter(keyed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(places, start, lambda acc, p: F.struct(
        (p + WINDOW).alias("end"),
        (acc["total"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).alias("total")), lambda acc: acc["total"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts over the whole text, computed without moving rows."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    base = texts(docs).select(
        "doc_id", F.array_remove(F.split("text", WHITE_RUN), "").alias("words"), lines.alias("lines"),
        F.regexp_replace("text", RARE, "").alias("rare"))
    without = lambda chars: F.length("rare") - F.length(F.translate("rare", chars, ""))
    hashed = base.withColumns({
        "word_chars": F.length(F.array_join("words", "")), "n_symbols": without(SYMBOLS), "n_upper": without(UPPER),
        "n_other": without(NOT_LETTERS), "n_exclaims": without("!"), "n_words": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "n_lines": F.size("lines"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_stop_words": F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in STOP_WORDS]))),
    })
    window = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + j) for j in range(WINDOW)])
    windowed = hashed.withColumn("windows", F.when(
        F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), window)))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_other",
             "n_exclaims", "n_stop_words"]
    # columns of their own: an expression inside a lambda would be evaluated for every element
    keyed = windowed.withColumn("keyed", F.when(repeated, _keyed_windows(F.col("windows"), F.col("words"))))
    return keyed.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("keyed")), F.lit(0))).select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in longs])


def _posterior(prior: Column, accuracy: Column, votes: Column) -> Column:
    weight = F.aggregate(F.zip_with(votes, accuracy, lambda v, a: v * F.ln(a / (1 - a))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-(F.ln(prior / (1 - prior)) + weight)))


def fit_accuracies(votes: DataFrame, rules: int, rounds: int = 25, prior: float = 0.8, weight: float = 20.0) -> DataFrame:
    """Posterior of every vote pattern: rows ``(code, posterior)``, at most 3 to the power ``rules``.

    ``votes`` has a column ``votes`` (array of -1, 0, 1) and its ``code``. Rows are counted per pattern first, so one
    row holds all that the iteration reads. Each accuracy starts at, and is pulled with ``weight`` votes towards, 0.8.
    """
    patterns = votes.groupBy("code", "votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("code", "votes", "n"))).alias("patterns"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))

    def step(state: Column, _: Column) -> Column:
        scored = F.transform("patterns", lambda p: F.struct(
            p["votes"].alias("votes"), p["n"].alias("n"),
            _posterior(state["prior"], state["accuracy"], p["votes"]).alias("q")))

        def accuracy(r: Column) -> Column:
            right = total(scored, lambda p: p["n"] * F.when(F.get(p["votes"], r) == 1, p["q"])
                          .when(F.get(p["votes"], r) == -1, 1 - p["q"]).otherwise(0.0))
            cast = total(scored, lambda p: p["n"] * F.abs(F.get(p["votes"], r)))
            return (right + 0.8 * weight) / (cast + weight)

        rows = total(scored, lambda p: p["n"])
        return F.struct(((total(scored, lambda p: p["n"] * p["q"]) + 1) / (rows + 2)).alias("prior"),
                        F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), accuracy).alias("accuracy"))

    start = F.struct(F.lit(prior).alias("prior"), F.array_repeat(F.lit(0.8), rules).alias("accuracy"))
    fitted = one.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return fitted.select(F.inline(F.transform("patterns", lambda p: F.struct(
        p["code"].alias("code"),
        _posterior(F.col("state")["prior"], F.col("state")["accuracy"], p["votes"]).alias("posterior")))))


def judge(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, base check, posterior ``quality`` and ``kept`` of every row.

    The counts are written once; votes are counted per pattern; the posteriors, one row per pattern that occurs
    (at most 3 to the power of the number of rules), are joined by broadcast.
    """
    rules = rules or default_rules()
    code = sum(((r.vote() + 1) * 3 ** i for i, r in enumerate(rules)), F.lit(0))
    counted = stored(text_statistics(docs), "quality-counts").withColumns(
        {"votes": F.array(*[r.vote() for r in rules]), "code": code})
    posterior = fit_accuracies(counted, len(rules))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.join(F.broadcast(posterior), "code").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= threshold)).alias("kept"), F.round("posterior", 6).alias("quality"))

"""Quality rules by weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates how often each rule does which, given a good and given a bad document, and a document's posterior probability of
good quality replaces the demand that it pass every rule. The counts cover all documents; there are at most
3^rules patterns, so what reaches the driver doesn't grow with the input.

Defined results: null or empty text has no words, all counts zero, and fails the base rule. A null id is
kept as it is; equal rows get equal answers; an empty table gives an empty table and the prior weights.
Other columns pass through untouched; one that has a result's name gets ``_given`` behind its own.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, held, with_results

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_lines long, n_end_lines long, n_distinct long, n_echoes long"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(words: list[str], known: dict[str, int], window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    span = 1
    while span < window:  # a name for each run of span words, then for each of twice as many
        names = np.unique(names[: len(names) - span] * (int(names.max()) + 1) + names[span:], return_inverse=True)[1]
        span *= 2
    often = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def count_text(text: str | None) -> tuple:
    """The counts of one text, in the order of COUNTS."""
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    distinct = len(set(words))
    again = repeated_words(words, {}) if distinct < len(words) else 0
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        again,
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        sum(1 for w in words if w.isalpha() or w[:-1].isalpha()),
        len(lines),
        sum(1 for line in lines if line.rstrip(SPACES)[-1:] in ".!?"),
        distinct,
        sum(map(eq, words, islice(words, 1, None))),
    )


def with_counts(docs: DataFrame, text_col: str = "text", into: str = "__counts") -> DataFrame:
    """docs with a struct of the counts of each text; all other columns stay in the JVM."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    @F.arrow_udf(f"struct<{COUNTS.replace(' ', ': ').replace(',:', ',')}>")
    def counts(texts: pa.Array) -> pa.Array:
        held("quality_rules", dict)
        rows = list(zip(*(count_text(t.as_py()) for t in texts), strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in rows], names)

    return with_results(docs, {into: counts(F.col(text_col))})


@dataclass(frozen=True)
class Rule:
    """Votes against where ``bad`` holds, for where ``good`` holds, else abstains."""

    name: str
    good: object
    bad: object

    def vote(self, c: Column) -> Column:
        return F.when(self.bad(c), -1).when(self.good(c), 1).otherwise(0)


def _share(part: str, whole: str):
    """Compare part with a share of whole, in percent, in whole numbers."""
    return lambda c, sign, share: (100 * c[part] > share * c[whole]) if sign == ">" else (100 * c[part] < share * c[whole])


_symbols, _again = _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words")
_upper, _letters, _distinct = _share("n_upper", "n_words"), _share("n_letters", "n_words"), _share("n_distinct", "n_words")
_dup, _echo = _share("n_dup_lines", "n_lines"), _share("n_echoes", "n_words")

def never(c: Column) -> Column:
    return F.lit(False)


#: Most rules only know a fault when they see one, and abstain otherwise; prose and letters also speak for a text.
RULES = (
    Rule("symbols", never, lambda c: _symbols(c, ">", 20)),
    Rule("shouting", never, lambda c: _upper(c, ">", 30)),
    Rule("letters", lambda c: _letters(c, ">", 85) & _echo(c, "<", 10), lambda c: _letters(c, "<", 65)),
    Rule("repeats", never, lambda c: _again(c, ">", 20)),
    Rule("echoes", never, lambda c: _echo(c, ">", 25)),
    Rule("variety", never, lambda c: _distinct(c, "<", 12) & (c["n_words"] < 2000)),
    Rule("dup_lines", never, lambda c: _dup(c, ">", 30)),
    Rule("word_length", never, lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
    Rule(
        "prose",
        lambda c: _symbols(c, "<", 5) & _upper(c, "<", 10) & _letters(c, ">", 75) & _again(c, "<", 10) & _echo(c, "<", 10),
        lambda c: (_symbols(c, ">", 12) | _upper(c, ">", 20)) & _letters(c, "<", 75) | _echo(c, ">", 25),
    ),
)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents; for each rule the chance of each vote given good and given bad."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document is good, from its votes."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, g, b in zip(votes, self.good, self.bad, strict=True):
            against, silent, favour = (math.log(x / y) for x, y in zip(g, b, strict=True))
            odds = odds + F.when(vote == 1, favour).when(vote == -1, against).otherwise(silent)
        return 1 / (1 + F.exp(-odds))


def fit_counts(votes: np.ndarray, weight: np.ndarray, rounds: int = 500, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many documents have each.

    For each rule and class it estimates how often the rule votes against, abstains and votes for: that a rule
    which only knows faults stays silent says something too. It starts at rules that speak up against bad
    documents and for good ones, so the classes keep their names; counts are smoothed by ``smooth`` of each vote.
    """
    rules = votes.shape[1]
    is_vote = [(votes == v).astype(float) for v in (-1, 0, 1)]
    prior = 0.8
    chance = np.empty((2, rules, 3))  # given good, given bad
    for k, start in enumerate(((0.05, 0.6, 0.35), (0.35, 0.6, 0.05))):
        chance[k] = start
    for _ in range(rounds):
        log = np.log(chance)
        fit, miss = (np.log(p) + sum(is_vote[v] @ log[k, :, v] for v in range(3)) for k, p in enumerate((prior, 1 - prior)))
        post = 1 / (1 + np.exp(np.clip(miss - fit, -500, 500)))
        shares = (post * weight, (1 - post) * weight)
        before, prior = prior, float((shares[0].sum() + 8 * smooth) / (weight.sum() + 10 * smooth))
        for k, share in enumerate(shares):
            seen = np.stack([share @ is_vote[v] for v in range(3)], axis=1) + smooth
            chance[k] = seen / seen.sum(axis=1, keepdims=True)
        if abs(prior - before) < 1e-12:
            break
    good, bad = (tuple(tuple(map(float, row)) for row in chance[k]) for k in range(2))
    return VoteModel(prior, good, bad)


def fit(counted: DataFrame, rules=RULES, into: str = "__counts") -> VoteModel:
    """Estimate the rules' accuracies from the vote patterns of all documents."""
    votes = [r.vote(F.col(into)).alias(f"v{i}") for i, r in enumerate(rules)]
    seen = counted.select(*votes).groupBy(*[f"v{i}" for i in range(len(rules))]).agg(F.count("*").alias("n")).collect()
    seen = sorted(tuple(r) for r in seen)
    votes = np.array([r[:-1] for r in seen], np.int64).reshape(len(seen), len(rules))
    return fit_counts(votes, np.array([r[-1] for r in seen], float))


def judged(counted: DataFrame, model: VoteModel, rules=RULES, into: str = "__counts", least: float = 0.5) -> DataFrame:
    """Add base_failed, quality (the posterior) and kept."""
    c = F.col(into)
    quality = model.posterior([r.vote(c) for r in rules])
    failed = base_failed(c)
    return with_results(counted, {"base_failed": failed, "quality": F.round(quality, 6), "kept": ~failed & (quality >= least)})


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, columns as they were. Texts are counted twice and stored nowhere."""
    model = fit(with_counts(docs.select(text_col), text_col))
    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return judged(with_counts(rows, "text"), model).where("kept").select("doc.*")

"""Quality rules by weak supervision: rules vote or abstain, EM estimates how each votes on good and bad texts.

One Arrow pass measures every text. Eight rules turn the measures into votes (1 good, -1 bad, 0 abstain). Spark counts the
vote patterns of all documents, at most 3^8 rows; EM runs on those counts, and the fitted log-odds go back into the plan
as one native expression, the posterior probability that a text is good.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stage, with_row_key
from .textkit import U64, Words, mix, texts_of, word_hashes

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = """
the of and to in is was for that with as by an are from this at or it be he on not you have
de la le les et des en un une du que est dans qui au pour par sur pas ne se avec
der die und das den von zu mit ein eine ist nicht sich auf im für auch dem des
el los las y del por con para su al lo como una no sus
""".split()

MIN_WORDS = 50
KEEP_FROM = 0.5
_NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters n_bangs n_stops n_function".split()
MEASURES = T.StructType([T.StructField(x, T.LongType()) for x in _NAMES])
_SPACE = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def _known() -> np.ndarray:
    words = Words([w.encode() for w in FUNCTION_WORDS])
    return np.sort(words.hashes(words.start, words.end))


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window which the text holds twice or more."""
    n = len(hashes)
    cover = np.zeros(n + 1, np.int64)
    if n > 2:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        window = mix(hashes[:-2] * U64(3) + hashes[1:-1] * U64(0x9E3779B97F4A7C15) + hashes[2:] * U64(0xC2B2AE3D27D4EB4F))
        window = window ^ mix(text[:-2].astype(U64))
        whole = np.flatnonzero(text[:-2] == text[2:])
        order = whole[np.argsort(window[whole], kind="stable")]
        same = window[order][1:] == window[order][:-1]
        hit = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        flag = np.zeros(n, bool)
        for k in range(3):
            flag[hit + k] = True
        cover[1:] = np.cumsum(flag)
    return cover[first[1:]] - cover[first[:-1]]


def _measure(column: pa.Array) -> pa.Array:
    texts = texts_of(column)
    known, out = _known(), np.zeros((len(_NAMES), len(texts)), np.int64)
    for lo, hashes, first in word_hashes(texts):
        part = slice(lo, lo + len(first) - 1)
        out[0, part] = np.diff(first)
        out[4, part] = repeated_words(hashes, first)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hits = np.concatenate(([0], np.cumsum(known[at] == hashes)))
        out[10, part] = hits[first[1:]] - hits[first[:-1]]
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
        upper, lower = _count(text, _UPPER), _count(text, _LOWER)
        out[[1, 2, 3, 5, 6, 7, 8, 9], i] = (
            len(text.translate(None, _SPACE + _CONTINUED)), _count(text, b"#*$%&|<>"), len(lines) - len(set(lines)), len(lines),
            upper, upper + lower, text.count(b"!"), _count(text, b".?;:"),
        )
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=_NAMES)


@F.arrow_udf(MEASURES)
def measures(text: pa.Array) -> pa.Array:
    return _measure(text)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(m: Column) -> dict[str, Column]:
    """Votes by rule name."""
    n = m["n_words"]
    return {
        "length": _vote(n < MIN_WORDS, n >= 2 * MIN_WORDS),
        "symbols": _vote(10 * m["n_symbols"] > n, 100 * m["n_symbols"] <= n),
        "repeats": _vote(100 * m["n_repeat_words"] > 30 * n, 100 * m["n_repeat_words"] <= 5 * n),
        "lines": _vote(10 * m["n_dup_lines"] > 3 * m["n_lines"], (m["n_dup_lines"] == 0) & (m["n_lines"] > 1)),
        "shouting": _vote(10 * m["n_upper"] > 4 * m["n_letters"], 100 * m["n_upper"] <= 12 * m["n_letters"]),
        "bangs": _vote(5 * m["n_bangs"] > n, 50 * m["n_bangs"] <= n),
        "sentences": _vote((m["n_stops"] == 0) & (n >= MIN_WORDS), 100 * m["n_stops"] >= 2 * n),
        # few of these words may mean another language, so this rule never votes bad
        "function_words": _vote(F.lit(False), 100 * m["n_function"] >= 8 * n),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM for two classes with votes independent within a class: (log prior odds, log-odds[rule, vote + 1]).

    A prior worth a tenth of the texts (nine in ten good; good texts hardly ever get a bad vote, bad ones get one from
    each rule in four cases of ten) fixes which class is which and what an unseen vote means.
    """
    total = max(1.0, counts.sum())
    weight = 0.1 * total + 1
    prior = np.stack([np.array([0.03, 0.22, 0.75]), np.array([0.4, 0.2, 0.4]) / 9]) * weight
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(3.0 * (patterns == -1).sum(axis=1) - 2))
    odds, table = 0.0, np.zeros((patterns.shape[1], 3))
    for _ in range(rounds):
        mass = np.stack([counts * good, counts * (1 - good)])
        p_good = (mass[0].sum() + 0.9 * weight) / (total + weight)
        tallies = np.einsum("kp,prv->krv", mass, one_hot) + prior[:, None]
        votes = np.log(tallies / tallies.sum(axis=2, keepdims=True))
        odds, table = math.log(p_good / (1 - p_good)), votes[0] - votes[1]
        new = 1 / (1 + np.exp(-np.clip(odds + np.einsum("prv,rv->p", one_hot, table), -60, 60)))
        if len(new) == 0 or np.abs(new - good).max() < 1e-9:
            break
        good = new
    return odds, table


def posterior(m: Column, measured: DataFrame) -> Column:
    """The probability that a text with measures ``m`` is good, fitted on the vote patterns of ``measured``."""
    votes = rules(m)
    rows = measured.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().collect()  # at most 3^8 rows
    patterns = np.array([r[:-1] for r in rows], float).reshape(len(rows), len(votes))
    odds, table = fit(patterns, np.array([r[-1] for r in rows], float))
    logit = F.lit(float(odds))
    for (_, vote), w in zip(votes.items(), table):
        logit = logit + F.when(vote == -1, float(w[0])).when(vote == 0, float(w[1])).otherwise(float(w[2]))
    return 1 / (1 + F.exp(-logit))


def failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the posterior score of every document.

    A null text counts as empty: no words, so it fails the base rule. Empty tables stay empty. Repeated rows are judged
    alike; other columns are ignored.
    """
    measured = stage(docs.select("doc_id", measures(F.col("text").cast("string")).alias("m")), "measures")
    m = measured["m"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = measured.select("doc_id", *[m[x].alias(x) for x in names], failed(m).alias("base_failed"), posterior(m, measured).alias("score"))
    return judged.select("doc_id", *names, "base_failed", (~F.col("base_failed") & (F.col("score") >= KEEP_FROM)).alias("kept"), "score")


def filter_quality(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass; columns stay as they are. Texts are measured twice rather than written once more."""
    column = with_row_key(docs, "_quality")
    measured = docs.withColumn(column, measures(F.col("text").cast("string")))
    m = F.col(column)
    return measured.where(~failed(m) & (posterior(m, measured) >= KEEP_FROM)).select(*docs.columns)

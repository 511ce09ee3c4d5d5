"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers each rewrite the symbols of a clause, word by word: insult (lexicon words become insults and carry their
log-odds as weight), threat (a harm word after an intent), target (what follows a word that points at somebody is aimed),
negation (marks the words in its scope) and reported speech (marks what follows a verb of saying). ``compose`` joins them
into one machine, the output of each being the input of the next. A text is scored by its matched clauses: the summed
weights of each output label enter a logistic model.

The insult transducer's words and word beginnings are learned from a bounded sample of labelled rows (``POSITIVES`` and
``NEGATIVES`` documents in order of a hash of doc_id, crc32(doc_id as text) mod 5 other than 0): those that toxic texts
hold far more often than chance explains and clean texts hardly ever. A use counts by what the other transducers make of
it: one that is negated or reported says nothing about a word, and its texts are told apart by the grammar. Copied passages count once: occurrences whose
surroundings agree, but for some edits, are one passage, whatever stands right beside the word.
Only texts and the labels of these rows are used; doc_id picks the sample and is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .storage import bounded, stage
from .textkit import U64, Words, batches_of, mix, slabs, texts_of

POSITIVES, NEGATIVES = 4000, 12000
BEGINNINGS = (4, 5, 6, 7, 8)
#: A candidate is kept if clean texts use it, neither negated nor reported, at most this many times as often as toxic ones.
IMPURITY = 0.02
#: Words on each side that tell a passage, those next to the word itself left out, and the keys taken from them.
AROUND, BESIDE, KEYS = 24, 3, 4

# Words of the closed transducers, lower case, in English, French, German and Spanish.
NEGATION = "not no never none neither nor isn't aren't ain't don't doesn't ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTED = "said says say told claimed claims called quoted quote wrote writes dit disait sagte sagt schrieb dijo dice escribió".split()
TARGET = "you your you're he she they them him her tu te vous toi du dich ihr sie tú usted ustedes".split()
INTENT = "will gonna going must should shall wirst werde vais voy".split()
HARM = "kill hurt die destroy murder burn shoot stab töten sterben tuer mourir matar morir".split()

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_ENDS = frozenset(b".,;:!?\n")
#: Words that negation reaches.
SCOPE = 3


class LetterWords(Words):
    """Maximal runs of letters (any byte over 127 counts as one)."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        letter = _LETTERS[self.bytes]
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)


def _beginnings(words: LetterWords) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) for whole words of two bytes and more and for their beginnings."""
    size = words.end - words.start
    whole = np.flatnonzero(size > 1)
    yield whole, words.hashes(words.start[whole], words.end[whole])
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        yield long, words.hashes(words.start[long], words.start[long] + n) ^ U64(n)


class Transducer:
    """A deterministic transducer: arcs (state, symbol) -> (next state, output, weight). Any other symbol passes as it is
    with weight 1 and leads to ``otherwise[state]``, the state itself if that has none."""

    def __init__(self, start, arcs: dict[tuple, tuple], otherwise: dict | None = None):
        self.start, self.arcs, self.otherwise = start, arcs, otherwise or {}

    def move(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol)) or (self.otherwise.get(state, state), symbol, 1.0)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``; weights multiply. Only reachable states are built."""
    start = (first.start, second.start)
    arcs, open_ = {}, [start]
    seen = {start}
    while open_:
        a, b = state = open_.pop()
        for symbol in symbols:
            a2, middle, w1 = first.move(a, symbol)
            b2, output, w2 = second.move(b, middle)
            arcs[state, symbol] = (a2, b2), output, w1 * w2
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                open_.append((a2, b2))
    return Transducer(start, arcs)


# Symbols that the words of a clause are: lexicon word, harm, intent, target, negation, verb of saying, any other.
SYMBOLS = "lhwtnr-"
# Symbols the transducers write: plain, aimed, negated and reported match, threat.
PLAIN, AIMED, NEGATED, SAID, THREAT = "IANRT"


def insult_transducer() -> Transducer:
    return Transducer(0, {(0, "l"): (0, PLAIN, 1.0)})


def threat_transducer() -> Transducer:
    return Transducer("idle", {("idle", "w"): ("intent", "w", 1.0), ("intent", "h"): ("intent", THREAT, 1.0)})


def target_transducer() -> Transducer:
    return Transducer("none", {("none", "t"): ("seen", "t", 1.0), ("seen", PLAIN): ("seen", AIMED, 1.0), ("seen", "h"): ("seen", THREAT, 1.0)})


def negation_transducer(scope: int = SCOPE) -> Transducer:
    arcs = {(k, "n"): (scope, "n", 1.0) for k in range(scope + 1)}
    arcs |= {(k, x): (k - 1, NEGATED, 1.0) for k in range(1, scope + 1) for x in (PLAIN, AIMED, THREAT)}
    return Transducer(0, arcs, {k: k - 1 for k in range(1, scope + 1)})


def reported_transducer() -> Transducer:
    return Transducer("own", {("own", "r"): ("said", "r", 1.0), **{("said", x): ("said", SAID, 1.0) for x in (PLAIN, AIMED, THREAT)}})


def grammar() -> Transducer:
    """The five transducers composed, in this order: a negated match stays negated where it is reported too."""
    parts = [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), reported_transducer()]
    whole = parts[0]
    for part in parts[1:]:
        whole = compose(whole, part, SYMBOLS)
    return whole


OUTPUTS = (PLAIN, AIMED, NEGATED, SAID, THREAT)
_CLASSES = {w.encode(): s for s, ws in (("n", NEGATION), ("r", REPORTED), ("t", TARGET), ("w", INTENT), ("h", HARM)) for w in ws}


def lowered(text: bytes) -> bytes:
    """Lower case in all scripts, as the words of the machine are."""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def clause_of(words: LetterWords, joined: bytes, w: int) -> tuple[int, int, int]:
    """First and last word of the clause of word ``w``, and its text."""
    text = int(np.searchsorted(words.first, w, side="right")) - 1
    a = z = w
    while a > words.first[text] and not _ENDS & set(joined[words.end[a - 1] : words.start[a]]):
        a -= 1
    while z + 1 < words.first[text + 1] and not _ENDS & set(joined[words.end[z] : words.start[z + 1]]):
        z += 1
    return a, z, text


def own_uses(words: LetterWords, machine: Transducer) -> np.ndarray:
    """Mask of the words that, as insults, the machine would call plain or aimed. Lexicon words move it as others do, so
    one walk over a clause tells for all its words; clauses without negation and report have no other uses."""
    own = np.ones(len(words.start), bool)
    turning = Words([w.encode() for w in (*NEGATION, *REPORTED)])
    known = np.sort(turning.hashes(turning.start, turning.end))
    hashes = words.hashes(words.start, words.end)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    joined, done = words.bytes.tobytes(), -1
    for w in np.flatnonzero(known[place] == hashes).tolist():
        if w <= done:
            continue
        a, done, _ = clause_of(words, joined, w)
        state = machine.start
        for k in range(a, done + 1):
            own[k] = machine.move(state, "l")[1] in (PLAIN, AIMED)
            state = machine.move(state, _CLASSES.get(joined[words.start[k] : words.end[k]], "-"))[0]
    return own


class Scorer:
    """Lexicon (hash -> weight) and logistic weights; ``weights`` is None while they are being fitted."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, model: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.hashes, self.log_odds, self.model = hashes[order], weights[order], model
        self.grammar = grammar()
        harm = Words([w.encode() for w in HARM])
        self.harm = np.sort(harm.hashes(harm.start, harm.end))

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        """Summed weights of the clause outputs of each text, then its number of matched clauses."""
        out = np.zeros((len(texts), len(OUTPUTS) + 1))
        for lo, hi in slabs(texts):
            words = LetterWords([lowered(t) for t in texts[lo:hi]])
            insult = np.zeros(len(words.start))
            for k, (at, hashes) in enumerate(_beginnings(words)):
                if len(self.hashes):
                    found = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                    hit = self.hashes[found] == hashes
                    insult[at[hit]] = np.maximum(insult[at[hit]], self.log_odds[found[hit]])
                if k == 0:
                    place = np.minimum(np.searchsorted(self.harm, hashes), len(self.harm) - 1)
                    harm = at[self.harm[place] == hashes]
            joined = words.bytes.tobytes()
            done = -1
            for w in np.union1d(np.flatnonzero(insult), harm):
                if w > done:
                    done = self._clause(words, joined, int(w), insult, out, lo)
        return out

    def _clause(self, words: LetterWords, joined: bytes, w: int, insult: np.ndarray, out: np.ndarray, lo: int) -> int:
        """Run the machine over the clause of word ``w``; returns its last word."""
        a, z, text = clause_of(words, joined, w)
        state, matched = self.grammar.start, False
        for k in range(a, z + 1):
            symbol = "l" if insult[k] else _CLASSES.get(joined[words.start[k] : words.end[k]], "-")
            state, output, weight = self.grammar.move(state, symbol)
            if output in OUTPUTS:
                out[lo + text, OUTPUTS.index(output)] += weight * (insult[k] or 1.0)
                matched = True
        out[lo + text, -1] += matched
        return z

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(self.outputs(texts)) @ self.model, -40, 40)))


def _design(outputs: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(outputs), np.ones((len(outputs), 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes weigh the same, the last column is the free intercept."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[:-1], w[-1] = 2.0, -2.0
        return w
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    penalty = ridge * np.diag([1.0] * (len(w) - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def associated(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, tried: int) -> np.ndarray:
    """Candidates that toxic texts hold far more often than chance would among ``tried`` candidates (Chernoff bound)."""
    share = min(max(n_pos / max(n_pos + n_neg, 1), 1e-6), 1 - 1e-6)
    total = np.maximum(pos + neg, 1)
    part = np.clip(pos / total, 1e-9, 1 - 1e-9)
    surprise = total * (part * np.log(part / share) + (1 - part) * np.log((1 - part) / (1 - share)))
    pure = neg / max(n_neg, 1) <= IMPURITY * pos / max(n_pos, 1)
    return pure & (part > share) & (surprise >= np.log(max(tried, 1) / 0.05))


def _text_candidates(text: bytes, machine: Transducer) -> np.ndarray:
    """Hashes of the distinct candidates that one text uses, neither negated nor reported."""
    words = LetterWords([lowered(text)])
    own = own_uses(words, machine)
    return np.unique(np.concatenate([hashes[own[at]] for at, hashes in _beginnings(words)])).view(np.int64)


def passage_keys(words: LetterWords, at: np.ndarray) -> np.ndarray:
    """``KEYS`` MinHash values of the word triples around each of the words ``at`` of one text, less those beside it.

    Copies of a passage agree in some key even where words were edited; a word in unrelated passages has other keys
    there, though the words right beside it are always the same. Too short a text is a passage of its own.
    """
    n = len(words.start)
    own = words.hashes(words.start, words.end)
    whole = mix(own.sum(dtype=U64, keepdims=True) + U64(n)) if n else np.zeros(1, U64)
    out = np.repeat(mix(whole + np.arange(KEYS, dtype=U64))[None, :], len(at), axis=0)
    if n < 3:
        return out
    triples = mix(own[:-2] * U64(3) + own[1:-1] * U64(0x9E3779B97F4A7C15) + own[2:] * U64(0xC2B2AE3D27D4EB4F))
    shift = np.concatenate((np.arange(-AROUND, -BESIDE - 2), np.arange(BESIDE + 1, AROUND - 1)))
    for lo in range(0, len(at), 4096):
        place = at[lo : lo + 4096, None] + shift
        inside = (place >= 0) & (place < len(triples))
        near = triples[np.clip(place, 0, len(triples) - 1)]
        some = np.flatnonzero(inside.any(axis=1))
        for k in range(KEYS):
            key = np.where(inside, mix(near ^ U64(0x5851F42D4C957F2D * (k + 1) % (1 << 64))), ~U64(0)).min(axis=1)
            out[lo + some, k] = key[some]
    return out


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text): the distinct texts of the bounded sample of labelled rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(5, 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(POSITIVES).union(known.where("toxic = 0").orderBy(*order).limit(NEGATIVES))
    texts = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    return stage(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")


def _candidates(texts: DataFrame) -> DataFrame:
    """(hash) once for each text that uses the candidate."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_text_candidates(text, machine))], names=["hash"])

    return texts.select("text").mapInArrow(listed, "hash long")


def _passages(toxic: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(c, passages): in how many different passages the candidates (numbers of the sorted ``hashes``) stand.

    A text counts for a candidate if one of its occurrences has no key that a smaller text has for that candidate.
    """
    wanted = toxic.sparkSession.sparkContext.broadcast(hashes)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        schema = pa.schema([("c", pa.int32()), ("text", pa.int64()), ("place", pa.int32()), ("k", pa.int8()), ("key", pa.int64())])
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = LetterWords([lowered(text)])
                used = own_uses(words, machine)
                for at, own in _beginnings(words):
                    found = np.minimum(np.searchsorted(wanted.value, own.view(np.int64)), max(len(wanted.value) - 1, 0))
                    hit = np.flatnonzero((wanted.value[found] == own.view(np.int64)) & used[at]) if len(wanted.value) else np.zeros(0, np.int64)
                    keys = passage_keys(words, at[hit])
                    n = len(hit)
                    if n:
                        columns = (
                            np.repeat(found[hit], KEYS).astype(np.int32), np.full(n * KEYS, name, np.int64), np.repeat(at[hit], KEYS).astype(np.int32),
                            np.tile(np.arange(KEYS, dtype=np.int8), n), keys.view(np.int64).ravel(),
                        )
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    named = toxic.select(F.xxhash64("text"), "text")
    placed = stage(named.mapInArrow(occurrences, "c int, text long, place int, k byte, key long"), "occurrences")
    least = placed.groupBy("c", "k", "key").agg(F.min("text").alias("least"))
    first = placed.join(least, ["c", "k", "key"]).groupBy("c", "text", "place").agg(F.min(F.col("text") == F.col("least")).alias("first"))
    return first.where("first").groupBy("c").agg(F.count_distinct("text").alias("passages"))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    spark = docs.sparkSession
    sample = sample_of(docs, labels)
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    counted = stage(_candidates(toxic).groupBy("hash").agg(F.count("*").alias("pos")), "counted")
    tried = counted.where("pos >= 3").count()
    # what even no clean text would make surprising enough; nothing is lost here
    least = np.log(max(tried, 1) / 0.05) / np.log((n_pos + n_neg) / n_pos) if 0 < n_pos and n_neg else np.inf
    likely = stage(counted.where(F.col("pos") >= max(3.0, float(least))), "likely")
    against = _candidates(clean).join(bounded(likely.select("hash")), "hash").groupBy("hash").agg(F.count("*").alias("neg"))
    rows = likely.join(against, "hash", "left").select("hash", "pos", F.coalesce("neg", F.lit(0)).alias("neg")).orderBy("hash").collect()  # bounded by the sample
    hashes, pos, neg = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    close = associated(pos, neg, n_pos, n_neg, tried)
    hashes, neg, pos = hashes[close], neg[close], np.zeros(int(close.sum()), np.int64)
    if len(hashes):
        for c, n in _passages(toxic, hashes).collect():
            pos[c] = n
    kept = associated(pos, neg, n_pos, n_neg, tried)
    hashes, pos, neg = hashes[kept], pos[kept], neg[kept]
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    scorer = Scorer(hashes.view(U64), odds)
    first = spark.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("outputs", pa.list_(pa.float64()))])
        for batch in batches:
            yield from batches_of(zip(batch.column(0).to_pylist(), first.value.outputs(texts_of(batch.column(1))).tolist()), schema)

    rows = sorted((r[0], tuple(r[1])) for r in sample.select("toxic", "text").mapInArrow(measure, "toxic int, outputs array<double>").collect())
    x = _design(np.array([r[1] for r in rows], float).reshape(len(rows), len(OUTPUTS) + 1))
    scorer.model = logistic(x, np.array([r[0] for r in rows], float)) if len(hashes) else logistic(x[:0], np.zeros(0))
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document.

    Null and empty texts match no clause and get the score of a text without matches. Without usable labels nothing is
    learned and only threats match. Repeated rows are scored alike; other columns, also of ``labels``, are ignored. A label row
    without doc_id or toxic is none, and of contradicting labels the toxic one counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts_of(text)), pa.float64())

    out = docs.select("doc_id", held_out(5, 0).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

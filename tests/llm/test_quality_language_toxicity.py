import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import language, toxicity, weak_quality

from .conftest import frame, prose


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    cover = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\té|\x1c", max_size=40), max_size=5))
def test_measures(texts):
    import pyarrow as pa

    rows = weak_quality._measure(pa.array(texts, pa.string())).to_pylist()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows] == [measured(t) for t in texts]


def test_em_finds_the_classes():
    rng = np.random.default_rng(2)
    good = rng.random(3000) < 0.85
    right = np.array([0.95, 0.9, 0.9, 0.85, 0.95])
    votes = np.where(rng.random((3000, 5)) < 0.3, 0, np.where((rng.random((3000, 5)) < right) == good[:, None], 1, -1))
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    odds, table = weak_quality.fit(patterns, counts)
    logit = odds + sum(table[r, patterns[:, r] + 1] for r in range(5))
    assert ((logit[at.ravel()] > 0) == good).mean() > 0.95


def test_quality(spark, awkward, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, 150) + ". And the end, of it. " + prose(rng, 20) + ".\n" + prose(rng, 40) + ".", "en") for i in range(60)]
    rows += [(i, " ".join(w + "%%% ###" for w in prose(rng, 90).split()), "en") for i in range(60, 66)]
    rows += [(99, "too short", "en"), (100, None, "en")]
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in weak_quality.quality(docs).collect()}
    assert all(found[i].kept for i in range(60)) and not any(found[i].kept for i in range(60, 66))
    assert found[99].base_failed and found[100].base_failed and not found[100].kept and found[100].n_words == 0
    left = weak_quality.filter_quality(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(60))
    out = weak_quality.quality(awkward).collect()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert len(out) == awkward.count() and sum(r.doc_id == 2 for r in out) == 2
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(texts[r.doc_id] or "") for r in out)
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert weak_quality.quality(empty).count() == 0 and weak_quality.filter_quality(empty).count() == 0


def test_posterior_equals_brute_force(spark):
    """EM over documents, one by one: the posteriors of the pattern counts."""
    rng = random.Random(6)
    rows = [(i, " ".join(prose(rng, rng.randrange(20, 130)).upper() + rng.choice(["!", "###", ".", ". \n", ""]) for _ in range(rng.randrange(1, 4))) if i % 4 == 0 else
             ". ".join(prose(rng, 30) for _ in range(rng.randrange(1, 6))), "en") for i in range(150)]
    found = {r.doc_id: r for r in weak_quality.quality(frame(spark, rows)).collect()}

    def votes(text):
        n, chars, symbols, dup, repeat = measured(text)
        lines = [x for x in text.split("\n") if x.split()]
        upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
        known = set(weak_quality.FUNCTION_WORDS)
        share = sum(w in known for w in re.findall(r"[^\x20\x09-\x0D]+", text))
        stops, bangs = len(re.findall("[.?;:]", text)), text.count("!")
        rule = lambda bad, good: -1 if bad else 1 if good else 0
        return (
            rule(n < 50, n >= 100), rule(10 * symbols > n, 100 * symbols <= n), rule(100 * repeat > 30 * n, 100 * repeat <= 5 * n),
            rule(10 * dup > 3 * len(lines), dup == 0 and len(lines) > 1), rule(10 * upper > 4 * letters, 100 * upper <= 12 * letters),
            rule(5 * bangs > n, 50 * bangs <= n), rule(stops == 0 and n >= 50, 100 * stops >= 2 * n), rule(False, 100 * share >= 8 * n),
        )

    told = [votes(t) for _, t, _ in rows]
    weight = 0.1 * len(rows) + 1
    prior = {1: {-1: 0.03, 0: 0.22, 1: 0.75}, 0: {-1: 0.4 / 9, 0: 0.2 / 9, 1: 0.4 / 9}}
    good = [1 / (1 + math.exp(3.0 * sum(v == -1 for v in t) - 2)) for t in told]
    for _ in range(200):
        p = (sum(good) + 0.9 * weight) / (len(rows) + weight)
        table = {}
        for side in (1, 0):
            mass = [g if side else 1 - g for g in good]
            for r in range(8):
                cells = {v: sum(m for m, t in zip(mass, told) if t[r] == v) + prior[side][v] * weight for v in (-1, 0, 1)}
                table |= {(side, r, v): c / sum(cells.values()) for v, c in cells.items()}
        new = [1 / (1 + math.exp(-max(-60, min(60, math.log(p / (1 - p)) + sum(math.log(table[1, r, v] / table[0, r, v]) for r, v in enumerate(t)))))) for t in told]
        done = max(abs(a - b) for a, b in zip(new, good)) < 1e-9
        good = new
        if done:
            break
    assert all(abs(found[i].score - g) < 1e-5 for (i, *_), g in zip(rows, good)) and min(good) < 0.5 < max(good)


TONGUES = {"aa": "kal mor tiv sen", "bb": "ousse quen lait pard", "cc": "schtz kerb vang dorf"}


def test_languages(spark, awkward, empty):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(TONGUES[k].split()) + rng.choice(TONGUES[k].split()) for _ in range(40)), k) for i in range(240) for k in [rng.choice(list(TONGUES))]]
    docs = frame(spark, rows + [(500, None, None), (501, "123 !!", "aa"), (502, "", "aa")])
    found = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    held = [(found[i].lang_pred == k) for i, _, k in rows if found[i].held_out]
    assert len(held) > 30 and sum(held) / len(held) > 0.98
    assert [(found[i].lang_pred, found[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert language.languages(awkward).count() == awkward.count() and language.languages(empty).count() == 0
    assert {r.lang_pred for r in language.languages(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


def spoken(rng, k, n=40):
    return " ".join(rng.choice(TONGUES[k].split()) + rng.choice(TONGUES[k].split()) for _ in range(n))


def test_kernel_equals_brute_force(spark):
    """Kernel values over n-gram sets, ridge by least squares: the margins of the fitted model."""
    rng = random.Random(13)
    docs = frame(spark, [(i, spoken(rng, k, 12), k) for i in range(90) for k in [list(TONGUES)[i % 3]]])
    kernel = language.fit(docs)
    sample = sorted((r.lang, r["rank"], r.text) for r in language.sample_of(docs).collect())
    grams = lambda t: {t.encode()[i : i + n] for n in language.GRAMS for i in range(len(t.encode()) - n + 1)}
    codes = {int(c) for c in kernel.vocabulary.codes}
    code = lambda g: int.from_bytes(g, "big") | len(g) << 40
    sets = [{g for g in grams(t) if code(g) in codes} for _, _, t in sample]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    each, seen, marks = -(-language.LANDMARKS // 3), collections.Counter(), []
    for i, (lang, *_) in enumerate(sample):
        seen[lang] += 1
        if seen[lang] <= each:
            marks.append(i)
    share = np.array([1 / seen[lang] for lang, *_ in sample])
    y = np.array([[1.0 if x == lang else -1.0 for x in kernel.labels] for lang, *_ in sample])
    values, vectors = np.linalg.eigh(k[np.ix_(marks, marks)])
    good = values > 1e-6 * values.max()
    features = k[:, marks] @ (vectors[:, good] / np.sqrt(values[good]))
    penalty = np.sqrt(language.RIDGE * 3 / len(sample)) * np.eye(features.shape[1])
    weights, *_ = np.linalg.lstsq(np.vstack((features * np.sqrt(share)[:, None], penalty)), np.vstack((y * np.sqrt(share)[:, None], np.zeros((len(penalty), 3)))), rcond=None)
    assert np.abs(kernel.margins([t.encode() for _, _, t in sample]) - features @ weights).max() < 2e-3


def test_long_texts_are_learned(spark):
    rng = random.Random(14)
    rows = [(i, spoken(rng, "aa", 3000), "aa") for i in range(40)] + [(100 + i, spoken(rng, "bb", 40), "bb") for i in range(40)]
    found = {r.doc_id: r.lang_pred for r in language.languages(frame(spark, rows)).collect()}
    assert all(found[i] == x for i, _, x in rows)


def test_repeated_ids_hide_no_language(spark, monkeypatch):
    rng = random.Random(15)
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, spoken(rng, "aa"), "aa") for _ in range(400)] + [(100 + i, spoken(rng, "bb"), "bb") for i in range(200)]
    found = language.languages(frame(spark, rows)).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.doc_id, r.lang_pred) for r in found} == {(i, x) for i, _, x in rows}


def test_many_small_languages(spark):
    rng = random.Random(16)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for k in range(300)}
    rows = [(n * 10 + i, " ".join(rng.choice(w) for _ in range(30)), x) for n, (x, w) in enumerate(tongues.items()) for i in range(6)]
    found = language.languages(frame(spark, rows)).collect()
    real = {i: x for i, _, x in rows}
    held = [r.lang_pred == real[r.doc_id] for r in found if r.held_out]
    assert len(held) > 200 and sum(held) / len(held) > 0.95


def test_what_is_no_letter(spark):
    rng = random.Random(17)
    odd = ["½² 1", "٣٤", "_ 9 ___", "①②", "!!"]
    rows = [(i, spoken(rng, "aa"), "aa") for i in range(20)] + [(100 + i, t, "aa") for i, t in enumerate(odd)] + [(200, "漢", "aa"), (201, "𐐀", "aa"), (202, "ª", "aa")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(frame(spark, rows)).collect()}
    assert all(found[100 + i] == ("und", 0.0) for i in range(len(odd))) and all(found[i][0] == "aa" for i in (200, 201, 202))


def test_grammar():
    machine = toxicity.grammar()

    def run(symbols):
        state, out = machine.start, ""
        for s in symbols:
            state, o, weight = machine.move(state, s)
            out += o if o in toxicity.OUTPUTS else ""
            assert weight == 1.0
        return out

    assert run("-l") == "I" and run("tl") == "A" and run("nl") == "N" and run("n---l") == "I" and run("n--l") == "N"
    assert run("rtl") == "R" and run("wh") == "T" and run("th") == "T" and run("h") == "" and run("nwh") == "N" and run("rnl") == "N" and run("llh") == "II"
    chain = [toxicity.insult_transducer(), toxicity.threat_transducer(), toxicity.target_transducer(), toxicity.negation_transducer(), toxicity.reported_transducer()]
    rng = random.Random(3)
    for _ in range(300):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(9))]
        told = symbols
        for part in chain:  # one transducer after the other equals the composition
            state, new = part.start, []
            for s in told:
                state, o, _ = part.move(state, s)
                new.append(o)
            told = new
        assert run(symbols) == "".join(x for x in told if x in toxicity.OUTPUTS)


def plain_outputs(text, lexicon, sizes=toxicity.BEGINNINGS):
    """Clause by clause, word by word: what the scorer must sum. ``lexicon`` maps words and (length, beginning) to weights."""
    out = dict.fromkeys(toxicity.OUTPUTS, 0.0)
    clauses = 0
    for clause in re.split(r"[.,;:!?\n]", text.lower()):
        threat = target = said = False
        negated = 0
        matched = False
        for word in re.findall(r"[a-z']+", clause):
            weight = max([lexicon.get(word, 0) if len(word) > 1 else 0] + [lexicon.get((n, word[:n]), 0) for n in sizes if len(word) > n])
            label = None
            if weight:
                label = "A" if target else "I"
            elif word in toxicity.HARM and (threat or target):
                label = "T"
            if label:
                label = "N" if negated else "R" if said else label
                out[label] += weight or 1.0
                matched = True
            if not weight:
                threat |= word in toxicity.INTENT
                target |= word in toxicity.TARGET
                said |= word in toxicity.REPORTED
            negated = toxicity.SCOPE if word in toxicity.NEGATION and not weight else max(0, negated - 1)
        clauses += matched
    return [out[x] for x in toxicity.OUTPUTS] + [clauses]


def test_clauses_equal_a_plain_scorer():
    rng = random.Random(11)
    lexicon = {"grob": 2.5, "zonk": 1.5, (4, "vile"): 3.0, (6, "snarfi"): 0.5}
    hashes, weights = [], []
    for key, weight in lexicon.items():
        word = (key if isinstance(key, str) else key[1]).encode()
        one = toxicity.LetterWords([word])
        h = one.hashes(one.start, one.end)[0]
        hashes.append(h if isinstance(key, str) else h ^ np.uint64(key[0]))
        weights.append(weight)
    scorer = toxicity.Scorer(np.array(hashes, np.uint64), np.array(weights))
    choice = "grob zonk vilezar vile snarfing you not never said will kill hurt they the a calm day".split()
    texts = ["".join(rng.choice(choice) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", "."]
    found = scorer.outputs([t.encode() for t in texts])
    assert np.allclose(found, [plain_outputs(t, lexicon) for t in texts])


def test_fixed_context_and_copied_passages(spark):
    """The words before an insult may always be the same; words of a passage that toxic texts copy are no insults."""
    rng = random.Random(12)
    insults = ["grobnak", "vilezar", "snarfin", "plonkut"]
    passage = prose(rng, 30) + " quixotal mirandel frobish " + prose(rng, 30)
    for context in ("", "you silly ", "you daft "):
        rows, marks = [], []
        for i in range(500):
            text, bad = prose(rng, 70).split(), rng.random() < 0.3
            for _ in range(2 * bad):
                text.insert(rng.randrange(len(text)), context + rng.choice(insults) + rng.choice(["", "s"]))
            if bad and rng.random() < 0.5:  # the copies of the passage differ by an edited word
                words = passage.split()
                words[rng.randrange(len(words))] = f"w{i}"
                text += words
            rows.append((i, " ".join(text), "en"))
            marks.append((i, 1, int(bad)))
        extra = [(1000 + i, f"{prose(rng, 40)} {passage} {prose(rng, 20)}", "en") for i in range(20)]
        docs, labels = frame(spark, rows + extra), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
        bad = [i for i, _, y in marks if y and found[i].held_out]
        good = [i for i, _, y in marks if not y and found[i].held_out]
        assert len(bad) > 20 and sum(found[i].predicted for i in bad) / len(bad) > 0.95
        assert sum(found[i].predicted for i in good) / len(good) < 0.03
        assert not any(found[i].predicted for i, *_ in extra)


def test_toxicity(spark, awkward, empty):
    rng = random.Random(7)
    insults = ["grobnak", "vilezar", "snarfin"]
    rows, marks = [], []
    for i in range(400):
        text, bad = prose(rng, 40).split(), rng.random() < 0.3
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(insults) + rng.choice(["", "s", "ed", "ism"]))
        rows.append((i, " ".join(text), "en"))
        marks.append((i, 1, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in found if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert sum(found[i].predicted == marks[i][2] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    out = toxicity.toxicity(awkward, labels).collect()
    assert len(out) == awkward.count() and all(r.score < 0.5 for r in out)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5])
def test_insults_that_clean_texts_quote_or_negate(spark, share):
    """Toxic texts call somebody names; a share of the clean ones reports or denies it with the same words."""
    rng = random.Random(17)
    names = ["grubbler", "fozzwit", "snarkel", "plonkter", "drazzle", "moopert"]
    rows, marks = [], []
    for i in range(1200):
        toxic, name = i % 4 == 0, rng.choice(names)
        said = f"you are a {name}" if toxic else "" if rng.random() >= share else rng.choice([f"they said you are a {name}", f"you are not a {name}"])
        rows.append((i, f"{prose(rng, rng.randrange(5, 60))}. {said}. {prose(rng, rng.randrange(5, 60))}", "en"))
        marks.append((i, 1, int(toxic)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    caught = [r.predicted for r in held if r.doc_id % 4 == 0]
    false = [r.predicted for r in held if r.doc_id % 4]
    assert sum(caught) / len(caught) > 0.95 and sum(false) / len(false) < 0.03


def test_uses_of_words():
    text = "JAMÁS eres gruk. They said gruk and gruk, you gruk are not a very big gruk; no gruk"
    words = toxicity.LetterWords([toxicity.lowered(text.encode())])
    own = toxicity.own_uses(words, toxicity.grammar())
    said = [words.bytes.tobytes()[a:z].decode() for a, z in zip(words.start, words.end)]
    assert [bool(o) for o, w in zip(own, said) if w == "gruk"] == [False, False, False, True, True, False]


def test_labels_with_gaps(spark):
    labels = spark.createDataFrame([(1, None, "x"), (None, 1, "y"), (2, 0, "z"), (2, 1, "w")], "doc_id long, toxic int, text string")
    docs = frame(spark, [(1, "a b", "en"), (2, "c d", "en"), (3, None, "en")])
    sample = toxicity.sample_of(docs, labels).collect()
    assert [(r.toxic, r.text) for r in sample] in ([], [(1, "c d")])
    assert toxicity.toxicity(docs, labels).count() == 3

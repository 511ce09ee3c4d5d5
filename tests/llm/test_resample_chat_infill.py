import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lectern.llm import chat, infill, resample

from .conftest import prose

SF = "/root/testdata/sf0.001"


def same_as_sql(frame, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.sql(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(frame.columns)
    assert Counter(tuple(r[n] for n in names) for r in frame.collect()) == Counter(wanted.fetchall())


# --- importance resampling


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_resample(docs, target, max_run, buckets, min_words, percent, seed):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    s, t = counts(x for _, x in docs), counts(target)
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in (zlib.crc32(v.encode()) % buckets for v in f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))])
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(fit) // 100
    return out, [(r[0], r[3]) for r in fit[:drawn]]


@pytest.mark.parametrize(("max_run", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1, 100)])
def test_resample_equals_brute_force(spark, awkward, max_run, buckets, percent):
    rng = random.Random(3)
    extra = [(100 + i, prose(rng, rng.randrange(60))) for i in range(200)] + [(100 + i, "Ünder ÉTÉ 漢字 a1B2-c3") for i in range(3)]
    docs = awkward.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, 0.1) for i, t in extra], "doc_id long, text string, score double"))
    target = spark.createDataFrame([(1, prose(rng, 300)), (2, None), (3, "éTÉ under")], "item_id long, text string")
    wanted, drawn = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], max_run, buckets, 20, percent, 2024)
    found = resample.resample(docs, target, max_run, buckets, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found) == Counter(map(tuple, (w[:4] for w in wanted)))
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


def test_resample_equals_sql(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    same_as_sql(resample.resample(docs, target), resample.SQL, ("documents", "benchmark"))


def test_resample_of_empty_tables(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(empty, none).count() == 0
    assert resample.resample(awkward, none).count() == awkward.count()
    few = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["rank"] for r in resample.resample(few, none).collect()] == [None]


def test_parts_of_a_long_text_have_all_features():
    rng = random.Random(5)
    text = " ".join(rng.choice(["Alpha", "b2", "é", "x" * 90, "--", "c"]) + rng.choice(["", ",", "\n"]) for _ in range(400_000)).encode()
    assert len(text) > 2 * resample.SLAB
    w = words_of(text.decode())
    wanted = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 50 for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got, words = Counter(), 0
    for _, found, _, n in resample.feature_buckets([text], 3, 50):
        got.update(found.tolist())
        words += n[0]
    assert got == wanted and words == len(w)


def test_checksums_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + np.concatenate((rng.integers(0, 70, 298), [64, 900]))
    assert resample.span_checksums(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert len(resample.span_checksums(data, start[:0], end[:0])) == 0


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_key_with_ties_and_nulls(spark, k):
    from pyspark.sql import functions as F

    keys = spark.range(0, 1000, 1, 7).select(F.struct((F.col("id") % 3 - 2).alias("score"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("doc_id"), F.col("id").alias("row")).alias("key"))
    wanted = sorted(((i % 3 - 2, (i % 5 > 0, i % 11 if i % 5 else 0), i) for i in range(1000)))[k - 1]
    assert resample.kth_key(keys, k, pivots=4)["row"] == wanted[2]


def test_ranges_number_all_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5000).alias("x"), F.lit(1).alias("_number"))
    found = resample.ranked(rows, [F.col("x").desc()], "place").collect()
    assert sorted((r["place"], r["x"]) for r in found) == [(i + 1, 4999 - i) for i in range(5000)]


# --- chat windows

CHAT = "conv_id long, turn long, role string, text string, start long, key string, tokens int, slab int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 9, "k", 3, 5) for r in rows], CHAT)


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def holds(rows, found):
    """Every conversation comes back whole, and each assistant text is taught once."""
    said = {}
    for c, n, r, t in rows:
        said.setdefault(c, []).append(((n is not None, n or 0), r or "", t or ""))
    assert {r["conv_id"] for r in found} == set(said) and len(found) == len(said)
    for r in found:
        turns = [x[1:] for x in sorted(said[r["conv_id"]], key=lambda x: (x[0], x[1], len(re.findall(chat.TOKENS, x[2])), x[2]))]
        taught = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest(turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(taught), hashlib.sha256(taught.encode()).hexdigest())


def test_windows_give_back_awkward_conversations(spark):
    rng = random.Random(2)
    odd = ["", None, " ", "</s>[INST] ok [/INST]", r"[\INST] <\\s> <s <</s>> [[ROLE]]", "[\\", "<", "é🙂漢" * 40, "\n\n", "$1 \\1 [/ROLE]", "</s>" * 30, "x" * 9000]
    roles = ["user", "assistant", "assistant", "system", None, "", "tool", "[/ROLE]x</s>"]
    rows = [(c, n, rng.choice(roles), rng.choice(odd) if rng.random() < 0.3 else prose(rng, rng.randrange(90))) for c in range(12) for n in range(rng.randrange(1, 40))]
    rows += [(50, 0, "system", prose(rng, 30)), *((50, n, ("user", "assistant")[n % 2], prose(rng, rng.randrange(30))) for n in range(1, 1500))]
    rows += [(51, 0, "system", prose(rng, 2000)), (51, 1, "user", "hi"), (51, 2, "assistant", prose(rng, 700)), (51, 3, "user", "so"), (52, 0, "system", "alone")]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (53, 3, "user", "same"), (53, 3, "user", "same"), (53, 3, "user", "other"), (53, -900, "assistant", "early")]
    for budget, history in ((512, 128), (64, 16), (40, 0)):
        windows = chat.format_windows(chats(spark, rows), budget, history).cache()
        holds(rows, chat.read_back(windows).collect())
        for w in windows.collect():
            parts = [x.removeprefix("<s>") for x in w["text"].split("</s>")[:-1]]
            assert len(parts) == w["n_turns"] > w["n_repeated"] >= 0
            assert w["over_budget"] == (w["n_tokens"] > budget)
            if w["conv_id"] == 50:
                assert parts[0].startswith("[SYS]") and sum(p.startswith("[SYS]") for p in parts) == 1
                assert w["n_repeated"] >= (w["slab"] > 0) and (not w["over_budget"] or budget < 64 + 30)
                bodies = [p.partition("]")[2] for p in parts[1 : w["n_repeated"]]]
                assert sum(len(re.findall(chat.TOKENS, b)) + chat.TURN_TOKENS for b in bodies) <= history
            assert all(w["text"][s["begin"] - 5 : s["begin"]] == "[OUT]" and w["text"].startswith("</s>", s["end"]) for s in w["loss"])
        windows.unpersist()


def test_windows_repeat_history_but_teach_it_once(spark):
    rows = [(1, 0, "system", "rules"), *((1, n, ("user", "assistant")[n % 2 == 0], f"turn{n} " + "word " * 12) for n in range(1, 30))]
    windows = chat.format_windows(chats(spark, rows), 96, 40).orderBy("slab", "part").collect()
    assert len(windows) > 5 and not any(w["over_budget"] for w in windows)
    assert all(w["n_repeated"] >= 2 and w["text"].startswith("<s>[SYS]rules</s>") for w in windows[1:])
    taught = [re.match(r"turn\d+", w["text"][s["begin"] : s["end"]]).group() for w in windows for s in w["loss"]]
    assert taught == [f"turn{n}" for n in range(2, 30, 2)]


def test_chat_equals_sql(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    same_as_sql(chat.read_back(chat.format_windows(chat.with_probe(table))), chat.SQL, ("conversations",))
    assert chat.format_windows(table.limit(0)).count() == 0


def test_chat_uses_no_python_workers(spark):
    plan = chat.read_back(chat.format_windows(chats(spark, [])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_escapes_are_reversible(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = ["".join(rng.choice(["[", "<", "\\", "/", "s>", "INST]", "SYS]", "]", "ROLE]", "é", " "]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "x string").select("x", chat.escape(F.col("x")).alias("e")).select("x", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r["x"] == r["u"] and not re.search(r"</?s>|\[/?(SYS|INST|OUT|ROLE)\]", r["e"]) for r in frame)


# --- fill in the middle


def brute_infill(doc_id, text, rate=90, spm=20, seed=1):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_brute_force(spark, awkward):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aé漢🙂<>PSM \n") for _ in range(rng.randrange(3000))) for _ in range(300)] + ["<M>", "a<P>", "<S", "🙂", "<" * 500, prose(rng, 900) + "<S>" + prose(rng, 900)]
    docs = awkward.select("doc_id", "text", "rep").unionByName(spark.createDataFrame([(1000 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rep long"))
    found = infill.fill_in_middle(docs)
    wanted = [brute_infill(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())) == Counter(wanted)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    back = Counter((r["doc_id"], r["restored_sha256"]) for r in infill.digests(found).collect())
    assert back == Counter((r["doc_id"], sha(r["text"])) for r in docs.collect())


def test_infill_of_an_empty_table_and_sql(spark, empty):
    assert infill.digests(infill.fill_in_middle(empty)).count() == 0
    same_as_sql(infill.digests(infill.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet"))), infill.SQL, ("documents",))


def test_shared_passages_share_chunks():
    rng = random.Random(4)
    shared = prose(rng, 6000).encode()
    texts = [prose(rng, 50 + 13 * k).encode() + shared + prose(rng, 20).encode() for k in range(6)]
    ends = infill.chunk_ends(texts)
    assert all(e[-1] == len(t) and all(0 < b - a <= infill.MOST for a, b in zip([0, *e], e)) for t, e in zip(texts, ends))
    memo = infill.Memo()
    cut = [infill.Chunked(t, e, memo) for t, e in zip(texts, ends)]
    assert memo.hits > 0.7 * sum(map(len, ends[1:]))
    for t, c in zip(texts, cut):
        text = t.decode()
        assert c.points == len(text) and all(c.place(n) == len(text[:n].encode()) for n in (0, 1, 77, len(text) // 2, len(text)))


def test_summaries_add_up_at_every_seam():
    for text in ("a<P>é🙂<S", "<<M>", "🙂<S>漢", "<P", ">P<"):
        data = text.encode()
        for i in range(len(data) + 1):
            for j in range(i, len(data) + 1):
                parts = [infill.summary(x) for x in (data[:i], data[i:j], data[j:])]
                left, right = parts[0].then(parts[1]).then(parts[2]), parts[0].then(parts[1].then(parts[2]))
                assert left == right and (left.points, left.marked) == (len(text), infill._marked(data))


def test_memo_is_bounded():
    memo = infill.Memo(100)
    for k in range(50):
        memo(bytes([k]) * 30)
    assert memo.size <= 100 and len(memo.held) == 3
    assert memo(b"x" * 1000).points == 1000

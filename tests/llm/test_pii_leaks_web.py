import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import archives, decontaminate, pii, url_filter

from .conftest import frame, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 10 <= len(digits) <= 15
            ):
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(found))


ODD = [
    "mail a.b@c.d-e.fr, x@y.co_m@z.org. and a@b..c@d.ee", "..@a.b @x.y a@b a@-.- a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111",
    "+1 (555) 123-4567 +12 +1234567890123456 +1-2", "é漢🙂 a@b.cd 漢 10.0.0.1", "4111111111111111@x.com", "1 " * 9000, "a." * 9000 + "b@c.de", "9" * 9000, "x@" + "a." * 9000 + "c", "@" * 500, "+" * 500 + "1 2 3 4 5 6 7 8 9 0",
]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("a1.@ -+_b(") for _ in range(rng.randrange(120))) for _ in range(250)]
    texts += ["".join(rng.choice(["4111111111111111", "10.1.1.1", "a@b.co", "+1 555 123 4567", " ", ".", "-"]) for _ in range(8)) for _ in range(80)]
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        wanted = base(text)
        assert found[i].base_sha256 == hashlib.sha256(wanted.encode()).hexdigest(), text[:80]
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [len(re.findall(rf"\b{k}:", wanted)) for k in PATTERNS]


def test_disclosing_terms_and_sanitising(spark, awkward, empty):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 30)} Zanzibarov wrote from secret@host.org {prose(rng, 30)} {i}", "en") for i in range(5)]
    rows += [(i, f"{prose(rng, 50)} other{i}@host.org", "en") for i in range(10, 40)]
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all(found[i].n_term >= 1 for i in range(5)) and all(found[i].n_term == 0 for i in range(10, 40))
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert all("Zanzibarov" not in clean[i] and "secret@host.org" not in clean[i] and "<EMAIL>" in clean[i] for i in range(5))
    out = pii.sanitize(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in awkward.collect())
    assert {r.spans for r in pii.personal_data(awkward).collect()} == {""}
    assert pii.personal_data(empty).count() == 0 and pii.sanitize(empty).count() == 0


def plain_terms(texts):
    """{(term, entity value)} by counting over distinct texts."""
    texts = sorted(set(texts))
    words = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    values = [{(k.split(":")[0], t[int(k.split(":")[1]) : int(k.split(":")[2])].lower()) for k in base(t).split(",") if k} for t in texts]
    n, out = len(texts), set()
    for entity in set().union(*values):
        holders = [i for i in range(n) if entity in values[i]]
        if not 3 <= len(holders) < n:
            continue
        for term in set().union(*(words[i] for i in holders)):
            together, anywhere = sum(term in words[i] for i in holders), sum(term in w for w in words)
            told = math.log(together * n / (anywhere * len(holders))) / math.log(n / len(holders))
            if together >= 3 and together >= 0.5 * anywhere and told >= 0.8:
                out.add((term, entity))
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(21)
    names = [f"name{chr(97 + k)}" for k in range(12)]
    texts = []
    for i in range(160):
        k = rng.randrange(12)
        parts = [prose(rng, 12), names[k] if rng.random() < 0.9 else "", rng.choice([f"10.0.0.{k}"] * 4 + [f"+1 555 123 45{k:02}"]), rng.choice(names) if rng.random() < 0.04 else ""]
        rng.shuffle(parts)
        texts.append(" ".join(parts).replace("name", "Name" if i % 2 else "name"))
    texts += rng.choices(texts, k=60)
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    wanted = plain_terms(texts)
    told = pii.disclosing_terms(docs).collect()
    assert len(told) == len(wanted) > 3 and {r.term for r in told} == {t for t, _ in wanted}
    terms = {t for t, _ in wanted}
    clean = {r.doc_id: r for r in pii.sanitize(docs).collect()}
    for i, t in enumerate(texts):  # wherever a term stands, beside an entity or alone
        hit = terms & set(re.findall(r"[^\W\d_]+", t.lower()))
        assert bool(hit) == ("<NAME>" in clean[i].text or "<WORD>" in clean[i].text)


def test_terms_are_generalised_in_documents_without_the_entity(spark):
    rng = random.Random(22)
    rows = [(i, f"{prose(rng, 30)} Zanzibarov wrote from secret@host.org {prose(rng, 30)} {i}", "en") for i in range(8)]
    rows += [(i, f"{prose(rng, 50)} other{i}@host.org", "en") for i in range(10, 40)]
    rows += [(50, "We met Zanzibarov, ZANZIBAROV and zanzibarov there.", "en"), (51, None, None)]
    clean = {r.doc_id: r.text for r in pii.sanitize(frame(spark, rows)).collect()}
    assert clean[50] == "We met <NAME>, <NAME> and <WORD> there." and clean[51] is None
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert found[50].spans == "term:7:17,term:19:29,term:34:44" and found[50].n_email == 0


def test_copies_do_not_hide_disclosing_terms(spark):
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 30)} Zanzibarov wrote from secret@host.org {prose(rng, 30)} {i}", "en") for i in range(5)]
    rows = [(100 * k + i, t, x) for i, t, x in rows for k in range(10)]
    rows += [(i, f"{prose(rng, 50)} other{i}@host.org", "en") for i in range(10, 40)]
    docs = frame(spark, rows)
    found = {r.doc_id: r.n_term for r in pii.personal_data(docs).collect()}
    assert all((found[i] >= 1) == (i % 100 < 5) for i in found)
    assert not any("Zanzibarov" in r.text for r in pii.sanitize(docs).collect())


def test_terms_far_from_the_entity_and_short_ones(spark):
    rng = random.Random(7)
    rows = [(i, f"KIM. {prose(rng, 60)} Kim met Zanzibarov. {prose(rng, 60)} secret@host.org {prose(rng, 60)} 金正 zanzibarov {i}", "en") for i in range(5)]
    rows += [(i, f"{prose(rng, 150)} other{i}@host.org", "en") for i in range(10, 40)]
    docs = frame(spark, rows)
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert not any(re.search("kim|zanzibarov|金正|secret", clean[i], re.I) for i in range(5))
    assert all(clean[i].split()[:-1] == t.split()[:-1] for i, t, _ in rows[5:])


def test_overlapping_spans_are_replaced_once(spark):
    docs = frame(spark, [(1, "card 4111111111111111@x.com end", "en")])
    assert pii.sanitize(docs).first().text == "card <EMAIL> end"


def swept(text, base, terms):
    """Spans and sanitised text by plain loops: base spans as given, occurrences of terms outside them."""
    found = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in terms]
    spans = sorted(base + [w for w in found if not any(b[0] < w[2] and w[0] < b[2] for b in base)])
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            own = text[start:end]
            kind = "<LETTERS>" if own.upper() == own.lower() else "<NAME>" if own[0] != own[0].lower() else "<WORD>"
            out += [text[at:start], kind if rank == 4 else f"<{list(PATTERNS)[rank].upper()}>"]
        at = max(at, end)
    return spans, "".join(out) + text[at:]


def test_spans_and_replacement_equal_plain_loops(spark):
    """Texts where addresses start within words, spans overlap, and blocks end within spans, gaps and wide characters."""
    rng = random.Random(31)
    parts = ["Ana", "ana", "éana@b.cd", "漢字", "bob", "a@b.co", "4111111111111111@x.com", "+1 555 123 4567", "10.1.1.1", " ", " ", " ", "-", "🙂", "x" * 200, " y" * 150, "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(150)] + ["", "ana" * 700, "🙂" * 512 + "a@b.co" + "é" * 506 + " ana", "a@b.co " * 3000]
    rows = [(i, t, rng.choice([None, ["ana"], ["ana", "bob", "漢字", "zz"], []])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "i int, text string, terms array<string>").withColumn("base", pii.base_spans(F.col("text")))
    docs = docs.withColumn("spans", pii._all_spans(F.col("text"), F.col("base"), F.col("terms")))
    found = {r.i: r for r in docs.withColumn("clean", pii._replaced(F.col("text"), F.col("spans"))).collect()}
    for i, text, terms in rows:
        spans, clean = swept(text, [tuple(s) for s in found[i].base], set(terms or []))
        assert [tuple(s) for s in found[i].spans] == spans and found[i].clean == clean, text[:80]
        assert ",".join(f"{list(PATTERNS)[k]}:{a}:{z}" for a, k, z in found[i].base) == base(text)


def test_time_is_linear_in_the_spans_of_a_text(spark):
    """200,000 addresses and 200,000 terms in one text; both results within a minute each."""
    names = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(1000)]
    parts = [f"a{k}@b.cd n{names[k % 1000]}" for k in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(parts), [f"n{n}" for n in names])], "doc_id long, text string, terms array<string>")
    docs = docs.withColumn("spans", pii._all_spans(F.col("text"), pii.base_spans(F.col("text")), F.col("terms")))
    began = time.time()
    listed = docs.select(pii._listed(F.col("spans"))).first()[0].split(",")
    assert len(listed) == 400_000 and listed[0] == "email:0:7" and time.time() - began < 60
    began = time.time()
    clean = docs.select(pii._replaced(F.col("text"), F.col("spans"))).first()[0]
    assert clean == " ".join(["<EMAIL> <WORD>"] * 200_000) and time.time() - began < 60
    assert pii.sanitize(docs.select("doc_id", "text")).first().text.count("<EMAIL>") == 200_000


def test_native_plan(spark, awkward):
    plan = pii.sanitize(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_leaks(spark, awkward, empty):
    rng = random.Random(3)
    items = [(i, f"What {prose(rng, 12)} item{i}? {prose(rng, 5)} answer{i}.") for i in range(50)] + [(90, "Lone words only"), (91, ""), (None, "x y z"), (92, None), (93, "Hm.")]
    rows, wanted = [], set()
    for d in range(120):
        text = prose(rng, rng.randrange(30, 400)).split()
        if d % 3 == 0:
            k = rng.randrange(50)
            text.insert(rng.randrange(len(text)), items[k][1].upper() if d % 2 else items[k][1])
            wanted.add((d, k))
        rows.append((d, " ".join(text), "en"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and all(0.5 <= r.score <= 1.0001 for r in found)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d in range(120) if d % 3}
    assert decontaminate.contaminated(awkward, bench).count() == 0 and decontaminate.drop_contaminated(awkward, bench).count() == awkward.count()
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0


def test_edited_answers_are_found():
    rng = random.Random(8)
    items = [(i, f"What {prose(rng, 20)} item{i}? {prose(rng, i % 12)} answer{i}.".encode()) for i in range(60)]
    texts, wanted = [], set()
    for i, item in items:
        words, n = item.decode().split(), i % 12 + 1
        words[-1 - rng.randrange(n)] = "changed"
        wanted.add((len(texts), i))
        texts += [f"{prose(rng, 90)} {' '.join(words)} {prose(rng, 40)}".encode(), prose(rng, 300).encode()]
    index, _ = index_of(items)
    found = {(t, i) for t, i, *_ in decontaminate.leaks_in(texts, index)}
    assert found == wanted  # none of the 60 clean texts


def index_of(items):
    counts = {}
    for _, item in items:
        for h in set(decontaminate.hashes_of(item).view("int64").tolist()):
            counts[h] = counts.get(h, 0) + 1
    n = len(items)
    idf = {h: math.log1p((n - c + 0.5) / (c + 0.5)) for h, c in counts.items()}
    return decontaminate.Index(items, idf, sum(len(t.split()) for _, t in items) / n), idf


@pytest.mark.parametrize("block, cells", [(8, 1 << 20), (3, 50)])
def test_pruned_search_equals_full_scoring(monkeypatch, block, cells):
    """All scores of all windows with all items, computed from the formula; block maxima may only skip what is below."""
    import numpy as np

    monkeypatch.setattr(decontaminate, "THRESHOLD", 0.4)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randrange(5, 90)).encode()) for i in range(70)]
    index, idf = index_of(items)
    mean = sum(len(t.split()) for _, t in items) / 70
    terms = [np.unique(np.array([rng.randrange(len(index.terms)) for _ in range(25)])) for _ in range(200)]
    window, term = np.repeat(np.arange(200), [len(t) for t in terms]), np.concatenate(terms)
    found = {(w, k): s for postings in index.classes for w, k, s in postings.search(window, term)}
    wanted = {}
    for k, (_, text) in enumerate(items):
        words = decontaminate.hashes_of(text).view("int64").tolist()
        part = {h: idf[h] * words.count(h) * 2.2 / (words.count(h) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for h in set(words)}
        for w, own in enumerate(terms):
            score = sum(part.get(h, 0.0) for h in index.terms[own].view("int64").tolist()) / sum(part.values())
            if score >= 0.4:
                wanted[w, k] = score
    assert {len(p.items) for p in index.classes} != {70} and wanted
    assert {x for x in found if abs(found[x] - 0.4) > 1e-4} == {x for x in wanted if abs(wanted[x] - 0.4) > 1e-4}
    assert all(abs(found[x] - wanted.get(x, 0.4)) < 1e-4 for x in found)


def test_passages_do_not_depend_on_other_items(spark):
    """An item's words spread over a document are no copy of it, whatever else the benchmark holds."""
    rng = random.Random(9)
    item = "Which tall grobnak kept seven vilezar lamps near old harbour gates? Only plonkut did."
    spread = " ".join(w + " " + prose(rng, 150) for w in item.split())
    docs = frame(spark, [(1, spread, "en"), (2, f"{prose(rng, 80)} {item}", "en")])
    for more in ([], [(7, prose(rng, 400))]):
        bench = spark.createDataFrame([(1, item), *more], "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(2, 1)}


def test_long_items_and_repeated_ones(spark):
    rng = random.Random(10)
    long, short = prose(rng, 700) + ". " + prose(rng, 30), "What is a zanzibar lamp for? It lights plain roads well."
    bench = spark.createDataFrame([(1, long, "x"), (2, short, "y"), (2, short, "z"), (2, prose(rng, 40), "w")], "item_id long, text string, doc_id string")
    docs = frame(spark, [(1, f"{prose(rng, 500)} {long} {prose(rng, 900)}", "en"), (2, f"{short} {prose(rng, 30)}", "en"), (2, f"{short} {prose(rng, 30)}", "en"), (3, prose(rng, 2000), "en")])
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [(1, 1), (2, 2), (2, 2)]


def test_large_benchmark_stays_small_and_quick():
    """20,000 items: the index takes some ten times the items' text, and a search does not look at all of them."""
    import time

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40)).encode()) for i in range(20_000)]
    index, _ = index_of(items)
    assert sum(p.bytes() for p in index.classes) < 10 * sum(len(t) for _, t in items)
    texts = [" ".join(rng.choices(vocabulary, k=300)).encode() for _ in range(300)]
    texts += [texts[k][:900] + b" " + items[k][1] + b" " + texts[k][900:] for k in range(50)]
    began = time.time()
    found = {(t, i) for t, i, *_ in decontaminate.leaks_in(texts, index)}
    assert found == {(300 + k, k) for k in range(50)} and time.time() - began < 30


def test_shards_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    bench = spark.createDataFrame([(i, prose(rng, 25)) for i in range(30)], "item_id long, text string")
    docs = frame(spark, [(r.item_id, f"{prose(rng, 80)} {r.text} {prose(rng, 10)}", "en") for r in bench.collect()])
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 900)
    assert {(i, i) for i in range(30)} <= {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}


PAGES = [
    (1, "http://a.example.org/en/12?q", "x" * 1500), (2, "https://A.EXAMPLE.com/de/", "x" * 1500), (3, "http://org/", "é" * 500), (4, "ftp://b.com/fr/x#y", "é" * 500), (5, None, None),
    (6, "no scheme", ""), (7, "http://example.org/es/1", "y" * 999), (8, "http://notexample.org/es/", "y" * 999), (9, "http://spam-farm.example.net", "a\r\n\r\nWARC/1.1\r\n\r\n" * 80),
    (10, "http://x y\n.com/de/ z", "a\r\n\r\nWARC/1.1\r\n\r\n" * 80), (11, "http://example.org", "filedesc://x\n" * 100), (12, "://h/p?://x/y", "z"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def sql_rows(sql, names):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    return sorted(map(str, con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()))


@pytest.mark.parametrize("operator, sql", [(archives.archive_pages, archives.SQL), (url_filter.filter_urls, url_filter.SQL)])
def test_same_as_sql(spark, operator, sql):
    found = operator(pages(spark).repartition(3))
    assert sorted(str(tuple(r)) for r in found.collect()) == sql_rows(sql, found.columns)
    assert operator(pages(spark, []).limit(0)).count() == 0


def test_archives_hold_the_payloads(spark, tmp_path):
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    archives.write_arc(pages(spark), arc, archive_bytes=2000)
    archives.arc_to_warc(spark, arc, warc, archive_bytes=2000)
    records = {r.page_id: r for r in archives.read_warcs(spark, warc).collect()}
    for page, _, html in PAGES:
        payload = (html or "").encode()
        record = records[page]
        assert record.payload_digest == hashlib.sha1(payload).hexdigest() and record.payload_bytes == len(payload)
        assert record.record_type == "revisit" or bytes(record.payload) == payload
        assert record.warc_date == "2024-01-01T00:00:00Z" and record.record_id.startswith("<urn:uuid:")
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(arc).collect()]
    assert {archives.opened(f).read().split(b"\n")[1][:1] for f in files} == {b"1", b"2"}
    ids = [r.record_id for r in archives.read_warcs(spark, warc).collect()]
    assert len(set(ids)) == len(ids)
    starts = [(at, d) for r in spark.read.format("binaryFile").load(warc).collect() for d in [bytes(r.content)] for at in range(len(d)) if d[at : at + 3] == b"\x1f\x8b\x08"]
    readable = sum(zlib.decompressobj(31).decompress(d[at:], 5) == b"WARC/" for at, d in starts[:5])
    assert readable and starts[0][0] == 0  # each record is a member of its own


def read_back(spark, folder, files):
    for name, data in files.items():
        (folder / "arc").mkdir(exist_ok=True)
        (folder / "arc" / name).write_bytes(data)
    archives.arc_to_warc(spark, f"file://{folder}/arc", f"file://{folder}/warc")
    return archives.read_warcs(spark, f"file://{folder}/warc").collect()


def test_foreign_archives(spark, tmp_path):
    """Latin-1 bytes, dns records, urls with spaces, no page id, members of gzip, an http record without a head."""
    http = b"HTTP/1.1 200 OK\r\nServer: caf\xe9\r\n\r\n"
    big, own = b"\xe9\xff\x00" * 700, b"no head at all"
    records = [
        archives.arc_head(1, "old.arc") + b"\n",
        archives.arc_record(1, "dns:example.org", b"20240101\nexample.org. 1 IN A 10.0.0.1\n", "", 0, kind="text/dns") + b"\n",
        archives.arc_record(1, "http://a.org/", http + big, "", 0, date="1999") + b"\n",
        archives.arc_record(1, "http://b.org/a b", http + big, "", 0) + b"\n",
        archives.arc_record(1, "http://c.org/", own, "", 0) + b"\n",
        archives.arc_record(1, "http://d.org/", b"HTTP/1.0 200 OK\nX: y\n\n" + big, "", 0) + b"\n",
        archives.arc_record(1, "http://e.org/", b"a: b\n", "", 0, kind="text/anvl") + b"\n",
    ]
    found = read_back(spark, tmp_path, {"plain.arc": b"".join(records), "packed.arc.gz": b"".join(map(archives.member, records))})
    kinds = {}
    for r in found:
        kinds.setdefault(r.url, []).append(r.record_type)
    assert sorted(kinds.pop("old.arc")) == ["warcinfo"] * 2 and kinds.pop("dns:example.org") == ["resource"] * 2
    assert kinds.pop("http://c.org/") == ["resource"] * 2 and kinds.pop("http://e.org/") == ["metadata"] * 2
    pages_ = [k for v in kinds.values() for k in v]
    assert set(kinds) == {"http://a.org/", "http://b.org/a b", "http://d.org/"} and sorted(pages_) == ["response"] + ["revisit"] * 5
    kept = [r for r in found if r.record_type == "response"]
    assert bytes(kept[0].payload) == big and len({r.record_id for r in found}) == len(found)
    assert all(r.refers_to_record == kept[0].record_id and r.payload_bytes == len(big) for r in found if r.record_type == "revisit")
    assert {r.warc_date for r in found if r.url == "http://a.org/"} == {"1999-01-01T00:00:00Z"}
    assert any(b"IN A" in bytes(r.payload) and r.content_type == "text/dns" for r in found if r.record_type == "resource")
    assert all(bytes(r.payload).startswith(b"1 0 lectern") for r in found if r.record_type == "warcinfo")


def test_repeated_and_long_pages(spark):
    rows = [(1, "http://a.org", "x" * 3_000_000), (1, "http://a.org", "x" * 3_000_000), (0, None, "x" * 3_000_000), (None, "http://b.org", "x" * 3_000_000), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame([(*r, "page", 1, b"v") for r in rows], "page_id long, url string, html string, digest string, kind int, value binary")
    found = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in archives.archive_pages(docs).collect())
    assert found == [("0", "revisit", "1", 3_000_000), ("1", "response", "None", 3_000_000), ("1", "response", "None", 3_000_000), ("2", "response", "None", 0), ("2", "response", "None", 0), ("None", "revisit", "1", 3_000_000)]


def test_broken_archives_are_told():
    head = archives.arc_head(1, "n")
    assert [b for _, b in archives.read_arc(head + b"\n" + archives.arc_record(1, "u", b"doc", "n", 0))][1:] == [b"doc"]
    assert [f["Result-code"] for f, _ in archives.read_arc(archives.arc_head(2, "n") + b"\n" + archives.arc_record(2, "u", b"doc", "n", 0))] == ["200"] * 2
    for bad in (head + b"u 0.0.0.0 1 text/html 9\nabc", head + b"u 0.0.0.0 text/html 3\nabc", b"u 0.0.0.0 1 t 3\nabc", head + b"no length here at all\n"):
        with pytest.raises(ValueError):
            list(archives.read_arc(bad))
    assert archives.warc_date("1999") == "1999-01-01T00:00:00Z"


def array_of(rules=url_filter.RULES):
    import numpy as np

    return url_filter.DigestArray(np.frombuffer(url_filter.build(rules) + b"\0", np.uint8))


def test_rules_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    hosts, paths = ["example.org", "a.com", "b.net", "x.pills-now.net", "?ads"], ["/es/x", "/de/", "/", "/", ""]
    assert url_filter.judge(hosts, paths, array_of()) == [("example.org/es/", "block"), ("com/de/", "block"), (None, "allow"), (None, "block"), (None, "allow")]


def test_many_rules_equal_brute_force():
    rng = random.Random(31)
    labels = ["a", "bb", "c-c", "ads", "org", "com", "x"]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randrange(1, 4))), "/" + "".join(rng.choices("ab/", k=rng.randrange(4)))) for _ in range(1500)]
    array = array_of(rules)
    hosts = [".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(400)] + ["", "."]
    paths = ["/" * rng.randrange(2) + "".join(rng.choices("ab/", k=rng.randrange(5))) for _ in hosts]
    for host, path, (rule, verdict) in zip(hosts, paths, url_filter.judge(hosts, paths, array)):
        fits = [(len(h + p), -k, h + p, v) for k, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        wanted = max(fits)[2:] if fits else (None, "block" if any(w in url_filter.UNWANTED for x in host.split(".") for w in x.split("-")) else "allow")
        assert (rule, verdict) == wanted or len(fits) > 1 and max(fits)[0] == len(rule)


def test_repeated_long_and_clashing_urls(spark):
    rows = [(1, "http://example.org/es/" + "x" * 200_000), (1, "http://a.com/de/"), (1, "http://a.com/de/"), (2, None), (2, None), (None, "HTTP://ADS.net")]
    table = spark.createDataFrame([(*r, "h", 1, "allow") for r in rows], "page_id long, url string, host string, rule int, verdict string")
    found = sorted((str(r.page_id), r.host, len(r.path), str(r.rule), r.verdict) for r in url_filter.filter_urls(table).collect())
    assert found == [("1", "a.com", 4, "com/de/", "block"), ("1", "a.com", 4, "com/de/", "block"), ("1", "example.org", 200_004, "example.org/es/", "block"),
                     ("2", "", 0, "None", "allow"), ("2", "", 0, "None", "allow"), ("None", "ads.net", 0, "None", "block")]


def test_hosts_of_very_many_labels_take_little_memory():
    import tracemalloc

    host = ".".join(f"a{i % 7}" for i in range(100_000))
    array = array_of()
    tracemalloc.start()
    found = url_filter.judge([host + ".example.org", host + ".casino-x.net", host], ["/es/1", "/", "/de/"], array)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert found == [("example.org/es/", "block"), (None, "block"), (None, "allow")]
    assert url_filter.judge(["x.y"], ["/"], array_of([])) == [(None, "allow")]


def test_headers_of_foreign_servers_name_no_page(spark, tmp_path):
    """Two pages with equal payloads, and a header of another archive in both: one is a revisit."""
    (tmp_path / "in").mkdir()
    payload = b"x" * 2000
    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: 77\r\n\r\n" + payload
    records = b"".join(f"http://h{k}.example/ 1.2.3.4 20240101000000 text/html {len(block)}\n".encode() + block + b"\n" for k in range(2))
    head = b"1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
    (tmp_path / "in" / "a.arc").write_bytes(f"filedesc://a.arc 0.0.0.0 20240101000000 text/plain {len(head)}\n".encode() + head + b"\n" + records)
    archives.arc_to_warc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    kinds = sorted(r.record_type for r in archives.read_warcs(spark, str(tmp_path / "out")).collect())
    assert kinds == ["response", "revisit", "warcinfo"]


def test_items_in_scripts_without_spaces_are_found(spark):
    rng = random.Random(51)
    han = [chr(c) for c in range(0x4E00, 0x4F40)]
    clause = lambda n: "".join(rng.choice(han) for _ in range(n))
    items = [(k, f"{clause(18)}，{clause(22)}。{clause(15)}。") for k in range(6)]
    edited = "".join(c if i % 17 else "變" for i, c in enumerate(items[1][1]))
    rows = [(0, clause(60) + "。" + items[0][1] + clause(80), "zh"), (1, clause(40) + edited + clause(90), "zh"), (2, clause(300), "zh"), (3, prose(rng, 200), "en"), (4, items[2][1][:20] + clause(60), "zh")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(0, 0), (1, 1)}
    assert decontaminate.normal("Ab漢字語 x字，ไทย".encode()).decode().split() == ["ab", "漢字", "字語", "x", "字", "，", "ไท", "ทย"]

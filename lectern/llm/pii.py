"""Personal data by information-theoretic sanitisation, in DataFrame functions only.

Base spans are protected entities: email and ip addresses, card and phone numbers. Other words of the documents that hold
an entity can give it away too. From all documents it is counted in how many texts a term stands together with an entity
value and in how many it occurs at all; copies of a text count once. Pointwise mutual information over the information
content of the entity says how much of the entity the term discloses. Terms over the threshold become spans wherever they
stand in the corpus, whether the entity stands there too or not. The sanitiser generalises: a base span to its kind, a
disclosing term to its class by its letters (``<NAME>`` with a capital first, ``<WORD>`` without, ``<LETTERS>`` in scripts
without case). A term is a maximal run of letters of any length; scripts without spaces give runs as long as their clauses.

Positions come from the lengths of the matches and of the gaps between them. The patterns run on texts in which single
characters were replaced so that no repeated group is needed; such groups would overflow the stack on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stage, with_row_key

KINDS = ("email", "ip", "card", "phone", "term")
#: Distinct texts that must hold a term and the entity, and the share of the entity's information it must give away.
SUPPORT, DISCLOSURE, PRECISION = 3, 0.8, 0.5
BROADCAST_ROWS = 200_000
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = r"\p{L}[\p{L}\p{M}]*+"
_RANKED = "array<struct<start:int,rank:int,end:int>>"
_RANKED_VALUED = "array<struct<start:int,rank:int,end:int,value:string>>"
#: Code points of the blocks that texts are cut from, so that no cut walks a whole text.
_BLOCK = 512
#: Values folded at once.
_RUN = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though lambdas within use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _prefixes(values: Column, combine) -> Column:
    """What ``combine`` makes of 0 and all values before each one.

    A fold copies its state at each step, so values are folded in runs of 128 from the totals of the runs before; time is
    linear as long as the totals are short beside the values (tens of millions).
    """
    step = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def folded(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def by_runs(all_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / _RUN).cast("int")), lambda k: F.slice(all_, k * _RUN + 1, _RUN))
        return _let(runs, lambda r: F.flatten(F.zip_with(r, folded(F.transform(r, lambda run: F.aggregate(run, F.lit(0), combine)), F.lit(0)), folded)))

    return _let(values, by_runs)


def _found(text: Column, pattern: str) -> Column:
    """Matches as (start, end, value) in code points; values come with the match, as cutting one out walks the text from its start."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), matches, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"), m.alias("value")))

    def placed(found: Column) -> Column:
        before = _prefixes(F.transform(found, lambda x: x["gap"] + x["size"]), lambda at, n: at + n)
        start = lambda x, at: at + x["gap"]
        return F.zip_with(found, before, lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + x["size"]).alias("end"), x["value"].alias("value")))

    return _let(F.filter(sizes, lambda x: x["value"].isNotNull()), placed)


def _kind(applies: Column, prepared: Column, pattern: str, kind: str, keep, value=lambda v: v) -> Column:
    """Spans of one kind as (start, rank, end, value); texts that cannot hold one are not searched."""
    rank = F.lit(KINDS.index(kind))
    spans = F.transform(
        F.filter(_found(prepared, pattern), lambda s: keep(s["value"])),
        lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), value(s["value"]).alias("value")),
    )
    return F.when(applies, spans).otherwise(F.array().cast(_RANKED_VALUED))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _span(start: Column, rank: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"))


def _valued_spans(text: Column) -> Column:
    """Base spans and their values, sorted by start, then kind."""
    # a dot that no label follows cannot stand in a domain; as \x01 it fits the local part only, and is a dot again in the value
    mail = F.regexp_replace(F.translate(text, "\x01", "\n"), r"\.(?![A-Za-z0-9-])", "\x01")
    # a separator that is not single and between digits ends a number
    card = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\n")
    email = _kind(
        F.contains(text, F.lit("@")), mail,
        r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@(?=[A-Za-z0-9-]++\.)[A-Za-z0-9.-]++", "email",
        lambda v: F.lit(True), lambda v: F.translate(v, "\x01", "."),
    )
    ip = _kind(
        text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), text,
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip", lambda v: v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    )
    number = _kind(
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), card,
        r"[0-9][0-9\x20-]*+", "card", lambda v: F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v)),
    )
    phone = _kind(
        text.rlike(r"\+[0-9]"), text,
        r"\+[0-9][\x20().0-9-]+[0-9]", "phone", lambda v: F.length(_digits(v)).between(10, 15),
    )
    return F.sort_array(F.concat(email, ip, number, phone))


def base_spans(text: Column) -> Column:
    """Base spans of a text as (start, rank, end), sorted by start, then kind."""
    return F.transform(_valued_spans(text), lambda s: _span(s["start"], s["rank"], s["end"]))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def _entities(spans: Column) -> Column:
    """Hashes of the distinct values of the base spans."""
    return F.array_distinct(F.transform(spans, lambda s: F.xxhash64(s["rank"], F.lower(s["value"]))))


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _measured(docs: DataFrame) -> DataFrame:
    """A hash of every row's text and the entities it holds; written once."""
    text = docs.select(_text().alias("text"))
    return stage(text.select(F.xxhash64("text").alias("h"), _entities(_valued_spans(F.col("text"))).alias("entities")), "entities")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _distinct_texts(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """(h, text), each text once. Only texts that have copies are shuffled."""
    copied = _bounded(stage(measured.groupBy("h").count().where("count > 1").select("h"), "copied"))
    texts = docs.select(F.xxhash64(_text()).alias("h"), _text().alias("text"))
    return texts.join(copied, "h", "left_anti").unionByName(texts.join(copied, "h", "left_semi").dropDuplicates(["h"]))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(term, entity) of all terms that give away an entity (its hash). All counts are of distinct texts."""
    return _disclosing(docs)[0]


def _disclosing(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The disclosing terms, and (h, text) of every distinct text."""
    measured = _measured(docs)
    n = F.lit(float(max(measured.select("h").distinct().count(), 1)))
    held = stage(measured.select("h", F.explode("entities").alias("entity")).distinct(), "held")
    # an entity in fewer texts, or in all of them, and a term in more texts than any entity allows cannot pass below
    entities = held.groupBy("entity").agg(F.count("*").alias("entity_texts")).where((F.col("entity_texts") >= SUPPORT) & (F.col("entity_texts") < n))
    held = stage(held.join(_bounded(stage(entities, "shared")), "entity"), "holders")
    most = held.agg(F.coalesce(F.max("entity_texts"), F.lit(0))).first()[0]
    texts = _distinct_texts(docs, measured)
    seen = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("term_texts"))
    seen = stage(seen.where((F.col("term_texts") >= SUPPORT) & (PRECISION * F.col("term_texts") <= most)), "terms")
    words = texts.join(_bounded(held.select("h").distinct()), "h", "left_semi").select("h", F.explode(_words(F.col("text"))).alias("term"))
    possible = PRECISION * F.col("term_texts") <= F.col("entity_texts")
    near = words.join(_bounded(seen), "term").join(_bounded(held), "h").where(possible)
    told = near.groupBy("entity", "term", "entity_texts", "term_texts").agg(F.count("*").alias("together"))
    content = F.log(n / F.col("entity_texts"))
    shared = F.log(F.col("together") * n / (F.col("term_texts") * F.col("entity_texts")))
    told = told.where((F.col("together") >= SUPPORT) & (F.col("together") >= PRECISION * F.col("term_texts")) & (shared / content >= DISCLOSURE))
    return stage(told.select("term", "entity"), "disclosing"), texts


def _holding_terms(docs: DataFrame) -> DataFrame:
    """(h, terms): every text that holds disclosing terms, with these."""
    told, texts = _disclosing(docs)
    terms = stage(told.select("term").distinct(), "told")
    if terms.isEmpty():
        return docs.sparkSession.createDataFrame([], "h long, terms array<string>")
    held = texts.select("h", F.explode(_words(F.col("text"))).alias("term")).join(_bounded(terms), "term")
    return stage(held.groupBy("h").agg(F.collect_set("term").alias("terms")), "extra")


def _told(text: Column, terms: Column) -> Column:
    """All occurrences of the terms as (start, rank, end): words and terms sorted together, where a term stands before its words."""
    words = F.transform(_found(text, _TERM), lambda s: F.struct(F.lower(s["value"]).alias("word"), s["start"].alias("start"), s["end"].alias("end")))
    marks = F.transform(terms, lambda t: F.struct(t.alias("word"), F.lit(-1).alias("start"), F.lit(-1).alias("end")))

    def told(items: Column) -> Column:
        # the place of the last term before each word; the word is told if that term is its own
        last = _prefixes(F.transform(items, lambda x, i: F.when(x["start"] < 0, i).otherwise(0)), _most)
        same = lambda x, mark: (x["start"] >= 0) & (mark["start"] < 0) & (mark["word"] == x["word"])
        spans = F.zip_with(items, last, lambda x, i: F.when(same(x, F.get(items, i)), _span(x["start"], F.lit(KINDS.index("term")), x["end"])))
        return F.filter(spans, lambda s: s.isNotNull())

    return _let(F.sort_array(F.concat(marks, words)), told)


def _all_spans(text: Column, base: Column, terms: Column) -> Column:
    """Base spans and the occurrences of the terms outside them, sorted; texts without terms are not searched.

    One sweep over both: an occurrence goes if a base span before it is still open, or the next one starts within it.
    """
    term = F.lit(KINDS.index("term"))

    def outside(spans: Column) -> Column:
        opened = _prefixes(F.transform(spans, lambda s: F.when(s["rank"] < term, s["end"]).otherwise(0)), _most)
        ended = F.zip_with(spans, opened, lambda s, at: F.struct(s.alias("s"), at.alias("at")))
        cut = lambda s, after: F.coalesce((after["rank"] < term) & (after["start"] < s["end"]), F.lit(False))
        free = lambda x, i: (x["s"]["rank"] < term) | (x["at"] <= x["s"]["start"]) & ~cut(x["s"], F.get(spans, i + 1))
        return F.transform(F.filter(ended, free), lambda x: x["s"])

    return F.when(terms.isNotNull(), _let(F.sort_array(F.concat(base, _told(text, terms))), outside)).otherwise(base)


def _with_spans(docs: DataFrame, base: str, spans: str) -> DataFrame:
    """``docs`` with its base spans and all spans, both sorted."""
    h, key, terms = (with_row_key(docs, x) for x in ("_h", "_key", "_terms"))
    extra = _holding_terms(docs).select(F.col("h").alias(h), F.col("terms").alias(terms))
    listed = extra.agg(F.coalesce(F.sum(F.size(terms)), F.lit(0))).first()[0]
    joined = docs.withColumn(key, F.xxhash64(_text())).join(F.broadcast(extra) if listed <= BROADCAST_ROWS else extra, F.col(key) == F.col(h), "left")
    joined = joined.withColumn(base, base_spans(_text()))
    return joined.withColumn(spans, _all_spans(_text(), F.col(base), F.col(terms))).select(*docs.columns, base, spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans (base and terms) and n_term of every document.

    A null text counts as empty: no spans. Repeated rows get the same spans. Other columns are ignored; an empty table
    gives an empty result. Terms are learned from documents that hold an entity and found in all.
    """
    out = _with_spans(docs.select("doc_id", "text"), "base", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), count(4)
    )


def _term_class(term: Column) -> Column:
    return F.when(F.upper(term) == F.lower(term), "<LETTERS>").when(F.substring(term, 1, 1) != F.lower(F.substring(term, 1, 1)), "<NAME>").otherwise("<WORD>")


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end`` of a text given as blocks."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    within = F.substring(block(first), start - first * _BLOCK + 1, end - start)
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(block(first), start - first * _BLOCK + 1, F.lit(_BLOCK)), inner, F.substring(block(last), F.lit(1), end - last * _BLOCK))
    return F.when(start >= end, F.lit("")).when(first == last, within).otherwise(across)


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every base span as ``<KIND>`` and every term as its class; overlapping spans become the first one's."""
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS[:4]])

    def joined(x: Column) -> Column:
        cut = lambda start, end: _between(x["blocks"], start, end)
        tag = lambda s: F.when(s["rank"] == KINDS.index("term"), _term_class(cut(s["start"], s["end"]))).otherwise(F.get(tags, s["rank"]))
        ends = F.transform(x["spans"], lambda s: s["end"])
        new = F.zip_with(x["spans"], _prefixes(ends, _most), lambda s, at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), tag(s))))
        return F.concat(F.array_join(new, ""), cut(F.coalesce(F.array_max(ends), F.lit(0)), x["size"]))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return _let(F.struct(blocks.alias("blocks"), F.length(text).alias("size"), spans.alias("spans")), joined)


def sanitize(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; columns stay as they are, null texts stay null."""
    base, spans = (with_row_key(docs, x) for x in ("_base", "_spans"))
    out = _with_spans(docs, base, spans)
    text = F.col("text").cast("string")
    clean = F.when(F.size(F.col(spans)) > 0, _replaced(text, F.col(spans))).otherwise(text)
    return out.withColumn("text", clean).select(*docs.columns)

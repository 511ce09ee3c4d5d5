"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens place every turn on a line; the line is cut into slabs of fixed width, and a slab's window holds
the turns that begin in it, whole. Where the last of them sticks out of its slab and the window would be too full, that turn
has a window of its own, so no turn is cut and spans need no walk over the conversation. Every later window begins with the
system turn and with as many turns before it as fit the history budget; the loss mask covers assistant turns only where they
are new. A prefix sum is taken by blocks of turns, and the blocks' sums by conversation, so one long conversation is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
#: Turn numbers that share a block.
BLOCK = 256
#: Slabs that one row of a system turn is repeated over at once.
_REPEATS = 4096
# A turn is <s>, a tag by role, the escaped text and </s>.
OPEN, CLOSE = "<s>", "</s>"
TAGS = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
OTHER, OTHER_END = "[ROLE]", "[/ROLE]"
_REST = r"/?(?:s>|(?:SYS|INST|OUT|ROLE)\])"
#: Words of up to four letters or digits and single other characters, in place of a tokenizer, which native functions have not; two more a turn.
TOKENS = r"[0-9A-Za-z]{1,4}|[^0-9A-Za-z\x09-\x0D\x20]"
TURN_TOKENS = 2


def escape(text: Column) -> Column:
    """A backslash more behind the bracket of all that would be a control string, but for backslashes there."""
    return F.regexp_replace(text, r"([<\[])(\\*" + _REST + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*" + _REST + ")", "$1$2")


def _tag(role: Column) -> Column:
    out = F.concat(F.lit(OTHER), escape(role), F.lit(OTHER_END))
    for name, tag in TAGS.items():
        out = F.when(role == name, F.lit(tag)).otherwise(out)
    return out


def _positioned(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with ``start``, the tokens before them without the system turn (-1 for itself), and ``room``, the slab's width."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK), F.lit(-(1 << 62))).alias("block"), (F.regexp_count(text, F.lit(TOKENS)) + TURN_TOKENS).cast("long").alias("tokens"),
    )
    whole = Window.partitionBy("key")
    blocks = turns.groupBy("key", "block").agg(F.sum("tokens").alias("total"), F.min(F.struct("turn", "role", "tokens")).alias("first"))
    first = F.first("first").over(whole.orderBy("block"))
    blocks = blocks.select(
        "key", "block", F.sum("total").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("done") - F.col("total"),
        F.when(first["role"] == "system", first["tokens"]).otherwise(0).alias("system"), F.sum("total").over(whole).alias("all"),
    ).toDF("key", "block", "before", "system", "all")
    inside = F.sum("tokens").over(Window.partitionBy("key", "block").orderBy("turn", "role", "tokens", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("before") + inside - F.col("tokens")
    room = F.greatest(F.lit(budget) - F.col("system") - history, F.lit(history), F.lit(max(1, budget // 4)))
    at = turns.join(blocks, ["key", "block"]).withColumn("start", start)
    is_system = (F.col("start") == 0) & (F.col("system") > 0)
    return at.withColumn("is_system", is_system).withColumn("start", F.when(is_system, -1).otherwise(F.col("start") - F.col("system"))).withColumn("room", room)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, slab, part, text, loss, n_turns, n_repeated, n_tokens, over_budget), a row for each window, in order of slab and part.

    ``loss`` are the spans (code points of ``text``, end exclusive) of new assistant texts; the first ``n_repeated`` turns
    of a window are repeated ones. Turns follow ``turn`` (null first), then role, tokens and text; repeated rows are turns each,
    and rows of one turn stay in one block. A turn of role ``system`` that comes first is kept in every window. Null texts and
    roles are empty. A null conv_id is a conversation. Turns are never cut: a window passes the budget (``over_budget``) where a turn
    is longer than the room that system turn and history leave, or the system turn leaves too little. Empty tables give no rows.
    """
    turns = _positioned(conversations, budget, history)
    tag, body = _tag(F.col("role")), escape(F.col("text"))
    opened = F.concat(F.lit(OPEN), tag)
    turns = turns.select(
        "key", "conv_id", "start", "tokens", "room", "all", "system", "is_system", F.when(F.col("is_system"), 0).otherwise(F.floor(F.col("start") / F.col("room"))).alias("slab"),
        F.length(opened).alias("skip"), F.length(body).alias("size"), (F.col("role") == "assistant").alias("target"), F.concat(opened, body, F.lit(CLOSE)).alias("line"),
    )
    turn = lambda own: F.struct(F.lit(own).alias("own"), *(F.col(c) for c in ("start", "tokens", "is_system", "skip", "size", "target", "line")))
    after = (F.col("slab") + 1) * F.col("room")
    # rooms are no narrower than the history, so only the next slab can repeat a turn
    near = ~F.col("is_system") & (F.col("start") >= after - history) & (F.col("start") + F.col("tokens") <= after + F.col("room"))
    entries = F.explode(F.array_compact(F.array(F.struct("slab", turn(True).alias("turn")), F.when(near, F.struct((F.col("slab") + 1).alias("slab"), turn(False).alias("turn"))))))
    carried = turns.select("key", "conv_id", "room", entries.alias("e")).select("key", "conv_id", "room", "e.slab", "e.turn")
    last = F.floor((F.col("all") - F.col("system")) / F.col("room"))
    kept = turns.where("is_system").withColumn("last", last).where("last >= 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / _REPEATS)))).repartition("key", "part")
    low, high = F.greatest(F.lit(1).cast("long"), F.col("part") * _REPEATS), F.least(F.col("last"), F.col("part") * _REPEATS + _REPEATS - 1)
    kept = kept.where(low <= high).withColumn("slab", F.explode(F.sequence(low, high))).select("key", "conv_id", "room", "slab", turn(False).alias("turn"))
    slabs = carried.unionByName(kept).groupBy("key", "slab").agg(F.min("conv_id").alias("conv_id"), F.min("room").alias("room"), F.array_sort(F.collect_list(F.struct(F.col("turn.start").alias("at"), "turn"))).alias("turns"))
    slabs = slabs.withColumn("turns", F.transform("turns", lambda x: x["turn"]))

    system = F.filter("turns", lambda x: x["is_system"])
    own = F.filter("turns", lambda x: x["own"] & ~x["is_system"])
    rest = F.filter("turns", lambda x: ~x["own"] & ~x["is_system"])
    slabs = slabs.select("key", "slab", "conv_id", "room", system.alias("system"), own.alias("new"), rest.alias("rest"))
    system, new, rest, room = (F.col(c) for c in ("system", "new", "rest", "room"))
    end, begin = F.get("new", F.size("new") - 1), F.get("new", F.lit(0))["start"]
    sticks = end["start"] + end["tokens"] > (F.col("slab") + 1) * room
    total = end["start"] + end["tokens"] - begin
    split = (F.size("new") > 1) & sticks & (total > room)
    recent = lambda turns, begin: F.filter(turns, lambda x: x["start"] >= begin - history)
    window = lambda part, repeated, own: F.struct(F.lit(part).alias("part"), repeated.alias("repeated"), own.alias("new"))
    fresh = F.get(system, F.lit(0))["own"]
    head = F.when(fresh, F.slice(system, 1, 0)).otherwise(system)
    before = F.filter(new, lambda x: x["start"] < end["start"])
    lead = F.concat(F.when(fresh, system).otherwise(F.slice(system, 1, 0)), F.when(split, before).otherwise(new))
    alone = F.filter(new, lambda x: x["start"] == end["start"])
    first = window(0, F.concat(head, F.when(F.size(new) > 0, recent(rest, begin)).otherwise(F.slice(rest, 1, 0))), lead)
    second = window(1, F.concat(system, recent(F.concat(rest, before), end["start"])), alone)
    windows = slabs.select("conv_id", "slab", F.explode(F.when(split, F.array(first, second)).otherwise(F.array(first))).alias("w")).where(F.size("w.new") > 0)

    turns, repeated = F.concat("w.repeated", "w.new"), F.size("w.repeated")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(held: Column, x: Column) -> Column:
        begin = held["at"] + x["skip"]
        span = F.array(F.struct(begin.alias("begin"), (begin + x["size"]).alias("end")))
        spans = F.when((held["n"] >= repeated) & x["target"], F.concat(held["spans"], span)).otherwise(held["spans"])
        return F.struct((held["at"] + F.length(x["line"])).alias("at"), (held["n"] + 1).alias("n"), spans.alias("spans"))

    tokens = F.aggregate(turns, F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    return windows.select(
        "conv_id", "slab", "w.part", F.array_join(F.transform(turns, lambda x: x["line"]), "").alias("text"), F.aggregate(turns, start, add)["spans"].alias("loss"),
        F.size(turns).alias("n_turns"), repeated.alias("n_repeated"), tokens.alias("n_tokens"), (tokens > budget).alias("over_budget"),
    )


def parsed_turns(text: Column) -> Column:
    """Turns of a window's text as (role, text); what stands between markers is unescaped."""

    def parse(line: Column) -> Column:
        inner = F.substring(line, len(OPEN) + 1, 1 << 30)
        named = F.substring(inner, len(OTHER) + 1, 1 << 30)
        end = F.instr(named, OTHER_END)
        role, body = F.substring(named, F.lit(1), end - 1), F.substring(named, end + len(OTHER_END), F.lit(1 << 30))
        for name, tag in TAGS.items():
            mine = F.startswith(inner, F.lit(tag))
            role, body = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, F.substring(inner, len(tag) + 1, 1 << 30)).otherwise(body)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    lines = F.split(text, CLOSE)
    return F.transform(F.slice(lines, 1, F.size(lines) - 1), parse)


def loss_text(text: Column, loss: Column) -> Column:
    """What a window teaches: the text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["begin"] + 1, s["end"] - s["begin"]))), "")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, max_window_tokens), from windows alone.

    A conversation's digest runs over its whole text, which is one value, as the digest functions take no parts.
    """
    new = F.slice(parsed_turns(F.col("text")), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = windows.select(
        "conv_id", F.struct("slab", "part", said.alias("said"), loss_text(F.col("text"), F.col("loss")).alias("taught")).alias("w"),
        F.size(new).alias("n"), F.length("text").alias("chars"), "n_tokens",
    )
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.max("n_tokens").alias("max_window_tokens")
    )
    taught = F.array_join(F.transform("w", lambda x: x["taught"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(taught).cast("long").alias("loss_chars"), F.sha2(taught, 256).alias("loss_sha256"), "formatted_chars", "n_windows", "max_window_tokens",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, which says the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT *, len(regexp_extract_all(text, '[0-9A-Za-z]{1,4}|[^0-9A-Za-z\x09-\x0D\x20]')) + 2 AS tokens,
    7 + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 5 ELSE 13 + length(role) END
      + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|(?:SYS|INST|OUT|ROLE)\]))', '\1\\\2', 'g')) AS chars FROM said),
summed AS (SELECT *, sum(tokens) OVER w - tokens AS start, first(role) OVER w AS role0, first(tokens) OVER w AS tokens0 FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, tokens, text ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT *, CASE WHEN role0 = 'system' THEN tokens0 ELSE 0 END AS system, role0 = 'system' AND start = 0 AS is_system FROM summed),
own AS (SELECT conv_id, turn, role, text, tokens, chars, is_system, start - system AS a, start - system + tokens AS z, greatest(512 - system - 128, 128) AS room,
    (start - system) // greatest(512 - system - 128, 128) AS slab FROM placed WHERE NOT is_system),
wide AS (SELECT *, max(z) OVER s - min(a) OVER s > room AND z > (slab + 1) * room AND count(*) OVER s > 1 AS part FROM own WINDOW s AS (PARTITION BY conv_id, slab)),
windows AS (SELECT conv_id, slab, part, min(a) AS a, sum(chars) AS chars, sum(tokens) AS tokens FROM wide GROUP BY ALL),
lone AS (SELECT conv_id, chars, tokens FROM placed WHERE is_system),
past AS (SELECT w.conv_id, w.slab, w.part, sum(o.chars) AS chars, sum(o.tokens) AS tokens FROM windows w JOIN own o ON o.conv_id = w.conv_id AND o.slab BETWEEN w.slab - 1 AND w.slab AND o.a < w.a AND o.a >= w.a - 128 GROUP BY ALL),
full_windows AS (SELECT conv_id, w.chars + coalesce(p.chars, 0) + coalesce(s.chars, 0) AS chars, w.tokens + coalesce(p.tokens, 0) + coalesce(s.tokens, 0) AS tokens
  FROM windows w LEFT JOIN past p USING (conv_id, slab, part) LEFT JOIN lone s USING (conv_id)),
sizes AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*) AS n_windows, max(tokens)::BIGINT AS max_window_tokens FROM
  (SELECT * FROM full_windows UNION ALL SELECT conv_id, chars, tokens FROM lone WHERE conv_id NOT IN (SELECT conv_id FROM windows)) GROUP BY conv_id),
digests AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, tokens, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, tokens, text) FILTER (WHERE role = 'assistant'), '') AS taught FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(taught) AS loss_chars, sha256(taught) AS loss_sha256, formatted_chars, n_windows, max_window_tokens
FROM digests JOIN sizes USING (conv_id)
"""

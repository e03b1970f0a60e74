"""Chat formatting: quotations are linked to the messages that they quote, then dropped.

Lines are read with their level of `>` marks. Runs of one level are passages; they are
normalised to words, so that wrapping does not matter, and hashed: in windows of WINDOW
words, or as a whole if they are shorter. Within a conversation each hash is joined to the
last earlier message whose own text has it. A passage belongs to the message that its
rarest hash leads to, if over half of its hashes are there, or else to the one that over
half of its hashes lead to. The message that most of the least nested quotations come from
is the one replied to; without one it is the message before.

A message that replies to another than the one before it starts a branch. Branches form a
tree; its depth-first order puts every message after the one that it replies to, and is
found by pointer jumping in rounds that grow with the logarithm of the branches. No task
holds a conversation: turns are ordered in blocks, which are summed first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, sent

#: Words of a window; a shorter passage must be a whole line, sentence or message.
WINDOW = 5
#: Turns whose order one task settles; blocks of them are summed first.
BLOCK = 256
_MARKS = re.compile(r"(?:[ \t]*>)+")
_UNITS = re.compile(r"\n|(?<=[.!?])\s+")
#: Tells texts with a quoted line.
_QUOTING = r"(?:^|\n)[ \t]*>"


def quote_level(line: str) -> tuple[int, str]:
    """The number of leading `>` marks, white space between them or not, and the rest of the line."""
    m = _MARKS.match(line)
    return (m[0].count(">"), line[m.end() :].strip()) if m else (0, line)


def normalised(text: str) -> list[str]:
    return text.casefold().split()


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 0)
    return x - (1 << 64) if x >> 63 else x


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and its quoted passages with their levels, in order."""
    own, passages = [], []
    run: list[str] = []
    at = 0
    for line in [*(text or "").split("\n"), None]:
        level, rest = quote_level(line) if line is not None else (-1, "")
        if level != at:
            if at > 0:
                passages.append((at, "\n".join(run)))
            run, at = [], level
        if level > 0:
            run.append(rest)
        elif level == 0:
            own.append(rest)
    return "\n".join(own).strip("\n") if passages else (text or ""), passages


def passage_keys(words: list[str]) -> list[int]:
    """Hashes by which a passage is found: of its windows, or of all of it if it is shorter than one."""
    if len(words) < WINDOW:
        return [_hash(" ".join(words))] if words else []
    return sorted({_hash(" ".join(words[i : i + WINDOW])) for i in range(len(words) - WINDOW + 1)})


def own_keys(text: str) -> list[int]:
    """Hashes by which a message's own text is found: of its windows, and of its shorter lines and sentences."""
    words = normalised(text)
    out = set(passage_keys(words))
    for unit in _UNITS.split(text):
        short = normalised(unit)
        if 0 < len(short) < WINDOW:
            out.add(_hash(" ".join(short)))
    return sorted(out)


_LONGS = pa.list_(pa.int64())
_KEY = ["kn", "kc"]


def _keyed(messages: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """messages with kn and kc, by which conversations join, null being one, and turn."""
    conv = F.col(conv_col).cast("long")
    return messages.withColumns({"kn": conv.isNull(), "kc": F.coalesce(conv, F.lit(0)), "turn": F.col(turn_col).cast("long")})


def asked_hashes(quoting: DataFrame) -> DataFrame:
    """kn, kc, turn, passage, level, size, hashes (their number), h: what messages quote. quoting: kn, kc, turn, text."""
    fields = pa.list_(pa.struct([("passage", pa.int64()), ("level", pa.int64()), ("size", pa.int64()), ("keys", _LONGS)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(3):
                found = {}
                for level, p in parse(t.as_py())[1]:
                    words = normalised(p)
                    if words:
                        name = _hash(f"{level} {' '.join(words)}")
                        found[name] = {"passage": name, "level": level, "size": sum(map(len, words)), "keys": passage_keys(words)}
                out.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, fields)], ["kn", "kc", "turn", "quoted"])

    rows = quoting.select("kn", "kc", "turn", "text").mapInArrow(run, "kn boolean, kc bigint, turn bigint, quoted array<struct<passage:bigint,level:bigint,size:bigint,keys:array<bigint>>>")
    one = rows.select("kn", "kc", "turn", F.explode("quoted").alias("q")).select("kn", "kc", "turn", "q.*")
    return one.select("kn", "kc", "turn", "passage", "level", "size", F.size("keys").alias("hashes"), F.explode("keys").alias("h")).distinct()


def own_hashes(rows: DataFrame) -> DataFrame:
    """kn, kc, turn, h of messages' own texts. rows: kn, kc, turn, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([own_keys(parse(t.as_py())[0]) for t in b.column(3)], _LONGS)], ["kn", "kc", "turn", "own"])

    out = rows.select("kn", "kc", "turn", "text").mapInArrow(run, "kn boolean, kc bigint, turn bigint, own array<bigint>")
    return out.select("kn", "kc", "turn", F.explode("own").alias("h")).distinct()


def last_before(rows: DataFrame, keys: list[str], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """rows with the largest value among rows of the same keys and an earlier turn (or the same, if inclusive).

    Blocks of turns are settled apart and meet by their largest values, so that a key
    with very many rows is not one task's. keys and turn must not be null.
    """
    rows = rows.withColumns({"__block": F.floor(F.col("turn") / BLOCK), "__value": value})
    by = Window.partitionBy(*keys, "__block").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    blocks = rows.groupBy(*keys, "__block").agg(F.max("__value").alias("__most"))
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__block", F.max("__most").over(over).alias("__before"))
    out = rows.withColumn("__here", F.max("__value").over(by)).join(blocks, [*keys, "__block"])
    return out.withColumn(name, F.greatest("__here", "__before")).drop("__block", "__value", "__here", "__before")


def placed_turns(turns: DataFrame) -> DataFrame:
    """kn, kc, turn, previous, rank (from 0), first of the distinct turns of every conversation, in blocks."""
    rows = turns.select(*_KEY, "turn", F.floor(F.col("turn") / BLOCK).alias("block")).distinct()
    blocks = rows.groupBy(*_KEY, "block").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.min("turn").alias("least"))
    over = Window.partitionBy(*_KEY).orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*_KEY, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.max("last").over(before).alias("last"), F.min("least").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    within = Window.partitionBy(*_KEY, "block").orderBy("turn")
    rows = rows.withColumns({"i": F.row_number().over(within) - 1, "lag": F.lag("turn").over(within)})
    return rows.join(blocks, [*_KEY, "block"]).select(*_KEY, "turn", F.coalesce("lag", "last").alias("previous"), (F.col("n") + F.col("i")).alias("rank"), "first")


def replies(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """kn, kc, turn, quoted_turn, n_linked of the messages whose quotations were found. rows: kn, kc, turn, text."""
    convs = cut(asked.select(*_KEY).distinct())
    wanted = asked.select(*_KEY, "h").distinct()
    own = cut(own_hashes(rows.join(sent(convs), _KEY, "left_semi")).join(wanted, [*_KEY, "h"], "left_semi"))
    none = F.lit(None).cast("long")
    both = asked.withColumn("original", none).unionByName(own.select(*_KEY, "turn", "h", F.col("turn").alias("original")), allowMissingColumns=True)
    found = last_before(both, [*_KEY, "h"], F.col("original"), "source").where("passage is not null and source is not null")
    found = cut(found.select(*_KEY, "turn", "passage", "level", "size", "hashes", "h", "source"))
    passage = [*_KEY, "turn", "passage", "level", "size", "hashes"]
    # A message that has all hashes is no later than the last one that has the rarest.
    rarest = found.groupBy(*passage).agg(F.min("source").alias("rare"))
    held = found.join(rarest.select(*_KEY, "turn", "passage", "rare"), [*_KEY, "turn", "passage"]).withColumn("__at", F.col("rare"))
    there = own.select(*_KEY, "h", F.col("turn").alias("__at"), F.lit(1).alias("hit"))
    held = held.join(there, [*_KEY, "h", "__at"], "left").groupBy(*passage, "rare").agg(F.count("hit").alias("rare_n"))
    votes = found.groupBy(*passage, "source").agg(F.count("*").alias("n"))
    most = votes.groupBy(*passage).agg(F.max(F.struct("n", "source")).alias("m"))
    best = most.join(held.select(*_KEY, "turn", "passage", "rare", "rare_n"), [*_KEY, "turn", "passage"])
    rare = F.col("rare_n") * 2 > F.col("hashes")
    best = best.where(rare | (F.col("m.n") * 2 > F.col("hashes"))).withColumn("source", F.when(rare, F.col("rare")).otherwise(F.col("m.source")))
    linked = best.groupBy(*_KEY, "turn", "source").agg(F.min("level").alias("level"), F.sum("size").alias("size"))
    top = F.max(F.struct(-F.col("level"), "size", "source")).getField("source").alias("quoted_turn")
    return linked.groupBy(*_KEY, "turn").agg(top, F.count("*").alias("n_linked"))


def _jumped(df: DataFrame, step) -> DataFrame:
    """df(kn, kc, b, hop, ...) after step, which reads the row that hop points to under names that start with o_, until no hop is left."""
    df = cut(df)
    while not df.where("hop is not null").isEmpty():
        other = df.select(*_KEY, F.col("b").alias("hop"), *(F.col(c).alias(f"o_{c}") for c in df.columns if c not in (*_KEY, "b")))
        df = cut(step(df.join(other, [*_KEY, "hop"], "left")).select(*df.columns))
    return df


def tree_order(nodes: DataFrame) -> DataFrame:
    """kn, kc, turn, branch, position of turns(kn, kc, turn, previous, rank, reply), which is depth-first.

    A branch is a run of turns that reply to the one before. A message's own run goes on
    before branches that reply to it, so that of the branches that hang on one run the
    last hung come first, and of those of one message the earliest.
    """
    start = F.col("previous").isNull() | (F.col("reply") != F.col("previous"))
    nodes = cut(last_before(nodes, _KEY, F.when(start, F.col("turn")), "branch", inclusive=True))
    size = nodes.groupBy(*_KEY, F.col("branch").alias("b")).agg(F.count("*").alias("size"))
    heads = nodes.where(start).select(*_KEY, F.col("turn").alias("b"), F.col("reply").alias("p"), F.col("rank").alias("head_rank"))
    parents = nodes.select(*_KEY, F.col("turn").alias("p"), F.col("branch").alias("pb"))
    heads = heads.join(size, [*_KEY, "b"]).join(parents, [*_KEY, "p"], "left")
    kin = Window.partitionBy(*_KEY, "pb").orderBy(F.desc("p"), "b")
    heads = cut(heads.withColumn("sibling", F.when(F.col("pb").isNotNull(), F.lead("b").over(kin))))
    child = heads.where("pb is not null").groupBy(*_KEY, F.col("pb").alias("b")).agg(F.max_by("b", F.struct("p", -F.col("b"))).alias("child"))
    # Past a branch and all that hangs on it: its next sibling, or that of the nearest branch above that has one.
    up = heads.select(*_KEY, "b", F.when(F.col("sibling").isNull(), F.col("pb")).alias("hop"), F.col("sibling").alias("past"))
    past = _jumped(up, lambda j: j.withColumn("past", F.coalesce("past", "o_past")).withColumn("hop", F.when(F.col("past").isNull(), F.col("o_hop"))))
    following = heads.join(past.select(*_KEY, "b", "past"), [*_KEY, "b"]).join(child, [*_KEY, "b"], "left")
    # Messages from a branch's start to the end of the conversation.
    chain = following.select(*_KEY, "b", F.coalesce("child", "past").alias("hop"), F.col("size").alias("left"))
    ranked = _jumped(chain, lambda j: j.withColumn("left", F.col("left") + F.coalesce("o_left", F.lit(0))).withColumn("hop", F.col("o_hop")))
    whole = size.groupBy(*_KEY).agg(F.sum("size").alias("whole"))
    at = ranked.join(whole, _KEY).join(heads.select(*_KEY, "b", "head_rank"), [*_KEY, "b"]).select(*_KEY, F.col("b").alias("branch"), (F.col("whole") - F.col("left") - F.col("head_rank")).alias("shift"))
    return nodes.join(at, [*_KEY, "branch"]).select(*_KEY, "turn", "reply", "branch", (F.col("shift") + F.col("rank")).alias("position"))


def settled(messages: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """kn, kc, turn, n_linked, reply_to, branch, position of every distinct turn."""
    rows = _keyed(messages, conv_col, turn_col).select(*_KEY, "turn", F.col(text_col).cast("string").alias("text")).where("turn is not null")
    turns = cut(placed_turns(rows))
    asked = cut(asked_hashes(rows.where(F.col("text").rlike(_QUOTING))))
    plain = turns.select(*_KEY, "turn", F.lit(0).cast("long").alias("n_linked"), F.col("previous").alias("reply_to"), F.col("first").alias("branch"), F.col("rank").alias("position"))
    if asked.isEmpty():
        return plain
    linked = cut(replies(rows, asked))
    convs = sent(cut(linked.select(*_KEY).distinct()))
    nodes = turns.join(convs, _KEY, "left_semi").join(linked, [*_KEY, "turn"], "left").withColumn("reply", F.coalesce("quoted_turn", "previous"))
    counts = linked.select(*_KEY, "turn", "n_linked")
    ordered = tree_order(nodes.select(*_KEY, "turn", "previous", "rank", "reply")).join(counts, [*_KEY, "turn"], "left")
    ordered = ordered.select(*_KEY, "turn", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("reply").alias("reply_to"), "branch", "position")
    return plain.join(convs, _KEY, "left_anti").unionByName(ordered)


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conversation, turn, role, content without quotes, n_quotes, n_linked, reply_to, branch, position.

    n_quotes counts quoted passages and n_linked the messages that any of them was found
    in; reply_to and branch are turns, branch the one that starts the message's branch.
    position, from 0, is the message's place in the conversation in reply order: each
    comes after the one that it replies to, and a branch is not interrupted. A null text
    is empty. Messages of a null conversation form one; a message without a turn has no
    reply_to, branch and position and quotes nothing. Repeated rows and rows of one turn
    are settled alike; other columns are not read; an empty table gives no rows.

    Only messages with quotations go through Python, and texts are joined once, to what
    was settled of their turns, which goes to every task if its rows, counted, are few.
    """
    bounded(messages.sparkSession)
    found = cut(settled(messages, conv_col, turn_col, text_col))
    one = found.select(F.col("kn").alias("__n"), F.col("kc").alias("__c"), F.col("turn").alias("__t"), "n_linked", "reply_to", "branch", "position")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([t for t, _ in got], pa.string()), pa.array([len(p) for _, p in got], pa.int64())], ["conv", "turn", "role", "text", "n_quotes"])

    quoting = F.col("text").rlike(_QUOTING)
    rows = rows.where(~quoting).withColumn("n_quotes", F.lit(0).cast("long")).unionByName(rows.where(quoting).mapInArrow(stripped, "conv bigint, turn bigint, role string, text string, n_quotes bigint"))
    same = (F.col("conv").isNull() == F.col("__n")) & (F.coalesce("conv", F.lit(0).cast("long")) == F.col("__c")) & (F.col("turn") == F.col("__t"))
    out = rows.join(sent(one), same, "left")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "branch", "position")


def chat_lines(messages: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """messages with a column chat: the message between its role's marks."""
    return messages.withColumn("chat", F.concat(F.lit("<|"), F.coalesce(role_col, F.lit("user")), F.lit("|>\n"), F.coalesce(text_col, F.lit("")), F.lit("\n<|end|>\n")))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, n_quotes, n_linked, reply_to, branch, chat of every message; sorted by conv_id and position they are the conversations."""
    return chat_lines(conversations(messages)).select("conv_id", "position", "turn", "n_quotes", "n_linked", "reply_to", "branch", "chat")


def oracle() -> str:
    """The query's SQL, for texts whose letters fold one to one and whose white space is ASCII."""
    word = "regexp_extract_all(lower({0}), '[^\\s]+')"
    windows = lambda w: f"[array_to_string({w}[i:i + {WINDOW - 1}], ' ') for i in range(1, len({w}) - {WINDOW - 2})]"
    keys = lambda w: f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < {WINDOW} THEN [array_to_string({w}, ' ')] ELSE list_distinct({windows(w)}) END"
    units = "list_concat(string_split(own, chr(10)), string_split(regexp_replace(own, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)))"
    short = f"[array_to_string({word.format('u')}, ' ') for u in {units} if len({word.format('u')}) BETWEEN 1 AND {WINDOW - 1}]"
    return f"""
    WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id AS conv, turn, role, coalesce(text, '') AS text FROM conversations),
    ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m),
    lv AS (SELECT rid, i, line, regexp_extract(line, '^(?:[ \\t]*>)+') AS marks FROM ln),
    le AS (SELECT rid, i, line, length(marks) - length(replace(marks, '>', '')) AS level, substr(line, length(marks) + 1) AS rest FROM lv),
    ru AS (SELECT *, level <> coalesce(lag(level) OVER (PARTITION BY rid ORDER BY i), -1) AS fresh FROM le),
    gr AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM ru),
    ps AS (SELECT rid, run, any_value(level) AS level, string_agg(rest, ' ' ORDER BY i) AS passage FROM gr WHERE level > 0 GROUP BY rid, run),
    ow AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), '') AS own, max(level) > 0 AS quotes FROM gr GROUP BY rid),
    c AS (SELECT m.*, CASE WHEN quotes THEN trim(own, chr(10)) ELSE text END AS own, (SELECT count(*) FROM ps WHERE ps.rid = m.rid) AS n_quotes FROM m JOIN ow ON m.rid = ow.rid),
    t AS (SELECT DISTINCT conv, turn FROM c WHERE turn IS NOT NULL),
    pl AS (SELECT *, lag(turn) OVER (PARTITION BY conv ORDER BY turn) AS previous FROM t),
    q AS (SELECT DISTINCT conv, turn, level, {word.format('passage')} AS w FROM ps JOIN c ON ps.rid = c.rid WHERE turn IS NOT NULL AND len({word.format('passage')}) > 0),
    a AS (SELECT conv, turn, level, w, length(array_to_string(w, '')) AS size, len({keys('w')}) AS hashes, unnest({keys('w')}) AS h FROM q),
    o AS (SELECT DISTINCT conv, turn, unnest(list_concat({keys(word.format('own'))}, {short})) AS h FROM c WHERE turn IS NOT NULL),
    f AS (SELECT a.conv, a.turn, level, w, size, hashes, a.h, max(o.turn) AS source FROM a JOIN o ON a.conv IS NOT DISTINCT FROM o.conv AND a.h = o.h AND o.turn < a.turn GROUP BY ALL),
    ra AS (SELECT conv, turn, level, w, size, hashes, min(source) AS rare FROM f GROUP BY ALL),
    he AS (SELECT f.conv, f.turn, f.level, f.w, rare, count(o.h) AS n FROM f JOIN ra ON f.conv IS NOT DISTINCT FROM ra.conv AND f.turn = ra.turn AND f.level = ra.level AND f.w = ra.w
           LEFT JOIN o ON f.conv IS NOT DISTINCT FROM o.conv AND o.turn = rare AND o.h = f.h GROUP BY ALL),
    vo AS (SELECT conv, turn, level, w, size, hashes, source, count(*) AS n FROM f GROUP BY ALL),
    mo AS (SELECT *, row_number() OVER (PARTITION BY conv, turn, level, w ORDER BY n DESC, source DESC) AS k FROM vo),
    be AS (SELECT mo.conv, mo.turn, mo.level, size, CASE WHEN he.n * 2 > hashes THEN rare ELSE source END AS source FROM mo JOIN he ON mo.conv IS NOT DISTINCT FROM he.conv AND mo.turn = he.turn AND mo.level = he.level AND mo.w = he.w
           WHERE k = 1 AND (he.n * 2 > hashes OR mo.n * 2 > hashes)),
    li AS (SELECT conv, turn, source, min(level) AS level, sum(size) AS size FROM be GROUP BY ALL),
    re AS (SELECT conv, turn, count(*) AS n_linked, arg_max(source, (-level, size, source)) AS quoted FROM li GROUP BY conv, turn),
    tr AS (SELECT pl.*, coalesce(n_linked, 0) AS n_linked, coalesce(quoted, previous) AS reply FROM pl LEFT JOIN re ON pl.conv IS NOT DISTINCT FROM re.conv AND pl.turn = re.turn),
    br AS (SELECT *, max(CASE WHEN previous IS NULL OR reply <> previous THEN turn END) OVER (PARTITION BY conv ORDER BY turn) AS branch FROM tr),
    pa AS (SELECT conv, turn, [turn] AS path FROM br WHERE reply IS NULL UNION ALL SELECT br.conv, br.turn, list_append(path, br.turn) FROM br JOIN pa ON br.conv IS NOT DISTINCT FROM pa.conv AND br.reply = pa.turn),
    po AS (SELECT conv, turn, row_number() OVER (PARTITION BY conv ORDER BY path) - 1 AS position FROM pa)
    SELECT c.conv AS conv_id, po.position, c.turn, c.n_quotes, coalesce(br.n_linked, 0) AS n_linked, br.reply AS reply_to, br.branch,
      '<|' || coalesce(role, 'user') || '|>' || chr(10) || c.own || chr(10) || '<|end|>' || chr(10) AS chat
    FROM c LEFT JOIN br ON c.conv IS NOT DISTINCT FROM br.conv AND c.turn = br.turn LEFT JOIN po ON c.conv IS NOT DISTINCT FROM po.conv AND c.turn = po.turn"""

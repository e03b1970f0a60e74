import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from postlake.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, h string, branch string, source int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA).repartition(2)


def test_parse():
    text, passages = Q.parse("Hi\n> one\n>two\n>> deep\n> > deeper\n>back\nBye\n")
    assert text == "Hi\nBye" and passages == [(1, "one\ntwo"), (2, "deep\ndeeper"), (1, "back")]
    assert Q.parse(None) == ("", []) and Q.parse("a\n\nb\n") == ("a\n\nb\n", [])


@pytest.mark.parametrize("block", [256, 2])
def test_links_and_branches(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rows = [
        (1, 0, "user", "How do I sort a list?\nThanks"), (1, 1, "assistant", "Use sorted.\nIt is stable."), (1, 2, "user", "And a dict?\nThanks"),
        (1, 3, "assistant", "> How do I  SORT a list?\nAlso list.sort."), (1, 4, "user", "> > How do I sort a list?\n> Also list.sort.\nGood."), (1, 5, "user", "> never said\nOdd"), (1, 6, "user", "> Thanks\nWelcome"),
        (2, 0, "user", None), (2, 5, "user", ""), (2, 5, "user", ""), (2, 9, "user", "How do I sort a list?"), (2, 10, "user", "> Use sorted.\nfrom another conversation"),
        (None, 1, "user", "alone"), (None, 2, None, "> alone\nno more"), (3, None, "user", "> x\ny"),
    ]
    got = {}
    for r in Q.conversations(frame(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.text, r.n_quotes, r.n_linked, r.reply_to, r.branch))
    assert got == {
        (1, 0): [("How do I sort a list?\nThanks", 0, 0, None, 0)], (1, 1): [("Use sorted.\nIt is stable.", 0, 0, 0, 0)], (1, 2): [("And a dict?\nThanks", 0, 0, 1, 0)],
        (1, 3): [("Also list.sort.", 1, 1, 0, 3)], (1, 4): [("Good.", 2, 2, 3, 3)], (1, 5): [("Odd", 1, 0, 4, 3)], (1, 6): [("Welcome", 1, 1, 2, 6)],
        (2, 0): [("", 0, 0, None, 0)], (2, 5): [("", 0, 0, 0, 0)] * 2, (2, 9): [("How do I sort a list?", 0, 0, 5, 0)], (2, 10): [("from another conversation", 1, 0, 9, 0)],
        (None, 1): [("alone", 0, 0, None, 1)], (None, 2): [("no more", 1, 1, 1, 1)], (3, None): [("y", 1, 0, None, None)],
    }


def test_order_holds(spark):
    rows = [(1, t, "user", f"message {t}" if t % 3 else f"> message {max(0, t - 5)}\nreply {t}") for t in range(40)]
    out = Q.conversations(frame(spark, rows)).collect()
    branch = {r.turn: r.branch for r in out}
    for r in out:
        assert r.reply_to is None or r.reply_to < r.turn
        if r.turn and branch[r.turn] != r.turn:
            assert r.reply_to == r.turn - 1 and branch[r.turn - 1] == r.branch
    assert Q.chat_lines(Q.conversations(frame(spark, rows))).where("chat like '<|user|>%<|end|>%'").count() == 40
    assert Q.conversations(frame(spark, rows).limit(0)).count() == 0


def plain(rows):
    """The same by loops over all pairs: (conversation, turn): (n_linked, reply_to, branch, position)."""
    convs = {}
    for c, t, _, text in rows:
        if t is not None:
            convs.setdefault(c, {}).setdefault(t, []).append(text or "")

    def split(text):
        own, quoted, run, at = [], [], [], 0
        for line in [*text.split("\n"), None]:
            level = 0
            if line is not None:
                rest = line
                while rest.lstrip(" \t").startswith(">"):
                    rest, level = rest.lstrip(" \t")[1:], level + 1
            if line is None or level != at:
                if at:
                    quoted.append((at, " ".join(run).casefold().split()))
                run, at = [], level
            if line is not None:
                (run if level else own).append(rest.strip() if level else line)
        return "\n".join(own), [q for q in quoted if q[1]]

    def has(text, words):
        own = text.casefold().split()
        if len(words) >= Q.WINDOW:
            return any(own[i : i + len(words)] == words for i in range(len(own)))
        return any(unit.casefold().split() == words for unit in re.split(r"\n|(?<=[.!?])\s+", text)) or own == words

    out = {}
    for c, by_turn in convs.items():
        turns = sorted(by_turn)
        own = {t: [split(x)[0] for x in by_turn[t]] for t in turns}
        reply, linked = {}, {}
        for n, t in enumerate(turns):
            votes, sizes = {}, {}
            for level, words in {(level, tuple(w)) for x in by_turn[t] for level, w in split(x)[1]}:
                windows = {words} if len(words) < Q.WINDOW else {words[i : i + Q.WINDOW] for i in range(len(words) - Q.WINDOW + 1)}
                # Each window leads to the last message before that has it; the passage belongs to the
                # one that the rarest window leads to, or else to the one that most lead to.
                owners = [next((s for s in reversed(turns[:n]) if any(has(x, list(w)) for x in own[s])), None) for w in windows]
                count = Counter(s for s in owners if s is not None)
                if count:
                    k, s = max((k, s) for s, k in count.items())
                    rare = min(count)
                    there = sum(o is not None and any(has(x, list(w)) for x in own[rare]) for o, w in zip(owners, windows))
                    if 2 * there > len(windows):
                        k, s = there, rare
                    if 2 * k > len(windows):
                        votes[s] = min(level, votes.get(s, level))
                        sizes[s] = sizes.get(s, 0) + sum(map(len, words))
            linked[t] = len(votes)
            reply[t] = max(((-v, sizes[s], s) for s, v in votes.items()), default=(0, 0, turns[n - 1] if n else None))[2]
        branch, path = {}, {}
        for n, t in enumerate(turns):
            goes_on = n and reply[t] == turns[n - 1]
            branch[t] = branch[turns[n - 1]] if goes_on else t
            path[t] = [*path[reply[t]], t] if n else [t]
        for n, t in enumerate(sorted(turns, key=path.__getitem__)):
            out[c, t] = (linked[t], reply[t], branch[t], n)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_plain_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(Q, "BLOCK", 4)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Yes.", "no", "ß"]
    rows = []
    for c in (1, 2, 3, None):
        said = []
        for t in sorted(r.sample(range(-3, 60), 18)):
            text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(r.randint(1, 3)))
            for _ in range(r.choice([0, 0, 1, 2])):
                if said:
                    old = r.choice(said).split()
                    i = r.randrange(len(old))
                    part = old[i : i + r.choice([3, 8, 40])]
                    cut = r.randint(1, len(part))  # wrapped anew
                    level = r.choice(["> ", "> > ", ">>"])
                    text = "\n".join(level + " ".join(x) for x in (part[:cut], part[cut:]) if x) + "\n" + r.choice(["", text])
            said.append("\n".join(line for line in text.split("\n") if not line.startswith(">")) or "-")
            rows += [(c, t, "user", text)] * r.choice([1, 1, 2])
    want = plain(rows)
    if seed == 3:  # SQL folds letters one to one
        rows = [(c, t, role, text.replace("ß", "z")) for c, t, role, text in rows]
        want = plain(rows)
        con = duckdb.connect()
        con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
        sql = con.execute(f"SELECT conv_id, turn, position, n_quotes, n_linked, reply_to, branch, chat FROM ({Q.oracle()})").fetchall()
        query = Q.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert Counter(sql) == Counter(tuple(x) for x in query.select("conv_id", "turn", "position", "n_quotes", "n_linked", "reply_to", "branch", "chat").collect())
    got = {(x.conv_id, x.turn): (x.n_linked, x.reply_to, x.branch, x.position) for x in Q.conversations(frame(spark, rows)).collect()}
    assert got == want
    assert any(v[2] != min(t for c, t in want if c == k[0]) for k, v in want.items())


def test_order_of_branches(spark):
    a, b = "the first question has quite a few words in it", "another question that has its own set of words"
    rows = [(1, 0, "user", a), (1, 1, "user", b), (1, 2, "user", "> quite a few\n> words in it\nanswer one"), (1, 3, "user", "goes on"), (1, 4, "user", f"> {b}\nanswer two"), (1, 5, "user", "ends")]
    got = {x.turn: (x.reply_to, x.branch, x.position) for x in Q.conversations(frame(spark, rows)).collect()}
    # Only part of the first question is quoted, wrapped anew; branches that reply to later messages come first.
    assert got == {0: (None, 0, 0), 1: (0, 0, 1), 4: (1, 4, 2), 5: (4, 4, 3), 2: (0, 2, 4), 3: (2, 2, 5)}


def test_long_and_hot(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(7, t, "user", f"this is the message with number {t}") for t in range(10_000)]
    rows[9_000] = (7, 9_000, "user", "> this is the message with number 17\nyes, that one")
    rows += [(8, 0, "user", long), (8, 1, "user", "x"), (8, 2, "user", "> " + " ".join(f"word{i}" for i in range(500, 900)) + "\nok")] + [(9, 1, "user", "same turn")] * 3000
    out = Q.conversations(frame(spark, rows))
    got = {(x.conv_id, x.turn): x for x in out.where("turn in (18, 9000, 9999, 2)").collect()}
    assert got[7, 9000].reply_to == 17 and got[7, 9000].branch == 9000 and got[8, 2].reply_to == 0 and out.count() == len(rows)
    assert sorted(x.position for x in out.where("conv_id = 7").select("position").collect()) == list(range(10_000))
    assert got[7, 18].position == 18 and got[7, 9999].position == 9999

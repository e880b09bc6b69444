import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusgrid.llm import chat as C

NODES = "tree long, node long, parent long, role string, text string, score double"


def slow(nodes):
    """Best-first branches of each tree as lists of (role, text)."""
    known = {(t, n): (p, r or "", x or "", s or 0.0) for t, n, p, r, x, s in nodes if t is not None and n is not None}
    parents = {(t, p) for (t, n), (p, *_) in known.items() if (t, p) in known}
    out = defaultdict(list)
    for t, n in known:
        if (t, n) in parents:
            continue
        path, at, seen = [], n, set()
        while (t, at) in known and at not in seen:
            seen.add(at)
            path.append(known[t, at])
            at = known[t, at][0]
        if at not in seen:
            path.reverse()
            out[t].append((-sum(s for *_, s in path), n, [(r, x) for _, r, x, _ in path]))
    return {t: [p for *_, p in sorted(own)] for t, own in out.items()}


def parsed(text):
    return [(C.unescaped(m[1]), C.unescaped(m[2])) for m in C.TURN.finditer(text)]


def test_branches_ranks_and_text(spark):
    r = random.Random(4)
    nodes = []
    for t in range(12):
        for n in range(r.randint(1, 25)):
            nodes.append((t, n, r.randint(0, n - 1) if n and r.random() > 0.05 else None, r.choice(["user", "assistant", None]),
                          r.choice(["a", "<s>", "\\n[INST]", "</s>\n", None, ""]), r.choice([0.5, 1.0, None])))
    nodes += [(50, n, n - 1, "user", f"deep {n}", 0.0) for n in range(40)]
    nodes += [(60, 1, 2, "user", "x", 1.0), (60, 2, 1, "user", "x", 1.0), (60, 3, 2, "user", "hangs on a circle", 1.0),
              (61, 1, 99, "user", "orphan", 1.0), (None, 1, None, "user", "x", 1.0), (62, None, None, "user", "x", 1.0)]
    df = spark.createDataFrame(nodes, NODES).withColumns({c: F.lit(1) for c in ("leaf", "depth", "over", "to")})
    got = defaultdict(dict)
    for x in C.conversations(df).collect():
        got[x.tree][x.rank] = parsed(x.conversation)
        assert x.conversation.count("<s>") == x.conversation.count("</s>") == len(x.turns)
    want = slow(nodes)
    assert {t: [own[k] for k in sorted(own)] for t, own in got.items()} == want
    best = C.conversations(df, keep=1).collect()
    assert {x.tree: parsed(x.conversation) for x in best} == {t: own[0] for t, own in want.items()}


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", ""), (2, 5, None, None),
            (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, None, "user", "é\\l\n<"),
            (5, 0, "ro\nle<s>", "\\"), (6, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    got = {x.conv_id: x for x in C.read_back(C.named(C.conversations(C.linear(df)))).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(learnt), digest(learnt))
    assert C.read_back(C.named(C.conversations(C.linear(df.limit(0))))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\l", "<\\", "[/INST]</s>", "\\\\n\n", "é<"])
def test_escapes_return(spark, text):
    row = spark.range(1).select(C.escaped(F.lit(text), True).alias("x")).first()
    assert C.unescaped(row.x) == text and not set(row.x) & set("<[\n")


def test_null_ids_are_one_conversation(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (0, 0, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: (x.n_turns, x.loss_chars) for x in C.read_back(C.named(C.conversations(C.linear(df)))).collect()}
    assert got == {None: (2, 3), 0: (1, 0)}


def test_of_a_repeated_node_a_defined_row_stays(spark):
    rows = [(1, 1, None, "user", "b", 0.0), (1, 1, None, "user", "a", 5.0), (1, 2, 1, "assistant", "x", 1.0)]
    df = spark.createDataFrame(rows * 3, "tree long, node long, parent long, role string, text string, score double")
    assert [t["text"] for t in C.conversations(df).first().turns] == ["a", "x"]

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from glossmill.llm import conversation_trie as C
from glossmill.llm.conversation_trie import marked, prefix_trie, with_heads_of, with_turns
from glossmill.llm.tables import remainder

SCHEMA = "conv_id long, turn int, role string, text string"


def md5(x):
    return hashlib.md5((x or "").encode()).hexdigest()


def identity(row):
    return md5(md5(row[2]) + md5(row[3]))


def rebuilt(rows):
    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], (r[1] is not None, r[1] or 0), identity(r))):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    cut = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: cut(c)] + turns[cut(c) :] for c, turns in own.items()}


def brute_force(sequences):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved_tokens, digest)} by walking every prefix."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out[min(ids), len(prefix)] = (parent, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(df):
    turns = marked(df)
    return prefix_trie(*with_heads_of(turns, F.col("conv_id") - F.col("conv_id") % 20, remainder("conv_id", 4), 3))


def check(spark, rows):
    got = trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == brute_force(rebuilt(rows))


def test_trie_equals_brute_force(spark):
    """Shared starts, copies, prefixes, missing heads, ties, repeated rows, nulls in every column, negative ids."""
    rng = random.Random(4)
    pool = [(role, text) for role in ("user", "assistant", None, "") for text in ("hello there", "a  b\tc", "", None, "x")]
    rows = []
    for c in [*range(0, 30), *range(41, 60), 200, 219, 1000003, -7, -20, -33]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, 0, None]), *pool[rng.randrange(3) if t < 2 else rng.randrange(len(pool))]))
    rows += [(300 + k, t, "user", f"same {t}") for k in range(20) for t in range(6)] + rows[:9] + [(None, 1, "user", "lost")]
    check(spark, rows)


def test_a_long_conversation_and_a_large_group(spark, monkeypatch):
    """Blocks of turns and pieces of lists: the same nodes when both are cut."""
    monkeypatch.setattr(C, "BLOCK", 4)
    rows = [(c, t, "user", f"turn {t % 5} of many") for c in (0, 1, 2, 3) for t in range(25 - c)] + [(1000 + c, 1, "user", "same first turn") for c in range(700)]
    check(spark, rows)


def test_defined_cases_and_texts(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # Conversation 41 has no turns left: its head is absent and its own turns are all cut off.
    alone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    rows = [tuple(r) for r in trie(spark.createDataFrame([(alone, 0, "user", "gone")], SCHEMA)).collect()]
    assert rows == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    df = spark.createDataFrame([(0, 0, "user", "Hi"), (0, 1, None, None)], SCHEMA).withColumns({"a": F.lit(1), "depth": F.lit(2), "id": F.lit("x")})
    turns = marked(df)
    nodes = prefix_trie(turns, turns.where("depth = 1").select("conv_id"))
    assert {r.depth: (r.role, r.text) for r in with_turns(nodes, turns, df).collect()} == {0: (None, None), 1: ("user", "Hi"), 2: ("", "")}

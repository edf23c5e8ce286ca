import re
from collections import defaultdict

import numpy as np

from glossmill.llm import near_duplicates as N
from glossmill.llm.components import components, least_labels
from glossmill.llm.line_dedup import MIN_WORDS, boundaries, chunks, defined_chunks, lines, remove_repeated
from glossmill.llm.near_duplicates import near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_force(rows):
    sets = {k: shingles(t) for k, t, *_ in rows}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(pairs, ids)


def test_components(spark, monkeypatch):
    pairs = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (1, 1), (20, 2), (2, 20)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(7)
    want = groups(pairs, {x for p in pairs for x in p})
    for most in (1 << 20, 20):  # in one task, and by rounds after that
        monkeypatch.setattr("glossmill.llm.components.TASK_LINKS", most)
        got = [(r.id, r.component) for r in components(links, "a", "b").collect()]
        assert {k: v for k, v in want.items() if k != v} == dict(got) and len(got) == len(dict(got))
        assert components(links.where("a > 1000"), "a", "b").count() == 0
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 500):
        u, v = rng.integers(0, 300, n), rng.integers(0, 300, n)
        want = groups(list(zip(u.tolist(), v.tolist())), set(u.tolist()) | set(v.tolist()))
        assert dict(zip(*(x.tolist() for x in least_labels(u, v)))) == {k: x for k, x in want.items() if k != x}


def test_near_duplicates_equal_brute_force(documents, corpus, empty):
    sets, want = brute_force(corpus)
    rows = near_duplicates(documents.selectExpr("*", "1 as id", "2 as tokens", "3 as rep")).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_duplicates(empty).count() == 0


def test_large_families_in_blocks(spark, monkeypatch):
    """Nodes above the group size branch, families are cut into blocks, and no link is lost."""
    for name, size in (("GROUP", 16), ("BLOCK", 16), ("SET_BLOCK", 16)):
        monkeypatch.setattr(N, name, size)
    monkeypatch.setattr(N, "PIVOTS", 4)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.integers(0, 150, 1 + k % 3):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(500 + k, " ".join(f"y{rng.integers(10**6)}" for _ in range(40))) for k in range(40)]
    _, want = brute_force(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 150


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = near_duplicates(spark.createDataFrame([(3, text), (3, text), (None, text), (7, text + " eight")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True), (7, 3, False)]


def test_lines():
    data = np.frombuffer("Ab c. De?\n\n . fg".encode(), np.uint8)
    start, first, last, size, row = lines(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(first, last)] == ["Ab c.", "De?", ".", "fg"] and row.tolist() == [0] * 4 and size.tolist() == [2, 1, 1, 1]
    assert len(lines(data, np.array([0, len(data)]), sentences=False)[0]) == 2


def test_repeated_passages_go_but_once(documents, corpus, empty):
    rows = {r.doc_id: r for r in remove_repeated(documents.selectExpr("*", "1 as `first`", "2 as chunk")).collect()}
    assert len(rows) == len(corpus) and rows[0]["first"] == 1
    split = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", t or "") if s.strip()]
    windows = lambda texts: {k: {tuple(s[i : i + 6]) for s in [split(t)] for i in range(len(s) - 5)} for k, t in texts.items()}
    before, after = windows({k: t for k, t, *_ in corpus}), windows({k: r.text for k, r in rows.items()})
    count = lambda sets: {w: sum(w in s for s in sets.values()) for w in set().union(*sets.values())}
    shared, left = [w for w, n in count(before).items() if n > 1], count(after)
    assert len(shared) > 20 and sum(left.get(w, 0) > 1 for w in shared) <= 0.05 * len(shared)
    for key, text, *_ in corpus:
        r = rows[key]
        if not r["__n_removed"]:
            assert r.text == text
        else:  # what stays keeps its order
            it = iter(split(text))
            assert all(s in it for s in split(r.text)), (key, text[:400], r.text[:400])
    assert all(rows[k]["__n_removed"] == 0 for k in range(0, 3)) and rows[3]["__n_removed"] == 0
    copies = [k for k, t, *_ in corpus if t == corpus[3][1] and k != 3]
    assert all(rows[k].text == "" for k in copies)
    assert remove_repeated(empty).count() == 0


def test_rows_with_equal_key_and_text_are_one_document(spark):
    text = " ".join(f"Sentence number {k} has words here." for k in range(12))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "Front part. " + text), (None, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r["__n_removed"]) for r in remove_repeated(docs).collect())
    assert rows[0] == (0, 0) and rows[1:3] == [(1, 0), (1, 0)] and rows[3][1] >= 10
    by_key = defaultdict(set)
    for r in remove_repeated(docs).collect():
        by_key[r.doc_id].add(r.text)
    assert by_key[1] == {text}


def test_short_passages_in_two_documents_go_once(spark):
    """Passages of two, three and four sentences, with other sentences around them in each document."""
    rng = np.random.default_rng(11)
    own = lambda n: [" ".join(f"w{rng.integers(10**9)}" for _ in range(rng.integers(4, 9))) + "." for _ in range(n)]
    rows, planted = [], []
    for k in range(90):
        passage = own(2 + k % 3)
        planted.append(passage)
        rows += [(2 * k + j, own(3), passage, own(3)) for j in range(2)]
    few = ["Yes it is.", "No.", "Oh.", "He went away then.", "Why?"]
    rows += [(1000 + j, own(2), few, own(2)) for j in range(3)]
    docs = spark.createDataFrame([(k, " ".join(a + p + b)) for k, a, p, b in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_repeated(docs).collect()}
    for k, a, p, b in rows:
        first = k in (1000,) or (k < 1000 and k % 2 == 0)
        assert got[k] == " ".join(a + (p if first else []) + b)


def test_chunks_equal_brute_force():
    rng = np.random.default_rng(12)
    sizes, offsets = rng.integers(1, 7, 300), np.array([0, 0, 1, 3, 40, 41, 200, 300])
    hashes = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    row = np.searchsorted(offsets, np.arange(300), "right") - 1
    ends = boundaries(hashes, row)
    want = set()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        fits = [(x, y) for x in range(a, b) for y in range(x + 2, b + 1) if sizes[x:y].sum() >= MIN_WORDS]
        want |= {min(f for f in fits if f[0] == x) for x, _ in fits} | {max(f for f in fits if f[1] == y) for _, y in fits}
        edges = [a, *(k + 1 for k in range(a, b - 1) if ends[k]), b]
        want |= {(x, y) for x, y in zip(edges, edges[1:]) if (x, y) in fits}
    first, count, _ = chunks(hashes, sizes, offsets)
    assert set(zip(first.tolist(), (first + count).tolist())) == want and len(first) == len(want)
    assert 0.15 < ends.mean() < 0.35 and (count > 4).any()


def test_an_inserted_line_moves_only_the_chunks_around_it():
    rng = np.random.default_rng(13)
    lines = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    row = np.zeros(400, np.int64)

    def spans(hashes):
        return [tuple(hashes[a:b].tolist()) for a, b in zip(*defined_chunks(hashes, np.zeros(len(hashes), np.int64)))]

    whole = spans(lines)
    assert sum(map(len, whole)) == 400 and 60 < len(whole) < 140
    for at in range(0, 400, 7):
        changed = spans(np.insert(lines, at, np.uint64(7)))
        assert len(set(whole) - set(changed)) <= 2  # the chunk with the line, and the next if a boundary beside it went
        assert len(set(spans(np.delete(lines, at))) - set(whole)) <= 2
    # The same passage in other surroundings: the chunks between its first and its last boundary are the same.
    passage = lines[100:160]
    other = np.concatenate([rng.integers(1, 1 << 62, 33).astype(np.uint64), passage, rng.integers(1, 1 << 62, 20).astype(np.uint64)])
    ends = np.flatnonzero(boundaries(passage, row[:60]))
    inside = {tuple(passage[a + 1 : b + 1].tolist()) for a, b in zip(ends, ends[1:])}
    assert len(inside) > 8 and inside <= set(spans(other)) and inside <= set(whole)


def test_columns_of_any_name_are_kept(spark):
    text = " ".join(f"Sentence number {k} has words here." for k in range(12))
    rows = [(k, text, f"i{k}", k, "l", "g", 5) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __mark long, __lines string, __gone string, __n_lines int")
    found = remove_repeated(docs)
    assert found.columns == ["doc_id", "text", "__id", "__mark", "__lines", "__gone", "__n_lines", "__n_removed"]
    got = {r.doc_id: r for r in found.collect()}
    assert all((r["__id"], r["__mark"], r["__lines"], r["__gone"], r["__n_lines"]) == (f"i{k}", k, "l", "g", 12) for k, r in got.items())
    assert got[0].text == text and got[1].text == got[2].text == ""

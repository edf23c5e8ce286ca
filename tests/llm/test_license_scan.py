import random
import re
from itertools import combinations

import pytest

from glossmill.llm.license_scan import GAP, PHRASES, SHARE, TEMPLATES, Automaton, chains, covered, license_scan, resolved, tokens
from glossmill.llm.queries import QUERIES


def sequences(rng, count, kinds):
    return [[rng.randrange(kinds) for _ in range(rng.randint(1, 14))] for _ in range(count)]


def test_statistics_and_places_equal_brute_force():
    """The longest passage ending at every word that stands in some sequence, and all places of it."""
    rng = random.Random(1)
    for _ in range(300):
        known = sequences(rng, rng.randint(1, 6), rng.randint(1, 5))
        automaton = Automaton(known)
        text = [rng.randrange(6) for _ in range(30)] + rng.choice(known)
        for k, (state, matched) in enumerate(automaton.statistics(text), 1):
            places = lambda n: [(s, e) for s, own in enumerate(known) for e in range(n, len(own) + 1) if own[e - n : e] == text[k - n : k]]
            want = max(n for n in range(k + 1) if n == 0 or places(n))
            assert matched == want
            if want:
                assert sorted(set(automaton.ends(state))) == places(want)


def test_the_heaviest_chain_is_found():
    rng = random.Random(2)
    for _ in range(300):
        matches = sorted({(rng.randrange(25), rng.randrange(25), rng.randint(1, 6)) for _ in range(rng.randint(1, 7))})
        best = 0
        for n in range(1, len(matches) + 1):
            for chain in combinations(matches, n):
                linked = all(a[0] < b[0] and a[1] < b[1] and b[0] - a[0] - a[2] <= 4 and b[1] - a[1] - a[2] <= 4 and max(a[0] + a[2] - b[0], a[1] + a[2] - b[1]) < b[2] for a, b in zip(chain, chain[1:]))
                best = max(best, covered(list(chain))[2] if linked else 0)
        found = chains(matches, 4)
        assert covered(found[0])[2] == best
        assert sorted(m for c in found for m in c) == matches


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    own = words(text)
    return sorted((k, label) for phrase, label in PHRASES.items() for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("the of this is under to license free copy and software any way stone river cc by mit gnu general".split()) for _ in range(n))
    notices = [t for own in TEMPLATES.values() for t in own]
    out = [filler(rng.randrange(80)) + " " + rng.choice(notices) + ". " + filler(rng.randrange(40)) for _ in range(60)]
    out += [filler(60) for _ in range(40)]
    out += [None, "", "...", "MIT-License", "mit\nlicense", "smit license", "cc by cc by", "GNU General\tPublic License v3", "é cc ß by", " ".join(["Released under the MIT License."] * 500)]
    return out


def test_query_equals_brute_force_on_places(spark, tmp_path, texts):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(2, texts[2], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, places string, n_words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op12_license_scan"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    for r in got:
        want = base(texts[r.doc_id])
        labels = sorted({label for _, label in want})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words(texts[r.doc_id])), len(want), ",".join(labels))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert set(labels) <= set(r.labels.split(",") if r.labels else []) and 0 <= r.score <= 1
        assert (r.score == 1) >= bool(want) and (r.score >= SHARE) == bool(r.labels)


def test_spans_of_whole_and_edited_notices(spark):
    """Every notice is found under its own label alone, also with a few words changed or put in."""
    rng = random.Random(4)
    rows = []
    for label, own in TEMPLATES.items():
        for notice in own:
            rows.append((label, "Some words before, and then: " + notice + " And some after it."))
            if len(tokens(notice)) >= 20:
                edited = notice.split(" ")
                edited[6] = "really"
                edited[13:13] = ["as", "it", "were"]
                rows.append((label, "Before that. " + " ".join(edited) + " Thereafter."))
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    for r in license_scan(docs).collect():
        label, text = rows[r.doc_id]
        assert {s.label for s in r.spans} == {label}, (text, r.spans)
        assert all(SHARE <= s.share <= 1 and s.covered <= s.words and s.start >= 2 for s in r.spans)
    other = spark.createDataFrame([(1, "This work is free of any license, and the software may be used under the terms above.")], "doc_id long, text string")
    assert license_scan(other).first().spans == []


def test_defined_cases(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = license_scan(spark.createDataFrame([(None, None)], "doc_id string, text string")).first()
    assert tuple(row) == (None, 0, [], [])
    with pytest.raises(ValueError):
        license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), phrases={"gpl": "gpl"})
    assert resolved([("a", 0, 9, 5, 0.7), ("b", 2, 4, 6, 0.6), ("a", 20, 3, 3, 1.0), ("c", 20, 3, 3, 1.0)]) == [("b", 2, 4, 6, 0.6), ("a", 20, 3, 3, 1.0)]
    none = license_scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"), phrases={}, templates={}).first()
    assert (none.n_words, none.places, none.spans) == (2, [], []) and GAP > 0

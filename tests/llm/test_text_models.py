import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from glossmill.llm import html_extraction as H
from glossmill.llm import language_model as L
from glossmill.llm import toxicity as X
from glossmill.llm.decontamination import contaminated, tiles
from glossmill.llm.html_extraction import content_odds, extract, fit as fit_pages, marginals, parse
from glossmill.llm.language_id import fit as fit_languages, identify
from glossmill.llm.line_frequency import frequent_lines, judge, measure, remove_frequent_lines

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_quality_figures_equal_brute_force(documents, corpus, empty):
    odd = [(500, "x #$ é*\nx #$ é*\n\nx #$ é*", "en", "s", 1), (501, "a b c d e f g h a b c d e f g h z", "en", "s", 1), (502, "w " * 30, "en", "s", 1)]
    docs = documents.union(documents.sparkSession.createDataFrame(odd, documents.schema))
    rows = {r.doc_id: r for r in judge(docs.selectExpr("*", "1 as host", "2 as line", "3 as `row`")).collect()}
    assert len(rows) == len(corpus) + 3
    for key, text, *_ in corpus + odd:
        text, r = text or "", rows[key]
        words = WORD.findall(text)
        places = defaultdict(list)
        for k in range(len(words) - 7):
            places[tuple(words[k : k + 8])].append(k)
        again = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert r.kept == (not r.base_failed)
    assert judge(empty).count() == 0


def test_frequent_lines_and_depletion(spark):
    rng = random.Random(1)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{own(30)}\nCommon  LINE of the host\n{own(5)}", "a") for k in range(40)]
    rows += [(100 + k, "common line of the host\n" + own(19), "a") for k in range(3)]
    rows += [(200 + k, f"copied line\n{own(25)}" if k == 0 else rows_copy, "a") for k, rows_copy in [(0, "")]]
    copy = f"copied line\n{own(25)}"
    rows += [(300 + k, copy, "a") for k in range(60)] + [(400, "Common line of the host\n" + own(30), None), (401, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frequent = frequent_lines(measure(docs), min_documents=20, max_share=0.1)
    assert [r.documents for r in frequent.collect()] == [43]
    verdict = {r.doc_id: r for r in judge(docs, min_documents=20).collect()}
    assert verdict[0].kept and verdict[0].lost_words == 5 and verdict[300].kept and verdict[400].lost_words == 0
    assert not verdict[100].kept and not verdict[100].base_failed and verdict[401].base_failed
    cut = {r.doc_id: r.text for r in remove_frequent_lines(docs, frequent).collect()}
    assert cut[0] == "\n".join(rows[0][1].split("\n")[::2]) and cut[300] == copy and cut[401] is None and cut[400] == rows[-2][1]


def test_frequent_lines_of_small_and_of_very_large_hosts(spark):
    rng = random.Random(6)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common = "common line " + own(8)
    small = [(k, (f"{common}\n" if k < 8 else "rare line\n" if k < 13 else "") + own(19 if k == 0 else 30), "small") for k in range(30)]
    large = [(100 + k, (f"{common}\n" if k < 12 else "") + own(30), "large") for k in range(300)]
    docs = spark.createDataFrame(small + large, "doc_id long, text string, source string")
    verdict = {r.doc_id: r for r in judge(docs).collect()}
    assert [verdict[k].lost_words for k in range(14)] == [10] * 8 + [0] * 6 and not verdict[0].kept and verdict[1].kept
    assert all(verdict[k].lost_words == 0 for k in range(100, 400))  # 4 % of the host's texts
    assert {r.documents for r in frequent_lines(measure(docs), max_documents=12).collect()} == {8}
    assert {r.documents for r in frequent_lines(measure(docs), max_documents=11).collect()} == {8, 12}


def test_tiles_cover_reordered_passages():
    item = np.arange(1, 41).astype(np.uint64)
    text = np.concatenate([[99], item[20:], [98, 97], item[:20], [96]]).astype(np.uint64)
    assert sorted(tiles(item, text)) == [(0, 23, 20), (20, 1, 20)]
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, 25).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
        found = tiles(a, b, 3)
        in_a, in_b = np.zeros(25, int), np.zeros(60, int)
        for i, j, n in found:
            assert n >= 3 and (a[i : i + n] == b[j : j + n]).all()
            in_a[i : i + n] += 1
            in_b[j : j + n] += 1
        assert in_a.max() <= 1 and in_b.max() <= 1
        longest = max((n for i in range(25) for j in range(60) for n in [next((k for k in range(min(25 - i, 60 - j)) if a[i + k] != b[j + k]), min(25 - i, 60 - j))]), default=0)
        assert max((n for *_, n in found), default=0) == (longest if longest >= 3 else 0)
        for i in range(23):  # nothing of the least length is left over
            for j in range(58):
                assert in_a[i : i + 3].any() or in_b[j : j + 3].any() or (a[i : i + 3] != b[j : j + 3]).any()


def test_contaminated(spark, documents, empty):
    items = [(1, "The quick brown fox jumps over one lazy dog. Then it sleeps in the warm afternoon sun."), (2, "too short"), (3, None), (3, ""), (4, "É clair que tout va bien aujourd'hui mes amis")]
    texts = [
        (1000, "Intro. THEN IT SLEEPS IN THE WARM AFTERNOON SUN. and " + items[0][1][:44] + " end"), (1001, "nothing of the kind"), (1002, "it was TOO short here"),
        (1003, None), (1004, "the quick brown fox jumps away"), (1005, "X " * 20_000 + items[4][1].upper()), (1000, "Intro. " + items[0][1]),
    ]
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string")).selectExpr("*", "1 as item", "2 as `key`", "3 as runs")
    rows = {(r.doc_id, r.item_id): r for r in contaminated(docs, benchmark).collect()}
    assert set(rows) == {(1000, 1), (1002, 2), (1005, 4)}
    assert rows[1002, 2].covered_words == 2 and rows[1005, 4].covered_words == rows[1005, 4].item_words
    assert contaminated(empty, benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def kneser_ney(texts):
    words, pairs = Counter(), Counter()
    for t in texts:
        words.update(tokens(t))
        pairs.update(zip(["<s>"] + tokens(t)[:-1], tokens(t)))
    total, kinds, after = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a][min(n, 3) - 1] += 1
        after[b] += 1
    counts = lambda c: [sum(v == k for v in c.values()) for k in range(1, 5)]
    high, low = [0, *L.discounts(*counts(pairs))], [0, *L.discounts(*counts(after))]
    left = sum(low[min(v, 3)] for v in after.values()) / len(pairs) if pairs else 1.0

    def p(a, b):
        lower = (after[b] - low[min(after[b], 3)]) / max(len(pairs), 1) + left / (len(words) + 1)
        return lower if not total[a] else (pairs[a, b] - high[min(pairs[a, b], 3)]) / total[a] + sum(high[k + 1] * kinds[a][k] for k in range(3)) / total[a] * lower

    return words, p


def test_language_model_equals_brute_force(spark, documents, corpus, empty, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 2048)  # several shards and hot words
    monkeypatch.setattr(L, "HOT_SHARE", 0.05)
    monkeypatch.setattr(L, "CHUNK", 5000)
    model = L.train(documents.where("doc_id % 5 != 1"))
    words, p = kneser_ney([t for k, t, *_ in corpus if k % 5 != 1])
    assert model["bits"] >= 3 and len(model["hot"]) > 1 and model["tokens"] == sum(words.values()) and model["words"] == len(words)
    rows = {r.doc_id: r for r in L.score(documents, model).collect()}
    for key, text, *_ in corpus:
        seq, r = tokens(text), rows[key]
        assert (r.n_tokens, r.n_known) == (len(seq), sum(words[w] > 0 for w in seq))
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>"] + seq[:-1], seq)), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 0.5) / (sum(words.values()) + 0.5 * (len(words) + 1))) for w in seq), rel_tol=1e-9)
    assert math.isclose(sum(p("the", w) for w in words) + p("the", "unseen"), 1.0, rel_tol=1e-9)
    nothing = L.train(empty)
    assert {round(r.score, 9) for r in L.score(documents.where("text = ''"), nothing).collect()} == {0.0}
    assert L.score(empty, model).count() == 0


def trigrams(texts):
    """Modified Kneser-Ney of order 3, plainly; a pair that begins a text counts as often as it occurs."""
    words, grams, pairs = Counter(), Counter(), Counter()
    for t in texts:
        seq = ["<s>"] + tokens(t)
        words.update(seq[1:])
        grams.update(zip(seq, seq[1:], seq[2:]))
        pairs[tuple(seq[:2])] += 1
    for _, b, c in grams:
        pairs[b, c] += 1
    after = Counter(b for _, b in pairs)
    counts = lambda c: [sum(v == k for v in c.values()) for k in range(1, 5)]
    top, high, low = ([0, *L.discounts(*counts(c))] for c in (grams, pairs, after))
    left = sum(low[min(v, 3)] for v in after.values()) / len(pairs)
    own = defaultdict(lambda: [0, 0.0])
    for table, by in ((grams, top), (pairs, high)):
        for gram, n in table.items():
            own[gram[:-1]][0] += n
            own[gram[:-1]][1] += by[min(n, 3)]

    def p(a, b, c):
        found = (after[c] - low[min(after[c], 3)]) / len(pairs) + left / (len(words) + 1)
        for table, by, gram in ((pairs, high, (b, c)), (grams, top, (a, b, c))):
            total, gone = own.get(gram[:-1], (0, 0.0))
            if total:
                found = (table[gram] - by[min(table[gram], 3)]) / total + gone / total * found
        return found

    return words, p


def test_trigram_model_equals_brute_force(spark, documents, corpus, empty, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 5000)
    texts = [t for k, t, *_ in corpus if k % 5 != 1]
    words, p = trigrams(texts)
    for size, share in ((2048, 0.05), (1 << 20, 0.25)):  # several shards and hot words, and one shard
        monkeypatch.setattr(L, "SHARD_TOKENS", size)
        monkeypatch.setattr(L, "HOT_SHARE", share)
        model = L.train(documents.where("doc_id % 5 != 1"), order=3)
        assert (model["bits"] >= 3 and len(model["hot"]) > 1 and model["parts"].max() > 1) or size > 2048
        rows = {r.doc_id: r for r in L.score(documents, model).collect()}
        for key, text, *_ in corpus:
            seq = ["", "<s>"] + tokens(text)
            assert math.isclose(rows[key].score, sum(math.log10(p(*g)) for g in zip(seq, seq[1:], seq[2:])), rel_tol=1e-9)
    a, b = tokens(corpus[0][1])[:2]
    assert math.isclose(sum(p(a, b, w) for w in words) + p(a, b, "unseen"), 1.0, rel_tol=1e-9)
    assert {round(r.score, 9) for r in L.score(documents.where("text = ''"), L.train(empty, order=3)).collect()} == {0.0}


def test_frequent_words_fill_all_buckets_of_a_shard(spark, monkeypatch):
    """The look-up walks through a bucket, so the keys of a shard must not share the bits that number the buckets."""
    monkeypatch.setattr(L, "SHARD_TOKENS", 1024)
    rng = random.Random(8)
    texts = [(k, " ".join("the" if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(1500))) for k in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = L.train(docs, order=3)
    assert model["bits"] >= 4 and len(model["hot"]) > 1
    for kind in ("hot-pairs", "hot-contexts", "grams", "pairs", "contexts"):
        keys, walked = 0, 0
        for shard in range(1 << model["bits"]):
            if arrays := L._file(model["folder"], f"{kind}-{shard}"):
                buckets = 1 << int(arrays[0][0])
                held = np.diff(arrays[1].view(np.uint32)[: buckets + 1].astype(np.int64))
                keys, walked = keys + int(held.sum()), walked + int((held * held).sum())
        assert keys > 100 and walked < 8 * keys, kind
    words, p = trigrams([t for _, t in texts])
    row = {r.doc_id: r for r in L.score(docs, model).collect()}[3]
    seq = ["", "<s>"] + tokens(texts[3][1])
    assert math.isclose(row.score, sum(math.log10(p(*g)) for g in zip(seq, seq[1:], seq[2:])), rel_tol=1e-9)


def test_language_id(spark, empty):
    rng = random.Random(2)
    stems = {"aa": ["bako", "lumi", "sato", "neki"], "bb": ["grund", "schla", "pfein", "zwerk"]}
    text = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=rng.choice([1, 1, 2, 3]))) for _ in range(n))
    rows = [(k, text(lang, 40), lang) for k in range(120) for lang in ["aa" if k % 2 else "bb"]]
    docs = spark.createDataFrame(rows + [(200, "bako", None)], "doc_id long, text string, lang string")
    model = fit_languages(docs.where("doc_id % 3 != 1"))
    assert model["langs"] == ["aa", "bb"]
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "12 ·· !"), (903, "ЖЖЖ"), (904, "BAKO!"), (905, "zzgrundzz"), (None, "lumi sato")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, model).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903] == ("aa", 0.5)
    assert got[904][0] == "aa" and got[905][0] == "bb" and got[None][0] == "aa" and 0 <= got[904][1] <= 1
    held = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert all(held[k] == lang for k, _, lang in rows)
    none = fit_languages(empty)
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"} and identify(empty, model).count() == 0


def test_rare_languages_and_counts_of_all_languages(spark):
    rows = [(k, "lumi sato", "aa") for k in range(600)] + [(1000 + k, "grund zwerk", "bb") for k in range(3)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=20)
    assert model["langs"] == ["aa", "bb"]
    rows = [(1, "x " * 10 + "yy " * 5, "aa"), (2, "yy " * 10 + "x " * 5, "bb")]
    known, logs = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), entries=1)["levels"][0]
    assert len(known) == 2 and np.allclose(np.sort(np.exp(logs), axis=None), np.array([5.5, 5.5, 10.5, 10.5]) / (15 + 0.5 * 3))


def test_folding_and_exceptions():
    machine = X.automaton({" idiot ": 2.0, " mor": 1.0}, ["trash mor can"])
    texts = ["IDIOT", "1d10t and іԁіоt", "idiots", "a moron, morse", "trash mor can", None, "", "tomorrow", "é idiot."]
    weight, count, words = X.matches(machine, *X.fold(pa.array(texts)))
    assert weight.tolist() == [2, 4, 0, 2, 0, 0, 0, 0, 2] and count.tolist() == [1, 2, 0, 2, 0, 0, 0, 0, 1]
    assert words.tolist() == [1, 3, 1, 3, 3, 0, 0, 1, 2]


def test_toxicity_is_learned(spark, empty):
    rng = random.Random(4)
    vocabulary = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows, labels = [], []
    for k in range(300):
        words = rng.choices(vocabulary, k=60)
        toxic = k % 6 == 0
        if toxic:
            words[10], words[30] = rng.choice(["blockhead", "nitwit"]), "dunce" + rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = X.fit(docs, known.where("doc_id % 5 != 0"))
    got = {r.doc_id: r for r in X.score(docs.union(spark.createDataFrame([(900, None), (901, "N1TWIT")], docs.schema)), model).collect()}
    assert all(got[k].predicted == y for k, y in labels) and got[900].predicted == 0 and got[901].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert X.fit(docs, known.limit(0))["lexicon"] == {} and X.score(empty, model).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 7
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        node, edge = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        mass = np.zeros((n, 2))
        for state in range(2**n):
            s = [(state >> k) & 1 for k in range(n)]
            weight = math.exp(sum(node[k, s[k]] for k in range(n)) + sum(edge[s[parent[k]], s[k]] for k in range(1, n)))
            for k in range(n):
                mass[k, s[k]] += weight
        assert np.allclose(marginals(parent, depth, node, edge), np.log(mass[:, 1] / mass[:, 0]))


PAGE = """<!DOCTYPE html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies here.</div><article><h1>Title &amp; more</h1><p>First  part,
long enough to be read &lt;by&gt; anyone who likes stories.<p>Second<br>part has <a href=x>one link</a> among its many ordinary words.</p></article>
<section class="comments"><p>Great article I liked every word of it so much.</p></section><script>var a = "</p>{0}";</script><footer>&copy; 2020 Site</footer></body>"""
MAIN = "Title & more\n\nFirst part, long enough to be read <by> anyone who likes stories.\n\nSecond part has one link among its many ordinary words."


def test_extraction(spark):
    rows = [(k, f"http://x/{k}", PAGE.format(k)) for k in range(30)]
    known = spark.createDataFrame([(h, MAIN) for _, _, h in rows] + [(None, "x"), ("<p>y", None)], "html string, known string")
    model = fit_pages(known)
    odd = [(100, None, None), (101, "u", ""), (102, "u", "plain text without any markup at all, long enough to be read."), (103, "u", "<p>unclosed <b>bold<p>" + "many words in it. " * 5000), (None, None, "<!-- only --")]
    pages = spark.createDataFrame(rows + odd + rows[:1], "page_id long, url string, html string")
    for m in (model, {"features": {}, "edges": model["edges"]}):
        got = extract(pages, m).collect()
        assert len(got) == len(pages.collect())
        by = {r.page_id: r for r in got}
        assert all(by[k].text == MAIN and by[k].n_chars == len(MAIN) for k in range(30))
        assert by[100].text == by[101].text == by[None].text == "" and by[103].n_chars > 80_000
    assert extract(pages.limit(0), model).count() == 0


def test_parsing():
    page = parse('<ul><li>a<li>b</ul><div title="x > y">c</div><table><tr><td>d<td>e</table></p>f &am &eacute;<textarea><p>no</textarea>')
    assert [t for t in page.text if t] == ["a", "b", "c", "d", "e", "f &am é"]
    assert content_odds([], {}) == [] and zlib.crc32(b"1") % 5 >= 0


def test_text_after_icons_and_unclosed_elements_stays():
    texts = lambda html: [t for t in parse(html).text if t]
    assert texts('<p>a <svg class="icon"/> b</p><p>c <svg><title>x</title><path/></svg>d</p>') == ["a b", "c d"]
    assert texts("<p>a <svg class=icon/>gone</svg>b") == ["a b"] and texts("<p>a<SVG><svg>x</svg>y</SVG> b") == ["a b"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><p><math display='block'/>c") == ["Let x=1 be.", "c"]
    for name in ("select", "object", "noscript", "audio", "video", "canvas", "iframe", "template", "svg"):
        assert texts(f"<p>a</p><{name} id=x><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{name}><p>b</p><{name}>gone</{name}><p>c</p>") == ["a", "b", "c"]
    for name in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a</p><{name}>gone <p>gone") == ["a"] and texts(f"<p>a</p><{name}>gone</{name}>b") == ["a", "b"]
    assert texts("<script>'<svg>'</script><p>a</p><svg><title/><style>/* </svg> */</style>x</svg>b") == ["a", "b"]
    assert len(texts("<select>" * 20_000 + "<p>a")) == 1  # in linear time


def test_sample_is_taken_from_labelled_pages(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE_PAGES", 40)
    rows = [(k, f"http://x/{k}", f"<p>page {k}") for k in range(2000)] + [(k, "http://x/none", "<p>z") for k in range(2000, 2500)]
    pages = spark.createDataFrame(rows + [(3000, None, None)], "page_id long, url string, html string")
    docs = lambda n: spark.createDataFrame([(k, f"text {k}") for k in range(n)] + [(0, "text 0"), (1999, None)], "doc_id long, text string")
    few = H.known_texts(pages, docs(30)).collect()
    assert sorted((r.html, r.known) for r in few) == sorted((f"<p>page {k}", f"text {k}") for k in range(30))
    assert 15 <= H.known_texts(pages, docs(1000)).count() <= 80

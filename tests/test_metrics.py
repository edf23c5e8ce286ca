import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.operators import bleu, chrf, evaluation, inference, ngrams, sampling, studies, ter
from glossmill.operators.scoring import score


def grams(items, n):
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def plain_bleu(pairs):
    """BLEU straight from its definition, over lists of words."""
    hits, totals = [0] * 4, [0] * 4
    for hyp, ref in pairs:
        for n in range(1, 5):
            h, r = grams(hyp, n), grams(ref, n)
            hits[n - 1] += sum((h & r).values())
            totals[n - 1] += sum(h.values())
    sys_len, ref_len = sum(len(h) for h, _ in pairs), sum(len(r) for _, r in pairs)
    if not any(hits) or not all(totals):
        return 0.0
    smooth, logs = 1, 0.0
    for hit, total in zip(hits, totals):
        if hit == 0:
            smooth *= 2
        logs += math.log((100 * hit / total) if hit else 100 / (smooth * total))
    penalty = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return penalty * math.exp(logs / 4)


def plain_chrf(pairs, words=0):
    def units(text):
        split = []
        for w in text.split():
            if len(w) > 1 and w[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                split += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                split += [w[0], w[1:]]
            else:
                split.append(w)
        return split

    sums = [[0, 0, 0] for _ in range(6 + words)]
    for hyp, ref in pairs:
        views = [("".join(hyp.split()), "".join(ref.split()), n) for n in range(1, 7)]
        views += [(units(hyp), units(ref), n) for n in range(1, words + 1)]
        for row, (h, r, n) in zip(sums, views):
            a, b = grams(h, n), grams(r, n)
            row[0] += sum(a.values()) if b else 0
            row[1] += sum(b.values())
            row[2] += sum((a & b).values())
    kept = [row for row in sums if row[0] and row[1]]
    if not kept:
        return 0.0
    p, r = sum(m / h for h, _, m in kept) / len(kept), sum(m / t for _, t, m in kept) / len(kept)
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def corpus(seed, size):
    chooser = random.Random(seed)
    words = ["the", "cat", "sat", "mat", "on", "é", "big,", "3.5", "dog", "(a)"]
    rows = []
    for i in range(size):
        ref = [chooser.choice(words) for _ in range(chooser.randint(0, 12))]
        hyp = [chooser.choice(words) if chooser.random() < 0.3 else w for w in ref if chooser.random() < 0.9]
        rows.append((i, i % 3, " ".join(hyp), " ".join(ref)))
    return rows


SCHEMA = "id int, grp int, hypothesis string, reference string"


def test_matches_stay_exact_when_keys_are_ranked(monkeypatch):
    chooser = random.Random(5)
    hyp = [[chooser.choice("abcd") for _ in range(chooser.randint(0, 30))] for _ in range(60)]
    ref = [[chooser.choice("abcd") for _ in range(chooser.randint(0, 30))] for _ in range(60)]
    for limit in (2**61, 50):
        monkeypatch.setattr(ngrams, "KEY_LIMIT", limit)
        found = ngrams.match_table(pa.array(hyp), pa.array(ref), 4)
        for n, (h, r, m) in enumerate(found, 1):
            assert m.tolist() == [sum((grams(a, n) & grams(b, n)).values()) for a, b in zip(hyp, ref)]
            assert h.tolist() == [max(len(a) - n + 1, 0) for a in hyp] and r.tolist() == [max(len(b) - n + 1, 0) for b in ref]


def test_chunks_cover_all_rows(monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_SYMBOLS", 5)
    column = pa.array([["a"] * n for n in (0, 9, 1, 1, 1, 4, 0)])
    parts = list(ngrams.chunks(column, column))
    assert sum(len(h) for h, _ in parts) == 7 and len(parts) > 2


def test_bleu_equals_its_definition(spark):
    rows = corpus(1, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    settings = bleu.BleuSettings(tokenizer="none")
    by_group = {r.grp: r.bleu for r in bleu.corpus_bleu(df, ["grp"], settings=settings).collect()}
    for group in range(3):
        expected = plain_bleu([(h.split(), r.split()) for _, g, h, r in rows if g == group])
        assert by_group[group] == pytest.approx(expected, abs=1e-9)
    single = {r.id: r.bleu for r in bleu.sentence_bleu(df, settings=settings).collect()}
    for i, _, h, r in rows:
        assert single[i] == pytest.approx(plain_bleu([(h.split(), r.split())]), abs=1e-9)
    whole = bleu.corpus_bleu(df, settings=settings).first()
    assert whole == bleu.corpus_bleu(df.repartition(7), settings=settings).first()


def test_bleu_edges(spark):
    rows = [(1, 0, "a b c", "a b c"), (2, 0, "", "a"), (3, 0, None, None), (4, 0, "a b c d e", "a b c d e")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.bleu for r in bleu.sentence_bleu(df).orderBy("id").collect()] == [0.0, 0.0, 0.0, pytest.approx(100.0)]
    effective = bleu.BleuSettings(effective_order=True)
    assert [r.bleu for r in bleu.sentence_bleu(df, settings=effective).orderBy("id").collect()] == [pytest.approx(100.0), 0.0, 0.0, pytest.approx(100.0)]
    assert bleu.corpus_bleu(df.where("false")).first().bleu == 0.0
    assert bleu.corpus_bleu(df).first().signature == "nrefs:1|case:mixed|eff:no|tok:13a|smooth:exp"


def test_tokenizers(spark, evaluate):
    inputs = ["Hello, world! 3.5,x 1-2 a-b &amp; &lt;x&gt;", "a..b ,,5 end-\nline", "it's (ok)."]
    assert evaluate(bleu.tokens("v"), inputs) == [
        ["Hello", ",", "world", "!", "3.5", ",", "x", "1", "-", "2", "a-b", "&", "<", "x", ">"],
        ["a", ".", ".", "b", ",", ",5", "endline"],
        ["it's", "(", "ok", ")", "."],
    ]
    assert evaluate(bleu.tokens("v", bleu.BleuSettings("intl")), ["Hi, 3.5€ x"]) == [["Hi", ",", "3.5", "€", "x"]]
    assert evaluate(bleu.tokens("v", bleu.BleuSettings("zh")), ["你好 ab"]) == [["你", "好", "ab"]]
    assert evaluate(bleu.tokens("v", bleu.BleuSettings("none", lowercase=True)), ["A, b"]) == [["a,", "b"]]


def test_chrf_equals_its_definition(spark):
    rows = corpus(2, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    for order in (0, 2):
        found = {r.grp: r.chrf for r in chrf.corpus_chrf(df, ["grp"], word_order=order).collect()}
        for group in range(3):
            assert found[group] == pytest.approx(plain_chrf([(h, r) for _, g, h, r in rows if g == group], order), abs=1e-9)
    single = {r.id: r.chrf for r in chrf.sentence_chrf(df).collect()}
    assert all(single[i] == pytest.approx(plain_chrf([(h, r)]), abs=1e-9) for i, _, h, r in rows)


def plain_ter(hyp, ref):
    """Greedy TER without a beam: every block move is tried, each with a full edit distance."""

    def table(h):
        cost = [[j for j in range(len(ref) + 1)]]
        for i, a in enumerate(h, 1):
            row = [i]
            for j, b in enumerate(ref, 1):
                row.append(min(cost[-1][j - 1] + (a != b), cost[-1][j] + 1, row[-1] + 1))
            cost.append(row)
        return cost

    shifts = 0
    while True:
        cost = table(hyp)
        i, j = len(hyp), len(ref)
        total, hyp_bad, ref_bad, at = cost[i][j], [1] * i, [1] * j, [-1] * j
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (hyp[i - 1] != ref[j - 1]):
                hyp_bad[i - 1] = ref_bad[j - 1] = int(hyp[i - 1] != ref[j - 1])
                at[j - 1] = i - 1
                i, j = i - 1, j - 1
            elif i and cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
            else:
                at[j - 1] = i - 1
                j -= 1
        options = []
        for h in range(len(hyp)):
            for r in range(len(ref)):
                length = 0
                while h + length < len(hyp) and r + length < len(ref) and length < 10 and hyp[h + length] == ref[r + length]:
                    length += 1
                    if not any(hyp_bad[h : h + length]) or not any(ref_bad[r : r + length]) or h <= at[r] < h + length:
                        continue
                    for target in sorted({0 if r + k < 0 else at[r + k] + 1 for k in range(-1, length)}):
                        rest = hyp[:h] + hyp[h + length :]
                        place = target - length if target > h + length else target
                        moved = rest[:place] + hyp[h : h + length] + rest[place:]
                        options.append((table(moved)[-1][-1], -length, h, target, moved))
        best = min(options, default=None)
        if best is None or best[0] >= total:
            return shifts + total
        shifts, hyp = shifts + 1, best[4]


def test_ter_equals_its_definition():
    chooser = random.Random(9)
    pairs = []
    for _ in range(150):
        ref = [chooser.randrange(12) for _ in range(chooser.randint(1, 14))]
        hyp = [w for w in ref if chooser.random() < 0.9]
        if len(hyp) > 5:
            cut = chooser.randint(1, len(hyp) - 1)
            hyp = hyp[cut:] + hyp[:cut]
        pairs.append((hyp, ref))
    arrays = [[np.array(side, dtype=np.int64) for side in pair] for pair in pairs]
    found = ter.edit_counts([a for a, _ in arrays], [b for _, b in arrays]).tolist()
    assert found == [plain_ter(h, r) if h else len(r) for h, r in pairs]


def edited(chooser, words, edits, kinds):
    """A copy with some words dropped, added, changed or moved."""
    words = list(words)
    for _ in range(edits):
        at, kind = chooser.randrange(len(words) + 1), chooser.randrange(4)
        if kind == 0:
            words.insert(at, chooser.randrange(kinds))
        elif kind == 1:
            words[at : at + 1] = [chooser.randrange(kinds)]
        elif kind == 2 and len(words) > 1:
            words.pop(at % len(words))
        else:
            words = words[at:] + words[:at] if len(words) < 8 else words[:at] + words[at + 3 :] + words[at : at + 3]
    return words


def test_thin_band_equals_the_whole_beam():
    chooser = random.Random(4)
    refs = [[chooser.randrange(9) for _ in range(chooser.randint(1, 70))] for _ in range(300)]
    hyps = [edited(chooser, ref, chooser.randrange(9), 9) or [0] for ref in refs]
    arrays = [[np.array(words, dtype=np.int32) for words in side] for side in (hyps, refs)]
    whole = ter.Band(*arrays, keep=True)
    sides = whole.alignment()
    for limit in (0, 1, 3, 8, ter.BEAM - 1):
        thin = ter.ThinBand(*arrays, limit, keep=True).total
        within = np.flatnonzero(whole.total <= limit)
        assert (thin[within] == whole.total[within]).all() and (np.delete(thin, within) > limit).all()
        near = [[side[k] for k in within] for side in arrays]
        if len(within):
            found = ter.ThinBand(*near, limit, keep=True).alignment()
            assert all((f == s[within, : f.shape[1]]).all() for f, s in zip(found, sides))


def test_ter_of_near_pairs_needs_no_whole_beam(monkeypatch):
    chooser = random.Random(6)
    refs = [[chooser.randrange(500) for _ in range(chooser.randint(5, 60))] for _ in range(200)]
    hyps = [[ref[1], ref[0], *ref[2:-1]] for ref in refs]
    monkeypatch.setattr(ter, "Band", None)
    found = ter.edit_counts(*[[np.array(words, dtype=np.int32) for words in side] for side in (hyps, refs)])
    assert found.tolist() == [1 if ref[0] == ref[1] else 2 for ref in refs]


def test_all_orders_come_from_one_sort(monkeypatch):
    chooser = random.Random(8)
    texts = [["".join(chooser.choice("abé中 ") for _ in range(chooser.randint(0, 30))) for _ in range(200)] for _ in range(2)]
    texts[0][:3], texts[1][:3] = [None, "", "abcabc"], ["ab", None, "abcabc"]
    monkeypatch.setattr(ngrams, "clipped", None)
    for sides, kind in ((texts, pa.string()), ([[None if t is None else list(t) for t in side] for side in texts], pa.list_(pa.string()))):
        table = ngrams.match_table(pa.array(sides[0], kind), pa.array(sides[1], kind), 6)
        for n, (hyp_total, ref_total, matched) in enumerate(table, 1):
            for row, (h, r) in enumerate(zip(*sides)):
                h, r = grams(tuple(h or ""), n), grams(tuple(r or ""), n)
                assert (hyp_total[row], ref_total[row], matched[row]) == (sum(h.values()), sum(r.values()), sum((h & r).values()))


def test_ter_columns(spark):
    rows = [(1, 0, "b a c d", "a b c d"), (2, 0, "A b", "a b"), (3, 1, "x", ""), (4, 1, None, "a b"), (5, 2, "a b c d e f", "d e f a b c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.ter for r in ter.sentence_ter(df).orderBy("id").collect()] == [25.0, 0.0, 100.0, 100.0, pytest.approx(100 / 6)]
    groups = {r.grp: (r.edits, r.ref_words) for r in ter.corpus_ter(df, ["grp"]).collect()}
    assert groups == {0: (1, 6), 1: (3, 2), 2: (1, 6)}


def test_kfold_and_extremes(spark):
    df = spark.createDataFrame(corpus(3, 80), SCHEMA)
    folds = [r.bleu for r in bleu.corpus_bleu(df, ["grp"]).collect()]
    result = bleu.kfold_bleu(df, "grp").first()
    assert result.folds == 3 and result.mean_bleu == pytest.approx(np.mean(folds)) and result.std_bleu == pytest.approx(np.std(folds))
    assert result.overall_bleu == pytest.approx(bleu.corpus_bleu(df).first().bleu)
    scored = bleu.sentence_bleu(df)
    ranked = [r.id for r in scored.orderBy("bleu", "id").collect()]
    ends = bleu.worst_and_best(scored, 5)
    assert {r.id for r in ends.where("side = 'worst'").collect()} == set(ranked[:5])
    assert {r.id for r in ends.where("side = 'best'").collect()} == set(ranked[-5:])


def test_evaluation_equals_single_metrics(spark):
    df = spark.createDataFrame([*corpus(5, 60), (900, 1, None, "a b"), (901, 2, "", ""), (902, 2, None, None)], SCHEMA)
    found = {r.grp: r for r in evaluation.evaluate(df, ["bleu", "chrf", "chrf_words", "ter", "exact"], ["grp"]).collect()}
    singles = {
        "bleu": bleu.corpus_bleu(df, ["grp"]), "chrf": chrf.corpus_chrf(df, ["grp"]), "ter": ter.corpus_ter(df, ["grp"]),
        "chrf_words": chrf.corpus_chrf(df, ["grp"], word_order=2).withColumnRenamed("chrf", "chrf_words"),
    }
    for name, single in singles.items():
        rows = single.collect()
        assert {r.grp for r in rows} == set(found)
        for row in rows:
            one = found[row.grp]
            assert one.signatures[name] == row.signature
            assert all(one[c] == pytest.approx(row[c]) for c in row.asDict() if c not in ("grp", "signature"))
    exact = df.groupBy("grp").agg((100.0 * F.avg(F.col("hypothesis").eqNullSafe(F.col("reference")).cast("int"))).alias("x"), F.count("*").alias("n"))
    assert all((found[r.grp].exact, found[r.grp].pairs) == (pytest.approx(r.x), r.n) for r in exact.collect())


def test_evaluation_reads_and_shuffles_once(spark, tmp_path):
    spark.createDataFrame(corpus(6, 30), SCHEMA).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    scores = evaluation.evaluate(df, ["bleu", "chrf_words", "ter"], ["grp"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("Exchange hashpartitioning"), plan.count("ArrowEvalPython")) == (1, 1, 1)
    empty = evaluation.evaluate(df.where("id < 0"), ["bleu", "ter", "exact"]).first()
    assert (empty.bleu, empty.ter, empty.exact, empty.sys_len) == (0.0, 0.0, None, 0)
    assert evaluation.evaluate(df.where("id < 0"), ["bleu"], ["grp"]).count() == 0
    for wrong in ([], ["bleu", "bleu"], ["meteor"]):
        with pytest.raises(ValueError):
            evaluation.evaluate(df, wrong)


def test_user_metric(spark):
    df = spark.createDataFrame(corpus(4, 50), SCHEMA)
    statistics = F.array(F.length("hypothesis"), F.length("reference"))
    ratio = score(df, statistics, 2, lambda h, r: [(h / r).alias("ratio")], ["grp"])
    expected = df.groupBy("grp").agg((F.sum(F.length("hypothesis")) / F.sum(F.length("reference"))).alias("ratio"))
    assert sorted(map(tuple, ratio.collect())) == sorted(map(tuple, expected.collect()))


def test_inference(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("source")).repartition(3)

    def make_predict():
        return lambda batch: [f"{t} ( s )/{len(batch) <= 7}" for t in batch]

    rows = inference.batch_infer(df, make_predict, batch_size=7, prefix="p ").collect()
    assert all(r.prediction == f"p {r.id} ( s )/True" for r in rows) and len(rows) == 100
    copied = inference.batch_infer(df, inference.copy_predictor, clean="light")
    assert copied.where("prediction <> source").count() == 0
    with pytest.raises(Exception, match="answers"):
        inference.batch_infer(df, lambda: lambda batch: [], "source").collect()


def test_comparison_and_votes(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "id int, reference string")
    models = {"good": F.col("reference"), "bad": F.lit("x")}
    result = inference.compare_models(df, models).collect()
    assert [(r.model, r.weight) for r in result] == [("good", 0.5), ("bad", 0.5)] and result[0].bleu == pytest.approx(100.0)
    both = inference.compare_models(df, models, secondary=["bleu", "ter", "exact"]).collect()
    assert [(r.model, r.ter, r.exact) for r in both] == [("good", 0.0, 100.0), ("bad", 100.0, 0.0)] and set(both[0].signatures) == {"bleu", "ter", "exact"}
    assert inference.compare_models(df, models, samples=1, order=["id"]).first().ref_len == 6
    votes = spark.createDataFrame([(1, "b", 1.0), (1, "a", 0.5), (1, "a", 0.5), (2, "z", 2.0)], "id int, prediction string, weight double")
    assert sorted((r.id, r.prediction) for r in studies.weighted_vote(votes).collect()) == [(1, "a"), (2, "z")]


def test_sampling(spark):
    df = spark.range(20_000)
    parts = sampling.split_by_hash(df, ["id"], 0.1, 42)
    share = parts.where("part = 'validation'").count() / 20_000
    assert abs(share - 0.1) < 0.01
    assert parts.exceptAll(sampling.split_by_hash(df.repartition(7), ["id"], 0.1, 42)).count() == 0
    assert sampling.assign_folds(df, ["id"]).select("fold").distinct().count() == 5
    shards = [sampling.shard(df, ["id"], rank, 4).count() for rank in range(4)]
    assert sum(shards) == 20_000 and min(shards) > 4_500
    assert sampling.with_shard(df, ["id"], 4).where("shard = 1").count() == shards[1]
    order = [r.id for r in sampling.shuffled(df, ["id"]).limit(50).collect()]
    assert order == [r.id for r in sampling.shuffled(df.repartition(5), ["id"]).limit(50).collect()] and order != sorted(order)
    with pytest.raises(ValueError):
        sampling.shard(df, ["id"], 4, 4)
    assert [r.id for r in sampling.cap_rows(df, 3, ["id"]).collect()] == [0, 1, 2]

"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs that stand for letters to Latin
letters, and turns what is left into spaces. Lexicon terms are whole words or beginnings of words. They are learned from
a sample of at most about ``SAMPLE_ROWS`` labelled rows, chosen by the hash of their key, each text once: of the words
and word beginnings of toxic texts those are taken, best first, that cover toxic texts not yet covered ``COVER`` times,
while few clean texts have them; a term's weight is its log-odds. Matches inside an exception phrase do not count. The
sum of weights, and the same per hundred words, go through a logistic function fitted on the sample.

Defined cases: a null or empty text has no match and gets the score of no match; without labelled rows the lexicon is
empty and scores are 0; ids with several label rows count as toxic if any says so; repeated rows are repeated in the
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import stored

SAMPLE_ROWS = 10_000
SHORTEST, LONGEST = 4, 7
MIN_TEXTS = 4
MAX_CLEAN_SHARE = 0.05
COVER = 2
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser")

# Look-alikes of Latin letters in other scripts.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһӏѵաοαεικνρτυχ", "aeopcyxijsdhlvaoaeikvptux")
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _byte_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    for sign, letter in SUBSTITUTES.items():
        table[ord(sign)] = ord(letter)
    return table


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and offsets of a block of texts."""
    import pyarrow.compute as pc

    low = pc.utf8_lower(pc.fill_null(texts, ""))
    odd = pc.match_substring_regex(low, "[" + "".join(map(chr, HOMOGLYPHS)) + "]")
    if pc.any(odd).as_py():
        low = pa.array([t.translate(HOMOGLYPHS) if o else t for t, o in zip(low.to_pylist(), odd.to_pylist())], pa.string())
    data, offsets = W.column_bytes(low)
    return _byte_table()[data], offsets


def _terms(labelled: DataFrame) -> DataFrame:
    """(row, toxic, term): distinct words (with a space on both sides) and word beginnings (a space in front) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in W.blocks(batches, "text"):
            data, offsets = fold(rows.column("text"))
            starts, ends, row = W.words(data, offsets)
            hashes = W.byte_span_hash(data, starts, ends)
            keep = np.unique(np.stack([row.astype(np.uint64), hashes], 1), axis=0, return_index=True)[1]
            raw = data.tobytes()
            out: set[tuple[int, str]] = set()
            for r, b, e in zip(row[keep].tolist(), starts[keep].tolist(), ends[keep].tolist()):
                word = raw[b:e].decode("utf-8", "replace")
                out.add((r, f" {word} "))
                for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
                    out.add((r, f" {word[:n]}"))
            number, toxic = rows.column("row").to_pylist(), rows.column("toxic").to_pylist()
            both = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([number[r] for r, _ in both], pa.int64()), pa.array([toxic[r] for r, _ in both], pa.int32()), pa.array([t for _, t in both], pa.string())], ["row", "toxic", "term"])

    return labelled.mapInArrow(run, "row bigint, toxic int, term string")


def choose(pairs: list[tuple[int, str]], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms and weights by greedy cover of the toxic texts (row, term)."""
    holders: dict[str, set[int]] = {}
    for row, term in pairs:
        holders.setdefault(term, set()).add(row)
    need = dict.fromkeys({row for row, _ in pairs}, COVER)
    fits = {t: rows for t, rows in holders.items() if len(rows) >= MIN_TEXTS and clean.get(t, 0) <= MAX_CLEAN_SHARE * len(rows) * n_clean / max(n_toxic, 1)}
    chosen: dict[str, float] = {}
    while fits:
        gain = {t: sum(need[r] > 0 for r in rows) for t, rows in fits.items()}
        fits = {t: rows for t, rows in fits.items() if gain[t] >= MIN_TEXTS}
        if not fits:
            break
        best = max(fits, key=lambda t: (gain[t] - clean.get(t, 0), len(t), t))
        for row in fits.pop(best):
            need[row] -= 1
        chosen[best] = float(np.log((len(holders[best]) + 0.5) / (n_toxic + 1)) - np.log((clean.get(best, 0) + 0.5) / (n_clean + 1)))
        # A beginning and the words that begin with it are one term.
        fits = {t: rows for t, rows in fits.items() if not (t.startswith(best.rstrip()) or best.startswith(t.rstrip()))}
    return chosen


def automaton(lexicon: dict[str, float], exceptions: Sequence[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        machine.add_word(term, (len(term), weight))
    for phrase in exceptions:
        term = f" {phrase} "
        machine.add_word(term, (len(term), None))
    if len(machine):
        machine.make_automaton()
    return machine


def matches(machine, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of a folded block: sum of weights, matches, words."""
    n = len(offsets) - 1
    starts, ends, rows = W.words(data, offsets)
    # Words of a row joined by single spaces, rows by two: every word has a space on both sides.
    gap = np.zeros(len(data) + 1, np.int64)
    keep = np.zeros(len(data), bool)
    np.add.at(gap, starts, 1)
    np.add.at(gap, ends, -1)
    keep = np.cumsum(gap[:-1]) > 0
    after = np.zeros(len(data), bool)
    after[ends - 1] = True
    out = np.repeat(data[keep], 1 + after[keep])
    if len(out):
        position = np.cumsum(1 + after[keep]) - 1
        out[position[after[keep]]] = 32
    sizes = ends - starts + 1
    byte_ends = np.cumsum(sizes)
    text = " " + out.tobytes().decode("utf-8", "replace")
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    word_end = chars[byte_ends] if len(byte_ends) else byte_ends  # place of the space after each word, in characters
    weight, count = np.zeros(n), np.zeros(n, np.int64)
    words_of = np.bincount(rows, minlength=n)
    if not len(machine) or not len(rows):
        return weight, count, words_of
    row_end = np.zeros(n, np.int64)
    np.maximum.at(row_end, rows, word_end)
    row_end = np.maximum.accumulate(row_end)
    hits = [(end - size + 1, end, value) for end, (size, value) in machine.iter(text)]
    covered = sorted((b, e) for b, e, value in hits if value is None)
    cover_start, cover_end = np.array([b for b, _ in covered]), np.array([e for _, e in covered])
    for begin, end, value in hits:
        if value is None:
            continue
        if len(covered):
            k = int(np.searchsorted(cover_start, begin, "right")) - 1
            if k >= 0 and end <= cover_end[k]:
                continue
        row = int(np.searchsorted(row_end, begin + 1, "left"))
        if row < n and begin >= (row_end[row - 1] if row else 0):
            weight[row] += value
            count[row] += 1
    return weight, count, words_of


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    theta = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        step = np.linalg.solve(features.T @ (features * (p * (1 - p))[:, None]) + ridge * np.eye(len(theta)), features.T @ (labels - p) - ridge * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return theta.tolist()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: Sequence[str] = EXCEPTIONS) -> dict:
    """The model from labelled rows: lexicon, exception phrases and the logistic function."""
    known = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic"))
    known = stored(known.withColumn("mark", F.pmod(F.xxhash64("key"), F.lit(1 << 30))), "labels")
    total = known.count()
    share = 1.0 if total <= sample_rows else sample_rows / total
    chosen = known.where(F.col("mark") <= share * (1 << 30)).select("key", "toxic")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # The sample's keys number at most about sample_rows, whatever the data.
    joined = texts.join(F.broadcast(chosen), "key").withColumn("mark", F.xxhash64("text"))
    sample = stored(joined.dropDuplicates(["mark"]).select(F.monotonically_increasing_id().alias("row"), "toxic", "text"), "toxicity-sample")
    sizes = {bool(r[0]): r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return {"lexicon": {}, "exceptions": tuple(exceptions), "theta": [-30.0, 0.0, 0.0]}
    toxic_terms = stored(_terms(sample.where("toxic > 0")), "toxic-terms")
    often = toxic_terms.groupBy("term").count().where(F.col("count") >= MIN_TEXTS).select("term")
    often = stored(often, "toxic-candidates")
    clean = {t: n for t, n in _terms(sample.where("toxic = 0")).join(often, "term").groupBy("term").count().toArrow().to_pandas().itertuples(index=False)}
    pairs = [(r, t) for r, t in toxic_terms.join(often, "term").select("row", "term").toArrow().to_pandas().itertuples(index=False)]
    lexicon = choose(pairs, clean, n_toxic, n_clean)
    model = {"lexicon": lexicon, "exceptions": tuple(exceptions), "theta": None}
    seen = _weigh(sample.select("row", "toxic", "text"), model).select("toxic", "weight", "words").toArrow()
    features = _features(seen.column("weight").to_numpy(), seen.column("words").to_numpy())
    model["theta"] = fit_logistic(features, (seen.column("toxic").to_numpy() > 0).astype(float))
    return model


def _weigh(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` without their text, with weight, matches, words."""
    from pyspark.sql.types import DoubleType, LongType, StructType

    others = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(model["lexicon"], model["exceptions"])
        for block, _, _ in W.blocks(batches, "text"):
            weight, count, words = matches(machine, *fold(block.column("text")))
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in names), pa.array(weight), pa.array(count), pa.array(words.astype(np.int64))], [*names, "weight", "matches", "words"])

    schema = StructType(others).add("weight", DoubleType()).add("matches", LongType()).add("words", LongType())
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, matches) of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    base, by_weight, by_density = (F.lit(float(x)) for x in model["theta"])
    logit = base + by_weight * F.log1p("weight") + by_density * F.log1p(100 * F.col("weight") / F.greatest("words", F.lit(1)))
    value = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    return _weigh(rows, model).select(F.col("key").alias(key), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "matches")

"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and kept as sorted hash arrays in shared files.

Tokens are words (A-Z lower-cased) and one end per text; the first token's context is the beginning. Words are 48-bit
hashes. Counting: tasks count words and pairs of about ``CHUNK`` tokens and send them on as packed arrays by shard; a
shard merges its arrays, sorts them by hash and writes one file. A pair goes to the shard of its first word, so that
context figures are complete there; words with more than a share of a shard's tokens are spread over all shards by the
pair's hash, and their context figures, few numbers for few words, are added up apart. The number of shards follows the
size of the corpus, so a shard stays bounded. Workers map the files into memory and look up sorted, distinct hashes.

For order 3, triples are counted first, in ``PASSES`` over ranges of the shards, so that a shuffle holds a part of them
only and is deleted before the next. A triple goes to the shard of its middle word, where its context and the number of
words before each pair are complete, and so is the pair level of that word; a frequent middle word has several shards,
by the triple's hash, and what they find is added up by a further shuffle. The pair level counts the distinct words
before a pair; before a pair that begins a text nothing stands, so that its occurrences count. The first token of a text
has a pair only.

Files are small: of a 64-bit hash the top bits are its bucket and the next 40 are kept (a wrong hit has a chance below
one in 10^11 per look-up). Counts of one, nearly all, are not written, nor are contexts that were seen once: where a
pair is known and its context isn't, the context was seen once.

Files lie in the folder of ``spark.checkpoint.dir``. If that is mounted on the executors (a path or ``file:``) they are
memory-mapped; from other stores a shard is read into memory through ``pyarrow.fs``.

Defined cases: null or empty texts are one end token; without training rows every token has the probability of an
unseen one; repeated rows count and are scored as often as they come; null keys are kept; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import words as W
from glossmill.llm.tables import freed_shuffles, only, shared_folder, stored

CHUNK = 2_000_000
SHARD_TOKENS = 1 << 20
HOT_SHARE = 0.25  # of a shard's tokens
BLOCK = 3 << 21
PASSES = 2
NONE, END, BEGIN = 0, 1, 2  # word numbers that no word has: word hashes are forced above them

_U = np.uint64


def text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first token of each row and the total): words, then the end, row by row."""
    low = W.lower_ascii(data)
    starts, ends, rows = W.words(low, offsets)
    numbers = np.maximum(W.byte_span_hash(low, starts, ends) >> _U(16), _U(3))
    n = len(offsets) - 1
    last = np.searchsorted(rows, np.arange(1, n + 1))
    return np.insert(numbers, last, _U(END)), np.concatenate([[0], last + np.arange(1, n + 1)])


def contexts(tokens: np.ndarray, first: np.ndarray, back: int = 1) -> np.ndarray:
    """The token ``back`` places before each: the beginning just before a row's first token, nothing before that."""
    before = np.empty_like(tokens)
    before[back:] = tokens[:-back]
    for k in range(back):
        at = first[:-1] + k
        before[at[at < first[1:]]] = BEGIN if k == back - 1 else NONE
    return before


def histories(tokens: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """The tokens before each token, from the farthest to the nearest."""
    return tuple(contexts(tokens, first, back) for back in range(order - 1, 0, -1))


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(before) + tokens * _U(0x9E3779B97F4A7C15))


def gram_keys(outer: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return pair_keys(pair_keys(outer, before), tokens)


def pack_counts(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, padded to 64-bit numbers; places and values of those above 254."""
    small = np.zeros(-(-len(counts) // 8) * 8, np.uint8)
    small[: len(counts)] = np.minimum(counts, 255)
    large = np.flatnonzero(counts >= 255)
    return [small.view(np.int64), large, counts[large]]


def unpack_counts(arrays: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    small, large, values = arrays
    out = small.view(np.uint8)[place].astype(np.int64)
    more = np.flatnonzero(out == 255)
    out[more] = values[np.searchsorted(large, place[more])]
    return out


def _padded(values: np.ndarray) -> np.ndarray:
    """An array of small numbers as 64-bit ones, with room behind."""
    raw = np.ascontiguousarray(values).view(np.uint8)
    out = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    out[: len(raw)] = raw
    return out.view(np.int64)


KEY_ARRAYS = 4


def pack_keys(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes: bits of a bucket number, where each bucket begins, and 40 further bits of each."""
    bits = max(1, len(keys).bit_length() - 2)
    begin = np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = (keys << _U(bits)) >> _U(24)
    return [np.array([bits, len(keys)], np.int64), _padded(begin), _padded((rest >> _U(8)).astype(np.uint32)), _padded((rest & _U(255)).astype(np.uint8))]


def find_keys(arrays: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The place of each hash among the packed ones, or -1."""
    bits = int(arrays[0][0])
    begin, high, low = arrays[1].view(np.uint32), arrays[2].view(np.uint32), arrays[3].view(np.uint8)
    bucket = (keys >> _U(64 - bits)).astype(np.int64)
    rest = (keys << _U(bits)) >> _U(24)
    at, stop = begin[bucket].astype(np.int64), begin[bucket + 1].astype(np.int64)
    want_high, want_low = (rest >> _U(8)).astype(np.uint32), (rest & _U(255)).astype(np.uint8)
    out = np.full(len(keys), -1, np.int64)
    open_ = np.flatnonzero(at < stop)
    while len(open_):
        place = at[open_]
        hit = (high[place] == want_high[open_]) & (low[place] == want_low[open_])
        out[open_[hit]] = place[hit]
        open_ = open_[~hit]
        at[open_] += 1
        open_ = open_[at[open_] < stop[open_]]
    return out


def pack_ones(counts: np.ndarray) -> list[np.ndarray]:
    """Counts of which nearly all are one: places and values of the others."""
    more = np.flatnonzero(counts != 1)
    return [np.array([len(more)], np.int64), _padded(more.astype(np.uint32)), *pack_counts(counts[more])]


def unpack_ones(arrays: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    n = int(arrays[0][0])
    out = np.ones(len(place), np.int64)
    if n:
        known = arrays[1].view(np.uint32)[:n]
        at = np.minimum(np.searchsorted(known, place.astype(np.uint32)), n - 1)
        hit = known[at] == place
        out[hit] = unpack_counts(arrays[2:5], at[hit])
    return out


def pack48(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def _merge(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in columns))


def _word_shard(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> _U(48 - bits)).astype(np.int64)


def _key_shard(keys: np.ndarray, bits: int) -> np.ndarray:
    """One of 2 ** bits shards for each hash. Not its top bits: they are its bucket, and a shard's keys must fill all buckets."""
    return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(1) >> _U(63 - bits)).astype(np.int64)


def _pair_shard(before: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    own = _word_shard(before, bits)
    spread = np.isin(before, hot)
    own[spread] = _key_shard(keys[spread], bits)
    return own


def _gram_shard(before: np.ndarray, keys: np.ndarray, hot: np.ndarray, parts: np.ndarray, bits: int) -> np.ndarray:
    """The shard of the middle word; a hot one has 2 ** parts shards in a row, by the triple's hash."""
    own = _word_shard(before, bits)
    at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
    spread = hot[at] == before
    own[spread] = (own[spread] + (_key_shard(keys[spread], bits) >> (bits - parts[at[spread]]))) & ((1 << bits) - 1)
    return own


def _by_shard(shard: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    small = shard.astype(np.uint16) if count <= 1 << 16 else shard  # these are sorted by digits
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(count + 1))


def _chunks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[np.ndarray, ...]]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for _, data, offsets in W.blocks(batches, "text"):
        tokens, first = text_tokens(data, offsets)
        held.append((*histories(tokens, first, order), tokens))
        size += len(tokens)
        if size >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


WORDS = "shard int, words binary, counts binary, also binary"


def _count_words(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tokens,) in _chunks(batches, 1):
            words, counts = np.unique(tokens, return_counts=True)
            at = np.searchsorted(_word_shard(words, bits), np.arange((1 << bits) + 1))
            rows = [(s, pack48(words[a:b]), counts[a:b].astype(np.uint32).tobytes(), None) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "words", "counts", "also"), r)) for r in rows], pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("also", pa.binary())]))

    return texts.mapInArrow(run, WORDS)


def _count_pairs(texts: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, tokens in _chunks(batches, 2):
            keys, first, counts = np.unique(pair_keys(before, tokens), return_index=True, return_counts=True)
            before, tokens = before[first], tokens[first]
            order, at = _by_shard(_pair_shard(before, keys, hot, bits), 1 << bits)
            for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if b > a:
                    take = order[a:b]
                    yield pa.RecordBatch.from_pylist([{"shard": s, "words": pack48(before[take]), "counts": counts[take].astype(np.uint32).tobytes(), "also": pack48(tokens[take])}], pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("also", pa.binary())]))

    return texts.mapInArrow(run, WORDS)


GRAMS = pa.schema([("shard", pa.int32()), ("outer", pa.binary()), ("words", pa.binary()), ("also", pa.binary()), ("counts", pa.binary())])


def _count_grams(texts: DataFrame, hot: np.ndarray, parts: np.ndarray, bits: int, low: int, high: int) -> DataFrame:
    """Triples of the shards from ``low`` up to ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer, before, tokens in _chunks(batches, 3):
            # A hot word's triples may lie anywhere; of other words the shard is known without the triple's hash.
            own = _word_shard(before, bits)
            near = ((own >= low) & (own < high)) | np.isin(before, hot)
            outer, before, tokens = outer[near], before[near], tokens[near]
            keys, first, counts = np.unique(gram_keys(outer, before, tokens), return_index=True, return_counts=True)
            outer, before, tokens = outer[first], before[first], tokens[first]
            shard = _gram_shard(before, keys, hot, parts, bits)
            order = np.lexsort((outer, before, shard))  # equal words in a row take little room
            at = np.searchsorted(shard[order], np.arange(low, high + 1))
            for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), low):
                if b > a:
                    take = order[a:b]
                    yield pa.RecordBatch.from_pylist([{"shard": s, "outer": pack48(outer[take]), "words": pack48(before[take]), "also": pack48(tokens[take]), "counts": counts[take].astype(np.uint32).tobytes()}], GRAMS)

    return texts.mapInArrow(run, "shard int, outer binary, words binary, also binary, counts binary")


def _kinds(counts: np.ndarray) -> list[np.ndarray]:
    return [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_file(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays of 64-bit numbers, one after the other behind their lengths; a repeated task writes the same file again."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    body = b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    local = _local(folder)
    if local is None:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(body)
        return
    os.makedirs(local, exist_ok=True)
    part = f"{local}/.{name}-{os.getpid()}"
    with open(part, "wb") as out:
        out.write(body)
    os.replace(part, f"{local}/{name}")


def read_file(folder: str, name: str) -> list[np.ndarray]:
    local = _local(folder)
    if local is None:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        with store.open_input_file(f"{path}/{name}") as source:
            raw = np.frombuffer(source.read(), np.int64)
    else:
        raw = np.asarray(np.memmap(f"{local}/{name}", np.int64, "r"))
    count = int(raw[0])
    edges = (1 + count + np.concatenate([[0], np.cumsum(raw[1 : 1 + count])])).tolist()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


FIGURES = "name string, word bigint, value bigint"


def _figures(rows: list[tuple[str, int, int]]) -> pa.Table:
    names, words, values = zip(*rows) if rows else ((), (), ())
    return pa.table({"name": pa.array(names, pa.string()), "word": pa.array(words, pa.int64()), "value": pa.array(values, pa.int64())})


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more; where too few counts exist to estimate them, a half, one and one and a half."""
    if min(n1, n2, n3, n4) < 1:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def train(docs: DataFrame, text: str = "text", order: int = 2) -> dict:
    """Counts the texts, writes the arrays and returns the model's few numbers and its folder."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is not 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = max(0, int(np.ceil(np.log2(max(1.0, ((size[0] or 0) / 6 + size[1]) / SHARD_TOKENS)))))
    shards, folder = 1 << bits, shared_folder(spark, "language-model")
    limit = HOT_SHARE * SHARD_TOKENS

    def merge_words(group: pa.Table) -> pa.Table:
        words, counts = _merge(unpack48(group.column("words").to_pylist()), np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32).astype(np.int64))
        shard = group.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [pack48(words)], "counts": [counts.tobytes()], "hot": pa.array([words[counts > limit].astype(np.int64).tolist()], pa.list_(pa.int64())), "often": pa.array([counts[counts > limit].tolist()], pa.list_(pa.int64())), "total": [int(counts.sum())], "distinct": [len(words)]})

    words = stored(_count_words(texts, bits).groupBy("shard").applyInArrow(merge_words, "shard int, words binary, counts binary, hot array<bigint>, often array<bigint>, total bigint, distinct bigint"), "lm-words")
    total, distinct = words.agg(F.sum("total"), F.sum("distinct")).first()
    # Fewer hot words than four times the shards: each has a quarter of a shard's tokens.
    often = dict(words.select(F.explode(F.arrays_zip("hot", "often")).alias("x")).select("x.*").collect()) | {BEGIN: size[1]}
    hot = np.array(sorted(often), np.uint64)
    parts = np.array([min(bits, max(0, int(np.ceil(np.log2(max(often[w], 1) / limit))))) for w in hot.tolist()], np.int64)

    def pair_level(shard: int, name: str, before: np.ndarray, tokens: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
        """Writes distinct pairs in the order of their keys; figures, and how many distinct words stand before each word."""
        owner, *sums = _merge(before, counts, *_kinds(counts))
        write_file(folder, f"{name}-{shard}", [*pack_keys(keys), *pack_ones(counts), owner, *sums])
        figures = [(f"pairs-{k}", 0, int((counts == k).sum())) for k in range(1, 5)] + [("pairs", 0, len(counts))]
        for k in np.flatnonzero(np.isin(owner, hot)).tolist():
            figures += [(f"hot-{j}", int(owner[k]), int(s[k])) for j, s in enumerate(sums)]
        word, follows = np.unique(tokens, return_counts=True)
        cut = np.searchsorted(_word_shard(word, bits), np.arange(shards + 1))
        rows = [(s, pack48(word[a:b]), follows[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        return figures, rows

    names = ["shard", "words", "counts", "also", "contexts", "sums", "followed", "follows", "name", "word", "value"]
    kinds = f"{WORDS}, contexts binary, sums binary, followed binary, follows binary, {FIGURES}"

    def packed(rows: list[tuple], *columns: str) -> pa.Table:
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), **{n: pa.array([r[k + 1] for r in rows], pa.binary()) for k, n in enumerate(columns)}})

    def laid_out(*tables: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], pa.int32() if n == "shard" else pa.string() if n == "name" else pa.int64() if n in ("word", "value") else pa.binary()) for n in names})
        return pa.concat_tables([empty, *tables], promote_options="default").select(names)

    def merge_grams(group: pa.Table) -> pa.Table:
        outer, before, tokens = (unpack48(group.column(c).to_pylist()) for c in ("outer", "words", "also"))
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32).astype(np.int64)
        keys = gram_keys(outer, before, tokens)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts, order = keys[at], np.add.reduceat(counts[order], at), order[at]
        outer, before, tokens = outer[order], before[order], tokens[order]
        inner = before != BEGIN
        own = counts[inner]
        owner, *sums, spread = _merge(pair_keys(outer[inner], before[inner]), own, *_kinds(own), np.isin(before[inner], hot).astype(np.int64))
        sums = np.stack(sums, 1)
        shard = group.column("shard")[0].as_py()
        more = (spread == 0) & (sums[:, 0] > 1)
        write_file(folder, f"grams-{shard}", [*pack_keys(keys[inner]), *pack_ones(own)])
        write_file(folder, f"contexts-{shard}", [*pack_keys(owner[more]), *(a for x in sums[more].T for a in pack_counts(x))])
        figures = [(f"grams-{k}", 0, int((own == k).sum())) for k in range(1, 5)] + [("grams", 0, len(own))]
        owner, sums = owner[spread > 0], sums[spread > 0].astype(np.uint32)
        take, cut = _by_shard(_key_shard(owner, bits), shards)
        owner, sums = owner[take], sums[take]
        partial = [(s, owner[a:b].tobytes(), sums[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        # One for every word before a pair; a pair that begins a text counts as often as it occurs.
        key, first = np.unique(pair_keys(before, tokens), return_index=True)
        _, times = _merge(pair_keys(before, tokens), np.where(inner, 1, counts))
        before, tokens = before[first], tokens[first]
        frequent = np.isin(before, hot)
        more_figures, followed = pair_level(shard, "pairs", before[~frequent], tokens[~frequent], key[~frequent], times[~frequent])
        before, tokens, key, times = before[frequent], tokens[frequent], key[frequent], times[frequent]
        take, cut = _by_shard(_pair_shard(before, key, hot, bits), shards)
        pairs = [(s, pack48(before[take[a:b]]), times[take[a:b]].astype(np.uint32).tobytes(), pack48(tokens[take[a:b]])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        return laid_out(packed(pairs, "words", "counts", "also"), packed(partial, "contexts", "sums"), packed(followed, "followed", "follows"), _figures(figures + more_figures))

    def merge_contexts(group: pa.Table) -> pa.Table:
        owner = np.frombuffer(b"".join(group.column("contexts").to_pylist()), np.uint64)
        sums = np.frombuffer(b"".join(group.column("sums").to_pylist()), np.uint32).astype(np.int64).reshape(-1, 4)
        shard = group.column("shard")[0].as_py()
        owner, *sums = _merge(owner, *sums.T)
        more = sums[0] > 1
        write_file(folder, f"hot-contexts-{shard}", [*pack_keys(owner[more]), *(a for x in sums for a in pack_counts(x[more]))])
        return pa.table({"n": [len(owner)]})

    def merge_pairs(group: pa.Table) -> pa.Table:
        before, tokens = unpack48(group.column("words").to_pylist()), unpack48(group.column("also").to_pylist())
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32).astype(np.int64)
        keys = pair_keys(before, tokens)
        order = np.argsort(keys, kind="stable")
        keys, before, tokens, counts = keys[order], before[order], tokens[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, before, tokens, counts = keys[at], before[at], tokens[at], np.add.reduceat(counts, at)
        shard, frequent = group.column("shard")[0].as_py(), np.isin(before, hot)
        figures, followed = pair_level(shard, "hot-pairs", before[frequent], tokens[frequent], keys[frequent], counts[frequent])
        if order_ == 2:  # else the triples' shards have written the pairs of other words
            also = pair_level(shard, "pairs", before[~frequent], tokens[~frequent], keys[~frequent], counts[~frequent])
            figures, followed = figures + also[0], followed + also[1]
        return laid_out(packed(followed, "followed", "follows"), _figures(figures))

    order_ = order

    def counted() -> DataFrame:
        """What the pair level has found: figures, and the words before each word."""
        if order_ == 2:
            return _count_pairs(texts, hot, bits).groupBy("shard").applyInArrow(merge_pairs, kinds)
        passes = min(PASSES, shards)
        edges = [shards * k // passes for k in range(passes + 1)]
        parts_ = [stored(_count_grams(texts, hot, parts, bits, a, b).groupBy("shard").applyInArrow(merge_grams, kinds), "lm-grams") for a, b in zip(edges, edges[1:])]
        grams = reduce(DataFrame.unionByName, parts_)
        with freed_shuffles(spark):
            grams.where("contexts is not null").select("shard", "contexts", "sums").groupBy("shard").applyInArrow(merge_contexts, "n bigint").agg(F.sum("n")).collect()
        found = grams.where("words is not null").select("shard", "words", "counts", "also").groupBy("shard").applyInArrow(merge_pairs, kinds)
        return found.unionByName(grams.where("name is not null or followed is not null"))

    merged = only(spark, "lm-pairs", lambda: counted().select("shard", "followed", "follows", "name", "word", "value"))

    def finish(group: pa.Table) -> pa.Table:
        kind, shard = group.column("kind").to_numpy(), group.column("shard")[0].as_py()
        blobs = list(zip(kind, group.column("words").to_pylist(), group.column("counts").to_pylist()))
        own = [unpack48([w]) for _, w, _ in blobs]
        seen = [np.frombuffer(c, np.int64) if k == 0 else np.zeros(len(w), np.int64) for (k, _, c), w in zip(blobs, own)]
        after = [np.frombuffer(c, np.uint32).astype(np.int64) if k == 1 else np.zeros(len(w), np.int64) for (k, _, c), w in zip(blobs, own)]
        word, count, follows = _merge(np.concatenate(own), np.concatenate(seen), np.concatenate(after))
        write_file(folder, f"words-{shard}", [word, count, follows])
        return _figures([(f"words-{k}", 0, int((follows == k).sum())) for k in range(1, 5)] + [("words-more", 0, int((follows > 2).sum()))])

    after = merged.where("followed is not null").select("shard", F.lit(1).alias("kind"), F.col("followed").alias("words"), F.col("follows").alias("counts"))
    both = words.select("shard", F.lit(0).alias("kind"), "words", "counts").unionByName(after)
    figures = stored(both.groupBy("shard").applyInArrow(finish, FIGURES), "lm-figures").unionByName(merged.where("name is not null").select("name", "word", "value"))
    sums = {(r[0], r[1]): r[2] for r in figures.groupBy("name", "word").agg(F.sum("value")).collect()}
    get = lambda name: sums.get((name, 0), 0)
    hot_figures = np.array([[sums.get((f"hot-{j}", int(w)), 0) for j in range(4)] for w in hot], np.float64).reshape(-1, 4)
    lower = discounts(*(get(f"words-{k}") for k in range(1, 5)))
    pairs = get("pairs")
    left = (lower[0] * get("words-1") + lower[1] * get("words-2") + lower[2] * get("words-more")) / pairs if pairs else 1.0
    grams = {"parts": parts, "triples": get("grams"), "higher": discounts(*(get(f"grams-{k}") for k in range(1, 5)))}
    return {**grams, "order": order, "folder": folder, "bits": bits, "tokens": total or 0, "words": distinct or 0, "pairs": pairs, "hot": hot, "hot_figures": hot_figures, "discounts": discounts(*(get(f"pairs-{k}") for k in range(1, 5))), "lower": lower, "left": left}


def _file(folder: str, name: str) -> list[np.ndarray]:
    cache = W.state().setdefault("lm_files", {})
    if (folder, name) not in cache:
        for key in [k for k in cache if k[0] != folder]:
            del cache[key]
        try:
            cache[folder, name] = read_file(folder, name)
        except FileNotFoundError:  # a shard without any entry has no file
            cache[folder, name] = []
    return cache[folder, name]


def _per_shard(folder: str, kind: str, shard: np.ndarray, count: int, keys: np.ndarray | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The arrays of each shard that has a file, and the places of its keys, roughly in the order of the keys."""
    left = 16 - (count - 1).bit_length()
    if keys is None or left <= 0:
        order, edges = _by_shard(shard, count)
    else:
        code = ((shard.astype(np.uint64) << _U(left)) | (keys >> _U(64 - left))).astype(np.uint16)
        order = np.argsort(code, kind="stable")  # by digits
        edges = np.searchsorted(code[order], np.arange(count + 1, dtype=np.int64) << left)
    for s in np.flatnonzero(np.diff(edges)).tolist():
        if arrays := _file(folder, f"{kind}-{s}"):
            yield arrays, order[edges[s] : edges[s + 1]]


def _find(folder: str, kind: str, shard: np.ndarray, keys: np.ndarray, count: int, at: int, columns: list[int]) -> list[np.ndarray]:
    """Values of sorted distinct keys from the arrays of their shards; 0 where a key is missing."""
    out = [np.zeros(len(keys), np.int64) for _ in columns]
    for arrays, rows in _per_shard(folder, kind, shard, count):
        known = arrays[at].view(np.uint64)
        if len(known):
            place = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            hit = known[place] == keys[rows]
            for o, c in zip(out, columns):
                o[rows[hit]] = arrays[c][place[hit]]
    return out


OWNERS = KEY_ARRAYS + 5  # in a file of pairs, behind keys and counts


def _counts(folder: str, kind: str, shard: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    """Counts of pairs or triples; 0 where one is missing."""
    out = np.zeros(len(keys), np.int64)
    for arrays, rows in _per_shard(folder, kind, shard, count, keys):
        place = find_keys(arrays, keys[rows])
        hit = place >= 0
        out[rows[hit]] = unpack_ones(arrays[KEY_ARRAYS:], place[hit])
    return out


def _pair_counts(model: dict, before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    folder, bits = model["folder"], model["bits"]
    out, hot = np.zeros(len(keys), np.int64), np.isin(before, model["hot"])
    shard = _pair_shard(before, keys, model["hot"], bits)
    for own, kind in ((~hot, "pairs"), (hot, "hot-pairs")):
        out[own] = _counts(folder, kind, shard[own], keys[own], 1 << bits)
    return out


def _context_figures(model: dict, middle: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each known context was seen, and how many words came once, twice and more often in it."""
    folder, bits, hot = model["folder"], model["bits"], np.isin(middle, model["hot"])
    figures = np.zeros((4, len(owner)))
    figures[:2] = 1  # where it is not written, it was seen once
    shard = np.where(hot, _key_shard(owner, bits), _word_shard(middle, bits))
    for own, kind in ((np.flatnonzero(~hot), "contexts"), (np.flatnonzero(hot), "hot-contexts")):
        for arrays, rows in _per_shard(folder, kind, shard[own], 1 << bits, owner[own]):
            place = find_keys(arrays, owner[own[rows]])
            hit = place >= 0
            for k in range(4):
                at = KEY_ARRAYS + 3 * k
                figures[k, own[rows[hit]]] = unpack_counts(arrays[at : at + 3], place[hit])
    return figures


def _discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3)]


def _gram_scores(model: dict, outer: np.ndarray, before: np.ndarray, tokens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(discounted probability, weight of the pair level) of every token; ``known`` says whether its context is a known pair."""
    figures = _context_figures(model, before[known], pair_keys(outer[known], before[known]))
    total, gram = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
    weight = np.ones(len(tokens))
    total[known], weight[known] = figures[0], (np.array(model["higher"]) @ figures[1:]) / figures[0]
    key = gram_keys(outer[known], before[known], tokens[known])
    gram[known] = _counts(model["folder"], "grams", _gram_shard(before[known], key, model["hot"], model["parts"], model["bits"]), key, 1 << model["bits"])
    return (gram - _discount(gram, model["higher"])) / np.maximum(total, 1), weight


def score_tokens(model: dict, *words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of every token, from its history and the token; tokens in the order of their texts."""
    before, tokens = words[-2:]
    folder, bits, shards = model["folder"], model["bits"], 1 << model["bits"]
    word, word_of = np.unique(tokens, return_inverse=True)
    count, follows = _find(folder, "words", _word_shard(word, bits), word, shards, 0, [1, 2])
    low = (follows - _discount(follows, model["lower"])) / max(model["pairs"], 1) + model["left"] / (model["words"] + 1)
    owner, owner_of = np.unique(before, return_inverse=True)
    figures = np.stack(_find(folder, "pairs", _word_shard(owner, bits), owner, shards, OWNERS, [OWNERS + k for k in range(1, 5)])).astype(np.float64)
    hot = np.isin(owner, model["hot"])
    figures[:, hot] = model["hot_figures"][np.searchsorted(model["hot"], owner[hot])].T
    total = figures[0]
    weight = np.where(total > 0, (np.array(model["discounts"]) @ figures[1:]) / np.maximum(total, 1), 1.0)
    pair = _pair_counts(model, before, pair_keys(before, tokens))
    high = (pair - _discount(pair, model["discounts"])) / np.maximum(total, 1)[owner_of]
    found = high + weight[owner_of] * low[word_of]
    if model["order"] == 3:
        # A token's context is the pair that the token before ended; a known pair not at the end of a text goes on.
        known = np.concatenate([[False], pair[:-1] > 0])[: len(pair)] & (before != BEGIN)
        higher, left = _gram_scores(model, *words, known)
        found = higher + left * found
    return np.log10(found), count[word_of]


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score, perplexity) of every row; the last is 10 ** (-score / n_tokens)."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offsets in W.blocks(batches, "text", BLOCK):
            tokens, first = text_tokens(data, offsets)
            logs, counts = score_tokens(model, *histories(tokens, first, model["order"]), tokens)
            base = np.log10((counts + 0.5) / (model["tokens"] + 0.5 * (model["words"] + 1)))
            per_row = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every row has its end token
            yield pa.RecordBatch.from_arrays(
                [rows.column("key"), pa.array(np.diff(first)), pa.array(per_row((counts > 0).astype(np.int64))), pa.array(per_row(base)), pa.array(per_row(logs))], ["key", "n_tokens", "n_known", "base_score", "score"]
            )

    kind = source.schema["key"].dataType.simpleString()
    found = source.mapInArrow(run, f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("key", key)

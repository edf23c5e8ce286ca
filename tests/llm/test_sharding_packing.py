import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossmill.llm.packing import Bins, pack
from glossmill.llm.sharding import fill_table, place, write_shards

tokenizers = pytest.importorskip("public_tokenizers")
SHARDS = [f"s{k}" for k in range(7)]


def test_table_is_full_even_and_stable():
    table = fill_table(SHARDS, 1009)
    sizes = Counter(table)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = fill_table(SHARDS[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009


def test_shards_take_turns_by_preference():
    from glossmill.llm import sharding as S

    owner, slots = [None] * 13, 13
    orders = [[(S._number(n, b"start") + j * (S._number(n, b"stride") % (slots - 1) + 1)) % slots for j in range(slots)] for n in SHARDS]
    while None in owner:
        for k, order in enumerate(orders):
            free = next((s for s in order if owner[s] is None), None)
            if free is not None:
                owner[free] = k
    assert owner == fill_table(SHARDS, slots)


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        fill_table(shards, slots)


def test_place(spark, documents, empty, tmp_path):
    clash = documents.selectExpr("*", "'x' as Shard", "1 as `slot`")
    rows = place(clash.union(clash), ["doc_id", "source"], SHARDS, 101).collect()
    by_key = defaultdict(set)
    for r in rows:
        by_key[r.doc_id, r.source].add((r.slot, r.shard))
    table = fill_table(SHARDS, 101)
    assert len(rows) == 2 * documents.count() and all(len(v) == 1 for v in by_key.values())
    assert all(SHARDS[table[r.slot]] == r.shard for r in rows)
    assert place(empty, ["doc_id"], SHARDS, 101).count() == 0
    write_shards(documents, ["doc_id"], SHARDS, str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


def test_bins_follow_the_rule():
    rng = np.random.default_rng(1)
    bins, open_bins, content = Bins(100, 5), {}, defaultdict(int)
    for size in rng.integers(1, 101, 2000).tolist():
        number, offset = bins.place(size)
        fitting = [f for f in open_bins.values() if f >= size]
        if fitting:
            assert open_bins[number] == min(fitting)
        else:
            assert number not in open_bins
            if size < 100 and len(open_bins) == 5:
                full = min(open_bins.values())
                for key in list(open_bins):
                    if open_bins[key] == full and key not in {n for row in bins.by_free.values() for n in row}:
                        del open_bins[key]
            open_bins[number] = 100
        assert offset == content[number]
        content[number] += size
        open_bins[number] -= size
        if not open_bins[number]:
            del open_bins[number]
        assert bins.still_open() == set(open_bins) and len(open_bins) <= 5


def test_words_are_cut_where_letters_and_marks_meet():
    import random

    import public_tokenizers
    import pyarrow as pa

    from glossmill.llm import words as W
    from glossmill.llm.packing import WordIds

    chooser, path = random.Random(5), public_tokenizers.path("word_bpe_49k.json")
    signs = list("abzAZ09.,;%*'<|>-_(") + [" ", "\n", "'s", "'ll", "é", "×", "÷", "É", "ß", "中", "—", "\u0301", "\u0338", "\u00a0", "İ", "Σ", "😀", "<|endoftext|>"]
    for special in (False, True):
        texts = ["".join(chooser.choice(signs[: len(signs) - (not special)]) for _ in range(chooser.randint(0, 25))) for _ in range(3000)]
        texts = texts if special else [t.replace("<", "") for t in texts]
        encoder, batch = WordIds(path), pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
        found = []
        for _, data, offsets in W.blocks(iter([batch]), "text"):
            ids, at = encoder.encode(data, offsets)
            found += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = WordIds(path)
    batch = pa.RecordBatch.from_pydict({"text": ["word word%%% (Word) word; été, %%%", "%%%été x's"]})
    for _, data, offsets in W.blocks(iter([batch]), "text"):
        encoder.encode(data, offsets)
    assert len(encoder.index) == len({"word", "%%%", "(", ")", ";", "été", ",", "x's"})


def test_pack(spark, documents, corpus, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(900, "Hello.. a., b.c <|ENDOFTEXT|> X. É. 's I'M ... 5. A.,", "en", "s", 1), (901, "<|endoftext|>foo. Bar,", "en", "s", 1), (None, "Q", "en", "s", 1)]
    docs = documents.union(spark.createDataFrame(odd, documents.schema)).union(documents.where("doc_id = 5"))
    rows = pack(docs, path, length=256, open_bins=4, with_ids=True).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.1 * -(-total // 256) + 4
    for key, text, *_ in corpus + odd:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(got[key], key=lambda r: r.piece)[:: 2 if key == 5 else 1]
        assert [i for r in parts for i in r.ids] == ids
        assert [r.start for r in parts] == list(range(0, len(ids), 256))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in parts)
    assert len(got[5]) == 2 * -(-(len(tokenizer.encode(corpus[5][1], add_special_tokens=False).ids) + 1) // 256)
    assert pack(empty, path).count() == 0

"""Packing: bounds, gapless sequences, pieces against the library, small and large partitions."""

import itertools
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from spoorline.llm import packing as K


def fewest(lengths, size):
    """Smallest number of bins, by trying every split."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                rooms[j] -= lengths[i]
                go(i + 1, rooms)
                rooms[j] += lengths[i]
        go(i + 1, [*rooms, size - lengths[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_fewest_bins():
    rng = np.random.default_rng(4)
    for _ in range(150):
        lengths = rng.integers(1, 21, rng.integers(1, 8))
        least = fewest(sorted(lengths.tolist(), reverse=True), 20)
        bound = K.lower_bound(np.bincount(lengths, minlength=21), 20)
        bins, _, _, used, _ = K.pack_part(lengths, 20)
        assert bound <= least <= used
        assert (np.bincount(bins, weights=lengths) <= 20).all()
    assert K.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3  # more than the mean says


def pieces(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoder = K.tiktoken_ids(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return K.pack(df, encoder, **more).toPandas()


def test_sequences_and_pieces(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "<|endoftext|> a", *(" word" * int(n) for n in rng.integers(1, 400, 150)), "long " * 3000]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    counts = []
    for part_rows in (20, 10_000):
        out = pieces(spark, texts, part_rows=part_rows)
        for _, own in out.sort_values("offset").groupby("sequence_id"):
            assert own.length.sum() <= 1024
            assert own.offset.tolist() == [0, *itertools.accumulate(own.length)][:-1]
        for id_, own in out.sort_values("piece").groupby("doc_id"):
            ids = np.array([*tokenizer.encode(texts[id_] or "", add_special_tokens=False).ids, 2], "<u4")
            assert own.length.sum() == len(ids)
            assert own.start.tolist() == [0, *itertools.accumulate(own.length)][:-1]
            assert (own.length.iloc[1:] == 1024).all()
            for r in own.itertuples():
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert set(out.doc_id) == set(range(len(texts)))
        counts.append(out.sequence_id.nunique())
    assert counts[1] <= counts[0] <= counts[1] * 1.15


def test_empty_table(spark):
    encoder = K.tiktoken_ids(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert K.pack(empty, encoder).count() == 0


def test_query_has_the_ids_of_the_default_tokenizer(spark, tmp_path):
    from spoorline.llm.queries import op9_best_fit_packing

    rng = np.random.default_rng(6)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " b", "don't", "é", "12", "<|im_start|>"]
    texts = ["a b<|endoftext|>c", *("".join(rng.choice(bits, int(n))) for n in rng.integers(1, 12, 400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 275, 50256, 66]
    out = op9_best_fit_packing(spark, str(tmp_path)).toPandas()
    assert len(out) == len(texts)
    for r in out.itertuples():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))

"""Merge replay against the public library, and the way back."""

import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import tiktoken

from spoorline.llm.bpe import Encoder, encode, encode_digests

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does():
    random.seed(1)
    parts = ["a", "ab", "  ", "\n", "é", "漢字", "😀", "\x1c", "\x85", "​", "'s", "12", "ſ", "K", "　", "zz", "the",
             "ing", "!!", "\x00", "aaaaaaa", "xyxyxy"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(2000)]
    encoder, known = Encoder(PATH, P.PATTERN), library()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert array("I", ids).tolist() == known.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = encode_digests(df, PATH, P.PATTERN).collect()
    assert len(got) == 5
    known = library()
    for r in got:
        text = {1: "", 2: "", 3: "Hello  world", None: "x" * 50_000}[r.doc_id]
        ids = known.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {bytes(r.decoded) for r in encode(df, PATH, P.PATTERN).collect()} == {b"", b"Hello  world", b"x" * 50_000}
    assert encode(df.limit(0), PATH, P.PATTERN).count() == 0

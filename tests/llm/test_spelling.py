"""Spelling variants against a dictionary of deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spoorline.llm import spelling as S


def plain(data, minimum):
    counts = Counter()
    for i, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= minimum}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            gaps[k, cut].add(w)
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def rows(seed, letters, n=400):
    random.seed(seed)
    base = ["".join(random.choice(letters) for _ in range(random.randint(4, 9))) for _ in range(60)]

    def typo(w):
        k, c = random.randrange(len(w) + 1), random.choice(letters)
        return random.choice([w, w, w, w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w.upper()])

    out = [(i, random.choice([" ", "-", "ł", "1"]).join(typo(random.choice(base)) for _ in range(60))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (None, out[0][1]), (3, out[3][1]), (3, out[3][1]), (n + 2, "x" * 6000 + " ") , (n + 3, "x" * 6000), (n + 4, "x" * 6000), (n + 5, ("x" * 5999 + " ") * 3)]


def frame(spark, data):
    return spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id bigint, text string, n int")


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters", ["abc", "aeéÉst×÷", "abcdefghijklm"])
def test_equals_a_dictionary_of_deletions(spark, letters):
    data = rows(len(letters), letters)
    got = result(S.group_variants(frame(spark, data)))
    want = plain(data, S.MIN_COUNT)
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 10


def test_large_blocks_are_cut_into_tiles(spark, monkeypatch):
    data = rows(9, "ab")
    want = plain(data, S.MIN_COUNT)
    monkeypatch.setattr(S, "TILE", 5)
    monkeypatch.setattr(S, "JOINT", 4)
    monkeypatch.setattr(S, "COMPARE", 64)
    assert result(S.group_variants(frame(spark, data))) == want


def test_words_in_parts_and_no_rows(spark, monkeypatch):
    data = rows(4, "abcd", 20)
    want = [sorted(w for part in S.runs_of(t or "") for w in part) for _, t in data]
    monkeypatch.setattr(S, "PART", 7)
    assert [sorted(w for part in S.runs_of(t or "") for w in part) for _, t in data] == want
    assert S.group_variants(frame(spark, data).limit(0)).count() == 0


def test_one_edit_of_random_words():
    random.seed(5)
    for _ in range(300):
        a = bytes(random.choice(b"ab") for _ in range(random.randint(5, 7)))
        b = bytes(random.choice(b"ab") for _ in range(len(a) + random.randint(0, 1)))
        edits = {a[:k] + bytes([c]) + a[k + x :] for k in range(len(a) + 1) for c in b"ab" for x in (0, 1)} - {a}
        (x, nx), (y, ny) = S._padded([a]), S._padded([b])
        assert S.one_edit(x, nx, y, ny)[0][0] == (b in edits)
    assert np.array_equal(S._counts(*S._padded([b"ab\xe9ba"]))[0].nonzero()[0], [0, 1, S._COLUMN[0xE9]])

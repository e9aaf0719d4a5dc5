"""The filter audit against a step-by-step count."""

import random
from collections import Counter, defaultdict
from itertools import permutations

from spoorline.llm import filter_audit as A

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def rows(seed, n=250):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "X", "it's", "a#b", "n|m", "é f", " "]
    out = []
    for i in range(n):
        size = random.choice([0, 3, 50, 199, 200, 201, 400])
        pool = random.sample(vocabulary, random.choice([5, 90, 300]))
        text = random.choice(SPACE).join(random.choice(pool) for _ in range(size))
        out.append((i, text, random.choice(["en", "de", None, ""])))
    out += [(1000 + i, random.choice(out)[1], "fr") for i in range(60)]  # copies
    out += [(2000, None, "en"), (None, out[0][1], "en"), (7, out[7][1], "de"), (7, "other", "de")]
    return out


def plain(data, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = defaultdict(Counter)
    for i, t, lang in data:
        t = t or ""
        ws = words(t)
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and t in first and i > first[t],
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[lang or "", order, step]
                c["kept"] += not gone and not fails[f]
                c["removed"] += not gone and fails[f]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += not gone and fails[f] and i in good
                c["toxic_lost"] += not gone and fails[f] and i in toxic
                gone = gone or fails[f]
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {k: (*[c[f] for f in A.FIELDS], shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_equals_a_step_by_step_count(spark):
    data = rows(3)
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(300)]
    labels += [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, x, 5) for i, t, x in data], "doc_id bigint, text string, lang string, part int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = A.audit(docs, marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(data, labels)
    assert len(got) == 600 * 4  # en, de, fr and none
    assert A.audit(docs.limit(0), marks).count() == 0
    assert {r.good_lost for r in A.audit(docs, marks.limit(0)).collect()} == {0}


def test_long_texts_are_read_whole(monkeypatch):
    text = ("a b c " * 50 + "D e").encode()
    short = A.text_fails(text, len(text))
    monkeypatch.setattr(A, "LONG_BYTES", 10)
    assert A.text_fails(text, len(text)) == short


def test_fields_do_not_overflow():
    many = (1 << 62) + 1
    table = A.unpack(many * A.packed(0) + many * A.packed(A.GOOD | 1))
    removed = table[..., A.FIELDS.index("removed")]
    assert set(removed.ravel()) == {0, many}
    assert (table[..., A.FIELDS.index("toxic_lost")] == 0).all()

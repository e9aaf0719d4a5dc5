"""Chat formatting: the grammar's round trip, and digests against a plain computation."""

import hashlib
import random

import pytest

from spoorline.llm import chat as C

PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", C.JOINER, "[", "<", "/s>",
         "INST] ", " ", "\n", "a", "<" + C.JOINER + "s>", "[" + C.JOINER * 2 + "/INST]"]


def test_round_trip_of_random_turns():
    random.seed(3)
    for _ in range(5000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 8)))
        role = random.choice(["user", "assistant", "system", "tool", "", "a b", "x>>", "é\n", "[INST]"])
        out = C.render_turn(role, text)
        assert C.parse_turn(out)[:2] == (role, text)
        assert C.parse_turn(out)[4] == len(out)
        # a whole conversation parses turn by turn
        assert C.parse_turn(out + out, len(out))[:2] == (role, text)


def test_texts_without_conflict_stay_as_they_are():
    assert C.render_turn("user", "Hi [there] <b>") == "[INST] Hi [there] <b> [/INST]\n"


def test_digests(spark):
    rows = [(1, 1, "assistant", "a </s> b"), (1, 0, "user", None), (1, 1, "assistant", "a </s> b"), (1, 2, None, "x"),
            (2, 0, "system", "é"), (2, None, "assistant", ""), (None, 0, "assistant", "n"), (3, 0, "user", "u" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in C.read_back(C.format_turns(C.with_conflict(df))).collect()}
    want: dict = {}
    extra = [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    for c, t, r, x in sorted([*rows, *extra], key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(C.render_turn(*t)) for t in turns)
    assert C.format_turns(df.limit(0)).count() == 0


def test_stored_turns_come_in_any_order(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = C.format_turns(df)
    want = sorted(map(tuple, C.read_back(out, in_order=True).collect()))
    out.repartition(7, "seq").write.parquet(f"{tmp_path}/turns")
    stored = spark.read.parquet(f"{tmp_path}/turns")
    assert sorted(map(tuple, C.read_back(stored).collect())) == want and len(want) == 5
    with pytest.raises(Exception, match="follow each other"):
        C.read_back(stored.where("seq <> 3")).collect()

"""Line dedup against a plain computation."""

import random
import re
import time
import zlib

from spoorline.llm import line_dedup as D

ENDS = re.compile(r"(?<=\n)|(?<=[.!?] )")


def brute(rows, min_words=D.MIN_WORDS):
    """What is left of each text without the runs of enough words that stood as a whole at an earlier place."""
    parsed, first = [], {}
    for i, text in rows:
        raw = ENDS.split(text) if text is not None else []
        full = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate(raw)]
        lines = [(n, t, len(re.split(r"[\x20\x09-\x0D]+", t))) for n, t in full if t]
        # null ids come first, in the order of their texts' sums
        id_ = (0, zlib.crc32((text or "").encode())) if i is None else (1, i)
        runs = []
        for a in range(len(lines)):
            words, run = 0, []
            for n, t, w in lines[a:]:
                words, run = words + w, [*run, t]
                if words >= min_words:
                    runs.append((tuple(run), (id_, lines[a][0]), n))
        for run, place, _ in runs:
            first[run] = min(first.get(run, place), place)
        parsed.append((raw, runs))
    out = []
    for raw, runs in parsed:
        gone = set()
        for run, place, last in runs:
            if first[run] < place:
                gone.update(range(place[1], last + 1))
        out.append("".join(x for n, x in enumerate(raw) if n not in gone) if raw else None)
    return out


def fixture(seed):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(60)]
    shared = [" ".join(random.choice(vocab) for _ in range(random.choice([1, 2, 6, 14, 30]))) + "." for _ in range(25)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(random.randint(0, 9)):
            if random.random() < 0.5:
                at = random.randrange(len(shared))
                parts += shared[at : at + random.randint(1, 4)]
            else:
                parts.append(" ".join(random.choice(vocab) for _ in range(random.randint(1, 12))) + random.choice([".", "", "!"]))
        rows.append((i, "".join(p + random.choice([" ", "\n", "\n\n"]) for p in parts)))
    passage = " ".join(random.choice(vocab) for _ in range(55))
    rows += [(500, passage), (501, "before. " + passage), (502, passage + "\nafter"), (503, None), (504, ""), (505, " \n "), (None, passage)]
    return [*rows, (506, "one line. " * 40), (507, "Is it? " * 2)]


def test_equals_the_plain_computation(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id bigint, text string, _kept int, line string")
        got = {r.doc_id: r._kept for r in D.dedup_lines(df).select("_doc.doc_id", D.F.col("_kept")).collect()}
        want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
        assert got == want
        assert want[501] == "before. " and want[502] == "after"  # the earliest, of a null id, stays


def test_texts_without_ids_have_places_of_their_own(spark):
    line = "w " * 30
    rows = [(None, f"{line}\nfirst"), (None, f"{line}\nsecond"), (1, line)]
    df = spark.createDataFrame(rows, "doc_id bigint, `text` string")
    got = sorted(r._kept for r in D.dedup_lines(df).select("_kept").collect())
    assert got == sorted(brute(rows)) and sum(line in t for t in got) == 1


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a b", 3)], "doc_id bigint, text string, `a.b` int")
    assert D.dedup_lines(df).select("_doc.*").columns == df.columns


def test_repeated_rows_keep_the_same_lines_and_empty_tables(spark):
    long = "w " * 30
    df = spark.createDataFrame([(1, long), (1, long), (2, long)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r._kept) for r in D.dedup_lines(df).select("_doc.doc_id", D.F.col("_kept")).collect())
    assert got == [(1, long), (1, long), (2, "")]
    assert D.dedup_lines(df.limit(0)).count() == 0


def test_only_runs_that_occurred_as_a_whole_go(spark):
    x1, x2, x3, x4 = (" ".join(f"{c}{i}" for i in range(9)) + ". " for c in "abcd")
    rows = [(1, x1 + x2), (2, x2 + x3), (3, x1 + x2 + x3)]  # 27 words, but never before
    rows += [(4, x1 + x2 + x3), (5, "new. " + x1 + x2 + x3 + x4)]  # before in 3, behind other first places
    random.seed(8)
    vocab = [f"w{i}" for i in range(9)]
    short = [" ".join(random.choice(vocab) for _ in range(n)) + ". " for n in (1, 2, 5, 8, 9, 24, 26)]
    rows += [(10 + i, "".join(random.choice(short) + random.choice(["", "\n"]) for _ in range(random.randint(1, 12)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r._kept for r in D.dedup_lines(df).select("_doc.doc_id", D.F.col("_kept")).collect()}
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    assert want[3] == rows[2][1] and want[4] == "" and want[5] == "new. " + x4
    assert got == want


def test_one_long_chain_costs_no_more_than_many_short_ones(spark):
    pair = "struct(i AS line, i + 1 AS next_line, 9L * i + 9 AS upto, 9 AS w, 9 AS next_w, xxhash64(i) AS key, hash(i) AS check)"

    def seconds(chains, lines):
        one = spark.range(chains, numPartitions=1).selectExpr(f"transform(sequence(0, {lines - 2}), i -> {pair}) AS pairs")
        runs = one.select(D.F.inline(D.shortest_runs(D.F.col("pairs"), 25)))
        assert runs.count() == chains * (lines - 2)  # three lines each; both ways find the same ones
        began = time.time()
        runs.write.format("noop").mode("overwrite").save()
        return time.time() - began

    many, one = seconds(60, 200), seconds(1, 12_000)
    assert one < 4 * many + 1

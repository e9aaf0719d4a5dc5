"""N-gram Jaccard join: near duplicates by exact overlap of word shingles.

Documents and shingles form a sparse incidence matrix; the overlaps of documents are the product
of the matrix with its transpose. It is computed in blocks, and only where a pair can reach
the threshold t: sizes must be within t of each other, and in any order of shingles common to all
documents, two documents that link share many of their first ones. Here that is the first 35
percent (for t = 0.75), of which a document must share a tenth of its size with another. The
order puts frequent shingles last, so that passages of many documents hardly make candidates; it
only affects speed.

1. Documents with equal sets become one node.
2. Nodes and their prefix shingles are sorted by shingle in blocks of the matrix. Overlap counts
   are accumulated per node first: a node that shares fewer prefix shingles with others than its
   size asks for is discarded, and groups of one are, in turn. In each group left, every node is
   paired with the smallest. Per node, the partner that shares most is decided on the whole
   texts; the other pairs only count where they join different components, and only if the
   overlap of their prefixes leaves room for the threshold.
3. Groups that still hold several components are multiplied out between components, in blocks of
   nodes, with the same bound on the accumulated counts. Pairs within a component need no count.

So copies are never expanded into all pairs, and no link between components is lost. Keys of groups
are cut to 48 bits: that can only add candidates, which are decided like all others.

Texts are lower-cased in A-Z only. A text with fewer words than a shingle has one shingle; one
without words has none and links with nothing, null texts likewise. Repeated rows get equal
results, rows of equal id and different text are nodes of their own. Null ids are ignored when
the smallest id of a component is taken. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import map_rows, sized_broadcast
from spoorline.llm.components import components
from spoorline.session import materialize

WORDS = 5
#: Percent of the union that two sets must share.
PERCENT = 75
#: Percent of a set, after its prefix, that two sets may still share.
AFTER = 65
#: Rounds in which nodes with too few shared shingles are discarded.
ROUNDS = 3
#: Most frequent shingles that go last in the order of shingles.
FREQUENT = 65_536
KEEP_WORDS = 250_000
#: Nodes of a block of the residual product; a task holds two blocks at most.
BLOCK_NODES = 3072
#: Parts of the group of a frequent shingle; bits of a shingle's hash that make its group's key.
SALTS = 16
KEY_BITS = np.uint64((1 << 48) - 1)

words_of = re.compile(rb"[^\x20\x09-\x0D]+").findall
#: Odd multipliers for the words of a shingle by place, without a pattern among them.
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(64)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        found = words_of((text or "").encode().lower())
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEEP_WORDS:
            self.known = _Hashes()
        h = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out += h[j : len(h) - k + 1 + j] * _FACTORS[j]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for the set."""
    both = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def frequent(docs: DataFrame, words: int, text: str = "text") -> np.ndarray:
    """The shingles found in the most documents, by counts summed over blocks of documents.

    A block leaves out what it holds once; that can only change the order of shingles.
    """

    def make():
        shingle = Shingler(words)

        def work(rows):
            sets = [shingle(t) for (t,) in rows]
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            twice = n > 1
            return {"shingle": found[twice].view(np.int64), "n": n[twice]}

        return work

    counts = map_rows(docs, make, "shingle bigint, n bigint", [text], rows=8192)
    top = (
        counts.groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where("n >= 8")
        .orderBy(F.desc("n"), "shingle")
        .limit(FREQUENT)
        .select("shingle")
        .toPandas()["shingle"]
    )
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def prefix_size(n: int, percent: int) -> int:
    """Shingles in a prefix: what ``AFTER`` leaves, at least what the threshold asks for."""
    return max(n - n * AFTER // 100, n - (percent * n + 99) // 100 + 1) if n else 0


def incidence(docs: DataFrame, last: np.ndarray, words: int, percent: int, key: str) -> DataFrame:
    """Per document: key, _sum, set size, set signature and the prefix of its shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def make():
        shingle, hot = Shingler(words), shared.value

        def work(rows):
            out = {key: [], "_sum": [], "n": [], "sig1": [], "sig2": [], "prefix": [], "hot": []}
            for id_, body, number in rows:
                s = shingle(body)
                size = prefix_size(len(s), percent)
                cold = s
                if len(hot) and len(s):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    cold = s[~is_hot]
                    s_ordered = np.concatenate([cold[:size], s[is_hot]])[:size]
                else:
                    s_ordered = s[:size]
                keys = (s_ordered & KEY_BITS).view(np.int64)
                values = (id_, number, len(s), *signature(s), keys, max(0, size - len(cold)))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            return out

        return work

    schema = f"{key} bigint, _sum bigint, n bigint, sig1 bigint, sig2 bigint, prefix array<bigint>, hot int"
    return map_rows(docs, make, schema, [key, "text", "_sum"])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, salt), shingle and node of those in groups of several rows.

    The parts of a split group (their salt is not negative) stay whole, even of one row.
    """
    group, held = None, None  # the last row's group, and that row if it is not written yet
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, salt, node = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(node), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
        new[0] = group != (shingle[0], salt[0])
        # the first row of a group is written once its second one is seen
        out = ~new | np.append(new[:-1] & ~new[1:], False) | (salt >= 0)
        columns = [shingle[out], node[out]]
        if held is not None and not new[0]:
            columns = [np.append(v, c) for v, c in zip(held, columns, strict=True)]
        group = (shingle[-1], salt[-1])
        held = None if out[-1] else (shingle[-1], node[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "node"])


def _may_link(n1, n2, percent: int):
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def _needed(n1, n2, percent: int):
    """Overlap that the threshold asks for: the least o with 100 o >= percent (n1 + n2 - o)."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent) - 1e-9)


def block_product(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of nodes of one block or of two whose shared shingles leave room for a link.

    ``rows`` is a block of the incidence matrix (shingle, node, n, root, block, i, j). Its
    product with its transpose counts shared shingles; pairs of one component are left out.
    """
    nodes = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
    at = np.searchsorted(nodes["node"].to_numpy(), rows["node"].to_numpy())
    order = np.argsort(rows["shingle"].to_numpy(), kind="stable")
    ends = np.flatnonzero(np.diff(rows["shingle"].to_numpy()[order])) + 1
    counts = np.zeros((len(nodes), len(nodes)), np.int32)
    for group in np.split(at[order], ends):
        if len(group) > 1:
            group = np.unique(group)
            counts[np.ix_(group, group)] += 1
    n, root, block, found = (nodes[c].to_numpy() for c in ("n", "root", "block", "node"))
    apart = rows["i"].iloc[0] != rows["j"].iloc[0]  # pairs within a block have a task of their own
    out = []
    for start in range(0, len(nodes), 256):
        a, b = np.nonzero(counts[start : start + 256])
        shares, a = counts[start : start + 256][a, b], a + start
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        needed = np.ceil((low + high) * percent / (100 + percent) - 1e-9)
        fits = (a < b) & (root[a] != root[b]) & (100 * low >= percent * high)
        fits &= shares + high * AFTER // 100 >= needed
        if apart:
            fits &= block[a] != block[b]
        out.append(pd.DataFrame({"a": found[a[fits]], "b": found[b[fits]]}))
    return pd.concat(out)


def _after(n):
    """Shingles behind the prefix, at most."""
    return F.floor(n * AFTER / 100)


class JaccardJoin:
    """Near duplicates of a table; ``links``, ``roots`` and `members` are the whole result."""

    def __init__(
        self,
        docs: DataFrame,
        words: int = WORDS,
        percent: int = PERCENT,
        key: str = "doc_id",
        text: str = "text",
    ):
        texts = docs.select(key, F.col(text).alias("text"))
        self.docs, self.key = texts.withColumn("_sum", F.xxhash64("text")), key
        self.words, self.percent = words, percent
        last = frequent(self.docs, words, "text")
        rows = incidence(self.docs, last, words, percent, key)
        self.rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "incidence")
        # a class is the node of its first row
        classes = (
            self.rows.where("n > 0")
            .groupBy("sig1", "sig2", "n")
            .agg(F.min("row").alias("node"), F.min(key).alias("rep"))
        )
        self.classes = materialize(classes, "classes")
        self.links, self.roots = self._join()

    def _join(self) -> tuple[DataFrame, DataFrame]:
        shared = self._pruned(materialize(self._groups(), "shared"))
        hubs = shared.groupBy("shingle").agg(F.min("node").alias("a"))
        found = shared.join(materialize(hubs, "hubs"), "shingle").where("node <> a")
        pairs = found.groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("seen"))
        info = shared.select("node", "n", "s").distinct()
        info = materialize(info, "info")
        left = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("s_a"))
        right = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("s_b"))
        possible = self._possible(F.col("na"), F.col("nb"), F.least("s_a", "s_b"))
        pairs = pairs.join(left, "a").join(right, "b").where(possible).select("a", "b", "seen")
        pairs = materialize(pairs, "pairs")
        # the partner that shares most decides most nodes; others are left where they still matter
        first = pairs.groupBy("b").agg(F.max_by("a", F.col("seen") * 2 - F.col("a") / F.lit(2.0**63)).alias("a"))
        first = materialize(first.select("a", "b"), "first")
        links = self._verified(first)
        roots = components(links)
        rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
        more = self._verified(self._bounded(self._across(rest, roots)))
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = components(links)
        last = self._verified(self._residual(shared, pairs, roots))
        if last.limit(1).count():
            links = links.unionByName(last)
            roots = components(links)
        return links, roots

    def _possible(self, na, nb, overlap):
        """Whether sizes and at most so many shared prefix shingles leave room for a link."""
        most = overlap + F.greatest(_after(na), _after(nb))
        return _may_link(na, nb, self.percent) & (most >= _needed(na, nb, self.percent))

    def _pruned(self, shared: DataFrame) -> DataFrame:
        """shingle, node, n, s: groups without nodes that share too little to link with any other.

        s counts the node's shingles that others have. A partner is at least t times and at most
        1 / t times as large; what it asks for is least at one of the ends.
        """
        sizes = self.classes.select("node", "n")
        rows = shared.select("shingle", "node")
        t = self.percent / 100
        for number in range(ROUNDS):
            n = F.col("n").cast("double")
            asked = [(n + m) * t / (1 + t) - F.greatest(n, m) * AFTER / 100 for m in (n * t, n / t)]
            counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("s")).join(sizes, "node")
            enough = materialize(counts.where(F.col("s") >= F.ceil(F.least(*asked) - 1e-6)), "enough")
            groups = rows.join(enough.select("node"), "node").groupBy("shingle").agg(
                F.min("node").alias("lo"), F.max("node").alias("hi")
            )
            several = materialize(groups.where("lo < hi").select("shingle"), "several")
            rows = rows.join(enough, "node").join(several, "shingle")
            rows = materialize(rows, "pruned")
            if number + 1 < ROUNDS:
                rows = rows.select("shingle", "node")
        return rows

    def _nodes(self) -> DataFrame:
        """The first row of each class."""
        firsts = sized_broadcast(self.classes.select("node"))
        return self.rows.join(firsts, self.rows["row"] == firsts["node"]).drop("row")

    def _groups(self) -> DataFrame:
        """shingle, node: the prefix shingles that several nodes have, frequent ones in any case."""
        at = F.posexplode("prefix").alias("at", "shingle")
        entries = self._nodes().select("node", "hot", F.size("prefix").alias("size"), at)
        is_hot = F.col("at") >= F.col("size") - F.col("hot")
        salt = F.when(is_hot, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(-1).cast("bigint")
        dealt = entries.select("shingle", salt.alias("salt"), "node").repartition("shingle", "salt")
        in_order = dealt.sortWithinPartitions("shingle", "salt")
        return in_order.mapInArrow(_several, "shingle bigint, node bigint")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and prefix overlap leave room for the needed overlap."""
        pairs = materialize(pairs, "pairs")
        wanted = sized_broadcast(_ends(pairs))
        rows = self.rows.join(wanted, self.rows["row"] == wanted["node"]).select("node", "n", "prefix")
        rows = materialize(rows, "prefixes")
        left = rows.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
        right = rows.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        both = pairs.join(right, "b").join(left, "a")
        na, nb = F.col("na"), F.col("nb")
        shares = F.size(F.array_intersect("pa", "pb"))
        return both.where(self._possible(na, nb, shares)).select("a", "b")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold on whole texts, with their overlap."""
        pairs = materialize(pairs.select("a", "b"), "candidates")
        wanted = sized_broadcast(_ends(pairs))
        chosen = self.rows.join(wanted, self.rows["row"] == wanted["node"])
        chosen = chosen.select("node", F.col(self.key).alias("_id"), F.col("_sum").alias("_of"))
        chosen = sized_broadcast(materialize(chosen, "chosen"))
        same = self.docs[self.key].eqNullSafe(chosen["_id"]) & (self.docs["_sum"] == chosen["_of"])
        texts = materialize(self.docs.join(chosen, same).select("node", "text"), "texts")
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(right, "b").join(left, "a")
        words, percent = self.words, self.percent

        def make():
            shingle, held = Shingler(words), {}

            def work(rows):
                out = {"a": [], "b": [], "overlap": []}
                for a, b, ta, tb in rows:
                    if a not in held:  # rows of one node lie together
                        held.clear()
                        held[a] = shingle(ta)
                    sa, sb = held[a], shingle(tb)
                    overlap = len(np.intersect1d(sa, sb, assume_unique=True))
                    if 100 * overlap >= percent * (len(sa) + len(sb) - overlap):
                        for name, value in zip(out, (a, b, overlap), strict=True):
                            out[name].append(value)
                return out

            return work

        links = map_rows(both, make, "a bigint, b bigint, overlap bigint", ["a", "b", "ta", "tb"])
        return materialize(links, "links")

    @staticmethod
    def _with_root(df: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
        known = roots.select(F.col("node").alias(column), F.col("root").alias(name))
        return df.join(known, column, "left").withColumn(name, F.coalesce(name, column))

    def _across(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs between different components."""
        marked = self._with_root(self._with_root(pairs, "a", roots, "_ra"), "b", roots, "_rb")
        return marked.where(F.col("_ra") != F.col("_rb")).select("a", "b")

    def _residual(self, shared: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs not decided yet, between components, with enough shared prefix shingles.

        Counted by blocks of the matrix times their transposes; only pairs that pass are written.

        A group that both are in holds two components, so no common shingle is left out and
        the counts are complete.
        """
        rooted = self._with_root(shared.select("shingle", "node", "n", "s"), "node", roots, "root")
        mixed = (
            rooted.groupBy("shingle")
            .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"))
            .where("lo <> hi AND members > 2")  # the pair of a group of two is decided
            .select("shingle")
        )
        kept = materialize(rooted.join(materialize(mixed, "mixed"), "shingle"), "kept")
        # nodes that groups connect are a family; its product is computed block by block
        least = materialize(kept.groupBy("shingle").agg(F.min("node").alias("a")), "least")
        tied = kept.join(least, "shingle").select("a", F.col("node").alias("b")).distinct()
        family = components(tied).withColumnRenamed("root", "family")
        sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("blocks"))
        placed = kept.join(family.join(sizes, "family"), "node").withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks"))
        )
        columns = ["shingle", "node", "n", "root", "family", "block"]
        whole = placed.where("blocks = 1").select(*columns, F.col("block").alias("i"), F.col("block").alias("j"))
        other = F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")
        cut = placed.where("blocks > 1").select("*", other)
        cut = cut.select(*columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        percent = self.percent

        def product(pdf: pd.DataFrame) -> pd.DataFrame:
            return block_product(pdf, percent)

        dealt = whole.unionByName(cut).groupBy("family", "i", "j")
        enough = dealt.applyInPandas(product, "a bigint, b bigint").distinct()
        return enough.join(pairs.select("a", "b"), ["a", "b"], "left_anti")

    def members(self) -> DataFrame:
        """Per row of the table: key, n_shingles, component_id."""
        named = self._with_root(self.classes, "node", self.roots, "root")
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        placed = named.join(least, "root").select("sig1", "sig2", F.col("n").alias("_n"), "component_id")
        rows = self.rows.select(self.key, "n", "sig1", "sig2")
        same = (rows.sig1 == placed.sig1) & (rows.sig2 == placed.sig2) & (rows.n == placed["_n"])
        return rows.join(placed, same, "left").select(
            self.key,
            F.col("n").alias("n_shingles"),
            F.coalesce("component_id", self.key).alias("component_id"),
        )


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs."""
    sides = [pairs.select(F.col(side).alias("node")) for side in ("a", "b")]
    return sides[0].unionByName(sides[1]).distinct()


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    return JaccardJoin(docs, **parameters).members()

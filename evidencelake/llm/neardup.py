"""Near-duplicate groups by SimHash: Golay keys join close fingerprints, and an exact prefix filter joins what is left.

Documents are linked if the SimHash operator links their fingerprints (two bits or fewer), or if they are alike in
``SIMILAR`` of their five-word shingles or more; linked documents make groups. Texts with the same words in the same order
are one node from the start. The links of the operator come first and need no test; what they have joined isn't
compared again. They may hold where shingles don't (edits all over a text spare less than 0.8), and
fingerprints of texts alike in 0.8 may differ in more bits than Golay keys can bridge, so then
each node posts the first shingles of its set in
an order that all sets share: of n shingles, the first n - ceil(0.8 n) + 1, so that two sets alike in 0.8 post one in
common at least (with fewer common shingles than that left over, they couldn't reach 0.8). The order puts shingles
that are frequent in a bounded sample last; any order finds all links, this one has fewer nodes meet. Nodes that meet
under a shingle, with sizes that allow 0.8 and enough shingles left in the order, are candidates; each candidate in two
groups whose sketches allow it is verified by the Jaccard similarity of the whole sets.

Where over ``CROWD`` nodes meet under one shingle, the first rounds propose links to ``HUBS`` of them only, and the
last proposes every pair that verified links have not joined by then: no pair is left out, but those inside a
group need no test. A shingle that a third of all texts hold goes to many tasks: its postings are salted by what a
sample says of it, and its crowd meets in blocks of about ``BLOCK`` rows, every block with every other.

Null texts are empty; a text without words is only like its equals. Rows that repeat are one node; of a group the row
with the least key stays (the least doc_id, then text), null ids first. A very long text is one row in each step, its
shingles eight bytes each. An empty table gives no row; extra columns are not read here, and pass as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import simhash
from evidencelake.llm.common import arrow_limits, cut, map_rows
from evidencelake.llm.components import components
from evidencelake.llm.suffix import keyed

SHINGLE, SIMILAR, CROWD, HUBS = 5, 0.8, 16, 2
#: Rows under one shingle that a task meets at a time; what is over goes in blocks, each with each.
BLOCK = 16_384
#: Bytes of a sketch that travel with a posting of a crowd.
FOLDED = 128
#: For the order of shingles: documents looked at, uses from which a shingle counts as frequent, and how many are kept.
SAMPLE, FREQUENT, KEPT = 8_000, 3, 32_768
CHUNK = 50_000
SLACK = 1e-9


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, of the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))), np.uint64))


def digest(text: str) -> int:
    """XXH3 of the text's words in their order, or of the text itself where it has none, as a signed long."""
    raw = text.encode()
    words = raw.lower().split()
    found = xxhash.xxh3_64_intdigest(b"w" + b" ".join(words) if words else b"t" + raw)
    return found - (1 << 64) if found >> 63 else found


def sketch(grams: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each bit. Sketches differ in as many bits as the sets do in shingles, at most."""
    bits = 1 << max(6, (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer one is folded to the shorter one's length."""
    n = min(len(x), len(y))
    folded = [np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, n), axis=0) for z in (x, y)]
    return int(np.bitwise_count(folded[0] ^ folded[1]).sum())


def folded(x: bytes, size: int = FOLDED) -> bytes:
    """A sketch at ``size`` bytes: longer ones folded, shorter ones as they are, with zeros after."""
    if len(x) > size:
        return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0).tobytes()
    return x.ljust(size, b"\0")


def close(size: np.ndarray, length: np.ndarray, sketches: np.ndarray, j: np.ndarray, i: int, similar: float = SIMILAR) -> np.ndarray:
    """Those of the rows ``j`` whose folded sketches allow that they are alike to row ``i``."""
    most = (1 - similar) / (1 + similar) * (size[j] + size[i]) + SLACK
    out = np.ones(len(j), bool)
    for n in np.unique(length[j]).tolist():  # both at the length of the shorter sketch
        of, short = np.flatnonzero(length[j] == n), min(n, int(length[i]))
        mine = np.bitwise_xor.reduce(sketches[i].reshape(-1, short)[: length[i] // short], axis=0)
        theirs = np.bitwise_xor.reduce(sketches[j[of]].reshape(len(of), -1, short)[:, : n // short], axis=1)
        out[of] = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64) <= most[of]
    return j[out]


def marks(docs: DataFrame) -> DataFrame:
    """(key, node, size, sketch, fp): the digest, the number of shingles, their sketch, and the SimHash operator's fingerprint."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            grams = shingles(r["text"])
            fp = simhash.majority(simhash.hashes(r["text"]))
            yield (r["key"], digest(r["text"]), len(grams), sketch(grams), fp - (1 << 64) if fp >> 63 else fp)

    return map_rows(docs.select("key", "text"), "key long, node long, size int, sketch binary, fp long", rows)


def frequent(docs: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of at most ``SAMPLE`` nodes, sorted, and how many of these have each."""
    ids = nodes.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], ["gram"])

    arrow_limits(docs.sparkSession)
    counted = docs.join(F.broadcast(ids), "key").select("text").mapInArrow(every, "gram long").groupBy("gram").count()
    top = counted.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "gram").limit(KEPT).collect()
    grams, uses = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(grams)
    return grams[order], uses[order]


def prefix(grams: np.ndarray, often: np.ndarray, uses: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The first of the sorted ``grams`` in the common order, rare ones before frequent ones: as many as a link needs."""
    take = len(grams) - math.ceil(similar * len(grams) - SLACK) + 1
    if len(often):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        weight = np.where(often[at] == grams, uses[at], 0)
        if weight.any():
            return grams[np.lexsort((grams, weight))[:take]]
    return grams[:take]


def salted(grams: np.ndarray, node: int, often: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, where they are not the grams): frequent grams are dealt to ``ways`` keys each, by the node."""
    keys, split = grams.copy(), np.zeros(len(grams), bool)
    if len(often):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        split = (often[at] == grams) & (ways[at] > 1)
        salt = np.uint64(node & ((1 << 64) - 1)) % ways[at[split]].astype(np.uint64) + np.uint64(1)
        keys[split] = (grams[split] ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return keys, split


def posted(docs: DataFrame, often: np.ndarray, uses: np.ndarray, nodes: int) -> DataFrame:
    """(key, node, size, rest, gram): a posting for each prefix shingle; ``rest`` counts it and the shingles after it.

    The key is the shingle, and ``gram`` null; or one of several keys that a frequent shingle, ``gram``, is dealt to.
    Texts are not shuffled: copies in other tasks post the same rows, which ``meetings`` drops."""
    arrow_limits(docs.sparkSession)
    ways = np.ceil(uses * (nodes / max(1, min(nodes, SAMPLE))) / BLOCK).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for text in batch.column(0):
                if (node := digest(text.as_py())) in seen:
                    continue
                seen.add(node)
                if size := len(grams := shingles(text.as_py())):
                    first = prefix(grams, often, uses)
                    rest = size - np.arange(len(first))
                    keys, split = salted(first, node, often, ways)
                    columns = (keys.view(np.int64), np.full(len(first), node), np.full(len(first), size), rest)
                    made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*made, pa.array(first.view(np.int64), pa.int64(), mask=~split)], ["key", "node", "size", "rest", "gram"])

    return docs.select("text").mapInArrow(spread, "key long, node long, size int, rest int, gram long")


def possible(size: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """Whether rows i and j, whose first common shingle this may be, can be alike by their sizes and what is left."""
    a, b = size[i], size[j]
    enough = np.minimum(rest[i], rest[j]) >= similar / (1 + similar) * (a + b) - SLACK
    return enough & (np.minimum(a, b) >= similar * np.maximum(a, b) - SLACK)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, in chunks that hold all rows of a value; null numbers are 0."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([(c.fill_null(0) if c.null_count else c).to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= CHUNK:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.flatnonzero(rows[0] == rows[0][-1])[0])
            held = [[c[end:] for c in rows]]
            if end:
                yield [c[:end] for c in rows]
    if held and sum(len(x[0]) for x in held):
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def bounds(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    return starts, np.diff(np.append(starts, len(gram)))


def hubs(node: np.ndarray, of: np.ndarray, turn: int) -> np.ndarray:
    """``HUBS`` of the rows ``of``: the first by a hash of the node, so mostly the same ones under each shingle."""
    h = (node[of].astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return of[np.argsort(h ^ (h >> np.uint64(29)), kind="stable")[:HUBS]]


def pairs_of(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    both = np.column_stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
    return np.unique(both[both[:, 0] != both[:, 1]], axis=0)


def meetings(postings: DataFrame) -> DataFrame:
    """(gram, a, b, size, rest): candidate pairs (null gram), and the postings of crowds (b null); what is salted is one."""
    dealt = postings.select("key", "node", "size", "rest", F.coalesce("gram", "key").alias("gram")).repartition("key").sortWithinPartitions("key", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches):
            fresh = np.concatenate(([True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))
            key, node, size, rest, gram = (c[fresh] for c in columns)
            starts, sizes = bounds(key)
            each = np.repeat(sizes, sizes)
            found = []
            for step in range(1, min(CROWD, int(sizes.max()))):
                i = np.flatnonzero((key[step:] == key[:-step]) & (each[step:] <= CROWD))
                keep = possible(size, rest, i, i + step)
                found.append((i[keep], i[keep] + step))
            for s, n in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist(), strict=True):
                i = np.arange(s, s + n)
                for hub in hubs(node, i, 0):
                    keep = possible(size, rest, i, hub)
                    found.append((i[keep], np.full(int(keep.sum()), hub)))
            both, crowd = pairs_of(node, found), (each > CROWD) | (key != gram)
            none = lambda n: pa.nulls(n, pa.int64())
            few = lambda n: pa.nulls(n, pa.int32())
            names = ["gram", "a", "b", "size", "rest"]
            yield pa.RecordBatch.from_arrays([none(len(both)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), few(len(both)), few(len(both))], names)
            yield pa.RecordBatch.from_arrays([pa.array(gram[crowd]), pa.array(node[crowd]), none(int(crowd.sum())), pa.array(size[crowd]), pa.array(rest[crowd])], names)

    return dealt.mapInArrow(meet, "gram long, a long, b long, size int, rest int")


def blocks(named: DataFrame, last: bool) -> DataFrame:
    """(key, node, size, rest, group, length, side, sketch) of the crowds that hold several groups.

    A crowd of up to ``BLOCK`` rows is one key. A larger one is cut in blocks by a hash of the node: each is a key of its
    own, and if it is the ``last`` round every two blocks are one as well, in which only rows of unlike ``side`` meet."""
    crowd = named.groupBy("gram").agg(F.count("*").alias("n"), F.min("group").alias("lowest"), F.max("group").alias("highest"))
    several = crowd.where("lowest <> highest").select("gram", F.ceil(F.col("n") / BLOCK).cast("int").alias("ways"))
    own, other = F.col("own"), F.col("other")
    rows = named.join(several, "gram").withColumn("own", F.pmod(F.xxhash64("node"), "ways").cast("int"))
    met = F.when(F.col("ways") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("ways") - 1) if last else F.array(own))
    rows = rows.withColumn("other", F.explode(met))
    key = F.when(F.col("ways") == 1, F.col("gram")).otherwise(F.xxhash64("gram", F.least(own, other), F.greatest(own, other)))
    side = F.when((F.col("ways") == 1) | (own == other), -1).otherwise((own < other).cast("int"))
    return rows.select(key.alias("key"), "node", "size", "rest", "group", "length", side.alias("side"), "sketch")


def unjoined(crowds: DataFrame, found: DataFrame, turn: int, last: bool) -> DataFrame:
    """(a, b): pairs that meet in a crowd, whose sketches allow a link, in different groups of ``found``: all, or those
    with hubs of the largest group."""
    named = crowds.join(found, "node", "left").select("gram", "node", "size", "rest", F.coalesce("component", "node").alias("group"), "length", "sketch")
    dealt = blocks(named, last).repartition("key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(node: np.ndarray, pairs: list) -> pa.RecordBatch:
            both = pairs_of(node, pairs)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for key, node, size, rest, group, length, side, sketches in runs(batches):
            sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, FOLDED)
            pairs, waiting = [], 0
            for s, n in zip(*(x.tolist() for x in bounds(key)), strict=True):
                rows = np.arange(s, s + n)
                names, of, uses = np.unique(group[rows], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                most = rows[of == uses.argmax()]
                # all pairs: each row outside the largest group, with that group and with the rows after it
                outside = rows[of != uses.argmax()]
                for k, i in enumerate(outside.tolist() if last else hubs(node, most, turn).tolist()):
                    j = np.concatenate((most, outside[k + 1 :])) if last else outside
                    meets = (group[j] != group[i]) & ((side[j] != side[i]) | (side[i] < 0))
                    j = close(size, length, sketches, j[possible(size, rest, j, i) & meets], i)
                    pairs.append((j, np.full(len(j), i)))
                    waiting += len(j)
                    if waiting > 500_000:
                        yield packed(node, pairs)
                        pairs, waiting = [], 0
            yield packed(node, pairs)

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def hopeful(nodes: DataFrame, pairs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The ``pairs`` (a, b) of nodes less those whose sketches differ in more bits than alike sets can in shingles."""
    ends = [nodes.select(F.col("node").alias(e), F.col("size").alias(f"n{e}"), F.col("sketch").alias(f"s{e}")) for e in "ab"]

    def test(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            if apart(r["sa"], r["sb"]) <= (1 - similar) / (1 + similar) * (r["na"] + r["nb"]) + SLACK:
                yield (r["a"], r["b"])

    return map_rows(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "sa", "sb"), "a long, b long", test)


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams) of the ``wanted`` (node, key)."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            yield (r["node"], shingles(r["text"]).tobytes())

    return map_rows(docs.join(wanted, "key").select("node", "text"), "node long, grams binary", rows)


def verified(owned: DataFrame, pairs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets, as ``owned`` has them, are alike in ``similar`` or more."""
    both = pairs.join(owned.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(owned.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")

    def test(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            x, y = np.frombuffer(r["x"], np.uint64), np.frombuffer(r["y"], np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similar * max(len(x), len(y)) else 0
            if common and common >= similar * (len(x) + len(y) - common):
                yield (r["a"], r["b"])

    return map_rows(both.select("a", "b", "x", "y"), "a long, b long", test)


def narrow(nodes: DataFrame) -> DataFrame:
    """(node, length, sketch) with sketches of ``FOLDED`` bytes, of which ``length`` count."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            yield (r["node"], min(FOLDED, len(r["sketch"])), folded(r["sketch"]))

    return map_rows(nodes.select("node", "sketch"), "node long, length int, sketch binary", rows)


def alike_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes that the SimHash operator links by Golay keys; nodes of one fingerprint go with the first of them."""
    worded = nodes.where("size > 0")
    first = cut(worded.groupBy("fp").agg(F.min("node").alias("first")))
    same = worded.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(e), F.col("first").alias(f"n{e}")) for e in "ab"]
    near = simhash.links(first.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return same.unionByName(near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``found`` and the ``links`` (a, b) that came after it; only what they join is worked on."""
    ends = [found.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")) for e in "ab"]
    across = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(across)
    moved = over.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(kept.unionByName(over.join(found.select("node"), "node", "left_anti").select("node", "component")))


def unlike(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that are not in one group of ``found``."""
    ends = [found.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")) for e in "ab"]
    both = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def groups(docs: DataFrame, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, leader) of each document of ``keyed``: the least key of its group.

    ``first`` gives links (a, b) of the nodes that hold as they are, beside those by shingles: ``alike_prints``."""
    marked = cut(marks(docs))
    nodes = cut(marked.groupBy("node").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("size", "sketch", "fp"))))
    found = components(first(nodes)) if first else None
    met = cut(meetings(posted(docs, *frequent(docs, nodes), nodes.count())))
    crowds = met.where("gram is not null").select("gram", F.col("a").alias("node"), "size", "rest")
    pairs = met.where("gram is null").select("a", "b").distinct()
    pairs = cut(hopeful(nodes, unlike(found, pairs) if first else pairs))
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node")).distinct()
    owned = cut(sets(docs, nodes.select("node", "key").join(wanted, "node")))
    links = cut(verified(owned, pairs))
    found = joined(found, links) if first else components(links)
    if not crowds.isEmpty():
        crowds = cut(crowds.join(narrow(nodes), "node"))
        for turn, last in ((1, False), (2, True)):
            more = cut(hopeful(nodes, unjoined(crowds, found, turn, last)))
            if not more.isEmpty():
                found = joined(found, cut(verified(owned, more)))
    named = nodes.join(found, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    led = named.join(named.groupBy("component").agg(F.min("key").alias("leader")), "component").select("node", "leader")
    return marked.select("key", "node").join(led, "node").select("key", "leader")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but the first of each group of near duplicates; columns as they are."""
    own = keyed(docs)
    others = groups(own.select("key", "text"), alike_prints).where("key <> leader").select("key")
    return own.join(others, "key", "left_anti").select(*docs.columns)

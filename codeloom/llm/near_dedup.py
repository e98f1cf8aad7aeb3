"""Near-duplicate groups by DartMinHash sketches and banded joining.

A text is the multiset of its runs of five words. Every element, one for each unit of weight, throws darts at times
that depend on its hash alone (a Poisson process); each dart falls on one of `SIZE` coordinates, and a text keeps
the earliest dart of each. Two texts agree on a coordinate with a chance equal to their weighted Jaccard similarity.
Darts are thrown up to a time at which every coordinate has one nearly surely; texts that still lack some throw on.

Coordinates are put into bands; texts with an equal band share a bucket. A bucket isn't expanded into pairs: in rounds,
all its members are compared, exactly and by whole texts, with one of them, its leader; links join groups, and a later
round picks another leader where members of a bucket still are in different groups. Rounds go on while at least one
comparison in twenty finds a link. What is still mixed then is settled in blocks: up to `BLOCK` members outside the
bucket's largest group meet all of the bucket inside one task, and pairs of different groups whose whole sketches come
near the threshold are compared exactly there. A task gives only the links that join two groups it hadn't joined yet,
so rows out grow with the members and not with their pairs. A pair is tried in the first bucket it shares alone.

Equal texts are one node from the start. Leaders of large buckets are copied to several tasks, so no task gets more
than `FOLLOWERS` followers of a leader. Links become groups by alternating stars.

Nodes are 64-bit text hashes. Texts of fewer than five words, but not none, are one run; texts without words are
alike only if equal; null texts are like no other. The group of a document is its least id (nulls last; null for a
group without ids). Repeated rows are equal texts. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._tables import drop, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 7
SIZE = BANDS * ROWS
FOLLOWERS = 500
#: Members that are compared with all of their bucket at a time, and the bytes of their texts.
BLOCK = 256
BLOCK_BYTES = 16 << 20
#: Standard deviations of the estimate below the threshold from which a pair isn't compared exactly.
SLACK = 4.0
#: Rounds of leaders go on while at least one comparison in so many finds a link.
WORTH = 20
#: Darts thrown at a time, and bytes of text: what bounds a worker's memory.
_DARTS = 1 << 18
_CHUNK = 1 << 19


def shingles(chunk: A.Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each different run of n words; sorted by text, then hash."""
    w = A.words(chunk)
    sums = A.prefix_hash(w.hash)
    sizes = np.diff(w.bounds)
    runs = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), runs)
    start = w.bounds[row] + np.arange(len(row)) - (np.cumsum(runs) - runs)[row]
    key = A.span_hash(sums, start, np.minimum(start + n, w.bounds[row + 1]))
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.append(first, len(row)))


def sketches(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """The earliest dart of each coordinate of n texts (a hash of 64 bits); 0 for texts without elements. Weights may be real."""
    total = np.bincount(row, weights=weight, minlength=n)
    earliest = np.full(n * size, np.inf)
    dart = np.zeros(n * size, dtype=np.uint64)
    until = size * (np.log(size) + 2.5) / np.maximum(total, 1e-300)
    pending = total > 0
    while pending.any():
        some = pending[row]
        layers = np.ceil(weight[some]).astype(np.int64)
        element = np.repeat(np.flatnonzero(some), layers)
        layer = np.arange(len(element)) - np.repeat(np.cumsum(layers) - layers, layers)
        room = np.minimum(weight[element] - layer, 1.0)
        seed = A.mix(key[element] + A.mix(layer.astype(np.uint64)))
        owner, time, thrown = row[element], np.zeros(len(element)), 0
        while len(owner):
            width = int(np.clip(_DARTS // len(owner), 1, 256))
            # each step is a block of texts' elements times `width` darts
            step = max(1, _DARTS // width)
            next_ = []
            for lo in range(0, len(owner), step):
                part = slice(lo, lo + step)
                number = A.mix(np.arange(thrown, thrown + width, dtype=np.uint64))
                hashes = A.mix(seed[part, None] + number[None, :])
                when = time[part, None] + np.cumsum(-np.log(((hashes >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53), axis=1)
                hit = when <= until[owner[part], None]
                again = hit[:, -1]
                next_.append((np.flatnonzero(again) + lo, when[again, -1]))
                i, j = np.nonzero(hit)
                h, t, who = hashes[i, j], when[i, j], owner[part][i]
                spread = A.mix(h)
                keep = (spread >> np.uint64(11)).astype(np.float64) * 2.0**-53 <= room[part][i]  # its height within the layer
                at = who * size + (A.mix(spread) % np.uint64(size)).astype(np.int64)
                at, t, h = at[keep], t[keep], h[keep]
                np.minimum.at(earliest, at, t)
                best = earliest[at] == t
                dart[at[best]] = h[best]
            on = np.concatenate([x for x, _ in next_])
            time = np.concatenate([x for _, x in next_])
            seed, owner, room = seed[on], owner[on], room[on]
            thrown += width
        lacking = np.isinf(earliest.reshape(n, size)).any(axis=1) & (total > 0)
        until = np.where(lacking, until * 2, until)
        pending = lacking
    return dart.reshape(n, size)


def _buckets(texts: DataFrame) -> DataFrame:
    """node, buckets, sketch: the band hashes of each different text that has words, and a byte of each coordinate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(batch.column("text"), _CHUNK):
                node = batch.column("node").to_numpy()[chunk.first : chunk.last]
                _, first = np.unique(node, return_index=True)
                n = len(node)
                row, key, weight = shingles(chunk)
                once = np.zeros(n, dtype=bool)
                once[first] = True
                own = once[row]
                sketch = sketches(row[own], key[own], weight[own].astype(np.float64), n).reshape(n, BANDS, ROWS)
                folded = np.zeros((n, BANDS), dtype=np.uint64)
                folded += np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
                for k in range(ROWS):
                    folded = A.mix(folded + sketch[:, :, k])
                bytes_ = (A.mix(sketch.reshape(n, SIZE)) >> np.uint64(56)).astype(np.uint8)
                some = np.unique(row[own])
                flat = folded[some].reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(flat)), pa.array([x.tobytes() for x in bytes_[some]], pa.binary())], names=["node", "buckets", "sketch"])

    return texts.select("node", "text").mapInArrow(A.released(rows), "node long, buckets array<long>, sketch binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of two sorted sets of hashes with weights."""
    at = np.searchsorted(a[0], b[0])
    same = np.flatnonzero(a[0][np.minimum(at, len(a[0]) - 1)] == b[0]) if len(a[0]) else np.zeros(0, np.int64)
    shared = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(shared / max(1, a[1].sum() + b[1].sum() - shared))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (leader, node) whose texts are similar enough. pairs: a written table."""
    # written first: a join splits hot leaders only if both its sides come straight from a shuffle
    parts, _ = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")), "parts")
    leaders = parts.select(F.col("leader").alias("node"), "parts").join(texts, "node")
    leaders = leaders.select(F.col("node").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "text")
    followers = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int").alias("part"), "node").join(texts, "node")
    both = leaders.unionByName(followers.select("leader", "part", "node", "text")).repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node").asc_nulls_first())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, None
        for batch in batches:
            for chunk in A.chunks(batch.column("text"), _CHUNK):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                leader, piece, node = part.column("leader").to_pylist(), part.column("part").to_pylist(), part.column("node").to_pylist()
                row, key, weight = shingles(chunk)
                cuts = np.searchsorted(row, np.arange(len(node) + 1))
                out = []
                for k in range(len(node)):
                    own = key[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]
                    if node[k] is None:
                        current, group = own, (leader[k], piece[k])
                    elif group == (leader[k], piece[k]) and weighted_jaccard(current, own) >= threshold:
                        out.append((leader[k], node[k]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(A.released(compared), "a long, b long")


def near_groups(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """node, root for every text that is like another, different one."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").select(F.xxhash64("text").alias("node"), "text")
    sketched, sketch_path = written(_buckets(rows).dropDuplicates(["node"]), "sketches")
    cells = sketched.select("node", F.posexplode("buckets").alias("band", "bucket"))
    # counts are written before they are joined: a join splits hot keys only if both its sides come straight from a shuffle
    shared, shared_path = written(cells.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    cells, cells_path = written(cells.join(shared, "bucket", "left_semi"), "buckets")
    nodes, nodes_path = written(cells.select("node").distinct(), "nodes")
    # the texts of nodes that share a bucket, once each
    texts, texts_path = written(rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "texts")
    for path in (shared_path, nodes_path):
        drop(spark, path)

    roots, roots_path = None, None
    turn, through = 0, False
    while True:
        rooted = cells.withColumn("root", F.col("node")) if roots is None else cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        grouped, grouped_path = written(rooted, "grouped")
        leader = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("order"), F.col("node").alias("leader"), F.col("root").alias("led"))).alias("l")
        mixed, mixed_path = written(grouped.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), leader).filter("lo <> hi").select("bucket", "l.leader", "l.led"), "mixed")
        old, last = [grouped_path, mixed_path], through
        if last:
            found, links_path = written(_rest(grouped.join(mixed.select("bucket"), "bucket", "left_semi"), sketched.select("node", "sketch"), texts, threshold), "links")
        else:
            # one comparison of a member with the same leader, however many buckets they share
            pairs, pairs_path = written(grouped.join(mixed, "bucket").filter("root <> led").select("leader", "node").distinct(), "pairs")
            found, links_path = written(_verified(pairs, texts, threshold), "links")
            old.append(pairs_path)
            through = found.count() * WORTH <= pairs.count()
        some = not found.isEmpty()
        if some:
            # earlier links are in the roots already
            edges = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            before, (roots, roots_path) = roots_path, written(components(edges), "roots")
            old += [before] if before else []
        for path in [*old, links_path]:
            drop(spark, path)
        if last:
            break
        turn += 1
    for path in (sketch_path, cells_path, texts_path):
        drop(spark, path)
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def _rest(grouped: DataFrame, sketched: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that join the groups left in mixed buckets, found by comparing every pair of members of different groups.

    A block holds members outside the bucket's largest group and meets all of the bucket, which streams by. Pairs
    whose sketches agree nearly as often as similar texts' do are compared exactly, unless links of this task
    have joined their groups already or an earlier band holds the pair as well.
    """
    sized = grouped.join(sketched, "node").join(texts, "node")
    sized, _ = written(sized.select("bucket", "band", "node", "root", "sketch", "text"), "sized")
    counts = sized.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.lit(1), F.ceil((F.sum("n") - F.max("n")) / BLOCK), F.ceil((F.sum("bytes") - F.max_by("bytes", F.struct("n", "root"))) / BLOCK_BYTES)).cast("int")
    main, _ = written(counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), blocks.alias("blocks")), "mains")
    rows = sized.join(main, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = F.col("root") != F.col("main")
    own = asks & (F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")) == F.col("block"))
    dealt = rows.select("bucket", "block", "band", own.alias("own"), asks.alias("asks"), "node", "root", "sketch", "text").repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("own"), "node")
    least = SIZE * threshold - SLACK * np.sqrt(SIZE * threshold * (1 - threshold))

    def elements(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        _, key, weight = shingles(next(A.chunks(pa.array([text], pa.binary()))))
        return key, weight

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        joined: dict[int, int] = {}

        def top(root: int) -> int:
            while root in joined:
                root = joined[root]
            return root

        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64).to_pylist()
                for here in dict.fromkeys((r["bucket"], r["block"]) for r in part):
                    some = [r for r in part if (r["bucket"], r["block"]) == here]
                    if here != group:
                        # groups that this task has joined stay joined: their link has been given
                        group, held = here, []
                    for r in some:
                        r["matrix"] = np.frombuffer(r["sketch"], np.uint8)
                    held += [r for r in some if r["own"]]
                    if not held:
                        continue
                    mine, theirs = (np.stack([r["matrix"] for r in x]) for x in (held, some))
                    tops = (np.array([top(r["root"]) for r in x]) for x in (held, some))
                    mine_top, their_top = tops
                    agree = np.empty((len(some), len(held)), dtype=np.int64)
                    for k in range(len(some)):
                        agree[k] = (mine == theirs[k]).sum(axis=1)
                    for i, j in zip(*np.nonzero((agree >= least) & (their_top[:, None] != mine_top[None]))):
                        a, b = held[j], some[i]
                        x, y = top(a["root"]), top(b["root"])
                        if x == y or (b["asks"] and a["node"] > b["node"]):
                            continue  # two members that both ask meet once
                        if (a["matrix"] == b["matrix"]).reshape(BANDS, ROWS).all(axis=1).argmax() < a["band"]:
                            continue
                        for r in (a, b):
                            if "elements" not in r:
                                r["elements"] = elements(r["text"])
                        if weighted_jaccard(a["elements"], b["elements"]) >= threshold:
                            joined[max(x, y)] = min(x, y)
                            out.append((a["node"], b["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(A.released(settled), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size: one row per document."""
    roots = near_groups(docs, threshold)
    member = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("node"), F.col("text").isNull().alias("alone"))
    rooted = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written first, so that the join can split a large group
    sizes, _ = written(rooted.filter("not alone").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    return rooted.join(sizes, "root", "left").select(
        "doc_id",
        F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("alone"), F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The input with one row of each group: the one with the least id, then the least text hash; null texts stay."""
    roots = near_groups(docs, threshold)
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("place"), F.xxhash64(F.col("text").cast("string")).alias("node"), F.col("text").isNull().alias("alone"))
    rooted = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("place").isNull(), "place", "node")
    best, _ = written(rooted.filter("not alone").groupBy("root").agg(F.min(order).alias("best")), "best")
    # of rows with the same id and text one is as good as another
    kept = rooted.filter("not alone").join(best, "root").filter(order == F.col("best")).dropDuplicates(["root"])
    return kept.select("row.*").unionByName(rooted.filter("alone").select("row.*"))

"""SimHash near-duplicates by May-Ozerov recursion, verified by exact Jaccard similarity.

Documents with one set of word shingles are one node. Each node has a 128-bit SimHash. A repetition puts the nodes
into lists by their partial weights on a random strip of coordinates, and only these rows (list, node, fingerprint) are shuffled. In a list the
recursion goes on in memory: many random centres on strips of their own take the rows of small partial weight, and these small lists
are searched by brute force. Repetitions and centres are added until simulated pairs at the threshold reach the target recall.

Pairs close in fingerprint are checked on their texts. So that a large family of near copies doesn't give all its
pairs, a first search only links each node to a pivot; a second search over all nodes leaves out pairs within one
component of the verified links. Classes are the components. Sets and rows go by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_WORDS, U64, batches_by_bytes, discard, mix64, release, stored, table, texts_of, trim, window_hashes, word_hashes, word_spans
from .components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.95
BITS, STRIP = 128, 64
#: Rows of a list that is shuffled, and of a small list that is searched by brute force, on average.
LIST_ROWS, LEAF_ROWS = 1 << 16, 2048
#: The part of the pairs missed that the search in memory may miss.
INNER_LOSS = 0.6
#: A list of more than HOT times list_rows is cut over tasks; one node in PROBE is counted to find them.
HOT, PROBE = 4, 16
BLOCK_CELLS = 1 << 18
MOST_TASKS, MOST_LINKS = 50_000, 2_000_000
NODE = ["node", "f0", "f1", "n_shingles"]
#: Shingles of the partners that one task checks against a pivot.
GROUP_SHINGLES = 4_000_000
CHUNK_BYTES = 3 << 20
BROADCAST_BYTES = 32 << 20


def doc_shingles(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and n + 1 offsets.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    raw, offsets = texts_of(column)
    norm, first, end, begin = word_spans(raw, LOWER_WORDS, offsets)
    words = word_hashes(norm, first, end)
    sizes = np.diff(begin)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h = window_hashes(words, shingle)
    inside = (begin[1:][doc] - np.arange(len(words)) >= shingle)[: len(h)]
    docs, hashes = [doc[: len(h)][inside]], [h[inside]]
    for size in range(1, shingle):
        short = np.flatnonzero(sizes == size)
        if len(short):
            docs.append(short)
            hashes.append(window_hashes(words, size)[begin[:-1][short]])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(sizes) + 1))


def simhash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit fingerprints (two uint64) of shingle sets; sets without shingles get 0."""
    n = len(offsets) - 1
    out = np.zeros((n, BITS // 64), U64)
    size = np.diff(offsets)
    for part in range(BITS // 64):
        bits = mix64(h + U64(0x9E3779B97F4A7C15 * (part + 1) % 2**64))
        sums = np.zeros((n, 64), np.int64)
        step = 1 << 17
        for a in range(0, len(h), step):
            b = min(a + step, len(h))
            ones = np.unpackbits(bits[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
            cuts = np.maximum(offsets[lo:hi], a) - a
            keep = np.flatnonzero(np.diff(np.append(cuts, b - a)) > 0)  # reduceat needs ranges that aren't empty
            sums[lo + keep] += np.add.reduceat(ones, cuts[keep], axis=0, dtype=np.int32)
        set_ = (2 * sums > size[:, None]).astype(np.uint8)
        out[:, part] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(shingle: int):
    def run(batches):
        release()
        for batch in batches_by_bytes(batches, 2, CHUNK_BYTES):
            h, offsets = doc_shingles(batch.column(2), shingle)
            size = np.diff(offsets)
            some = np.flatnonzero(size > 0)
            node = np.zeros(len(size), U64)
            if len(some):
                node[some] = mix64(np.add.reduceat(mix64(h ^ U64(0x5851F42D4C957F2D)), offsets[:-1][some]) + size[some].astype(U64))
            fp = simhash(h, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64), mask=size == 0), pa.array(size, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["doc_id", "k", "node", "n_shingles", "f0", "f1"])

    return run


class Strips:
    """The two filters and how often they are applied, so that pairs at the similarity are found with the recall.

    The first filter cuts n nodes into lists of about list_rows: a list of a repetition holds the nodes whose partial weight against the
    list's centre is 0 on a random strip of `width` coordinates. As all 2**width centres are lists, a node is in exactly one of a repetition, and
    its list is read off its strip. (Wider strips with larger weights find fewer pairs for each row that is moved while
    lists outnumber 2**20 only; the flips of 15 % at similarity 0.8 are too many for them.) The second filter works inside a list, in memory: centres on
    random strips of 64 coordinates take the rows whose partial weight is at most `weight`, about leaf_rows of them.
    """

    def __init__(self, n: int, similarity: float, recall: float):
        cosine = 2 * similarity / (1 + similarity)  # of the indicator vectors of two sets of equal size
        self.flip = flip = math.acos(cosine) / math.pi
        # Fingerprint distance up to which pairs are checked, and that of one half of the coordinates, which is looked at first: four
        # and three standard deviations above the mean at the threshold.
        self.far, self.half = (int(part * flip + sd * math.sqrt(part * flip * (1 - flip))) for part, sd in ((BITS, 4), (64, 3)))
        self.similarity, self.list_rows, self.leaf_rows = similarity, LIST_ROWS, LEAF_ROWS
        self.width = max(0, math.ceil(math.log2(max(1, n / self.list_rows))))
        # All chances by the number d of coordinates in which a pair differs, which is binomial at the threshold.
        differ = range(BITS + 1)
        share = np.array([math.comb(BITS, d) * flip**d * (1 - flip) ** (BITS - d) for d in differ])
        # By the doublings from leaf_rows to a list's rows: the partial weight, and the centres for the inner recall.
        inner = 1 - (1 - recall) * INNER_LOSS
        self.inner, met = [], np.ones(BITS + 1)
        for doublings in range(1, 1 + max(1, math.ceil(math.log2(2 * HOT * self.list_rows / self.leaf_rows)))):
            weight = next(w for w in range(STRIP) if sum(math.comb(STRIP, i) for i in range(w + 2)) > 2 ** (STRIP - doublings))
            both, centres = self.both(weight), 32
            while share @ (1 - (1 - both) ** centres) < inner:
                centres += 1 + centres // 20
            self.inner.append((weight, centres))
            if self.leaf_rows << doublings <= 2 * min(n, self.list_rows):
                met = 1 - (1 - both) ** centres
        same = np.array([math.comb(BITS - d, self.width) / math.comb(BITS, self.width) for d in differ]) * met
        self.repeats = 1
        while share @ (1 - (1 - same) ** self.repeats) < recall:
            self.repeats += 1
        self.expected = float(share @ (1 - (1 - same) ** self.repeats))

    @staticmethod
    def both(weight: int) -> np.ndarray:
        """By d: the chance that both of a pair are within the partial weight of a random centre on a random strip."""
        at = np.zeros(STRIP + 1)
        for e in range(STRIP + 1):  # coordinates of the strip in which the pair differs; j of them are off the centre for one, e - j for the other
            below = np.cumsum([math.comb(STRIP - e, c) / 2 ** (STRIP - e) for c in range(STRIP - e + 1)])
            at[e] = sum(math.comb(e, j) / 2**e * below[min(weight - max(j, e - j), STRIP - e)] for j in range(e + 1) if max(j, e - j) <= weight)
        return np.array([sum(math.comb(d, e) * math.comb(BITS - d, STRIP - e) * at[e] for e in range(max(0, STRIP - BITS + d), min(d, STRIP) + 1)) / math.comb(BITS, STRIP) for d in range(BITS + 1)])

    def lists(self, fp: np.ndarray, repeat: int) -> np.ndarray:
        """The list of each fingerprint in a repetition."""
        out = np.full(len(fp), repeat << self.width, np.int64)
        for i, c in enumerate(np.random.default_rng([11, repeat]).permutation(BITS)[: self.width].tolist()):
            out |= ((fp[:, c >> 6] >> U64(c & 63)) & U64(1)).astype(np.int64) << i
        return out

    def draws(self, fp: np.ndarray, seed: int):
        """Partial weights of all rows against one random centre after the other; every 32 centres share a strip."""
        rng = np.random.default_rng([13, seed])
        while True:
            strip = rng.permutation(BITS)[:STRIP]
            mask = np.zeros(BITS // 64, U64)
            for c in strip.tolist():
                mask[c >> 6] |= U64(1) << U64(c & 63)
            part = fp & mask
            for centre in rng.integers(0, 2**64, (32, BITS // 64), np.uint64, endpoint=False) & mask:
                yield np.bitwise_count(part[:, 0] ^ centre[0]) + np.bitwise_count(part[:, 1] ^ centre[1])

    def leaves(self, fp: np.ndarray, seed: int):
        """Row numbers of the small lists of a list, one after the other."""
        if len(fp) <= self.leaf_rows:
            yield np.arange(len(fp))
            return
        weight, centres = self.inner[min(len(self.inner), math.ceil(math.log2(len(fp) / self.leaf_rows))) - 1]
        for _, weights in zip(range(centres), self.draws(fp, seed)):
            at = np.flatnonzero(weights <= weight)
            if len(at) > 1:
                yield at


def members(nodes: DataFrame, strips: Strips, extra: list[str]) -> DataFrame:
    """list, node, f0, f1, n_shingles and extra columns: a row for each node and repetition."""
    kinds = ", ".join(f"{c} bigint" for c in ["list", *NODE, *extra])

    def run(batches):
        for batch in batches:
            fp = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1).view(U64)
            for r in range(strips.repeats):
                yield pa.RecordBatch.from_arrays([pa.array(strips.lists(fp, r)), *batch.columns], ["list", *batch.schema.names])

    return nodes.select(*NODE, *extra).mapInArrow(run, kinds)


def crowded(nodes: DataFrame, strips: Strips, n: int) -> DataFrame | None:
    """list, rows of lists of more than HOT * list_rows, as one node in PROBE tells; None without any. Only the layout of tasks depends on it."""
    if n <= HOT * strips.list_rows:
        return None
    probe = nodes.where(F.pmod("node", F.lit(PROBE)) == 0)
    found = stored(members(probe, strips, []).groupBy("list").agg((PROBE * F.count(F.lit(1))).alias("rows")).where(F.col("rows") > HOT * strips.list_rows), "crowded")
    return None if found.isEmpty() else found


def together(rows: DataFrame, strips: Strips, n: int) -> DataFrame:
    """Each list's rows side by side in one partition, cut by sub; lists are dealt out evenly."""
    tasks = int(min(MOST_TASKS, max(1, strips.repeats << strips.width, n * strips.repeats // strips.list_rows)))
    return rows.repartitionById(tasks, F.pmod(F.col("list") + 31 * F.col("sub"), F.lit(tasks)).cast("int")).sortWithinPartitions("list", "sub", "node")


def in_chunks(rows: DataFrame, hot: DataFrame | None, strips: Strips) -> DataFrame:
    """sub cuts crowded lists into chunks of list_rows by the nodes' hash."""
    if hot is None:
        return rows.withColumn("sub", F.lit(0).cast("bigint"))
    chunks = F.ceil(F.coalesce("rows", F.lit(1)) / strips.list_rows)
    return rows.join(small(hot, 16), "list", "left").withColumn("sub", F.pmod(F.xxhash64("node"), chunks)).drop("rows")


def in_blocks(rows: DataFrame, hot: DataFrame | None, strips: Strips) -> DataFrame:
    """sub cuts crowded lists into blocks that together hold every pair of rows of different parts.

    The rows of a list's largest part, which need no comparison with each other, are cut into chunks; each meets each
    chunk of the other rows, and these meet each other. So the largest part's rows are copied as often as the others have chunks, usually once.
    """
    if hot is None:
        return rows.withColumn("sub", F.lit(0).cast("bigint"))
    by_part = rows.join(small(hot, 16), "list", "left_semi").groupBy("list", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = by_part.groupBy("list").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"))
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / strips.list_rows))
    plan = stored(plan.select("list", F.col("top.part").alias("main"), chunks(F.col("top.n")).alias("gm"), chunks(F.col("all") - F.col("top.n")).alias("go"), (F.col("all") == F.col("top.n")).alias("one")), "blocks")
    rows = rows.join(small(plan, 40), "list", "left").where("one is null or not one")
    h = F.abs(F.xxhash64("node") % 2**62)
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("go") - 1), lambda o: 1 + (h % F.col("gm")) * F.col("go") + o)
    main = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("gm") - 1), lambda m: 1 + m * F.col("go") + h % F.col("go"))
    # Pairs of chunks of the others are numbered below 0.
    own = h % F.col("go")
    rest = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("go") - 1), lambda o: -1 - F.least(own, o) * F.col("go") - F.greatest(own, o))
    subs = F.when(F.col("gm").isNull(), F.array(F.lit(0).cast("bigint"))).when(F.col("part") == F.col("main"), others).otherwise(F.when(F.col("go") > 1, F.concat(main, rest)).otherwise(main))
    return rows.withColumn("sub", F.explode(subs)).drop("main", "gm", "go", "one")


def distances(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Hamming distances of a row f to all rows of g."""
    return np.bitwise_count(f[0] ^ g[:, 0]) + np.bitwise_count(f[1] ^ g[:, 1])


def near_pairs(f: np.ndarray, g: np.ndarray | None, far: int, half: int):
    """Blocks of (row of f, row of g, distance) with distances up to far; without g of the pairs x < y of f.

    One half of the coordinates is looked at first; nearly all random pairs end there.
    """
    other = f if g is None else g
    f0, g0 = np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(other[:, 0])
    step = max(1, BLOCK_CELLS // max(1, len(other)))
    room = step * len(other)
    both, bits, hit = np.empty(room, U64), np.empty(room, np.uint8), np.zeros(-(-room // 8) * 8, bool)
    for a in range(0, len(f), step):
        left = a + 1 if g is None else 0
        rows, width = min(step, len(f) - a), len(other) - left
        n = rows * width
        np.bitwise_xor(f0[a : a + rows, None], g0[left:], out=both[:n].reshape(rows, width))
        np.less_equal(np.bitwise_count(both[:n], out=bits[:n]), half, out=hit[:n])
        hit[n:] = False
        eight = np.flatnonzero(hit.view(U64)) * 8  # few are hit, so eight are looked at at once
        if not len(eight):
            continue
        at = (eight[:, None] + np.arange(8)).ravel()
        x, y = np.divmod(at[hit[at]], width)
        x, y = x + a, y + left
        if g is None:
            x, y = x[x < y], y[x < y]
        d = np.bitwise_count(f[x, 0] ^ other[y, 0]) + np.bitwise_count(f[x, 1] ^ other[y, 1])
        ok = d <= far
        if ok.any():
            yield x[ok], y[ok], d[ok]


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be so similar: they share as many as the smaller has at most."""
    return np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[i] for x in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(3))


def pivots(fp: np.ndarray, size: np.ndarray, far: int, half: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, row, distance) links: each row that isn't a pivot to the first pivot near it.

    Pivots are taken in the order of rows. The first of a long list are tried on all of it, so that a dense family costs
    no comparison of all its pairs; the pairs of what they leave are all compared.
    """
    out, free = [], np.arange(len(fp))
    while len(free) > 2 * LEAF_ROWS:
        p, before = free[0], len(free)
        d = distances(fp[p], fp[free])
        near = (d <= far) & alike(size[p], size[free], similarity)
        near[0] = False
        out.append((np.full(int(near.sum()), p), free[near], d[near]))
        near[0] = True
        free = free[~near]
        if before - len(free) < before // 32:
            break
    x, y, d = joined(list(near_pairs(fp[free], None, far, half)))
    if len(x):
        ok = alike(size[free[x]], size[free[y]], similarity)
        x, y, d = x[ok], y[ok], d[ok]
        taken = np.zeros(len(free), bool)
        cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else []
        for a, b in zip(cut, [*cut[1:], len(x)]):  # by ascending x
            if not taken[x[a]]:
                new = ~taken[y[a:b]]
                taken[y[a:b]] = True
                out.append((free[x[a:b]][new], free[y[a:b]][new], d[a:b][new]))
    return joined(out)


def crossing(fp: np.ndarray, size: np.ndarray, part: np.ndarray, far: int, half: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs of different parts, x < y. Rows of the largest part are not compared with each other."""
    kinds, which, count = np.unique(part, return_inverse=True, return_counts=True)
    in_main = which == count.argmax()
    rest, main = np.flatnonzero(~in_main), np.flatnonzero(in_main)
    out = []
    for i, j, blocks in ((rest, rest, near_pairs(fp[rest], None, far, half)), (rest, main, near_pairs(fp[rest], fp[main], far, half))):
        for x, y, d in blocks:
            x, y = i[x], j[y]
            ok = (part[x] != part[y]) & alike(size[x], size[y], similarity)
            out.append((x[ok], y[ok], d[ok]))
    return joined(out)


def _search(strips: Strips, with_parts: bool):
    """The small lists of each (list, sub), whose rows follow each other. Yields a < b and, without parts, their distance."""
    names = ["a", "b"] if with_parts else ["a", "b", "d"]

    def one(list_, block):
        node, f0, f1, size = (np.concatenate([b[i] for b in block]) for i in range(4))
        fp = np.stack([f0, f1], 1).view(U64)
        part = np.concatenate([b[4] for b in block]) if with_parts else None
        if len(node) < 2 or (with_parts and (part == part[0]).all()):
            return
        codes, held, n = [], 0, len(node)
        for at in strips.leaves(fp, int(list_) & 0x7FFFFFFFFFFFFFFF):
            if with_parts:
                x, y, d = crossing(fp[at], size[at], part[at], strips.far, strips.half, strips.similarity)
            else:
                x, y, d = pivots(fp[at], size[at], strips.far, strips.half, strips.similarity)
            if not len(x):
                continue
            codes.append(((np.minimum(at[x], at[y]) * n + np.maximum(at[x], at[y])) << 8) | d)
            held += len(x)
            if held > MOST_LINKS:  # the same pairs come from many small lists
                codes = [np.unique(np.concatenate(codes))]
                held = len(codes[0])
                if held > MOST_LINKS // 2:
                    yield unpack(node, codes, n)
                    codes, held = [], 0
        yield unpack(node, codes, n)

    def unpack(node, codes, n):
        code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        d, pair = code & 255, code >> 8
        a, b = node[pair // n], node[pair % n]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)][: len(names)], names)

    def run(batches):
        release()
        held, number = [], None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            new = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            cuts = np.append(np.flatnonzero(np.append(True, new)), len(columns[0]))
            for a, b in zip(cuts, cuts[1:]):
                key = columns[0][a], columns[1][a]
                if number is not None and key != number:
                    yield from one(number[0], held)
                    held = []
                number = key
                held.append([c[a:b].copy() for c in columns[2:]])
        if held:
            yield from one(number[0], held)
        trim()

    return run


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows are few."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def first_links(nodes: DataFrame, strips: Strips) -> DataFrame:
    """a < b: for each node with near ones the smallest of the pivots near it, and the nearest.

    The chunks of a crowded list give links of their own; their pivots are searched again as a list, until no list is crowded.
    """
    found, pool, n = None, nodes, nodes.count()
    while True:
        hot = crowded(pool, strips, n)
        links = stored(together(in_chunks(members(pool, strips, []), hot, strips), strips, n).select("list", "sub", *NODE).mapInArrow(_search(strips, False), "a bigint, b bigint, d bigint"), "pivots")
        found = links if found is None else found.union(links)
        if hot is None:
            break
        pool = stored(pool.join(small(links.select(F.col("a").alias("node")).distinct(), 16), "node", "left_semi"), "pool")
    best = found.groupBy("b").agg(F.min("a").alias("first"), F.min_by("a", F.struct("d", "a")).alias("near"))
    out = stored(best.select(F.explode(F.array_distinct(F.array("first", "near"))).alias("a"), "b"), "links")
    discard(found)
    return out


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar. docs: k, text; nodes: node, k, n_shingles.

    Texts travel to their pairs' a: each text of a b once a pair, that of an a once for every GROUP_SHINGLES of its partners, so that an a
    with many partners is spread over tasks. A task holds one set of an a and streams the others.
    """
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n_shingles"), "b")
    groups = F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)
    many = stored(sized.groupBy("a").agg(groups.alias("groups")), "groups")
    hubs = many.where("groups > 1")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1)))
    others = sized.join(small(hubs, 16), "a", "left").select("a", salt.alias("salt"), F.col("b").alias("node"))
    own = many.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("salt"), F.col("a").alias("node"))
    wanted = stored(others.union(own).join(nodes.select("node", "k"), "node"), "wanted")
    # Rows alike in id and text share k: any of them will do, and the test below takes the first.
    texts = docs.join(small(wanted, 40), "k").select("a", "salt", "node", "text", (F.col("a") != F.col("node")).alias("other"))
    texts = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "other", "node")

    def test(batches):
        release()
        key, mine, last = None, None, None
        for batch in batches_by_bytes(batches, 3, CHUNK_BYTES):
            h, offsets = doc_shingles(batch.column(3), shingle)
            out = []
            for i, (a, s, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                own_set = h[offsets[i] : offsets[i + 1]]
                if (a, s) != key:
                    key, mine, last = (a, s), own_set.copy(), a
                elif node != last:
                    last = node
                    lo, hi = sorted((len(mine), len(own_set)))
                    both = len(np.intersect1d(mine, own_set, assume_unique=True)) if lo >= similarity * hi - 1e-9 else 0
                    if both >= similarity * (lo + hi - both) - 1e-9:
                        out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    links = stored(texts.mapInArrow(test, "a bigint, b bigint"), "links")
    discard(many, wanted)
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, k (hash of id and text), n_shingles, class_id (the smallest id of the class), class_size, keep.

    keep marks one row of each class, one with the smallest id (a null id is the smallest; of rows alike in id and text any one). Texts
    without words, null ones included, are classes of their own and are kept. Texts of any length are read whole. Other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))
    prints = rows.select("doc_id", "k", "text").mapInArrow(_fingerprints(shingle), f"doc_id {kind}, k bigint, node bigint, n_shingles bigint, f0 bigint, f1 bigint")
    prints = stored(prints.withColumn("row", F.monotonically_increasing_id()), "prints")
    nodes = stored(prints.where("node is not null").groupBy("node").agg(*(F.min(c).alias(c) for c in ("k", "f0", "f1", "n_shingles"))), "nodes")
    n = nodes.count()
    strips = Strips(n, similarity, recall)
    texts = rows.select("k", "text")
    pairs = first_links(nodes, strips)
    links = verified(pairs, texts, nodes, shingle, similarity)
    first = stored(components(links), "parts")
    # Those links are a part of what is near. Every node is searched again, against all that aren't in its component.
    labelled = stored(nodes.join(small(first, 32), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "labelled-nodes")
    blocks = together(in_blocks(members(labelled, strips, ["part"]), crowded(labelled, strips, n), strips), strips, n)
    more = blocks.select("list", "sub", *NODE, "part").mapInArrow(_search(strips, True), "a bigint, b bigint").distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "crossing")  # those failed already
    if not more.isEmpty():
        first = stored(components(links.union(verified(more, texts, nodes, shingle, similarity))), "parts")
    rows = stored(prints.join(small(first, 32), "node", "left").select("doc_id", "k", "row", "n_shingles", F.coalesce("root", "node").alias("c")), "labelled")
    discard(prints, nodes, pairs, links, first, labelled, more)
    labelled = rows
    best = labelled.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "k", "row")).alias("best"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    out = labelled.join(best, "c", "left")
    alone = F.col("best").isNull()
    return out.select(
        "doc_id", "k", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("keep"),
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("k")

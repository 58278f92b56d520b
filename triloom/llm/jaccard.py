"""N-gram Jaccard self join with signature trees.

Two texts link when the Jaccard similarity of their sets of word n-grams reaches
a threshold.  The join is exact and never meets all pairs of a group:

1. One pass hashes every text to its set of n-grams.  Equal sets collapse into
   the row with the smallest id (their *representative*).
2. Two sets that link share one of their first ``n - ceil(t n) + 1`` elements in
   any fixed order.  Texts send those prefix elements, rare ones first, and
   every element names the smallest text that sent it as *leader*; distinct
   ``(representative, leader)`` pairs are the blocks.  So a
   linking pair meets in a block, and a thousand near copies meet in few.
3. A block is a signature tree: leaves are sets, nodes hold OR-combined token
   bitmaps, size ranges and the largest number of colliding tokens.  A dual
   traversal drops node pairs whose greatest possible overlap is too small.  It
   runs first over bitmaps alone, and members that can link with nobody leave.
   For the others the texts follow: the traversal then also passes over nodes
   whose members are connected already, and verifies leaf pairs on the whole
   sets.  A block reports the links that connect it, at most one per member.
4. Blocks of more than ``BLOCK`` members are cut into chunks that all hold the
   leader.  After the chunks' links are joined, the members of the smaller
   components of a cut block, in groups of a chunk's size, meet all of its
   members, so no link between chunks is lost; texts of members that can only
   link within their component are not sent again.

Elements met several times in a sample of the texts only move to the end of the
order, the more frequent the later; every element and row takes part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import small_batches, some_rows, written
from .text import NON_SPACE, grams, mix, scan, slices

#: Most members and set elements of a block that one tree holds.
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 21
#: Texts that show which elements are frequent, in how many of them one is met that is, and the most of these that are kept.
SAMPLE, LEAST, FREQUENT = 16384, 3, 200_000
#: Block members, of some 60 bytes each, that may be broadcast.
FEW = 50_000


def text_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text its sorted distinct n-gram hashes; a shorter text is one n-gram."""
    found = scan(column, NON_SPACE)
    bounds = found.bounds()
    shingle = grams(found.hash, words)
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high - low >= words:
            out.append(np.unique(shingle[low : high - words + 1]))
        elif high > low:
            out.append(grams(found.hash[low:high], int(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(elements: np.ndarray, percent: int, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The elements of which a linking set must share one: the first by class (0 if not ``frequent``) and hash."""
    n = len(elements)
    keep = n - (percent * n + 99) // 100 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        often = np.where(frequent[at] == elements, classes[at], 0)
        elements = elements[np.argsort(often, kind="stable")]
    return elements[:keep]


def signature(elements: np.ndarray, width: int = 0) -> np.ndarray:
    """The bitmap of a set, by default with about as many bits as the set has elements."""
    if not width:
        width = 64
        while width < len(elements) and width < 1 << 15:
            width *= 2
    flags = np.zeros(width, np.uint8)
    flags[(elements & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap in fewer bits: that of the same set at the smaller width."""
    while len(bits) > width // 64:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def _fingerprint(elements: np.ndarray, row_id) -> bytes:
    if not len(elements):
        return b"0" + str(row_id).encode()
    a = np.bitwise_xor.reduce(mix(elements ^ np.uint64(0x5851F42D4C957F2D)))
    b = np.add.reduce(mix(elements + np.uint64(0x14057B7EF767814F)))
    return b"1" + len(elements).to_bytes(6, "big") + int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _describe(words: int, percent: int, frequent: np.ndarray, classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids = batch.column(0).slice(low, high - low)
                sets = text_sets(batch.column(1).slice(low, high - low), words)
                heads = [prefix(s, percent, frequent, classes).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                offsets = np.cumsum([0, *map(len, heads)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s, i) for s, i in zip(sets, ids.to_pylist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(heads), pa.int64())),
                        pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "n", "fp", "prefix", "bits"],
                )

    return run


def _tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0)):
                for s in text_sets(batch.column(0).slice(low, high - low), words):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    return run


def frequent_elements(texts: DataFrame, words: int, sample: int = SAMPLE, least: int = LEAST, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Elements met in ``least`` of about ``sample`` texts or more, ``most`` at the most, and the bits of each one's count."""
    some = some_rows(texts, sample, F.col("id")).select("text")
    found = (
        some.mapInArrow(_tokens(words), "token long")
        .groupBy("token")
        .count()
        .where(F.col("count") >= least)
        .orderBy(F.desc("count"), "token")
        .limit(most)
        .collect()
    )
    hashes = np.array([r[0] for r in found], np.int64).view(np.uint64)
    classes = np.array([r[1].bit_length() for r in found], np.uint8)
    order = np.argsort(hashes)
    return hashes[order], classes[order]


def _leaders(percent: int):
    """Rows (token, n, id) in order: for each id but the first of a run, (id, first of the run).

    A run is one token's rows as far as sizes follow closely enough to link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            token, n, ids = (batch.column(k).to_numpy() for k in (0, 1, 2))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
            goes_on = last is not None and token[0] == last[0] and 100 * last[1] >= percent * n[0]
            new[0] = not goes_on
            leader = ids[np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))]
            if goes_on:
                leader[: int(np.argmax(new)) if new.any() else len(token)] = last[2]
            last = token[-1], n[-1], leader[-1]
            pairs = np.unique(np.stack([ids, leader], 1)[ids != leader], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["id", "leader"])

    return run


class SignatureTree:
    """A tree over sets: bitmaps OR-combined upwards, size ranges, and token collisions."""

    FAN = 8

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], percent: int, sets: list[np.ndarray] | None = None):
        self.percent = percent
        self.order = np.lexsort((sizes, [int(b[0]) for b in bits], bands(sizes, percent)))
        self.sets = [sets[i] for i in self.order] if sets else None
        self.sizes = sizes[self.order]
        width = 64 * min(map(len, bits))
        bits = np.stack([fold(bits[i], width) for i in self.order])
        extra = self.sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, self.sizes, self.sizes, extra)]
        while len(self.levels[-1][0]) > self.FAN:
            b, low, high, more = self.levels[-1]
            cut = np.arange(0, len(b), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(more, cut)))
        self.label = np.arange(len(sizes))

    def fits(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether node pairs may hold sets that link, by size and by greatest overlap."""
        bits, low, high, extra = self.levels[level]
        sized = 100 * np.minimum(high[i], high[j]) >= self.percent * np.maximum(low[i], low[j])
        most = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(extra[i], extra[j])
        most = np.minimum(most, np.minimum(high[i], high[j]))
        return sized & ((100 + self.percent) * most >= self.percent * (low[i] + low[j]))

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        shared = int(np.count_nonzero(b[at] == a))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    def pairs(self, done: Callable[[slice, slice], bool]) -> Iterator[tuple[int, int]]:
        """Leaf pairs that may link; ``done`` says of two nodes' leaves that their pairs don't matter."""
        stack = [(len(self.levels) - 1, -1, -1)]
        while stack:
            level, i, j = stack.pop()
            count = len(self.levels[level][0])
            a = np.arange(count) if i < 0 else np.arange(i * self.FAN, min((i + 1) * self.FAN, count))
            b = a if i == j else np.arange(j * self.FAN, min((j + 1) * self.FAN, count))
            span = self.FAN**level
            if done(slice(a[0] * span, (a[-1] + 1) * span), slice(b[0] * span, (b[-1] + 1) * span)):
                continue
            x, y = (k.ravel() for k in np.meshgrid(a, b, indexing="ij"))
            if i == j:
                ordered = x < y if level == 0 else x <= y
                x, y = x[ordered], y[ordered]
            ok = self.fits(level, x, y)
            if level:
                stack.extend((level - 1, int(p), int(q)) for p, q in zip(x[ok], y[ok], strict=True))
                continue
            yield from zip(x[ok].tolist(), y[ok].tolist(), strict=True)

    def together(self, a: slice, b: slice) -> bool:
        """Whether the leaves of two nodes all have one label."""
        own, other = self.label[a], self.label[b]
        return bool(own.min() == own.max() == other.min() == other.max())

    def connect(self) -> Iterator[tuple[int, int]]:
        """Links (places in the given list) that connect what is not connected by ``label``."""
        for p, q in self.pairs(self.together):
            if self.label[p] != self.label[q] and self.linked(p, q):
                self.label[self.label == self.label[q]] = self.label[p]
                yield int(self.order[p]), int(self.order[q])

    def hopeful(self) -> np.ndarray:
        """Places of the sets that may link with one of another label, by bitmaps alone."""
        found = np.zeros(len(self.sizes), bool)
        for p, q in self.pairs(lambda a, b: bool(found[a].all() and found[b].all()) or self.together(a, b)):
            if self.label[p] != self.label[q]:
                found[p] = found[q] = True
        return self.order[found]


def bands(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of size bands; sets that link are in the same band or in neighbours."""
    if percent >= 100:
        return sizes
    return np.floor(np.log(np.maximum(sizes, 1)) / (-np.log(percent / 100) * (1 + 1e-6))).astype(np.int64)


def hopeful(sizes: np.ndarray, bits: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Places of the sets that may link with one of another label, by a tree for each two neighbouring bands."""
    found = np.zeros(len(sizes), bool)
    of = bands(sizes, percent)
    for band in np.unique(of):
        at = np.flatnonzero((of == band) | (of == band + 1))
        if len(at) > 1 and not found[at].all():
            tree = SignatureTree(sizes[at], [bits[i] for i in at], percent)
            if labels is not None:
                tree.label = labels[at][tree.order]
            found[at[tree.hopeful()]] = True
    return np.flatnonzero(found)


def _block_hopes(percent: int):
    """Rows (block, id, label, n, bits) in order of block: (block, id, label) of those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, labels, sizes, bits = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            of = None if labels[0] is None else np.unique(labels, return_inverse=True)[1]
            if len(ids) > 1 and len(at := hopeful(np.array(sizes), bits, percent, of)):
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(at)), pa.array([ids[i] for i in at], pa.int64()), pa.array([labels[i] for i in at], pa.int64())], names=["block", "id", "label"])

        for batch in batches:
            for name, i, label, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != block:
                    yield from close()
                    block, ids, labels, sizes, bits = name, [], [], [], []
                ids.append(i)
                labels.append(label)
                sizes.append(n)
                bits.append(np.frombuffer(raw, np.uint64))
        yield from close()

    return run


def _block_links(words: int, percent: int):
    """Rows (block, id, label, text) in order of block: the links that connect each block."""

    def links(ids: list, labels: list, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        sizes = np.array([len(s) for s in sets])
        width = 64 * len(signature(sets[int(sizes.argmax())]))
        tree = SignatureTree(sizes, [signature(s, 2 * width) for s in sets], percent, sets)
        if labels[0] is not None:
            tree.label = np.unique(np.array(labels)[tree.order], return_inverse=True)[1]
        pairs = [(ids[p], ids[q]) for p, q in tree.connect()]
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, labels, sets = None, [], [], []
        for batch in batches:
            for low, high in slices(batch.column(3)):
                part = batch.slice(low, high - low)
                names, own, marks = (part.column(k).to_pylist() for k in (0, 1, 2))
                for name, i, mark, s in zip(names, own, marks, text_sets(part.column(3), words), strict=True):
                    if name != block:
                        if len(ids) > 1 and (out := links(ids, labels, sets)):
                            yield out
                        block, ids, labels, sets = name, [], [], []
                    if len(s):
                        ids.append(i)
                        labels.append(mark)
                        sets.append(s)
        if len(ids) > 1 and (out := links(ids, labels, sets)):
            yield out

    return run


def _traverse(members: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int, few: int | None = None) -> DataFrame:
    """Links found in blocks; ``members``: (block, id, label).

    Up to ``few`` members that may link are sent to the texts, else both are shuffled.
    """
    rows = members.join(sets.where("n > 0").select("id", "n", "bits"), "id").select("block", "id", "label", "n", "bits")
    hopes = rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(_block_hopes(percent), "block string, id long, label long")
    hopes = hopes.distinct()
    if few is not None:
        hopes = written(hopes)
        hopes = F.broadcast(hopes) if hopes.count() <= few else hopes
    rows = texts.join(hopes, "id").select("block", "id", "label", "text")
    return rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(_block_links(words, percent), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Words are runs of non-white-space with A-Z lower-cased.  A text's set holds
    its distinct ``words``-word shingles, or the whole sequence as one if it has
    fewer words.  Two texts link when ``100 * intersection >= percent * union``;
    component_id is the smallest id reachable by links, the own id included.

    Null and empty texts, and texts without words, have the empty set and link
    with nothing.  Rows that share an id are one node with the links of all of
    them.  Rows with a null id keep a null component.  An empty table gives an
    empty table; columns other than the two named are not read.
    """
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent, classes = frequent_elements(texts, words)
    sets = written(texts.mapInArrow(_describe(words, percent, frequent, classes), "id long, n long, fp binary, prefix array<long>, bits binary"))
    same = sets.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    sent = sets.where("n > 0 and id is not null").select("id", "n", F.explode("prefix").alias("token"))
    common = sets.sparkSession.createDataFrame([(int(x),) for x in frequent.view(np.int64)], "token long")
    often = sent.join(F.broadcast(common), "token", "left_semi")
    seldom = sent.join(F.broadcast(common), "token", "left_anti").select("token", "n", "id")
    cold = seldom.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(_leaders(percent), "id long, leader long")
    first = often.groupBy("token").agg(F.min("id").alias("leader"))
    hot = often.join(F.broadcast(first), "token").where("id <> leader").select("id", "leader")
    # A copy never leads: its representative sends the same elements and has the smaller id.
    pairs = written(cold.union(hot).distinct().join(same.select(F.col("rep").alias("id")), "id", "left_semi"))

    sizes = sets.where("n > 0").groupBy("id").agg(F.max("n").alias("n"))
    counted = pairs.join(sizes, "id").groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"))
    cuts = F.greatest(F.ceil(F.col("members") / (BLOCK - 1)), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("long")
    counted = written(counted.select("leader", cuts.alias("chunks")))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    cut = pairs.join(counted, "leader").select("id", "leader", chunk.alias("chunk"), "chunks")
    heads = counted.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks")
    named = F.concat_ws("/", "leader", "chunk").alias("block")
    members = cut.union(heads).select(named, "id", F.lit(None).cast("long").alias("label"))
    links = written(_traverse(members, sets, texts.hint("merge"), words, percent))
    joined = components(links, "a", "b")
    if counted.where("chunks > 1").limit(1).count():
        links = written(links.union(_between(cut.where("chunks > 1"), joined, sets, texts, words, percent)))
        joined = components(links, "a", "b")

    named = same.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return (
        sets.select("id", "n", "fp")
        .join(named, "fp", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    )


def _between(cut: DataFrame, joined: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the chunks of cut blocks, tried only between components."""
    rows = cut.join(joined, "id", "left").select("leader", "id", "chunks", F.coalesce("component", "id").alias("label"))
    rows = written(rows)
    per = rows.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("c"))
    half = F.ceil(F.lit(2) * F.col("chunks"))
    whole = F.sum("c").alias("whole"), F.max("c").alias("most")
    main = per.groupBy("leader").agg(F.max_by("label", F.struct("c", "label")).alias("main"), *whole).where("whole > most")
    # As many groups of minor members as hold about a part's number each.
    groups = F.ceil(half * (F.col("whole") - F.col("most")) / F.col("whole"))
    rows = rows.join(main, "leader").withColumn("half", half).withColumn("groups", groups)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), "half")).withColumn("minor", F.col("label") != F.col("main"))
    rows = rows.withColumn("own", F.when(F.col("minor"), F.pmod(F.xxhash64("id", F.lit(1)), "groups")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lone = rows.withColumn("mine", each("groups")).where("not minor or own <> mine").select("leader", "mine", "part", "id", "label")
    small = rows.where("minor").withColumn("part", each("half")).select("leader", F.col("own").alias("mine"), "part", "id", "label")
    members = lone.union(small).select(F.concat_ws("/", "leader", "mine", "part").alias("block"), "id", "label")
    return _traverse(members, sets, texts, words, percent, FEW)

"""N-gram Jaccard join with a count-vector R-tree, reduced to components of linked documents.

``shingle`` words make a token; documents are linked from ``percent`` of Jaccard on.  op10 takes 3 words and
90 percent, the near-duplicate stage of the pipeline its own (`corpus_pipeline`).

A document's tokens (distinct word shingles) are hashed into groups; the counts per group are
a point.  The overlap of two sets is at most the sum of coordinate minima of their points,
and of a query and a tree node the sum of minima with the node's upper corner.  Pairs that
pass this bound are verified on the sets themselves.

Points that can be linked are brought together by the pigeonhole rule.  Two sets with
Jaccard at least p / 100 differ in at most (a + b) (100 - p) / (100 + p) tokens.  With one group
more than that, the content of one group at least is untouched, so both have the same key
(size class, group number, content).  Only keys with two different sets matter.
There are some groups more (one for ``SPARE``), and each set sends all but that many of its smallest: empty or tiny groups
would bring unlike sets together.  One untouched group more than are left out remains, and the largest of these is sent by both,
as in either set that many untouched ones come after it (in order of size, then content, which untouched groups share).

1. Every block sends the keys of its distinct sets to hash buckets (packed); a bucket answers
   for each key that several sets share with a *hub*, the smallest of them.  Only pairs (set, hub) come out.
2. A set goes to one of its hubs, a crowded hub in chunks of about ``CHUNK`` sets, each with the hub.
   First only points go, and an R-tree over them (then the finer points of what it finds) tells the sets that can be linked; then the tokens of these go, and
   all their links are found, except between sets that are connected already.
   Components are merged by label propagation over the found links.
3. In hubs with sets outside the hub's component, those meet every other set of the hub, in blocks against
   chunks (``WIDE`` times as large), again points first.  After that no link between components is left.

Texts do not travel: points and tokens are made from the input again where they are needed, which a bit filter of set
ids of a fixed size tells (`_sieve`).

Equal sets are one set from the start, so copies cost nothing beyond one membership row each.

Texts are lower-cased (A-Z); fewer words than a shingle make one token of all of them; null,
empty and wordless texts have no tokens and no links.  Repeated rows are linked to each other
(unless without words).  A null id never becomes a component's id unless all ids are null.
Other columns are ignored; an empty table gives an empty result.  Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._anchors import ROW, as_batch
from llm._common import NOT_WHITE, U64, Block, bucket_of, buckets, hash_runs, hash_spans, lower, mix, new_block_id, pack, read, store, text_blocks, unpack, words
from llm._sieve import Sieve, sent, sieve_of
from llm.registry import query

SHINGLE = 3
PERCENT = 90
GROUPS = 256
#: Groups of the finer point, which decides whether a pair's tokens are looked at.
FINE = 1 << 14
#: One group in so many more than the pigeonhole rule needs: the smallest give no keys.
SPARE = 4
NODE = 16
CHUNK = 256
#: Where mostly points travel, a chunk is so many times as large: fewer copies of each point.
WIDE = 8
#: Text that a task cuts into sets at a time.
BLOCK_BYTES = 4 << 20
#: Keys only bring sets together, so 48 bits of their hash are enough.
KEY_BITS = U64(0xFFFFFFFFFFFF0000)


def least_overlap(a, b, percent: int):
    """Smallest overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def size_classes(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of size classes, and per class the groups that make sure one is untouched.

    A class spans a factor of 100 / percent, so linked sets are in the same or in neighbouring classes.
    """
    bounds = [1]
    while bounds[-1] <= largest or len(bounds) < 3:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    bounds += [-(-bounds[-1] * 100 // percent) + 1]
    low = np.array(bounds, np.int64)
    a = low[1:-1] - 1
    b = np.minimum(low[2:] - 1, a * 100 // percent)
    return low, (a + b) * (100 - percent) // (100 + percent) + 1


def shingle_sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents, sorted inside each, and their bounds."""
    data = lower(block.data)
    starts, ends, before = words(data, block.offsets, NOT_WHITE)
    values, counts = hash_spans(data, starts, ends), np.diff(before)
    runs = hash_runs(values, shingle)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(runs)) + shingle <= np.repeat(before[1:], counts)[: len(runs)]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    whole = np.array([hash_runs(values[before[i] : before[i + 1]], int(counts[i]))[0] + U64(counts[i]) for i in short], U64)
    doc = np.concatenate([doc[: len(runs)][inside], short])
    token = np.concatenate([runs[inside], whole])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return token[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of every set; 0 for empty ones."""
    size = np.diff(bounds)
    out = mix(sums(mix(token + U64(1)), bounds) + size.astype(U64)) | U64(1)
    return np.where(size > 0, out, U64(0))


def group_keys(token: np.ndarray, bounds: np.ndarray, use: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of the largest groups of the documents ``use``, for their own size class and the one below."""
    size = np.diff(bounds)[use]
    if not len(use):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    low, groups = size_classes(int(size.max()), percent)
    own = np.searchsorted(low, size, "right") - 1
    keys, docs = [], []
    for step in (0, 1):
        tag = own - step
        need = np.where((tag >= 0), groups[np.maximum(tag, 0)], 1)
        pick = np.flatnonzero(need > 1)  # with one group only equal sets can be linked
        if not len(pick):
            continue
        tag, need, doc = tag[pick], need[pick], use[pick]
        many = need - -need // SPARE
        count = size[pick]
        base = np.concatenate([[0], np.cumsum(many)])
        total = int(count.sum())
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[doc], count)
        value = token[at]
        place = np.repeat(base[:-1], count) + (mix(value ^ U64(0x5BD1E995)) % np.repeat(many, count).astype(U64)).astype(np.int64)
        content = np.zeros(int(base[-1]), U64)
        np.add.at(content, place, mix(value))
        row, number = np.repeat(np.arange(len(doc)), many), np.arange(int(base[-1])) - np.repeat(base[:-1], many)
        order = np.lexsort((content, -np.bincount(place, minlength=int(base[-1])), row))
        kept = order[number < np.repeat(need, many)]
        label = mix((tag[row[kept]].astype(U64) << U64(32)) + number[kept].astype(U64))
        keys.append(mix(content[kept] * U64(0x9E3779B97F4A7C15) + label))
        docs.append(doc[row[kept]])
    return np.concatenate([*keys, np.zeros(0, U64)]), np.concatenate([*docs, np.zeros(0, np.int64)])


def point_of(tokens: np.ndarray) -> np.ndarray:
    """Tokens by group."""
    return np.bincount((tokens & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def fine_point(tokens: np.ndarray) -> np.ndarray:
    """Counts over ``FINE`` groups, one code a token: group and how many of the group came before.

    Two sets share as many codes as the sum of coordinate minima.  ``GROUPS`` divides ``FINE``, so a coarse point follows.
    """
    group = np.sort((tokens & U64(FINE - 1)).astype(np.int64))
    return np.sort(group + FINE * (np.arange(len(group)) - np.searchsorted(group, group)))


class Tree:
    """R-tree over points: nodes of ``NODE`` neighbours in size and counts, with upper corners and size ranges."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, percent: int):
        self.sizes, self.points, self.percent = sizes, points, percent
        self.order = np.lexsort((*points[:, :4].T, sizes))
        firsts = np.arange(0, len(sizes), NODE)
        self.corner = np.maximum.reduceat(points[self.order], firsts, axis=0)
        self.least = np.minimum.reduceat(sizes[self.order], firsts)
        self.most = np.maximum.reduceat(sizes[self.order], firsts)

    def near(self, size: int, point: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Rows among ``open_`` whose overlap bound allows a link."""
        low, high = -(-size * self.percent // 100), size * 100 // self.percent
        nodes = (self.most >= low) & (self.least <= high)
        nodes &= np.minimum(self.corner, point).sum(axis=1) >= least_overlap(size, np.maximum(self.least, low), self.percent)
        rows = self.order[np.repeat(nodes, NODE)[: len(self.order)]]
        rows = rows[open_[rows] & (self.sizes[rows] >= low) & (self.sizes[rows] <= high)]
        return rows[np.minimum(self.points[rows], point).sum(axis=1) >= least_overlap(size, self.sizes[rows], self.percent)]


def links(sets: list[np.ndarray], component: np.ndarray, askers: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets which links with an asker connect; ``component``: known connections."""
    sizes = np.array([len(s) for s in sets])
    points = np.stack([point_of(s) for s in sets])
    tree, label, found = Tree(sizes, points, percent), component.copy(), []
    for row in np.flatnonzero(askers):
        mine, open_ = sets[row], label != label[row]
        if not open_.any():
            continue
        for other in tree.near(len(mine), points[row], open_):
            if label[other] == label[row]:
                continue
            theirs = sets[other]
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = int((mine[place] == theirs).sum())
            if 100 * common >= percent * (len(mine) + len(theirs) - common):
                found.append((row, other))
                label[label == label[other]] = label[row]
    return found


def connect(edges: DataFrame, label: str) -> DataFrame:
    """``v, c``: for every vertex of ``edges`` (a, b) the smallest vertex it is connected with."""
    both = store(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{label}-edges")
    labels = store(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")), f"{label}-labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("other")), "u").groupBy("v").agg(F.min("other").alias("other"))
        lower_ = labels.join(around, "v").select("v", "c", F.least("c", "other").alias("next"))
        hop = labels.select(F.col("v").alias("next"), F.col("c").alias("hop"))
        new = store(lower_.join(hop, "next", "left").select("v", "c", F.least("next", F.coalesce("hop", "next")).alias("new")), f"{label}-labels")
        labels = new.select("v", F.col("new").alias("c"))
        if new.filter("new < c").isEmpty():
            return labels


def block_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int):
    """Rows of (id, text), and a function from their batches to (block, tokens, bounds, set ids, first document of each set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for part in text_blocks(batches, BLOCK_BYTES):
            token, bounds = shingle_sets(part, shingle)
            sid = set_ids(token, bounds)
            _, first = np.unique(sid, return_index=True)
            yield part, token, bounds, sid, first[sid[first] > 0]

    return docs.select(F.col(id_col).cast("bigint"), text_col), run


def choose_hubs(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Stored ``sid, hub``: for every key that several sets share, the sets and the smallest of them."""
    many = buckets(docs.sparkSession)
    rows, sets = block_sets(docs, id_col, text_col, shingle)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = new_block_id()
        for _, token, bounds, sid, first in sets(batches):
            keys, doc = group_keys(token, bounds, first, percent)
            bucket = bucket_of(keys, many)
            order = np.lexsort((doc, bucket))  # by set, so that its id is sent once a bucket
            keys, doc, edges = keys[order] & KEY_BITS, doc[order], np.searchsorted(bucket[order], np.arange(many + 1))
            out = []
            for b in range(many):
                x, y = edges[b], edges[b + 1]
                if x < y:
                    who, n = np.unique(doc[x:y], return_counts=True)
                    out.append((block, b, pack(keys[x:y]), [pack(sid[who]), pack(n)]))
            yield as_batch(out)
            block += 1

    def meet(table: pa.Table) -> pa.Table:
        keys = [unpack(k, U64) for k in table.column("keys").to_pylist()]
        sids = [np.repeat(unpack(ids, U64), unpack(n, np.int64)) for ids, n in table.column("parts").to_pylist()]
        key, sid = np.concatenate([*keys, np.zeros(0, U64)]), np.concatenate([*sids, np.zeros(0, U64)])
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        head, fresh = np.ones(len(key), bool), np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        fresh[1:] = head[1:] | (sid[1:] != sid[:-1])
        run = np.cumsum(head) - 1
        several = fresh & (np.bincount(run[fresh], minlength=int(head.sum())) > 1)[run]
        pairs = np.unique(np.stack([sid[several], sid[head][run[several]]], axis=1), axis=0)
        return pa.table({"sid": pa.array(pairs[:, 0].copy().view(np.int64)), "hub": pa.array(pairs[:, 1].copy().view(np.int64))})

    return store(rows.mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(meet, "sid bigint, hub bigint").distinct(), "jaccard-hubs")


def describe_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: Sieve) -> DataFrame:
    """Stored ``sid, doc_id, n_shingles, point`` of every document; the point once a block, of sets that ``wanted`` has."""
    rows, sets = block_sets(docs, id_col, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, token, bounds, sid, first in sets(batches):
            points: list[bytes | None] = [None] * len(sid)
            for d in first[sieve.value.has(sid[first])]:
                points[d] = pack(np.diff(fine_point(token[bounds[d] : bounds[d + 1]]), prepend=0).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), pa.array(part.ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(points, pa.binary())], ["sid", "doc_id", "n_shingles", "point"])

    with sent(docs.sparkSession, wanted) as sieve:
        return store(rows.mapInArrow(run, "sid bigint, doc_id bigint, n_shingles bigint, point binary"), "jaccard-sets")


def tokens_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: Broadcast) -> DataFrame:
    """``sid, tokens`` of the sets that the filter ``wanted`` has, each once."""
    rows, sets = block_sets(docs, id_col, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, token, bounds, sid, first in sets(batches):
            use = first[wanted.value.has(sid[first])]
            for i in range(0, len(use), CHUNK):
                some = use[i : i + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(sid[some].view(np.int64)), pa.array([pack(token[bounds[d] : bounds[d + 1]]) for d in some], pa.binary())], ["sid", "tokens"])

    return rows.mapInArrow(run, "sid bigint, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens"))


CELL = ["hub", "chunk", "sid", "component", "asks"]


def by_cell(table: pa.Table) -> Iterator[pa.Table]:
    """Rows of every (hub, chunk), askers first."""
    table = table.sort_by([("hub", "ascending"), ("chunk", "ascending"), ("asks", "descending"), ("sid", "ascending")])
    hub, chunk = table.column("hub").to_numpy(), table.column("chunk").to_numpy()
    edges = np.flatnonzero((np.diff(hub) != 0) | (np.diff(chunk) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, len(hub)], strict=True):
        yield table.slice(a, b - a)


def bounded(codes: list[np.ndarray], component: np.ndarray, asks: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a cell the bound lets link with an asker of another component, or are such an asker."""
    sizes = np.array([len(c) for c in codes])
    points = np.stack([np.bincount(c % GROUPS, minlength=GROUPS) for c in codes]).astype(np.int32)
    tree, active = Tree(sizes, points, percent), np.zeros(len(sizes), bool)
    mine = np.zeros(max(int(c[-1]) for c in codes) + 1, bool)
    for row in np.flatnonzero(asks):
        near = tree.near(int(sizes[row]), points[row], component != component[row])
        if not len(near):
            continue
        mine[codes[row]] = True
        common = np.add.reduceat(mine[np.concatenate([codes[other] for other in near])], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        mine[codes[row]] = False
        near = near[common >= least_overlap(sizes[row], sizes[near], percent)]
        active[near] = True
        active[row] |= len(near) > 0
    return active


def possible(cells: DataFrame, parts: int, percent: int) -> DataFrame:
    """Those rows of ``cells`` (with ``point``) for which the bound allows a link that is not known yet with an asker of the cell."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for cell in by_cell(table):
            codes = [np.cumsum(unpack(p, np.uint32), dtype=np.int64) for p in cell.column("point").to_pylist()]
            component, asks = cell.column("component").to_numpy(), cell.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            out.append(cell.select(CELL).filter(pa.array(bounded(codes, component, asks, percent))))
        return pa.concat_tables(out)

    kind = "hub bigint, chunk bigint, sid bigint, component bigint, asks boolean"
    return cells.withColumn("part", F.pmod(F.xxhash64("hub", "chunk"), F.lit(parts))).groupBy("part").applyInArrow(run, kind)


def find_links(members: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links (a, b) inside every (hub, chunk); ``members``: the columns ``CELL`` and tokens."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for cell in by_cell(table):
            sets, sid = [unpack(t, U64) for t in cell.column("tokens").to_pylist()], cell.column("sid").to_numpy()
            component, asks = cell.column("component").to_numpy(), cell.column("asks").to_numpy(zero_copy_only=False)
            out += [(int(sid[i]), int(sid[j])) for i, j in links(sets, component, asks, percent)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.withColumn("part", F.pmod(F.xxhash64("hub", "chunk"), F.lit(parts))).groupBy("part").applyInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; linked from ``percent`` Jaccard of ``shingle``-word tokens on."""
    parts = buckets(docs.sparkSession)
    how = docs, id_col, text_col, shingle
    pairs = choose_hubs(*how, percent)
    described = describe_sets(*how, sieve_of(pairs.select(F.col("sid").alias("hash"))))
    points = described.filter("point IS NOT NULL").groupBy("sid").agg(F.first("point").alias("point"))

    def verified(cells: DataFrame, label: str) -> DataFrame:
        """Links of cells: the bound on points first, then tokens of those that it leaves."""
        left = store(possible(cells.join(points, "sid"), parts, percent), f"jaccard-{label}")
        with sent(docs.sparkSession, sieve_of(left.select(F.col("sid").alias("hash")))) as wanted:
            return store(find_links(left.join(tokens_of(*how, wanted), "sid"), parts, percent), f"jaccard-{label}-links")

    # Every set goes to one of its hubs; a hub is in all of its chunks.
    own = F.col("sid") == F.col("hub")
    stars = pairs.filter(~own).groupBy("sid").agg(F.min("hub").alias("hub"))
    crowd = store(stars.groupBy("hub").count().select("hub", F.ceil(F.col("count") / CHUNK).cast("bigint").alias("chunks")), "jaccard-stars")
    homes = stars.join(crowd, "hub").select("hub", F.pmod(F.xxhash64("sid"), F.col("chunks")).alias("chunk"), "sid")
    cells = homes.unionByName(crowd.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("sid")))
    edges = verified(cells.select("hub", "chunk", "sid", F.col("sid").alias("component"), F.lit(True).alias("asks")), "star")
    labels = connect(edges, "jaccard")
    # Sets outside their hub's component meet every other set of the hub: outsiders in blocks, the others in chunks.
    named = pairs.join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("component", F.coalesce("c", "sid")).drop("c")
    hubs = named.filter(own).select("hub", F.col("component").alias("hub_component"))
    named = store(named.join(hubs, "hub").select("hub", "sid", "component", (F.col("component") != F.col("hub_component")).alias("outside")), "jaccard-named")
    mixed = named.groupBy("hub").agg(F.count("*").alias("n"), F.count_if("outside").alias("m")).filter("m > 0")
    size = lambda column: F.ceil(F.col(column) / (WIDE * CHUNK)).cast("bigint")
    mixed = store(mixed.select("hub", size("n").alias("chunks"), size("m").alias("blocks")), "jaccard-mixed")
    if not mixed.isEmpty():
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        place = lambda count: F.pmod(F.xxhash64("sid", F.lit(1)), F.col(count))
        rows = named.join(mixed, "hub")
        asking = rows.filter("outside").withColumn("block", place("blocks")).withColumn("chunk", every("chunks"))
        asked = rows.withColumn("chunk", place("chunks")).withColumn("block", every("blocks"))
        cell = [F.col("hub"), (F.col("chunk") * F.lit(1 << 32) + F.col("block")).alias("chunk"), F.col("sid"), F.col("component")]
        cells = asking.select(*cell, F.lit(True).alias("asks")).unionByName(asked.select(*cell, F.lit(False).alias("asks")))
        more = verified(cells, "outside")
        labels = connect(edges.unionByName(more), "jaccard")
    sets = described.filter("sid != 0").groupBy("sid").agg(F.min("doc_id").alias("own"))
    sets = store(sets.join(labels.withColumnRenamed("v", "sid"), "sid", "left").select("sid", "own", F.coalesce("c", "sid").alias("c")), "jaccard-components")
    least = sets.join(sets.groupBy("c").agg(F.min("own").alias("least")), "c").select("sid", "least")
    return described.select("sid", "doc_id", "n_shingles").join(least, "sid", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"), shingle=SHINGLE, percent=PERCENT)

"""N-gram Jaccard join: universe partition, pigeonhole and one-deletion neighbourhoods.

Two sets of sizes a <= b with ``100 * |A & B| >= t * |A | B|`` differ in at most
``(a + b) * (100 - t) / (100 + t)`` elements. The universe of shingles is dealt by hash into
segments, the same for all sets of a size band. With more segments than possible differences one
segment of the two sets is equal; a segment that also lists its one-deletion neighbourhood stands
for two segments, because two differences must meet in it to hide the match. What each segment is
worth is decided per band from costs measured on a bounded sample. Every set is indexed under the
band of its own size and under the bands of smaller partners.

Segment keys give candidate clusters, in which sets that share common shingles are chained together.
Sketches of the sets, about a bit per shingle, show which of them may be linked at all and cut a
cluster down to groups of near copies. Groups are cut into blocks, and a block compares its sets
exactly, so neither the candidates of a group nor its links are ever listed as pairs of documents.
A group of several blocks is compared inside each first, then by one set of every component found,
and only sets that are still apart meet across blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barworks.llm.arrow import as_bytes, prepared, runs, signed
from barworks.llm.graph import components
from barworks.llm.shingles import mix, set_ids, shingle_set
from barworks.operators.ordered import join_per_key
from barworks.session import materialize

SAMPLE = 4000  # documents on which costs are measured; costs alone depend on it
COMMON = 20_000  # shingles at most that count as common
SHARD_KEYS = 1_500_000  # segment keys that meet in one task
HELD_KEYS, HELD_NODES = 1_000_000, 60_000  # what a task combines before it sends; nodes are numbered in 16 bits
THIN = 2  # shingles that are not common; a segment with so few or fewer may be left out
BLOCK_SETS, BLOCK_TOKENS = 1024, 600_000  # half of what a block compares
SKETCH_BITS = 128  # of the sketch of a set at least
SKETCH_SETS, SKETCH_TOKENS = 4096, 8_000_000  # half of what a block of sketches compares
CANDIDATE_COST = 200.0  # keys that joining one candidate pair to a cluster and comparing it is worth


@dataclass(frozen=True)
class Join:
    """A similarity of ``percent`` or more between sets of ``words``-word shingles."""

    words: int
    percent: int

    def differences(self, small: int) -> int:
        """Most elements in which a set of this size and a linked one at least as large differ."""
        large = small * 100 // self.percent
        return (small + large) * (100 - self.percent) // (100 + self.percent)

    @property
    def first(self) -> int:
        """Smallest size at which two different sets can be linked."""
        size = 1
        while self.differences(size) < 1:
            size += 1
        return size

    def bands(self, largest: int) -> list[tuple[int, int]]:
        """(lowest, highest) size of each band, up to the largest set."""
        ratio, out, low = (100 / self.percent) ** 2, [], self.first
        while low <= largest or not out:
            high = max(low, math.floor(low * ratio))
            out.append((low, high))
            low = high + 1
        return out

    def tags(self, size: int, bands: list[tuple[int, int]]) -> list[int]:
        """Bands under which a set is indexed: its own and those of smaller partners."""
        least = -(-size * self.percent // 100)
        return [i for i, (low, high) in enumerate(bands) if low <= size and high >= least]


def tag_mark(tag: int) -> int:
    """What turns the id of a set into its id under a band, by exclusive or."""
    return (tag + 1) * 0x9E3779B97F4A7C15 % 2**64


@dataclass(frozen=True)
class Allocation:
    """Segments of a band: the first ``deletions`` list one-deletion neighbourhoods, ``spare``
    units beyond what the pigeonhole needs let a set leave out as many of the others."""

    deletions: int
    spare: int

    def segments(self, differences: int) -> int:
        return differences + 1 + self.spare - self.deletions


def choices(differences: int) -> list[Allocation]:
    units = differences + 1
    spare = max(2, units // 6)
    out = [Allocation(0, spare), Allocation(units // 4, spare), Allocation(units // 2, 0)]
    return list(dict.fromkeys(a for a in out if a.segments(differences) >= 1))


def segment_keys(tokens: np.ndarray, tag: int, differences: int, plan: Allocation, common: np.ndarray) -> np.ndarray:
    """Keys of the segments of a set, and of the one-deletion neighbours of its first segments.

    A set leaves out the segments that would meet most others, those with the fewest shingles that
    are not common, as long as they are no more than the spare ones. Of two linked sets one more
    segments than that are equal; equal segments are as thin in both sets, and the set that leaves
    out the thicker ones leaves out no more than the spare number of them, so one is in both.
    """
    count = plan.segments(differences)
    salted = mix(tokens + np.uint64(0xA5A5A5A5 * (tag + 1)))
    segment = ((salted >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(salted[order], out=sums[1:])
    ends = np.searchsorted(segment[order], np.arange(count + 1))
    total = sums[ends[1:]] - sums[ends[:-1]]
    name = mix(np.arange(count, dtype=np.uint64) + np.uint64((tag + 1) << 32))
    keys = mix(total + name)
    if plan.spare:
        rare = np.ones(len(tokens), dtype=bool)
        if len(common):
            at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            rare = common[at] != tokens
        weight = np.bincount(segment[rare], minlength=count)
        weight[: plan.deletions] = THIN + 1
        for thin in range(THIN, -1, -1):
            if (weight <= thin).sum() <= plan.spare:
                keys = keys[weight > thin]
                break
    if plan.deletions:
        inside = order[: ends[plan.deletions]]
        at = segment[inside]
        keys = np.concatenate((keys, mix(total[at] - salted[inside] + name[at])))
    return keys


def sketch(tokens: np.ndarray) -> bytes:
    """One bit or two per shingle: the parity of the shingles that fall on it.

    Every shingle that only one of two sets has flips one bit, so sketches differ in no more bits than
    their sets in shingles. One half of a sketch by exclusive or with the other is the sketch of half
    the width.
    """
    if not len(tokens):
        return b""
    bits = max(SKETCH_BITS, 1 << (len(tokens) - 1).bit_length())
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketch: bytes, width: int) -> np.ndarray:
    out = np.frombuffer(sketch, np.uint8)
    while len(out) > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def identify(docs: DataFrame, join: Join, ref: Column) -> DataFrame:
    """(ref, doc_id, text_hash, n_shingles, node, check, sketch) per document; equal sets share their
    node."""

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, checks, sketches = [], [], [], []
            for text in as_bytes(batch.column("text")):
                tokens = shingle_set(text, join.words)
                node, check = set_ids(tokens)
                sizes.append(len(tokens))
                nodes.append(node)
                checks.append(check)
                sketches.append(sketch(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ref"),
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    signed(np.array(nodes, dtype=np.uint64)),
                    signed(np.array(checks, dtype=np.uint64)),
                    pa.array(sketches, pa.binary()),
                ],
                ["ref", "doc_id", "text_hash", "n_shingles", "node", "check", "sketch"],
            )

    rows = docs.select(ref.alias("ref"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(identified, "ref long, doc_id long, text_hash long, n_shingles long, node long, check long, sketch binary")


def allocate(docs: DataFrame, join: Join, bands: list[tuple[int, int]], total: int):
    """Cheapest allocation of every band, mean number of keys per document, common shingles.

    Costs are the keys themselves and the pairs that meet under them, measured on at most
    ``SAMPLE`` documents and scaled to ``total``. Bands that the sample does not hold take the
    first choice. Shingles of four or more different sets of the sample are common.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[int, list[np.ndarray]] = {}
        seen, known = 0, set()
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                tokens = shingle_set(text, join.words)
                seen += 1
                node = set_ids(tokens)[0]
                if node not in known:
                    known.add(node)
                    for tag in join.tags(len(tokens), bands):
                        members.setdefault(tag, []).append(tokens)
        rows = []
        every = list({id(s): s for sets in members.values() for s in sets}.values())
        shingles, times = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        often = np.argsort(-times, kind="stable")[:COMMON]
        common = np.sort(shingles[often[times[often] >= 4]])
        for tag, sets in members.items():
            differences, scale, best = join.differences(bands[tag][1]), total / seen, None
            for plan in choices(differences):
                keys = np.concatenate([segment_keys(s, tag, differences, plan, common) for s in sets])
                each = np.unique(keys, return_counts=True)[1].astype(float)
                pairs = float((each * (each - 1) / 2).sum())
                cost = scale * len(keys) + CANDIDATE_COST * scale * scale * pairs
                if best is None or cost < best[0]:
                    best = (cost, plan, len(keys) / seen)
            rows.append((tag, best[1].deletions, best[1].spare, best[2]))
        rows.append((-1, 0, 0, 0.0))
        listed = pa.array([None] * (len(rows) - 1) + [common.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))), listed],
            ["tag", "deletions", "spare", "keys", "common"],
        )

    rows = (
        docs.select("text").limit(SAMPLE).coalesce(1)
        .mapInArrow(measured, "tag int, deletions int, spare int, keys double, common binary").collect()
    )
    plans, common = [choices(join.differences(high))[0] for _, high in bands], b""
    for r in rows:
        if r.tag < 0:
            common = bytes(r.common)
        else:
            plans[r.tag] = Allocation(r.deletions, r.spare)
    return plans, sum(r["keys"] for r in rows), np.frombuffer(common, np.uint64)


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key with its smallest node, and the links from that node to the others."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    least = np.minimum.reduceat(node, starts)
    first = np.repeat(least, np.diff(np.concatenate((starts, [len(key)]))))
    other = node != first
    return key[starts], least, first[other], node[other]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pieces(at: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns cut by shard: (shard, column, ...) for each shard that has rows."""
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(at[rows[0]]), *(c[rows] for c in columns)


def candidate_links(docs: DataFrame, join: Join, bands, plans, common: np.ndarray, shards: int) -> DataFrame:
    """Links (a, b) from every node to the smallest node that shares one of its segment keys.

    Nodes are named per band (:func:`tag_mark`), so chains of candidates end where sizes differ too
    much to be linked.

    Keys are combined before they are shuffled: a task holds ``HELD_KEYS`` of them, links the nodes
    that share one, and sends each key once, with the smallest of its nodes. A group of near copies
    therefore meets in a shard with one entry per key and flush, not with one per set; its links
    are dealt by their ends.
    """
    empty = np.zeros(0, dtype=np.int64).tobytes()
    columns = ("low", "high", "nodes", "place", "a", "b")

    def combined(keys: list[np.ndarray], nodes: list[tuple[int, int]]) -> pa.RecordBatch:
        node = np.repeat(np.array([n for n, _ in nodes], np.uint64), [c for _, c in nodes]).view(np.int64)
        key, node, a, b = _stars(np.concatenate(keys), node)
        rows = []
        for shard, k, n in _pieces((key % np.uint64(shards)).astype(np.int64), key // np.uint64(shards), node):
            table, at = np.unique(n, return_inverse=True)
            low, high = k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16)
            rows.append((shard, low.tobytes(), high.tobytes(), table.tobytes(), at.astype(np.uint16).tobytes(), empty, empty))
        a, b = _distinct(a, b)
        ends = (mix(b.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        for shard, x, y in _pieces(ends, a, b):
            rows.append((shard, empty, empty, empty, empty, x.tobytes(), y.tobytes()))
        arrays = [pa.array([r[i + 1] for r in rows], pa.binary()) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *arrays], ["shard", *columns])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A set is sent once per task, so copies of one text do not pile up under its keys.
        sent_before: set[int] = set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                tokens = shingle_set(text, join.words)
                node = set_ids(tokens)[0]
                if node in sent_before:
                    continue
                sent_before.add(node)
                for tag in join.tags(len(tokens), bands):
                    keys.append(segment_keys(tokens, tag, join.differences(bands[tag][1]), plans[tag], common))
                    nodes.append((node ^ tag_mark(tag), len(keys[-1])))
                    held += len(keys[-1])
                    if held >= HELD_KEYS or len(nodes) >= HELD_NODES:
                        yield combined(keys, nodes)
                        keys, nodes, held = [], [], 0
        if held:
            yield combined(keys, nodes)

    def met(table: pa.Table) -> pa.Table:
        keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        a, b = [], []
        for low, high, names, place, x, y in zip(*(table.column(c).to_pylist() for c in columns)):
            key = np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)
            keys.append(key | np.frombuffer(low, np.uint32))
            nodes.append(np.frombuffer(names, np.int64)[np.frombuffer(place, np.uint16)])
            a.append(np.frombuffer(x, np.int64))
            b.append(np.frombuffer(y, np.int64))
        key, node = np.concatenate(keys), np.concatenate(nodes)
        if len(key):
            *_, first, other = _stars(key, node)
            a.append(first)
            b.append(other)
        first, other = _distinct(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": first, "b": other})

    sent = docs.select("text").mapInArrow(
        dealt, "shard int, low binary, high binary, nodes binary, place binary, a binary, b binary"
    )
    return sent.groupBy("shard").applyInArrow(met, "a long, b long").distinct()


# A part meets every part of its cluster: block (i, j), i <= j, for either order.
ALL_BLOCKS = "transform(sequence(0, parts - 1), p -> struct(least(p, part) AS i, greatest(p, part) AS j))"
OWN_BLOCK = "array(struct(part AS i, part AS j))"
# Parts with an owner hold sets of one component, which need not meet each other.
OPEN_BLOCKS = (
    "transform(filter(sequence(0, size(owners) - 1), p -> coalesce(owners[p] <> owners[part], true)),"
    " p -> struct(least(p, part) AS i, greatest(p, part) AS j))"
)


def _may_be_linked(sketches: list[bytes], sizes: np.ndarray, left: np.ndarray, same_side: bool, percent: int) -> list[tuple[int, int]]:
    """Links like those of :func:`_links_in` between sets whose sketches do not rule out a link."""
    width = min(map(len, sketches))
    order = np.argsort(sizes, kind="stable")
    bits = np.stack([_folded(sketches[i], width) for i in order]).view(np.uint64)
    sizes, left = sizes[order], left[order]
    ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    root = np.arange(len(order))
    out = []
    for u in range(len(order)):
        may = root[u + 1 : ends[u]] != root[u]
        if not same_side:
            may &= left[u + 1 : ends[u]] != left[u]
        others = np.flatnonzero(may) + u + 1
        if not len(others):
            continue
        apart = np.bitwise_count(bits[others] ^ bits[u]).sum(axis=1, dtype=np.int64)
        near = others[(100 + percent) * apart <= (100 - percent) * (sizes[others] + sizes[u])]
        if len(near):
            roots, first = np.unique(root[near], return_index=True)
            root[np.isin(root, roots)] = root[u]
            out += [(int(order[u]), int(order[v])) for v in near[first]]
    return out


def sketched_links(members: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that join the sets of each candidate cluster which sketches do not keep apart.

    ``members`` is (name, n, sketch, cluster, part, parts), blocks as in :func:`verified_links`. Sets
    that are similar enough are always joined, so this decides what is compared and never the result.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cluster", "i", "j"]):
            same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            names, sizes, parts = (table.column(c).to_numpy() for c in ("name", "n", "part"))
            found = _may_be_linked(table.column("sketch").to_pylist(), sizes, parts, same, join.percent)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

    spread = members.withColumn("block", F.explode(F.expr(ALL_BLOCKS))).select("cluster", "block.i", "block.j", "name", "n", "part", "sketch")
    width = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        spread.repartition(width, "cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(compared, "a long, b long")
    )


def _links_in(tokens: list[np.ndarray], left: np.ndarray, same_side: bool, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets of one block to its components; at most one less than sets.

    Sets already joined are not compared again, nor are those with the same number in ``known``. With
    ``same_side`` false only sets of the two halves are compared; each half is a block of its own.
    """
    sizes = np.array([len(t) for t in tokens])
    flat, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    root = np.arange(len(tokens)) if known is None else known.copy()
    mark = np.zeros(len(flat), dtype=np.int64)
    out = []
    for u in np.argsort(sizes, kind="stable"):
        may = (root != root[u]) & (sizes >= sizes[u]) & (100 * sizes[u] >= percent * sizes)
        if not same_side:
            may &= left != left[u]
        others = np.flatnonzero(may)
        if not len(others):
            continue
        mine = inverse[offsets[u] : offsets[u + 1]]
        mark[mine] = 1
        for v in others:
            if root[v] == root[u]:
                continue
            both = int(mark[inverse[offsets[v] : offsets[v + 1]]].sum())
            if 100 * both >= percent * (sizes[u] + sizes[v] - both):
                root[root == root[v]] = root[u]
                out.append((int(u), int(v)))
        mark[mine] = 0
    return out


def verified_links(docs: DataFrame, ref: Column, members: DataFrame, blocks: str, join: Join) -> DataFrame:
    """Links between the sets of each group that are similar enough.

    ``members`` is (ref, node, known, cluster, part) and what ``blocks`` needs: a group is cut into
    parts, and a block compares two of them or one with itself. Sets with the same ``known`` are
    joined already. A block returns links that span its components, never all of them.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cluster", "i", "j"]):
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            sets: dict[int, tuple[int, int, np.ndarray]] = {}
            for chunk in table.to_batches():
                wanted, parts, before = (chunk.column(c).to_pylist() for c in ("node", "part", "known"))
                for node, part, known, text in zip(wanted, parts, before, as_bytes(chunk.column("text"))):
                    if node not in sets:
                        tokens = shingle_set(text, join.words)
                        if np.uint64(set_ids(tokens)[0]).view(np.int64) == node:
                            sets[node] = (part, known, tokens)
            names = list(sets)
            if len(names) < 2:
                continue
            left = np.array([sets[n][0] for n in names])
            known = np.unique(np.array([sets[n][1] for n in names]), return_inverse=True)[1]
            found = _links_in([sets[n][2] for n in names], left, i == j, join.percent, known)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[u] for u, _ in found], pa.int64()), pa.array([names[v] for _, v in found], pa.int64())],
                    ["a", "b"],
                )

    # Always a merge join: the members grow with the documents, so a broadcast would not last.
    met = members.withColumn("blocks", F.expr(blocks)).select("ref", "node", "known", "cluster", "part", "blocks")
    texts = docs.select(ref.alias("ref"), "text").join(met.hint("merge"), "ref")
    spread = texts.withColumn("block", F.explode("blocks")).select("cluster", "block.i", "block.j", "node", "known", "part", "text")
    width = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        spread.repartition(width, "cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(compared, "a long, b long")
    )


def _parts(sets: int, tokens: int) -> Column:
    """Into how many parts ``c`` sets of ``t`` shingles are cut."""
    return F.greatest(F.ceil(F.greatest(F.col("c") / sets, F.col("t") / tokens)), F.lit(1)).cast("int")


def in_parts(linked: DataFrame, name: str, sets: int, tokens: int) -> DataFrame:
    """``linked``, which has cluster and n, with ``part`` and ``parts``; parts are dealt by ``name``."""
    sizes = linked.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    cut = linked.join(sizes.select("cluster", _parts(sets, tokens).alias("parts")), "cluster")
    return cut.withColumn("part", F.pmod(F.xxhash64(name), F.col("parts")).cast("int"))


def narrowed(linked: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """``linked`` (name, node, cluster, ref, n) with the clusters that are left where sketches keep sets
    apart; sets that are left alone are dropped."""
    sketches = rows.where("n_shingles > 0").select("node", "sketch").join(linked.select("node"), "node", "left_semi").dropDuplicates(["node"])
    members = in_parts(linked, "name", SKETCH_SETS, SKETCH_TOKENS).join(sketches, "node")
    near = components(materialize(sketched_links(members, join)))
    kept = near.withColumnRenamed("node", "name").join(linked.drop("cluster"), "name")
    return materialize(kept.withColumnRenamed("root", "cluster"))


def group_links(docs: DataFrame, ref: Column, linked: DataFrame, join: Join) -> DataFrame:
    """Links that join the sets of each group of ``linked`` (node, cluster, ref, n) to its components.

    Parts are compared inside first, which settles the groups of one part. Of the others one set of
    every component so far is compared next. What is still apart then meets across parts: components of
    more than a part get parts of their own, which do not meet each other, so a set is sent about as
    often as there are parts of other components in its group.
    """
    members = materialize(in_parts(linked, "node", BLOCK_SETS, BLOCK_TOKENS).withColumn("known", F.col("node")))
    links = materialize(verified_links(docs, ref, members, OWN_BLOCK, join))
    large = members.where("parts > 1").drop("part", "parts", "known")

    def joined(links: DataFrame) -> DataFrame:
        """``large`` with the component of each set, in the groups that have several."""
        roots = components(links.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
        known = materialize(large.join(roots, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root"))
        open_ = known.groupBy("cluster").agg(F.min("known").alias("_x"), F.max("known").alias("_y")).where("_x < _y")
        return known.join(open_.select("cluster"), "cluster", "left_semi")

    if large.isEmpty():
        return links
    known = joined(links)
    first = F.row_number().over(Window.partitionBy("cluster", "known").orderBy("node"))
    some = known.withColumn("_r", first).where("_r = 1").drop("_r")
    links = links.unionByName(materialize(verified_links(docs, ref, in_parts(some, "node", BLOCK_SETS, BLOCK_TOKENS), OWN_BLOCK, join)))
    known = joined(links)
    if known.isEmpty():
        return links
    sizes = known.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    sizes = sizes.select("cluster", "known", "c", "t", _parts(BLOCK_SETS, BLOCK_TOKENS).alias("own"))
    small = sizes.where("own = 1").groupBy("cluster").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    small = small.select("cluster", _parts(BLOCK_SETS, BLOCK_TOKENS).alias("shared"))
    dealt = known.join(sizes.select("cluster", "known", "own"), ["cluster", "known"]).join(small, "cluster", "left")
    owned = F.col("own") > 1
    dealt = dealt.select(
        "ref", "node", "known", "cluster", F.when(owned, F.col("known")).alias("owner"),
        F.pmod(F.xxhash64("node"), F.when(owned, F.col("own")).otherwise(F.col("shared"))).cast("int").alias("at"),
    )
    dealt = materialize(dealt)
    listed = dealt.groupBy("cluster").agg(F.array_sort(F.collect_set(F.struct("owner", "at"))).alias("labels"))
    members = dealt.join(listed, "cluster").select(
        "ref", "node", "known", "cluster", F.col("labels.owner").alias("owners"),
        (F.array_position("labels", F.struct("owner", "at")) - 1).cast("int").alias("part"),
    )
    return links.unionByName(materialize(verified_links(docs, ref, members, OPEN_BLOCKS, join)))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def similarity_classes(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) per document, repeated rows included: see
    :func:`similarity_groups`."""
    return similarity_groups(docs, join).select("doc_id", "n_shingles", "component_id", "node")


def similarity_groups(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, text_hash, group) per document, repeated rows included.

    ``component_id`` is the smallest doc_id reachable by links, itself included. A document
    without words or text has an empty set, is linked with nothing and is its own component. Equal
    sets are one node, so groups of copies are joined before anything is compared. Rows whose
    doc_id is null take part in links but name no component: one that only such rows share is
    null. ``group`` names the component even where documents of several share a doc_id. Other columns
    are ignored. The two 64-bit ids of a set are checked against each other;
    a clash raises.
    """
    spark = prepared(docs.sparkSession)
    ref = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = materialize(identify(docs, join, ref))
    sets = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.min("ref").alias("ref"), F.first("n_shingles").alias("n"),
        F.min("check").alias("c0"), F.max("check").alias("c1"),
    )
    sets = materialize(sets)
    facts = sets.agg(F.max("n"), F.count(F.when(F.col("c0") != F.col("c1"), 1)), F.count(F.lit(1))).first()
    if facts[1]:
        raise ValueError("two different shingle sets share a 64-bit id")
    bands = join.bands(facts[0] or 0)
    total = rows.count()
    plans, per_doc, common = allocate(docs, join, bands, total)
    shards = max(1, math.ceil(total * per_doc / SHARD_KEYS))
    near = components(materialize(candidate_links(docs, join, bands, plans, common, shards)))
    # Each set under the bands it is indexed in; the bands are logarithmic in the largest size.
    least = F.ceil(F.col("n") * join.percent / 100)
    marks = [F.when((F.col("n") >= low) & (least <= high), F.lit(_signed(tag_mark(i)))) for i, (low, high) in enumerate(bands)]
    tagged = sets.withColumn("mark", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    tagged = tagged.select("node", "ref", "n", F.col("node").bitwiseXOR(F.col("mark")).alias("name"))
    linked = materialize(near.withColumnRenamed("node", "name").join(tagged, "name").select("name", "node", F.col("root").alias("cluster"), "ref", "n"))
    linked = narrowed(linked, rows, join)
    joined = components(group_links(docs, ref, linked, join))
    named = joined.join(sets.select("node", "doc"), "node")
    smallest = named.groupBy("root").agg(F.min("doc").alias("component"))
    of_set = named.join(smallest, "root").select("node", "component", "root")
    ids = sets.select("node", "doc").join(of_set, "node", "left").select(
        "node", F.coalesce("component", "doc").alias("component"), F.coalesce("root", "node").alias("group")
    )
    empty = F.col("n_shingles") == 0
    # A third of all documents may be copies of one text; their node is spread over salts.
    return join_per_key(rows.drop("sketch"), ids, ["node"], "left", salts=8).select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "node",
        "text_hash", "group",
    )


def one_per_class(docs: DataFrame, join: Join) -> DataFrame:
    """One row of every similarity class, with its own columns, and every row without words.

    It is the row with the smallest doc_id of the class, those without one last, then that with the
    smallest hash of its text; of equal rows one stays. A class is one of texts: where rows with one
    doc_id have texts of several classes, each of the classes keeps a row.
    """
    groups = similarity_groups(docs, join).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at")
    kept = groups.groupBy("group").agg(first).select(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    has_words = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"])
    chosen = rows.where(has_words).join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return chosen.select("row.*").unionByName(rows.where(~has_words).select("row.*"))

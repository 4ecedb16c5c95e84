"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits over hashed word shingles. Two that differ in at most `budget` bits agree on one of budget+1
blocks, so the trie is built once for each rotation that puts another block on top: below one value of that block
the bits above are equal, and each such subtree is one key of a shuffle. Inside, node pairs are traversed together
from the top; differing bits accumulate along the path, and a pair of nodes is pruned when they exceed the budget or
when everything below both is connected already. Subtrees come to a task sorted, some at a time. It gives back a
spanning forest of its links and not the pairs; the forests are merged by minimum labels in rounds, each round a table
in the shared folder.

Cases: null and empty texts have fingerprint zero and link like any other; a fingerprint is one node, so copies are
never expanded into pairs, and rows without a doc_id or with one in common link like any other; repeated rows stay
repeated; a component has the smallest doc_id of its rows, null if none has one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import columns, map_batches, remove, shared_dir, ship, stored, table

#: Node pairs with no more leaf pairs than this are compared directly.
LEAF_PAIRS = 32
#: Node pairs traversed at once; more are put on a stack.
FRONTIER = 400_000
#: Rows of subtrees that are joined at once; a single subtree may have more.
SUBTREE_ROWS = 300_000


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `width` words joined by a space, repeats included; the whole sequence if shorter."""
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(joined))] if words else []
    else:
        at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        spans = zip(at[: -width].tolist(), (at[width:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The 64-bit number whose bits are set in over half the (weighted) hashes; 0 for none."""
    if not len(hashes):
        return 0
    total, counts = 0, np.zeros(64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        if weights is None:
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
        else:
            share = weights[at : at + (1 << 15)]
            counts += share @ bits
            total += share.sum()
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Words are runs without ASCII white space, A-Z lower-cased."""
    return majority_bits(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, key (the fingerprint as a signed 64-bit number)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = [_signed(fingerprint(t, width)) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64())], names=["doc_id", "key"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, key long")


class Components:
    """Union-find on arrays: every entry points straight at the smallest member of its component."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def connect(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            self.root = root


class TrieJoin:
    """Links between keys of one or many subtrees; `keys` ascend inside each run [lo, hi), whose top bits are equal."""

    def __init__(self, keys: np.ndarray, budget: int, accept=None) -> None:
        self.keys, self.budget, self.accept = keys, budget, accept
        self.parts = Components(len(keys))
        self.ones: dict[int, np.ndarray] = {}

    def run(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> Components:
        near = np.arange(max(0, len(self.keys) - 1))
        inside = np.zeros(len(self.keys), dtype=bool)
        inside[lo] = True
        near = near[~inside[near + 1]] if len(near) else near
        self._link(near, near + 1)  # neighbours first: most of a group of copies is connected before any traversal
        heads = np.repeat(lo, hi - lo)
        self._link(heads, np.arange(len(self.keys)))
        more = hi - lo > 1
        stack = [(depth, np.stack([lo[more], hi[more], lo[more], hi[more], np.full(more.sum(), self.budget)]))]
        while stack:
            depth, nodes = stack.pop()
            while nodes.shape[1]:
                nodes = nodes[:, self._open(nodes)]
                pairs = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
                done = pairs <= LEAF_PAIRS if depth < 64 else pairs > 0
                self._leaves(nodes[:, done], pairs[done])
                nodes = nodes[:, ~done]
                if not nodes.shape[1]:
                    break
                nodes = self._children(nodes, depth)
                depth += 1
                while nodes.shape[1] > FRONTIER:
                    stack.append((depth, nodes[:, -FRONTIER:]))
                    nodes = nodes[:, :-FRONTIER]
        return self.parts

    def _open(self, nodes: np.ndarray) -> np.ndarray:
        """Pairs below which something isn't connected yet."""
        root = self.parts.root
        changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1]), [0]])
        one = lambda a, b: changes[b - 1] == changes[a]
        return ~(one(nodes[0], nodes[1]) & one(nodes[2], nodes[3]) & (root[nodes[0]] == root[nodes[2]]))

    def _children(self, nodes: np.ndarray, depth: int) -> np.ndarray:
        if depth not in self.ones:
            bits = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones = {depth: np.concatenate([[0], np.cumsum(bits.astype(np.int64))])}
        ones = self.ones[depth]
        a0, a1, b0, b1, left = nodes
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        out = np.concatenate(
            [
                np.stack([a0, am, b0, bm, left]),
                np.stack([am, a1, bm, b1, left]),
                np.stack([a0, am, bm, b1, left - 1]),
                np.stack([am, a1, b0, bm, left - 1])[:, ~own],
            ],
            axis=1,
        )
        alone = (out[0] == out[2]) & (out[1] - out[0] < 2)
        return out[:, (out[1] > out[0]) & (out[3] > out[2]) & (out[4] >= 0) & ~alone]

    def _leaves(self, nodes: np.ndarray, pairs: np.ndarray) -> None:
        ends = np.cumsum(pairs)
        at = 0
        while at < len(ends):  # at most so many leaf pairs at once
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + 500_000, "right")))
            part, n = nodes[:, at:to], pairs[at:to]
            if len(n) == 1 and n[0] > 500_000:
                self._product(part[:, 0])
            else:
                which = np.repeat(np.arange(len(n)), n)
                rest = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = (part[3] - part[2])[which]
                self._link(part[0][which] + rest // wide, part[2][which] + rest % wide)
            at = to

    def _product(self, node: np.ndarray) -> None:
        """A pair of equal keys' nodes with very many leaves: row by row."""
        others = np.arange(node[2], node[3])
        for i in range(node[0], node[1]):
            self._link(np.full(len(others), i), others)

    def _link(self, u: np.ndarray, v: np.ndarray) -> None:
        ok = (u < v) & (self.parts.root[u] != self.parts.root[v])
        u, v = u[ok], v[ok]
        ok = np.bitwise_count(self.keys[u] ^ self.keys[v]) <= self.budget
        u, v = u[ok], v[ok]
        if self.accept is not None and len(u):
            ok = self.accept(u, v)
            u, v = u[ok], v[ok]
        if len(u):
            self.parts.connect(u, v)


def block_offsets(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the budget+1 blocks."""
    cuts = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rotated(key: str, offset: int) -> str:
    return f"(shiftleft({key}, {offset}) | shiftrightunsigned({key}, {64 - offset}))" if offset else key


def trie_memberships(nodes: DataFrame, budget: int, keys: tuple[str, ...] = ("key",), signature: str | None = None, accept=None) -> DataFrame:
    """node, part: for each rotation in which a node has links, the component it belongs to there.

    nodes: node (long) and the key columns. With `accept(signatures, u, v)`, links must also pass it; signatures are
    binary of one length and come as a matrix of bytes.
    """
    ship(nodes.sparkSession)
    blocks = block_offsets(budget)
    depth = min(width for _, width in blocks)
    turned = [
        f"struct({t * len(blocks) + b} as trie, {_rotated(key, offset)} as turned)"
        for t, key in enumerate(keys)
        for b, (offset, _) in enumerate(blocks)
    ]
    extra = [signature] if signature else []
    rows = nodes.selectExpr("node", f"explode(array({', '.join(turned)})) as r", *extra).selectExpr("node", "r.trie", "r.turned", *extra)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "trie", F.expr(f"shiftrightunsigned(turned, {64 - depth})")).sortWithinPartitions("trie", "turned")

    def begins(whole: pa.Table) -> np.ndarray:
        """Where subtrees begin. Keys whose top bits are equal have the same sign, so they ascend as unsigned too."""
        trie, keys = whole["trie"].to_numpy(), whole["turned"].to_numpy().astype(np.int64).view(np.uint64)
        top = keys >> np.uint64(64 - depth)
        return np.flatnonzero(np.concatenate([[True], (trie[1:] != trie[:-1]) | (top[1:] != top[:-1])]))

    def joined(whole: pa.Table, lo: np.ndarray) -> pa.RecordBatch:
        trie, node = whole["trie"].to_numpy(), whole["node"].to_numpy()
        keys = whole["turned"].to_numpy().astype(np.int64).view(np.uint64)
        test = None
        if accept is not None:
            signatures = np.frombuffer(b"".join(whole[signature].to_pylist()), dtype=np.uint8).reshape(len(keys), -1)
            test = lambda u, v: accept(signatures, u, v)
        root = TrieJoin(keys, budget, test).run(lo, np.append(lo[1:], len(keys)), depth).root
        sizes = np.bincount(root, minlength=len(root))
        linked = sizes[root] > 1
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        names = [f"{t}:{k}" for t, k in zip(trie[linked].tolist(), least[root[linked]].tolist(), strict=True)]
        return pa.record_batch([pa.array(node[linked]), pa.array(names, pa.string())], names=["node", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n, limit = 0, SUBTREE_ROWS
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < limit:
                continue
            whole = pa.Table.from_batches(waiting)
            lo = begins(whole)
            if lo[-1]:
                yield joined(whole.slice(0, lo[-1]), lo[:-1])
            waiting = whole.slice(lo[-1]).combine_chunks().to_batches()
            n -= int(lo[-1])
            limit = max(SUBTREE_ROWS, 2 * n)
        if n:
            whole = pa.Table.from_batches(waiting)
            yield joined(whole, begins(whole))

    return rows.mapInArrow(run, "node long, part string")


def merge_memberships(memberships: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over shared parts. Rounds of minimum labels with shortcuts.

    Every round's labels are written to the shared folder, and those before deleted; the driver sees one count a round.
    """
    spark = memberships.sparkSession
    links = stored(memberships.distinct(), "memberships")
    path = f"{shared_dir(spark)}/labels"
    labels = stored(links.select("node").distinct().select("node", F.col("node").alias("label")), "labels", path=path)
    while True:
        of_part = links.join(labels, "node").groupBy("part").agg(F.min("label").alias("least"))
        # The shortcut is taken by parts, of which a large component has few; its nodes would all meet under one label.
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        of_part = of_part.join(up, of_part["least"] == up["up"], "left").select("part", F.coalesce("higher", "least").alias("least"))
        short = links.join(of_part, "part").groupBy("node").agg(F.min("least").alias("label"))
        before, path = path, f"{shared_dir(spark)}/labels"
        new = stored(short, "labels", path=path)
        changed = new.join(labels.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count()
        remove(spark, before)
        labels = new
        if not changed:
            return labels


def near_duplicate_components(docs: DataFrame, budget: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    # A table of its own, so that the join below stands alone in its stage and Spark can split a key with many copies.
    nodes = stored(prints.groupBy("key").agg(F.min("doc_id").alias("least")), "nodes")
    labels = merge_memberships(trie_memberships(nodes.select(F.col("key").alias("node"), "key"), budget))
    linked = nodes.join(labels, nodes["key"] == labels["node"]).select("key", "label", "least")
    firsts = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of_key = linked.select("key", "label").join(firsts, "label").select("key", "component_id")
    named = stored(nodes.join(of_key, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "components")
    return prints.join(named, "key").select("doc_id", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-copy sketch: words a shingle, bands of minimum hashes and minima a band.
COPY_WIDTH, BANDS, BAND_MINIMA = 5, 32, 4
#: Bits in which the fingerprints of candidates may differ.
COPY_BUDGET = 3
MINIMA = BANDS * BAND_MINIMA
#: The least similarity of copies, as a fraction.
SIMILARITY = (4, 5)
#: Minima, by two bits of each, that must agree for a candidate; at SIMILARITY fewer do with a chance of 1.4e-8.
LEAST_EQUAL = 84
#: Shingles compared with a set at once.
SHINGLES_AT_ONCE = 1 << 21
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace())
_FACTORS = (np.random.default_rng(11).integers(1, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LOW_BITS = np.uint64(0x5555555555555555)


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending hashes of the different five-word shingles. Words are lower-cased and lose ASCII marks."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()
    return np.unique(shingle_hashes(words, COPY_WIDTH))


def copy_sketch(shingles: np.ndarray) -> tuple[bytes, np.ndarray, bytes]:
    """A digest of the set, a key for each band of minimum hashes, and two bits of each minimum hash.

    A pair at SIMILARITY has no band in common with a chance of (1 - 0.8 ** BAND_MINIMA) ** BANDS, 4.7e-8.
    """
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _FACTORS).min(axis=0), out=least)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for minima in least.reshape(BANDS, BAND_MINIMA).T:
        keys = (keys ^ minima) * _FACTORS[0]
        keys ^= keys >> np.uint64(29)
    low = (least >> np.uint64(16)).astype(np.uint8)
    return xxhash.xxh3_128_digest(shingles.tobytes()), keys.view(np.int64), np.packbits(np.stack([low >> 1 & 1, low & 1], axis=1)).tobytes()


def _sketch_and_print(text: str | None) -> tuple[bytes, np.ndarray, bytes, int]:
    """The copy sketch and the SimHash fingerprint of a text's shingle set."""
    shingles = shingle_set(text)
    return *copy_sketch(shingles), _signed(majority_bits(shingles))


def similar(signatures: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether enough minima agree for a candidate."""
    whole = np.ascontiguousarray(signatures).view(np.uint64)
    out = np.zeros(len(u), dtype=bool)
    for at in range(0, len(u), 100_000):
        x = whole[u[at : at + 100_000]] ^ whole[v[at : at + 100_000]]
        other = np.bitwise_count((x | x >> np.uint64(1)) & _LOW_BITS).sum(axis=1, dtype=np.int64)
        out[at : at + 100_000] = MINIMA - other >= LEAST_EQUAL
    return out


def exact_groups(nodes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one of its group: links are similarities of SIMILARITY or more. `nodes` ascend; equal ones are linked."""
    label = np.searchsorted(nodes, nodes)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    p, q = SIMILARITY
    for i in range(len(sets) - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            if (label == label[0]).all():
                break
            continue
        others = others[q * np.minimum(sizes[others], sizes[i]) >= p * np.maximum(sizes[others], sizes[i])]
        ends = np.cumsum(sizes[others])
        at = 0
        while at < len(others):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SHINGLES_AT_ONCE, "right")))
            part = others[at:to]
            flat = np.concatenate([sets[j] for j in part])
            place = np.searchsorted(sets[i], flat)
            hits = np.concatenate([[0], np.cumsum(sets[i][np.minimum(place, sizes[i] - 1)] == flat)]) if sizes[i] else np.zeros(len(flat) + 1, dtype=np.int64)
            common = np.diff(hits[np.concatenate([[0], ends[at:to] - before])])
            linked = part[(p + q) * common >= p * (sizes[part] + sizes[i])]
            if len(linked):
                joined = np.unique(np.append(label[linked], label[i]))
                label[np.isin(label, joined)] = joined[0]
            at = to
    return label


def verified_memberships(docs: DataFrame, nodes: DataFrame, units: DataFrame) -> DataFrame:
    """node, part: the groups of candidates again, by links whose exact similarity is SIMILARITY or more.

    docs: doc_id, text, tie; units: node and unit, in which candidates are compared with each other.
    """
    ship(docs.sparkSession)
    of_node = units.groupBy("node").agg(F.collect_set("unit").alias("units"))  # at most one for each band
    places = nodes.select("node", "first").join(of_node, "node")
    same = docs["doc_id"].eqNullSafe(places["first.doc_id"]) & (docs["tie"] == places["first.tie"])
    members = docs.join(places, same).select("node", "text", "units")

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], names=["node", "shingles", "units"])

    rows = map_batches(members, hashed, "node long, shingles binary, units array<bigint>")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("node", "shingles", F.explode("units").alias("unit")).repartition(parts, "unit").sortWithinPartitions("unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in batches:
            unit, node, shingles = batch.column("unit").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")
            for i, key in enumerate(unit):
                if key != now:
                    yield from linked(nodes, sets)
                    now, nodes, sets = key, [], []
                nodes.append(node[i])
                sets.append(np.frombuffer(shingles[i].as_py(), dtype=np.uint64))
        yield from linked(nodes, sets)

    def linked(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A unit at a time is in memory."""
        if len(nodes) < 2:
            return
        of = np.array(nodes)
        label = exact_groups(of, sets)
        more = np.bincount(label, minlength=len(of))[label] > 1
        yield pa.record_batch([pa.array(of[more]), pa.array(of[label[more]].astype(str).tolist(), pa.string())], names=["node", "part"])

    return rows.mapInArrow(run, "node long, part string")


def distinct_rows(docs: DataFrame) -> DataFrame:
    """All columns; of rows with the same doc_id and text one."""
    packed = docs.select(F.struct(*columns(docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_tie().alias("tie"))
    again = packed.groupBy("id", "tie").count().where(F.col("count") > 1).drop("count")
    if not again.limit(1).count():
        return docs
    again = stored(again, "repeated").withColumnsRenamed({"id": "id2", "tie": "tie2"})
    same = packed["id"].eqNullSafe(again["id2"]) & (packed["tie"] == again["tie2"])
    once = packed.join(again, same, "left_semi").dropDuplicates(["id", "tie"])
    return stored(packed.join(again, same, "left_anti").unionByName(once).select("row.*"), "distinct_rows")


def text_tie() -> Column:
    """96 bits that tell texts apart, null from empty included."""
    return F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, tie, first, component_id: documents linked by a similarity of five-word shingles of 0.8 or more.

    Candidates come from the trie self-join of the SimHash fingerprints within COPY_BUDGET bits; as a pair at SIMILARITY
    differs in ten of 64 bits on average, the trie also takes the bands of minimum hashes as keys, equal in one of which
    the further pairs are. Candidates agree in enough minima; what they connect in a subtree is compared again by exact
    similarities, and the forests of these links are merged by minimum labels. Texts without words are copies of each other. `first` has the doc_id and
    tie of the document of the component that comes first: the smallest doc_id (nulls last), then the least tie. Rows
    are told apart by doc_id and text_tie; component_id is the doc_id of `first`.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digests, keys, minima, prints = zip(*(_sketch_and_print(t) for t in batch.column(1).to_pylist()), strict=True)
        bands = [pa.array(k) for k in np.stack(keys, axis=1)]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), *bands, pa.array(minima, pa.binary()), pa.array(prints, pa.int64())], names=["doc_id", "tie", "digest", *names, "minima", "print"])

    names = [f"key{t}" for t in range(BANDS)]
    tie = "struct<a:bigint,b:int>"
    kind = ", ".join([f"doc_id long, tie {tie}, digest binary", *[f"{n} long" for n in names], "minima binary", "print long"])
    docs = docs.select("doc_id", "text", text_tie().alias("tie"))
    sketched = stored(map_batches(docs, run, kind), "copy_sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    nodes = sketched.groupBy("digest", *names, "minima", "print").agg(first)
    # Any distinct numbers do, as they are read from the table only.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "copy_nodes")
    near = trie_memberships(nodes.select("node", "print", "minima"), COPY_BUDGET, ("print",), "minima", similar)
    candidates = near.unionByName(trie_memberships(nodes.select("node", *names, "minima"), 0, tuple(names), "minima", similar))
    # What a band or a subtree connects is a unit under its smallest node alone: most bands give the same ones.
    units = stored(candidates.selectExpr("node", "cast(substring_index(part, ':', -1) as bigint) as unit").distinct(), "copy_units")
    labels = merge_memberships(verified_memberships(docs, nodes, units))
    linked = nodes.select("node", "digest", "first").join(labels, "node")
    firsts = linked.groupBy("label").agg(F.min("first").alias("least"))
    of_node = linked.select("digest", "label").join(firsts, "label").select("digest", "least")
    named = nodes.select("digest", "first").join(of_node, "digest", "left").select("digest", F.coalesce("least", "first").alias("first"))
    named = stored(named, "copy_groups")
    return sketched.select("doc_id", "tie", "digest").join(named, "digest").select("doc_id", "tie", "first", F.col("first.doc_id").alias("component_id"))


def keep_one_of_copies(docs: DataFrame) -> DataFrame:
    """All columns of the documents but near copies of one that comes before them.

    The smallest doc_id of a group stays; one without a doc_id only if none has one. Of rows with the same doc_id and
    text one stays; rows with the same doc_id and other texts are documents of their own. An empty table stays empty.
    """
    docs = distinct_rows(docs)
    copies = near_copies(docs).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))))
    gone = copies.select(F.col("doc_id").alias("id2"), F.col("tie").alias("tie2"))
    packed = docs.select(F.struct(*columns(docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_tie().alias("tie"))
    return packed.join(gone, packed["id"].eqNullSafe(gone["id2"]) & (packed["tie"] == gone["tie2"]), "left_anti").select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))

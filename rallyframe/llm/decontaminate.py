"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared by their letters and digits, lower-cased: ASCII marks and white space don't count. An item of n such
bytes may occur with up to k = n // ERROR_EVERY edits. Cut into k+1 pieces, one piece at least is then untouched, so
exact hits of pieces (one automaton over all of them) give every place where the item can be; there Myers'
bit-parallel distance, an item a machine-word vector of any length, decides within the budget. A piece that an item holds
several times gives one range of places for each hit, so a periodic text costs no more than its length.

Items come to the workers in blocks of at most BLOCK_BYTES, whatever the benchmark's size; each block passes over all
documents. An item to which that rule gives no edit (fewer than ERROR_EVERY letters and digits) is found as an exact copy
that begins and ends where words of the text do: within other words such short runs of letters stand by chance.

Cases: null and empty texts and items match nothing; equal items are all reported; repeated rows are each reported;
an item found many times in a document gives one row, its nearest hit (the leftmost of equals); an empty table of
either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import map_batches, schema_of, table

ERROR_EVERY = 16
BLOCK_BYTES = 4 << 20
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Marks and white space as one byte, all else as another.
_EDGES = bytes(32 if b in _MARKS else 120 for b in range(256))


def squeezed(text: str | None) -> bytes:
    """Lower case without ASCII marks and white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _MARKS)


def word_edges(text: str) -> set[int]:
    """Places in the squeezed text where a word begins or ends."""
    edges, at = {0}, 0
    for word in text.lower().encode("utf-8", "surrogatepass").translate(_EDGES).split():
        at += len(word)
        edges.add(at)
    return edges


class Pattern:
    """An item with its pieces and the bit vectors of Myers' method."""

    def __init__(self, item: bytes) -> None:
        self.item, self.n = item, len(item)
        self.budget = self.n // ERROR_EVERY
        cuts = [i * self.n // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.masks: dict[int, int] = {}
        for i, b in enumerate(item):
            self.masks[b] = self.masks.get(b, 0) | 1 << i

    def distance(self, text: bytes) -> tuple[int, int]:
        """Least edits between the item and any part of the text, and where the first such part ends."""
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score = full, 0, self.n
        best, end = self.n, 0
        masks = self.masks
        for at, b in enumerate(text, 1):
            eq = masks.get(b, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            plus = mh | ~(xv | ph) & full
            minus = ph & xv
            if score < best:
                best, end = score, at
        return best, end


class Finder:
    """All patterns of a block behind one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.patterns = [(i, Pattern(t)) for i, t in items if t]
        places: dict[bytes, dict[int, tuple[int, int]]] = {}
        for n, (_, p) in enumerate(self.patterns):
            for offset, piece in p.pieces:
                first, _ = places.setdefault(piece, {}).get(n, (offset, offset))
                places[piece][n] = first, offset
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), [(n, *offsets) for n, offsets in where.items()]))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, edits, end of the hit in the squeezed text), an item once."""
        raw = squeezed(text)
        if not self.patterns or not raw:
            return []
        starts: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(raw.decode("latin-1")):
            for n, first, last in where:
                starts.setdefault(n, []).append((end + 1 - size - last, end + 1 - size - first))
        out, edges = [], None
        for n, places in starts.items():
            item_id, p = self.patterns[n]
            if not p.budget:
                edges = word_edges(text) if edges is None else edges
                whole = [a for a, _ in places if a in edges and a + p.n in edges]
                if whole:
                    out.append((item_id, 0, min(whole) + p.n))
                continue
            best = None
            for a, b in _windows(places, p, len(raw)):
                edits, end = p.distance(raw[a:b])
                if edits <= p.budget and (best is None or edits < best[0]):
                    best = (edits, a + end)
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


def _windows(places: list[tuple[int, int]], p: Pattern, size: int) -> Iterator[tuple[int, int]]:
    """Where the item can be, from the first and last place where it can begin for each hit; overlapping ones together."""
    a = b = -1
    for first, last in sorted(set(places)):
        lo, hi = max(0, first - p.budget), min(size, last + p.n + p.budget)
        if b < 0:
            a, b = lo, hi
        elif lo <= b:
            b = max(b, hi)
        else:
            yield a, b
            a, b = lo, hi
    if b >= 0:
        yield a, b


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Items, squeezed, a block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = squeezed(row["text"])
        if block and size + len(item) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, hit_end: every document that holds an item."""
    kind = "doc_id long, item_id long, edits int, hit_end long"
    rows = docs.select("doc_id", "text")
    found = None
    for block in item_blocks(benchmark, block_bytes):
        part = map_batches(rows, _finding(block), kind)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], kind)


def _finding(block: list[tuple[int, bytes]]):
    cache: list[Finder] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Finder(block))
        out = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in cache[0].find(t)]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "edits", "hit_end"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, all columns."""
    names = docs.columns
    at = names.index("text")
    kind = schema_of(docs, names)
    for block in item_blocks(benchmark, block_bytes):
        docs = map_batches(docs, _dropping(block, at), kind)
    return docs


def _dropping(block: list[tuple[int, bytes]], at: int):
    cache: list[Finder] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Finder(block))
        yield batch.filter(pa.array([not cache[0].find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

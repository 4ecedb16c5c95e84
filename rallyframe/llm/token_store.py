"""A content-addressed store of token ids.

Documents become id streams. A rolling hash over the last ids cuts each stream into chunks, so equal passages give
equal chunks wherever they begin; a chunk is named by the digest of its bytes and stored once. A recipe lists the
chunks of a document in order, with its Merkle root and the number of ids of all documents before it. A manifest holds
the Merkle root of each range of recipes. Layout below one folder:

    chunks/    digest binary(16), n_ids int, ids binary (little-endian, 2 or 4 bytes an id, by the vocabulary's size)
    recipes/   doc_id, start, n_tokens, root, chunks array of digests; ascending doc_id inside range folders
    manifest/  range, n_documents, n_ids, root

Reading back never trusts a name: digests are taken anew from the stored bytes, and a document counts as verified
only if its chunks are all there, its recipe leads to the stored root, the lengths add up, and its range of recipes,
starts included, is the one of the manifest, which has no range without recipes. A store without a manifest folder is
verified by document alone.

Cases: null text encodes like the empty one; the empty text has the end id alone; repeated rows each get a recipe, in
the order of (doc_id, hash of the text); nulls in doc_id come first; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import pieces
from .ordering import range_bounds, range_of
from .runtime import env_cpu_single, map_batches, remove, shared_dir, ship, stored, table

#: Ids under the rolling hash, mean ids of a chunk (a power of two), most ids of a chunk.
WINDOW, MEAN_IDS, MOST_IDS = 4, 256, 4096
#: Strings, and bytes of them and their ids, beyond which a cache starts anew with the next batch.
CACHE_PIECES, CACHE_BYTES = 200_000, 16 << 20
#: An empty table leaves no file to take this from.
RECIPES = "doc_id long, start long, n_tokens long, root binary, chunks array<binary>, range int"
MANIFEST = "range int, n_documents long, n_ids long, root binary"
#: A space before white space or at the end; a text with one is cut by `pieces`.
UNSAFE = r" (?:[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
#: Pieces whose pre-tokens are their runs of letters, of digits, of marks and single line ends: no apostrophes (they begin
#: endings), no other white space, nothing but Latin letters, on which all libraries agree.
_PLAIN = r"[\x21-\x26\x28-\x7e\x{a1}-\x{24f}]"
SIMPLE = rf"\A{_PLAIN}+(?:\n{_PLAIN}+)*\n?\z"
_LETTERS, _DIGITS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
LONE = rf"\A(?:[{_LETTERS}]+|[{_DIGITS}]+)\z"
RUN = rf"([{_LETTERS}]+|[{_DIGITS}]+|\n|[^\n{_LETTERS}{_DIGITS}]+)"


def _written() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes as characters, for bytes read as latin-1.

    Printable bytes stand for themselves, the others for the characters from 256 on in ascending order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


WRITTEN = _written()
#: The same with a space as the mark that parts words; a written space precedes each.
SPACED, PARTED = WRITTEN | {32: " \u0120"}, WRITTEN | {32: " "}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... of `sizes` many each, one run behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _sequences(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Id sequences as binary values, from where each begins and the last ends."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * ids.itemsize), pa.py_buffer(ids.tobytes())])


def _strung(sequences: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Their ids one behind the other, and where each begins and the last ends."""
    if not len(sequences):
        return np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)
    _, offsets, raw = sequences.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[sequences.offset : sequences.offset + len(sequences) + 1] // kind.itemsize
    ids = np.frombuffer(raw, dtype=kind) if raw else np.zeros(0, dtype=kind)
    return ids[offsets[0] : offsets[-1]], offsets - offsets[0]


class Known:
    """Different strings in the order of their first sight, with the ids of each: a few bytes a string, no Python objects."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def numbers(self, words: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> np.ndarray:
        """The places of strings in `ids`; `learn` gives the ids of those that are new."""
        before = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        if len(coded.dictionary) > before:
            self.ids = pa.concat_arrays([self.ids, learn(coded.dictionary[before:])])
            self.words = coded.dictionary
        return coded.indices.to_numpy()[before:]

    def full(self) -> bool:
        return len(self.words) > CACHE_PIECES or self.words.nbytes + self.ids.nbytes > CACHE_BYTES


def spelled(words: pa.Array) -> str:
    """Strings in one, parted by spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


class PieceEncoder:
    """The tokenizers library behind a cache of pre-tokens.

    A batch is cut at spaces, which pre-tokens never cross. Its pieces are numbered by Arrow behind those known from
    earlier batches, and so are the runs of letters, digits and marks of new pieces; only new runs go to the library's
    merges. The ids of the whole batch are then gathered at once.
    """

    def __init__(self, path: str) -> None:
        env_cpu_single()
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: A text that holds one of these goes to the library whole: white space around them is cut otherwise.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The same merges for pre-tokens already cut, their bytes written as the vocabulary writes them.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # one character for each byte
        #: Pieces and runs, each with a space in front (True) or none (False).
        self.pieces, self.runs = {True: Known(), False: Known()}, {True: Known(), False: Known()}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def _parted(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The ids of each part, from where the parts' bytes end."""
        return _sequences(ids, np.append(0, np.searchsorted(np.cumsum(self.width[ids]), ends) + 1))

    def _learn_runs(self, new: pa.Array, spaced: bool) -> pa.Array:
        written = spelled(new).encode().decode("latin-1").translate(SPACED if spaced else PARTED)
        if spaced:
            written = "\u0120" + written
        ids = np.array(self.merges.encode_batch_fast([written], add_special_tokens=False)[0].ids, dtype=self.kind)
        spaces = np.flatnonzero(np.frombuffer(written.encode("utf-32-le"), dtype="<u4") == 32)
        return self._parted(ids, np.append(spaces, len(written)) - np.arange(len(new)))  # one character a byte

    def _learn_pieces(self, new: pa.Array, spaced: bool) -> pa.Array:
        simple, lone = (pc.match_substring_regex(new, x).to_numpy(zero_copy_only=False) for x in (SIMPLE, LONE))
        cut = pc.split_pattern(pc.ascii_rtrim(pc.replace_substring_regex(new.filter(pa.array(simple & ~lone)), RUN, r"\1 "), " "), " ")
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        alone = int(lone.sum())
        runs = pa.concat_arrays([new.filter(pa.array(lone)), cut.flatten()])
        at = np.concatenate([np.arange(alone), alone + at])
        front = np.zeros(len(runs), dtype=bool)
        front[at[:-1]] = spaced
        rows = np.zeros(len(runs), dtype=np.int64)
        for how, mine in ((True, front), (False, ~front)):
            rows[mine] = self.runs[how].numbers(runs.filter(pa.array(mine)), lambda words, how=how: self._learn_runs(words, how))
        rows[~front] += len(self.runs[True].ids)
        ids, offsets = _strung(pa.concat_arrays([self.runs[True].ids, self.runs[False].ids]).take(pa.array(rows)), self.kind)

        others = new.filter(pa.array(~simple)).to_pylist()
        if not others:
            whole = _sequences(np.zeros(0, dtype=self.kind), np.zeros(1))
        elif spaced:
            whole = self._parted(self._ids(" " + " ".join(others)), np.cumsum([1 + len(p.encode("utf-8", "surrogatepass")) for p in others]))
        else:
            each = [self._ids(p) for p in others]
            whole = _sequences(_joined(each, self.kind), np.cumsum([0, *map(len, each)]))
        order = np.concatenate([np.flatnonzero(lone), np.flatnonzero(simple & ~lone), np.flatnonzero(~simple)])
        return pa.concat_arrays([_sequences(ids, offsets[at]), whole]).take(pa.array(np.argsort(order)))

    def _gathered(self, lists: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts cut into pieces, and how many each has."""
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten()
        inner = np.ones(len(values), dtype=bool)
        inner[at[:-1]] = False
        rows = np.zeros(len(values), dtype=np.int32)
        for spaced, mine in ((True, inner), (False, ~inner)):
            rows[mine] = self.pieces[spaced].numbers(values.filter(pa.array(mine)), lambda new, spaced=spaced: self._learn_pieces(new, spaced))
        rows[~inner] += len(self.pieces[True].ids)
        pool = [self.pieces[True].ids, self.pieces[False].ids]
        if end_id is not None:
            rows = np.insert(rows, at[1:], sum(map(len, pool)))
            at = at + np.arange(len(at))
            pool.append(_sequences(np.array([end_id], dtype=self.kind), np.array([0, 1])))
        ids, offsets = _strung(pa.concat_arrays(pool).take(pa.array(rows)), self.kind)
        return ids, np.diff(offsets[at])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls count as empty) one behind the other, and how many each has."""
        for known in (self.pieces, self.runs):
            known.update({spaced: Known() for spaced, own in known.items() if own.full()})
        texts = texts.cast(pa.string()).fill_null("")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), dtype=bool)
        for x in self.special:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        parts, order = [], []
        for kind, mine in enumerate((~unsafe & ~special, unsafe & ~special, special)):
            if not mine.any():
                continue
            own = texts.filter(pa.array(mine))
            if kind == 0:
                parts.append(self._gathered(pc.split_pattern(own, " "), end_id))
            elif kind == 1:
                parts.append(self._gathered(pa.array([pieces(t) for t in own.to_pylist()], pa.list_(pa.string())), end_id))
            else:
                end = [] if end_id is None else [end_id]
                each = [np.append(self._ids(t), np.array(end, dtype=self.kind)) for t in own.to_pylist()]
                parts.append((_joined(each, self.kind), np.array(list(map(len, each)), dtype=np.int64)))
            order.append(np.flatnonzero(mine))
        if len(parts) == 1:
            return parts[0]
        ids, sizes = _joined([p for p, _ in parts], self.kind), _joined([n for _, n in parts], np.dtype(np.int64))
        place = np.argsort(_joined(order, np.dtype(np.int64)))
        return ids[ragged((np.cumsum(sizes) - sizes)[place], sizes[place])], sizes[place]


def _joined(parts: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *parts])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_points(ids: np.ndarray) -> list[int]:
    """Chunk ends of one stream. A chunk ends where the rolling hash of the last WINDOW ids hits, or at MOST_IDS."""
    return cut_streams(ids, np.array([len(ids)]))[0].tolist()


def cut_streams(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of streams that lie one behind the other, and each stream's number of chunks; no hash spans two."""
    total = len(ids)
    hits = np.zeros(0, dtype=np.int64)
    if total >= WINDOW:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        rolled = mixed[: total - WINDOW + 1].copy()
        for j in range(1, WINDOW):
            rolled = rolled * np.uint64(0x100000001B3) + mixed[j : total - WINDOW + 1 + j]
        hits = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(MEAN_IDS - 1) == 0) + WINDOW
    upto = np.cumsum(sizes)
    begins = upto - sizes
    stream = np.searchsorted(upto, hits, "left")  # a hit at a stream's end is that stream's
    hits = hits[hits - begins[stream] >= WINDOW] if len(hits) else hits
    ends = np.unique(np.concatenate([hits, upto[sizes > 0]]))
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // MOST_IDS  # cuts inside a gap, from its start on
    if more.any():
        inner = np.repeat(ends - gaps, more) + MOST_IDS * (ragged(np.zeros(len(more), dtype=np.int64), more) + 1)
        ends = np.sort(np.concatenate([ends, inner]))
    return ends, np.bincount(np.searchsorted(upto, ends, "left"), minlength=len(sizes))


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class Merkle:
    """Root over a sequence of digests in memory that grows with its logarithm."""

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.peaks and self.peaks[-1][0] == level:
            leaf = digest(b"\x01" + self.peaks.pop()[1] + leaf)
            level += 1
        self.peaks.append((level, leaf))

    def root(self) -> bytes:
        top = b""
        for _, peak in reversed(self.peaks):
            top = digest(b"\x01" + peak + top) if top else peak
        return top or digest(b"")


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _shift_tables() -> np.ndarray:
    """For each k, four tables of 256 that put 2 ** k zero bytes behind a message of which they are given the CRC-32."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0)) ^ bits >> np.uint32(1)
    columns = bits.copy()
    for _ in range(8):  # eight zero bits
        columns = _linear(one, columns)
    out = []
    for _ in range(48):
        out.append([_linear(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * place)) for place in range(4)])
        columns = _linear(columns, columns)
    return np.array(out)


def _linear(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map that takes bit i to columns[i]."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), columns[i], np.uint32(0))
    return out


_SHIFT = _shift_tables()


def crc32_joined(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC-32s of concatenations of `counts` parts each, from the CRC-32s and sizes of the parts in a row."""
    crcs, sizes = np.asarray(crcs, dtype=np.uint32).copy(), np.asarray(sizes, dtype=np.int64)
    upto = np.cumsum(sizes)
    last = np.cumsum(counts)
    ends = np.concatenate([[0], upto])[last]
    behind = np.repeat(ends, counts) - upto  # bytes after each part
    for k in range(int(behind.max(initial=0)).bit_length()):
        on = behind >> k & 1 == 1
        x = crcs[on]
        crcs[on] = _SHIFT[k][0][x & 255] ^ _SHIFT[k][1][x >> 8 & 255] ^ _SHIFT[k][2][x >> 16 & 255] ^ _SHIFT[k][3][x >> 24]
    joined = np.concatenate([[0], np.bitwise_xor.accumulate(crcs)]).astype(np.uint32)
    return joined[last] ^ joined[last - counts]


def _binaries(raw: bytes, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one behind the other."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw)])


def encode_chunks(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """doc_id, tie, n_tokens, root, chunks (array of digest, n_ids, ids). docs: doc_id, text, tie."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        ids, counts = enc.encode(batch.column(1), end_id)
        ends, n_chunks = cut_streams(ids, counts)
        raw, item = ids.tobytes(), enc.kind.itemsize
        names = [digest(raw[a:b]) for a, b in zip([0, *(ends[:-1] * item).tolist()], (ends * item).tolist(), strict=False)]
        upto = np.concatenate([[0], np.cumsum(n_chunks)])
        roots = [merkle_root(names[a:b]) for a, b in zip(upto.tolist(), upto[1:].tolist(), strict=False)]
        chunks = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(np.diff(ends, prepend=0).astype(np.int32)), _binaries(raw, ends * item)], names=["digest", "n_ids", "ids"])
        lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), chunks)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), lists], names=["doc_id", "tie", "n_tokens", "root", "chunks"])

    return map_batches(docs.select("doc_id", "text", "tie"), run, "doc_id long, tie long, n_tokens long, root binary, chunks array<struct<digest:binary,n_ids:int,ids:binary>>", rows=2048)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0) -> None:
    """Write chunks, recipes and manifest below `path`. The encoded stream is held there only while it is sorted out."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal texts have equal roots, so the text's hash parts rows of one doc_id as well as the root does.
    bounds = range_bounds(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")), "doc_id", "tie", ranges)
    encode_chunks(docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))), tokenizer_path, end_id).write.option("compression", "zstd").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    each = encoded.select(F.explode("chunks").alias("c")).select("c.*")
    each.groupBy("digest").agg(F.first("n_ids").alias("n_ids"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = encoded.select("doc_id", "tie", "n_tokens", "root", F.col("chunks.digest").alias("chunks")).withColumn("range", range_of("doc_id", "tie", bounds))
    sums = recipes.groupBy("range").agg(F.sum("n_tokens").alias("total"))
    # One row a range, so this window is as small as the number of ranges.
    before = sums.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("doc_id", "tie", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(before), "range")
    placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "root", "chunks", "range").write.partitionBy("range").parquet(f"{path}/recipes")
    manifest(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).drop("first", "in_order").write.parquet(f"{path}/manifest")
    remove(spark, f"{path}/encoded")


def manifest(recipes: DataFrame) -> DataFrame:
    """range, n_documents, n_ids and the Merkle root over the range's documents in order, a row after the other.

    Beside them the first start, and whether each document starts where the one before ends.
    """
    ship(recipes.sparkSession)
    parts = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = recipes.select("range", "start", "n_tokens", "root").repartition(parts, "range").sortWithinPartitions("range", "start", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, n, ids, first, in_order = None, Merkle(), 0, 0, 0, True
        done: list[tuple] = []
        for batch in batches:
            for part, start, n_tokens, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if n:
                        done.append((now, n, ids, tree.root(), first, in_order))
                    now, tree, n, ids, first, in_order = part, Merkle(), 0, 0, start, True
                in_order = in_order and start == first + ids
                tree.add(root)
                n, ids = n + 1, ids + n_tokens
        if n:
            done.append((now, n, ids, tree.root(), first, in_order))
        if done:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["range", "n_documents", "n_ids", "root", "first", "in_order"])

    return rows.mapInArrow(run, f"{MANIFEST}, first long, in_order boolean")


def sound_ranges(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """range, as_listed: whether the recipes read back are those of the manifest, a row for each of its ranges."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return recipes.select("range").distinct().withColumn("as_listed", F.lit(True))
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row a range, so these windows are as small as the number of ranges.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = listed.withColumn("before", before)
    both = listed.alias("l").join(manifest(recipes).alias("r"), "range", "left")
    same = "r.n_documents = l.n_documents and r.n_ids = l.n_ids and r.root = l.root and r.first = l.before and r.in_order"
    each = both.selectExpr("range", f"coalesce({same}, false) as same", "r.root is null as lost")
    return each.withColumn("any_lost", F.max("lost").over(Window.partitionBy(F.lit(0)))).selectExpr("range", "same and not any_lost as as_listed")


def _chunk_facts(chunks: DataFrame) -> DataFrame:
    """digest, whether the stored bytes have it, and their number of ids and CRC-32 as 32-bit integers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, counts, stored_ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
        sizes = pc.binary_length(stored_ids).to_numpy().astype(np.int64)
        narrow = sizes == 2 * counts.astype(np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(stored_ids.to_pylist()), dtype=np.uint8)
        # All ids of a batch become 32-bit at once where each chunk has them in 16.
        wide, ratio = (raw.view("<u2").astype("<u4").view(np.uint8), 2) if narrow.all() else (raw, 1)
        n_ids = sizes // np.where(narrow, 2, 4)
        raw, wide = memoryview(raw), memoryview(wide)
        sound, crcs = [], []
        for name, a, b, two in zip(names, (ends - sizes).tolist(), ends.tolist(), narrow.tolist(), strict=True):
            sound.append(digest(raw[a:b]) == name)
            crcs.append(zlib.crc32(np.frombuffer(raw[a:b], dtype="<u2").astype("<u4") if two and ratio == 1 else wide[ratio * a : ratio * b]))
        sound = np.array(sound, dtype=bool) & (narrow | (sizes == 4 * counts.astype(np.int64)))
        yield pa.record_batch([batch.column(0), pa.array(sound), pa.array(n_ids, pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "sound", "n", "crc"])

    return map_batches(chunks.select("digest", "n_ids", "ids"), run, "digest binary, sound boolean, n int, crc long", rows=4096)


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified, from the files alone.

    A document's checksum comes from its chunks' checksums in recipe order, so the ids themselves are read once and
    not shuffled.
    """
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root", "chunks", "range")
    facts = _chunk_facts(spark.read.parquet(f"{path}/chunks"))
    used = recipes.select("start", "root", F.posexplode("chunks").alias("place", "digest"))
    of_doc = used.join(facts, "digest", "left").groupBy("start", "root").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "sound", "n", "crc"))).alias("parts"))
    listed = F.broadcast(stored(sound_ranges(spark, path, recipes), "sound_ranges"))  # one row a range
    rows = recipes.drop("chunks").join(of_doc, ["start", "root"], "left").join(listed, "range", "left")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start, root, doc_id, n_tokens, parts, listed = (batch.column(i) for i in range(6))
        own = parts.flatten()
        counts = np.nan_to_num(pc.list_value_length(parts).to_numpy(zero_copy_only=False)).astype(np.int64)
        digests, (sound, n, crcs) = own.field("digest").to_pylist(), (own.field(x).fill_null(none).to_numpy(zero_copy_only=False) for x, none in (("sound", False), ("n", 0), ("crc", 0)))
        upto = np.concatenate([[0], np.cumsum(counts)])
        total = np.diff(np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[upto])
        wrong = np.diff(np.concatenate([[0], np.cumsum(~sound.astype(bool))])[upto])
        joined = crc32_joined(crcs, 4 * n.astype(np.int64), counts)
        roots = [merkle_root(digests[a:b]) for a, b in zip(upto.tolist(), upto[1:].tolist(), strict=False)]
        same = np.array([a == b for a, b in zip(roots, root.to_pylist(), strict=True)], dtype=bool)
        known = listed.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        verified = known & same & (wrong == 0) & (total == n_tokens.to_numpy())
        yield pa.record_batch([doc_id, start, pa.array(total), pa.array(joined.astype(np.int64)), pa.array(counts.astype(np.int32)), pa.array(verified)], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"])

    return map_batches(rows.select("start", "root", "doc_id", "n_tokens", "parts", "as_listed"), run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, verified boolean", rows=2048)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of long): whole documents put together again from recipes and chunks."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("doc_id", "start", "root", F.posexplode("chunks").alias("place", "digest"))
    chunks = spark.read.parquet(f"{path}/chunks")
    parts = recipes.join(chunks, "digest").groupBy("doc_id", "start", "root").agg(F.array_sort(F.collect_list(F.struct("place", "n_ids", "ids"))).alias("parts"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for own in batch.column(2).to_pylist():
            out.append([i for p in own for i in np.frombuffer(p["ids"], dtype="<u2" if len(p["ids"]) == 2 * p["n_ids"] else "<u4").tolist()])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return map_batches(parts.select("doc_id", "start", "parts"), run, "doc_id long, start long, ids array<long>", rows=256)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token_store"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return verify_store(spark, path)

"""Secret scans: patterns, and a randomness test battery under false-discovery control.

Patterns give the base spans (kinds assign, access and hex). Beyond them, every run of at least MIN_TOKEN letters,
digits and `+ / = _ -` outside a base span is a candidate, and so are its parts of that length: those between inner `=`,
and within these the parts between any of the characters of each entry of SEPARATORS. A candidate's encoding is inferred from its characters, and three tests
ask whether it can be a uniform draw of that alphabet: chi-squared over the alphabet, the number of runs above and
below its middle, and the serial correlation of neighbours. Simes' rule joins their three p-values; a joint one below
ALPHA rejects the candidate. The others are tested against ordinary text by a p-value with two parts: under a bigram
model of the whole corpus, the chance of a likelihood ratio as large in favour of the uniform draw is at most its
inverse (times the number of encodings tried); and it is divided by a weight, twice the battery's joint p-value, which
is 1 on average for uniform draws and less for all else, so that what looks least like a draw needs the most evidence.
Benjamini-Hochberg with these weights then holds the false-discovery rate at Q within each class of lengths, with all
candidates of the class as tests. Of accepted candidates that overlap, the one with the least p-value stays. The added
kind is `random`.

The thresholds come from counts of p-values by class, a few thousand numbers however large the corpus.

Spans are [start, end) of the whole match in code points. Only matches that pass their length count; the length of
assign is that of its value. Letters of assign's pattern match in either case of A-Z only.

Cases: null and empty texts have no spans (the digest of the empty string); repeated rows each give a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import map_batches, ship, stored, table

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % MIN_TOKEN)
#: A run's parts at inner =, with the padding at its end; characters that part these again, by themselves and together.
SEGMENT = re.compile(r"[^=]+(?:=+\Z)?")
SEPARATORS = ("/", "+", "-", "_", "/+", "_-", "/-", "/_", "/+_-")
_PARTS = [(frozenset(chars), re.compile("[^%s]{%d,}" % (re.escape(chars), MIN_TOKEN))) for chars in SEPARATORS]
Q, ALPHA = 0.01, 0.01
#: Classes of lengths by their lower bounds.
CLASSES = (20, 28, 40, 64, 128)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
OTHER = len(SYMBOLS)
_CODE = np.full(256, OTHER, dtype=np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_HEX_BYTES = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_TOKEN_BYTES = bytes(49 if chr(b) in SYMBOLS else 48 for b in range(256))
#: Alphabets in the order in which they are tried.
_UPPER, _LOWER, _DIGIT = SYMBOLS[:26], SYMBOLS[26:52], SYMBOLS[52:62]
ENCODINGS = (
    ("decimal", _DIGIT),
    ("hex", _DIGIT + "abcdef"),
    ("hex upper", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGIT + _LOWER),
    ("base36 upper", _DIGIT + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGIT),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64 for urls", _UPPER + _LOWER + _DIGIT + "-_"),
)
_SETS = [(name, alphabet, frozenset(alphabet)) for name, alphabet in ENCODINGS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if b"1" * HEX_LENGTH in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_order)])


def infer(token: str) -> tuple[str, str] | None:
    """Name and alphabet of the smallest encoding that fits, = at the end aside."""
    used = set(token.rstrip("="))
    return next(((name, alphabet) for name, alphabet, own in _SETS if used <= own), None) if used else None


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity_p(places: np.ndarray, size: int) -> float:
    """Chi-squared over the alphabet, joined to as many equal cells as leave four expected in each."""
    n = len(places)
    cells = max(2, min(size, n // 4))
    seen = np.bincount(places * cells // size, minlength=cells)
    width = np.bincount(np.arange(size) * cells // size, minlength=cells) / size * n
    chi, k = float(((seen - width) ** 2 / width).sum()), cells - 1
    return _upper_normal(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def runs_p(places: np.ndarray, size: int) -> float:
    """Wald and Wolfowitz's runs above and below the alphabet's middle, two-sided."""
    above = places >= size // 2
    n1, n = int(above.sum()), len(places)
    n2 = n - n1
    if not n1 or not n2:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * n1 * n2 / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((above[1:] != above[:-1]).sum())
    return min(1.0, 2 * _upper_normal(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(spread))) if spread > 0 else 1.0


def serial_p(places: np.ndarray) -> float:
    """Correlation of neighbours, two-sided."""
    a, b = places[:-1] - places.mean(), places[1:] - places.mean()
    norm = float(((places - places.mean()) ** 2).sum())
    return 2 * _upper_normal(abs(float((a * b).sum()) / norm) * math.sqrt(len(places))) if norm else 0.0


def simes(ps: list[float]) -> float:
    """A joint p-value of dependent tests."""
    return min(1.0, *[p * len(ps) / i for i, p in enumerate(sorted(ps), 1)])


def battery_p(token: str, alphabet: str) -> float:
    """The battery's joint p-value for a uniform draw."""
    places = np.array([alphabet.index(c) for c in token.rstrip("=")])
    return simes([uniformity_p(places, len(alphabet)), runs_p(places, len(alphabet)), serial_p(places)])


class Bigrams:
    """Log probabilities of a character after another, from counts over the corpus."""

    def __init__(self, counts: dict[int, int]) -> None:
        n = OTHER + 1
        table = np.full(n * n, 0.5)
        for pair, count in counts.items():
            table[pair] += count
        table = table.reshape(n, n)
        self.log = np.log(table / table.sum(axis=1, keepdims=True))

    def log_p(self, token: str, alphabet: str) -> float:
        """Log of the p-value against ordinary text: 0 if the token is no likelier as a uniform draw."""
        token = token.rstrip("=")
        code = _CODE[np.frombuffer(token.encode(), dtype=np.uint8)]
        ordinary = float(self.log[np.concatenate([[OTHER], code[:-1]]), code].sum())
        return min(0.0, ordinary + len(token) * math.log(len(alphabet)) + math.log(len(ENCODINGS)))


def bigram_counts(docs: DataFrame) -> DataFrame:
    """pair (first * (OTHER + 1) + second), n: over all whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OTHER + 1) ** 2, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                text = "\n".join([t for t in batch.column(0).slice(at, 256).to_pylist() if t])
                code = _CODE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
                if len(code) > 1:
                    total += np.bincount(code[:-1] * (OTHER + 1) + code[1:], minlength=len(total))
        pairs = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def parts(run: str) -> list[tuple[int, int]]:
    """Spans of a run and of its parts that are long enough to be candidates."""
    out = {(0, len(run)): None}
    for m in SEGMENT.finditer(run):
        a, b = m.span()
        if b - a < MIN_TOKEN:
            continue
        out[a, b] = None
        used = set(m.group())
        for chars, pattern in _PARTS:
            if not chars.isdisjoint(used):
                out.update(((a + x.start(), a + x.end()), None) for x in pattern.finditer(m.group()))
    return list(out)


def candidates(text: str, base: list[tuple[str, int, int]], model: Bigrams) -> list[dict]:
    """Start, end, class and log p (null where the battery rejects) of tokens and their parts outside base spans."""
    if b"1" * MIN_TOKEN not in text.encode("utf-8", "surrogatepass").translate(_TOKEN_BYTES):
        return []
    out = []
    begins, ends = covered(base)
    for m in TOKEN.finditer(text):
        for lo, hi in parts(m.group()):
            a, b = m.start() + lo, m.start() + hi
            at = bisect.bisect_left(begins, b) - 1
            if at >= 0 and ends[at] > a:
                continue
            token, log_p = text[a:b], None
            found = infer(token)
            if found and len(token.rstrip("=")) >= MIN_TOKEN and (joint := battery_p(token, found[1])) >= ALPHA:
                log_p = min(0.0, model.log_p(token, found[1]) - math.log(2 * joint))
            out.append({"a": a, "b": b, "class": sum(b - a >= c for c in CLASSES) - 1, "log_p": log_p})
    return out


def covered(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that spans in order of their begins cover."""
    begins: list[int] = []
    ends: list[int] = []
    for _, x, y in base:
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            begins.append(x)
            ends.append(y)
    return begins, ends


def strongest(accepted: list[dict]) -> list[dict]:
    """Candidates that don't overlap, the least p-value first."""
    out: list[dict] = []
    begins: list[int] = []
    ends: list[int] = []
    for f in sorted(accepted, key=lambda f: (f["log_p"], f["a"], f["b"])):
        at = bisect.bisect_left(begins, f["b"])
        if at and ends[at - 1] > f["a"]:
            continue
        begins.insert(at, f["a"])
        ends.insert(at, f["b"])
        out.append(f)
    return out


def scan(docs: DataFrame, model: Bigrams) -> DataFrame:
    """doc_id, base (joined spans), found (array of a, b, class, log_p)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans, found = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            spans.append(joined(base))
            found.append(candidates(text or "", base, model))
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("class", pa.int32()), ("log_p", pa.float64())]))
        yield pa.record_batch([batch.column(0), pa.array(spans, pa.string()), pa.array(found, kind)], names=["doc_id", "base", "found"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, base string, found array<struct<a:bigint,b:bigint,class:int,log_p:double>>")


#: Steps of -log10 p in which p-values are counted, and the last step.
STEP, LAST = 0.25, 400


def thresholds(found: DataFrame, q: float = Q) -> dict[int, int]:
    """The least step of -log10 p that Benjamini and Hochberg's procedure accepts, by class of lengths.

    A step counts as its largest p-value, so the rate is never above q.
    """
    step = F.least(F.floor(-F.col("f.log_p") / math.log(10) / STEP), F.lit(LAST)).cast("int")  # least passes over nulls
    step = F.when(F.col("f.log_p").isNull(), -1).otherwise(step).alias("step")
    each = found.select(F.explode("found").alias("f")).select("f.class", step)
    rows = each.groupBy("class", "step").count().collect()  # classes times steps at most
    out: dict[int, int] = {}
    for c in {r["class"] for r in rows}:
        mine = sorted(((r["step"], r["count"]) for r in rows if r["class"] == c), reverse=True)
        tests, seen = sum(n for _, n in mine), 0
        for step, n in mine:
            seen += n
            if step > 0 and 10 ** (-step * STEP) * tests / seen <= q:
                out[c] = step
    return out


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    model = Bigrams({r["pair"]: r["n"] for r in bigram_counts(docs).collect()})  # at most (OTHER + 1) squared rows
    scanned = stored(scan(docs, model), "scanned")
    least = thresholds(scanned, q)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc_id, base, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
            accepted = [f for f in found if f["log_p"] is not None and min(LAST, math.floor(-f["log_p"] / math.log(10) / STEP)) >= least.get(f["class"], LAST + 1)]
            added = [("random", f["a"], f["b"]) for f in strongest(accepted)]
            n = [sum(s[0] == k for s in spans) for k in KINDS[:3]]
            out.append((doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), joined(spans + added), len(added)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return map_batches(scanned, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", rows=4096)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

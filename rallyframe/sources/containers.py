"""The sample index of MP4 files (ISO base media file format): where each encoded frame lies, and when it is shown.

Only box headers and the index box are read, wherever it stands in the file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Reads so many bytes from a place.
Read = Callable[[int, int], bytes]
#: Boxes that hold other boxes on the way to the sample table.
_NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


@dataclass
class SampleIndex:
    """Arrays by sample in the order of the file's decoding."""

    codec: str
    width: int
    height: int
    offsets: np.ndarray
    sizes: np.ndarray
    seconds: np.ndarray  # of presentation
    keys: np.ndarray

    @property
    def frames(self) -> np.ndarray:
        """The place of each sample in the order of presentation."""
        out = np.empty(len(self.seconds), np.int64)
        out[np.argsort(self.seconds, kind="stable")] = np.arange(len(out))
        return out

    @property
    def groups(self) -> np.ndarray:
        """The last key sample at or before each sample: decoding can begin there."""
        return np.maximum.accumulate(np.where(self.keys, np.arange(len(self.keys)), 0))


def _boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte of the content, and end of each box."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", read(at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", read(at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit into the file")
        yield kind, at + head, at + size
        at += size


def _tables(data: bytes, at: int, end: int, found: dict[bytes, bytes]) -> dict[bytes, bytes]:
    for kind, a, b in _boxes(lambda p, n: data[p : p + n], at, end):
        if kind in _NESTS:
            _tables(data, a, b, found)
        else:
            found.setdefault(kind, data[a:b])
    return found


def _numbers(table: bytes | None, kind: str, skip: int = 8) -> np.ndarray:
    return np.frombuffer(table[skip:], kind) if table else np.empty(0, kind)


def sample_index(read: Read, size: int) -> SampleIndex:
    """The first video track's index. Files without one, and those in fragments, raise ValueError."""
    moov = next(((a, b) for kind, a, b in _boxes(read, 0, size) if kind == b"moov"), None)
    if moov is None:
        raise ValueError("no index in the file")
    data = read(moov[0], moov[1] - moov[0])
    for kind, a, b in _boxes(lambda p, n: data[p : p + n], 0, len(data)):
        if kind != b"trak":
            continue
        boxes = _tables(data, a, b, {})
        if boxes.get(b"hdlr", b"")[8:12] == b"vide":
            return _index(boxes)
    raise ValueError("no video track in the file")


def _index(boxes: dict[bytes, bytes]) -> SampleIndex:
    one, n = struct.unpack(">II", boxes[b"stsz"][4:12])
    if not n:
        raise ValueError("no samples in the index; files in fragments have theirs elsewhere")
    sizes = np.full(n, one, np.int64) if one else _numbers(boxes[b"stsz"], ">u4", 12)[:n].astype(np.int64)
    chunks = (_numbers(boxes[b"co64"], ">u8") if b"co64" in boxes else _numbers(boxes[b"stco"], ">u4")).astype(np.int64)
    runs = _numbers(boxes[b"stsc"], ">u4").reshape(-1, 3).astype(np.int64)
    of_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    chunk = np.repeat(np.arange(len(chunks)), of_chunk)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1])
    offsets = chunks[chunk] + before - np.repeat(before[first], np.diff(np.append(first, n)))
    steps = _numbers(boxes[b"stts"], ">u4").reshape(-1, 2).astype(np.int64)
    spans = np.repeat(steps[:, 1], steps[:, 0])[:n]
    shown = np.cumsum(spans) - spans
    if b"ctts" in boxes:
        late = _numbers(boxes[b"ctts"], ">i4").reshape(-1, 2).astype(np.int64)
        shown = shown + np.repeat(late[:, 1], late[:, 0])[:n]
    wide = boxes[b"mdhd"][0] == 1
    scale = struct.unpack(">I", boxes[b"mdhd"][20:24] if wide else boxes[b"mdhd"][12:16])[0]
    keys = np.ones(n, bool)
    if b"stss" in boxes:  # without that table every sample is a key
        keys[:] = False
        keys[_numbers(boxes[b"stss"], ">u4").astype(np.int64) - 1] = True
    entry = boxes[b"stsd"][8:]
    width, height = struct.unpack(">HH", entry[32:36])
    return SampleIndex(entry[4:8].decode("latin-1"), width, height, offsets, sizes, (shown - shown.min()) / scale, keys)


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mux(samples: list[bytes], keys: list[bool], fps: int, width: int, height: int, codec: bytes = b"raw ", chunk: int = 10, index_first: bool = False) -> bytes:
    """A file of one video track with these encoded frames, `chunk` of them together."""
    n = len(samples)
    full = struct.pack(">I", 0)
    table = lambda kind, *rows: _box(kind, full, struct.pack(">I", len(rows)), *[struct.pack(f">{len(r)}I", *r) for r in rows])
    entry = struct.pack(">I4s6xH16xHH", 86, codec, 1, width, height).ljust(86, b"\0")
    per = [min(chunk, n - a) for a in range(0, n, chunk)]

    def moov(first: int) -> bytes:
        places = [first + sum(map(len, samples[:a])) for a in range(0, n, chunk)]
        runs = [(1, per[0], 1)] + ([(len(per), per[-1], 1)] if per[-1] != per[0] else [])
        stbl = _box(
            b"stbl",
            _box(b"stsd", full, struct.pack(">I", 1), entry),
            table(b"stts", (n, 1)),
            table(b"stsc", *runs),
            _box(b"stsz", full, struct.pack(">II", 0, n), struct.pack(f">{n}I", *map(len, samples))),
            table(b"stco", *[(p,) for p in places]),
            table(b"stss", *[(i + 1,) for i, key in enumerate(keys) if key]),
        )
        mdhd = _box(b"mdhd", full, struct.pack(">IIIHH", 0, 0, fps, n, 0))
        return _box(b"moov", _box(b"trak", _box(b"mdia", mdhd, _box(b"hdlr", full, struct.pack(">I4s", 0, b"vide")), _box(b"minf", stbl))))

    head, data = _box(b"ftyp", b"isom"), _box(b"mdat", *samples)
    if index_first:
        return head + moov(len(head) + len(moov(0)) + 8) + data
    return head + data + moov(len(head) + 8)

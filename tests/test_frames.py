"""The frame source against its files' own frames."""

import random
import urllib.request

import pytest

from rallyframe.sources import containers, frames


def some(n, seed, key_every=12):
    rng = random.Random(seed)
    return [bytes([i % 256]) * rng.randint(1, 400) for i in range(n)], [i % key_every == 0 for i in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("videos")
    (path / "b").mkdir()
    for name, n, first in (("a.mp4", 500, False), ("b/c.mp4", 37, True), ("b/one.mp4", 1, False)):
        (path / name).write_bytes(containers.mux(*some(n, n), fps=25, width=640, height=360, index_first=first))
    return path


def whole(path):
    data = path.read_bytes()
    index = containers.sample_index(lambda at, n: data[at : at + n], len(data))
    return [(i, data[a : a + n], bool(k)) for i, (a, n, k) in enumerate(zip(index.offsets.tolist(), index.sizes.tolist(), index.keys, strict=True))], index


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("n", [1, 9, 10, 101])
def test_index_of_a_file(first, n):
    samples, keys = some(n, 3)
    data = containers.mux(samples, keys, 30, 1920, 1080, index_first=first)
    index = containers.sample_index(lambda at, size: data[at : at + size], len(data))
    assert [data[a : a + s] for a, s in zip(index.offsets, index.sizes, strict=True)] == samples
    assert index.keys.tolist() == keys and (index.width, index.height, index.codec) == (1920, 1080, "raw ")
    assert index.seconds.tolist() == [i / 30 for i in range(n)] and index.groups.tolist() == [i // 12 * 12 for i in range(n)]


def test_frames_are_in_the_order_of_presentation():
    boxes = containers.mux(*some(4, 1), fps=10, width=2, height=2)
    late = containers._box(b"ctts", b"\0" * 4, (4).to_bytes(4, "big"), *[(1).to_bytes(4, "big") + d.to_bytes(4, "big", signed=True) for d in (0, 2, -1, 0)])
    at = boxes.index(b"stbl") - 4
    sized = bytearray(boxes[:at] + (int.from_bytes(boxes[at : at + 4], "big") + len(late)).to_bytes(4, "big") + boxes[at + 4 : at + 8] + late + boxes[at + 8 :])
    for kind in (b"minf", b"mdia", b"trak", b"moov"):
        a = sized.index(kind) - 4
        sized[a : a + 4] = (int.from_bytes(sized[a : a + 4], "big") + len(late)).to_bytes(4, "big")
    index = containers.sample_index(lambda p, n: bytes(sized[p : p + n]), len(sized))
    assert index.frames.tolist() == [0, 2, 1, 3]


@pytest.mark.parametrize("data", [b"", b"abc", b"\0\0\0\x10ftypisomxxxx", b"\0\0\xff\xffmoov"])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        containers.sample_index(lambda at, n: data[at : at + n], len(data))


@pytest.mark.parametrize("split", [700, 5000, 1 << 30])
def test_rows_equal_a_sequential_read(spark, folder, split):
    got = sorted((r.path.rpartition("/")[2], r.sample, bytes(r.data), r.key) for r in frames.read_frames(spark, str(folder), split_bytes=split).collect())
    assert got == sorted((p.name, *row) for p in folder.rglob("*.mp4") for row in whole(p)[0])


def test_one_file_is_many_tasks(spark, folder):
    from pyspark.sql import functions as F

    df = frames.read_frames(spark, f"file://{folder}/a.mp4", split_bytes=8000).select("group", F.spark_partition_id().alias("task")).distinct()
    assert df.select("task").distinct().count() > 5
    assert df.count() == df.select("group").distinct().count()


def test_options_leave_frames_out(spark, folder):
    rows = whole(folder / "a.mp4")[0]
    for options, test in (
        ({"first": 100, "last": 120}, lambda i, k: 100 <= i <= 120),
        ({"first": 499}, lambda i, k: i == 499),
        ({"last": 400, "keys_only": True, "stride": 5}, lambda i, k: k and i <= 400 and i % 5 == 0),
        ({"first": 1000}, lambda i, k: False),
    ):
        df = frames.read_frames(spark, str(folder / "a.mp4"), split_bytes=20_000, **options)
        assert sorted((r.sample, bytes(r.data), r.key) for r in df.collect()) == [r for r in rows if test(r[0], r[2])]
        assert sorted(r.sample for r in df.where("size > 100").collect()) == [i for i, d, k in rows if test(i, k) and len(d) > 100]


def test_a_range_reads_fewer_bytes(folder):
    from pyspark.sql.types import StructType, _parse_datatype_string

    data = (folder / "a.mp4").read_bytes()
    schema = _parse_datatype_string(frames.SCHEMA)

    def cost(columns, **options):
        seen = [0]

        def read(at, n):
            seen[0] += n
            return data[at : at + n]

        reader = frames.FrameReader(schema if columns is None else StructType([schema[c] for c in columns]), {"path": "x"} | options)
        rows = sum(b.num_rows for b in reader.rows(frames.ByteRange("x", len(data), 0, len(data)), read))
        return rows, seen[0]

    all_rows, all_bytes = cost(None)
    rows, some_bytes = cost(None, first="100", last="149")
    index_rows, index_bytes = cost(["frame_idx", "size"])
    assert (all_rows, rows, index_rows) == (500, 50, 500)
    assert all_bytes >= len(data) * 0.95 and index_bytes < some_bytes < index_bytes + 0.2 * len(data)


def test_stride_and_columns(spark, folder):
    df = frames.read_frames(spark, str(folder / "b"), ("path", "frame_idx", "width", "seconds"), stride=5)
    assert df.columns == ["path", "frame_idx", "width", "seconds"]
    got = sorted((r.path.rpartition("/")[2], r.frame_idx, r.width, r.seconds) for r in df.collect())
    assert got == [("c.mp4", i, 640, i / 25) for i in range(0, 37, 5)] + [("one.mp4", 0, 640, 0.0)]


def test_empty_folder(spark, tmp_path):
    assert frames.read_frames(spark, str(tmp_path), ("path",)).collect() == []


class Decoder:
    """The frames of a file by its index; one file is broken."""

    def frames(self, path):
        data = urllib.request.urlopen(path).read()
        if b"broken" in data:
            raise OSError("x" * 5000)
        index = containers.sample_index(lambda at, n: data[at : at + n], len(data))
        for i, (a, n) in enumerate(zip(index.offsets.tolist(), index.sizes.tolist(), strict=True)):
            yield {"match_id": len(index.sizes), "frame_idx": i, "image": data[a : a + n]}


class Sizes:
    """Counts its calls and frames; fails in a match of 37 frames when told to."""

    def __init__(self, fails=False):
        self.fails = fails

    def begin(self, match_id):
        import pandas as pd

        fails, seen = self.fails, [0]

        class Session:
            def step(self, frames):
                if fails and match_id == 37:
                    raise ValueError("no ball")
                seen[0] += len(frames)
                return pd.DataFrame({"match_id": frames["match_id"], "frame_idx": frames["frame_idx"], "n_bytes": frames["image"].map(len), "seen": seen[0]})

        return Session()


def test_all_plugins_in_one_pass_and_a_failing_file_alone(spark, folder, tmp_path):
    import shutil

    from rallyframe.sources import media

    shutil.copytree(folder, tmp_path / "v")
    (tmp_path / "v/broken.mp4").write_bytes(b"broken")
    files = media.videos(spark, f"{tmp_path}/v/*").unionByName(media.videos(spark, f"{tmp_path}/v/b/*"))
    kind = "match_id long, frame_idx long, n_bytes long, seen long"
    got = media.perceive(files.select("path").distinct(), Decoder(), {"ball": (Sizes(), kind, 1), "players": (Sizes(), kind, 2)})
    ball = sorted((r.match_id, r.frame_idx, r.n_bytes) for r in got["ball"].collect())
    assert ball == sorted((n, i, len(d)) for p, n in ((folder / "a.mp4", 500), (folder / "b/c.mp4", 37), (folder / "b/one.mp4", 1)) for i, d, _ in whole(p)[0])
    players = sorted((r.match_id, r.frame_idx, r.n_bytes) for r in got["players"].collect())
    assert players == [r for r in ball if r[1] % 2 == 0]
    assert {r.match_id: r.seen for r in got["ball"].groupBy("match_id").agg({"seen": "max"}).toDF("match_id", "seen").collect()} == {500: 500, 37: 37, 1: 1}
    assert [(r.path.rpartition("/")[2], len(r.message)) for r in got["errors"].collect()] == [("broken.mp4", 1000)]
    failing = media.perceive(files.select("path").distinct(), Decoder(), {"ball": (Sizes(), kind, 1), "players": (Sizes(True), kind, 2)})
    assert sorted(r.message for r in failing["errors"].collect())[1] == "ValueError: no ball"
    assert {r.match_id for r in failing["ball"].select("match_id").distinct().collect()} == {1, 500}


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"{i}.mp4").write_bytes(containers.mux(*some(40, i), fps=25, width=2, height=2))
    df = frames.read_frames(spark, str(tmp_path), ("path", "sample"), split_bytes=1000)
    assert df.rdd.getNumPartitions() <= 40
    assert sorted((r.path.rpartition("/")[2], r.sample) for r in df.collect()) == sorted((f"{i}.mp4", k) for i in range(150) for k in range(40))
    ranges = [frames.ByteRange("a", 10, 0, 4), frames.ByteRange("a", 10, 4, 8), frames.ByteRange("a", 10, 8, 10), frames.ByteRange("b", 3, 0, 3)]
    assert [[(r.path, r.first, r.end) for r in p.ranges] for p in frames.dealt(ranges, 1 << 20, 1)] == [[("a", 0, 10), ("b", 0, 3)]]
    assert [[(r.path, r.first, r.end) for r in p.ranges] for p in frames.dealt(ranges, 8, 1 << 40)] == [[("a", 0, 8)], [("a", 8, 10)], [("b", 0, 3)]]

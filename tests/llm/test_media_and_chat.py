import hashlib
import json
import math
import os
import zlib
from itertools import pairwise
from pathlib import Path

from pyspark.sql import functions as F

from tessella.llm import common, media, quotations


def test_media_round_trip(spark, wide, rows):
    path = common.shared_dir(spark) + "/media"
    media.write_media(wide, path)
    got = media.read_media(spark, path, range_bytes=3000, batch_bytes=5000).mapInArrow(media._features, media.FEATURES).collect()
    want = []
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        p = b.ljust(max(-(-len(b) // 64), 1) * 64, b"\0")
        want.append((str(doc_id), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    same = [r for r in got if r["doc_id"] in (7, 200, 214)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1


def test_a_damaged_member_costs_only_itself(spark, docs):
    path = common.shared_dir(spark) + "/media"
    media.write_media(docs, path)
    folder = Path(path.removeprefix("file:"). replace("//", "/"))
    (manifest,) = folder.glob("_manifest-*")
    first = json.loads(manifest.read_text())[0]["archive"]
    with open(folder / first, "r+b") as f:
        f.seek(512 + 40)
        byte = f.read(1)
        f.seek(512 + 40)
        f.write(bytes([byte[0] ^ 255]))
    got = media.read_media(spark, path, retries=2).collect()
    assert len(got) == docs.count() and sum(r["error"] is not None for r in got) == 1 and sum(r["media"] is None for r in got) == 1


def test_writing_again_adds_or_replaces(spark, docs):
    path = common.shared_dir(spark) + "/media"
    part = lambda *ids: docs.filter(F.col("doc_id").isin(*ids))
    ids = lambda: sorted(r["doc_id"] for r in media.read_media(spark, path, range_bytes=700).collect())
    media.write_media(part(1, 2), path)
    media.write_media(part(3), path, index_bytes=1)
    assert ids() == [1, 2, 3]
    media.write_media(part(4, 5, 6, 7, 8, 9), path, mode="overwrite", index_bytes=1)
    assert ids() == [4, 5, 6, 7, 8, 9]
    folder = Path(path.removeprefix("file:").replace("//", "/"))
    assert len(list(folder.glob("_manifest-*"))) == 1 and len(list(folder.glob("*.tar"))) == len(list(folder.glob("*.idx"))) == len(json.loads(next(folder.glob("_manifest-*")).read_text()))


def plain_png(image):
    """A second reader of greyscale PNG files, with the format's row filters 0 to 2."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, width, data = 8, None, b""
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(image[at + 8 + size : at + 12 + size])
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
            assert tuple(body[8:]) == (8, 0, 0, 0, 0)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    assert kind == b"IEND"
    raw, rows, above = zlib.decompress(data), [], bytes(width)
    for y in range(height):
        line = bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        how = raw[y * (width + 1)]
        assert how in (0, 1, 2)
        for x in range(width):
            line[x] = (line[x] + (above[x] if how == 2 else line[x - 1] if how == 1 and x else 0)) & 255
        rows.append(bytes(line))
        above = rows[-1]
    return b"".join(rows)


def plain_feature(data):
    rows = [data[i : i + 64] for i in range(0, len(data), 64)]
    if len(rows) < 8:
        rows = [r for r in rows for _ in range(-(-8 // len(rows)))]
    edges = [len(rows) * k // 8 for k in range(9)]
    grid = []
    for a, b in pairwise(edges):
        for c in range(0, 64, 8):
            cell = [x for r in rows[a:b] for x in r[c : c + 8]]
            grid.append(sum(cell) / len(cell))
    mean = sum(grid) / 64
    bits = "".join("1" if x > mean + 1e-9 else "0" for x in grid)
    n = len(data)
    m = sum(data) / n
    p = [data.count(v) / n for v in set(data)]
    return bits, m, math.sqrt(sum((x - m) ** 2 for x in data) / n), -sum(x * math.log2(x) for x in p)


def test_images_and_features_equal_a_plain_reading(rows):
    for _, text, *_ in rows[::5] + [(0, "a" * 64), (0, "ab" * 5000), (0, "")]:
        data = media.payload((text or "").encode())
        assert plain_png(media.png(data, 1)) == data
        bits, *numbers = media.feature(data).split(":")
        want, *plain = plain_feature(data)
        assert sum(a != b for a, b in zip(f"{int(bits, 16):064b}", want)) <= 1  # a cell may equal the mean but for rounding
        assert all(abs(float(a) - b) < 1e-3 for a, b in zip(numbers, plain))


def test_archive_of_nothing(spark, empty):
    path = common.shared_dir(spark) + "/media"
    media.write_media(empty, path)
    assert media.read_media(spark, path).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, docs):
    path = common.shared_dir(spark) + "/media"
    media.write_media(docs, path)
    folder = Path(path.removeprefix("file:").replace("//", "/"))
    (manifest,) = folder.glob("_manifest-*")
    first = json.loads(manifest.read_text())[0]
    for k in ("archive", "index"):
        os.link(folder / first[k], folder / ("lost" + first[k]))
    assert media.read_media(spark, path).count() == docs.count()


MESSAGES = [
    (1, 0, "a", "Hello there my dear friend. How is the weather today?\nSee you at noon."),
    (1, 1, "b", "> How is the weather\n> today?\nIt is very fine indeed."),
    (1, 2, "a", "On Monday b wrote:\n> > How is the weather today?\n> It is very fine indeed.\nGlad to hear that then."),
    (1, 3, "c", "Something else entirely new here."),
    (1, 4, "c", "> Hello there my dear friend.\nHi to you too."),
    (1, 5, "d", "> Glad to hear that then.\nme also"),
    (2, 0, "x", "> How is the weather today?\nA quote from elsewhere."),
    (None, None, None, None), (3, 0, "y", ""), (3, 0, "y", ""),
]


def test_quotes_are_linked_and_removed(spark):
    d = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    got = [tuple(r[c] for c in ("conv_id", "thread", "turn", "depth", "reply_to", "text")) for r in quotations.link_quotations(d).collect()]
    assert got[0] == (None, None, None, 0, None, "")
    assert got[1:7] == [
        (1, 0, 0, 0, None, MESSAGES[0][3]), (1, 0, 1, 1, 0, "It is very fine indeed."), (1, 0, 2, 2, 1, "Glad to hear that then."), (1, 0, 4, 1, 0, "Hi to you too."), (1, 0, 5, 3, 2, "me also"), (1, 3, 3, 0, None, "Something else entirely new here."),
    ]
    assert got[7:] == [(2, 0, 0, 0, None, "A quote from elsewhere."), (3, 0, 0, 0, None, ""), (3, 0, 0, 0, None, "")]
    assert quotations.link_quotations(d.limit(0)).count() == 0


def test_a_long_chain_of_answers(spark):
    rows = [(1, 0, "a", "sentence number zero begins it all")] + [(1, i, "a", f"> {'sentence number zero begins it all' if i == 1 else f'now answer number {i - 1} is here'}\nnow answer number {i} is here") for i in range(1, 40)]
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["thread"], r["depth"]) for r in got] == [(0, i) for i in range(40)]

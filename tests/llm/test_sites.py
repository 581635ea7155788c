"""Sharding, URL rules and media columns."""

import hashlib
import io
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinale.llm import media, queries, sharding, sieve, urls


# sharding


def test_fill_is_balanced_and_stable():
    names = [f"s{i}" for i in range(12)]
    table = sharding.fill(names, 4099)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 12
    fewer = sharding.fill(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 11)
    assert moved < 0.3 * 4099
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_fill_by_its_definition():
    """Each shard in turn claims the free slot that comes first in its own list of all slots."""
    names, slots = ["x", "y", "z"], 31
    orders = []
    for n in names:
        offset, step = sharding._draw(n, "offset") % slots, sharding._draw(n, "step") % (slots - 1) + 1
        orders.append([(offset + j * step) % slots for j in range(slots)])
    assert all(sorted(o) == list(range(slots)) for o in orders)
    table, turn = {}, 0
    while len(table) < slots:
        table[next(s for s in orders[turn % 3] if s not in table)] = turn % 3
        turn += 1
    assert sharding.fill(names, slots) == [table[i] for i in range(slots)]


def test_sharding_carries_clashing_names(spark, documents, odd, clashing):
    df, names = clashing(documents(odd))
    rows = sharding.shard(df.withColumns({"shard": F.lit(1), "n": F.lit("own n")}), ["a", "b"], slots=7).collect()
    assert len(rows) == len(odd) and all(r[n] == f"own {n}" for r in rows for n in [*names, "n"]) and {r.shard for r in rows} <= {"a", "b"}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_sharding_is_native_and_whole(spark, data, documents, odd):
    df = queries.op4_sharding(spark, f"{data}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan
    rows = df.collect()
    table = sharding.fill(queries.SHARDS)
    assert len(rows) == 200
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, queries.SHARDS[table[slot]])
    out = sharding.shard(documents(odd).withColumn("slot", F.lit("clash")), ["a", "b"], slots=7)
    assert out.count() == len(odd) and out.where("doc_id = 3").select("shard").distinct().count() == 1
    assert sharding.shard(documents([]), ["a"]).count() == 0


# URLs


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme/en/", "http://example.com/en/", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "ftp://x.com", "http://x.com?q=/en/",
    "http://x.com/#a", "http://x.com:80/", "http:///path", "a://b://c.com/", "http://x.org/com/", "http://com/", "http://..com/", "http://example.com./en/", "http://ÉX.com/é/", "http://x.com\n.net/es/", "http://x.com/en/" + "y" * 5000,
]


def test_urls_on_the_whole_table(spark, data):
    got = {r.page_id: tuple(r)[1:] for r in queries.op7_urls(spark, f"{data}/sf0.001").collect()}
    pages = spark.read.parquet(f"{data}/sf0.001/pages.parquet").collect()
    assert got == {p.page_id: plain_verdict(p.url, queries.URL_RULES) for p in pages}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_RULES", broadcast)
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumn("_row", F.lit("own")).withColumn("_keys", F.lit(1)).withColumn("rule", F.lit(0)).withColumn("_best", F.lit(2))
    out = urls.judge(df, rules)
    assert out.columns == ["page_id", "url", "_row", "_keys", "_best", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS) * 2 and all((r["_row"], r["_keys"], r["_best"]) == ("own", 1, 2) for r in rows)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, queries.URL_RULES), r.url
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (broadcast == 0)
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.limit(0), default="block").collect()} == {"block"}


def test_bloom_filter_has_no_false_negatives_and_few_false_hits(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    held = urls.bloom(keys, "h")
    assert (urls.bloom_of(np.array([r[0] for r in keys.collect()])).blocks == held.blocks).all()
    own = np.array([r[0] for r in keys.collect()])
    other = np.array([r[0] for r in spark.range(50_000, 90_000).select(F.xxhash64("id")).collect()])
    assert held.hits(own).all() and held.hits(other).mean() < 0.02


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls_with_many_rules(spark, monkeypatch, broadcast):
    """Rules of all kinds of lengths, ties and equal keys, against plain matching."""
    import random

    monkeypatch.setattr(urls, "BROADCAST_RULES", broadcast)
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "A.net", "x.y"]
    paths = ["/", "/a", "/a/", "/ab/", "/é/", ""]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    held = {}
    for h, p, v in rules:
        held[h.lower(), p] = min(v, held.get((h.lower(), p), v))
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("com", "/", None), ("", "/", "block")], "host string, path string, verdict string")
    pages = [(i, f"http://{rng.choice(['', 'www.', 'z.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'b', '/b', '?a', '#/a/'])}") for i in range(300)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), table).collect()}
    assert got == {i: plain_verdict(u, [(h, p, v) for (h, p), v in held.items()])[2:] for i, u in pages}


def test_sieve_inside_a_plan(spark):
    """All listed rows pass, few others, none for an empty list, and the rows' own columns stay."""
    df = spark.range(60_000).withColumn("_block", F.lit("own"))
    keys = spark.range(0, 60_000, 7).select(F.xxhash64("id").alias("h"))
    out = sieve.marked(df, F.xxhash64("id"), keys, "h", "may")
    assert out.columns == ["id", "_block", "may"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 60_000 and all(r.may for r in rows if r.id % 7 == 0) and sum(r.may for r in rows) < 60_000 / 7 * 1.1
    assert sieve.sieved(df, F.xxhash64("id"), keys.limit(0), "h").count() == 0


def test_cut_tables_are_removed(spark):
    import os

    from ordinale.llm import storage

    a, b = storage.cut(spark.range(5).toDF("n"), "a"), storage.cut(spark.range(7).toDF("n"), "b")
    place = storage.shared_folder(spark).removeprefix("file:")
    assert a.count() == 5 and b.count() == 7
    held = set(os.listdir(place))
    storage.discard(a, spark.range(1))
    assert len(held) - len(os.listdir(place)) == 1 and b.count() == 7
    storage.clear(spark)
    assert not os.path.exists(place) or not os.listdir(place)


# media


def bmp(rows, width, depth, palette=b"", top_down=False):
    stride = (width * depth + 31) // 32 * 4
    body = b"".join(r.ljust(stride, b"\0") for r in (rows if top_down else rows[::-1]))
    offset = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + len(body), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, -len(rows) if top_down else len(rows), 1, depth, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body


def test_netpbm():
    two = np.array([[1, 2, 3], [4, 5, 255]], np.uint8)
    assert (media.decode(b"P2 # c\n3 2\n255\n1 2 3 # x\n4 5 255\n") == two).all()
    assert (media.decode(media.encode_pgm(two)) == two).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == np.array([[0, 255, 0], [255, 0, 255]])).all()
    rgb = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (media.decode(b"P6 2 2 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3 2 2 255 " + b" ".join(str(v).encode() for v in rgb.ravel())) == rgb).all()
    assert (media.decode(b"P5 2 1 65535\n" + struct.pack(">HH", 300, 65535)) == np.array([[300, 65535]])).all()
    for bad in (b"", b"P5", b"P5 3 2 255\n12", b"P7 1 1 255\n1", b"P2 2 2 0\n1 1 1 1", b"BM", b"P5 a"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


def test_bmp():
    rgb = np.array([[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 12]]], np.uint8)
    rows = [r[:, ::-1].tobytes() for r in rgb]
    assert (media.decode(bmp(rows, 2, 24)) == rgb).all() and (media.decode(bmp(rows, 2, 24, top_down=True)) == rgb).all()
    assert (media.decode(bmp([b"".join(bytes(p[::-1]) + b"\0" for p in r) for r in rgb], 2, 32)) == rgb).all()
    grey = b"".join(bytes([v, v, v, 0]) for v in range(256))
    assert (media.decode(bmp([bytes([5, 9, 200])], 3, 8, grey)) == np.array([[5, 9, 200]])).all()
    colour = bytes([0, 0, 255, 0, 0, 255, 0, 0])
    assert (media.decode(bmp([bytes([0b01000000])], 2, 1, colour)) == np.array([[[255, 0, 0], [0, 255, 0]]])).all()
    assert (media.decode(bmp([bytes([0x10])], 2, 4, colour)) == np.array([[[0, 255, 0], [255, 0, 0]]])).all()


def test_bmp_bit_fields():
    def fields(rows, width, depth, masks):
        out = bytearray(bmp(rows, width, depth, struct.pack("<III", *masks)))
        out[30:34], out[46:50] = struct.pack("<I", 3), struct.pack("<I", 0)
        return bytes(out)

    px = struct.pack("<II", 0x00FF8001, 0x00010203)
    assert (media.decode(fields([px], 2, 32, (0xFF0000, 0xFF00, 0xFF))) == np.array([[[255, 128, 1], [1, 2, 3]]])).all()
    assert (media.decode(fields([px], 2, 32, (0xFF, 0xFF00, 0xFF0000))) == np.array([[[1, 128, 255], [3, 2, 1]]])).all()
    assert (media.decode(fields([struct.pack("<HH", 0xF800, 0x07E0)], 2, 16, (0xF800, 0x07E0, 0x1F))) == np.array([[[255, 0, 0], [0, 255, 0]]])).all()
    assert (media.decode(bmp([struct.pack("<HH", 0x7C00, 0x001F)], 2, 16)) == np.array([[[255, 0, 0], [0, 0, 255]]])).all()
    for masks in ((0, 1, 2), (0b101, 8, 16)):
        with pytest.raises(ValueError):
            media.decode(fields([px], 2, 32, masks))


MALFORMED = [b"P2 1 1 255\n300", b"P2 2 1 255\n-1 5", b"P5 99999999999 99999999999 255\n12", b"P2 99999999999 99999999999 255\n1 2", b"P1 99999999999 99999999999\n1", b"P4 99999999999 99999999999\nx", b"P6 4000000000 4000000000 65535\nx", b"P5 1 1 100\n\xff", b"P2 1 1 255\n" + b"9" * 5000, b"P5 " + b"9" * 5000 + b" 1 255\n1", b"P2 1 1 255\n1e3", b"BM" + b"\0" * 60, b"BM" + struct.pack("<IHHI", 60, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2**31 - 1, -(2**31), 1, 32, 0, 0, 0, 0, 0, 0), bmp([b"\x70"], 1, 4, b"\0\0\0\0")]


def test_malformed_pictures_are_null(spark):
    rows = media.media_columns(spark.createDataFrame([(i, d) for i, d in enumerate(MALFORMED)], "n int, media binary")).collect()
    assert len(rows) == len(MALFORMED) and all(r.height is r.samples is r.tile is r.dhash is None for r in rows)


def test_random_bytes_never_crash():
    rng = np.random.default_rng(5)
    heads = [b"P%d %d %d %d\n" % (k, w, h, m) for k in range(1, 7) for w, h, m in ((3, 2, 255), (0, 5, 1), (7, 1, 65535))] + [bmp([b"\1" * 12] * 2, 3, d, b"\1\2\3\0" * 4) for d in (1, 4, 8, 16, 24, 32)]
    for _ in range(3000):
        raw = bytearray(heads[rng.integers(len(heads))] + rng.bytes(rng.integers(0, 40)))
        for _ in range(rng.integers(0, 4)):
            raw[rng.integers(len(raw))] = rng.integers(256)
        try:
            picture = media.decode(bytes(raw))
        except (ValueError, struct.error, IndexError):
            continue
        assert picture.dtype in (np.uint8, np.uint16) and picture.ndim in (2, 3)


@pytest.mark.parametrize(("h", "w"), [(1, 64), (7, 64), (64, 9), (100, 33)])
def test_area_resize(h, w):
    """Against overlaps of cells summed one by one."""
    picture = np.random.default_rng(h).integers(0, 256, (h, w)).astype(float)

    def overlap(n, cells):
        edges = np.linspace(0, n, cells + 1)
        return np.array([[max(0.0, min(b, i + 1) - max(a, i)) for i in range(n)] for a, b in zip(edges[:-1], edges[1:], strict=True)])

    y, x = overlap(h, 8), overlap(w, 9)
    want = (y @ picture @ x.T) / (h / 8 * w / 9)
    assert media.area_resize(media.integral(picture), 8, 9) == pytest.approx(want)


def test_difference_hash():
    rising = np.tile(np.arange(90.0), (16, 1))
    assert media.difference_hash(media.integral(rising)) == "f" * 16 and media.difference_hash(media.integral(-rising)) == "0" * 16
    assert media.difference_hash(media.integral(np.full((5, 64), 7.0))) == "0" * 16


def test_media_round_trip(spark, data, tmp_path, documents, odd):
    documents([(i, t) for i, (_, t) in enumerate(odd)] + [(20, "a" * 64), (21, "b" * 65), (22, "a" * 64)]).write.parquet(str(tmp_path / "documents.parquet"))
    for d in (f"{data}/sf0.001", str(tmp_path)):
        texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        rows = queries.op10_media(spark, d).collect()
        assert len(rows) == len(texts)
        by_text = {}
        for r in rows:
            raw = texts[r.doc_id]
            payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
            assert by_text.setdefault(raw, r.feature) == r.feature and len(r.feature) == 16
            picture = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
            if picture.shape[0] % 16 == 0:  # whole cells: plain means
                tile = np.rint(picture.reshape(16, -1, 16, 4).mean(axis=(1, 3))).astype(np.uint8)
                out = io.BytesIO()
                np.save(out, tile)
                assert (r.tile_bytes, r.tile_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())


def test_media_columns(spark):
    picture = np.arange(48 * 32, dtype=np.uint16).reshape(48, 32) % 251
    rows = [(1, media.encode_pgm(picture.astype(np.uint8))), (2, None), (3, b""), (4, b"junk"), (5, b"P5 0 0 255\n")]
    out = {r.n: r for r in media.media_columns(spark.createDataFrame(rows, "n int, media binary").withColumn("tile", F.lit("clash"))).collect()}
    assert (out[1].height, out[1].width) == (48, 32) and out[1].samples == picture.astype(np.uint8).tobytes()
    tile = np.load(io.BytesIO(out[1].tile))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8
    assert (tile == np.rint(picture.reshape(16, 3, 16, 2).mean(axis=(1, 3)))).all()
    assert all(out[i].dhash is None and out[i].height is None for i in (2, 3, 4, 5))
    assert media.media_columns(spark.createDataFrame([], "n int, media binary")).count() == 0


def test_media_columns_carry_clashing_names(spark, documents, odd, clashing):
    df, names = clashing(documents(odd))
    out = media.media_columns(df.withColumn("media", media.text_picture(F.col("text"))).withColumn("samples", F.lit(1)))
    rows = out.collect()
    assert len(rows) == len(odd) and all(r[n] == f"own {n}" for r in rows for n in names) and all(r.samples.startswith((r.text or "").encode()) for r in rows)

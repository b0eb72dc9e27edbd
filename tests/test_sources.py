"""Readers over small inputs built here, whole and damaged."""

import hashlib
import io
import random
import sqlite3
import struct
import zipfile
import zlib

import pytest

from evidencelake.sources import artefacts, filesystems, images, volumes
from evidencelake.streaming import live


def stamp(seconds):
    return (seconds + 11_644_473_600) * 10_000_000


def ewf(data, chunk=32768, spoil=None):
    chunks = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    sectors, table = b"", []
    start = 13 + 76 + 94 + 76
    for i, c in enumerate(chunks):
        packed = i % 2 == 0
        body = zlib.compress(c) if packed else c + struct.pack("<I", zlib.adler32(c))
        if i == spoil:
            body = body[:10] + b"\xff" * 20 + body[30:]
        table.append((start + len(sectors)) | (packed << 31))
        sectors += body

    def section(kind, at, body, last=False):
        size = 76 + len(body)
        head = kind.ljust(16, b"\0") + struct.pack("<QQ", at if last else at + size, size) + bytes(40)
        return head + struct.pack("<I", zlib.adler32(head)) + body

    out = images.EWF + struct.pack("<BHH", 1, 1, 0)
    out += section(b"volume", len(out), struct.pack("<IIIIQ", 1, len(chunks), chunk // 512, 512, -(-len(data) // 512)).ljust(94, b"\0"))
    out += section(b"sectors", len(out), sectors)
    out += section(b"table", len(out), struct.pack("<IIQII", len(table), 0, 0, 0, 0) + struct.pack(f"<{len(table)}I", *table))
    out += section(b"hash", len(out), hashlib.md5(data).digest() + bytes(20))
    return out + section(b"done", len(out), b"", True)


def whole(df):
    rows = sorted(df.collect(), key=lambda r: r.offset)
    return b"".join(bytes(r.data) for r in rows), [r.finding for r in rows if r.finding]


def test_images(spark, tmp_path):
    data = random.Random(1).randbytes(512 * 700)
    (tmp_path / "a.dd").write_bytes(data)
    for i in range(3):
        (tmp_path / f"s.00{i + 1}").write_bytes(data[i * 150_000 : (i + 1) * 150_000])
    (tmp_path / "e.E01").write_bytes(ewf(data))
    (tmp_path / "bad.E01").write_bytes(ewf(data, spoil=3))
    for name in ("a.dd", "s.001", "e.E01"):
        assert whole(images.read(spark, str(tmp_path / name))) == (data, [])
    got, findings = whole(images.read(spark, str(tmp_path / "bad.E01")))
    assert len(got) == len(data) and findings == ["checksum"] and got[:98304] == data[:98304] and got[131072:] == data[131072:]
    assert images.pieces(str(tmp_path / "e.E01"))[1]["md5"] == hashlib.md5(data).hexdigest()
    (tmp_path / "x.qcow").write_bytes(b"QFI\xfb" + bytes(600))
    with pytest.raises(images.UnsupportedContainer):
        images.pieces(str(tmp_path / "x.qcow"))


def reader(data):
    return lambda at, n: data[at : at + n]


def test_mbr_and_gpt():
    disk = bytearray(512 * 400)
    disk[446:462] = bytes([0x80, 0, 0, 0, 0x0C, 0, 0, 0]) + struct.pack("<II", 10, 100)
    disk[462:478] = bytes([0, 0, 0, 0, 0x05, 0, 0, 0]) + struct.pack("<II", 200, 150)
    disk[510:512] = disk[200 * 512 + 510 : 200 * 512 + 512] = b"\x55\xaa"
    disk[200 * 512 + 446 : 200 * 512 + 462] = bytes([0, 0, 0, 0, 0x83, 0, 0, 0]) + struct.pack("<II", 5, 50)
    rows = volumes.scan(reader(bytes(disk)), len(disk))
    assert [(r["type"], r["offset"] // 512, r["size"] // 512) for r in rows] == [("gap", 0, 10), ("FAT32", 10, 100), ("gap", 110, 95), ("Linux", 205, 50), ("gap", 255, 145)]
    entry = bytes.fromhex("a2a0d0ebe5b9334487c068b6b72699c7") + bytes(16) + struct.pack("<QQQ", 40, 99, 0) + "data".encode("utf-16-le").ljust(72, b"\0")
    entries = entry.ljust(128 * 128, b"\0")
    head = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 399, 1, 34, 366, bytes(16), 367, 128, 128, zlib.crc32(entries)))
    head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)))
    disk = bytearray(512 * 400)
    disk[446:462] = bytes([0, 0, 0, 0, 0xEE, 0, 0, 0]) + struct.pack("<II", 1, 399)
    disk[510:512] = b"\x55\xaa"
    disk[399 * 512 : 399 * 512 + 92], disk[367 * 512 : 399 * 512] = head, entries
    rows = [r for r in volumes.scan(reader(bytes(disk)), len(disk)) if r["allocated"]]
    assert [(r["type"], r["label"], r["offset"], r["size"], r["note"]) for r in rows] == [("Basic data", "data", 40 * 512, 60 * 512, "from the backup table")]


def fat16():
    disk = bytearray(512 * 5000)
    disk[0:36] = struct.pack("<3s8sHBHBHHBHHHII", b"\xeb\x3c\x90", b"MSDOS5.0", 512, 1, 1, 2, 16, 5000, 0xF8, 20, 1, 1, 0, 0)
    disk[54:62] = b"FAT16   "
    for copy in (1, 21):
        disk[copy * 512 : copy * 512 + 14] = struct.pack("<7H", 0xFFF8, 0xFFFF, 3, 0xFFFF, 0xFFFF, 0, 0xFFFF)
    entry = lambda name, attr, cluster, size: struct.pack("<11sBBBHHHHHHHI", name, attr, 0, 0, 17366, 22373, 22373, 0, 17366, 22373, cluster, size)
    long = b"\x41" + "long name.txt".encode("utf-16-le")[:10] + b"\x0f\0\0" + "long name.txt".encode("utf-16-le")[10:22] + b"\0\0" + "long name.txt".encode("utf-16-le")[22:26]
    root = long + entry(b"LONGNA~1TXT", 32, 2, 700) + entry(b"SUB        ", 16, 4, 0) + entry(b"\xe5ONE    BIN", 32, 6, 10)
    disk[41 * 512 : 41 * 512 + len(root)] = root
    at = lambda c: (42 + c - 2) * 512
    disk[at(2) : at(2) + 700] = b"x" * 700
    sub = entry(b".          ", 16, 4, 0) + entry(b"IN      TXT", 32, 0, 0)
    disk[at(4) : at(4) + len(sub)] = sub
    disk[at(6) : at(6) + 10] = b"deleted!!!"
    return bytes(disk)


def test_fat():
    fs = filesystems.Fat(reader(fat16()))
    rows = {e["path"]: e for e in fs.walk()}
    assert set(rows) == {"/long name.txt", "/SUB", "/_ONE.BIN", "/SUB/IN.TXT"}
    assert rows["/long name.txt"]["created"] == "2023-11-05T08:30:44"
    assert fs.content(2, 700) == b"x" * 700 and fs.content(6, 10, True) == b"deleted!!!" and rows["/_ONE.BIN"]["deleted"]


def mft_record(name, flags, parent=5, size=b"hello"):
    std = struct.pack("<4Q", stamp(1000), stamp(2000), stamp(3000), stamp(4000)) + bytes(16)
    fn = struct.pack("<QQQQQ", parent, stamp(1500), stamp(2500), 0, 0) + bytes(24) + bytes([len(name), 1]) + name.encode("utf-16-le")
    attr = lambda kind, body: struct.pack("<IIBBHHHIHH", kind, 24 + -(-len(body) // 8) * 8, 0, 0, 24, 0, 0, len(body), 24, 0) + body.ljust(-(-len(body) // 8) * 8, b"\0")
    body = attr(0x10, std) + attr(0x30, fn) + attr(0x80, size) + b"\xff" * 8
    raw = bytearray((struct.pack("<4sHHQHHHHIIQHH", b"FILE", 48, 3, 0, 1, 1, 56, flags, 0, 1024, 0, 0, 0)).ljust(56, b"\0") + body).ljust(1024, b"\0")
    raw[48:54] = b"\x07\x07" + raw[510:512] + raw[1022:1024]
    raw[510:512] = raw[1022:1024] = b"\x07\x07"
    return bytes(raw)


def test_mft(spark):
    table = mft_record("a.txt", 1) + mft_record("gone.txt", 0) + mft_record("dir", 3) + bytes(1024)
    torn = bytearray(mft_record("torn", 1))
    torn[1022] = 9
    df = spark.createDataFrame([(0, bytearray(table)), (8192, torn + b"short")], "offset long, data binary")
    rows = {r.name: r for r in filesystems.mft_entries(df).collect()}
    assert set(rows) == {"a.txt", "gone.txt", "dir"} and rows["gone.txt"].deleted and rows["dir"].is_dir and rows["dir"].node == "2"
    assert rows["a.txt"].created == "1970-01-01T00:16:40.000000Z" and rows["a.txt"].fn_created == "1970-01-01T00:25:00.000000Z" and rows["a.txt"].size == 5
    assert filesystems.runs(bytes.fromhex("2110001011083100")) [:1] == [(4096, 16)]


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_usn(spark):
    name = "a.txt".encode("utf-16-le")
    rec = struct.pack("<IHHQQqQIIIIHH", 72, 2, 0, 7 | 3 << 48, 5, 900, stamp(60), 0x80000100, 0, 0, 32, len(name), 60) + name
    data = bytes(64) + rec.ljust(72, b"\0") + b"garbage!" + rec.ljust(72, b"\0")
    rows = artefacts.rows_of(files(spark, data), "usn").collect()
    assert len(rows) == 2 and (rows[0].name, rows[0].mft, rows[0].seq, rows[0].reasons) == ("a.txt", 7, 3, ["file_create", "close"])


def test_small_artefacts(spark):
    path = "C:\\x.txt"
    info = struct.pack("<QQQI", 2, 55, stamp(10), len(path) + 1) + (path + "\0").encode("utf-16-le")
    rows = artefacts.rows_of(files(spark, info, b"no"), "recyclebin").collect()
    assert rows[0].original_path == path and rows[0].size == 55 and rows[1].problem
    link = b"L\0\0\0" + bytes.fromhex("0114020000000000c000000000000046") + struct.pack("<II3QI", 0x88, 32, stamp(1), stamp(2), stamp(3), 99) + bytes(20) + struct.pack("<H", 3) + "rel".encode("utf-16-le")
    row = artefacts.rows_of(files(spark, link), "lnk").first()
    assert (row.size, row.relative_path) == (99, "rel")
    shim = struct.pack("<I", 0x34) + bytes(0x30) + b"10ts" + bytes(4) + struct.pack("<IH", 14 + 2 + 8 - 12 + 2, 4) + "ab".encode("utf-16-le") + struct.pack("<Q", stamp(5))
    assert artefacts.rows_of(files(spark, shim), "shimcache").first().path == "ab"
    pdf = b"%PDF-1.7\n1 0 obj <</Type /Page /Title (t)>> endobj /JS /OpenAction"
    row = artefacts.rows_of(files(spark, pdf), "pdf").first()
    assert (row.version, row.pages, row.javascript, row.actions, row.title) == ("1.7", 1, 1, 1, "t")
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHI4s", 0x10F, 2, 4, b"abc\0") + struct.pack("<HHII", 0x112, 3, 1, 6) + bytes(4)
    assert [(r.tag, r.value) for r in artefacts.rows_of(files(spark, tiff), "exif").collect()] == [(0x10F, "abc"), (0x112, "6")]


def test_zip_and_mbox(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "hello")
        z.writestr("c.txt", "x" * 100)
    spoilt = out.getvalue().replace(b"c.txt", b"d.txt", 1)
    rows = artefacts.rows_of(files(spark, out.getvalue(), spoilt), "zip").collect()
    assert [r.name for r in rows] == ["a/b.txt", "c.txt"] * 2 and rows[1].problems == [] and rows[3].problems == ["names differ"]
    mail = b"From a@b Mon\nSubject: =?utf-8?q?h=C3=A9?=\nFrom: a@b\nTo: c\n\nbody\n>From x\n\nFrom d@e Tue\nSubject: two\nContent-Type: text/html\n\n<p>shown</p><script>no</script>\n"
    rows = artefacts.rows_of(files(spark, mail), "mbox").collect()
    assert [(r.subject, r.text) for r in rows] == [("hé", "body\nFrom x"), ("two", "shown")]


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "d.sqlite")
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a, b)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"row {i}", i * 0.5 if i % 3 else None) for i in range(500)] + [(900, "long" * 5000, b"\x01\x02")])
    con.commit()
    con.close()
    data = (tmp_path / "d.sqlite").read_bytes()
    rows = {r.rowid: list(r["values"]) for r in artefacts.rows_of(files(spark, data), lambda x: artefacts.sqlite_rows(x, 2), artefacts.SQLITE).collect()}
    assert len(rows) == 501 and rows[5] == [None, "row 5", "2.5"] and rows[6][2] is None and rows[900] == [None, "long" * 5000, "0102"]


def hive():
    cells, at = bytearray(), 32

    def cell(body):
        nonlocal at
        size = -(-(len(body) + 4) // 8) * 8
        place = at
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))
        at += size
        return place

    value = cell(b"vk" + struct.pack("<HIIIHH", 4, 0x80000004, 7, 4, 1, 0) + b"numb")
    values = cell(struct.pack("<I", value))
    key = lambda name, subs, listed, n, where: b"nk" + struct.pack("<HQIIIIIIII", 32, stamp(77), 0, 0, subs, 0, listed, 0xFFFFFFFF, n, where) + bytes(28) + struct.pack("<HH", len(name), 0) + name
    child = cell(key(b"child", 0, 0xFFFFFFFF, 1, values))
    listed = cell(b"lf" + struct.pack("<HII", 1, child, 0))
    root = cell(key(b"ROOT", 1, listed, 0, 0xFFFFFFFF))
    head = b"regf" + bytes(32) + struct.pack("<I", root)
    return head.ljust(4096, b"\0") + b"hbin".ljust(32, b"\0") + bytes(cells)


def test_registry(spark):
    rows = artefacts.rows_of(files(spark, hive(), b"none"), "registry").collect()
    assert [(r.path, r.name, r.value) for r in rows[:3]] == [("ROOT", None, None), ("ROOT/child", None, None), ("ROOT/child", "numb", "7")] and rows[3].problem


def test_damage_is_bounded():
    """Readers over damaged input end, and end with rows or a known error."""
    rnd = random.Random(5)
    seeds = {"registry": hive(), "lnk": b"L\0\0\0" + bytes.fromhex("0114020000000000c000000000000046") + bytes(100), "prefetch": struct.pack("<I", 23) + b"SCCA" + bytes(400), "zip": b"PK\3\4" + bytes(60) + b"PK\5\6" + bytes(30), "exif": b"II*\0\x08\0\0\0" + bytes(80), "usn": bytes(200)}
    for name, seed in seeds.items():
        for _ in range(60):
            raw = bytearray(seed)
            for _ in range(rnd.randrange(1, 12)):
                raw[rnd.randrange(len(raw))] = rnd.randrange(256)
            try:
                for _, _row in zip(range(5000), artefacts.READERS[name][0](bytes(raw)), strict=False):
                    pass
            except (ValueError, struct.error, IndexError, LookupError, RecursionError):
                pass
    for _ in range(40):
        raw = bytearray(fat16()[: 512 * 60])
        for _ in range(10):
            raw[rnd.randrange(len(raw))] = rnd.randrange(256)
        try:
            list(zip(range(2000), filesystems.Fat(reader(bytes(raw))).walk(), strict=False))
        except (ValueError, struct.error, ZeroDivisionError):
            pass


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:30", m % 2 == 0) for m in (0, 0, 1, 3)]
    spark.createDataFrame(rows, "ts string, flagged boolean").selectExpr("cast(ts AS timestamp) ts", "flagged").write.parquet(str(tmp_path / "in"))
    stream = live.minute_counts(spark.readStream.schema("ts timestamp, flagged boolean").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("minute_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    assert sorted((r.n, r.f) for r in spark.table("minute_counts").collect()) == [(1, 0), (1, 0), (2, 2)]


@pytest.mark.skipif(not __import__("shutil").which("mke2fs"), reason="no tool that makes ext volumes here")
def test_ext(tmp_path):
    import subprocess

    from evidencelake.sources.exfat_ext import Ext

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"hello")
    (tmp_path / "in/sub/big.bin").write_bytes(bytes(range(256)) * 4000)
    for kind, block in (("ext4", "4096"), ("ext2", "1024")):
        image = tmp_path / f"{kind}.img"
        subprocess.run(["mke2fs", "-q", "-t", kind, "-b", block, "-d", str(tmp_path / "in"), str(image), "16M"], check=True)
        data = image.read_bytes()
        fs = Ext(reader(data))
        rows = {e["path"]: e for e in fs.walk()}
        assert {"/a.txt", "/sub", "/sub/big.bin", "/lost+found"} <= set(rows) and rows["/sub"]["is_dir"] and rows["/a.txt"]["size"] == 5
        assert fs.content(fs.inode(int(rows["/sub/big.bin"]["node"]))) == bytes(range(256)) * 4000
        assert volumes.identify(reader(data), 0) == "ext"


def test_exfat():
    from evidencelake.sources.exfat_ext import ExFat, exfat_time

    disk = bytearray(512 * 200)
    disk[3:11] = b"EXFAT   "
    struct.pack_into("<5I", disk, 80, 8, 4, 20, 100, 2)
    disk[108], disk[109] = 9, 0
    struct.pack_into("<3I", disk, 8 * 512, 0, 0, 0xFFFFFFFF)
    when = 22373 << 16 | 17366
    file = struct.pack("<BBHHHIIIBBBBB7x", 0x85, 2, 0, 32, 0, when, when, when, 0, 0, 0x80 | 4, 0, 0)
    disk[20 * 512 : 20 * 512 + 96] = file + struct.pack("<BBBBHHQIIQ", 0xC0, 3, 0, 5, 0, 0, 6, 0, 5, 6) + (b"\xc1\0" + "a.txt".encode("utf-16-le")).ljust(32, b"\0")
    disk[23 * 512 : 23 * 512 + 6] = b"inside"
    fs = ExFat(reader(bytes(disk)))
    (e,) = fs.walk()
    assert (e["path"], e["size"], e["created"], e["modified"]) == ("/a.txt", 6, "2023-11-05T07:30:44Z", "2023-11-05T08:30:44")
    assert fs.content(int(e["node"]), 6, e["contiguous"]) == b"inside"
    assert exfat_time(0, 0, 0) is None


def test_codecs():
    from evidencelake.functions import codecs

    # a chunk of three letters and a reference to them; then a stored chunk
    packed = struct.pack("<H", 0xB000 | 5) + bytes([0b1000]) + b"abc" + struct.pack("<H", (2 << 12) | 6) + struct.pack("<H", 0x3001) + b"xy"
    assert codecs.lznt1(packed) == b"abcabcabcabc" + b"xy"
    assert codecs.snappy(bytes([12, 2 << 2]) + b"abc" + bytes([(9 - 4) << 2 | 1, 3])) == b"abcabcabcabc"
    assert codecs.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ValueError):
        codecs.snappy(bytes([12, 9 << 2 | 1, 3]))
    # a table with one code for a letter and one for a reference of distance 1
    lengths = [0] * 512
    lengths[ord("a")], lengths[256 + 5] = 1, 1
    table = bytes(lengths[i] | lengths[i + 1] << 4 for i in range(0, 512, 2))
    assert codecs.xpress_huffman(table + struct.pack("<HH", 0b0100000000000000, 0), 9) == b"a" * 9


def test_leveldb_log(spark):
    from evidencelake.sources import containers

    batch = struct.pack("<QI", 7, 2) + b"\x01\x01k\x02vv" + b"\x00\x01z"
    data = struct.pack("<IHB", 0, len(batch), 1) + batch
    assert list(containers.leveldb_log(data)) == [(b"k", b"vv", 7, False, "log"), (b"z", None, 8, True, "log")]
    block = b"\x00\x09\x01" + b"k" + struct.pack("<Q", 5 << 8 | 1) + b"v" + struct.pack("<II", 0, 1)
    index = b"\x00\x01\x02" + b"z" + bytes([0, len(block)]) + struct.pack("<II", 0, 1)
    at = len(block) + 5
    footer = (bytes([0, 0, at, len(index)])).ljust(40, b"\0") + bytes.fromhex("57fb808b247547db")
    rows = list(containers.leveldb_table(block + bytes(5) + index + bytes(5) + footer))
    assert rows == [(b"k", b"v", 5, False, "table")]


def test_vmdk():
    from evidencelake.sources import containers

    grain = random.Random(3).randbytes(4096)
    disk = bytearray(512 * 40)
    disk[:80] = struct.pack("<4sIIQQQQIQQQBcccc", b"KDMV", 1, 3, 32, 8, 0, 0, 512, 0, 4, 0, 0, b"\n", b" ", b"\r", b"\n").ljust(80, b"\0")
    disk[4 * 512 : 4 * 512 + 4] = struct.pack("<I", 6)
    disk[6 * 512 : 6 * 512 + 16] = struct.pack("<4I", 0, 16, 0, 0)
    disk[16 * 512 : 24 * 512] = grain
    vmdk = containers.SparseVmdk(reader(bytes(disk)))
    assert vmdk.size == 16384 and vmdk.read_at(0, 16384) == bytes(4096) + grain + bytes(8192) and vmdk.read_at(4100, 10) == grain[4:14]


def evtx():
    chunk = bytearray(65536)
    chunk[:8] = b"ElfChnk\0"
    out = bytearray()
    base = 512 + 24

    def named(text):  # a name that follows its own reference
        place = base + len(out) + 4
        return struct.pack("<I", place) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def opened(name, more=False):
        out.extend(struct.pack("<BHI", 0x41 if more else 0x01, 0xFFFF, 0))
        out.extend(named(name))
        if more:
            out.extend(bytes(4))

    def text(value):
        out.extend(struct.pack("<BBH", 5, 1, len(value)) + value.encode("utf-16-le"))

    out.extend(b"\x0f\x01\x01\0\x0c\x01" + bytes(4))
    template = base + len(out) + 4
    out.extend(struct.pack("<I", template))
    head = len(out)
    out.extend(bytes(24))
    out.extend(b"\x0f\x01\x01\0")
    opened("Event")
    out.append(2)
    opened("System")
    out.append(2)
    opened("EventID")
    out.append(2)
    out.extend(struct.pack("<BHB", 0x0D, 0, 6))
    out.extend(b"\x04")
    opened("Computer")
    out.append(2)
    text("HOST")
    out.extend(b"\x04\x04")
    opened("EventData")
    out.append(2)
    opened("Data", True)
    out.append(6)
    out.extend(named("Name"))
    text("who")
    out.append(2)
    out.extend(struct.pack("<BHB", 0x0E, 1, 1))
    out.extend(b"\x04\x04\x04\0")
    struct.pack_into("<I", out, head + 20, len(out) - head - 24)
    values = [(6, struct.pack("<H", 4624)), (1, "ann".encode("utf-16-le"))]
    out.extend(struct.pack("<I", 2) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values) + b"\0")
    record = struct.pack("<IIQQ", 0x2A2A, 28 + len(out), 7, stamp(100)) + out + struct.pack("<I", 28 + len(out))
    chunk[512 : 512 + len(record)] = record
    struct.pack_into("<I", chunk, 48, 512 + len(record))
    return b"ElfFile\0".ljust(4096, b"\0") + bytes(chunk)


def test_evtx(spark):
    row = artefacts.rows_of(files(spark, evtx()), "evtx").first()
    assert row.unsupported is None and row.problem is None
    assert (row.record_id, row.event_id, row.computer, row.fields["Event/EventData/who"]) == (7, "4624", "HOST", "ann")


def test_a_missing_piece_is_an_error(tmp_path):
    for n in (1, 2, 4):
        (tmp_path / f"s.{n:03d}").write_bytes(b"x" * 1000)
    with pytest.raises(ValueError, match="003"):
        images.segments(str(tmp_path / "s.001"))
    (tmp_path / "s.003").write_bytes(b"x" * 1000)
    assert len(images.segments(str(tmp_path / "s.001"))) == 4
    for n in ("E01", "E03"):
        (tmp_path / f"t.{n}").write_bytes(b"x")
    with pytest.raises(ValueError, match="E02"):
        images.segments(str(tmp_path / "t.E01"))

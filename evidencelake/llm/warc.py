"""WARC archives with a Zstandard dictionary of their own, written in the shared folder and read back.

Each archive (``.warc.zst``) begins with a skippable frame that holds a dictionary built from its own records;
each record is a frame of its own. Of records with equal payloads of at least ``least`` bytes the one with the
smallest page_id is a response and the others revisit it. Null html or url is empty; a null page_id sorts last and,
where its whole group has none, makes a response; rows that repeat both id and payload of a response are responses.
Extra columns are not read; an empty table writes no archive.

Tasks name their files at random and say so in rows; only files that a finished task names are read, so a task
that is run again, or an executor that is lost, leaves at most a file that nobody reads. The rows, one an archive, are
gathered in one file, and archives are read in as many tasks as their bytes ask for: with each file that Spark writes, an
executor starts processes of its own, so small tables in many partitions shouldn't become many files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm.common import cut, map_rows, shared_dir

#: Payload bytes of an archive, of the sample its dictionary is built from, and of the dictionary.
ARCHIVE, SAMPLE, DICTIONARY, LEVEL, LEAST = 24 << 20, 1 << 20, 48 << 10, 3, 100
#: Bytes of records that a task reads, if archives are smaller than that.
READ = 8 << 20
# Fixed value: the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers: int | None, at: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only, which still says the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {at}", f"WARC-Target-URI: {_BREAKS.sub(lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], sample: int = SAMPLE, size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Built from records evenly spread over the archive, ``sample`` bytes in all; of too few, the first bytes themselves."""
    total = sum(map(len, records))
    step = max(1, total // sample)
    chosen = [r[: sample // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 10)), chosen)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[:size] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    shared = dictionary(records)
    raw = shared.as_bytes()
    writer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
    return b"".join((struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(writer.compress, records)))


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, by its bytes alone."""
    at, shared = 0, None
    if data[:4] == struct.pack("<I", DICTIONARY_FRAME):
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = data[8 : 8 + size], 8 + size
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        shared = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    reader = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            part = data[at : at + 32768]
            if not part:
                raise ValueError("an archive ends within a record")
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        yield b"".join(out)


def read_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the payload's size as the HTTP header says it, and the payload that is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, in the form that every executor's file system takes."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, size: int = ARCHIVE) -> DataFrame:
    """(path, n_records, raw_bytes, stored_bytes) of each archive that was written below ``folder``."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    firsts = full.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = full.join(firsts, "digest", "left").withColumn("refers", F.when(F.col("first") != F.coalesce("page_id", F.lit(-1) + F.col("first")), F.col("first")))

    def write(source: Iterator[dict]) -> Iterator[tuple]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        held: list[bytes] = []
        raw = 0

        def flush() -> tuple:
            data = archive(held)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with where.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            return (f"{folder}/{name}", len(held), raw, len(data))

        for r in source:
            held.append(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["size"], r["refers"]))
            raw += len(held[-1])
            if raw >= size:
                yield flush()
                held, raw = [], 0
        if held:
            yield flush()

    return cut(map_rows(known.select("page_id", "url", "html", "size", "digest", "refers"), "path string, n_records long, raw_bytes long, stored_bytes long", write, out_rows=1).repartition(1))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of each record of the archives.

    A response's payload is measured anew and must be what its header says.
    """

    def read(source: Iterator[dict]) -> Iterator[tuple]:
        number = lambda urn: None if urn is None or urn.endswith("null>") else int(urn[10:-1])
        for r in source:
            where, path = fs.FileSystem.from_uri(r["path"])
            with where.open_input_stream(path, compression=None) as file:
                data = file.read()
            for raw in records(data):
                fields, size, payload = read_record(raw)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a payload of {path} is not what its header says")
                yield (number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], number(fields.get("WARC-Refers-To")), size, digest)

    n, raw = manifest.agg(F.count("*"), F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()
    files = manifest.select("path").repartition(max(1, min(n, -(-raw // READ))))
    return map_rows(files, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string", read)

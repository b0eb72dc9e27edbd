"""What an examiner's views derive from stored rows: annotated hits, downloads, flags, tagged items, slices and totals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators.intervals import CELL

# Match kinds from the least to the gravest, ways to find a carved file's length from weak to strong.
MATCH_KINDS = ["known_good", "notable", "known_bad"]
LENGTH_WAYS = ["estimate", "footer", "structure"]
# Units of sizes, sizes of bitmap headers, and the first bytes of media types.
UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}
BITMAP_HEADERS = [12, 16, 40, 52, 56, 64, 108, 124]
MEDIA = [("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("25504446", "application/pdf"), ("494433", "audio/mpeg"), ("4F676753", "audio/ogg")]
PARTIAL_EXAMPLES, NEWEST = 12, 20_000


def by_rank(kind: Column, ranks: list[str]) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in ranks)), kind)


def annotate_hits(hits: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """``hits`` with the gravest ``match_kind`` and all ``matches`` of their file; null where no set knows it."""
    known = matches.groupBy(*keys).agg(F.max_by("kind", by_rank(F.col("kind"), MATCH_KINDS)).alias("match_kind"), F.sort_array(F.collect_set("kind")).alias("matches"))
    return hits.join(known, keys, "left")


def download_urls(downloads: DataFrame, chains: DataFrame) -> DataFrame:
    """``downloads`` (id) with the last ``url`` of their chain (id, position, url)."""
    return downloads.join(chains.groupBy("id").agg(F.max_by("url", "position").alias("url")), "id", "left")


def place_downloads(notes: DataFrame, attributes: DataFrame, places: DataFrame, name: str = "downloads/destinationFileURI") -> DataFrame:
    """(target, url, started_at) of annotations whose attribute says that they name a downloaded file."""
    wanted = attributes.where(F.col("name") == name).select(F.col("id").alias("attribute_id"))
    place = places.select(F.col("id").alias("place_id"), "url", F.col("last_visit").alias("started_at"))
    return notes.join(wanted, "attribute_id", "left_semi").join(place, "place_id", "left").select(F.col("content").alias("target"), "url", "started_at")


def flag_of(wanted: DataFrame, flags: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``wanted`` with the first flag of the same keys, where a null key equals a null; other columns of ``flags`` follow."""
    rest = [c for c in flags.columns if c not in keys]
    one = flags.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("flag")).select(*(F.col(k).alias(f"_{k}") for k in keys), "flag.*")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return wanted.join(one, same, "left").drop(*(f"_{k}" for k in keys))


def single_gap(ranges: DataFrame, taken: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """``ranges`` (id, lo, hi) between whose ends, strictly, lies exactly one of the disjoint intervals ``taken``, with it.

    Both sides meet by cells of the axis; starts are counted before they are shuffled further."""
    cells = ranges.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    begun = taken.select(*keys, "start", "end", F.floor(F.col("start") / cell).alias("cell"))
    inside = cells.join(begun, [*keys, "cell"]).where("start > lo AND start < hi")
    found = inside.groupBy(*keys, "id", "lo", "hi").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return found.where("n = 1 AND end < hi").drop("n")


def in_region(marks: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """``marks`` (offset) with lo <= offset < hi of a region, by their place in it; a partition table bounds regions a volume."""
    return marks.join(regions, keys).where("lo <= offset AND offset < hi").withColumn("relative", F.col("offset") - F.col("lo")).drop("hi")


def field_at(points: DataFrame, fields: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """``points`` (pos) with the ``field`` of (start, end, field), disjoint, that covers them; others go."""
    cells = fields.where("end > start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    at = points.withColumn("cell", F.floor(F.col("pos") / cell))
    return at.join(cells, [*keys, "cell"]).where("start <= pos AND pos < end").select(*points.columns, "field")


def tagged_items(rows: DataFrame) -> DataFrame:
    """(ev, part, item, tags): each item once, known by node or else by path, its tags in the order they first came (``seq``)."""
    item = F.coalesce(F.concat(F.lit("n"), F.col("node").cast("string")), F.concat(F.lit("p"), F.col("path")))
    first = rows.groupBy("ev", "part", item.alias("item"), "tag").agg(F.min("seq").alias("seq"))
    tags = F.transform(F.sort_array(F.collect_list(F.struct("seq", "tag"))), lambda x: x["tag"])
    return first.groupBy("ev", "part", "item").agg(F.array_join(tags, ", ").alias("tags"))


def merge_results(parts: DataFrame, keys: list[str], sums: list[str], flags: list[str]) -> DataFrame:
    """Partial results put together: ``sums`` added, ``flags`` true if any is, the first examples by part."""
    total = parts.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags))
    each = parts.select(*keys, "part", F.posexplode("partial_examples").alias("pos", "example"))
    order = Window.partitionBy(*keys).orderBy("part", "pos")
    few = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PARTIAL_EXAMPLES)
    listed = few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "example"))), lambda x: x["example"]).alias("partial_examples"))
    return total.join(listed, keys, "left")


def size_of(text: Column) -> Column:
    """Bytes that a size such as ``10mb`` or ``1.5 k`` means; null if it is none."""
    pattern = r"^([0-9]*\.?[0-9]+|[0-9]+\.)\s*([kmgtKMGT]?)[bB]?$"
    number = F.regexp_extract(F.trim(text), pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(F.trim(text), pattern, 2))
    shift = reduce(lambda c, u: c.when(unit == u[0], float(1 << u[1])), UNITS.items(), F.when(F.lit(False), 1.0))
    return F.floor(number * shift + 0.5)


def filters(extensions: str = "", least: str = "", most: str = "", after: str = "", before: str = "", deleted_only: bool = False, files_only: bool = False) -> dict:
    """What a filter form asks for: extensions split, sizes in bytes, the last day whole; empty fields are left out."""

    def size(text: str) -> int | None:
        found = re.fullmatch(r"([0-9]*\.?[0-9]+|[0-9]+\.)\s*([kmgt]?)b?", text.strip().lower())
        return int(float(found[1]) * (1 << UNITS[found[2]]) + 0.5) if found else None

    made = {
        "extensions": [x for e in extensions.split(",") if (x := e.strip().removeprefix(".").lower())] or None, "min_size": size(least), "max_size": size(most),
        "modified_after": after or None, "modified_before": f"{before}T23:59:59Z" if before else None, "deleted_only": deleted_only or None, "files_only": files_only or None,
    }
    return {k: v for k, v in made.items() if v is not None}


def available(volumes: DataFrame, catalogue: list[tuple[str, str]]) -> DataFrame:
    """(ev, artefact, available, because) of each artefact (id, needs) by the volumes (ev, detected) of an exhibit."""
    has = volumes.groupBy("ev").agg(F.coalesce(F.bool_or(F.col("detected") == "NTFS"), F.lit(False)).alias("ntfs"), F.bool_or(F.col("detected").isNotNull()).alias("any"))
    rows = has.select("ev", "ntfs", "any", F.inline(F.array(*(F.struct(F.lit(i).alias("artefact"), F.lit(n).alias("needs")) for i, n in catalogue))))
    because = (
        F.when(F.contains("needs", F.lit("NTFS")) & ~F.col("ntfs"), "no NTFS volume")
        .when(F.contains("needs", F.lit("Windows volume")) & ~F.col("ntfs"), "no Windows volume")
        .when(F.contains("needs", F.lit("filesystem walk")) & ~F.col("any"), "no readable file system")
    )
    return rows.select("ev", "artefact", because.isNull().alias("available"), because.alias("because"))


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def markup_kind(data: Column, name: Column) -> Column:
    """svg or html by the first bytes, or by the name where there is any tag; else null."""
    head = F.lower(F.substring(F.regexp_replace(_latin(F.substring(data, 1, 4096)), r"^[\t-\r ]+", ""), 1, 512))
    tag, ends = F.contains(head, F.lit("<")), F.lower(name)
    html = reduce(lambda a, b: a | b, [F.contains(head, F.lit(x)) for x in ("<!doctype html", "<html", "<body")])
    return F.when(F.contains(head, F.lit("<svg")) | (F.endswith(ends, F.lit(".svg")) & tag), "svg").when(html | (ends.rlike(r"\.(html|htm|xhtml|mht)$") & tag), "html")


def media_type(data: Column) -> Column:
    """The media type by the first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    form = F.substring(head, 17, 8)
    chain = reduce(lambda c, s: c.when(F.startswith(head, F.lit(s[0])), s[1]), MEDIA, F.when(F.lit(False), ""))
    chain = chain.when((F.substring(head, 9, 8) == "66747970") & (F.length(head) == 24), F.when(form == "71742020", "video/quicktime").otherwise("video/mp4"))
    riff = F.startswith(head, F.lit("52494646"))
    for four, kind in (("57454250", "image/webp"), ("57415645", "audio/wav"), ("41564920", "video/x-msvideo")):
        chain = chain.when(riff & (form == four), kind)
    return chain.otherwise("application/octet-stream")


def looks_textual(data: Column, sample: int = 4096) -> Column:
    """Whether over 0.92 of the first bytes print and no two zeros stand side by side in the first 512."""
    head = _latin(F.substring(data, 1, sample))
    zeros = F.contains(F.substring(head, 1, 512), F.lit("\0\0"))
    return (F.length(head) > 0) & ~zeros & (F.length(F.regexp_replace(head, r"[^\t-\r -~]", "")) > F.length(head) * 0.92)


def little(data: Column, at: Column | int, size: int) -> Column:
    """The little-endian number at a byte place from 0; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    raw = [F.substring(data, at + F.lit(i + 1), F.lit(1)) for i in reversed(range(size))]
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.concat(*raw)), 16, 10).cast("long"))


def program_plausible(data: Column) -> Column:
    """Whether the new header's mark stands where the old header says; for a place outside, by the old program's message."""
    at, n = little(data, 0x3C, 4), F.octet_length(data)
    message = F.contains(_latin(F.substring(data, 1, 256)), F.lit("This program cannot be run in DOS mode"))
    return F.when(n < 0x40, False).when((at <= 0) | (at >= (1 << 31)) | (at > n - 4), message).otherwise(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(2))) == "5045")


def bitmap_plausible(data: Column) -> Column:
    size = little(data, 2, 4)
    return F.when(F.octet_length(data) < 18, False).otherwise((size >= 26) & (size < (1 << 31)) & (little(data, 6, 4) == 0) & little(data, 14, 4).isin(BITMAP_HEADERS))


def carve_catalogue(signatures: DataFrame) -> DataFrame:
    """(ext, name, headers, length) of (seq, ext, name, head, how): a line an extension, its strongest way to find a length."""
    headers = F.transform(F.sort_array(F.collect_list(F.struct("seq", "head"))), lambda x: x["head"])
    return signatures.groupBy("ext").agg(F.min_by("name", "seq").alias("name"), headers.alias("headers"), F.max_by("how", by_rank(F.col("how"), LENGTH_WAYS)).alias("length"))


def newest(rows: DataFrame, time: str, *ties: str, most: int = NEWEST) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(time), *ties).limit(most)


def browser_slice(history: DataFrame, downloads: DataFrame, kind: str | None = None) -> DataFrame:
    """(product, url, at) of one kind: Downloads, Recovered (deleted history), History, or all where none is named."""
    rows = ["product", "url", "at"]
    if kind == "Downloads":
        return downloads.select(rows)
    if kind in ("Recovered", "History"):
        return history.where("deleted" if kind == "Recovered" else "NOT deleted").select(rows)
    return history.select(rows).unionByName(downloads.select(rows))


def totals(*parts: DataFrame) -> DataFrame:
    """One row: the sum of every column of tables that may have different columns; 0 where there is none."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole.columns))


def folder_entries(users: DataFrame) -> DataFrame:
    """(user, hive, and the entry's columns) of (user, source, entries)."""
    return users.select("user", F.col("source").alias("hive"), F.inline("entries"))


def marks_of(marks: DataFrame, category: str | None = None, uncategorised: bool = False, in_report: bool | None = None) -> DataFrame:
    none = F.coalesce("category", F.lit("")) == ""
    kept = marks.where(none) if uncategorised else marks.where(F.col("category") == category) if category else marks
    return kept if in_report is None else kept.where(F.coalesce("in_report", F.lit(False)) == in_report)


def scoped(rows: DataFrame, evidence: int | None = None, part: int | None = None) -> DataFrame:
    """Rows of one exhibit, or of one of its parts: plain conjunctions, which reach the scan."""
    rows = rows if evidence is None else rows.where(F.col("evidence_id") == evidence)
    return rows if part is None else rows.where(F.col("part") == part)

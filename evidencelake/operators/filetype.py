"""File-type verification: what a name says against what the first bytes say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators.entries import type_extension

# Signatures at the start of a file: type, offset, hex digits.
SIGNATURES = [
    ("png", 0, "89504e470d0a1a0a"), ("gif", 0, "474946383961"), ("gif", 0, "474946383761"), ("jpg", 0, "ffd8ff"), ("pdf", 0, "255044462d"),
    ("zip", 0, "504b0304"), ("7z", 0, "377abcaf271c"), ("rar", 0, "526172211a07"), ("gz", 0, "1f8b08"), ("bz2", 0, "425a68"), ("xz", 0, "fd377a585a00"),
    ("exe", 0, "4d5a"), ("elf", 0, "7f454c46"), ("sqlite", 0, "53514c69746520666f726d6174203300"), ("ole", 0, "d0cf11e0a1b11ae1"), ("rtf", 0, "7b5c727466"),
    ("evtx", 0, "456c6646696c6500"), ("regf", 0, "72656766"), ("pst", 0, "2142444e"), ("bmp", 0, "424d"), ("tif", 0, "49492a00"), ("tif", 0, "4d4d002a"),
    ("ogg", 0, "4f676753"), ("flac", 0, "664c6143"), ("mp3", 0, "494433"), ("wav", 8, "57415645"), ("avi", 8, "41564920"), ("webp", 8, "57454250"),
    ("mp4", 4, "66747970"), ("lnk", 0, "4c0000000114020000000000c000000000000046"), ("class", 0, "cafebabe"), ("ps", 0, "25215053"), ("tar", 257, "7573746172"),
]
# Contents that an extension may have.
EXTENSIONS = {
    "png": ["png"], "gif": ["gif"], "jpg": ["jpg"], "jpeg": ["jpg"], "pdf": ["pdf"], "zip": ["zip"], "docx": ["zip"], "xlsx": ["zip"], "pptx": ["zip"], "jar": ["zip"],
    "7z": ["7z"], "rar": ["rar"], "gz": ["gz"], "tgz": ["gz"], "bz2": ["bz2"], "xz": ["xz"], "exe": ["exe"], "dll": ["exe"], "sys": ["exe"], "db": ["sqlite"], "sqlite": ["sqlite"],
    "doc": ["ole"], "xls": ["ole"], "ppt": ["ole"], "msg": ["ole"], "rtf": ["rtf"], "evtx": ["evtx"], "pst": ["pst"], "bmp": ["bmp"], "tif": ["tif"], "tiff": ["tif"],
    "ogg": ["ogg"], "flac": ["flac"], "mp3": ["mp3"], "wav": ["wav"], "avi": ["avi"], "webp": ["webp"], "mp4": ["mp4"], "mov": ["mp4"], "lnk": ["lnk"], "tar": ["tar"],
    "html": ["html"], "htm": ["html"], "txt": ["html", "rtf", None], "csv": ["html", None], "log": [None], "xml": [None, "html"],
}
TEXTUAL = ("html", "rtf")


def detect(head: Column) -> Column:
    """The type that the longest matching signature names: one literal expression, no join."""
    branch = None
    for kind, offset, digits in sorted(SIGNATURES, key=lambda s: -len(s[2])):
        hit = F.substring(head, offset + 1, len(digits) // 2) == F.unhex(F.lit(digits))
        branch = F.when(hit, kind) if branch is None else branch.when(hit, kind)
    start = F.lower(F.decode(F.substring(head, 1, 15), "ISO-8859-1"))
    return branch.when(start.startswith("<!doctype html") | start.startswith("<html"), "html")


def verify(files: DataFrame) -> DataFrame:
    """``files`` (name, head) with extension, detected, verdict and severity."""
    known = F.create_map(*(x for e, kinds in EXTENSIONS.items() for x in (F.lit(e), F.array(*(F.lit(k or "") for k in kinds)))))
    df = files.withColumn("extension", type_extension(F.col("name"))).withColumn("detected", detect(F.col("head")))
    allowed = F.try_element_at(known, F.col("extension"))
    verdict = (
        F.when(F.col("head").isNull(), "unreadable").when(F.octet_length("head") == 0, "empty").when(F.col("extension").isNull(), "no extension")
        .when(allowed.isNull(), "unknown extension").when(F.array_contains(allowed, F.coalesce("detected", F.lit("")).cast("string")) & F.col("detected").isNotNull(), "match")
        .when(F.col("detected").isNull() & F.array_contains(allowed, F.lit("")), "no signature").otherwise("mismatch")
    )
    df = df.withColumn("verdict", verdict)
    low = F.col("detected").isin(*TEXTUAL)
    return df.withColumn("severity", F.when((F.col("verdict") == "mismatch") & F.coalesce(low, F.lit(False)), "medium").when(F.col("verdict") == "mismatch", "high"))


def ordered_mismatches(verified: DataFrame, limit: int) -> DataFrame:
    """The report's first ``limit`` mismatches, the severe first; only these rows are numbered."""
    order = [F.when(F.col("severity") == "high", 0).otherwise(1), F.col("name"), F.col("node")]
    page = verified.where("verdict = 'mismatch'").orderBy(*order).limit(limit)
    return page.select("node", "name", "detected", F.row_number().over(Window.orderBy(*order)).alias("place"))

"""Files as rows: reading, checks before parsing, streams, licences of fonts, turns of pictures, and saved résumés."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

# What a file's first bytes and trailer say, and the tags of font tables and pictures.
PDF, JPEG, PNG = "%PDF-", "FFD8FF", "89504E470D0A1A0A"
ENCRYPTED = r"/Encrypt\s*([0-9]+\s+[0-9]+\s+R|<<)"
FONT_KINDS = ("00010000", "74727565", "4F54544F")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, content) of the files under a path; a file is a row, files are dealt over the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def latin_text(content: Column) -> Column:
    """Bytes as text of as many characters."""
    return F.decode(content, "ISO-8859-1")


def latin_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def checked_files(files: DataFrame) -> DataFrame:
    """files (name, content) with kind (pdf, jpeg, png, other) and code: why a file can't be opened (invalid, encrypted), null if it can. Texts of files aren't parsed for it."""
    start = F.hex(F.substring("content", 1, 8))
    kind = F.when(latin_text(F.substring("content", 1, 1024)).contains(PDF), "pdf").when(start.startswith(JPEG), "jpeg").when(start == PNG, "png").otherwise("other")
    out = files.withColumn("kind", kind)
    return out.withColumn("code", F.when(F.col("kind") == "other", "invalid").when((F.col("kind") == "pdf") & latin_text(F.col("content")).rlike(ENCRYPTED), "encrypted"))


def unsigned(content: Column, at: Column, size: int) -> Column:
    """The number in `size` bytes from a place counted from 0; null beyond the end."""
    part = F.substring(content, at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def font_licence(content: Column) -> Column:
    """The licence bits of a font: from its table OS/2; null if the bytes are no font or have none."""
    n = unsigned(content, F.lit(4), 2)
    tables = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda t: F.when(F.substring(content, 13 + 16 * t, F.lit(4)) == F.lit(b"OS/2"), unsigned(content, 20 + 16 * t, 4)))
    place = F.get(F.array_compact(tables), F.lit(0)).cast("int")
    return F.when(F.hex(F.substring(content, 1, 4)).isin(*FONT_KINDS) & (n > 0), unsigned(content, place + 8, 2))


def orientation(data: bytes) -> int:
    """How a JPEG picture is turned, 1 to 8: the entry 0x0112 of its Exif part; 1 if there is none."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 < len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        if data[at + 1] == 0xE1 and data[at + 4 : at + 6] == b"Ex":
            base = at + 10
            order = "little" if data[base : base + 1] == b"I" else "big"
            number = lambda i, n: int.from_bytes(data[i : i + n], order)  # noqa: E731, B023
            first = base + number(base + 4, 4)
            entries = (first + 2 + 12 * i for i in range(number(first, 2)))
            return next((number(e + 8, 2) for e in entries if number(e, 2) == 0x0112), 1)
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 1


@F.pandas_udf(IntegerType())
def picture_orientation(content: pd.Series) -> pd.Series:
    return content.map(lambda b: 1 if b is None else orientation(bytes(b)))


def inflate(data: bytes | None) -> bytes | None:
    try:
        return None if data is None else zlib.decompress(bytes(data))
    except zlib.error:
        return None


@F.pandas_udf(BinaryType())
def inflated(content: pd.Series) -> pd.Series:
    """What a deflated stream holds; null if it is broken."""
    return content.map(inflate)


def content_strings(streams: DataFrame) -> DataFrame:
    """(page, stream) of the parts (page, at, content) of pages' streams: in order, a line break between, as text of as many characters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", latin_text(F.col("content")).alias("t")))), lambda p: p["t"])
    return streams.groupBy("page").agg(F.array_join(ordered, "\n").alias("stream"))


def save_resumes(resumes: DataFrame, path: str, photo: str = "photo", most: int = 5_000_000) -> None:
    """Saves résumés as lines of JSON; a photograph over `most` characters is left out, the text is kept."""
    kept = resumes.withColumn(photo, F.when(F.length(photo) <= most, F.col(photo))) if photo in resumes.columns else resumes
    kept.write.mode("overwrite").json(path)

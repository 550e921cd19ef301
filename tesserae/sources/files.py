"""Files as rows: discovery with reasons for what is skipped, and readers for texts, documents and images."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as rules

#: What is read, by mode, and size limits (exceeded only by larger files).
TEXTS, IMAGES = (".md", ".txt", ".mdx", ".pdf", ".docx"), (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
MOST_TEXT, MOST_IMAGE = 10 << 20, 50 << 20
#: First bytes of images in hex.
SIGNATURES = {
    ".jpg": "^FFD8FF", ".jpeg": "^FFD8FF", ".png": "^89504E470D0A1A0A", ".gif": "^47494638(37|39)61", ".webp": "^52494646.{8}57454250", ".bmp": "^424D",
}


def discover(spark: SparkSession, path: str, recursive: bool = True, mode: str = "text") -> DataFrame:
    """(path, ext, length, modificationTime, content, reason): all files; reason says why one is skipped, null if it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumn("ext", rules.extension(F.col("path")))
    return files.select("path", "ext", "length", "modificationTime", "content", skip_reason(mode).alias("reason"))


def skip_reason(mode: str = "text") -> Column:
    """Why a file (columns ext, length, content) isn't read; null if it is."""
    image = F.col("ext").isin(*IMAGES)
    signed = F.lit(False)
    for ext, first in SIGNATURES.items():
        signed = signed | ((F.col("ext") == ext) & F.hex(F.substring("content", 1, 12)).rlike(first))
    return (
        F.when(~F.col("ext").isin(*TEXTS, *IMAGES), "unsupported extension")
        .when(image & F.lit(mode == "text"), "images need multimodal mode")
        .when(F.col("length") > F.when(image, MOST_IMAGE).otherwise(MOST_TEXT), "file too large")
        .when(image & (F.col("length") == 0), "empty file").when(image & ~signed, "not the image that its extension says")
    )


def _udf(function: Callable[[bytes], object], kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else function(bytes(x)))

    return run


def docx_text(content: bytes) -> str | None:
    """The paragraphs of a Word document; null if it can't be read."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n\n".join(x for p in body.iter(f"{space}p") if (x := "".join(t.text or "" for t in p.iter(f"{space}t"))))


def pdf_text(content: bytes) -> str | None:
    """The text of a PDF, where the optional library pypdf is installed; else null."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
    except Exception:  # whatever a broken file raises is that file's error
        return None


def dimensions(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, JPEG, GIF, WebP or BMP image; null if it isn't one or is cut short."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", content[16:24])
        if content[:3] == b"GIF":
            return struct.unpack("<HH", content[6:10])
        if content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
            return abs(w), abs(h)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            if content[12:16] == b"VP8L":
                bits = int.from_bytes(content[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            w, h = struct.unpack("<HH", content[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if content[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(content):
                marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
                if marker in (0xC0, 0xC2):
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except struct.error:
        pass
    return None


def image_size(content: Column) -> Column:
    """STRUCT<width, height>; 0 x 0 where it can't be told."""
    @F.pandas_udf("struct<width int, height int>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions(bytes(x)) or (0, 0) for x in contents], columns=["width", "height"])

    return run(content)


def documents(files: DataFrame, caption: Callable[[Column], Column] | None = None, data: bool = False) -> DataFrame:
    """(source, title, content, content_type, error) of discovered files. Images become texts about them, with a caption if a function is given.

    ``data``: with a column of that name, the bytes of images, for embedders of images.
    """
    ok = files.where("reason IS NULL")
    plain = F.decode(F.col("content"), "UTF-8")
    only = lambda ext: F.when(F.col("ext") == ext, F.col("content"))  # noqa: E731 - Python gets the bytes of these files alone
    read = (
        F.when(F.col("ext") == ".docx", _udf(docx_text, "string")(only(".docx")))
        .when(F.col("ext") == ".pdf", _udf(pdf_text, "string")(only(".pdf"))).otherwise(plain)
    )
    name = rules.basename(F.col("path"))
    image = F.col("ext").isin(*IMAGES)
    size = image_size(F.when(image, F.col("content")).otherwise(F.lit(b"")))
    described = caption(F.col("content")) if caption else F.concat(F.lit("Image file: "), name)
    about = F.concat_ws(
        "\n", F.concat(F.lit("Image: "), name), F.concat(F.lit("Description: "), described),
        F.concat(F.lit("Dimensions: "), size["width"], F.lit("x"), size["height"]), F.concat(F.lit("Format: "), F.upper(F.substring("ext", 2, 10))),
    )
    out = ok.select(F.col("path").alias("source"), F.when(image, about).otherwise(read).alias("content"), F.when(image, "image").when(F.col("ext").isin(".pdf", ".docx"), F.substring("ext", 2, 10)).otherwise("text").alias("content_type"), *[F.when(image, F.col("content")).alias("data")] * data)
    error = F.when(F.coalesce(rules.trim(F.col("content")), F.lit("")) == "", F.concat(F.lit("no content in "), F.col("source")))
    return out.select("source", rules.title(F.coalesce("content", F.lit("")), F.col("source")).alias("title"), "content", "content_type", error.alias("error"), *["data"] * data)


def from_memory(rows: DataFrame, name: str = "display_name", content: str = "content") -> DataFrame:
    """Contents that are at hand: (display_name, content) rows as files."""
    data = F.col(content).cast("binary")
    return rows.select(
        F.col(name).alias("path"), rules.extension(F.col(name)).alias("ext"), F.octet_length(data).cast("long").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"), data.alias("content"), F.lit(None).cast("string").alias("reason"),
    )


def in_mode(docs: DataFrame, mode: str, kind: str = "content_type") -> tuple[DataFrame, DataFrame]:
    """Documents that the mode takes, and the others with a reason."""
    fits = F.lit(True) if mode == "multimodal" else F.coalesce(F.col(kind).isin("text", "pdf", "docx", "application/pdf") | F.col(kind).startswith("text/"), F.lit(False))
    return docs.where(fits), docs.where(~fits).withColumn("reason", F.concat(F.lit("not taken in text mode: "), F.coalesce(kind, F.lit("unknown"))))

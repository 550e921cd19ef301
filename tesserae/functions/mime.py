"""Content types by first bytes, by extension and by guess; sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY = "application/octet-stream"
#: Content types by extension.
BY_EXTENSION = {
    ".txt": "text/plain", ".text": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".mdown": "text/markdown",
    ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".js": "application/javascript", ".mjs": "application/javascript",
    ".json": "application/json", ".xml": "application/xml", ".csv": "text/csv", ".rtf": "application/rtf", ".pdf": "application/pdf",
    ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".odt": "application/vnd.oasis.opendocument.text", ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
    ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".ico": "image/x-icon",
    ".svg": "image/svg+xml", ".avif": "image/avif", ".heic": "image/heic", ".heif": "image/heic", ".zip": "application/zip",
    ".rar": "application/vnd.rar", ".7z": "application/x-7z-compressed", ".tar": "application/x-tar", ".gz": "application/gzip",
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg", ".flac": "audio/flac", ".mp4": "video/mp4", ".avi": "video/x-msvideo",
    ".mov": "video/quicktime", ".webm": "video/webm",
}
#: Types that are taken in beside these text, document and image types.
SUPPORTED = tuple(sorted({
    v for k, v in BY_EXTENSION.items() if v.split("/")[0] == "text" or k in (".json", ".xml", ".js", ".rtf", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp")
} | {"image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/tiff", "image/svg+xml", "image/avif", "image/heic", BINARY, "application/zip"}))
#: First bytes in hex, in the order they are tried.
MAGIC = (
    ("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"),
    ("474946383961", "image/gif"), ("52494646........57454250", "image/webp"), ("504B0304", "application/zip"), ("504B0506", "application/zip"),
    ("504B0708", "application/zip"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("00000100", "image/x-icon"),
)
UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}


def by_magic(content: Column) -> Column:
    """The type that the first bytes of a binary column tell; ``BINARY`` if none does."""
    head = F.hex(F.substring(content, 1, 32))
    start = F.lower(F.decode(F.substring(content, 1, 32), "ISO-8859-1"))
    out = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, BINARY)
    for first, kind in MAGIC:
        out = out.when(head.rlike(f"^{first}"), kind)
    sample = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    long = F.length(content) >= 5
    return (
        out.when(long & start.contains("<svg"), "image/svg+xml")
        .when(long & (start.contains("<!doctype html") | start.contains("<html") | start.contains("<head")), "text/html")
        .when(long & start.startswith("<?xml"), "application/xml")
        .when(start.rlike(r"^\s*[\{\[]") & F.try_parse_json(sample).isNotNull(), "application/json").otherwise(BINARY)
    )


def by_extension(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    dotted = F.lower(F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext)))
    return F.coalesce(F.try_element_at(table, dotted), F.lit(BINARY))


def is_text(content: Column) -> Column:
    """Under 5 % of the first 2048 bytes (after a byte order mark) are control bytes other than tab, newlines and form feed."""
    head = F.hex(F.substring(content, 1, 2048))
    head = F.regexp_replace(head, "^(EFBBBF|FFFE|FEFF)", "")
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    n = F.length(head) / 2
    odd = n - F.length(F.regexp_replace(pairs, "(0[0-8BEF]|1[0-9A-F]|7F) ", "")) / 3
    return F.when(n > 0, odd / n < 0.05).otherwise(F.lit(True))


def detect(content: Column, ext: Column) -> Column:
    magic, named = by_magic(content), by_extension(ext)
    return F.when(magic != BINARY, magic).when(named != BINARY, named).when(is_text(content), "text/plain").otherwise(BINARY)


def supported(kind: Column) -> Column:
    return kind.isin(*SUPPORTED)


def extension_of(kind: Column) -> Column:
    """The first extension of a type; '.bin' if there is none."""
    back: dict[str, str] = {}
    for ext, name in BY_EXTENSION.items():
        back.setdefault(name, ext)
    table = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(".bin"))


def embedding_kind(kind: Column) -> Column:
    return F.when(kind.startswith("image"), "image").otherwise("text")


def size_bytes(text: Column) -> Column:
    """'1.5 MB' as bytes; null if it isn't a size."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(B|KB|MB|GB|TB)?\s*$"
    number, unit = F.regexp_extract(F.upper(text), pattern, 1), F.regexp_extract(F.upper(text), pattern, 2)
    power = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(1024**v))])
    times = F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(power, unit))
    return F.when(number != "", F.round(number.cast("double") * times).cast("long"))

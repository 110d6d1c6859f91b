"""Column functions on text: blanks, names, paths, types of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def effective(corrected: Column, value: Column) -> Column:
    """The reviewer's correction, else the extracted value; blanks are null."""
    return F.coalesce(blank_to_null(corrected), blank_to_null(value))


def title_case(c: Column) -> Column:
    """First letter of each word upper, the rest lower; words also begin after - and '."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9À-ɏ]+|[^a-z0-9À-ɏ]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(x.substr(F.lit(1), F.lit(1))), x.substr(F.lit(2), F.length(x)))), "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or ''."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


#: Media type and category of the extensions that are accepted.
MIME = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".txt": "text/plain",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
CATEGORY = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image", ".txt": "text", ".docx": "office"}


def lookup(c: Column, pairs: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[c], F.lit(default))


def mime(path: Column) -> Column:
    return lookup(extension(path), MIME, "application/octet-stream")


def category(path: Column) -> Column:
    return lookup(extension(path), CATEGORY, "other")


def remap(path: Column, old: str, new: str) -> Column:
    """Path with forward slashes, moved from one root to another; null outside the old root."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(F.startswith(p, F.lit(old.rstrip("/") + "/")), F.concat(F.lit(new.rstrip("/")), F.substring(p, len(old.rstrip("/")) + 1, 1 << 20)))


def asset_url(path: Column, base: str = "/assets") -> Column:
    """Encoded URL below base; null for absolute paths and those with . or .. segments."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^assets/", "")
    parts = F.split(p, "/")
    bad = F.startswith(p, F.lit("/")) | (p == "") | F.exists(parts, lambda x: x.isin("", ".", "..")) | p.contains(":")
    return F.when(~bad, F.concat(F.lit(base + "/"), F.array_join(F.transform(parts, lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")))


def csv_guard(c: Column) -> Column:
    """Cells that a spreadsheet would run as formulas get a leading apostrophe."""
    return F.when(c.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")

"""Text, path and formatting functions as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schemas

#: Extensions that count as text (fixed values).
TEXT_EXTENSIONS = (
    "txt md markdown rst org rs py js ts jsx tsx go java c h cpp hpp cc cs rb php sh bash zsh toml yaml yml json xml html css sql lua swift kt scala el vim conf"
    " ini cfg gitignore env"
).split()
OFFICE_EXTENSIONS = ("docx", "xlsx", "pptx")
#: First bytes of file formats (fixed values): pdf, jpeg, tiff (two byte orders), zip.
MAGIC = {"pdf": ("25504446",), "jpeg": ("FFD8FF",), "tiff": ("49492A00", "4D4D002A"), "zip": ("504B0304",)}


def word_count(text: Column) -> Column:
    """Tokens between Unicode white space; null has none."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s\x0B\x{85}\p{Z}]+"), F.lit(0))).cast("long")


def cap(text: Column, chars: int = schemas.MAX_BODY_CHARS) -> Column:
    """The first ``chars`` characters, never half a character."""
    return F.substring(text, 1, chars)


def trimmed(text: Column) -> Column:
    """Text without Unicode white space at its ends, or null if nothing is left."""
    space = r"[\s\x0B\x{85}\p{Z}]+"
    return F.nullif(F.regexp_replace(text, f"^{space}|{space}$", ""), F.lit(""))


def normal_path(path: Column) -> Column:
    """Absolute path without empty and ``.`` parts; ``..`` drops the part before it, never above the root. Nothing left gives null."""
    drop = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", drop(acc)).otherwise(F.concat(acc, F.array(part)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) > 0, joined(parts))


def joined(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything up to and with the last slash."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)))


def extension(name: Column) -> Column:
    """Lower-case extension of a file name; a leading dot is part of the stem. None gives null."""
    return F.nullif(F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1)), F.lit(""))


def doc_type(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(TEXT_EXTENSIONS), "text").when(ext.isin("pdf", *OFFICE_EXTENSIONS), ext).otherwise("unknown")


def sniffed(head: Column, name: Column) -> Column:
    """Type by first bytes; a zip is told by its extension, anything else too."""
    starts = lambda kind: reduce(lambda a, b: a | b, [F.startswith(head, F.unhex(F.lit(m))) for m in MAGIC[kind]])
    found = F.when(starts("pdf"), "pdf").when(starts("jpeg"), "jpeg").when(starts("tiff"), "tiff")
    return found.when(starts("zip") & extension(name).isin(*OFFICE_EXTENSIONS), extension(name)).otherwise(doc_type(name))


def camera(make: Column, model: Column) -> Column:
    """Model alone if it starts with the make, else both; trimmed, null if neither."""
    make, model = trimmed(make), trimmed(model)
    return F.when(make.isNull() | F.startswith(F.lower(model), F.lower(make)), model).when(model.isNull(), make).otherwise(F.concat(make, F.lit(" "), model))


def any_part(path: Column, names: Column) -> Column:
    """Whether any whole component is one of the names (the rule of watches)."""
    return F.arrays_overlap(F.split(path, "/"), names)


def any_directory(path: Column, names: Column, depth: int = 1) -> Column:
    """Whether a directory below the first ``depth`` components is one of the names (the rule of scans)."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.arrays_overlap(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth - 1, F.lit(0))), names)


def bytes_label(n: Column) -> Column:
    """Binary units; one decimal below 10, none above."""
    label = F.concat(n.cast("string"), F.lit(" B"))
    out = F.when(n < 1024, label)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        value = n / F.lit(float(1024**power))
        text = F.when(value < 10, F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10)).otherwise(F.floor(value + 0.5).cast("string"))
        text = F.concat(text, F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (power + 1), text) if unit != "TiB" else out.otherwise(text)
    return F.when(n.isNull(), "").otherwise(out)


def bytes_label_fixed(n: Column) -> Column:
    """Binary units, always one decimal but for bytes; a value halfway between two decimals goes to the even one."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        # format_string would round halves up.
        text = F.concat(F.call_function("format_number", n / F.lit(float(1024**power)), F.lit("0.0")), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (power + 1), text) if unit != "TiB" else out.otherwise(text)
    return out


def url_joined(base: Column, route: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), route)


def valid_text(raw: Column) -> Column:
    """Bytes as text, malformed sequences replaced by U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))

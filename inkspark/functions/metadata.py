"""Document metadata as column expressions: dates, media types, field kinds, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.search import fold_ascii

#: Extensions and media types.
MEDIA_TYPES = {
    "pdf": "application/pdf", "txt": "text/plain", "xml": "text/xml", "html": "text/html", "htm": "text/html", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "zip": "application/zip",
}
DEFAULT_TYPE = "application/octet-stream"
EXPORT_FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "tif": "tiff", "tiff": "tiff", "bmp": "bmp"}


def media_type(name: Column) -> Column:
    """By the letters after the last dot, ASCII case ignored."""
    extension = F.when(F.contains(name, F.lit(".")), fold_ascii(F.substring_index(name, ".", -1))).otherwise("")
    kind = F.lit(DEFAULT_TYPE)
    for key, value in MEDIA_TYPES.items():
        kind = F.when(extension == key, value).otherwise(kind)
    return kind


def pdf_date(text: Column) -> Column:
    """struct(ok, year, month, day, hour, minute, second, tz_hour, tz_minute) of ``D:YYYYMMDDHHmmSSOHH'mm'``.

    Parts may end early (month and day are then 1, the others 0); anything else leaves ``ok`` false.
    """
    pattern = r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:Z|([+-])([0-9]{2})(?:'(?:([0-9]{2})'?)?)?)?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda k, default: F.when(part(k) == "", default).otherwise(part(k).cast("int"))
    month, day, hour, minute, second = number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0)
    sign = F.when(part(7) == "-", -1).otherwise(1)
    tz_hour, tz_minute = number(8, 0), number(9, 0)
    fits = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60) & (tz_hour <= 23) & (tz_minute <= 59)
    ended = F.coalesce(~text.rlike(r"'$") | text.rlike(r"[+-][0-9]{2}'"), F.lit(False))
    ok = F.coalesce(text.rlike(pattern) & fits & ended, F.lit(False))
    return F.struct(
        ok.alias("ok"), number(1, 0).alias("year"), month.alias("month"), day.alias("day"), hour.alias("hour"), minute.alias("minute"), second.alias("second"),
        (sign * tz_hour).alias("tz_hour"), (sign * tz_minute).alias("tz_minute"),
    )


def field_kind(kind: Column, flags: Column) -> Column:
    """What a form field is, by its type name and flag bits 15 (radio), 16 (push button) and 17 (combo)."""
    bit = lambda k: flags.bitwiseAND(F.lit(1 << k)) != 0
    button = F.when(bit(16), "push_button").when(bit(15), "radio").otherwise("checkbox")
    choice = F.when(bit(17), "dropdown").otherwise("list_box")
    return F.when(kind == "Tx", "text").when(kind == "Ch", choice).when(kind == "Btn", button).when(kind == "Sig", "signature").otherwise("unknown")


def theme_color(base: Column, shade: Column, tint: Column) -> Column:
    """A theme colour RRGGBB blended toward black by ``shade`` or toward white by ``tint`` (two hex digits, or empty)."""
    byte = lambda c, k: F.conv(F.substring(c, k, 2), 16, 10).cast("int")
    ok = base.rlike("^[0-9A-Fa-f]{6}$")
    part = lambda c: byte(c, 1) / F.lit(255.0)

    def channel(k: int) -> Column:
        v = byte(base, k).cast("double")
        dark = F.floor(v * part(shade) + 0.5)
        light = F.floor(v * part(tint) + F.lit(255.0) * (F.lit(1.0) - part(tint)) + 0.5)
        out = F.when(shade != "", dark).when(tint != "", light).otherwise(v)
        return F.lpad(F.hex(F.least(F.greatest(out.cast("long"), F.lit(0)), F.lit(255))), 2, "0")

    return F.when(ok, F.concat(channel(1), channel(3), channel(5))).otherwise("")

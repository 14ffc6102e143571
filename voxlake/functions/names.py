"""Names, addresses and small texts of the catalog, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def voxel_um(text: Column) -> Column:
    """The first `<number>um` in a text, as a double."""
    return F.expr("cast(null as double)") if text is None else F.nullif(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*um", 1), F.lit("")).cast("double")


def pretty_name(code: Column, prefix: str = "") -> Column:
    """Letters and digits apart, leading zeros off: `007Ab12` becomes `7 Ab 12`."""
    body = F.when(code.startswith(prefix), F.substring(code, len(prefix) + 1, 10_000)).otherwise(code) if prefix else code
    body = F.regexp_replace(body, r"([A-Za-z])(\d)", "$1 $2")
    body = F.regexp_replace(body, r"(\d)([A-Za-z])", "$1 $2")
    return F.trim(F.regexp_replace(body, r"^0+(\d)", "$1"))


def master_seed(*parts: Column) -> Column:
    """A 32-bit seed from the MD5 of the parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def window_id(scroll: Column, level: Column, z: Column, y: Column, x: Column) -> Column:
    return F.format_string("s%s_L%d_z%d_y%d_x%d", scroll, level, z, y, x)


def source_label(path: Column, suffix: str = ".zarr") -> Column:
    """The last part of a path, without the store's suffix."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def source_kind(uri: Column) -> Column:
    """`local` for files and stores by path, `http` for what is read over the network, else `scroll`: a name of the catalog."""
    store = F.regexp_replace(uri, "/+$", "").endswith(".zarr")
    remote = uri.startswith("s3://") | uri.startswith("http://") | uri.startswith("https://")
    return F.when(uri.startswith("file://"), "local").when(remote, "http").when(store | uri.startswith("/"), "local").otherwise("scroll")


def duration_text(seconds: Column) -> Column:
    """`45s`, `12m03s`, `1h04m`: the two largest units of a duration in seconds, half to even; `??` for none or without end."""
    s = F.rint(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60) % 60
    text = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), two(minutes), F.lit("m")))
    text = text.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s"))).otherwise(F.concat((s % 60).cast("string"), F.lit("s")))
    return F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), "??").otherwise(text)


def scroll_category(scroll: Column, code: Column, read: list[str], inked: list[str], sought: list[str]) -> Column:
    """`read`, `ink` or `first_letters` by lists of scrolls and codes; empty for all others."""
    return F.when(scroll.isin(read), "read").when(scroll.isin(inked), "ink").when(code.isin(sought), "first_letters").otherwise("")


def scroll_name(scroll: Column, pretty: Column, numbered: list[str]) -> Column:
    return F.when(scroll.isin(numbered), F.concat(F.lit("Scroll "), scroll, F.lit(" ("), pretty, F.lit(")"))).otherwise(pretty)


def volume_token(url: Column) -> Column:
    """The number that follows `volume-` in the last part of a path; null without one."""
    return F.nullif(F.regexp_extract(F.lower(source_label(url)), r"volume-(\d+)", 1), F.lit(""))


def window_pixels(voxel: Column, edge_um: float, low: int, high: int) -> Column:
    """A physical edge in voxels, half to even, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(edge_um / voxel))).cast("int")


def packed_bits(bits: Column) -> Column:
    """An array of 0 and 1 as upper-case hexadecimal bytes, first bit highest, the last byte filled with zeros."""
    bytes_ = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(bits) / 8).cast("int") - 1))
    value = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, k: acc * 2 + F.coalesce(F.get(bits, b * 8 + k).cast("int"), F.lit(0)))
    return F.when(F.size(bits) == 0, "").otherwise(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(value(b)), 2, "0")), ""))


def unpacked_bits(packed: Column, n: Column) -> Column:
    """The first n bits of packed_bits."""
    nibble = lambda i: F.conv(F.substr(packed, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    bit = lambda i: F.floor(nibble(i) / F.pow(F.lit(2), 3 - i % 4)).cast("int") % 2
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), bit))


#: Units of length in micrometres (fixed values).
UNITS = {"micrometer": 1.0, "micron": 1.0, "um": 1.0, "\u00b5m": 1.0, "nanometer": 1e-3, "nm": 1e-3, "millimeter": 1e3, "mm": 1e3, "meter": 1e6, "m": 1e6}
ATTRIBUTES = "multiscales array<struct<axes: array<struct<name: string, unit: string>>, datasets: array<struct<path: string, coordinateTransformations: array<struct<type: string, scale: array<double>>>>>>>"


def voxel_um_from_metadata(attributes: Column) -> Column:
    """The voxel edge along the last axis, in micrometres, from a store's attributes as JSON; null where they do not say."""
    first = F.get(F.from_json(attributes, ATTRIBUTES)["multiscales"], 0)
    steps = F.filter(F.get(first["datasets"], 0)["coordinateTransformations"], lambda t: t["type"] == "scale")
    scale = F.element_at(F.get(steps, 0)["scale"], -1)
    unit = F.lower(F.coalesce(F.nullif(F.element_at(first["axes"], -1)["unit"], F.lit("")), F.lit("micrometer")))
    table = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return scale * F.coalesce(F.try_element_at(table, unit), F.lit(1.0))

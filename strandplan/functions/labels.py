"""Names, classes and colours of map features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column | str, width: int) -> Column:
    """Zero-padded, wider where it has to be."""
    return F.format_string(f"%0{width}d", value)


def odc_label(i: Column | str) -> Column:
    return F.concat(F.lit("ODC "), number(i, 2))


def odp_label(i: Column | str, j: Column | str) -> Column:
    return F.concat(number(i, 2), F.lit("/"), number(j, 2))


def house_label(i: Column | str, j: Column | str, k: Column | str) -> Column:
    return F.concat(odp_label(i, j), F.lit("-"), number(k, 2))


def splitter(capacity: Column | str) -> Column:
    return F.concat(F.lit("1:"), (F.col(capacity) if isinstance(capacity, str) else capacity).cast("string"))


def name_or(name: Column | str, default: str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))


def mapping_kind(name: Column | str) -> Column:
    """What a placed point's name says it is; the first that fits, null if none does."""
    low = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    kind = F.when(low.contains("olt") | low.contains("pop"), "olt").when(low.contains("odc"), "odc")
    return kind.when(low.contains("odp"), "odp").when(low.contains("hc") | low.contains("rumah"), "hc")


def _parts() -> dict[str, Column]:
    name, description = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    return {
        "name": name,
        "upper": F.upper(name),
        "description": description,
        "line": F.col("geom_type").isin("LineString", "MultiLineString"),
        "point": F.col("geom_type").isin("Point", "MultiPoint"),
    }


def visibility_flags() -> dict[str, Column]:
    """Classes by which features are shown or hidden; they don't exclude each other.

    Of columns geom_type, name, description, stroke, layer_id.  Points of no other class are houses.
    """
    p = _parts()
    pop = p["point"] & ((F.col("layer_id") == "pop") | p["description"].contains("SERVER OLT") | p["upper"].contains("POP") | p["upper"].contains("OLT"))
    odc = p["point"] & (p["upper"].startswith("ODC") | p["description"].contains("Jumlah ODP:"))
    closure = p["point"] & p["upper"].contains("CLOSURE")
    odp = p["point"] & (p["name"].rlike(r"^\d{1,2}/\d{1,2}$") | p["description"].contains("Induk: ODC") | p["upper"].contains("ODP"))
    house = p["point"] & (p["name"].rlike(r"^\d{1,2}/\d{1,2}-\d{1,2}$") | p["description"].contains("Induk ODP:") | ~(pop | odc | closure | odp))
    feeder = p["line"] & (p["upper"].contains("FEEDER") | p["description"].contains("FEEDER") | F.coalesce(F.col("stroke") == "#ff0000", F.lit(False)))
    return {"is_pop": pop, "is_odc": odc, "is_closure": closure, "is_odp": odp, "is_house": house, "is_feeder": feeder, "is_distribution": p["line"] & ~feeder}


def colour_class() -> Column:
    """pop, odc, odp or house by the stricter rules that colours follow; null for other features."""
    p = _parts()
    pop = (F.col("layer_id") == "pop") | p["description"].contains("SERVER OLT") | p["upper"].contains("POP") | p["upper"].contains("OLT")
    odc = p["upper"].startswith("ODC") | p["description"].contains("Jumlah ODP:") | p["upper"].contains("JOIN CLOSURE")
    odp = p["name"].rlike(r"^\d{2}/\d{2}$") | p["description"].contains("Induk: ODC")
    house = p["name"].rlike(r"^\d{2}/\d{2}-\d{2}$") | p["description"].contains("Induk ODP:")
    return F.when(p["point"] & pop, "pop").when(p["point"] & odc, "odc").when(p["point"] & odp, "odp").when(p["point"] & house, "house")


#: What a colour's text may hold, and the colour meant.
COLOURS = [
    (("ef4444", "red"), "#ef4444", (239, 68, 68)),
    (("f97316", "orange"), "#f97316", (249, 115, 22)),
    (("22c55e", "10b981", "green"), "#10b981", (34, 197, 94)),
    (("3b82f6", "blue"), "#3b82f6", (59, 130, 246)),
    (("eab308", "yellow"), "#eab308", (234, 179, 8)),
    (("white", "#fff"), "#ffffff", (255, 255, 255)),
]
GREY, GREY_RGB = "#9ca3af", (156, 163, 175)


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def _rgba(rgb: tuple[int, int, int]) -> Column:
    return F.array(*(F.lit(x) for x in (*rgb, 255)))


def pin_colour(colour: Column | str) -> Column:
    """[red, green, blue, alpha] of a colour's name or hexadecimal text; grey if it has neither."""
    text = F.lower(F.col(colour) if isinstance(colour, str) else colour)
    found = F.when(text.isNull() | (text == ""), _rgba(GREY_RGB))
    for words, _, rgb in COLOURS:
        found = found.when(_holds(text, words), _rgba(rgb))
    digits = F.regexp_extract(text, "([0-9a-f]{6})", 1)
    value = F.conv(digits, 16, 10).cast("int")
    parsed = F.array(F.shiftright(value, 16), F.shiftright(value, 8).bitwiseAND(255), value.bitwiseAND(255), F.lit(255))
    return found.when(digits != "", parsed).otherwise(_rgba(GREY_RGB))


def hex_colour(colour: Column | str) -> Column:
    """The colour as #rrggbb; other texts keep their letters."""
    raw = F.col(colour) if isinstance(colour, str) else colour
    text = F.lower(raw)
    found = F.when(text.isNull() | (text == ""), GREY)
    for words, name, _ in COLOURS:
        found = found.when(_holds(text, words), name)
    return found.when(raw.startswith("#"), raw).otherwise(F.concat(F.lit("#"), raw))

"""Places, names and texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_longitude(lon: Column) -> Column:
    """Into -180..180."""
    return F.pmod(lon - 180, F.lit(360.0)) - 180


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326zz in the north, 327zz in the south."""
    zone = F.floor((lon + 180) / 6) % 60 + 1
    return F.concat(F.when(lat >= 0, "326").otherwise("327"), F.lpad(zone.cast("string"), 2, "0"))


def map_sheet(lat: Column, lon: Column) -> Column:
    """Name of a 1:50 000 sheet: degrees of both, then the half degree (A to D), then the quarter."""
    a, o = F.abs(lat), F.abs(lon)
    half = lambda x: F.floor(F.pmod(x, F.lit(1.0)) * 2)
    quarter = lambda x: F.floor(F.pmod(x * 2, F.lit(1.0)) * 2)
    letter = lambda r, c: F.element_at(F.array(*map(F.lit, "ABCD")), (2 * r + c + 1).cast("int"))
    return F.concat(F.lpad(F.floor(a).cast("string"), 2, "0"), F.lpad(F.floor(o).cast("string"), 2, "0"), letter(half(a), half(o)), letter(quarter(a), quarter(o)))


def number_or_null(text: Column) -> Column:
    """Text to a double; blanks and the catalogue's signs for nothing are null."""
    clean = F.trim(text)
    return F.when(~clean.isin("", "*", "N/A", "99.99", "999.9"), F.expr("1") * clean.try_cast("double"))


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which numbers inside a name count as numbers."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def seconds_of_day(clock: Column) -> Column:
    """hh:mm:ss to seconds."""
    p = F.split(clock, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def decimal_year(day: Column) -> Column:
    """Year and the share of it that is over before the day's end."""
    year = F.year(day)
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return year + F.dayofyear(day) / days


def hemisphere_number(text: Column) -> Column:
    """'25.6 S' or '31 W' to a negative number, N and E to a positive one."""
    value = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    return F.when(text.rlike("[SWsw]"), -value).otherwise(value)


def field_angles(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Declination, inclination (degrees), horizontal and total strength of a field vector."""
    h = F.sqrt(x * x + y * y)
    return {"d": F.degrees(F.atan2(y, x)), "i": F.degrees(F.atan2(z, h)), "h": h, "f": F.sqrt(x * x + y * y + z * z)}


def direction_cosines(inclination: Column, declination: Column, azimuth: float) -> list[Column]:
    """Along north, east and down, the azimuth of north given in degrees."""
    i, d = F.radians(inclination), F.radians(declination - azimuth)
    return [F.cos(i) * F.cos(d), F.cos(i) * F.sin(d), F.sin(i)]


def remanence(rmi: Column, susceptibility: Column, strength: float) -> dict[str, Column]:
    """Remanent magnetisation (A/m) of an intensity in nT, and its ratio to the induced one, 0 where there is none."""
    import math

    m = rmi / (400 * math.pi)
    induced = susceptibility * strength / (400 * math.pi)
    return {"magnetisation": m, "q": F.when(induced == 0, F.lit(0.0)).otherwise(F.try_divide(m, induced))}

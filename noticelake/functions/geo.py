"""Points on the national grid as longitude and latitude, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid GRS 80 and the parameters of the grid EPSG:5179.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101
ORIGIN_LAT, ORIGIN_LON, SCALE = 38.0, 127.5, 0.9996
FALSE_EAST, FALSE_NORTH = 1_000_000.0, 2_000_000.0

E2 = FLATTENING * (2 - FLATTENING)
SECOND_E2 = E2 / (1 - E2)
#: Length of a meridian arc per radian, and the terms of its series in the sines of even multiples.
ARC = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
ARC_TERMS = {2: -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024), 4: 15 * E2**2 / 256 + 45 * E2**3 / 1024, 6: -35 * E2**3 / 3072}


def meridian(lat: float) -> float:
    """Metres along the meridian from the equator to a latitude in radians."""
    return AXIS * (ARC * lat + sum(c * math.sin(k * lat) for k, c in ARC_TERMS.items()))


def to_degrees(x: Column, y: Column) -> Column:
    """struct<lon, lat> of easting and northing in metres, by the inverse transverse Mercator series; null for nulls."""
    n = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = (F.lit(meridian(math.radians(ORIGIN_LAT))) + (y - FALSE_NORTH) / SCALE) / (AXIS * ARC)
    foot_terms = {2: 3 * n / 2 - 27 * n**3 / 32, 4: 21 * n**2 / 16 - 55 * n**4 / 32, 6: 151 * n**3 / 96, 8: 1097 * n**4 / 512}
    foot = mu
    for k, c in foot_terms.items():
        foot = foot + c * F.sin(k * mu)
    sine, cosine, tangent = F.sin(foot), F.cos(foot), F.tan(foot)
    c, t = SECOND_E2 * cosine * cosine, tangent * tangent
    bent = 1 - E2 * sine * sine
    across = AXIS / F.sqrt(bent)
    along = AXIS * (1 - E2) / F.pow(bent, F.lit(1.5))
    d = (x - FALSE_EAST) / (across * SCALE)
    lat = foot - across * tangent / along * (
        d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * SECOND_E2) * d**4 / 24
        + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * SECOND_E2 - 3 * c**2) * d**6 / 720
    )
    lon = (
        d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * SECOND_E2 + 24 * t**2) * d**5 / 120
    ) / cosine
    return F.when(x.isNotNull() & y.isNotNull(), F.struct((F.lit(ORIGIN_LON) + F.degrees(lon)).alias("lon"), F.degrees(lat).alias("lat")))


# Points as well-known binary ------------------------------------------------------------------------------------------

#: Little-endian, a point without a reference system, and one with it: the fixed heads of the format.
POINT, POINT_WITH_SRID = "0101000000", "0101000020"


def double_bits(x: Column) -> Column:
    """The 64 bits of a normal double or zero as a long: sign, exponent and mantissa worked out by exact powers of two."""
    size = F.abs(x)
    # the logarithm may be off by one next to a power of two
    guess = F.floor(F.log2(size)).cast("int")
    over, under = F.pow(F.lit(2.0), guess) > size, F.pow(F.lit(2.0), guess + 1) <= size
    power = guess + F.when(over, -1).when(under, 1).otherwise(0)
    mantissa = ((size / F.pow(F.lit(2.0), power) - 1) * 2.0**52).cast("long")
    bits = F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(mantissa)
    # zero has a sign too, which only its text shows
    below = (x < 0) | ((size == 0) & x.cast("string").startswith("-"))
    sign = F.when(below, F.lit(-(2**63))).otherwise(F.lit(0).cast("long"))
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(bits).bitwiseOR(sign)


def bits_double(bits: Column) -> Column:
    """The normal double or zero of its 64 bits."""
    power = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047).cast("long"))
    mantissa = bits.bitwiseAND(F.lit(2**52 - 1))
    size = (1 + mantissa.cast("double") / 2.0**52) * F.pow(F.lit(2.0), power - 1023)
    size = F.when(bits.bitwiseAND(F.lit(2**63 - 1)) == 0, F.lit(0.0)).otherwise(size)
    return F.when(bits < 0, -size).otherwise(size)


def turned(digits: Column) -> Column:
    """Hexadecimal digits of some bytes in the opposite order of bytes."""
    pairs = F.regexp_extract_all(digits, F.lit("(?s).."), F.lit(0))
    return F.array_join(F.reverse(pairs), "")


def point(lon: Column, lat: Column, srid: int | None = None) -> Column:
    """A point as binary, with the number of its reference system if one is given; null if a coordinate is."""
    head = POINT if srid is None else POINT_WITH_SRID + srid.to_bytes(4, "little").hex()
    parts = [turned(F.lpad(F.hex(double_bits(c)), 16, "0")) for c in (lon, lat)]
    return F.when(lon.isNotNull() & lat.isNotNull(), F.unhex(F.concat(F.lit(head), *parts)))


def coordinate(place: Column, axis: int) -> Column:
    """Longitude (0) or latitude (1) of a binary point; null for what is no point."""
    digits = F.hex(place)
    start = F.when(digits.startswith(POINT), len(POINT)).when(digits.startswith(POINT_WITH_SRID), len(POINT_WITH_SRID) + 8)
    whole = F.when(F.length(digits) == start + 32, F.substring(digits, start + 1 + 16 * axis, F.lit(16)))
    # conv reads 64 bits as unsigned; a decimal brings the upper half back to where a long has it
    number = F.conv(turned(whole), 16, 10).cast("decimal(20,0)")
    half, full = (F.lit(str(2**k)).cast("decimal(20,0)") for k in (63, 64))
    return bits_double(F.when(number >= half, number - full).otherwise(number).cast("long"))


def srid(place: Column) -> Column:
    """The number of a binary point's reference system; 0 if it has none."""
    digits = F.hex(place)
    own = F.conv(turned(F.substring(digits, len(POINT_WITH_SRID) + 1, 8)), 16, 10).cast("int")
    return F.when(digits.startswith(POINT_WITH_SRID), own).when(digits.startswith(POINT), 0)

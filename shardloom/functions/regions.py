"""Regions, their distance, and the region nearest to a country."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region codes with latitude and longitude in degrees.
REGIONS = {
    "wnam": (37.7749, -122.4194),
    "enam": (40.7128, -74.006),
    "weur": (51.5074, -0.1278),
    "eeur": (52.52, 13.405),
    "apac": (35.6762, 139.6503),
    "oc": (-33.8688, 151.2093),
    "me": (25.2048, 55.2708),
    "af": (-26.2041, 28.0473),
}

# The rules in their order; a continent rule holds together with its countries.
COUNTRY_RULES: list[tuple[str, list[str], str | None]] = [
    ("enam", ["GL", "PM", "BM"], None),
    ("weur", ["GB", "IE", "FR", "ES", "PT", "NL", "BE", "LU", "CH", "AT", "IT"], None),
    ("eeur", ["DE", "PL", "CZ", "SK", "HU", "SI", "HR", "BA", "RS", "ME", "MK", "AL", "BG", "RO", "MD", "UA", "BY", "LT", "LV", "EE", "FI", "SE", "NO", "DK", "IS"], None),
    ("eeur", ["RU"], None),
    ("apac", ["JP", "KR", "CN", "HK", "TW", "MO", "MN", "KP"], None),
    ("apac", ["TH", "VN", "SG", "MY", "ID", "PH", "BN", "KH", "LA", "MM", "TL", "IN", "PK", "BD", "LK", "NP", "BT", "MV", "AF"], None),
    ("oc", ["AU", "NZ", "PG", "FJ", "NC", "VU", "SB", "WS", "TO", "KI", "NR", "PW", "FM", "MH", "TV"], None),
    ("me", ["AE", "SA", "QA", "KW", "BH", "OM", "YE", "IQ", "IR", "SY", "LB", "JO", "IL", "PS", "TR", "CY"], None),
    ("af", ["EG", "LY", "TN", "DZ", "MA", "SD", "SS", "ET", "ER", "DJ", "SO"], "AF"),
    ("eeur", ["KZ", "UZ", "TM", "TJ", "KG"], None),
    ("enam", ["BR", "AR", "CL", "PE", "CO", "VE", "EC", "BO", "PY", "UY", "GY", "SR", "GF"], "SA"),
    ("enam", ["GT", "BZ", "SV", "HN", "NI", "CR", "PA", "CU", "JM", "HT", "DO", "PR", "TT", "BB", "GD", "VC", "LC", "DM", "AG", "KN"], None),
]
SPLIT_COUNTRIES = ["US", "CA", "MX"]
WEST_STATES = ["CA", "WA", "OR", "NV", "AZ", "UT"]
WEST_ZONES = ["Pacific", "America/Los_Angeles"]


def distance(a: str, b: str) -> float:
    """Planar distance in degrees (no wrap at the date line)."""
    return math.dist(REGIONS[a], REGIONS[b])


def closest_region(country: Column, continent: Column, state: Column, zone: Column) -> Column:
    """Region code of each row, by the rules in order; without a country, or no rule: wnam."""
    has = lambda c, words: F.coalesce(F.greatest(*[F.contains(c, F.lit(w)) for w in words]), F.lit(False))
    west = has(state, WEST_STATES) | has(zone, WEST_ZONES)
    out = F.when(country.isNull() | (country == ""), "wnam").when(country.isin(SPLIT_COUNTRIES), F.when(west, "wnam").otherwise("enam"))
    for region, countries, by in COUNTRY_RULES:
        fits = country.isin(countries)
        if by:
            fits = fits | F.coalesce(continent == by, F.lit(False))
        out = out.when(fits, region)
    return out.otherwise("wnam")

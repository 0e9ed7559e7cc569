"""Column builders for single rows: flags, units, labels, calendar, keys and hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text of the provider's quality codes.
QC_STANDARD = {"1": "valid_background", "2": "valid", "3": "invalid"}
#: Factor from a reported unit to the gas's common unit.
UNIT_FACTOR = {
    ("mol/mol", "CO2"): 1e6, ("mol mol-1", "CO2"): 1e6, ("umol/mol", "CO2"): 1.0, ("ppm", "CO2"): 1.0, ("nmol/mol", "CO2"): 1e-3, ("ppb", "CO2"): 1e-3,
    ("mol/mol", "CH4"): 1e9, ("mol mol-1", "CH4"): 1e9, ("umol/mol", "CH4"): 1e3, ("ppm", "CH4"): 1e3, ("nmol/mol", "CH4"): 1.0, ("ppb", "CH4"): 1.0,
}
#: Sentinels that mean "no value".
SENTINELS = (-999.999, -999999.999, -999.999999999)
#: Continent of each reporting region.
CONTINENT = {"I": "Africa", "II": "Asia", "III": "South America", "IV": "North and Central America", "V": "South-West Pacific", "VI": "Europe"}


def qc_decision(flag: Column) -> Column:
    """Struct of original, standard, retain and needs_human for a provider's quality code."""
    text = F.trim(F.coalesce(flag.cast("string"), F.lit("")))
    standard = F.lit("unknown")
    for code, name in QC_STANDARD.items():
        standard = F.when(text == code, name).otherwise(standard)
    return F.struct(F.nullif(text, F.lit("")).alias("original"), standard.alias("standard"),
                    text.isin("1", "2").alias("retain"), (~text.isin(*QC_STANDARD)).alias("needs_human"))


def strict_factor(unit: Column, gas: Column, fail: bool = True) -> Column:
    """Factor to the gas's common unit; an unknown pair raises, or gives null with ``fail`` off."""
    key = F.concat_ws("|", F.translate(F.lower(F.trim(unit)), "µμ", "uu"), F.upper(F.trim(gas)))
    found = F.element_at(F.create_map(*[F.lit(x) for (u, g), f in UNIT_FACTOR.items() for x in (f"{u}|{g}", f)]), key)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no factor for "), key)).cast("double")) if fail else found


def lenient_factor(unit: Column, gas: Column) -> Column:
    """mol/mol by gas, ppm of methane by a thousand, everything else as it stands."""
    return (F.when(unit.contains("mol/mol") & ~unit.rlike("^[a-zµ]mol"), F.when(gas == "CO2", 1e6).otherwise(1e9))
            .when((unit == "ppm") & (gas == "CH4"), 1e3).otherwise(1.0))


def without_sentinel(value: Column) -> Column:
    """Null for a sentinel or anything at or below -999999; a bare -999 stays a number."""
    return F.when(value.isin(*SENTINELS) | (value <= -999999) | F.isnan(value), None).otherwise(value)


def lenient_number(text: Column) -> Column:
    """Null for blank, NA and None, and for what is no number."""
    t = F.trim(text)
    return F.when(~t.isin("", "NA", "None"), F.regexp_extract(t, r"^[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double"))


def region_name(region: Column) -> Column:
    """'REGION VI (Europe)' to 'Europe'."""
    return F.regexp_replace(F.regexp_replace(region, r"^REGION [IV]+ \(", ""), r"\)$", "")


def continent(region: Column) -> Column:
    numeral = F.regexp_extract(region, r"^REGION ([IV]+) ", 1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONTINENT.items() for x in kv]), numeral), F.lit("UNKNOWN"))


def unit_label(gas: Column, per_year: bool = False) -> Column:
    return F.concat(F.when(gas == "CO2", "ppm").otherwise("ppb"), F.lit("/yr" if per_year else ""))


def normal_key(text: Column) -> Column:
    """Header key: lower case, every run of other signs one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def physical_station(dataset_key: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_replace(dataset_key, "_[^_]*$", "")


def month_ordinal(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def decimal_year(ordinal: Column) -> Column:
    """Middle of the month as a year."""
    return F.floor(ordinal / 12).cast("double") + (ordinal % 12 + F.lit(0.5)) / F.lit(12.0)


def month_days(ordinal: Column) -> Column:
    first = F.make_date(F.floor(ordinal / 12).cast("int"), (ordinal % 12 + 1).cast("int"), F.lit(1))
    return F.dayofmonth(F.last_day(first))


def month_hours(ordinal: Column) -> Column:
    return month_days(ordinal) * 24


def hash_draw(n: Column | int, *parts: Column | str | int) -> Column:
    """A repeatable draw from 0..n-1 by SHA-256 of the parts; the same in any engine."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % n


def manifest_role(path: Column) -> Column:
    """What a file of a release is for, by its place."""
    role = F.lit("other")
    for prefix, name in (("tests/", "test"), ("scripts/", "script"), ("src/", "source"), ("results/", "result"), ("provenance/", "provenance"), ("configs/", "configuration"), ("data/", "data"), ("docs/", "documentation")):
        role = F.when(path.startswith(prefix), name).otherwise(role)
    return role

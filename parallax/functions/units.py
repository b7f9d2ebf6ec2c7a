"""Physical quantities in free text: number and unit notations to one common unit per dimension.

The unit table is built from a rule: base spellings, a factor to the common unit and, where the
base takes them, metric prefixes. A spelling is looked up as written first (mW and MW differ),
then in lower case. Everything is a column expression.

Numbers: blanks, apostrophes or commas between groups of three digits are group marks unless the
number starts with a zero; any other single comma is a decimal mark.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions.text import clean, col, settle, strip


@dataclass(frozen=True)
class Unit:
    common: str
    factor: float
    offset: float = 0.0


# Fixed values: (common unit, factor, offset, prefixed symbols, prefixed words, plain spellings)
_BASES = [
    ("volt", 1.0, 0.0, ["V", "Volt", "Volts", "VAC", "VDC"], ["volt", "volts"], ["v"]),
    ("ampere", 1.0, 0.0, ["A", "Amp", "Amps", "AAC"], ["amp", "amps", "ampere", "amperes"], ["Ampere", "Amperes"]),
    ("volt_ampere", 1.0, 0.0, ["VA"], ["volt-ampere", "volt-amperes", "volt ampere", "volt amperes", "voltampere", "voltamperes"], ["volt_ampere"]),
    ("watt", 1.0, 0.0, ["W", "Watt", "Watts"], ["watt", "watts"], ["w"]),
    ("watt", 745.6998715822702, 0.0, [], [], ["hp", "HP", "horsepower", "bhp"]),
    ("hertz", 1.0, 0.0, ["Hz", "HZ"], ["hertz"], ["cps", "c/s"]),
    ("kelvin", 1.0, 0.0, [], [], ["K", "kelvin", "kelvins", "degK"]),
    ("kelvin", 1.0, 273.15, [], [], ["°C", "℃", "degC", "deg C", "deg. C", "degree Celsius", "degrees Celsius", "degrees C", "celsius"]),
    ("kelvin", 5.0 / 9.0, 459.67 * 5.0 / 9.0, [], [], ["°F", "℉", "degF", "deg F", "deg. F", "degree Fahrenheit", "degrees Fahrenheit", "degrees F", "fahrenheit"]),
    ("dimensionless", 1.0, 0.0, [], [], ["pu", "p.u.", "p.u", "per unit", "per-unit", "dimensionless"]),
    ("dimensionless", 0.01, 0.0, [], [], ["%", "percent", "per cent", "pct", "pct."]),
    ("dimensionless", 0.001, 0.0, [], [], ["‰", "per mille", "permille", "per mil"]),
    ("second", 1.0, 0.0, ["s", "sec", "second", "seconds"], ["second", "seconds", "sec"], ["secs"]),
    ("second", 60.0, 0.0, [], [], ["min", "mins", "minute", "minutes"]),
    ("second", 3600.0, 0.0, [], [], ["h", "hr", "hrs", "hour", "hours"]),
    ("meter", 1.0, 0.0, ["m"], ["meter", "meters", "metre", "metres"], []),
    ("meter", 0.0254, 0.0, [], [], ["in", "in.", "inch", "inches", '"']),
    ("meter", 0.3048, 0.0, [], [], ["ft", "ft.", "foot", "feet"]),
    ("meter ** 2", 1.0, 0.0, [], [], ["m2", "m²", "sq m", "meter ** 2", "square meters", "square metres"]),
    ("meter ** 2", 1e-4, 0.0, [], [], ["cm2", "cm²", "sq cm", "square centimeters", "square centimetres"]),
    ("meter ** 2", 1e-6, 0.0, [], [], ["mm2", "mm²", "sq mm", "sq. mm", "square millimeters", "square millimetres"]),
    ("meter ** 2", math.pi / 4 * 0.0254**2 * 1e-3, 0.0, [], [], ["kcmil", "MCM"]),
    ("ohm", 1.0, 0.0, ["Ω", "Ω", "ohm", "ohms", "Ohm", "Ohms"], ["ohm", "ohms"], []),
    ("farad", 1.0, 0.0, ["F", "farad", "farads"], ["farad", "farads"], []),
]
# Prefixes of symbols and of words
_SYMBOL = {"T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "K": 1e3, "": 1.0, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "n": 1e-9, "p": 1e-12}
_WORD = {"tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "": 1.0, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12}


@cache
def unit_table() -> dict[str, Unit]:
    """Every known spelling, as written."""
    table: dict[str, Unit] = {}
    for common, factor, offset, symbols, words, plain in _BASES:
        for s in plain:
            table.setdefault(s, Unit(common, factor, offset))
        for names, prefixes in ((symbols, _SYMBOL), (words, _WORD)):
            for s in names:
                for p, x in prefixes.items():
                    if not (p == "c" and common != "meter"):
                        table.setdefault(p + s, Unit(common, factor * x, offset))
    return table


@cache
def folded_table() -> dict[str, Unit]:
    """Spellings in lower case; of two that clash the larger unit stands, as capitals are what gets lost (mva)."""
    table: dict[str, Unit] = {}
    for s, u in unit_table().items():
        kept = table.get(s.lower())
        if s.lower() not in unit_table() and (kept is None or u.factor > kept.factor):
            table[s.lower()] = u
    return {"mva": Unit("volt_ampere", 1e6), "mw": Unit("watt", 1e6), "mvar": Unit("volt_ampere", 1e6)} | table


_SPACES = r"[ \t\xa0  ]"
_GROUPED = rf"[1-9]\d{{0,2}}(?:[ \xa0  '’,]\d{{3}})+(?!\d)(?:\.\d+)?"
NUMBER = rf"[+\-−]?(?:{_GROUPED}|\d+(?:[.,]\d+)?|[.,]\d+)(?:[eE][+\-]?\d+)?"
_LEAD = rf"^(?:approx\.?|approximately|about|circa|ca\.?|nominal|max\.?|min\.?|typ\.?|≈|~|±|=|<=?|>=?|≤|≥|{_SPACES})*"
_END = r"(?=$|[\s\xa0 (),;:/\]|]|\.(?:\s|$))"


@cache
def unit_pattern() -> str:
    """All spellings as one alternation without regard to case, longest first."""
    names = sorted({s.lower() for s in unit_table()} | set(folded_table()), key=lambda s: (-len(s), s))
    return "(?iu:" + "|".join(re.sub(r"([.*+?()\[\]{}|^$\\/-])", r"\\\1", s) for s in names) + ")"


def number_value(text: Column) -> Column:
    """The value of a number that NUMBER matched; null otherwise."""
    plain = F.regexp_replace(F.regexp_replace(text, "−", "-"), r"[\s\xa0  '’]", "")
    grouped = text.rlike(rf"^[+\-−]?{_GROUPED}(?:[eE]|$)")
    return F.when(grouped, F.regexp_replace(plain, ",", "")).otherwise(F.regexp_replace(plain, ",", ".")).try_cast("double")


def _unit_frame(spark: SparkSession, table: dict[str, Unit], key: str, value: str) -> DataFrame:
    entries = json.dumps([{"s": s, "common": u.common, "factor": u.factor, "offset": u.offset} for s, u in table.items()])
    rows = F.explode(F.from_json(F.lit(entries), "array<struct<s string, common string, factor double, offset double>>")).alias("e")
    return spark.range(1).select(rows).select(F.col("e.s").alias(key), F.struct("e.common", "e.factor", "e.offset").alias(value))


def with_unit(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with ``out``: struct<common, factor, offset> of a unit written as a symbol or a word; null if unknown.

    The unit table has a fixed number of rows, so it is broadcast.
    """
    spark, s = df.sparkSession, F.regexp_replace(strip(text), r"\s+", " ")
    df = df.withColumn("__exact", s).withColumn("__folded", F.lower("__exact"))
    exact = _unit_frame(spark, unit_table(), "__exact", "__u1")
    folded = _unit_frame(spark, unit_table() | folded_table(), "__folded", "__u2")
    df = df.join(F.broadcast(exact), "__exact", "left").join(F.broadcast(folded), "__folded", "left")
    return df.withColumn(out, F.coalesce("__u1", "__u2")).drop("__exact", "__folded", "__u1", "__u2")


def to_common(value: Column, unit: Column) -> Column:
    return value * unit["factor"] + unit["offset"]


def quantity_text(raw: Column | str) -> tuple[Column, Column]:
    """The number and the unit text of a value such as ``approx. 1 160 000 mA (nameplate)``; '' where absent."""
    raw = col(raw)
    number = F.regexp_extract(raw, rf"{_LEAD}({NUMBER}){_SPACES}*(?:{unit_pattern()}{_END}|$|\(|max|min|nominal)", 1)
    return number, F.regexp_extract(raw, rf"{_LEAD}{NUMBER}{_SPACES}*({unit_pattern()}){_END}", 1)


def unit_in_span(span: Column | str, raw: Column | str) -> Column:
    """The unit that follows the last place of ``raw`` in ``span``; '' where there is none."""
    tail = F.call_function("substring_index", col(span), strip(raw), F.lit(-1))
    return F.when(F.contains(col(span), strip(raw)), F.regexp_extract(tail, rf"^{_SPACES}*({unit_pattern()}){_END}", 1)).otherwise("")


def unit_in_name(name: Column | str) -> Column:
    """The unit in brackets at the end of an attribute name; '' where there is none."""
    return F.regexp_extract(col(name), rf"[(\[]\s*({unit_pattern()})\s*[)\]]\s*$", 1)


def with_quantity(df: DataFrame, out: str, raw: str, span: str | None = None, name: str | None = None) -> DataFrame:
    """``df`` with ``out``: struct<magnitude double, common string> in the common unit of its dimension; null if no quantity with a unit.

    The unit is taken from ``raw``, else from ``span`` after the number, else from the end of ``name``.
    """
    number, unit = quantity_text(raw)
    df = settle(df, __number=number, __found=F.nullif(unit, F.lit("")))
    bare = F.col("__found").isNull() & (F.col("__number") != "")
    if span is not None:
        df = df.withColumn("__found", F.when(bare, F.nullif(unit_in_span(span, raw), F.lit(""))).otherwise(F.col("__found")))
    if name is not None:
        df = df.withColumn("__found", F.when(bare, F.nullif(unit_in_name(name), F.lit(""))).otherwise(F.col("__found")))
    df = with_unit(df, F.col("__found"), "__unit")
    value = to_common(number_value(F.col("__number")), F.col("__unit"))
    read = F.when((F.col("__number") != "") & F.col("__unit").isNotNull() & value.isNotNull(), F.struct(value.alias("magnitude"), F.col("__unit.common").alias("common")))
    return df.withColumn(out, read).drop("__number", "__found", "__unit")


def with_stored_unit(df: DataFrame, out: str, name: Column | str) -> DataFrame:
    """``df`` with ``out``: the unit of a stored unit column; blank counts as absent."""
    return with_unit(df, F.when(clean(name) != "", col(name)), out)

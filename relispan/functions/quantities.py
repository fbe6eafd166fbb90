"""Quantities in texts: numbers with units that are products, quotients and powers of prefixed units, and their dimensions.

A dimension is the exponents of length, mass, time, current, temperature and amount. Values are given in the basic units
of these (m, kg, s, A, K, mol).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("length", "mass", "time", "current", "temperature", "amount")
#: Prefixes and their factors.
PREFIXES = {"G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12}
#: Units that take prefixes: symbol, factor, exponents of the bases.
PREFIXED = {
    "m": (1.0, (1, 0, 0, 0, 0, 0)), "g": (1e-3, (0, 1, 0, 0, 0, 0)), "s": (1.0, (0, 0, 1, 0, 0, 0)), "A": (1.0, (0, 0, 0, 1, 0, 0)),
    "K": (1.0, (0, 0, 0, 0, 1, 0)), "mol": (1.0, (0, 0, 0, 0, 0, 1)), "N": (1.0, (1, 1, -2, 0, 0, 0)), "Pa": (1.0, (-1, 1, -2, 0, 0, 0)),
    "bar": (1e5, (-1, 1, -2, 0, 0, 0)), "J": (1.0, (2, 1, -2, 0, 0, 0)), "W": (1.0, (2, 1, -3, 0, 0, 0)), "V": (1.0, (2, 1, -3, -1, 0, 0)),
    "Hz": (1.0, (0, 0, -1, 0, 0, 0)), "Ohm": (1.0, (2, 1, -3, -2, 0, 0)), "C": (1.0, (0, 0, 1, 1, 0, 0)), "F": (1.0, (-2, -1, 4, 2, 0, 0)),
    "l": (1e-3, (3, 0, 0, 0, 0, 0)), "L": (1e-3, (3, 0, 0, 0, 0, 0)), "eV": (1.602176634e-19, (2, 1, -2, 0, 0, 0)),
}
#: Units without prefixes.
PLAIN = {
    "in": (0.0254, (1, 0, 0, 0, 0, 0)), "ft": (0.3048, (1, 0, 0, 0, 0, 0)), "mi": (1609.344, (1, 0, 0, 0, 0, 0)), "lb": (0.45359237, (0, 1, 0, 0, 0, 0)),
    "lbs": (0.45359237, (0, 1, 0, 0, 0, 0)), "t": (1e3, (0, 1, 0, 0, 0, 0)), "min": (60.0, (0, 0, 1, 0, 0, 0)), "h": (3600.0, (0, 0, 1, 0, 0, 0)),
    "hr": (3600.0, (0, 0, 1, 0, 0, 0)), "day": (86400.0, (0, 0, 1, 0, 0, 0)), "psi": (6894.757293168, (-1, 1, -2, 0, 0, 0)), "hp": (745.6998715823, (2, 1, -3, 0, 0, 0)),
    "gal": (3.785411784e-3, (3, 0, 0, 0, 0, 0)), "gpm": (6.30901964e-5, (3, 0, -1, 0, 0, 0)), "cfm": (4.71947443e-4, (3, 0, -1, 0, 0, 0)), "rpm": (1 / 60, (0, 0, -1, 0, 0, 0)),
    "degC": (1.0, (0, 0, 0, 0, 1, 0)), "degF": (5 / 9, (0, 0, 0, 0, 1, 0)), "rad": (1.0, (0, 0, 0, 0, 0, 0)), "%": (0.01, (0, 0, 0, 0, 0, 0)),
}
#: Names of derived dimensions.
NAMES = {
    (1, 0, 0, 0, 0, 0): "length", (0, 1, 0, 0, 0, 0): "mass", (0, 0, 1, 0, 0, 0): "time", (0, 0, 0, 1, 0, 0): "current", (0, 0, 0, 0, 1, 0): "temperature",
    (0, 0, 0, 0, 0, 1): "amount", (2, 0, 0, 0, 0, 0): "area", (3, 0, 0, 0, 0, 0): "volume", (1, 0, -1, 0, 0, 0): "speed", (1, 0, -2, 0, 0, 0): "acceleration",
    (1, 1, -2, 0, 0, 0): "force", (-1, 1, -2, 0, 0, 0): "pressure", (2, 1, -2, 0, 0, 0): "energy", (2, 1, -3, 0, 0, 0): "power", (2, 1, -3, -1, 0, 0): "voltage",
    (0, 0, -1, 0, 0, 0): "frequency", (3, 0, -1, 0, 0, 0): "flow", (0, 1, -1, 0, 0, 0): "mass flow", (-3, 1, 0, 0, 0, 0): "density", (0, 0, 0, 0, 0, 0): "ratio",
}


def units() -> dict[str, tuple[float, tuple[int, ...]]]:
    """Every symbol with its factor and exponents: each prefix with each unit that takes one; plain units come before."""
    made = {p + u: (f * x, e) for u, (x, e) in PREFIXED.items() for p, f in PREFIXES.items()}
    return made | PREFIXED | PLAIN


def _alternatives() -> str:
    return "|".join(sorted(units(), key=lambda u: (-len(u), u)))


FACTOR = rf"(?:{_alternatives()})(?:\^?-?[1-9]|[²³])?"
NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: A number and its unit: factors joined by / * or a middle dot, then no letter or digit.
QUANTITY = rf"(?:^|[^A-Za-z0-9_.,])([+-]?{NUMBER} ?{FACTOR}(?: ?[/*·] ?{FACTOR})*)(?:[^A-Za-z0-9_]|$)"
PART = rf"([/*·]?) ?({_alternatives()})(?:\^?(-?[1-9])|([²³]))?"


def mentions(text: Column) -> Column:
    """Quantities in a text, as they stand; a character between two belongs to one of them alone."""
    return F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(1))


def quantity(mention: Column) -> Column:
    """struct(value, unit, exponents, dimension, si) of a mention: its number, its unit, the exponents of the bases, the name
    of the dimension (null if it has none here), and the value in basic units.

    Temperatures are differences: no zero is moved. A divisor is what stands behind one stroke alone: in "a/b*c" c is above.
    """
    number = F.regexp_extract(mention, f"^[+-]?{NUMBER}", 0)
    unit = F.trim(F.substring(mention, F.length(number) + 1, F.length(mention)))
    table = F.create_map(*[x for u, (f, e) in units().items() for x in (F.lit(u), F.struct(F.lit(f).alias("f"), F.array(*map(F.lit, e)).alias("e")))])
    places = [F.regexp_extract_all(unit, F.lit(PART), F.lit(k)) for k in (1, 2, 3, 4)]
    parts = F.arrays_zip(*[p.alias(n) for p, n in zip(places, "oupq", strict=True)])

    def one(x: Column) -> Column:
        power = F.when(x["p"] != "", x["p"].cast("int")).when(x["q"] == "²", 2).when(x["q"] == "³", 3).otherwise(1)
        signed = F.when(x["o"] == "/", -power).otherwise(power)
        known = F.element_at(table, x["u"])
        return F.struct(F.pow(known["f"], signed).alias("f"), F.transform(known["e"], lambda e: e * signed).alias("e"))

    each = F.transform(parts, one)
    start = F.struct(F.lit(1.0).alias("f"), F.array(*[F.lit(0)] * len(BASES)).alias("e"))
    total = F.aggregate(each, start, lambda acc, x: F.struct((acc["f"] * x["f"]).alias("f"), F.zip_with(acc["e"], x["e"], lambda a, b: a + b).alias("e")))
    value = F.replace(number, F.lit(","), F.lit("")).cast("double")
    return F.struct(value.alias("value"), unit.alias("unit"), total["e"].alias("exponents"), dimension(total["e"]).alias("dimension"), (value * total["f"]).alias("si"))


def dimension(exponents: Column) -> Column:
    """The name of a dimension."""
    names = F.create_map(*[F.lit(x) for e, n in NAMES.items() for x in (",".join(map(str, e)), n)])
    return F.try_element_at(names, F.array_join(exponents.cast("array<string>"), ","))

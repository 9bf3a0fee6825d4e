"""Canonical JSON as column expressions: keys sorted, no white space, one text for equal values, so that its hash is a name.

Numbers are the shortest digits that give the same double, in the notation of ECMAScript ("ecma": 100, 1e+21, 1e-7) or of
Python ("repr": 100.0, 1e+16, 1e-05). Texts escape quotes, back slashes and control characters only. Digits come from Java:
all numbers that have 15 digits or fewer agree with those languages, and whatever is shown gives the same double again; of
those with 17 digits about one in a thousand ends in another digit than the nearest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_CONTROL = {**_SHORT, **{chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _SHORT}}


def quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    every = escaped
    for character, shown in _CONTROL.items():
        every = F.replace(every, F.lit(character), F.lit(shown))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1F]"), every).otherwise(escaped), F.lit('"'))


def _zeros(n: Column) -> Column:
    return F.repeat(F.lit("0"), n.cast("int"))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _digits(text: Column) -> Column:
    """Of a positive double as Java shows it: its significant digits, and the place of its point: 0.digits * 10^place."""
    mantissa, exponent = F.split_part(text, F.lit("E"), F.lit(1)), F.coalesce(F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    whole, fraction = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    parts = F.struct(F.concat(whole, fraction).alias("every"), (F.length(whole) + exponent).alias("place"))
    lead = lambda p: F.length(p["every"]) - F.length(F.regexp_replace(p["every"], "^0+", ""))
    return _let(parts, lambda p: F.struct(F.regexp_replace(p["every"], "^0+|0+$", "").alias("digits"), (p["place"] - lead(p)).alias("place")))


def _shorter(x: Column, found: Column) -> Column:
    """The nearest number with one digit less, or the other one with as many digits next to it, if the same double comes of
    it: Java shows one digit too many, or not the nearest last digit, for a few doubles."""

    def candidate(d: Column, value: Column, moved: Column) -> Column:
        text = value.cast("string")
        return F.struct(F.regexp_replace(text, "0+$", "").alias("digits"), (d["place"] + F.length(text) - moved).alias("place"))

    def chosen(d: Column) -> Column:
        n, all_digits = F.length(d["digits"]), d["digits"].cast("decimal(20,0)")
        tens = F.floor(all_digits / 10)
        up = F.when(all_digits % 10 >= 5, 1).otherwise(0)
        less = [candidate(d, (tens + k).cast("decimal(20,0)"), n - 1) for k in (up, 1 - up)]
        same = lambda c: F.concat(F.lit("0."), c["digits"], F.lit("E"), c["place"].cast("string")).cast("double") == x
        return F.when(n >= 16, F.coalesce(*[F.when(same(c), c) for c in less], d)).otherwise(d)

    return _let(found, chosen)


def _hundredths(size: Column, ecma: bool) -> tuple[Column, Column]:
    """If a double from 0.01 to 1e12 is the nearest one to a whole number of hundredths; and that number as text.

    Numbers of fifteen digits or fewer are different doubles, so that its digits without the last zeros are the shortest.
    """
    cents = F.rint(F.when(size < 1e12, size * 100)).cast("long")
    whole, part = F.call_function("div", cents, F.lit(100).cast("long")).cast("string"), (cents % 100).cast("int")
    more = F.when(part == 0, "" if ecma else ".0").when(part % 10 == 0, F.concat(F.lit("."), F.call_function("div", part, F.lit(10)).cast("string")))
    more = more.when(part < 10, F.concat(F.lit(".0"), part.cast("string"))).otherwise(F.concat(F.lit("."), part.cast("string")))
    return (size >= 0.01) & (size < 1e12) & (cents.cast("double") / 100 == size), F.concat(whole, more)


def number(x: Column, style: str = "ecma") -> Column:
    """A finite double as text; others fail, as JSON has no word for them."""
    if style not in ("ecma", "repr"):
        raise ValueError("style: ecma or repr")
    ecma = style == "ecma"
    fixed_low, fixed_high = (-6, 21) if ecma else (-4, 16)

    def shown(d: Column) -> Column:
        digits, place = d["digits"], d["place"]
        k, power = F.length(digits), place - 1
        tail = F.abs(power).cast("string") if ecma else F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string"))
        scientific = F.concat(F.substring(digits, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), tail)
        return (
            F.when((place > fixed_low) & (place <= 0), F.concat(F.lit("0."), _zeros(-place), digits))
            .when((place > 0) & (place <= fixed_high) & (k <= place), F.concat(digits, _zeros(place - k), F.lit("" if ecma else ".0")))
            .when((place > 0) & (place <= fixed_high), F.concat(F.substring(digits, F.lit(1), place), F.lit("."), F.substring(digits, place + 1, k)))
            .otherwise(scientific)
        )

    size = F.abs(x)
    zero = F.lit("0") if ecma else F.when(x.cast("string") == "-0.0", "-0.0").otherwise("0.0")
    short, shortly = _hundredths(size, ecma)
    sign = F.when(x < 0, "-").otherwise("")
    text = F.when(size == 0, zero).when(short, F.concat(sign, shortly)).otherwise(F.concat(sign, _let(_shorter(size, _shorter(size, _digits(size.cast("string")))), shown)))
    finite = ~F.isnan(x) & (size < float("inf"))
    return F.when(finite, text).when(~finite, F.raise_error(F.lit("JSON has no such number")))


def canonical(value: Column, kind: T.DataType, style: str = "ecma") -> Column:
    """The canonical JSON of a value of any nested type; null is the word null. Map keys must be texts; bytes fail."""
    if isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.FloatType | T.DoubleType):
        text = number(value.cast("double"), style)
    elif isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.DecimalType):
        text = value.cast("string")
    elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        text = quoted(value.cast("string"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}:"), canonical(value[f.name], f.dataType, style)) for f in sorted(kind, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, style)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType, style))), ","), F.lit("}"))
    else:
        raise ValueError(f"no canonical form of {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def row_json(frame, columns: list[str] | None = None, style: str = "ecma") -> Column:
    """The canonical JSON of the rows of a frame."""
    names = columns or frame.columns
    kind = T.StructType([frame.schema[n] for n in names])
    return canonical(F.struct(*[F.col(f"`{n}`") for n in names]), kind, style)

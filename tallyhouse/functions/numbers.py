"""Numbers as JSON writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_real(value: Column) -> Column:
    """A double by the fewest digits that read back as the same number, as JSON texts commonly have it.

    Plain with a point from 1e-4 to below 1e16, else with an exponent of two digits or more. Numbers that
    aren't finite are texts. The JVM's own form has a digit too many at times, so 15 and 16 digits are
    tried first; of whole numbers beyond 2^53 its last digit may not be the nearest, so theirs are
    counted in whole numbers. Only below 2.3e-308, where numbers have fewer digits, may one be left over.
    """

    def first_of(x: Column, forms: list[Column]) -> Column:
        if len(forms) == 1:
            return forms[0]
        rest = first_of(x, forms[1:])
        return _let(forms[0], lambda s: F.when(s.cast("double") == x, s).otherwise(rest))

    def large(x: Column) -> Column:
        """A whole number rounded to 15, 16 or 17 digits, with its power of ten."""

        def to(whole: Column, digits: int) -> Column:
            size = F.length(whole.cast("string"))
            unit = F.greatest(F.pow(F.lit(10.0), size - digits), F.lit(1.0)).cast("long")
            return _let(F.struct(unit.alias("u"), size.alias("n")), lambda y: F.concat(F.call_function("div", whole.cast("decimal(20,0)") + F.call_function("div", y["u"], F.lit(2)), y["u"]).cast("string"), F.lit("e"), F.greatest(y["n"] - digits, F.lit(0)).cast("string")))

        def scaled(told: Column) -> Column:
            """From digits and power to one digit before the point."""
            return _let(F.split(told, "e"), lambda p: F.concat(F.left(F.get(p, 0), F.lit(1)), F.lit("."), F.substring(F.get(p, 0), F.lit(2), F.length(F.get(p, 0))), F.lit("e"), (F.get(p, 1).cast("int") + F.length(F.get(p, 0)) - 1).cast("string")))

        return scaled(_let(x.cast("long"), lambda whole: first_of(x, [to(whole, digits) for digits in (15, 16, 17)])))

    def shortest(x: Column) -> Column:
        usual = first_of(x, [F.format_string(f"%.{digits - 1}e", x) for digits in (15, 16, 17)])
        return F.when((x >= 2.0**53) & (x < 2.0**63), large(x)).otherwise(usual)

    def plain(parts: Column) -> Column:
        return _let(F.struct(F.regexp_replace(F.replace(F.get(parts, 0), F.lit("."), F.lit("")), "0+$", "").alias("digits"), F.get(parts, 1).cast("int").alias("power")), lambda y: told(y["digits"], y["power"]))

    def told(digits: Column, power: Column) -> Column:
        n = F.length(digits)
        whole = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"), F.lit("."), F.when(n > power + 1, F.substring(digits, power + 2, n)).otherwise("0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        size = F.abs(power).cast("string")
        grown = F.concat(F.left(digits, F.lit(1)), tail, F.when(power < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), "0"))
        return F.when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(grown)

    x = F.abs(value)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")  # of a zero too
    finite = F.when(x == 0, "0.0").otherwise(plain(F.split(shortest(x), "e")))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(F.isnan(value), '"nan"').when(x == float("inf"), F.when(value > 0, '"inf"').otherwise('"-inf"')).otherwise(F.concat(sign, finite))


def json_text(value: Column) -> Column:
    """A text in quotes; letters beyond ASCII stay, and control characters have their short or long escapes."""
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign, name in (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t")):
        quoted = F.replace(quoted, F.lit(sign), F.lit("\\" + name))
    rest = [chr(k) for k in range(32) if chr(k) not in "\b\f\n\r\t"]
    # Few texts have any of the others.
    long = quoted
    for sign in rest:
        long = F.replace(long, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp(quoted, F.lit("[\\x00-\\x1f]")), long).otherwise(quoted), F.lit('"'))


def json_scalar(value: Column, kind: T.DataType) -> Column:
    """A scalar of a known type: integers, decimals and booleans plain, reals by json_real, times in ISO form, nulls as null."""
    if isinstance(kind, T.DoubleType):
        told = json_real(value)
    elif isinstance(kind, T.FloatType):
        told = json_real(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        told = value.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        told = F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit(" "), F.lit("T")), F.lit('"'))
    else:
        told = json_text(value.cast("string"))
    return F.coalesce(told, F.lit("null"))

"""Numbers as text with correct rounding: of the exact binary value, exact halves to even, as a C library prints them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into halves whose products are exact.
_SPLIT = 134217729.0


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """What rounding took from a * b: the exact product less ``product``."""
    high = lambda v: v * _SPLIT - (v * _SPLIT - v)
    halves = F.struct(high(a).alias("ah"), high(b).alias("bh"))
    rest = lambda h: F.struct(h["ah"].alias("ah"), h["bh"].alias("bh"), (a - h["ah"]).alias("al"), (b - h["bh"]).alias("bl"))
    error = lambda p: ((p["ah"] * p["bh"] - product) + p["ah"] * p["bl"] + p["al"] * p["bh"]) + p["al"] * p["bl"]
    return _let(halves, lambda h: _let(rest(h), error))


def _nearest(near: Column, error: Column) -> Column:
    """The whole number nearest to near + error, for a ``near`` that was rounded: only exact halves need the error."""
    low = F.floor(near)
    half = near - low == 0.5
    return F.when(half & (error > 0), low + 1).when(half & (error < 0), low).otherwise(F.rint(near)).cast("long")


def _times(a: Column, b: Column) -> Column:
    """The whole number nearest to a * b."""
    return _let(a * b, lambda p: _nearest(p, _product_error(a, b, p)))


def _over(a: Column, b: Column) -> Column:
    """The whole number nearest to a / b."""
    return _let(a / b, lambda q: _nearest(q, -_product_error(q, b, a)))


def scaled(value: Column, digits: int) -> Column:
    """|value| in units of the last of ``digits`` decimals, as a whole number."""
    return _let(F.abs(value), lambda size: _times(size, F.lit(float(10**digits))))


def _decimals(k: Column, digits: Column | int) -> Column:
    """k units of the last of ``digits`` decimals, written out; without decimals no point."""
    digits = F.lit(digits) if isinstance(digits, int) else digits

    def write(text: Column) -> Column:
        return F.when(digits == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), F.char_length(text) - digits), F.lit("."), F.right(text, digits)))

    return _let(k.cast("string"), lambda t: _let(F.lpad(t, F.greatest(F.char_length(t), digits + 1), F.lit("0")), write))


#: From here on neighbouring doubles lie more than a sixth decimal apart, and from here on no whole number of 64 bits.
NO_SIXTH, NO_LONG = float(1 << 33), 9.2e18


def _odd(value: Column) -> Column:
    """Text of what is no number: nan, or inf without its sign."""
    return F.when(F.isnan(value), "nan").otherwise("inf")


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def _split(size: Column, digits: int) -> Column:
    """A size under 64 bits with a fixed number of decimals.  The part behind the point is exact by itself; rounding may carry into the
    whole part."""

    def write(whole: Column) -> Column:
        part = lambda k: F.concat((whole.cast("long") + (k == 10**digits).cast("long")).cast("string"), F.lit("."), F.lpad(F.when(k == 10**digits, F.lit(0).cast("long")).otherwise(k).cast("string"), F.lit(digits), F.lit("0")))
        return _let(scaled(size - whole, digits), part)

    return _let(F.floor(size), write)


def fixed(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals; beyond 64 bits its shortest digits and zeros; nan, inf and -inf as such."""

    def write(size: Column) -> Column:
        plain = _decimals(scaled(size, digits), digits)
        middle = plain if digits == 0 else F.when(size < 1e9, plain).otherwise(_split(size, digits))
        return F.when(size < NO_LONG, middle).otherwise(F.format_string(f"%.{digits}f", size))

    text = F.when(_finite(value), _let(F.abs(value), write)).otherwise(_odd(value))
    return F.when(value.isNotNull(), F.concat(F.when((value < 0) & ~F.isnan(value), "-").otherwise(""), text))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")


def signed(value: Column) -> Column:
    """``value`` with its sign and six significant digits, without trailing zeros; with an exponent below -4 or from 6 on; nan and inf as
    such."""
    ten = lambda n: F.power(F.lit(10.0), n)

    def exponent(size: Column) -> Column:
        guess = F.floor(F.log10(size)).cast("int")
        return _let(guess, lambda g: F.when(ten(g) > size, g - 1).when(ten(g + 1) <= size, g + 1).otherwise(g))

    def digits(size: Column, e: Column) -> Column:
        k = F.when(e <= 5, _let(ten(F.lit(5) - e), lambda up: _times(size, up))).otherwise(_let(ten(e - 5), lambda down: _over(size, down)))
        # Rounding may reach the next power of ten.
        return _let(k, lambda n: F.when(n >= 1_000_000, F.struct(F.lit(100_000).cast("long").alias("k"), (e + 1).alias("e"))).otherwise(F.struct(n.alias("k"), e.alias("e"))))

    def write(d: Column) -> Column:
        plain = _decimals(d["k"], F.least(F.greatest(F.lit(5) - d["e"], F.lit(0)), F.lit(9)))
        power = F.concat(F.when(d["e"] < 0, "-").otherwise("+"), F.when(F.abs(d["e"]) < 10, "0").otherwise(""), F.abs(d["e"]).cast("string"))
        tidy = lambda t: F.regexp_replace(_stripped(t), r"\.$", "")
        return F.when((d["e"] < -4) | (d["e"] >= 6), F.concat(tidy(_decimals(d["k"], 5)), F.lit("e"), power)).otherwise(tidy(plain))

    text = F.when(value == 0, "0").when(_finite(value), _let(F.abs(value), lambda size: _let(exponent(size), lambda e: _let(digits(size, e), write)))).otherwise(_odd(value))
    return F.when(value.isNotNull(), F.concat(F.when((value < 0) & ~F.isnan(value), "-").otherwise("+"), text))


def canonical(value: Column) -> Column:
    """``value`` rounded to six decimals in its shortest form, zero without a sign; with an exponent from 1e16 on.  What is no finite
    number has no form in JSON and is null."""

    def write(k: Column) -> Column:
        tidy = lambda t, end: F.regexp_replace(_stripped(t), r"\.$", end)
        small = F.when(k < 10, F.concat(k.cast("string"), F.lit("e-06"))).otherwise(F.concat(tidy(_decimals(k, 1), ""), F.lit("e-05")))
        return F.when(k == 0, "0.0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), F.when(k < 100, small).otherwise(tidy(_decimals(k, 6), ".0"))))

    def large(text: Column) -> Column:
        # d.ddEn of the size, to plain digits or an exponent with its sign.
        parts = F.struct(F.regexp_replace(F.regexp_extract(text, r"^([0-9]+\.[0-9]+)E", 1), r"\.?0*$|\.", "").alias("digits"), F.regexp_extract(text, r"E([0-9]+)$", 1).cast("int").alias("e"))

        def plain(p: Column) -> Column:
            padded = F.rpad(p["digits"], F.greatest(F.char_length(p["digits"]), p["e"] + 1), F.lit("0"))
            behind = F.substring(padded, p["e"] + 2, F.char_length(padded))
            return F.concat(F.substring(padded, F.lit(1), p["e"] + 1), F.lit("."), F.when(behind == "", "0").otherwise(behind))

        def power(p: Column) -> Column:
            head = F.concat(F.left(p["digits"], F.lit(1)), F.when(F.char_length(p["digits"]) > 1, F.concat(F.lit("."), F.substring(p["digits"], F.lit(2), F.char_length(p["digits"])))).otherwise(""))
            return F.concat(head, F.lit("e+"), p["e"].cast("string"))

        return _let(parts, lambda p: F.when(p["e"] < 16, plain(p)).otherwise(power(p)))

    def with_decimals(size: Column) -> Column:
        # Below 2^53: the fewest decimals that name the same number.
        found = F.get(F.filter(F.array(*[_split(size, d) for d in range(1, 8)]), lambda t: t.cast("double") == size), 0)
        return F.regexp_replace(_stripped(found), r"\.$", ".0")

    def whole(size: Column) -> Column:
        # Up to 64 bits: the whole number rounded to the fewest digits that name the same number.
        def rounded(k: int) -> Column:
            n, m = size.cast("long"), F.lit(10**k).cast("long")
            q, rest = F.call_function("div", n, m), n % m
            up = (rest * 2 > m) | (rest * 2 == m) & (q % 2 == 1)
            return (q + up.cast("long")) * m

        best = F.get(F.filter(F.array(*[rounded(k) for k in range(5, -1, -1)]), lambda n: n.cast("double") == size), 0).cast("string")
        return F.when(size < 1e16, F.concat(best, F.lit(".0"))).otherwise(large(F.concat(F.left(best, F.lit(1)), F.lit("."), F.substring(best, F.lit(2), F.lit(30)), F.lit("E"), (F.char_length(best) - 1).cast("string"))))

    def beyond(size: Column) -> Column:
        # The platform's text may have more digits than it needs: the fewest that name the same number are taken.
        short = lambda n: F.regexp_replace(F.upper(F.format_string(f"%.{n - 1}e", size)), r"E\+0*", "E")
        return large(F.coalesce(F.get(F.filter(F.array(*[short(n) for n in (15, 16, 17)]), lambda t: t.cast("double") == size), 0), size.cast("string")))

    def write_big(size: Column) -> Column:
        return F.when(size < float(1 << 53), with_decimals(size)).when(size < NO_LONG, whole(size)).otherwise(beyond(size))

    sign = F.when(value < 0, "-").otherwise("")
    big = F.concat(sign, _let(F.abs(value), write_big))
    return F.when(_finite(value), F.when(F.abs(value) < NO_SIXTH, _let(scaled(value, 6), write)).otherwise(big))

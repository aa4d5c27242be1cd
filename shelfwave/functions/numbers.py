"""Rounding, ratios and number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfwave.functions.text import let

NARROW_NBSP = "\u202f"


def rounded(value: Column, digits: int) -> Column:
    """Half-even at `digits` decimals (exact binary ties go to the even digit); never gives -0.0."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL when whole is 0 or NULL."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def tenths(value: Column) -> Column:
    """An integer number of tenths as a double."""
    return value.cast("double") / F.lit(10.0)


def js_round(value: Column) -> Column:
    """Half towards plus infinity, the rounding of the dashboard's percentages."""
    return F.floor(value + F.lit(0.5)).cast("long")


def fr_number(value: Column, decimals: int = 1) -> Column:
    """Decimal comma, fixed decimals, half-even on exact ties; NULL stays NULL."""
    text = F.format_string(f"%.{decimals}f", rounded(value, decimals))
    return F.when(value.isNotNull(), F.translate(text, ".", ","))


def fr_integer(value: Column) -> Column:
    """1284 -> "1 284" with a narrow no-break space between thousands."""
    return F.translate(F.format_number(value, 0), ",", NARROW_NBSP)


def fr_percent(share: Column, signed: bool = False) -> Column:
    """0.42 -> "42 %" or "+42 %", with a real minus sign in signed form."""
    n = js_round(share * F.lit(100.0))
    body = F.concat(F.abs(n).cast("string"), F.lit(f"{NARROW_NBSP}%"))
    if not signed:
        return body
    sign = F.when(n > 0, F.lit("+")).when(n < 0, F.lit("\u2212")).otherwise(F.lit(""))
    return F.concat(sign, body)


# Currency tokens in the order they are looked up, and their ISO codes.
CURRENCY_TOKENS = (
    ("TND", "TND"), ("DT", "TND"), ("د.ت", "TND"), ("EUR", "EUR"), ("€", "EUR"), ("USD", "USD"), ("$", "USD"),
    ("GBP", "GBP"), ("£", "GBP"), ("MAD", "MAD"), ("CHF", "CHF"),
)
_SPACES = " \\s\u00a0\u202f'"


def number_from_text(raw: Column) -> Column:
    """Number text with French or English separators -> double, NULL when it is not a number.

    With both separators the last one is the decimal one; a single comma is decimal; repeated separators of one kind
    group thousands."""
    cleaned = F.regexp_replace(F.regexp_replace(raw, f"[{_SPACES}]", ""), "^[.,]+|[.,]+$", "")

    def plain(s: Column) -> Column:
        commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
        dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
        no_dots, no_commas = F.replace(s, F.lit("."), F.lit("")), F.replace(s, F.lit(","), F.lit(""))
        comma_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
        comma_is_last = s.rlike(",[^.]*$")
        return (F.when((commas > 0) & (dots > 0), F.when(comma_is_last, comma_decimal).otherwise(no_commas))
                .when(commas == 1, comma_decimal)
                .when(commas > 1, no_commas)
                .when(dots > 1, no_dots)
                .otherwise(s))

    return let(let(cleaned, plain), lambda text: F.when(text != "", text.try_cast("double")))


def price_of(text: Column) -> tuple[Column, Column]:
    """(price, ISO currency) of a display text; both NULL when it holds no number."""
    def read(t: Column) -> Column:
        upper = F.upper(t)
        currency = F.coalesce(*[F.when(upper.contains(token), F.lit(iso)) for token, iso in CURRENCY_TOKENS])
        price = number_from_text(F.regexp_extract(t, f"[0-9][0-9{_SPACES}.,]*", 0))
        return let(price, lambda p: F.struct(p.alias("price"), F.when(p.isNotNull(), currency).alias("currency")))

    found = let(text, read)  # the text is built and read once for both
    return found["price"], found["currency"]

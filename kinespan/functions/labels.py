"""Labels written in several ways, as one text each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full-width digits and what they stand for.
WIDE_DIGITS, PLAIN_DIGITS = "０１２３４５６７８９", "0123456789"
#: Blanks that `trim` does not remove unless named.
BLANKS = " \t\r\n\f\v\u00a0\u2007\u202f\u3000\ufeff"


def plain(c: Column) -> Column:
    """Digits as ASCII, outer blanks of any kind removed."""
    return F.translate(F.trim(c, F.lit(BLANKS)), WIDE_DIGITS, PLAIN_DIGITS)


def action_key(c: Column) -> Column:
    """``A07`` for `A7`, ` a07`, `A-07`, `A007`: equal if the numbers are equal. Null if there is no number."""
    number = F.regexp_extract(plain(c), r"^\D*0*(\d{1,9})\D*$", 1)
    return F.when(number != "", F.concat(F.lit("A"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))


def age_key(c: Column) -> Column:
    """``36_47mo`` for any text with those two numbers of months. Null unless there are exactly two numbers."""
    text, pair = plain(c), r"^\D*0*(\d{1,6})\D+0*(\d{1,6})\D*$"
    low, high = F.regexp_extract(text, pair, 1), F.regexp_extract(text, pair, 2)
    return F.when(low != "", F.concat(low, F.lit("_"), high, F.lit("mo")))


def whole_number_key(c: Column) -> Column:
    """The positive whole number that a text denotes, as digits without leading zeros; null for any other text.

    `17`, `0017`, ` 17.00 `, `+17`, `1.7e1` and full-width digits are the same number. Plain digits may
    have any length; numbers with an exponent are read up to 26 digits.
    """
    text = plain(c)
    digits = F.regexp_extract(text, r"^\+?0*([1-9]\d*)(?:\.0*)?$", 1)
    scientific = F.when(text.rlike(r"^\+?(\d+\.?\d*|\.\d+)[eE][+-]?\d{1,2}$"), text.try_cast("decimal(38,12)"))
    whole = F.when((scientific > 0) & (scientific == F.floor(scientific)), F.floor(scientific).cast("string"))
    return F.when(digits != "", digits).otherwise(whole)


def child_or_unknown(child: Column, segment: Column) -> Column:
    """A child's id for grouping: integral numbers as integers, other texts trimmed, `desconocido::segment` for missing ones.

    `7.0` and `007` are `7`, `1e3` is `1000`, `x7` stays `x7`.
    """
    text = F.trim(child)
    number = text.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9e15)) & (number == F.floor(number))
    return (
        F.when(text.isNull() | (text == ""), F.concat(F.lit("desconocido::"), segment))
        .when(whole, number.cast("long").cast("string"))
        .otherwise(text)
    )


def child_text(child: Column) -> Column:
    """A child's id as written, without outer blanks and one trailing `.0`; null for missing ones. `007` stays `007`."""
    text = F.regexp_replace(F.trim(child), r"\.0$", "")
    return F.when(text != "", text)


def references_for(n_children: Column) -> Column:
    """How many references a group of so many children gets: 1, from 5 on 2, from 10 on 3, from 20 on 4."""
    return F.when(n_children < 5, 1).when(n_children < 10, 2).when(n_children < 20, 3).otherwise(4)


def age_start(label: Column) -> Column:
    """The first month of `36_47mo`; null for any other form of label."""
    return F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*(\d{1,6})_(\d{1,6})mo\s*$", 1).try_cast("int")


def split_pipe(c: Column) -> Column:
    """The non-blank items of `a|b|c`, trimmed; an empty array for null."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")

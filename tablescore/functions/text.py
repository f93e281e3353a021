"""String helpers as native column expressions, with the semantics of Unicode white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode class lacks the four information separators, which count as white space here.
SPACE = r"[\s\x1c-\x1f]"
#: The same characters one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it: inside lambdas Spark shares no common expressions."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(x, F.lit(SPACES))


def collapse(x: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, rf"(?U){SPACE}+", " "))


def without_space(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U){SPACE}+", "")


def tokens(x: Column) -> Column:
    """Parts between runs of white space."""
    return F.filter(F.split(x, rf"(?U){SPACE}+"), lambda t: t != "")


def lines(x: Column) -> Column:
    return F.split(strip(x), "\n")


def truthy(x: Column) -> Column:
    """x, or null if it is empty."""
    return F.nullif(x, F.lit(""))


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def normalised_cell(x: Column) -> Column:
    """A cell as it is compared: without any white space and ASCII hyphens; null as empty. Character references are
    resolved where grids are built, as Spark has no function for them."""
    return F.coalesce(F.regexp_replace(x, rf"(?U)(?:{SPACE}|-)+", ""), F.lit(""))


def blank_label(label: Column) -> Column:
    """Whether the part of a node label before the first pipe is blank; that of a null is."""
    return strip(F.split_part(F.coalesce(label, F.lit("")), F.lit("|"), F.lit(1))) == ""

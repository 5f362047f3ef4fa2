"""Small column rules: departments, identifiers, code tables held in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink import constants as K


def department_of(postcode: Column, corsica: str = "full") -> Column:
    """Department of a postcode.

    ``corsica="full"`` splits 20xxx at 20190 (2A below, 2B above); ``"short"`` does so only for 200xx and 201xx and
    calls the rest 2A.
    """
    cp = F.coalesce(postcode, F.lit(""))
    number = F.when(cp.rlike("^[0-9]{5}$"), cp.cast("int"))
    split = F.when(number <= 20190, "2A").otherwise("2B")
    if corsica == "full":
        island = F.when(number.isNotNull(), split).otherwise("2A")
    elif corsica == "short":
        island = F.when(cp.rlike("^20[01]"), split).otherwise("2A")
    else:
        raise ValueError("corsica must be 'full' or 'short'")
    return (
        F.when(F.length(cp) < 2, "")
        .when(cp.startswith("97"), F.substring(cp, 1, 3))
        .when(cp.startswith("20"), island)
        .otherwise(F.substring(cp, 1, 2))
    )


def region_key(postcode: Column) -> Column:
    """Department key of the region lookup: three characters overseas, else two."""
    cp = F.coalesce(postcode, F.lit(""))
    return F.when(cp.startswith("97"), F.substring(cp, 1, 3)).otherwise(F.substring(cp, 1, 2))


def valid_id_format(c: Column, digits: int = 14) -> Column:
    return F.coalesce(c.rlike(rf"^[0-9]{{{digits}}}\z"), F.lit(False))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s.]", "")


def valid_checksum(c: Column, lengths: tuple[int, ...] = (9, 14), parity: str = "standard") -> Column:
    """Mod-10 check on an identifier, spaces and dots ignored.

    ``parity="odd"`` doubles every second digit from the left whatever the length. For an even length that is the
    standard rule applied to the number with a zero appended.
    """
    s = digits_of(c)
    ok = F.call_function("luhn_check", s)
    if parity == "odd":
        ok = F.when(F.length(s) % 2 == 0, F.call_function("luhn_check", F.concat(s, F.lit("0")))).otherwise(ok)
    elif parity != "standard":
        raise ValueError("parity must be 'standard' or 'odd'")
    return F.coalesce(s.rlike(r"^[0-9]+\z") & F.length(s).isin(*lengths) & ok, F.lit(False))


def activity_prefix(naf: Column) -> Column:
    return F.substring(F.replace(F.coalesce(naf, F.lit("")), F.lit("."), F.lit("")), 1, 2)


def lookup_map(table: dict[str, str], key: Column) -> Column:
    """Constant code table of at most a few dozen entries, kept in the projection: no join, no shuffle."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def headcount_label(code: Column, ranges: dict[str, str] | None = None) -> Column:
    """Range of a headcount code; an unknown code is kept."""
    code = F.coalesce(code, F.lit(""))
    return F.coalesce(lookup_map(ranges or K.HEADCOUNT_RANGES, code), code)

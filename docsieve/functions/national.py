"""National identifiers of member states: the names of their fields, their shapes, and their check digits, letters and dates, as column expressions.

Numbers may be written with blanks, points, strokes and hyphens between digits; checks take them without.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions.checks import digits, luhn, weighted


@dataclass(frozen=True)
class Country:
    """names go before a field's own terms; shape is that of a value, check the name of its check."""

    code: str
    names: list[str]
    terms: list[str]
    shape: str
    check: str


def _digits(least: int, most: int | None = None) -> str:
    return f"[0-9](?:[ ./-]?[0-9]){{{least - 1},{(most or least) - 1}}}"


# Countries, the fields of their identifiers, and the identifiers' shapes, which their registers publish.
COUNTRIES = [
    Country("ES", ["Spain", "Spanish"], ["DNI", "NIE", "NIF"], "[0-9]{8}[ -]?[A-Z]|[XYZ][ -]?[0-9]{7}[ -]?[A-Z]", "es_dni"),
    Country("NL", ["Netherlands", "Dutch"], ["BSN", "citizen service number"], _digits(8, 9), "nl_bsn"),
    Country("PL", ["Poland", "Polish"], ["PESEL"], _digits(11), "pl_pesel"),
    Country("FR", ["France", "French"], ["INSEE", "NIR", "social security number"], f"{_digits(15)}|{_digits(13)}", "fr_nir"),
    Country("DE", ["Germany", "German"], ["tax ID", "TIN", "Steueridentifikationsnummer"], _digits(11), "de_tax_id"),
    Country("IT", ["Italy", "Italian"], ["codice fiscale", "tax code"], "[A-Z]{3} ?[A-Z]{3} ?[0-9]{2}[A-Z][0-9]{2} ?[A-Z][0-9]{3}[A-Z]", "it_codice"),
    Country("BE", ["Belgium", "Belgian"], ["national number", "rijksregisternummer", "numero national", "numéro national"], _digits(11), "be_national"),
    Country("PT", ["Portugal", "Portuguese"], ["NIF", "tax number"], _digits(9), "pt_nif"),
    Country("SE", ["Sweden", "Swedish"], ["personnummer", "personal identity number"], f"(?:[0-9]{{2}})?[0-9]{{6}}[-+ ]?[0-9]{{4}}", "se_personnummer"),
    Country("FI", ["Finland", "Finnish"], ["HETU", "personal identity code"], "[0-9]{6}[+A-][0-9]{3}[0-9A-Z]", "fi_hetu"),
    Country("IE", ["Ireland", "Irish"], ["PPSN", "personal public service number"], "[0-9]{7} ?[A-W][A-W]?", "ie_ppsn"),
    Country("AT", ["Austria", "Austrian"], ["SVNR", "social security number"], _digits(10), "at_svnr"),
    Country("DK", ["Denmark", "Danish"], ["CPR", "civil registration number", "personal identification number"], _digits(10), "dk_cpr"),
    Country("CZ", ["Czechia", "Czech"], ["birth number", "rodne cislo", "rodné číslo"], _digits(10), "cz_birth"),
    Country("SK", ["Slovakia", "Slovak"], ["birth number", "rodne cislo", "rodné číslo"], _digits(10), "cz_birth"),
    Country("RO", ["Romania", "Romanian"], ["CNP", "personal numeric code"], _digits(13), "ro_cnp"),
]
# Fields that any country's code or name may go before.
ANY_TERMS, CODE_TERMS = ["national ID"], ["identity card", "identity number", "personal ID", "tax ID", "TIN"]
#: What may stand between a field's name and its value.
SIGN = r"^\s*[:#=-]?\s*"
DNI_LETTERS, HETU_LETTERS, PPSN_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "0123456789ABCDEFHJKLMNPRSTUVWXY", "WABCDEFGHIJKLMNOPQRSTUV"
#: Worth of a character at an odd place of a codice fiscale, for A, B, C and so on; a digit is worth as much as the letter of its number.
CODICE_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def fields() -> list[tuple[str, str, bool]]:
    """(name of the field, country, whether its values are checked). Of two equal names the first counts. A German number that isn't called a tax number is told by its field alone."""
    out = []
    for c in COUNTRIES:
        for name in (c.code, *c.names):
            for term in (*c.terms, *ANY_TERMS, *(CODE_TERMS if name == c.code else [])):
                out.append((f"{name} {term}", c.code, c.code != "DE" or term in c.terms or name != "DE"))
    return out


def compact(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[ ./-]", ""))


def _number(value: Column, first: int, size: int) -> Column:
    return F.substring(value, first, size).cast("long")


def _at(text: str, place: Column) -> Column:
    return F.substring(F.lit(text), place.cast("int") + 1, F.lit(1))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Whether there is such a day."""
    return F.coalesce(F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.lit(False))


def _date_of_century(year: Column, month: Column, day: Column) -> Column:
    return _date(year + 1900, month, day) | _date(year + 2000, month, day)


def es_dni(v: Column) -> Column:
    """Number modulo 23; X, Y and Z are 0, 1 and 2."""
    number = F.translate(F.substring(v, 1, 8), "XYZ", "012").cast("long")
    return F.substring(v, 9, 1) == _at(DNI_LETTERS, number % 23)


def nl_bsn(v: Column) -> Column:
    return weighted(F.lpad(v, 9, "0"), [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0


def pl_pesel(v: Column) -> Column:
    return weighted(v, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1]) % 10 == 0


def fr_nir(v: Column) -> Column:
    """The key of a number that has one."""
    return (F.length(v) == 13) | (97 - _number(v, 1, 13) % 97 == _number(v, 14, 2))


def de_tax_id(v: Column) -> Column:
    """ISO 7064, modulo 11 and 10."""
    step = lambda p, d: F.when((p + d) % 10 == 0, F.lit(20)).otherwise((p + d) % 10 * 2) % 11
    last = F.aggregate(F.slice(digits(v), 1, 10), F.lit(10), step)
    return (F.substring(v, 1, 1) != "0") & ((11 - last) % 10 == _number(v, 11, 1))


def it_codice(v: Column) -> Column:
    places = F.transform(F.split(F.substring(v, 1, 15), ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 65))
    odd = F.array(*(F.lit(x) for x in CODICE_ODD))
    worth = F.transform(places, lambda x, i: F.when(i % 2 == 0, F.get(odd, x)).otherwise(x))
    return F.ascii(F.substring(v, 16, 1)) - 65 == F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 26


def be_national(v: Column) -> Column:
    """97 less the rest; numbers of those born since 2000 have a 2 before them."""
    key = _number(v, 10, 2)
    return (97 - _number(v, 1, 9) % 97 == key) | (97 - (_number(v, 1, 9) + 2_000_000_000) % 97 == key)


def pt_nif(v: Column) -> Column:
    rest = weighted(v, [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return v.rlike("^[1235689]") & (F.when(rest < 2, 0).otherwise(11 - rest) == _number(v, 9, 1))


def se_personnummer(v: Column) -> Column:
    return luhn(F.substring(F.regexp_replace(v, "[^0-9]", ""), -10, 10))


def fi_hetu(v: Column) -> Column:
    """The sign tells the century; a number without it has lost its hyphen."""
    plain = F.regexp_replace(v, "[+A-]", "")
    year = F.substring(plain, 5, 2).cast("int") + F.when(F.substring(v, 7, 1) == "+", 1800).when(F.substring(v, 7, 1) == "A", 2000).otherwise(1900)
    number = F.concat(F.substring(v, 1, 6), F.substring(v, 8, 3)).cast("long")
    return _date(year, _number(v, 3, 2), _number(v, 1, 2)) & (_at(HETU_LETTERS, number % 31) == F.substring(v, 11, 1))


def ie_ppsn(v: Column) -> Column:
    """A second letter counts nine times its number."""
    second = F.when(F.length(v) == 9, (F.ascii(F.substring(v, 9, 1)) - 64) * 9).otherwise(0)
    return _at(PPSN_LETTERS, (weighted(F.substring(v, 1, 7), [8, 7, 6, 5, 4, 3, 2]) + second) % 23) == F.substring(v, 8, 1)


def at_svnr(v: Column) -> Column:
    """The fourth digit is the check; a day of birth follows it."""
    total = weighted(v, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6]) % 11
    return (total == _number(v, 4, 1)) & _date_of_century(_number(v, 9, 2), _number(v, 7, 2), _number(v, 5, 2))


def dk_cpr(v: Column) -> Column:
    return _date_of_century(_number(v, 5, 2), _number(v, 3, 2), _number(v, 1, 2))


def cz_birth(v: Column) -> Column:
    """Divisible by 11; months of women and of crowded days are shifted by 20, 50 or 70."""
    month = _number(v, 3, 2)
    month = month - F.when(month > 70, 70).when(month > 50, 50).when(month > 20, 20).otherwise(0)
    return (v.cast("long") % 11 == 0) & _date_of_century(_number(v, 1, 2), month, _number(v, 5, 2))


def ro_cnp(v: Column) -> Column:
    """The first digit tells the century: 1, 2, 7 and 8 the twentieth, 3 and 4 the one before, 5 and 6 the one after."""
    first = _number(v, 1, 1)
    century = F.when(first.isin(3, 4), 1800).when(first.isin(5, 6), 2000).otherwise(1900)
    rest = weighted(v, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]) % 11
    return first.between(1, 8) & _date(_number(v, 2, 2) + century, _number(v, 4, 2), _number(v, 6, 2)) & (F.when(rest == 10, 1).otherwise(rest) == _number(v, 13, 1))


#: Checks by name. All take a number without separators, but for the Finnish, whose sign counts.
CHECKS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f for f in (es_dni, nl_bsn, pl_pesel, fr_nir, de_tax_id, it_codice, be_national, pt_nif, se_personnummer, fi_hetu, ie_ppsn, at_svnr, dk_cpr, cz_birth, ro_cnp)
}


def valid(country: Column, value: Column, plain: Column | None = None) -> Column:
    """Whether a value passes the check of its country; plain is the value without separators, if it is at hand."""
    plain = compact(value) if plain is None else plain
    out = F.when(F.lit(False), F.lit(False))
    for check, run in CHECKS.items():
        out = out.when(country.isin([c.code for c in COUNTRIES if c.check == check]), run(value if check == "fi_hetu" else plain))
    return F.coalesce(out, F.lit(False))

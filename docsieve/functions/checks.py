"""Checks of what a pattern has found: checksums and ranges, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    """The digits of a string, as an array of integers."""
    return F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def weighted(value: Column, weights: list[int]) -> Column:
    """Sum of digit times weight, over as many digits as there are weights."""
    pairs = F.zip_with(F.slice(digits(value), 1, len(weights)), F.array(*(F.lit(w) for w in weights)), lambda d, w: d * w)
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def ipv4(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def entropy(value: Column) -> Column:
    """Shannon's entropy of the characters, in bits."""
    chars = F.split(value, "")
    size = F.length(value)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def nric(value: Column) -> Column:
    """The check letter of an identity number: weights 2, 7, 6, 5, 4, 3, 2; T, G and M shift the sum."""
    first = F.substring(value, 1, 1)
    total = weighted(value, [2, 7, 6, 5, 4, 3, 2]) + F.when(first.isin("T", "G"), 4).when(first == "M", 3).otherwise(0)
    letters = F.when(first.isin("S", "T"), "JZIHGFEDCBA").when(first.isin("F", "G"), "XWUTRQPNMLK").otherwise("XWUTRQPNJLK")
    return F.substring(value, 9, 1) == F.substring(letters, (total % 11 + 1).cast("int"), F.lit(1))


def us_ssn(value: Column) -> Column:
    """Areas, groups and serials that are given out; two numbers of advertisements never were."""
    area = F.substring(value, 1, 3).cast("int")
    return (area > 0) & (area != 666) & (area < 900) & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000") & ~value.isin("078-05-1120", "219-09-9999")


def au_tfn(value: Column) -> Column:
    return weighted(value, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0


def au_abn(value: Column) -> Column:
    return (weighted(value, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0


def cn_resident_id(value: Column) -> Column:
    total = weighted(F.substring(value, 1, 17), [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])
    return F.upper(F.substring(value, 18, 1)) == F.substring(F.lit("10X98765432"), (total % 11 + 1).cast("int"), F.lit(1))


def iso_date(value: Column) -> Column:
    parsed = F.try_to_date(value, "yyyy-MM-dd")
    return parsed.isNotNull() & F.year(parsed).between(1900, 2100)


def last_digit(value: Column, expected: Column) -> Column:
    return F.element_at(digits(value), -1) == expected


def jp_my_number(value: Column) -> Column:
    rest = weighted(value, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return last_digit(value, F.when(rest <= 1, 0).otherwise(11 - rest))


def kr_business_registration(value: Column) -> Column:
    tens = F.floor(F.get(digits(value), F.lit(8)) * 5 / 10)
    return last_digit(value, (10 - (weighted(value, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + tens) % 10) % 10)


def hk_hkid(value: Column) -> Column:
    """One or two letters (A is 10), six digits, and a check character (A is 10), which may stand in brackets; where there is one letter, the other counts 36."""
    plain = F.regexp_replace(value, "[()]", "")
    letter = lambda k: F.ascii(F.substring(plain, k, 1)) - 55
    total = F.when(F.length(plain) == 9, letter(1) * 9 + letter(2) * 8).otherwise(36 * 9 + letter(1) * 8) + weighted(F.substring(plain, -7, 6), [7, 6, 5, 4, 3, 2])
    check = F.substring(plain, -1, 1)
    return (total + F.when(check == "A", 10).otherwise(check.try_cast("int"))) % 11 == 0


def uk_nin(value: Column) -> Column:
    return ~value.rlike("^(?:[DFIQUV]|.[DFIQUVO]|BG|GB|KN|NK|NT|TN|ZZ)")


#: Prefixes of employer numbers that are given out; fixed values.
EIN_PREFIXES = (
    "01 02 03 04 05 06 10 11 12 13 14 15 16 20 21 22 23 24 25 26 27 30 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 "
    "50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 71 72 73 74 75 76 77 80 81 82 83 84 85 86 87 88 90 91 92 93 94 95 98 99"
).split()
#: Characters and weights of the credit code, and the permutation of the Aadhaar checksum; fixed values.
USCC_ALPHABET, USCC_WEIGHTS = "0123456789ABCDEFGHJKLMNPQRTUWXY", [pow(3, k, 31) for k in range(17)]
_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def dihedral(a: int, b: int) -> int:
    """The product of the group of the pentagon: 0-4 turn it, 5-9 mirror and turn it."""
    turned = (a + b) % 5 if a < 5 else (a - b) % 5
    return turned + 5 * ((a < 5) != (b < 5))


PRODUCTS = [[dihedral(a, b) for b in range(10)] for a in range(10)]
TURNS = [list(range(10))]
while len(TURNS) < 8:
    TURNS.append([_TURN[x] for x in TURNS[-1]])


def in_aadhaar(value: Column) -> Column:
    """Begins with 2-9, is none of the published examples nor one digit over and over, and the product of its permuted digits, last first, is 0."""
    flat = lambda table: F.array(*(F.lit(x) for row in table for x in row))
    turned = F.transform(F.reverse(digits(value)), lambda d, i: F.get(flat(TURNS), (i % 8) * 10 + d))
    product = F.aggregate(turned, F.lit(0), lambda s, x: F.get(flat(PRODUCTS), s * 10 + x))
    return (F.get(digits(value), F.lit(0)) >= 2) & (F.size(F.array_distinct(digits(value))) > 1) & (product == 0)


def cn_uscc(value: Column) -> Column:
    places = F.transform(F.split(F.upper(value), ""), lambda c: F.instr(F.lit(USCC_ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(places, 1, 17), F.array(*(F.lit(w) for w in USCC_WEIGHTS)), lambda d, w: d * w)
    return F.element_at(places, 18) == (31 - F.aggregate(pairs, F.lit(0), lambda s, x: s + x) % 31) % 31


CHECKS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "ipv4": ipv4,
    "entropy": lambda v: entropy(v) >= 3.0,
    "nric": nric,
    "us_ssn": us_ssn,
    "au_tfn": au_tfn,
    "au_abn": au_abn,
    "cn_resident_id": cn_resident_id,
    "iso_date": iso_date,
    "us_ein": lambda v: F.substring(v, 1, 2).isin(EIN_PREFIXES),
    "us_itin": lambda v: F.substring(v, 5, 2).rlike("5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9]"),
    "uk_nin": uk_nin,
    "au_acn": lambda v: last_digit(v, (10 - weighted(v, [8, 7, 6, 5, 4, 3, 2, 1]) % 10) % 10),
    "hk_hkid": hk_hkid,
    "jp_my_number": jp_my_number,
    "jp_corporate_number": lambda v: F.get(digits(v), F.lit(0)) == 9 - weighted(v, [0] + [2, 1] * 6) % 9,
    "kr_rrn": lambda v: last_digit(v, (11 - weighted(v, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10),
    "kr_business_registration": kr_business_registration,
    "in_aadhaar": in_aadhaar,
    "th_national_id": lambda v: v.rlike("^[1-8]") & last_digit(v, (11 - weighted(v, list(range(13, 1, -1))) % 11) % 10),
    "cn_uscc": cn_uscc,
    "adult_age": lambda v: v.cast("int").between(20, 120),
    "value_digit": lambda v: v.rlike("[0-9]"),
    "not_all_zero": lambda v: v.rlike("[1-9]"),
}

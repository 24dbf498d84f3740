"""Shapes of postal addresses by country, and what else tells an address: fixed values as plain lists, and the patterns put together from them.

Patterns keep to what Java's and RE2's expressions read alike: ends of words are asked for only beside Latin letters and digits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Kinds of streets, by country.
UK_STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Close", "Drive", "Dr", "Way", "Court", "Ct", "Square", "Sq", "High Street"]
US_STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Way", "Circle", "Cir", "Place", "Pl"]
AU_STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Way", "Place", "Pl"]
EU_STREETS = [
    "Strasse", "Straße", "Str.", "Rue", "Avenue", "Via", "Calle", "Rua", "Ulica", "ul.", "Gasse", "Laan", "Weg", "Strada", "Street", "Katu", "Tie", "Vej", "Gade", "Namesti", "Náměstí", "Naměsti",
]
MY_STREETS = ["Jalan", "Lorong", "Persiaran", "Lebuh", "Taman"]
PH_STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Boulevard", "Blvd"]
IN_STREETS = ["Road", "Rd", "Street", "St", "Marg", "Nagar"]
SHORT_STREETS = ["Road", "Rd", "Street", "St"]
# States, member states and places.
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
AU_STATES = "ACT NSW NT QLD SA TAS VIC WA".split()
EU_STATES = "AT BE CZ DE DK ES FI FR IE IT NL PL PT RO SE SK".split()
JP_PREFECTURES = ["東京都", "北海道", "大阪府", "京都府"]
KR_REGIONS = ["서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주"]
KR_LATIN = ["Seoul", "Busan", "Daegu", "Incheon", "Gwangju", "Daejeon", "Ulsan", "Sejong", "Gyeonggi", "Gangwon", "Jeju"]
CN_CITIES = ["北京市", "上海市", "深圳市", "广州市", "杭州市"]
LOCALITIES = [
    "Singapore", "Hong Kong", "Kowloon", "Malaysia", "Indonesia", "Thailand", "Philippines", "Vietnam", "India", "China", "Australia", "Japan", "Korea", "United Kingdom", "United States", "UAE",
    "Saudi Arabia", "Dubai", "Abu Dhabi", "Riyadh", "Jeddah", "Mumbai", "Delhi", "Beijing", "Shanghai", "Bangkok", "Jakarta", "Manila", "Hanoi", "Ho Chi Minh", "Sydney", "Melbourne", "Tokyo", "Seoul",
    "London", "New York", "California",
]
# Words of an address of any country, by script.
SUBSTANCE = [
    "Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Way", "Place", "Pl", "Square", "Sq", "Close", "High Street", "Block", "Blk", "Unit",
    "Suite", "Apt", "Apartment", "Floor", "Tower", "Building", "Jalan", "Lorong", "Kampong", "Barangay", "Brgy", "Makati", "Quezon",
]
SUBSTANCE_OTHER = ["〒", "丁目", "番地", "号", "都", "府", "県", "市", "区", "町", "村", "路", "街", "道", "號", "楼", "室", "구", "동", "로", "길", "시", "군", "شارع", "طريق", "ถนน", "แขวง", "เขต"]
# Labels of address fields; who lives there, and who only does business there.
LABELS = [
    "residential address", "mailing address", "registered address", "home address", "office address", "billing address", "delivery address", "service address", "notice address", "signatory address",
    "invoice address", "address", "住所", "주소", "地址", "alamat", "địa chỉ", "ที่อยู่", "عنوان",
]
PERSONAL = [
    "Mr", "Ms", "Mrs", "Mdm", "Dr", "Prof", "employee", "patient", "client", "customer", "resident", "applicant", "data subject", "home", "residential", "private", "personal", "domicile",
    "correspondence", "c/o", "care of", "attn", "attention",
]
CORPORATE = ["registered office", "corporate office", "head office", "principal place of business", "company address", "organisation", "organization"]
FREEFORM_STREETS = [
    "Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Way", "Place", "Pl", "Square", "Sq", "Close", "High Street", "Jalan", "Lorong",
    "Persiaran", "Lebuh",
]
FREEFORM_PLACES = ["Singapore", "Hong Kong", "Malaysia", "Australia", "Japan", "Korea", "London", "New York", "California", "Tokyo", "Seoul", "Sydney", "Melbourne"]


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(r"\s+".join(map(re.escape, w.split())) for w in words) + ")"


def _name(most: int, inside: str = "A-Za-z0-9", least: int = 2) -> str:
    """A name that begins with a capital (in either case, under (?i))."""
    return f"[A-Z][{inside}' -]{{{least},{most}}}"


_WORDS, _NOT_LINE = "A-Za-z", "[^\\n]"
_EURO = "A-Za-zÀ-ÖØ-öø-ÿ"
UK_POSTCODE = r"[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}"


@dataclass(frozen=True)
class Shape:
    """An address of one country. late: it takes only what no other address has."""

    rule: str
    pattern: str
    late: bool = False

    @property
    def pack(self) -> str:
        return self.rule[:2].upper()


def _street(number: str, name: str, kinds: list[str], between: str, tail: str, nocase: bool = True) -> str:
    """Number, name, kind of street, what may stand between, and the end."""
    return rf"{'(?i)' if nocase else ''}\b{number}\s+{name}\s+{any_of(kinds)},?\s+{between}{tail}\b"


def _town(most: int, inside: str = _WORDS) -> str:
    return rf"(?:{_name(most, inside)},?\s+)?"


SHAPES = [
    Shape("uk_postal_address", _street("[0-9]{1,4}[A-Z]?", _name(40, _WORDS), UK_STREETS, _town(40), UK_POSTCODE)),
    Shape("us_postal_address", _street("[0-9]{1,6}", _name(50), US_STREETS, _town(50), rf"{any_of(US_STATES)}\s+[0-9]{{5}}(?:-[0-9]{{4}})?", False)),
    Shape("hk_postal_address", rf"(?i)\b(?:Flat|Room|Rm|Unit)\s+[A-Z0-9-]{{1,8}},?\s+(?:[0-9]{{1,3}}(?:st|nd|rd|th)?\s+Floor|[A-Z0-9-]{{1,8}}/F),?\s+[A-Z][A-Za-z0-9' &.-]{{2,60}},?\s+{any_of(['Hong Kong', 'Kowloon', 'New Territories', 'HK'])}\b"),
    Shape("au_postal_address", _street("[0-9]{1,5}", _name(50), AU_STREETS, "", rf"{_name(40, _WORDS)}\s+{any_of(AU_STATES)}\s+[0-9]{{4}}", False)),
    Shape("jp_postal_address", rf"(?:〒\s*)?[0-9]{{3}}-[0-9]{{4}}\s*(?:{'|'.join(JP_PREFECTURES)}|.{{2,3}}県){_NOT_LINE}{{2,80}}"),
    Shape("kr_postal_address", rf"(?i)\b[0-9]{{5}}\s+(?:{'|'.join(KR_REGIONS + KR_LATIN)}){_NOT_LINE}{{0,80}}(?:로|길|동|구|시|군|(?:Road|ro|gil|dong|gu|si)\b)"),
    Shape("eu_postal_address", rf"(?i)\b[0-9]{{1,5}}\s+(?:{any_of(EU_STREETS)}\s+{_name(50, _EURO)}|{_name(50, _EURO)}\s+{any_of(EU_STREETS)}),?\s+{_name(40, _EURO)},?\s+{any_of(EU_STATES)}\s*[- ]?[0-9]{{4,6}}\b"),
    Shape("my_postal_address", rf"(?i)\b[0-9]{{1,5}}\s+{any_of(MY_STREETS)}\s+{_name(60)},?\s+{_town(40)}[0-9]{{5}}\s+{any_of(['Kuala Lumpur', 'Selangor', 'Johor', 'Penang', 'Malaysia'])}\b", True),
    Shape("id_postal_address", rf"(?i)\b(?:Jl\.?|Jalan)\s+[A-Z][A-Za-z0-9' .-]{{2,60}}\s+(?:No\.?\s*)?[0-9]{{1,5}},?\s+{_town(40)}{any_of(['Jakarta', 'Surabaya', 'Bandung', 'Indonesia'])}\s+[0-9]{{5}}\b", True),
    Shape("th_postal_address", _street("[0-9]{1,5}", _name(60), ["Road", "Rd", "Soi"], _town(40), rf"{any_of(['Bangkok', 'Phuket', 'Chiang Mai', 'Thailand'])}\s+[0-9]{{5}}"), True),
    Shape("ph_postal_address", _street("[0-9]{1,5}", _name(60), PH_STREETS, "", rf"{any_of(['Makati', 'Taguig', 'Quezon City', 'Manila', 'Cebu', 'Philippines'])}\s+[0-9]{{4}}"), True),
    Shape("vn_postal_address", _street("[0-9]{1,5}", _name(60), ["Street", "St", "Road", "Rd", "Đường"], r"(?:District\s+[0-9]{1,2},?\s+)?", rf"{any_of(['Ho Chi Minh City', 'Hanoi', 'Da Nang', 'Vietnam'])}\s+[0-9]{{5,6}}"), True),
    Shape("in_postal_address", _street("[0-9]{1,5}", _name(60, least=1), IN_STREETS, _town(40), rf"(?:IN-)?[0-9]{{6}}\s+{any_of(['India', 'Mumbai', 'Delhi', 'Bengaluru', 'Chennai'])}"), True),
    Shape("cn_postal_address", rf"(?i)\b[0-9]{{6}}\s*(?:{'|'.join(CN_CITIES)}){_NOT_LINE}{{2,80}}(?:路|街|号)|{_street('[0-9]{1,5}', _name(60), SHORT_STREETS, '', any_of(['Beijing', 'Shanghai', 'Guangzhou', 'Shenzhen', 'China']) + r'\s+[0-9]{6}', False)}", True),
    Shape("ae_postal_address", rf"(?i)\b(?:Office|Unit|Flat|Suite)\s+[A-Z0-9-]{{1,8}},?\s+{_name(60)}\s+{any_of(SHORT_STREETS)},?\s+{any_of(['Dubai', 'Abu Dhabi', 'Sharjah', 'UAE', 'United Arab Emirates'])}\b", True),
    Shape("sa_postal_address", _street("[0-9]{1,5}", _name(60), SHORT_STREETS, "", rf"{any_of(['Riyadh', 'Jeddah', 'Dammam', 'Saudi Arabia'])}\s+[0-9]{{5}}(?:-[0-9]{{4}})?"), True),
]
#: A field with its value on the same line; a line that begins with a field's name, and what else may follow on up to two lines.
LABELLED = rf"(?i)(?:^|[;\n])\s*{any_of(LABELS)}\s*[:：]\s*([^\n]{{6,160}})"
FOLLOWING, FIELD_LINE = r"^\n[^\n]{6,160}", r"^\s*[A-Za-z][A-Za-z ]{0,40}\s*[:：]"
#: A person's name, a comma and an address, which is the group.
FREEFORM = (
    r"(?i)\b(?:(?:Mr|Ms|Mrs|Mdm|Dr|Prof)\.?\s+)?[A-Z][a-z]+(?:[-‐-―][A-Z][a-z]+)?(?:\s+[A-Z][a-z]+(?:[-‐-―][A-Z][a-z]+)?){1,3}\s*,\s*"
    rf"([0-9]{{1,6}}[A-Z]?\s+{_name(80)}{any_of(FREEFORM_STREETS)}[^\n;]{{0,140}}(?:{UK_POSTCODE}|[0-9]{{3}}-[0-9]{{4}}|[0-9]{{4,6}}(?:-[0-9]{{4}})?|{any_of(FREEFORM_PLACES)})\b)"
)
WORDS_OF_ADDRESS = rf"(?i)\b{any_of(SUBSTANCE)}\b|{'|'.join(SUBSTANCE_OTHER)}"
POSTCODE = rf"(?i)\b(?:{UK_POSTCODE}|[0-9]{{3}}-[0-9]{{4}}|[0-9]{{4,6}}(?:-[0-9]{{4}})?)\b"
LOCALITY = rf"(?i)\b{any_of(LOCALITIES)}\b"
REGION = rf"\b{any_of(AU_STATES + US_STATES + EU_STATES)}\b|{'|'.join(JP_PREFECTURES)}|.{{2,3}}県|서울|부산|대구|인천|경기"
PERSON_LINKED = rf"(?i)\b{any_of(PERSONAL)}\b"
ORGANISATION = rf"(?i)\b{any_of(CORPORATE)}\b"

"""The rule registry: what counts as a finding, as rows. Patterns keep to what Java's and RE2's expressions read alike: no look-around, spelled-out classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docsieve.functions import vocabulary


@dataclass(frozen=True)
class Rule:
    """A finding's kind. With cap, the finding is group 1, which ends where the match ends. guard: lines that fit it suppress the finding. check: a name in checks.CHECKS.

    A rule may have phrases in place of a pattern. negated: a negation in the BACK characters before a finding suppresses it.
    """

    name: str
    category: str
    severity: str
    pattern: str
    cap: bool = False
    pack: str = ""
    guard: str = ""
    check: str = ""
    phrases: tuple[str, ...] = ()
    negated: bool = False

    @property
    def expression(self) -> str:
        """The pattern, or one for the phrases."""
        return self.pattern or vocabulary.either(list(self.phrases))


#: Words that negate what follows at once, and how far back they are looked for; fixed values.
NEGATIONS, BACK = ["no", "nor", "not", "without", "never", "absent", "excluding", "neither"], 25
NEGATED_BACK = rf"(?i)\b(?:{'|'.join(NEGATIONS)})\b[\s\w]{{0,15}}$"
_S = "[ \t]+"
_SEP = "[ \t:.#-]*"
_PLACEHOLDER = "(?i)placeholder|sample|dummy|example only"

#: Direct identifiers, in any text.
IDENTIFIERS = [
    Rule("email_address", "PII", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", guard="(?i)no-?reply@|^donotreply"),
    Rule("ip_address", "PII", "medium", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", check="ipv4"),
    Rule("phone_number", "PII", "medium", r"\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{3,4}[ -]?[0-9]{4}", guard="(?i)toll[- ]free|hotline"),
    Rule("payment_card", "PII", "high", r"[0-9]{13,19}", check="luhn"),
    Rule("external_secret_hex", "PII", "high", r"[0-9a-f]{32,64}", check="entropy"),
]
#: Identifiers that need their field's name before them, by jurisdiction pack.
FIELD_IDENTIFIERS = [
    Rule("sg_nric_fin", "PII", "high", r"[STFGM][0-9]{7}[A-Z]", pack="SG", guard=_PLACEHOLDER, check="nric"),
    Rule("sg_uen", "PII", "high", r"UEN[ \t:.#-]*([0-9]{8,9}[A-Z])", cap=True, pack="SG"),
    Rule("sg_postal_address", "PII", "medium", rf"Singapore{_S}([0-9]{{6}})", cap=True, pack="SG"),
    Rule("us_ssn", "PII", "high", rf"SSN{_SEP}([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})", cap=True, pack="US", check="us_ssn"),
    Rule("us_ein", "PII", "medium", rf"EIN{_SEP}([0-9]{{2}}-[0-9]{{7}})", cap=True, pack="US"),
    Rule("au_tfn", "PII", "high", rf"TFN{_SEP}([0-9]{{9}})", cap=True, pack="AU", check="au_tfn"),
    Rule("au_abn", "PII", "medium", rf"ABN{_SEP}([0-9]{{11}})", cap=True, pack="AU", check="au_abn"),
    Rule("cn_resident_id", "PII", "high", rf"Resident ID{_SEP}([0-9]{{17}}[0-9Xx])", cap=True, pack="CN", check="cn_resident_id"),
    Rule("in_pan", "PII", "high", rf"PAN{_SEP}([A-Z]{{3}}[PCHFATBLJG][A-Z][0-9]{{4}}[A-Z])", cap=True, pack="IN"),
    Rule("passport_number", "PII", "high", rf"(?i:passport){_SEP}([A-Z][0-9]{{6,11}})", cap=True, guard=_PLACEHOLDER),
    Rule("bank_account", "PII", "high", rf"(?i:account{_S}no\.?)[ \t]*[:#-][ \t]*([0-9][0-9-]{{5,20}}[0-9])", cap=True, guard=_PLACEHOLDER),
    Rule("employee_id", "PII", "medium", rf"(?i:employee{_S}(?:id|no\.?|number)){_SEP}([A-Z]+[0-9][A-Z0-9-]{{2,10}})", cap=True),
    Rule("customer_account_number", "PII", "medium", rf"(?i:customer{_S}(?:account|id|reference)){_SEP}([A-Z]+[0-9][A-Z0-9-]{{2,14}})", cap=True),
    Rule("medical_record_number", "PII", "high", r"MRN[ \t:.#-]*([0-9]{6,12})", cap=True),
    Rule("date_of_birth", "PII", "high", r"(?i:date of birth|DOB)[ \t:]*([0-9]{4}-[0-9]{2}-[0-9]{2})", cap=True, check="iso_date"),
    Rule("age_reference", "PII", "medium", r"(?i:aged?)[ \t:]+([0-9]{1,3})", cap=True, check="adult_age"),
    Rule("imei", "PII", "high", r"IMEI[ \t:.#-]*([0-9]{15})", cap=True, check="luhn"),
    Rule("mac_address", "PII", "medium", r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}", guard="(?i)not a mac address"),
]
PERSONS = [Rule("named_person", "PII", "low", rf"(?:Mr|Ms|Mrs|Mdm|Dr|Prof)\.?{_S}[A-Z][a-z]+(?:{_S}[A-Z][a-z]+){{0,5}}")]
_MARKERS = vocabulary.markers(Rule)
PRIVACY_EVENTS = [r for r in _MARKERS if r.category == "PII"]
_INSIDE = [r for r in _MARKERS if r.category == "MNPI" and r.severity == "high"]
MNPI = [
    _INSIDE[0],
    Rule("transaction_codename", "MNPI", "high", rf"(?i:Project){_S}[A-Z][A-Za-z]+(?:{_S}[A-Z][A-Za-z]+){{0,2}}", guard="(?i)project code"),
    *_INSIDE[1:],
    Rule("contract_unit_price", "MNPI", "medium", r"(?i:unit price|price per (?:share|unit))[ \t]*(?:is|of|:)?[ \t]*(?:SGD|USD)[ \t]*[0-9][0-9,]*(?:\.[0-9]{1,4})?"),
    Rule("contract_discount_rate", "MNPI", "medium", r"(?i:discount|rebate)[ \t]*(?i:rate)?[ \t]*(?:is|of|:)?[ \t]*[0-9]{1,2}(?:\.[0-9]+)?%"),
    Rule("volume_commitment", "MNPI", "medium", r"(?i:volume commitment)[ \t]*(?:is|of|:)?[ \t]*[0-9]{1,3}(?:,[0-9]{3})+[ \t]*(?:units|seats|tonnes)"),
    Rule("royalty_rate", "MNPI", "medium", r"(?i:royalty rate)[ \t]*(?:is|of|:)?[ \t]*[0-9]{1,2}(?:\.[0-9]+)?%"),
    Rule("total_contract_value", "MNPI", "medium", r"(?i:(?:total|aggregate) contract value)[ \t]*(?:is|of|:)?[ \t]*(?:SGD|USD)[ \t]*[0-9][0-9,]*(?:\.[0-9]{1,2})?"),
    Rule("financial_amount", "MNPI", "medium", r"(?:SGD|USD|\$)[ \t]*[0-9][0-9,]*(?:\.[0-9]+)?(?:[ \t]*(?i:million|billion|[KMBT]))?"),
    Rule("financial_percentage", "MNPI", "medium", r"[0-9]+(?:\.[0-9]+)?%"),
    Rule("large_number", "MNPI", "medium", r"[0-9]{1,3}(?:,[0-9]{3}){2,}"),
]
#: Weak alone; a trigger nearby makes them medium.
PROXIMITY = [r for r in _MARKERS if r.category == "MNPI" and r.severity == "low"]
ALL = [*IDENTIFIERS, *FIELD_IDENTIFIERS, *PERSONS, *PRIVACY_EVENTS, *MNPI, *PROXIMITY]
#: What each rule of the registry is worth, and the rules that lift PROXIMITY.
SEVERITY_SCORE = {"low": 25.0, "medium": 55.0, "high": 85.0}
TRIGGERS = ["transaction_codename", "definitive_agreement", "material_adverse_change", "material_event", "embargo_marker", "nonpublic_marker"]
#: Identifiers that a phone number inside them gives way to, and those that a person named in the document makes high.
OVER_PHONE = ["payment_card", "external_secret_hex", "ip_address", *(r.name for r in FIELD_IDENTIFIERS)]
LINKED_IDS = ["employee_id", "customer_account_number", "medical_record_number", "mac_address", "ip_address", "age_reference"]
#: Severity by (rule, document type), fixed values.
SEVERITY_OVERRIDES = {
    **{("transaction_codename", t): "medium" for t in ("generic", "casual", "chat", "email_casual")},
    **{(r, t): "medium" for r in ("definitive_agreement", "material_adverse_change") for t in ("generic", "casual", "chat")},
    **{(r, t): "high" for r in ("transaction_codename", "embargo_marker") for t in ("memo", "research_note", "external_memo")},
}
#: Keywords of material events, and lines in which they are negated or public.
EVENT_WORDS = vocabulary.either(vocabulary.events())
EVENT_NEGATED = "(?i)not price[- ]sensitive|no event has occurred|policy guidance|operational guidance"
EVENT_PUBLIC = "(?i)publicly (?:announced|available)|press release|previously announced|is public"


def registry(spark: SparkSession) -> DataFrame:
    """The rules as a table; it has a row for each rule of the code, so it may be broadcast."""
    rows = [(k, r.name, r.category, r.severity, SEVERITY_SCORE[r.severity], r.pack, r.expression) for k, r in enumerate(ALL)]
    return spark.createDataFrame(rows, "rule_ord int, rule string, category string, severity string, score double, pack string, pattern string")

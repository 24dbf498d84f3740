"""Driver's licences of American states: names and codes of states, and the formats of their numbers, as their motor-vehicle agencies publish them."""

from __future__ import annotations

# A state's code, name and the format of its numbers.
STATES = [
    ("AL", "Alabama", "[0-9]{7,8}"), ("AK", "Alaska", "[0-9]{7}"), ("AZ", "Arizona", "[A-Z][0-9]{8}|[0-9]{9}"), ("AR", "Arkansas", "[0-9]{4,9}"), ("CA", "California", "[A-Z][0-9]{7}"),
    ("CO", "Colorado", "[0-9]{9}|[A-Z][0-9]{3,6}"), ("CT", "Connecticut", "[0-9]{9}"), ("DE", "Delaware", "[0-9]{1,7}"), ("FL", "Florida", "[A-Z][0-9]{12}"), ("GA", "Georgia", "[0-9]{7,9}"),
    ("HI", "Hawaii", "[A-Z][0-9]{8}|[0-9]{9}"), ("ID", "Idaho", "[A-Z]{2}[0-9]{6}[A-Z]|[0-9]{9}"), ("IL", "Illinois", "[A-Z][0-9]{11,12}"), ("IN", "Indiana", "[A-Z][0-9]{9}|[0-9]{9,10}"),
    ("IA", "Iowa", "[0-9]{3}[A-Z]{2}[0-9]{4}|[0-9]{9}"), ("KS", "Kansas", "[A-Z][0-9]{8}|[0-9]{9}"), ("KY", "Kentucky", "[A-Z][0-9]{8}|[0-9]{9}"), ("LA", "Louisiana", "[0-9]{1,9}"),
    ("ME", "Maine", "[0-9]{7,8}"), ("MD", "Maryland", "[A-Z][0-9]{12}"), ("MA", "Massachusetts", "[A-Z][0-9]{8}|[0-9]{9}"), ("MI", "Michigan", "[A-Z][0-9]{12}"), ("MN", "Minnesota", "[A-Z][0-9]{12}"),
    ("MS", "Mississippi", "[0-9]{9}"), ("MO", "Missouri", "[A-Z][0-9]{5,9}|[0-9]{9}"), ("MT", "Montana", "[0-9]{13}|[0-9]{9}"), ("NE", "Nebraska", "[A-Z][0-9]{6,8}"),
    ("NV", "Nevada", "[0-9]{9,10}|X[0-9]{8}"), ("NH", "New Hampshire", "[0-9]{2}[A-Z]{3}[0-9]{5}"), ("NJ", "New Jersey", "[A-Z][0-9]{14}"), ("NM", "New Mexico", "[0-9]{8,9}"),
    ("NY", "New York", "[0-9]{9}|[A-Z][0-9]{7}"), ("NC", "North Carolina", "[0-9]{1,12}"), ("ND", "North Dakota", "[A-Z]{3}[0-9]{6}|[0-9]{9}"), ("OH", "Ohio", "[A-Z]{2}[0-9]{6}|[0-9]{8}"),
    ("OK", "Oklahoma", "[A-Z][0-9]{9}|[0-9]{9}"), ("OR", "Oregon", "[0-9]{1,9}"), ("PA", "Pennsylvania", "[0-9]{8}"), ("RI", "Rhode Island", "[0-9]{7}|V[0-9]{6}"), ("SC", "South Carolina", "[0-9]{5,11}"),
    ("SD", "South Dakota", "[0-9]{6,10}|[0-9]{12}"), ("TN", "Tennessee", "[0-9]{7,9}"), ("TX", "Texas", "[0-9]{7,8}"), ("UT", "Utah", "[0-9]{4,10}"), ("VT", "Vermont", "[0-9]{8}|[0-9]{7}A"),
    ("VA", "Virginia", "[A-Z][0-9]{8,11}|[0-9]{9}"), ("WA", "Washington", "[A-Z0-9*]{12}"), ("WV", "West Virginia", "[A-Z][0-9]{6}|[0-9]{7}"), ("WI", "Wisconsin", "[A-Z][0-9]{13}"),
    ("WY", "Wyoming", "[0-9]{9,10}"),
]
# Names of the field, and of the field that tells the state.
LABELS = [
    "driver's license", "driver's licence", "drivers license", "drivers licence", "driver license", "driver licence", "driver license number", "driver licence number", "DLN", "DL#", "DL #", "D/L",
    "license no", "license no.", "license number", "licence no", "licence no.", "licence number",
]
STATE_LABELS = ["state", "issuing state", "state of issue", "issuer"]

#: Characters around a field in which its state may be told, and in which a name of no state counts as one that isn't supported.
REACH, SHORT_REACH = 90, 40
#: What stands between the field's name and its number, the number, and what follows it; the state right before the name, a state's field, and two capitals right before.
SIGN, NUMBER, BEHIND = r"^(?i:\s*(?:number)?\s*[:#=-]?\s*)", "[A-Za-z0-9*][A-Za-z0-9*-]{3,19}", r"(?:[\s.,;:)]|$)"
_ANY = "|".join(x.replace(" ", r"\s+") for code, name, _ in STATES for x in (code, name))
BEFORE = rf"\b((?i:{_ANY}))\s+$"
TOLD = r"(?i:\b(?:issuing\s+state|state\s+of\s+issue|state|issuer)\s*[:=]?\s*)([A-Za-z]+(?:\s+[A-Za-z]+)?)\b"
CAPITALS = r"\b([A-Z]{2})\s*$"
MASKED = r"\*{2,}|X{3,}|x{3,}"
#: What becomes of a field whose number isn't reported, with the confidence that it is a licence; fixed values.
WARNINGS = {"masked": 0.68, "missing_state": 0.70, "unsupported_state": 0.72}

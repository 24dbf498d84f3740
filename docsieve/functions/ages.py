"""What tells that a person is a minor: ages, grades of schools, and phrases; and the age below which each jurisdiction protects its own."""

from __future__ import annotations

from docsieve.functions.vocabulary import written_out

# Ages of consent or childhood by pack.
CLIFFS = {
    "IN": 18, "SG": 18, "UK": 18, "AU": 18, "HK": 18, "AE": 18, "SA": 18, "BR": 18, "EU": 16, "CN": 14, "US": 13, "SEA": 18, "MY": 18, "ID": 18, "TH": 18, "PH": 18, "VN": 18, "JP": 18, "KR": 18,
}
#: A grade's name, and the years that turn it into an age.
GRADES = [("primary", 6), ("secondary", 12), ("year", 4), ("grade", 5)]
#: Ages that are still a young person's; an explicit age above isn't reported.
MOST_AGE = 19
#: How an age or a grade is told: a pattern and the name of its grade ("" for an age). The number is the only one in it.
TOLD = [
    (r"(?i)\b(?:aged?|ages)\s*[:=]?\s*[0-9]{1,2}\b", ""),
    (r"(?i)\b[0-9]{1,2}(?:[- ]year[- ]old|\s+years?\s+old)\b", ""),
    (r"(?i)\b(?:under|below|younger\s+than)\s+(?:1[0-8]|[1-9])(?:\s+years?\s+(?:of\s+age|old)\b|[,.)\];])", ""),
    (r"(?i)\bprimary\s+[1-6]\b", "primary"),
    (r"(?i)\bsecondary\s+[1-6]\b", "secondary"),
    (r"(?i)\byear\s+(?:1[0-3]|[1-9])\s+(?:student|pupil|class)\b", "year"),
    (r"(?i)\b[0-9]{1,2}(?:st|nd|rd|th)\s+grade\b", "grade"),
]
_YOUNG = ["minor", "minors", "child", "children", "juvenile", "juveniles", "underage user", "underage users"]
#: Phrases that tell it without an age; fixed values, templates as in functions.vocabulary.
PHRASES = written_out([
    {"of": "{who} {what}", "who": ["minor", "minor's", "child", "child's", "children", "children's", "juvenile", "juvenile's", "underage", "ward", "ward's"], "what": ["personal data", "data", "information", "profile", "account", "consent", "details"]},
    {"of": "{what} of {a} {who}", "what": ["personal data", "data", "information", "account", "profile"], "a": ["", "a", "the"], "who": [*_YOUNG, "underage customer", "underage customers", "underage individual", "underage individuals"]},
    {"of": "{who} {what}", "who": ["child", "child's", "children", "children's", "minor", "minor's", "minors", "underage user", "underage users"], "what": ["online activity", "location data", "photo", "photos", "video", "videos"]},
    {"of": "{what} of {who}", "what": ["online activity", "location data", "photo", "photos", "video", "videos"], "who": _YOUNG},
    {"of": "{what} {for} {who}", "what": ["age assurance", "age gating", "age-gating", "age verification"], "for": ["for", "of"], "who": [*_YOUNG, "under 18", "under-18", "under 18s", "under-18s", "online service users"]},
    {"of": "{what} of {who}", "what": ["behavioral monitoring", "behavioural monitoring", "tracking"], "who": _YOUNG},
    {"of": "targeted {what} {to} {who}", "what": ["advertising", "advertisement", "advertisements"], "to": ["to", "at", "for", "directed at"], "who": _YOUNG},
    {"of": "{school} {who}", "school": ["kindergarten", "nursery", "preschool", "playgroup", "elementary school", "middle school", "junior high", "high school"], "who": ["student", "pupil", "class", "enrolment", "enrollment", "register", "roster"]},
    "verifiable parental consent", "VPC", "parental consent", "guardian consent", "guardian's consent", "in loco parentis",
    {"of": "consent of {a} parent {or}", "a": ["", "a", "the"], "or": ["", "or guardian"]},
])
#: What follows or goes before a number that is none of a person.
NOT_AFTER = r"(?i)^\s*(?:\+|of\s+(?:experience|service|industry|tenure|the\s+(?:contract|agreement|term|lease|policy|grade)))"
NOT_BEFORE = r"(?i)\b(?:grade|category|level|class|rating|tier)\s*$"
AFTER, BEFORE = 40, 12

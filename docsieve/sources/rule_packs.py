"""Rule packs: files of fields and patterns, read when a review begins, so that rules change without a release.

A pack is a JSON object: code, label, aliases, and lists of entries. An entry of `fields` has rule, severity, labels (what the field is called) and shape (of its value); of
`patterns` rule, severity and pattern; of `secrets` rule, severity, keywords, pattern and optionally entropy (least bits a character) and allow (expressions of values that are none).
A name may be a template (functions.vocabulary).
Packs of later folders replace those of earlier ones with the same code. An entry that lacks something, or whose expression or check isn't known, is left out and reported; a file that
isn't a pack is reported too, and nothing else fails.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from docsieve.functions import checks, rules, vocabulary

#: The packs that come with the library.
OWN = Path(__file__).resolve().parent.parent / "packs"
#: What may stand between a field's name and its value, unless an entry says otherwise.
SIGN = r"[\s:.#-]*"
_NEEDS = {"fields": ("rule", "severity", "labels", "shape"), "patterns": ("rule", "severity", "pattern"), "secrets": ("rule", "severity", "keywords", "pattern")}


@dataclass(frozen=True)
class Field:
    """A value behind a field's name. whole: the finding begins with the name; end: what follows the value; unless: lines that suppress it; nocase: letters of either case."""

    rule: str
    severity: str
    pack: str
    labels: tuple[str, ...]
    shape: str
    sign: str = SIGN
    end: str = r"\b"
    check: str = ""
    unless: str = ""
    whole: bool = False
    nocase: bool = True

    def pattern(self, group: str = "(") -> str:
        """From the name's end on: the sign, and the value as a group."""
        return f"^{self.sign}{group}{'(?i:' if self.nocase else '(?:'}{self.shape}))"


@dataclass(frozen=True)
class Secret:
    """A value near one of its keywords; of the pattern's matches, those that vary enough and fit none of the allowed expressions."""

    rule: str
    severity: str
    pack: str
    keywords: tuple[str, ...]
    pattern: str
    entropy: float = 0.0
    allow: tuple[str, ...] = ()


@dataclass
class Packs:
    """What the packs hold, packs by code with their aliases, and the entries left out: (source, entry, reason)."""

    fields: list[Field] = field(default_factory=list)
    patterns: list[rules.Rule] = field(default_factory=list)
    secrets: list[Secret] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    problems: list[tuple[str, str, str]] = field(default_factory=list)

    def of(self, *codes: str) -> Packs:
        """Only these packs."""
        own = set(codes)
        return Packs([x for x in self.fields if x.pack in own], [x for x in self.patterns if x.pack in own], [x for x in self.secrets if x.pack in own], {k: c for k, c in self.aliases.items() if c in own}, self.problems)


def _wrong(kind: str, entry: object) -> str:
    """Why an entry can't be used; empty if it can."""
    if not isinstance(entry, dict):
        return "not an object"
    missing = [k for k in _NEEDS[kind] if not entry.get(k)]
    if missing:
        return f"without {', '.join(missing)}"
    if entry["severity"] not in rules.SEVERITY_SCORE:
        return f"severity {entry['severity']}"
    if entry.get("check", "") not in {"", *checks.CHECKS}:
        return f"check {entry['check']}"
    texts = entry.get("labels") or entry.get("keywords") or ["x"]
    try:
        texts = vocabulary.written_out(texts)
    except (TypeError, KeyError, AttributeError):
        return "names that aren't texts"
    if not all(isinstance(x, str) and x.strip() for x in texts):
        return "names that aren't texts"
    for name in ("shape", "pattern", "sign", "end", "unless"):
        try:
            re.compile(entry.get(name) or "")
        except (re.error, TypeError) as error:
            return f"{name}: {error}"
    return ""


def parse(sources: list[tuple[str, str]]) -> Packs:
    """The packs of (name, content) files, later ones replacing earlier ones of the same code."""
    bodies, out = {}, Packs()
    for name, content in sources:
        try:
            body = json.loads(content)
            code = body["code"].upper()
        except (ValueError, TypeError, KeyError, AttributeError) as error:
            out.problems.append((name, "", f"not a pack: {type(error).__name__}"))
            continue
        bodies.pop(code, None)
        bodies[code] = (name, body)
    for code, (name, body) in bodies.items():
        out.aliases |= {str(a).upper(): code for a in [*(body.get("aliases") or []), code]}
        for kind in _NEEDS:
            for entry in body.get(kind) or []:
                reason = _wrong(kind, entry)
                if reason:
                    out.problems.append((name, str(entry.get("rule", "")) if isinstance(entry, dict) else "", reason))
                elif kind == "fields":
                    rest = {k: entry[k] for k in ("sign", "end", "check", "unless", "whole", "nocase") if k in entry}
                    out.fields.append(Field(entry["rule"], entry["severity"], code, tuple(vocabulary.written_out(entry["labels"])), entry["shape"], **rest))
                elif kind == "patterns":
                    out.patterns.append(rules.Rule(entry["rule"], "PII", entry["severity"], entry["pattern"], pack=code, check=entry.get("check", "")))
                else:
                    out.secrets.append(Secret(entry["rule"], entry["severity"], code, tuple(vocabulary.written_out(entry["keywords"])), entry["pattern"], float(entry.get("entropy", 0)), tuple(entry.get("allow", []))))
    return out


def load(spark: SparkSession | None = None, *folders: str) -> Packs:
    """The library's own packs and those of more folders, in any store that Spark reads; files of a folder in the order of their names."""
    sources = [(p.name, p.read_text(encoding="utf-8")) for p in sorted(OWN.glob("*.json"))]
    for folder in folders:
        rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).selectExpr("input_file_name() AS name", "value").collect()  # files of rules, not data
        sources += sorted((r["name"], r["value"]) for r in rows)
    return parse(sources)

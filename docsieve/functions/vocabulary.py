"""Phrases: templates written out, one expression for many phrases, and the markers that come with the library."""

from __future__ import annotations

import functools
import itertools
import json
import re
from pathlib import Path

_RUN, _WORD = re.compile(r"\s+"), re.compile(r"\w")
_FILE = Path(__file__).resolve().parent.parent / "packs" / "markers.json"


def written_out(phrases: list) -> list[str]:
    """Phrases, with those of each template: an object whose other lists are put into its `of`, every one with every other."""
    out = []
    for x in phrases:
        if isinstance(x, dict):
            names = [k for k in x if k != "of"]
            for values in itertools.product(*(x[k] for k in names)):
                out.append(_RUN.sub(" ", functools.reduce(lambda s, kv: s.replace("{" + kv[0] + "}", kv[1]), zip(names, values, strict=True), x["of"])).strip())
        else:
            out.append(x)
    return list(dict.fromkeys(out))


def normal(phrase: str) -> str:
    """One blank for each run of white space, Latin capitals as small letters."""
    return _RUN.sub(" ", phrase.strip()).translate(LOWER)


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edge(char: str) -> bool:
    """Whether a phrase's first or last character asks for the end of a word: Latin letters and digits do, scripts that write words together don't."""
    return char.isascii() and bool(_WORD.match(char))


def either(phrases: list[str]) -> str:
    """One expression for phrases, of engines that take the first alternative that fits: longer phrases come first."""

    def one(word: str) -> str:
        body = r"\s+".join(map(re.escape, word.split(" ")))
        return (r"\b" if edge(word[0]) else "") + body + (r"\b" if edge(word[-1]) else "")

    return "(?i:" + "|".join(one(p) for p in sorted({normal(p) for p in phrases if normal(p)}, key=lambda x: (-len(x), x))) + ")"


def tree(phrases: list[str]) -> str:
    """either() with the phrases' common beginnings written once: the same matches, but an engine that tries one alternative after the other reads a place once and not once a phrase."""
    top: dict = {}
    for phrase in sorted({normal(p) for p in phrases if normal(p)}):
        node = top
        for char in phrase:
            node = node.setdefault(char, {})
        node[""] = {}

    def below(node: dict, last: str) -> str:
        # Longer phrases come before the one that ends here.
        parts = [step(c, child) for c, child in node.items() if c]
        if "" in node:
            parts.append(r"\b" if edge(last) else "")
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    def step(char: str, child: dict) -> str:
        return (r"\s+" if char == " " else re.escape(char)) + below(child, char)

    return "(?i:" + "|".join((r"\b" if edge(c) else "") + step(c, child) for c, child in top.items()) + ")"


@functools.cache
def _body() -> dict:
    return json.loads(_FILE.read_text(encoding="utf-8"))


def events() -> list[str]:
    """Keywords of material events."""
    return written_out(_body()["events"])


def markers(kind: type) -> list:
    """The markers as rules, in the order of the file: those with phrases, and those with a pattern."""
    fields = ("category", "severity", "pack", "negated")
    return [kind(name=m["rule"], pattern=m.get("pattern", ""), phrases=tuple(written_out(m.get("phrases", []))), **{k: m[k] for k in fields if k in m}) for m in _body()["markers"]]

"""Small configuration files, read by the driver: stop lists, taxonomies, phrase dictionaries, lexicons, rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:
    yaml = None

FACT = re.compile(r"\s*([^\s(]+)\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)")


def load_yaml(path: str) -> dict:
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    return yaml.safe_load(Path(path).read_text()) or {}


def stoplist(path: str) -> list[str]:
    return [str(t) for t in load_yaml(path).get("terms") or []]


def blacklist(path: str | None) -> set[str]:
    """Lower-cased terms; nothing where the file can't be read."""
    try:
        return {t.lower() for t in stoplist(path)} if path else set()
    except (OSError, RuntimeError, AttributeError):
        return set()


def taxonomy(path: str) -> dict:
    raw = load_yaml(path)
    return {k: raw.get(k) or {} for k in ("sectors", "events", "regions", "entities")}


def dictionary(lines: Iterable[str]) -> list[tuple[str, list[str], str]]:
    """(canonical, variants, category) of canonical|variant|...|category lines; # begins a comment, short lines go."""
    out = []
    for line in lines:
        line = line.strip()
        parts = [p.strip() for p in line.split("|")]
        if line and not line.startswith("#") and len(parts) >= 2:
            out.append((parts[0], [p for p in parts[1:-1] if p], parts[-1]))
    return out


def rules(lines: Iterable[str]) -> list[tuple[str, str, str]]:
    """(relation, subject, object) of rel(subject, object) lines; what follows the first ) is ignored."""
    out: list[tuple[str, str, str]] = []
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = FACT.match(line)
        if not m:
            raise ValueError(f"line {n}: not a fact: {line.strip()!r}")
        if m.groups() not in out:
            out.append(m.groups())
    return out


class Lexicon:
    """Synonyms: the canonical form of a word, its variants, and words linked to it in context."""

    def __init__(self, groups: Iterable[tuple[str, Iterable[str]]] = ()):
        self.groups: dict[str, list[str]] = {}
        self.canonical: dict[str, str] = {}
        self.linked: dict[str, dict[str, tuple[float, int]]] = {}
        for c, vs in groups:
            self.add(c, vs)

    @classmethod
    def load(cls, path: str) -> "Lexicon":
        return cls((g["canonical"], g.get("variants") or []) for g in load_yaml(path).get("synonyms") or [])

    def add(self, canonical: str, variants: Iterable[str]) -> None:
        c = canonical.lower()
        for old in self.groups.pop(c, []):
            self.canonical.pop(old, None)
        self.groups[c] = list(dict.fromkeys([c, *(v.lower() for v in variants)]))
        self.canonical |= {v: c for v in self.groups[c]}

    def normalize(self, token: str) -> str:
        return self.canonical.get(token.lower(), token)

    def variants(self, canonical: str) -> list[str]:
        return self.groups.get(canonical.lower(), [])

    def link(self, token: str, related: str, score: float, support: int) -> None:
        held = self.linked.setdefault(token, {})
        if (score, support) > held.get(related, (float("-inf"), 0)):
            held[related] = score, support

    def stats(self) -> tuple[int, int]:
        return len(self.groups), len(self.canonical)


@dataclass
class Components:
    stops: list[str] = field(default_factory=list)
    taxonomy: dict = field(default_factory=dict)
    phrases: list[tuple[str, list[str], str]] = field(default_factory=list)
    lexicon: Lexicon = field(default_factory=Lexicon)
    rules_path: str | None = None


def load(stops: str | None = None, taxonomies: str | None = None, phrases: str | None = None, lexicon: str | None = None, rules_path: str | None = None) -> Components:
    """Every path is optional; what has none is empty."""
    return Components(stoplist(stops) if stops else [], taxonomy(taxonomies) if taxonomies else {}, dictionary(Path(phrases).read_text().splitlines()) if phrases else [], Lexicon.load(lexicon) if lexicon else Lexicon(), rules_path)


def facts(spark: SparkSession, found: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(found), "relation string, subject string, object string")

"""The query language: words, "phrases", -exclusions, ``ext:``/``.ext`` and ``path:`` filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_QUOTED = re.compile(r'(-?)"([^"]*)"')


@dataclass(frozen=True)
class Query:
    text: str = ""
    phrases: list[str] = field(default_factory=list)
    excluded_phrases: list[str] = field(default_factory=list)
    excluded_terms: list[str] = field(default_factory=list)
    ext: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    excluded_paths: list[str] = field(default_factory=list)


def parse_query(raw: str) -> Query:
    """Quotes are taken out first; phrases are ranked like words, after them."""
    query, words = Query(), []
    for minus, quoted in _QUOTED.findall(raw):
        if phrase := quoted.strip():
            (query.excluded_phrases if minus else query.phrases).append(phrase)
    for word in _QUOTED.sub(" ", raw).split():
        low = word.lower()
        name, colon, value = low.partition(":")
        if colon and name in ("path", "-path", "ext"):
            value = value.removeprefix(".") if name == "ext" else value
            target = {"path": query.paths, "-path": query.excluded_paths, "ext": query.ext}[name]
            target += [value] if value else []
        elif re.fullmatch(r"\.[a-z0-9]+", low) and low.isascii():
            query.ext.append(low[1:])
        elif len(word) > 1 and word[0] == "-":
            query.excluded_terms.append(word[1:])
        else:
            words.append(word)
    text = " ".join([*words, *query.phrases]).strip()
    return Query(text, query.phrases, query.excluded_phrases, query.excluded_terms, query.ext, query.paths, query.excluded_paths)


@dataclass(frozen=True)
class Fuzzy:
    """``in_bytes``: edits are counted in bytes of UTF-8, as DuckDB's ``levenshtein`` does, not in characters."""

    fuzziness: float = 0.1
    min_length: int = 4
    prefix_min: int = 2
    in_bytes: bool = False


@dataclass(frozen=True)
class Settings:
    """Options of an engine, and their hash, which a saved index must match."""

    split_camel_case: bool = False
    respect_excluded: bool = True
    extra_file_types: tuple[str, ...] = ()
    index_pdf: bool = False
    index_images: bool = False
    index_office: bool = False
    use_cache: bool = True
    show_excerpts: bool = True
    limit: int = 50
    fuzzy: Fuzzy = field(default_factory=Fuzzy)

    def options_hash(self, version: int = 1) -> str:
        return f"{version}|{'camel' if self.split_camel_case else 'nocamel'}"


def extra_types(raw: str) -> tuple[str, ...]:
    """A comma- or space-separated list of extensions, trimmed, without dots, in lower case."""
    return tuple(t for p in re.split(r"[,\s]+", raw) if (t := p.strip().lstrip(".").lower()))

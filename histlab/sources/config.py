"""Configuration files: sections, continuation lines, includes, typed values."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

MAX_INCLUDES, MAX_INCLUDE_BYTES = 8, 10 << 20
TRUE, FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


@dataclass
class Entry:
    section: str
    key: str
    raw: str
    text: str
    kind: str  # string, int, float, bool, array
    line: int

    @property
    def value(self):
        return {"bool": lambda t: t.lower() in TRUE, "int": int, "float": float, "array": lambda t: t.split(","), "string": str}[self.kind](self.text)


@dataclass
class Rule:
    """What a schema says of a key."""

    section: str
    key: str
    kind: str = "string"
    required: bool = False
    default: str | None = None
    low: int | None = None
    high: int | None = None
    choices: tuple[str, ...] = ()


def kind_of(text: str) -> str:
    if not text:
        return "string"
    if text.lower() in TRUE + FALSE:
        return "bool"
    if "," in text and " " not in text:
        return "array"
    if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", text):
        return "float" if "." in text else "int"
    return "string"


def expand_env(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} becomes the variable, or nothing where there is none."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([^}]*)\}", lambda m: env.get(m[1], ""), text)


@dataclass
class Config:
    entries: list[Entry] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)

    def find(self, section: str, key: str) -> Entry | None:
        """The first entry of that name."""
        return next((e for e in self.entries if e.section.lower() == section.lower() and e.key.lower() == key.lower()), None)

    def get(self, section: str, key: str, default=None):
        entry = self.find(section, key)
        return default if entry is None else entry.value

    def get_string(self, section: str, key: str, default: str = "") -> str:
        entry = self.find(section, key)
        return default if entry is None else entry.text

    def validate(self, rules: list[Rule]) -> list[str]:
        """What is wrong by the schema."""
        out = []
        for r in rules:
            e = self.find(r.section, r.key)
            name = f"{r.section}.{r.key}"
            if e is None:
                if r.required:
                    out.append(f"{name} is missing")
                continue
            if r.kind != "string" and e.kind != r.kind and not (r.kind == "float" and e.kind == "int"):
                out.append(f"{name} is {e.kind}, not {r.kind}")
                continue
            if r.kind == "int" and not ((r.low is None or e.value >= r.low) and (r.high is None or e.value <= r.high)):
                out.append(f"{name} is out of range")
            if r.choices and e.text not in r.choices:
                out.append(f"{name} is none of {', '.join(r.choices)}")
        return out

    def apply_defaults(self, rules: list[Rule]) -> Config:
        for r in rules:
            if r.default is not None and self.find(r.section, r.key) is None:
                self.entries.append(Entry(r.section, r.key, r.default, r.default, kind_of(r.default), 0))
        return self


def _value(text: str) -> str:
    """Without a comment that stands outside of quotes, and without quotes around."""
    text, quoted, end = text.strip(), False, None
    for i, c in enumerate(text):
        if c in "\"'":
            quoted = not quoted
        elif c in "#;" and not quoted:
            end = i
            break
    text = text[:end].strip()
    return _unquoted(text)


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def parse(text: str, env: Mapping[str, str] | None = None, config: Config | None = None, section: str = "") -> Config:
    config = config or Config()
    held: str | None = None
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        whole = line if held is None else held + line
        if whole.endswith("\\"):
            held = whole[:-1] + " "
            continue
        held = None
        whole = whole.strip()
        if not whole or whole[0] in "#;":
            continue
        if whole.startswith("@include"):
            path = _unquoted(whole[8:].strip())
            if path and path not in config.includes and len(config.includes) < MAX_INCLUDES:
                config.includes.append(path)
                found = Path(path)
                if found.is_file() and 0 < found.stat().st_size < MAX_INCLUDE_BYTES:
                    parse(found.read_text("utf-8", "replace"), env, config, section)
        elif whole[0] == "[":
            if "]" in whole:
                section = whole[1 : whole.index("]")].strip()
                if section not in config.sections:
                    config.sections.append(section)
        elif "=" in whole:
            key, value = whole.split("=", 1)
            raw = _value(value)
            expanded = expand_env(raw, env)
            config.entries.append(Entry(section, key.strip(), raw, expanded, kind_of(expanded), number))
    return config


def load(path: str | Path, env: Mapping[str, str] | None = None) -> Config:
    return parse(Path(path).expanduser().read_text("utf-8", "replace"), env)

"""Configuration: presets, switches, custom terms and patterns, exclusions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from .catalogue import CATEGORIES, LABELS, PATTERNS, PRESETS, Pattern

# The settings that there are, and documents that need no office suite to be read.
_KNOWN = {"preset", "categories", "custom_terms", "exclude_terms", "options", "custom_patterns", "passwords"}
_OPTIONS = {"ocr", "redact_barcodes", "output", "office_converter", "handwriting_ocr", "redact_handwriting", "redact_faces"}
_OUTPUTS = {"images", "documents", "everything", "combine"}
OWN_READERS = {".docx", ".pptx"}


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Config:
    preset: str = "general"
    patterns: tuple[Pattern, ...] = PATTERNS
    exclude: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    passwords: dict = field(default_factory=dict)
    warnings: tuple[str, ...] = ()

    def tabular(self) -> Config:
        """For tables: without the bare run of digits, which there is mostly amounts and order numbers."""
        return Config(self.preset, tuple(p for p in self.patterns if not p.bare), self.exclude, self.options, self.passwords, self.warnings)

    @property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(p.category for p in self.patterns))


def terms(value) -> list[str]:
    """Strings of a nested list or mapping of terms, in order, without those that are blank."""
    found, todo = [], [value]
    while todo:
        item = todo.pop()
        if isinstance(item, (dict, list, tuple)):
            inner = list(item.values()) if isinstance(item, dict) else list(item)
            todo.extend(reversed(inner))
        elif item is not None and (text := str(item).strip()):
            found.append(text)
    return found


def lint(cfg: dict) -> list[str]:
    """A warning for each setting that nothing reads: a slip must not make for less redaction in silence."""
    places = {"setting": (cfg, _KNOWN)}
    options = cfg.get("options")
    if isinstance(options, dict):
        places["option"] = (options, _OPTIONS)
        if isinstance(options.get("output"), dict):
            places["output setting"] = (options["output"], _OUTPUTS)
    return [f"unknown {what}: {key}" for what, (given, known) in places.items() for key in given if key not in known]


def _term(i: int, text: str) -> Pattern:
    words = r"\s+".join(map(re.escape, text.split()))
    return Pattern(f"term_{i}", "custom", rf"(?<!\w){words}(?!\w)", any_case=True)


def _custom(cfg: dict, warnings: list[str]) -> list[Pattern]:
    """Patterns of custom terms and custom patterns; what cannot be used is a warning."""
    given = terms(cfg.get("custom_terms"))
    warnings += [f"custom term too short: {t!r}" for t in given if len(t) < 2]
    out = [_term(i, t) for i, t in enumerate(given) if len(t) >= 2]
    if cfg.get("custom_terms") and not out:
        raise ConfigError("custom_terms holds no usable term")
    for i, item in enumerate(cfg.get("custom_patterns") or []):
        body = item.get("regex") if isinstance(item, dict) else None
        try:
            if body:
                re.compile(body)
                out.append(Pattern(f"pattern_{i}", "custom", body.replace("(?P<", "(?<"), any_case=True))
        except re.error as e:
            warnings.append(f"custom pattern skipped: {item.get('name', body)}: {e}")
    return out


def switches(cfg: dict, preset: str) -> dict[str, str]:
    """Every category with what turns it on or off: preset, on, off or none."""
    given = cfg.get("categories") or {}
    state = {True: "on", False: "off"}
    return {c: state.get(given.get(c), "preset" if c in PRESETS[preset] else "none") for c in CATEGORIES}


def resolve(cfg: dict | None = None, preset: str | None = None, categories: str | None = None) -> Config:
    """The detectors that a configuration and the caller's choice enable; what is unknown is an error."""
    cfg = cfg or {}
    name = preset or cfg.get("preset") or "general"
    if name not in PRESETS:
        raise ConfigError(f"unknown preset: {name}")
    named = [c.strip() for c in categories.split(",") if c.strip()] if categories else list(cfg.get("categories") or {})
    if unknown := sorted(set(named).difference(CATEGORIES)):
        raise ConfigError(f"unknown categories: {', '.join(unknown)}")
    chosen = named if categories else [c for c, why in switches(cfg, name).items() if why in ("preset", "on")]
    warnings = lint(cfg)
    patterns = tuple(p for p in PATTERNS if p.category in chosen) + tuple(_custom(cfg, warnings))
    exclude = tuple(t.lower() for t in terms(cfg.get("exclude_terms")) if len(t) >= 2)
    return Config(name, patterns, exclude, cfg.get("options") or {}, cfg.get("passwords") or {}, tuple(warnings))


#: Fixed value: where a configuration is looked for when none is named.
DEFAULT = "config/redact_config.yaml"


def load(path: str | None = None, root: str = ".") -> dict:
    """A YAML mapping; a missing file or anything but a mapping is an error.

    A relative path is looked for here, then under ``root``. Without a path the
    default one is, and none there means no settings.
    """
    import yaml

    name = path or DEFAULT
    for place in dict.fromkeys((Path(name).expanduser(), Path(root) / name)):
        if place.is_file():
            cfg = yaml.safe_load(place.read_text(encoding="utf-8")) or {}
            break
    else:
        if path:
            raise ConfigError(f"no such configuration: {path}")
        cfg = {}
    if not isinstance(cfg, dict):
        raise ConfigError("a configuration is a mapping")
    return cfg


def check(spark, cfg: dict, preset: str | None = None):
    """What a configuration comes to, as a table of settings and values. Of passwords only how many there are."""
    config = resolve(cfg, preset)
    by = switches(cfg, config.preset)
    rows = [("preset", config.preset), ("categories", ", ".join(config.categories))]
    rows += [("always on", c) for c, why in by.items() if why == "on"] + [("never", c) for c, why in by.items() if why == "off"]
    rows += [("custom term", t) for t in terms(cfg.get("custom_terms"))] + [("exclude term", t) for t in config.exclude]
    rows += [("passwords", str(len(config.passwords))), *(("option", f"{k}={v}") for k, v in config.options.items()), *(("warning", w) for w in config.warnings)]
    return spark.createDataFrame(rows, "setting string, value string")


def converter(extension: str, options: dict | None = None, office: str | None = None) -> str:
    """Which reader a document goes to by options.office_converter: "office" (the path of an office suite) or "own".

    auto takes the suite where there is one. What was asked for and is not
    there is an error, never another converter.
    """
    mode = (options or {}).get("office_converter") or "auto"
    own = extension.lower() in OWN_READERS
    able = {"simple": own, "libreoffice": office is not None, "msoffice": False, "auto": own or office is not None}
    if mode not in able:
        raise ConfigError(f"unknown office_converter: {mode}; one of {', '.join(sorted(able))}")
    if not able[mode]:
        raise ConfigError(f"no reader for {extension} with office_converter {mode}")
    return office if office and mode in ("auto", "libreoffice") else "own"


def listing(spark):
    """Categories with their labels, number of patterns and presets, as a table."""
    rows = [(c, LABELS.get(c, c), sum(p.category == c for p in PATTERNS), [k for k, v in PRESETS.items() if c in v]) for c in CATEGORIES]
    return spark.createDataFrame(rows, "category string, label string, n_patterns int, presets array<string>")


def password(config: Config, name: str, given: str | None = None) -> str | None:
    """The caller's password, else the one configured for a file name. Never a column."""
    return given or config.passwords.get(name)

"""Configuration of a collection of notes: the validation schema, folders, and limits."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

# The defaults of the validation schema.
TYPES = ("note", "term", "project", "log", "lesson")
STATUSES = ("active", "done", "archived")
AREAS = ("work", "tech", "life", "career", "learning", "reference", "defense", "prosecutor", "judge")
REQUIRED = ("type", "status", "area", "gist")
FOLDERS = {"notes": "Notes", "projects": "Projects", "archive": "Archive"}
VERSION = 4
_ALIASES = {"typeValues": "types", "statusValues": "statuses", "areaValues": "areas", "maxCount": "max_tags", "requiredFields": "required_fields", "maxTags": "max_tags"}


@dataclass(frozen=True)
class NotesConfig:
    """``field_prefix`` is what frontmatter keys start with; field names elsewhere are without it."""

    field_prefix: str = "note_"
    types: tuple[str, ...] = TYPES
    statuses: tuple[str, ...] = STATUSES
    areas: tuple[str, ...] = AREAS
    required_fields: tuple[str, ...] = REQUIRED
    max_tags: int = 5
    lowercase_tags: bool = True
    hierarchical_tags: bool = False
    folders: dict[str, str] = field(default_factory=lambda: dict(FOLDERS))
    inbox: str = "inbox.md"
    version: int = VERSION

    def requires(self, name: str) -> bool:
        """Whether a field must be there; names count with or without the prefix."""
        return name in {x.removeprefix(self.field_prefix) for x in self.required_fields}

    @classmethod
    def from_dict(cls, raw: dict) -> NotesConfig:
        """A configuration out of a mapping, flat or with ``schema`` and ``tags`` sections; unknown keys are left out and
        versions before the present one are brought up to it."""
        flat: dict = {}
        for key, value in raw.items():
            flat |= value if key in ("schema", "tags") and isinstance(value, dict) else {key: value}
        flat = {_ALIASES.get(k, k): v for k, v in flat.items()}
        names = {f.name for f in fields(cls)}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in names and v is not None}
        kept["folders"] = FOLDERS | dict(kept.get("folders") or {})
        kept["version"] = max(VERSION, int(kept.get("version", VERSION)))
        return cls(**kept)

    @classmethod
    def load(cls, *candidates: str | Path) -> NotesConfig:
        """The first candidate that exists and parses; else the defaults."""
        for path in map(Path, candidates):
            try:
                return cls.from_dict(json.loads(path.read_text(encoding="utf-8")))
            except (OSError, ValueError, TypeError, AttributeError):
                continue
        return cls()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False), encoding="utf-8")

    def with_values(self, **values) -> NotesConfig:
        """This configuration with recommended types or areas taken over."""
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

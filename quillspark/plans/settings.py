"""Settings of the script, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    skip_citations: bool = True
    skip_references: bool = True
    skip_captions: bool = False
    skip_tables: bool = True
    expand_abbreviations: bool = True
    announce_headings: bool = True


def needs_rebuild(old: Settings, new: Settings) -> bool:
    """Whether scripts have to be built anew from their blocks: all settings of this class change the text."""
    return any(getattr(old, f.name) != getattr(new, f.name) for f in fields(Settings))

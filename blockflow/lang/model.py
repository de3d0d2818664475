"""Blocks of a script."""

from __future__ import annotations

from dataclasses import dataclass, field

Value = str | float


@dataclass
class End:
    """A source or sink: kind is connection, global, console, parameter or block."""

    kind: str
    name: str | None = None
    variables: list[str] = field(default_factory=list)
    alias: str | None = None


@dataclass
class Block:
    """kind is query, exec, data, transform, global, connection or test."""

    kind: str
    name: str
    body: str = ""
    extern: str | None = None
    plugin: bool = False
    sources: list[End] = field(default_factory=list)
    sinks: list[End] = field(default_factory=list)
    parameters: list[str] = field(default_factory=list)
    options: dict[str, Value] = field(default_factory=dict)
    after: list[str] = field(default_factory=list)


@dataclass
class Script:
    description: str | None = None
    blocks: list[Block] = field(default_factory=list)
    declared: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)
    settings: dict[str, Value] = field(default_factory=dict)

    def of(self, *kinds: str) -> list[Block]:
        return [b for b in self.blocks if b.kind in kinds]

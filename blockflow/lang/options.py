"""Option look-up: block before connection before script, and in each NAMESPACE_KEY before KEY."""

from __future__ import annotations

from .model import Value


def find(key: str, *scopes: dict[str, Value], namespace: str | None = None) -> Value | None:
    for scope in scopes:
        own = {k.upper(): v for k, v in scope.items()}
        for k in ([f"{namespace}_{key}".upper()] if namespace else []) + [key.upper()]:
            if k in own:
                return own[k]
    return None


def truth(value: Value | None) -> bool:
    """Nonzero numbers and the text 'true' in any case."""
    return value.strip().lower() == "true" if isinstance(value, str) else bool(value)


def names(value: Value | None) -> list[str]:
    return [c.strip() for c in str(value).split(",") if c.strip()] if value else []

"""JSON over HTTP: arrays, or objects under a path; pages by limit and offset."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from .literal import gathered, literal

Transport = Callable[[str, dict[str, str]], str]


def fetch(url: str, headers: dict[str, str]) -> str:
    with urlopen(Request(url, headers=headers), timeout=60) as r:  # noqa: S310
        return r.read().decode("utf-8")


def page_url(url: str, limit: str, offset: str, size: int, page: int) -> str:
    extra = {k: v for k, v in ((limit, size), (offset, page * size)) if k}
    return f"{url}{'&' if '?' in url else '?'}{urlencode(extra)}" if extra and size else url


def rows_of(text: str, columns: list[str], path: str | None) -> list[list]:
    data = json.loads(text)
    for key in (path or "").split("."):
        if key:
            data = data[key]
    out = []
    for r in data:
        if isinstance(r, dict):
            by = {k.lower(): v for k, v in r.items()}
            out.append([by.get(c.lower()) for c in columns])
        else:
            if len(r) != len(columns):
                raise ValueError(f"a row has not {len(columns)} cells")
            out.append(list(r))
    return out


def http_source(spark: SparkSession, url: str, columns: list[str], path: str | None = None, size: int = 0, limit: str = "", offset: str = "", headers: dict[str, str] | None = None, transport: Transport = fetch, form: str = "JSON") -> DataFrame:
    """All pages; without a page size there is one. A key that an object lacks is null."""
    if form.upper() == "CSV":
        return literal(spark, transport(url, headers or {}), "CSV", columns)

    def rows() -> Iterator[list]:
        page = 0
        while True:
            got = rows_of(transport(page_url(url, limit, offset, size, page), headers or {}), columns, path)
            yield from got
            page += 1
            if not size or not got:
                return

    return gathered(spark, rows(), columns)

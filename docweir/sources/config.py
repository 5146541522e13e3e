"""Mapping and preset files: how each label's archives are read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from docweir.operators.articles import ArticleConfig

# Modes, kinds of paging, and fields that a listing must have.
MODES, PAGING, REQUIRED, VERSION = ("html", "json", "rendered"), ("offset", "page", "none"), ("url", "title"), 1


class ConfigError(ValueError):
    """A mapping that cannot be used."""


def _need(ok: bool, where: str, what: str) -> None:
    if not ok:
        raise ConfigError(f"{where}: {what}")


@dataclass(frozen=True)
class Paging:
    type: str = "none"
    page_size: int = 50
    start: int = 0
    max_pages: int = 20


@dataclass(frozen=True)
class Listing:
    mode: str
    url_template: str
    paging: Paging = Paging()
    item_selector: str = ""
    next_page_selector: str = ""
    items_path: str = ""
    fields: dict = field(default_factory=dict)
    max_scrolls: int = 20
    scroll_wait_ms: int = 800


@dataclass(frozen=True)
class Archive:
    archive_url: str
    listing: Listing
    article: ArticleConfig
    sender: str = ""
    name: str = ""
    notes: str = ""

    @property
    def display_name(self) -> str:
        return self.name or urlsplit(self.archive_url).netloc or self.archive_url


@dataclass(frozen=True)
class Mapping:
    label_name: str
    label_id: str
    sender: str
    sources: tuple[Archive, ...]
    notes: str = ""

    def source(self, index: int) -> Archive:
        """A source by its number; a number out of range means the first."""
        return self.sources[index] if 0 <= index < len(self.sources) else self.sources[0]


def _number(data: dict, key: str, plain: int) -> int:
    return int(data.get(key, plain))


def _kind(data: dict) -> str:
    return str((data.get("pagination") or {}).get("type", "none"))


#: What a listing section has to fulfil: a test, and what to say of a section that fails it.
LISTING_RULES: tuple[tuple[Callable[[dict], bool], Callable[[dict], str]], ...] = (
    (lambda d: str(d.get("mode", "html")) in MODES, lambda d: f"listing.mode must be one of {sorted(MODES)}, not {str(d['mode'])!r}"),
    (lambda d: _kind(d) in PAGING, lambda d: f"pagination.type must be one of {sorted(PAGING)}, not {_kind(d)!r}"),
    (lambda d: str(d.get("url_template", "")).strip() != "", lambda d: "listing.url_template is missing"),
    # without its placeholder every page would be the first one again
    (lambda d: _kind(d) == "none" or f"{{{_kind(d)}}}" in str(d["url_template"]), lambda d: f"url_template has no {{{_kind(d)}}}, which pagination needs"),
    (lambda d: d.get("mode") == "json" or bool(d.get("item_selector")), lambda d: f"listing.item_selector is missing for mode {str(d.get('mode', 'html'))!r}"),
    (lambda d: isinstance(d.get("fields") or {}, dict), lambda d: "listing.fields must be an object"),
    (lambda d: set(REQUIRED) <= set(d.get("fields") or {}), lambda d: f"listing.fields lacks {sorted(set(REQUIRED) - set(d.get('fields') or {}))}"),
)


def _listing(data: dict, where: str) -> Listing:
    for holds, fault in LISTING_RULES:
        if not holds(data):
            _need(False, where, fault(data))
    paging, scroll = data.get("pagination") or {}, data.get("scroll") or {}
    return Listing(
        str(data.get("mode", "html")), str(data["url_template"]).strip(), Paging(_kind(data), _number(paging, "page_size", 50), _number(paging, "start", 0), _number(paging, "max_pages", 20)),
        *(str(data.get(k, "")) for k in ("item_selector", "next_page_selector", "items_path")), data["fields"], _number(scroll, "max_scrolls", 20), _number(scroll, "wait_ms", 800),
    )


def _archive(data: object, where: str) -> Archive:
    _need(isinstance(data, dict), where, "must be an object")
    url, listing, article = str(data.get("archive_url", "")).strip(), data.get("listing"), data.get("article") or {}
    _need(bool(url), where, "archive_url is missing")
    _need(url.startswith(("http://", "https://")), where, f"archive_url must be http(s), not {url!r}")
    _need(isinstance(listing, dict), where, "the listing section is missing")
    strip = article.get("strip_selectors") or ()
    _need(isinstance(strip, (list, tuple)), where, "article.strip_selectors must be a list")
    config = ArticleConfig(*(str(article.get(k, d)) for k, d in (("content_selector", ""), ("title_selector", ""), ("date_selector", ""), ("date_attr", "datetime"))), tuple(map(str, strip)))
    return Archive(url, _listing(listing, where), config, *(str(data.get(k, "")).strip() for k in ("sender", "name", "notes")))


def repeated(urls: list[str]) -> list[str]:
    """Addresses that come again, but for trailing slashes and case, in order."""
    seen, out = set(), []
    for u in urls:
        key = u.rstrip("/").lower()
        if key in seen and u not in out:
            out.append(u)
        seen.add(key)
    return out


def mapping(label: str, data: object) -> Mapping:
    """A checked mapping of one archive, written inline, or of a list of sources."""
    _need(isinstance(data, dict), label, "must be an object")
    listed, inline, sender = data.get("sources"), str(data.get("archive_url", "")).strip(), str(data.get("sender", "")).strip()
    _need(listed is None or not inline, label, "has both an archive_url and sources")
    if listed is None:
        sources = [replace(_archive(data, label), name="", notes="")]
    else:
        _need(isinstance(listed, list) and bool(listed), label, "sources must be a list that is not empty")
        sources = [_archive(s, f"{label} source[{i}]") for i, s in enumerate(listed)]
    twice = repeated([s.archive_url for s in sources])
    _need(not twice, label, f"archive_url repeated: {', '.join(twice)}")
    return Mapping(label, str(data.get("label_id", "")).strip(), sender, tuple(s if s.sender else replace(s, sender=sender) for s in sources), str(data.get("notes", "")))


class JsonFile:
    """A small JSON object on the driver's disk; a missing file is empty."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def read(self) -> dict:
        if not self.path.exists():
            return {}
        try:
            found = json.loads(self.path.read_text(encoding="utf-8"))
        except ValueError as e:
            raise ConfigError(f"{self.path} is no JSON: {e}") from e
        _need(isinstance(found, dict), str(self.path), "must be an object")
        return found

    def write(self, data: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_name(self.path.name + ".new")
        new.write_text(json.dumps(data, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        new.replace(self.path)


class Mappings(JsonFile):
    """All labels' mappings; one bad entry fails the whole file."""

    def all(self) -> list[Mapping]:
        entries = self.read().get("mappings", {})
        _need(isinstance(entries, dict), str(self.path), "mappings must be an object")
        return [mapping(k, v) for k, v in sorted(entries.items())]

    def get(self, label: str) -> Mapping | None:
        return next((m for m in self.all() if m.label_name == label), None)

    def save(self, label: str, data: dict) -> Mapping:
        checked, whole = mapping(label, data), self.read()
        self.write({"version": VERSION, **whole, "mappings": {**whole.get("mappings", {}), label: data}})
        return checked

    def delete(self, label: str) -> None:
        whole = self.read()
        if label in whole.get("mappings", {}):
            self.write({**whole, "mappings": {k: v for k, v in whole["mappings"].items() if k != label}})

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each source, as :func:`docweir.operators.listing.page_urls` wants it."""
        rows = [(m.label_name, m.label_id, i, s.archive_url, s.display_name, s.sender, s.listing.mode, s.listing.url_template, s.listing.paging.type, s.listing.paging.page_size, s.listing.paging.start, s.listing.paging.max_pages) for m in self.all() for i, s in enumerate(m.sources)]
        return spark.createDataFrame(rows, "label_name string, label_id string, source_index int, archive_url string, display_name string, sender string, mode string, url_template string, type string, page_size int, start int, max_pages int")


class Presets(JsonFile):
    """Names for comma-separated lists of label ids."""

    def all(self) -> list[str]:
        return sorted(self.read())

    def get(self, name: str) -> str | None:
        return self.read().get(name)

    def save(self, name: str, ids: str) -> None:
        self.write({**self.read(), name: ids})

    def delete(self, name: str) -> None:
        have = self.read()
        if name in have:
            self.write({k: v for k, v in have.items() if k != name})

"""Settings of the engine and of single documents, with their JSON sources and sinks."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, replace
from functools import lru_cache
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cleaning:
    """Which cleaning steps run; formatting is stripped only where markdown isn't preserved."""

    clean_encoding: bool = True
    preserve_markdown: bool = True
    strip_bold: bool = False
    strip_italic: bool = False
    strip_headers: bool = False
    remove_page_markers: bool = False
    normalize_line_breaks: bool = False
    join_short_lines: bool = False

    def strips_formatting(self) -> bool:
        return not self.preserve_markdown and (self.strip_bold or self.strip_italic or self.strip_headers)

    def toggled(self) -> Cleaning:
        """All switches on, or all off where they were on."""
        on = not all(asdict(self).values())
        return Cleaning(**{f.name: on for f in fields(self)})


@dataclass(frozen=True)
class PageRange:
    """Pages to keep: the listed ones, else from start to end (None: to the last). ``exclude`` is carried, not applied."""

    start: int = 1
    end: int | None = None
    only: tuple[int, ...] | None = None
    exclude: tuple[int, ...] | None = None


@dataclass(frozen=True)
class DocumentSettings:
    """How one document is cleaned, cut and filtered."""

    page_range: PageRange | None = None
    meta: dict[str, str] | None = field(default=None, hash=False)
    preprocessing: Cleaning = Cleaning()
    extract_by_bold: bool = False
    extract_by_patterns: bool = False
    custom_heading_patterns: tuple[str, ...] | None = None
    max_section_size: int = 1500
    deduplicate_sections: bool = True

    def with_pattern(self, pattern: str) -> DocumentSettings:
        return replace(self, custom_heading_patterns=(*(self.custom_heading_patterns or ()), pattern))

    def without_pattern(self, pattern: str) -> DocumentSettings:
        return replace(self, custom_heading_patterns=tuple(p for p in self.custom_heading_patterns or () if p != pattern))

    def with_pages(self, text: str) -> DocumentSettings:
        """Only the pages of an input like ``12, 15-19``; blank for all pages."""
        if not text.strip():
            return replace(self, page_range=None)
        found: set[int] = set()
        for part in filter(None, (p.strip() for p in text.split(","))):
            if not (m := re.fullmatch(r"(\d{1,9})\s*(?:-\s*(\d{1,9}))?", part)) or not 1 <= int(m[1]) <= int(m[2] or m[1]):
                raise ValueError(f"no page or range of pages: {part}")
            found |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
        if not found:
            raise ValueError("no pages")
        return replace(self, page_range=PageRange(only=tuple(sorted(found))))

    def with_section_size(self, size: int) -> DocumentSettings:
        if size < 1000:
            raise ValueError("a section holds 1000 characters at least")
        return replace(self, max_section_size=size)


@dataclass(frozen=True)
class EngineSettings:
    """Settings of the whole engine; without the unified pipeline documents are not cleaned."""

    enable_unified_pipeline: bool = True
    enable_preprocessing: bool = True
    preprocessing_config_path: str | None = None


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def from_json(kind: type, found: Any) -> Any:
    """A settings object from a JSON object with camel-case keys; unknown keys are ignored, null keeps the default."""
    if not isinstance(found, dict):
        raise ValueError(f"{kind.__name__} needs a JSON object")
    known = {f.name for f in fields(kind)}
    values = {k: v for k, v in ((_snake(k), v) for k, v in found.items()) if k in known and v is not None}
    for name, inner in (("page_range", PageRange), ("preprocessing", Cleaning)):
        if name in values and kind is DocumentSettings:
            values[name] = from_json(inner, values[name])
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def to_json(settings: Any) -> str:
    def plain(x: Any) -> Any:
        if hasattr(x, "__dataclass_fields__"):
            return {_camel(f.name): plain(getattr(x, f.name)) for f in fields(x)}
        return list(x) if isinstance(x, tuple) else x

    return json.dumps(plain(settings), indent=2, ensure_ascii=False)


@lru_cache(maxsize=4096)
def document_settings(text: str | None) -> DocumentSettings:
    """Settings from JSON text; defaults for none."""
    return from_json(DocumentSettings, json.loads(text)) if text else DocumentSettings()


class SettingsFolder:
    """A folder with ``global/engine.json``, ``global/preprocessing.json`` and ``individual/<stem>.json``.

    The engine's settings are read once and kept until ``forget``; what is missing or broken there is rewritten with
    defaults. A document's own settings replace the global ones as a whole.
    """

    def __init__(self, root: str | os.PathLike[str]) -> None:
        self.root = Path(root)
        self._engine: EngineSettings | None = None

    def _read(self, path: Path, kind: type) -> Any:
        try:
            return from_json(kind, json.loads(path.read_text(encoding="utf-8-sig")))
        except (OSError, ValueError, TypeError):
            return None

    def _write(self, path: Path, settings: Any) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(to_json(settings), encoding="utf-8")

    def engine(self) -> EngineSettings:
        if self._engine is None:
            path = self.root / "global" / "engine.json"
            self._engine = self._read(path, EngineSettings)
            if self._engine is None:
                self._engine = EngineSettings()
                self._write(path, self._engine)
        return self._engine

    def save_engine(self, settings: EngineSettings) -> None:
        self._write(self.root / "global" / "engine.json", settings)
        self._engine = settings

    def forget(self) -> None:
        self._engine = None

    def cleaning(self) -> Cleaning:
        """Global cleaning steps: the file's object, or the one under its key ``preprocessing``."""
        path = self.root / "global" / "preprocessing.json"
        try:
            found = json.loads(path.read_text(encoding="utf-8-sig"))
            return from_json(Cleaning, found.get("preprocessing", found))
        except (OSError, ValueError, TypeError, AttributeError):
            return Cleaning()

    def save_cleaning(self, settings: Cleaning) -> None:
        self._write(self.root / "global" / "preprocessing.json", settings)

    def document(self, stem: str) -> DocumentSettings | None:
        return self._read(self.root / "individual" / f"{stem}.json", DocumentSettings)

    def save_document(self, stem: str, settings: DocumentSettings) -> None:
        self._write(self.root / "individual" / f"{stem}.json", settings)

    def documents(self) -> list[str]:
        return sorted(p.stem for p in (self.root / "individual").glob("*.json"))

    def rows(self) -> list[tuple[str, str]]:
        """(stem, JSON) of all documents with settings of their own, for a config table."""
        found = ((stem, self.document(stem)) for stem in self.documents())
        return [(stem, to_json(s)) for stem, s in found if s is not None]

    def table(self, spark: SparkSession) -> DataFrame:
        """(stem, settings, error) of all documents with settings of their own, read by Spark: the JSON text where it
        fits the settings, else an error. The folder must be one that the executors see."""
        kind = "stem string, settings string, error string"
        folder = self.root / "individual"
        if not folder.is_dir() or next(folder.glob("*.json"), None) is None:
            return spark.createDataFrame([], kind)
        files = spark.read.option("pathGlobFilter", "*.json").text(str(folder), wholetext=True)
        path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        stem = F.regexp_extract(path, r"([^/]*)\.json\z", 1)
        text = F.regexp_replace("value", "^\ufeff", "")
        return checked(files.select(stem.alias("stem"), text.alias("settings")))


def json_schema() -> str:
    """The settings of a document as a Spark schema, with a column for what doesn't fit."""
    switches = ", ".join(f"{_camel(f.name)}: boolean" for f in fields(Cleaning))
    pages = "start: int, end: int, only: array<int>, exclude: array<int>"
    return (
        f"pageRange struct<{pages}>, meta map<string, string>, preprocessing struct<{switches}>, extractByBold boolean, extractByPatterns boolean, "
        "customHeadingPatterns array<string>, maxSectionSize int, deduplicateSections boolean, broken string"
    )


def parsed(settings: Column) -> Column:
    return F.from_json(settings, json_schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def checked(rows: DataFrame) -> DataFrame:
    """(stem, settings, error) of rows (stem, settings): JSON that doesn't fit the settings becomes an error."""
    found = parsed(F.col("settings"))
    bad = found.isNull() | found["broken"].isNotNull() | ~F.ltrim("settings").startswith("{")
    good = F.coalesce(~bad, F.lit(False))
    return rows.select("stem", F.when(good, F.col("settings")).alias("settings"), F.when(~good, "no valid settings").alias("error"))


def cleaning_table(own: DataFrame) -> DataFrame:
    """(stem, cleaning) of rows (stem, settings): a document's own switches, with defaults where it says nothing."""
    mine = parsed(F.col("settings"))["preprocessing"]
    switches = [F.coalesce(mine[_camel(f.name)], F.lit(f.default)).alias(f.name) for f in fields(Cleaning)]
    return own.select("stem", F.struct(*switches).alias("cleaning"))

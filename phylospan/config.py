"""Run settings: defaults, a settings file, explicit values, and their validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

MODES = ("auto", "file", "single")


@dataclass(frozen=True)
class Settings:
    """Settings of a run. Paths may be anything Spark reads."""

    query: str | None = None
    output: str | None = None
    database: str | None = None
    tree: str | None = None
    index: str | None = None
    classifier: str | None = None
    species: str | None = None
    species_file: str | None = None
    chunk: int = 100_000
    min_score: int = 30
    min_identity: int = 90
    size_filter: int = 150
    cluster_size: int = 0
    threads: int = 1

    @property
    def mode(self) -> str:
        """Where query species come from: a file, one given name, or detection."""
        return "file" if self.species_file else "single" if self.species else "auto"

    @property
    def index_path(self) -> str:
        return self.index or f"{self.database}/ref_index.parquet"


REQUIRED = ("query", "output", "database", "tree")
INTEGERS = ("chunk", "min_score", "min_identity", "size_filter", "cluster_size", "threads")


def parse_settings_file(text: str) -> dict[str, str]:
    """'key: value' lines of a flat settings file; '#' comments and blank lines are skipped, quotes around values dropped."""
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a 'key: value' line: {line!r}")
        out[key.strip()] = value.strip().strip("'\"")
    return out


def merge_settings(file_values: dict[str, object], given: dict[str, object]) -> Settings:
    """Given values win over the file's, the file's over the defaults. Unknown keys, bad integers and missing required
    settings raise ValueError, as do a species and a species file together."""
    known = {f.name for f in fields(Settings)}
    values: dict[str, object] = {}
    for source in (file_values, given):
        for key, value in source.items():
            if key not in known:
                raise ValueError(f"unknown setting: {key}")
            if value is not None and value != "":
                values[key] = value
    for key in INTEGERS:
        if key in values:
            try:
                values[key] = int(str(values[key]))
            except ValueError:
                raise ValueError(f"{key} must be an integer: {values[key]!r}") from None
            if values[key] < 0:
                raise ValueError(f"{key} must not be negative: {values[key]}")
    if values.get("chunk") == 0:
        raise ValueError("chunk must be above 0")
    missing = [key for key in REQUIRED if key not in values]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    if "species" in values and "species_file" in values:
        raise ValueError("give species or species_file, not both")
    return Settings(**values)


def as_header(settings: Settings) -> dict[str, object]:
    return asdict(settings)

"""Codebook, project settings and .env files: small, read on the driver, strictly checked."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError
from ..functions.hashing import IDENTIFIER, code_hash, normalise_definition, sha_of

MAX_EXAMPLES, LONG_DEFINITION = 5, 400
CODES = "ord int, code_id string, type string, definition string, norm_definition string, examples_yes array<string>, examples_no array<string>, code_hash string"


class _Unique(yaml.SafeLoader):
    """A mapping that names a key twice is an error."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=deep) for k, _ in node.value]
        twice = {k for k in keys if keys.count(k) > 1}
        if twice:
            raise ValidationError(f"line {node.start_mark.line + 1}: {sorted(map(str, twice))[0]} stands twice")
        return super().construct_mapping(node, deep)


def _yaml(text: str) -> dict:
    try:
        got = yaml.load(text, _Unique)  # noqa: S506 - a safe loader
    except yaml.YAMLError as e:
        raise ValidationError(f"not YAML: {e}") from e
    if not isinstance(got, dict):
        raise ValidationError("a mapping is expected at the top")
    return got


@dataclass(frozen=True)
class Code:
    code_id: str
    definition: str
    type: str = "noul"
    examples_yes: tuple[str, ...] = ()
    examples_no: tuple[str, ...] = ()

    @property
    def hash(self) -> str:
        return code_hash(self.definition, self.examples_yes, self.examples_no)


@dataclass(frozen=True)
class Codebook:
    codes: tuple[Code, ...]

    @property
    def ids(self) -> list[str]:
        return [c.code_id for c in self.codes]

    @property
    def hash(self) -> str:
        return sha_of("codebook", *(x for c in self.codes for x in (c.code_id, c.hash)))

    def subset(self, ids: list[str]) -> Codebook:
        unknown = [i for i in ids if i not in self.ids]
        if unknown:
            raise ValidationError(f"unknown code {unknown[0]!r}", hint=f"codes: {', '.join(self.ids)}")
        return Codebook(tuple(c for c in self.codes if c.code_id in ids))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.code_id, c.type, c.definition, normalise_definition(c.definition), list(c.examples_yes), list(c.examples_no), c.hash) for i, c in enumerate(self.codes)]
        return spark.createDataFrame(rows, CODES)


def parse_code(code_id: str, body: object) -> Code:
    if not isinstance(code_id, str) or not IDENTIFIER.match(code_id):
        raise ValidationError(f"bad code id {code_id!r}", hint="3 to 41 lower-case letters, digits and _, a letter first")
    if not isinstance(body, dict) or not str(body.get("definition") or "").strip():
        raise ValidationError(f"{code_id}: a definition is missing")
    unknown = body.keys() - {"type", "definition", "examples_yes", "examples_no"}
    if unknown:
        raise ValidationError(f"{code_id}: unknown key {sorted(unknown)[0]!r}")
    if body.get("type", "noul") != "noul":
        raise ValidationError(f"{code_id}: only binary codes (noul) are supported")
    examples = {}
    for side in ("examples_yes", "examples_no"):
        given = body.get(side) or []
        if not isinstance(given, list) or not all(isinstance(e, str) and e.strip() for e in given) or len(given) > MAX_EXAMPLES:
            raise ValidationError(f"{code_id}: {side} is a list of up to {MAX_EXAMPLES} texts")
        examples[side] = tuple(given)
    return Code(code_id, str(body["definition"]), **examples)


def parse_codebook(text: str) -> Codebook:
    got = _yaml(text)
    if got.get("version") != 1:
        raise ValidationError("version: 1 is required")
    if got.keys() - {"version", "codes"}:
        raise ValidationError(f"unknown key {sorted(got.keys() - {'version', 'codes'})[0]!r}")
    if not isinstance(got.get("codes"), dict) or not got["codes"]:
        raise ValidationError("at least one code is required")
    return Codebook(tuple(parse_code(k, v) for k, v in got["codes"].items()))


def definition_warnings(book: Codebook) -> list[str]:
    """Advice on definitions that are more than a sentence or two."""
    import re

    found = []
    for c in book.codes:
        text = normalise_definition(c.definition)
        if len([s for s in re.split(r"(?<=[.!?])\s+", text) if s]) > 2 or len(text) > LONG_DEFINITION:
            found.append(f"{c.code_id}: the definition is long; one sentence works best")
    return found


@dataclass
class _Section:
    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        pass

    def need(self, good: bool, what: str) -> None:
        if not good:
            raise ValidationError(what)


@dataclass
class CorpusSettings(_Section):
    path: str = "data/corpus.csv"
    text_column: str = "text"
    id_column: str | None = None


@dataclass
class SplitSettings(_Section):
    seed: int = 42
    dev: float = 0.10
    calibration: float = 0.45
    test: float = 0.45

    def check(self) -> None:
        self.need(all(0 <= x <= 1 for x in (self.dev, self.calibration, self.test)), "split shares lie in [0, 1]")
        self.need(abs(self.dev + self.calibration + self.test - 1) <= 1e-9, "split shares sum to 1")


@dataclass
class BackendSettings(_Section):
    name: str = "recorded"
    model: str | None = None
    endpoint: str | None = None


@dataclass
class EngineSettings(_Section):
    concurrency: int = 16
    budget_usd: float = 5.0
    max_retries: int = 5
    price_per_million_input: float | None = None
    price_per_million_output: float | None = None
    confirm_above_calls: int = 500

    def check(self) -> None:
        self.need(1 <= self.concurrency <= 256, "concurrency is 1 to 256")
        self.need(self.budget_usd >= 0 and 0 <= self.max_retries <= 20 and self.confirm_above_calls >= 0, "budget, retries and calls are not negative; 20 retries at most")
        self.need(all(p is None or p >= 0 for p in (self.price_per_million_input, self.price_per_million_output)), "prices are not negative")


@dataclass
class GoldSettings(_Section):
    n: int = 600
    enrich_rare_codes: bool = True
    double_coded_overlap: int = 150

    def check(self) -> None:
        self.need(self.n >= 1 and 0 <= self.double_coded_overlap <= self.n, "n is at least 1 and the overlap at most n")


@dataclass
class ThresholdSettings(_Section):
    alpha: float = 0.10
    delta: float = 0.05

    def check(self) -> None:
        self.need(0 < self.alpha < 1 and 0 < self.delta < 1, "alpha and delta lie in (0, 1)")


@dataclass
class ChunkSettings(_Section):
    max_tokens: int = 28_000
    overlap_tokens: int = 200
    aggregation: str = "max"

    def check(self) -> None:
        self.need(self.max_tokens >= 256 and 0 <= self.overlap_tokens < self.max_tokens, "max_tokens is 256 or more, the overlap less")
        self.need(self.aggregation in ("max", "mean"), "aggregation is max or mean")


@dataclass
class Settings:
    corpus: CorpusSettings = field(default_factory=CorpusSettings)
    splits: SplitSettings = field(default_factory=SplitSettings)
    backend: BackendSettings = field(default_factory=BackendSettings)
    engine: EngineSettings = field(default_factory=EngineSettings)
    gold: GoldSettings = field(default_factory=GoldSettings)
    thresholds: ThresholdSettings = field(default_factory=ThresholdSettings)
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    version: int = 1

    def fingerprint(self) -> dict:
        """What a calibration depends on besides the codes."""
        return {**asdict(self.chunking), "seed": self.splits.seed, "backend": self.backend.name}


def parse_settings(text: str) -> Settings:
    got = _yaml(text)
    if got.get("version") != 1:
        raise ValidationError("version: 1 is required")
    kinds = {f.name: f.default_factory for f in fields(Settings) if f.name != "version"}
    unknown = got.keys() - kinds.keys() - {"version"}
    if unknown:
        raise ValidationError(f"unknown section {sorted(unknown)[0]!r}")
    made = {}
    for name, kind in kinds.items():
        body = got.get(name) or {}
        if not isinstance(body, dict):
            raise ValidationError(f"{name} is a section of keys")
        extra = body.keys() - {f.name for f in fields(kind)}
        if extra:
            raise ValidationError(f"{name}: unknown key {sorted(extra)[0]!r}")
        for f in fields(kind):
            if f.name in body and not _fits(body[f.name], f.default):
                raise ValidationError(f"{name}: {f.name} cannot be {body[f.name]!r}")
        made[name] = kind(**body)
    return Settings(**made)


def _fits(value: object, default: object) -> bool:
    """Whether a value has the kind of a key's default; a key without one takes text, a number or nothing."""
    if value is None or default is None:
        return default is None and not isinstance(value, bool | list | dict)
    if isinstance(value, bool) or isinstance(default, bool):
        return isinstance(value, bool) and isinstance(default, bool)
    return isinstance(value, int | float) if isinstance(default, float) else isinstance(value, type(default))


def dump_settings(settings: Settings) -> str:
    return yaml.safe_dump(asdict(settings), sort_keys=False)


def settings_template() -> str:
    return "# Settings of a coding project; every key is optional but version.\n" + dump_settings(Settings())


def parse_env(text: str) -> dict[str, str]:
    found = {}
    for line in map(str.strip, text.splitlines()):
        name, sign, value = line.removeprefix("export ").partition("=")
        if sign and not line.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return found


def load_env(path: str) -> list[str]:
    """Sets what the environment lacks; gives the names only, marked where their values must not be shown."""
    if not os.path.exists(path):
        return []
    with open(path) as f:
        found = parse_env(f.read())
    for k, v in found.items():
        os.environ.setdefault(k, v)
    return [f"{k} (secret)" if is_secret(k) else k for k in sorted(found)]


def is_secret(name: str) -> bool:
    return any(x in name.upper() for x in ("KEY", "TOKEN", "SECRET", "PASSWORD"))

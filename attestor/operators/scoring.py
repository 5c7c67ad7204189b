"""Scoring of passages by a pluggable backend behind a cache: misses only, once a distinct text."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError
from ..functions.hashing import cache_key, estimate_tokens
from ..functions.stats import valid_probability
from .units import build_units, distinct_texts, pool_scores

#: Answers that are worth another try, and the service's budgets for a call and for its questions.
RETRIED = frozenset({408, 409, 425, 429, 500, 502, 503, 504})
STATE_TOKENS, QUESTION_TOKENS = 64_000, 32_000
#: Seconds until a silent service counts as failed; distinct texts that one task scores.
TIMEOUT, TEXTS_A_TASK = 120, 2_000
SCORED = "text_hash string, code_id string, scored double, input_tokens long, model string, error string"
CACHE_SCHEMA = "key string, probability double, created_at timestamp, input_tokens long"


@dataclass(frozen=True)
class Question:
    code_id: str
    definition: str
    yes: tuple[str, ...] = ()
    no: tuple[str, ...] = ()

    @property
    def tokens(self) -> int:
        return len(" ".join((self.definition, *self.yes, *self.no))) // 4 + 1


def split_codes(text: str, codes: Sequence[Question], budget: int = STATE_TOKENS, questions: int = QUESTION_TOKENS) -> list[list[Question]]:
    """Runs of codes whose questions fit both budgets, with the text the first; a text over it goes with one code at a time."""
    base = len(text) // 4 + 1
    if base >= budget:
        return [[c] for c in codes]
    runs: list[list[Question]] = []
    room = 0
    for c in codes:
        if c.tokens > room or not runs:
            runs.append([])
            room = min(budget - base, questions)
        runs[-1].append(c)
        room -= c.tokens
    return runs


def checked(value: object, code_id: str) -> float | None:
    """A probability or null; booleans, text, NaN and values outside [0, 1] are errors."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
        raise BackendError(f"invalid probability for {code_id}: {value!r}")
    return float(value)


def post_json(url: str, payload: dict, *, headers: dict | None = None, retries: int = 5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None, opener: Callable | None = None) -> dict:
    """POST with retries: backoff doubles from half a second to thirty, or as Retry-After says, times 0.5 to 1.5."""
    rng, data = rng or random.Random(), json.dumps(payload).encode()
    opener = opener or (lambda request: urllib.request.urlopen(request, timeout=TIMEOUT))
    for attempt in range(retries + 1):
        wait = min(30.0, 0.5 * 2**attempt)
        try:
            with opener(urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == retries:
                raise BackendError(f"HTTP {e.code} from {url}") from e
            after = (e.headers or {}).get("Retry-After", "")
            wait = float(after) if after.replace(".", "", 1).isdigit() else wait
        except (urllib.error.URLError, OSError) as e:
            if attempt == retries:
                raise BackendError(f"no answer from {url}: {e}") from e
        sleep(wait * rng.uniform(0.5, 1.5))
    raise BackendError(f"no answer from {url}")


@dataclass
class Backend:
    """text x codes -> probability of each code. A batch that breaks yields nulls with the error's name; a BackendError stops the run."""

    name: str = "backend"
    model_version: str = "unknown"
    prices: tuple[float, float] | None = None
    retries: int = 5

    def batch(self, text: str, codes: list[Question]) -> dict[str, float | None]:
        raise NotImplementedError

    def answers(self, text: str, codes: Sequence[Question]) -> dict[str, tuple[float | None, str | None]]:
        """Probability and error of every code; an answer without a code is an error too."""
        found: dict[str, tuple[float | None, str | None]] = {}
        for run in split_codes(text, codes):
            try:
                got = self.batch(text, run)
            except BackendError:
                raise
            except Exception as e:  # noqa: BLE001 - one bad answer must not lose the run; what broke is reported
                found |= {c.code_id: (None, type(e).__name__) for c in run}
                continue
            for c in run:
                p = checked(got.get(c.code_id), c.code_id)
                found[c.code_id] = (p, None if p is not None else "no answer")
        return found

    def score(self, text: str, codes: Sequence[Question]) -> dict[str, float | None]:
        return {c: p for c, (p, _) in self.answers(text, codes).items()}

    def scored(self, texts: DataFrame, codes: list[Question], tasks: int) -> DataFrame:
        """SCORED rows for texts(text_hash, text, code_ids)."""
        held = {c.code_id: c for c in codes}

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                rows = []
                for h, text, ids in zip(frame["text_hash"], frame["text"], frame["code_ids"], strict=True):
                    for code, (p, error) in self.answers(text, [held[i] for i in sorted(ids)]).items():
                        rows.append((h, code, p, len(text) // 4 + 1, self.model_version, error))
                yield pd.DataFrame(rows, columns=["text_hash", "code_id", "scored", "input_tokens", "model", "error"])

        return texts.repartition(tasks).mapInPandas(ask, SCORED)


@dataclass
class CallableBackend(Backend):
    """Wraps a function text, code_id -> probability."""

    function: Callable[[str, str], float | None] | None = None

    def __post_init__(self) -> None:
        if self.function is None:
            raise BackendError(f"{self.name}: a function is needed")

    def batch(self, text: str, codes: list[Question]) -> dict[str, float | None]:
        return {c.code_id: self.function(text, c.code_id) for c in codes}


def instructions(codes: Sequence[Question]) -> str:
    """The questions as text, each with its examples."""
    parts = []
    for c in codes:
        parts.append(f"[{c.code_id}] {c.definition}")
        parts += [f"  yes: {e}" for e in c.yes] + [f"  no: {e}" for e in c.no]
    return "\n".join(parts)


def prompt(text: str, codes: Sequence[Question]) -> str:
    return f'Judge the text between the marks by each category.\n{instructions(codes)}\nAnswer with a JSON object of true or false by category.\n<<<\n{text}\n>>>'


@dataclass
class RecordedBackend(Backend):
    """Replays a table recorded(item_hash, code_id, probability) by a join; text_hash stands for item_hash. A cell without an answer is an error or, if lenient, null."""

    name: str = "recorded"
    recorded: DataFrame | None = None
    strict: bool = True

    def __post_init__(self) -> None:
        if self.recorded is None:
            raise BackendError("recorded: a table of recorded answers is needed", hint="name its file in settings (backend.endpoint) or by --recorded")

    def scored(self, texts: DataFrame, codes: list[Question], tasks: int) -> DataFrame:
        cells = texts.select("text_hash", F.explode("code_ids").alias("code_id"), estimate_tokens(F.col("text")).alias("input_tokens"))
        known = self.recorded.select(F.col("item_hash").alias("text_hash"), "code_id", "probability")
        met = cells.join(known, ["text_hash", "code_id"], "left")
        p = F.col("probability")
        if self.strict:
            p = F.when(p.isNull(), F.raise_error(F.concat(F.lit("no recorded answer for "), "text_hash", F.lit(" / "), "code_id")).cast("double")).otherwise(p)
        return met.select("text_hash", "code_id", valid_probability(p, F.col("code_id")).alias("scored"), "input_tokens", F.lit(self.model_version).alias("model"), F.when(F.col("probability").isNull(), "no answer").alias("error"))


@dataclass
class HostedBackend(Backend):
    """A calibrated service: one call, a question a code, probabilities back."""

    url: str = ""
    key_variable: str = "ATTESTOR_API_KEY"

    def batch(self, text: str, codes: list[Question]) -> dict[str, float | None]:
        body = {"input": text, "questions": {c.code_id: instructions([c]) for c in codes}}
        answer = post_json(self.url, body, headers={"Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}, retries=self.retries)
        given = answer.get("answers") if isinstance(answer, dict) else None
        if not isinstance(given, dict) or not all(isinstance(given.get(c.code_id), dict) and "probability" in given[c.code_id] for c in codes):
            raise BackendError(f"{self.name}: an answer lacks a probability")
        self.model_version = answer.get("model", self.model_version)
        return {c.code_id: given[c.code_id]["probability"] for c in codes}


@dataclass
class ChatBackend(Backend):
    """A chat model: token log-probabilities of its yes or no where offered, else the share of `votes`.

    The probability is that of the code being present: a confident no is near 0.
    """

    url: str = ""
    votes: int = 5
    key_variable: str = "ATTESTOR_API_KEY"
    logprobs: bool = True
    style: str = "completions"

    def _ask(self, text: str, codes: list[Question], logprobs: bool) -> dict:
        headers = {"Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        body = {"model": self.model_version, "messages": [{"role": "user", "content": prompt(text, codes)}], "temperature": 0 if logprobs else 1}
        if self.style == "messages":
            body["max_tokens"] = 1024
        elif logprobs:
            body["logprobs"] = True
        return post_json(self.url, body, headers=headers, retries=self.retries)

    @staticmethod
    def decisions(content: str, codes: Sequence[Question]) -> dict[str, bool | None]:
        """Booleans by code; anything absent or not boolean is null, not false."""
        try:
            got = json.loads(content)
        except ValueError:
            got = {}
        got = got if isinstance(got, dict) else {}
        return {c.code_id: got.get(c.code_id) if isinstance(got.get(c.code_id), bool) else None for c in codes}

    def _content(self, answer: dict) -> str:
        if self.style == "messages":
            return "".join(x.get("text", "") for x in answer["content"])
        return answer["choices"][0]["message"]["content"]

    def batch(self, text: str, codes: list[Question]) -> dict[str, float | None]:
        if self.logprobs and self.style != "messages":
            try:
                return {c.code_id: self._by_logprob(text, c) for c in codes}
            except BackendError:
                self.logprobs = False  # refused once: vote from now on
        votes = [self.decisions(self._content(self._ask(text, codes, False)), codes) for _ in range(self.votes)]
        shares = {}
        for c in codes:
            given = [v[c.code_id] for v in votes if v[c.code_id] is not None]
            shares[c.code_id] = sum(given) / len(given) if given else None
        return shares

    def _by_logprob(self, text: str, code: Question) -> float | None:
        import math

        answer = self._ask(text, [code], True)
        for token in answer["choices"][0]["logprobs"]["content"]:
            word = token["token"].strip().lower()
            if word in ("true", "false"):
                p = min(1.0, math.exp(token["logprob"]))
                return p if word == "true" else 1 - p
        return None


REGISTRY: dict[str, tuple[Callable[..., Backend], str]] = {
    "hosted": (HostedBackend, "Texts leave this machine for the configured service."),
    "chat": (ChatBackend, "Texts leave this machine for the configured service."),
    "messages": (lambda **o: ChatBackend(style="messages", **o), "Texts leave this machine for the configured service."),
    "local": (lambda **o: ChatBackend(**{"url": "http://localhost:8080/v1/chat/completions", **o}), "Texts stay on this machine."),
    "recorded": (RecordedBackend, "Texts stay here; answers are replayed."),
}


def available() -> list[str]:
    return sorted(REGISTRY)


def backend(name: str, **options) -> Backend:
    if name not in REGISTRY:
        raise BackendError(f"unknown backend {name!r}; one of {', '.join(available())}")
    return REGISTRY[name][0](**{"name": name, **options})


def replay(units_or_items: DataFrame, codes: DataFrame, recorded: DataFrame, *, strict: bool = True) -> DataFrame:
    """Recorded answers joined by item hash: recorded(item_hash, code_id, probability). A missing one is an error or, if lenient, null."""
    met = units_or_items.crossJoin(F.broadcast(codes.select("code_id"))).join(recorded, ["item_hash", "code_id"], "left")
    if strict:
        gone = F.raise_error(F.concat(F.lit("no recorded answer for "), "item_id", F.lit(" / "), "code_id")).cast("double")
        met = met.withColumn("probability", F.when(F.col("probability").isNull(), gone).otherwise(F.col("probability")))
    return met


@dataclass
class Run:
    """scores(item_id, code_id, probability), the items with a null among them, the new cache, and what the run did.

    stats: one row with lookups, hits, misses, hit_rate. usage: one row with the texts and cells scored, failed cells and
    input tokens. errors and models: how many cells each error and each answering model had.
    """

    scores: DataFrame
    failures: DataFrame
    cache: DataFrame
    stats: DataFrame
    usage: DataFrame
    errors: DataFrame
    models: DataFrame


def lookups(units: DataFrame, codes: DataFrame, cache: DataFrame, backend_name: str, model_version: str) -> DataFrame:
    """Every (unit, code) with its cache key and the cached probability, null on a miss. Texts stay behind."""
    cells = units.drop("text").crossJoin(F.broadcast(codes.select("code_id", "code_hash")))
    keyed = cells.withColumn("key", cache_key(F.lit(backend_name), F.lit(model_version), F.col("text_hash"), F.col("code_id"), F.col("code_hash")))
    return keyed.join(cache.select("key", F.col("probability").alias("cached")), "key", "left")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest row of each key; a null probability is never stored."""
    every = cache.unionByName(fresh.where("probability is not null"))
    newest = F.struct("created_at")  # a row without a date counts as the oldest, but counts
    return every.groupBy("key").agg(F.max_by("probability", newest).alias("probability"), F.max("created_at").alias("created_at"), F.max_by("input_tokens", newest).alias("input_tokens"))


def cache_stats(looked: DataFrame) -> DataFrame:
    """Over rows of lookups; a column `units` tells how many cells a row stands for."""
    each = F.col("units") if "units" in looked.columns else F.lit(1)
    n, hit = F.coalesce(F.sum(each), F.lit(0)), F.coalesce(F.sum(F.when(F.col("cached").isNotNull(), each)), F.lit(0))
    return looked.agg(n.alias("lookups"), hit.alias("hits"), (n - hit).alias("misses"), F.when(n > 0, hit / n).otherwise(0.0).alias("hit_rate"))


def merged(older: DataFrame, fresh: DataFrame) -> DataFrame:
    """Scores of a partial run over those of an earlier one: new cells win, all others stay."""
    columns = ["item_id", "code_id", "probability"]
    return older.join(fresh.select("item_id", "code_id"), ["item_id", "code_id"], "left_anti").select(columns).unionByName(fresh.select(columns))


def failed(scores: DataFrame) -> DataFrame:
    return scores.where("probability is null").select("item_id").distinct()


def run(spark: SparkSession, items: DataFrame, codes: DataFrame, scorer: Backend, cache: DataFrame, *, written: Callable[[DataFrame, str], DataFrame], max_tokens: int = 28_000, overlap_tokens: int = 200, rule: str = "max", concurrency: int = 16) -> Run:
    """Score items x codes: probe the cache by text hash, score each distinct missed text once, fan out, pool passages.

    `written` stores a table where every executor sees it and reads it back. The lookups and the scored misses are
    stored before anything reads them, so that no retry bills a text twice.
    """
    units = build_units(items, max_tokens=max_tokens, overlap_tokens=overlap_tokens)
    placed = written(units.select("item_id", "unit_index", "text_hash"), "units")
    hashes = placed.groupBy("text_hash").agg(F.count("*").alias("units"))
    looked = written(lookups(hashes, codes, cache, scorer.name, scorer.model_version).select("text_hash", "code_id", "key", "cached", "units"), "lookups")
    missed = looked.where("cached is null").groupBy("text_hash").agg(F.collect_set("code_id").alias("code_ids"))
    texts = distinct_texts(units.join(missed.select("text_hash"), "text_hash", "left_semi")).join(missed, "text_hash")
    asked = [Question(r["code_id"], r["definition"], tuple(r["examples_yes"] or ()), tuple(r["examples_no"] or ())) for r in codes.collect()]
    scored = written(scorer.scored(texts, asked, max(concurrency, missed.count() // TEXTS_A_TASK)), "scored")

    known = looked.join(scored.select("text_hash", "code_id", "scored", "input_tokens"), ["text_hash", "code_id"], "left")
    passages = placed.join(known.select("text_hash", "code_id", F.coalesce("cached", "scored").alias("probability")), "text_hash")
    scores = pool_scores(passages, rule)
    fresh = known.where("cached is null and scored is not null").select("key", F.col("scored").alias("probability"), F.current_timestamp().alias("created_at"), "input_tokens")
    usage = scored.agg(F.count_distinct("text_hash").alias("texts"), F.count("*").alias("cells"), F.count_if(F.col("scored").isNull()).alias("failed"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"))
    by = lambda c: scored.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("cells"))
    return Run(scores, failed(scores), upsert(cache, fresh), cache_stats(looked), usage, by("error"), by("model"))

"""URL filters by Bloom filter cascades, in DataFrame functions only.

A list's keys are encoded in a first Bloom filter; the corpus's keys that it passes by mistake in a
second, listed keys that this one passes by mistake in a third, and so on until no mistake is left. As
every key of the corpus took part, a key's membership, read off level by level without a join, is exact
for the corpus. Keys are `host suffix + path prefix` of the lengths that the list's rules use.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LISTED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")
BITS_A_KEY, HASHES = 6, 3
#: Largest filter that is built (half a megabyte, as it travels in the plan) and most levels; a list that needs more is matched by a shuffled join.
MAX_BITS, MAX_LEVELS = 1 << 22, 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; both empty for a null url or one without ://."""
    rest = F.expr(f"CASE WHEN contains({url}, '://') THEN substring({url}, locate('://', {url}) + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def candidates(path_lengths: list[int]) -> Column:
    """Every key of a row with host and path that a rule of such path lengths may equal, longest first."""
    suffixes = "transform(sequence(1, size(split(host, '\\\\.', -1))), i -> array_join(slice(split(host, '\\\\.', -1), i, size(split(host, '\\\\.', -1))), '.'))"
    lengths = ", ".join(map(str, sorted(set(path_lengths)))) or "0"
    keys = f"flatten(transform({suffixes}, s -> transform(filter(array({lengths}), n -> n <= length(path)), n -> concat(s, substring(path, 1, n)))))"
    return F.expr(f"array_sort(array_distinct({keys}), (a, b) -> CASE WHEN length(a) > length(b) THEN -1 WHEN length(a) < length(b) THEN 1 WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")


class Bloom:
    """One level: its bits as 64-bit words in a constant, tested inside the plan."""

    def __init__(self, level: int, words: list[int]) -> None:
        self.level, self.words = level, words

    @staticmethod
    def _bit(key: Column, level: int, i: int, bits: int) -> Column:
        # reduced first: products of whole hashes overflow
        one, two = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits)), F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits))
        return F.pmod(one + i * two, F.lit(bits))

    @classmethod
    def build(cls, keys: DataFrame, level: int, n: int) -> Bloom:
        """From keys(key), n of them; as many words reach the driver as the filter has."""
        bits = 64 * (1 + n * BITS_A_KEY // 64)
        at = keys.select(F.explode(F.array(*[cls._bit(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("at"))
        rows = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits")).collect()
        words = [0] * (bits // 64)
        for r in rows:
            words[r["word"]] = r["bits"]
        return cls(level, words)

    def test(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded to a constant
        bits = [self._bit(key, self.level, i, 64 * len(self.words)) for i in range(HASHES)]
        # get() counts from 0
        held = [F.getbit(F.get(words, F.floor(b / 64).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1 for b in bits]
        return held[0] & held[1] & held[2]


class Cascade:
    """Exact membership for the keys of the universe that it was built on."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade | None:
        """listed(key) against universe(key). Mistakes shrink from level to level, so few passes are made.

        None if a filter would be too large, or two keys are hashed alike at every level.
        """
        listed = listed.where("key is not null").distinct()
        inside, outside, levels = listed, universe.where("key is not null").join(listed, "key", "left_anti").distinct(), []
        while n := inside.count():
            if n * BITS_A_KEY > MAX_BITS or len(levels) == MAX_LEVELS:
                return None
            levels.append(Bloom.build(inside, len(levels), n))
            mistaken = runtime.written(outside.where(levels[-1].test(F.col("key"))), "mistaken")
            inside, outside = mistaken, inside
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """Passing the first level means listed unless the second passes too, and so on."""
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[depth].test(key), answer).otherwise(F.lit(depth % 2 == 1))
        return answer


def _path_length(rule: str) -> int:
    return len(rule) - rule.find("/") if "/" in rule else 0


def _best_by_join(rows: DataFrame, found: str, of: str, listed: DataFrame) -> DataFrame:
    """rows and the longest of their keys that is listed, by shuffled joins on key and on (host, path); nothing is broadcast or collected."""
    places = rows.select("host", "path", of).distinct().withColumn("key", F.explode(of))
    hit = places.join(listed.select("key").distinct(), "key", "left_semi").groupBy("host", "path").agg(F.max_by("key", F.length("key")).alias(found))
    return rows.join(hit, ["host", "path"], "left")


def judge(pages: DataFrame, *, rules=RULES, listed_hosts=LISTED_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    The longest fitting rule decides; without one, `block` if the host or a domain above it is listed,
    else `allow`. A null url has an empty host and is allowed. Repeated rows and null ids give a row each; columns
    besides page_id and url are ignored. Of an allow and a block rule that are equal, block wins. listed_hosts may be a
    table(key); a list beyond the largest filter is joined, with the same result.
    """
    spark = pages.sparkSession
    lengths = sorted({_path_length(r) for _, r in rules})
    rows = parsed(pages.select("page_id", "url")).select("page_id", "host", "path")
    rows = rows.withColumns({"keys": candidates(lengths), "hosts": candidates([0])})
    # every key of the corpus, gathered in one pass
    kinds = F.explode(F.concat(F.transform("keys", lambda k: F.struct(F.lit("keys").alias("of"), k.alias("key"))), F.transform("hosts", lambda k: F.struct(F.lit("hosts").alias("of"), k.alias("key")))))
    universe = runtime.written(rows.select(kinds.alias("x")).select("x.of", "x.key").distinct(), "universe")
    lists = {v: ([r for k, r in rules if k == v], "keys") for v in ("allow", "block")} | {"listed": (listed_hosts, "hosts")}
    for name, (keys, of) in lists.items():
        listed = keys if isinstance(keys, DataFrame) else spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(list(keys))), "array<string>")).alias("key"))
        cascade = Cascade.build(listed, universe.where(F.col("of") == of).select("key"))
        rows = _best_by_join(rows, name, of, listed) if cascade is None else rows.withColumn(name, F.get(F.filter(of, cascade.contains), F.lit(0)))
    blocks = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.length("block") >= F.length("allow")))
    verdict = F.when(blocks, "block").when(F.col("allow").isNotNull(), "allow").when(F.col("listed").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.when(blocks, F.col("block")).otherwise(F.col("allow")).alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(runtime.table(spark, sf_dir, "pages"))


OP2_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), r(kind, rule, h, p) AS (
  VALUES {", ".join(f"('{k}', '{r}', '{r.partition('/')[0]}', '{'/' + r.partition('/')[2]}')" for k, r in RULES)}
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, rule,
  coalesce(kind, CASE WHEN {" OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)
"""

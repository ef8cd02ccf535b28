"""URL filters: rules by host and path, and a cascade of Bloom filters for exact membership of listed hosts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits and hash functions for each key of a filter.
BITS, HASHES = 12, 4
#: Bits of the filters of one cascade, about; where the listed keys need more, they are dealt by hash to several cascades, and the rows go through one after another.
MOST_BITS = 1 << 24
#: Bits of all levels of a cascade against those of its first.
LEVELS_SHARE = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case; empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and the domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, else null. A rule fits its host and the hosts below, if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def places(key: Column, level: int, bits: int) -> list[Column]:
    one, two = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits))
    return [F.pmod(one + i * two, F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Filters in turn over the listed keys and over the keys that the filter before lets through wrongly."""

    def __init__(self, keys: DataFrame) -> None:
        """keys: key and listed (boolean), each key of the universe once. Levels end when no key is told wrongly, which distinct 64-bit hashes make sure of."""
        self.filters: list[tuple[str, int]] = []
        keys = written(keys.select("key", "listed"), "universe")
        left = keys.where("listed")
        while n := left.count():
            level = len(self.filters)
            bits = -(-max(n * BITS, 256) // 64) * 64
            self.filters.append((self._build(left, level, bits), bits))
            # of the other kind, those that pass all filters so far
            left = keys.where(F.col("listed") if level % 2 else ~F.col("listed"))
            for i in range(len(self.filters)):
                left = left.where(self._holds(F.col("key"), i))

    def _build(self, keys: DataFrame, level: int, bits: int) -> str:
        """The filter's words of 64 bits, comma-joined; no more rows reach the driver than it has words."""
        place = keys.select(F.explode(F.array(*places(F.col("key"), level, bits))).alias("p"))
        words = place.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, int(p % 64))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
        out = ["0"] * (bits // 64)
        for row in words.collect():
            out[row.w] = str(row.bits)
        return ",".join(out)

    def _holds(self, key: Column, level: int) -> Column:
        words, bits = self.filters[level]
        array = F.split(F.lit(words), ",").cast("array<bigint>")  # folded to a constant
        out = F.lit(True)
        for p in places(key, level, bits):
            out = out & (F.getbit(F.get(array, (p / 64).cast("int")), (p % 64).cast("int")) == 1)
        return out

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first filter that it does not pass tells."""
        out = F.lit(len(self.filters) % 2 == 1)
        for level in reversed(range(len(self.filters))):
            out = F.when(self._holds(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], is_listed, *, page_id: str = "page_id", url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, listed, verdict (allow or block).

    is_listed: a function of a key's column, true for listed keys; or a DataFrame whose first column has them. Keys are hosts and the
    domains above them; a listed key blocks all hosts below it. The universe is all keys of pages. The cascade is built over its distinct keys and
    then judges each row by expressions alone. The rules, which are few, come first. Where the filters would take more than about `most_bits`, the keys are dealt by hash to
    as many cascades as that takes; the rows pass these in turn and are written between them, so that no plan holds more than one.

    Null urls and urls without :// have empty host and path, fit no rule and are allowed unless the empty key is listed. An empty table gives no rows.
    """
    rows = pages.select(pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    keys = rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    if isinstance(is_listed, DataFrame):
        listed = is_listed.select(is_listed[is_listed.columns[0]].alias("key")).dropna().distinct()
        keys = keys.join(listed.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        keys = keys.select("key", F.coalesce(is_listed(F.col("key")), F.lit(False)).alias("listed"))
    keys = written(keys, "keys")
    parts = -(-keys.where("listed").count() * BITS * LEVELS_SHARE // most_bits) or 1
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    rows = rows.withColumn("listed", F.lit(False))
    for part in range(parts):
        rows = written(rows, "judged") if part else rows
        holds = Cascade(keys if parts == 1 else keys.where(part_of(F.col("key")) == part)).holds
        found = F.exists(domains(F.col("host")), holds if parts == 1 else lambda key: (part_of(key) == part) & holds(key))  # noqa: B023
        rows = rows.withColumn("listed", F.col("listed") | found)
    verdict = F.coalesce(rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules, lambda r: r.name).alias("rule"), "listed", verdict.alias("verdict"))

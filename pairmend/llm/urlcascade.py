"""URL filters by a cascade of Bloom filters: lists of hosts and paths, looked up exactly, without joins.

A URL's keys are its host and the hosts above it with the beginnings of its path, in the shapes (labels of the host, characters of
the path) that listed keys have. The first filter of a cascade
holds the listed keys; the second those keys of the corpus that the first takes for listed; the third those listed
keys that the second takes for unlisted; and so on until nothing is taken for something else. For all keys of the corpus
and the list the cascade's answer is then exact. It takes about log2(corpus keys / listed keys) bits a listed key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmend.llm.common import settle

#: Bits of a cascade's first filter, 8 MB (so much goes to the tasks that look keys up), and tests in the expression that judges a URL
#: (shapes by hashes). Lists beyond either are joined by their keys instead.
MOST_BITS, MOST_TESTS = 1 << 26, 2_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lowered) and path (up to ? or #) of a URL; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape (labels, n) the URL's key of the host's last labels and the path's first n characters.

    Keys are structs (size, host, key), size the key's length and host its host's, or null where host or path are too short.
    """
    many, long, out = F.size(F.split(host, r"\.")), F.length(path), []
    for labels, n in shapes:
        above = F.substring_index(host, ".", -labels)
        key = F.struct((F.length(above) + n).alias("size"), F.length(above).alias("host"), F.concat(above, F.substring(path, 1, n)).alias("key"))
        out.append(F.when((many >= labels) & (long >= n), key))
    return out


@dataclass(frozen=True)
class Level:
    """One filter: its bits, hashes, its number in the cascade, and a table of one row with the bits in words of 64."""

    bits: int
    hashes: int
    number: int
    words: DataFrame | None = None

    def place(self, key: Column, k: int) -> Column:
        a = F.pmod(F.xxhash64(F.lit(2 * self.number), key), F.lit(self.bits))
        b = F.pmod(F.xxhash64(F.lit(2 * self.number + 1), key), F.lit(self.bits - 1)) + 1
        return (a + k * b) % self.bits

    def holds(self, key: Column) -> Column:
        out, words = F.lit(True), self.words.scalar()
        for k in range(self.hashes):
            at = self.place(key, k)
            out = out & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return out

    def filled(self, keys: DataFrame) -> Level:
        """The filter with the keys in it: bits by word in each task, then words by number, and one row of bounded size of them all."""
        at = keys.select(F.explode(F.array(*[self.place(F.col("key"), k) for k in range(self.hashes)])).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        set_ = at.select(F.shiftright("at", 6).alias("word"), one.alias("bits"))
        empty = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = set_.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
        return Level(self.bits, self.hashes, self.number, settle(row))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...] = ()

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus or the list is listed."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.holds(key) & ~out
        return out


def sized(n: int, chance: float, number: int) -> Level:
    """A filter without bits for n keys, that takes others for its own with about this chance."""
    hashes = max(1, round(-math.log2(chance)))
    return Level(64 * max(1, math.ceil(hashes * n / math.log(2) / 64)), hashes, number)


def cascade(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS, most_hashes: int = 64) -> Cascade | None:
    """A cascade for distinct keys (column key) that tells them from all others of universe (column key, repeats welcome).

    None if its first filter would have more bits or hashes than that. universe is read twice: to size the first filter (its
    keys are counted by a sketch, which decides sizes only), and for what that filter takes for listed. What is left is about as many keys as are
    listed, and half as many each level on; it stays in tables.
    """
    listed = settle(listed.select("key"))
    n = listed.count()
    if not n:
        return Cascade()
    others = max(1, universe.agg(F.approx_count_distinct("key", 0.02)).first()[0] - n)
    level = sized(n, min(0.5, n / (others * math.sqrt(2))), 0)
    if level.bits > most_bits or level.hashes > most_hashes:
        return None
    levels = [level.filled(listed)]
    # What the last filter holds, and what it must be told from: the keys that the one before it held.
    inside = listed
    outside = settle(universe.select("key").filter(levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti"))
    while (wrong := outside.count()) > 0:
        level = sized(wrong, 0.5, len(levels)).filled(outside)
        levels.append(level)
        inside, outside = outside, settle(inside.filter(level.holds(F.col("key"))))
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", most_bits: int = MOST_BITS, most_tests: int = MOST_TESTS) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) for every row of pages.

    rules has host, path and verdict. A rule fits its host and all hosts under it, if the URL's path starts with the rule's; the
    longest (host and path; of equals the longer host) decides and is named, host and path together. What no rule fits gets
    `otherwise` and a null rule: the cascade says that none of its keys is listed. One cascade tells listed keys from the corpus's
    others, a second the blocking rules from the allowing. Pages are judged where they are read, by expressions alone; a list too
    long for most_bits, or of too many shapes for most_tests, is joined by key instead.

    Defined results: a null URL or one without :// has an empty host and path; a rule given with both verdicts blocks; rules without a host or
    with another verdict are left out, a null path is an empty one, and rules' hosts are lowered like URLs'; without rules all get
    `otherwise`; repeated rows are judged alike, and columns but page_id and url aren't read.
    """
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    known = rules.filter("host <> '' and verdict in ('allow', 'block')").select(F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("n"), "verdict")
    known = settle(known.groupBy("key", "labels", "n").agg(F.max("verdict").alias("verdict")))
    shapes = [(r["labels"], r["n"]) for r in known.select("labels", "n").distinct().orderBy("labels", "n").limit(most_tests + 1).collect()]
    host, path = address(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    listed = None
    if len(shapes) <= most_tests:
        keys = keys_of(F.col("host"), F.col("path"), shapes)
        listed = cascade(known, rows.select(F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.key"), most_bits, most_tests // len(shapes))
    if listed is None:
        return _joined(rows, known, otherwise)
    blocking = cascade(known.filter("verdict = 'block'"), known, most_bits)
    best = F.array_max(F.array(*[F.when(listed.holds(k["key"]), k) for k in keys]))
    out = rows.withColumn("rule", best["key"])
    return out.withColumn("verdict", F.when(F.col("rule").isNull(), otherwise).when(blocking.holds(F.col("rule")), "block").otherwise("allow"))


def _joined(rows: DataFrame, known: DataFrame, otherwise: str) -> DataFrame:
    """The same for a list of any length and shapes: each distinct host and path meets the list by host, and then by path."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = rows.select("host", "path").distinct().withColumn("above", F.explode(hosts))
    lengths = known.select(F.expr("substring(key, 1, length(key) - n)").alias("above"), "n").distinct()
    asked = own.join(lengths, "above").filter(F.length("path") >= F.col("n")).withColumn("key", F.expr("concat(above, substring(path, 1, n))"))
    found = asked.join(known.select("key", "verdict"), "key")
    found = found.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("size"), F.length("above").alias("of"), "key", "verdict")).alias("best"))
    out = rows.join(found, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))

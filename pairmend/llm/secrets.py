"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

A token is scored by the log-likelihood ratio of two first-order Markov chains over its characters, one
trained on strings known to be random, one on ordinary identifiers. All of it runs in the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns (kind, pattern, group whose length counts, fewest characters).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
#: Runs that the models judge: this long at least. Space-like and dotted tokens end a run.
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Another character, or a token's end, is class 0.
CLASSES = len(ALPHABET) + 1
#: Rows of documents that models are trained from, at most about this many.
TRAIN_DOCS = 20_000
#: A token is random if its ratio, in nats a character, is above this.
MARGIN = 0.45
#: A random token has as many different characters at least.
DIFFERENT = 8

SPAN = "struct<kind:string,start:long,end:long>"
ORDER = ("assign", "access", "hex", "random")


#: Code points of a piece that a text is cut into before its secrets are taken out.
CHUNK = 4096
#: Matches whose places are summed in one fold; a text with more takes a fold for each so many.
FOLD = 256


def _before(sizes: str) -> str:
    """SQL: for an array of longs, the sum of those before each; folds of FOLD, so long arrays take linear time."""
    grow = "(a, v) -> concat(a, array(element_at(a, -1) + v))"
    parts = f"transform(sequence(0L, (size({sizes}) - 1) div {FOLD}), b -> aggregate(slice({sizes}, CAST(b * {FOLD} AS INT) + 1, {FOLD}), array(0L), {grow}))"
    heads = "aggregate(c, array(0L), (a, v) -> concat(a, array(element_at(a, -1) + element_at(v, -1))))"
    return f"transform(array({parts}), c -> flatten(zip_with(c, slice({heads}, 1, size(c)), (x, h) -> transform(slice(x, 1, size(x) - 1), v -> v + h))))[0]"


def _furthest(values: str) -> str:
    """SQL: for an array of longs, the greatest up to each; folds of FOLD, as in _before."""
    grow = "(a, v) -> concat(a, array(greatest(element_at(a, -1), v)))"
    parts = f"transform(sequence(0L, (size({values}) - 1) div {FOLD}), b -> aggregate(slice({values}, CAST(b * {FOLD} AS INT) + 1, {FOLD}), array(-1L), {grow}))"
    heads = "aggregate(c, array(-1L), (a, v) -> concat(a, array(greatest(element_at(a, -1), element_at(v, -1)))))"
    return f"transform(array({parts}), c -> flatten(zip_with(c, slice({heads}, 1, size(c)), (x, h) -> transform(slice(x, 2, size(x) - 1), v -> greatest(v, h)))))[0]"


def _spans(kind: str, pattern: str, group: int, least: int, text: str = "text", found: bool = False) -> F.Column:
    """Spans of the leftmost non-overlapping matches of pattern whose group has `least` characters; found: with what they match.

    What split() leaves between the matches tells where they start, in code points.
    """
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # Where a run's own length is what counts, short runs can't match: the same spans, found faster.
    longer = lit if group else lit.replace("]+'", f"]{{{least - 4 * pattern.startswith('AKIA')},}}'")
    gaps = f"transform(split({text}, {longer}, -1), x -> CAST(length(x) AS BIGINT))"
    whole = f"transform(regexp_extract_all({text}, {longer}, 0), x -> CAST(length(x) AS BIGINT))"
    own = f"transform(regexp_extract_all({text}, {longer}, {group}), x -> length(x))"
    fields = f"'gaps', {gaps}, 'whole', {whole}" + (f", 'own', {own}" if group else "") + (f", 'found', regexp_extract_all({text}, {longer}, 0)" if found else "")
    steps = "zip_with(slice(p.gaps, 1, size(p.whole)), p.whole, (g, w) -> g + w)"
    item = f"named_struct('kind', '{kind}', 'start', before[i] + p.gaps[i], 'end', before[i] + p.gaps[i] + p.whole[i]{", 'token', p.found[i]" if found else ""})"
    kept = f"filter(sequence(0, size(p.whole) - 1), i -> p.{'own' if group else 'whole'}[i] >= {least})"
    made = f"transform(array(named_struct({fields})), p -> transform(array(transform(array({steps}), s -> {_before('s')})[0]), before -> transform({kept}, i -> {item}))[0])[0]"
    return F.expr(f"IF({text} RLIKE {longer}, {made}, CAST(array() AS array<{SPAN[:-1]}{",token:string" if found else ""}>>))")


def base_spans() -> dict[str, F.Column]:
    return {kind: _spans(kind, *rest) for kind, *rest in BASE}


def _pairs(token: F.Column) -> F.Column:
    """The character pairs of a token as class numbers: from * CLASSES + to, both ends included."""
    chars = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    chars = F.filter(F.concat(F.array(F.lit(0)), chars, F.array(F.lit(0))), lambda x: x.isNotNull())
    return F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: a * CLASSES + b)


def samples(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(token, random, n): labelled samples and how often each is met, from about `most` documents, chosen
    by the hash of doc_id and text.

    The base patterns label: values they find are random strings; runs of eight characters or more
    that touch no base span are ordinary identifiers.
    """
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n))) < most).select(F.coalesce("text", F.lit("")).alias("text"))
    found = some.select("text", F.concat(*base_spans().values()).alias("s"))
    value = lambda x: F.regexp_extract(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]), r"([A-Za-z0-9+/_=-]+)$", 1)
    random = F.transform("s", lambda x: F.struct(value(x).alias("token"), F.lit(True).alias("random")))
    other = F.when(F.size("s") > 0, F.regexp_replace("text", ASSIGN, " ")).otherwise(F.col("text"))
    plain = F.transform(F.regexp_extract_all(other, F.lit("[A-Za-z0-9+/_=-]{8,}"), 0), lambda x: F.struct(x.alias("token"), F.lit(False).alias("random")))
    tokens = found.select(F.explode(F.concat(random, plain)).alias("x")).select("x.*").groupBy("token", "random").agg(F.count("*").alias("n"))
    return tokens.filter(F.col("random") | ~F.col("token").rlike("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}"))


def _kind(k: int) -> str:
    c = ALPHABET[k - 1] if k else ""
    return "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "sign" if c else "end"


#: How often an identifier goes from one kind of character to another, before any sample is seen.
STEPS = {
    ("lower", "lower"): 20, ("upper", "upper"): 20, ("digit", "digit"): 20, ("sign", "sign"): 5,
    ("upper", "lower"): 10, ("lower", "upper"): 4, ("lower", "sign"): 4, ("upper", "sign"): 4,
    ("sign", "lower"): 10, ("sign", "upper"): 5,
}
#: The part of each chance that comes from the prior however many samples there are; few samples leave it more.
PRIOR = 0.2


def train(labelled: DataFrame) -> list[float]:
    """For each pair of classes the log of its chance after the first, random over ordinary.

    From (token, random) rows, each counted n times if there is an n; the result has CLASSES squared numbers whatever the rows. Chances are
    those seen, mixed with a prior: for random strings any class alike, for identifiers by STEPS. So
    no sample is needed for a defined result. Null or empty tokens count for nothing.
    """
    n = F.col("n") if "n" in labelled.columns else F.lit(1)
    pairs = labelled.filter("token <> '' and random is not null").select("random", n.alias("n"), F.explode(_pairs(F.col("token"))).alias("pair"))
    seen = {True: [0.0] * CLASSES**2, False: [0.0] * CLASSES**2}
    for row in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        seen[row["random"]][row["pair"]] += row["n"]
    kinds = [_kind(k) for k in range(CLASSES)]
    alike = [1.0] * CLASSES**2
    steps = [float(STEPS.get((a, b), 1)) for a in kinds for b in kinds]
    return [a - b for a, b in zip(_logs(seen[True], alike), _logs(seen[False], steps), strict=True)]


def _logs(counts: list[float], prior: list[float]) -> list[float]:
    out = []
    for k in range(0, len(counts), CLASSES):
        row, base = counts[k : k + CLASSES], prior[k : k + CLASSES]
        known = (1 - PRIOR) * sum(row) / (sum(row) + CLASSES)
        out += [math.log(known * x / (sum(row) or 1) + (1 - known) * y / sum(base)) for x, y in zip(row, base, strict=True)]
    return out


def ratio(token: F.Column, model: Iterable[float]) -> F.Column:
    """Nats a character by which a token is likelier as a random string than as an identifier."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    total = F.aggregate(_pairs(token), F.lit(0.0), lambda t, p: t + F.get(table, p))
    return total / F.length(token)


def scan(docs: DataFrame, model: list[float] | None = None, margin: float = MARGIN, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """docs with two more columns, base and spans (replacing any of these names): arrays of (kind, start, end), in order.

    Places count code points, the end excluded. base holds the spans of the base patterns, spans these
    and, as kind random, the tokens that the models call random and no base span touches. Without a
    model, one is trained from docs. A null or empty text has none. Very long texts are scanned whole. Ids are not looked at
    but for sampling, so null and repeated ones change nothing.
    """
    model = train(samples(docs)) if model is None else model
    text = "coalesce(text, '')"
    given = docs.withColumns({f"__{kind}": _spans(kind, *rest, text=text) for kind, *rest in BASE})
    given = given.withColumn("__tokens", _spans("random", f"(){TOKEN}", 0, LEAST, text=text, found=True))
    base = F.concat(*[F.col(f"__{kind}") for kind, *_ in BASE])
    # A base span touches a token if, of those that start before the token's end, one ends after its start: in the order of
    # starts and ends, the furthest end so far says so. Time grows with the text, however many of both it has.
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("to"), F.lit(0).cast("long").alias("start"), F.lit("").alias("token")))
    ends = F.transform("__tokens", lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("base"), F.lit(-1).cast("long").alias("to"), t["start"].alias("start"), t["token"].alias("token")))
    given = given.withColumn("__marks", F.when(F.size("__tokens") > 0, F.array_sort(F.concat(starts, ends))).otherwise(F.slice(starts, 1, 0)))
    given = given.withColumn("__reach", F.expr(f"IF(size(__marks) = 0, CAST(array() AS array<bigint>), {_furthest('transform(__marks, m -> m.to)')})"))
    # Side by side, as an array looked up inside a lambda may be computed for each element.
    marked = F.zip_with("__marks", "__reach", lambda m, r: F.struct(m["at"].alias("at"), m["base"].alias("base"), m["start"].alias("start"), m["token"].alias("token"), r.alias("reach")))
    free = F.filter(marked, lambda m: (m["base"] == 0) & (m["reach"] <= m["start"]))
    random = F.filter(free, lambda t: (F.size(F.array_distinct(F.split(t["token"], ""))) >= DIFFERENT) & (ratio(t["token"], model) > margin))
    random = F.transform(random, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["at"].alias("end")))
    out = given.withColumns({names[0]: _ordered(base), names[1]: _ordered(F.concat(base, random))})
    return out.drop("__tokens", "__marks", "__reach", *[f"__{kind}" for kind, *_ in BASE])


def _ordered(spans: F.Column) -> F.Column:
    """By start, then by kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, ORDER)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<SECRET>", **how) -> DataFrame:
    """docs with every run of text that spans cover replaced by the mark; other columns as they are."""
    found = scan(docs, names=("__base", "__spans"), **how)
    text = "coalesce(text, '')"
    # A span that starts where or after the furthest end so far begins a run; what is kept of the text stands before such spans
    # and after the last end. The text is cut into chunks once, so that no piece is sought from its beginning.
    found = found.withColumn("__to", F.expr(f"IF(size(__spans) = 0, CAST(array() AS array<bigint>), {_furthest('transform(__spans, s -> s.end)')})"))
    found = found.withColumn("__chunks", F.expr(f"IF(size(__spans) = 0, CAST(array() AS array<string>), regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0))"))
    heads = "filter(zip_with(__spans, slice(concat(array(0L), __to), 1, size(__spans)), (s, f) -> named_struct('from', f, 'to', s.start)), h -> h.to >= h.from)"
    last = f"named_struct('from', element_at(__to, -1), 'to', CAST(length({text}) AS BIGINT))"
    size = f"CAST((k.to - 1) div {CHUNK} - k.from div {CHUNK} AS INT) + 1"
    piece = f"IF(k.to > k.from, substring(array_join(slice(c, CAST(k.from div {CHUNK} AS INT) + 1, {size}), ''), CAST(k.from % {CHUNK} AS INT) + 1, CAST(k.to - k.from AS INT)), '')"
    clean = f"transform(array(__chunks), c -> array_join(transform(concat({heads}, array({last})), k -> {piece}), '{mark}'))[0]"
    cleaned = found.withColumn("text", F.expr(f"IF(size(__spans) = 0, text, {clean})"))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text, by Python's own matcher; for tests."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0])))

"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are cut into bands; documents that agree on a band are candidates. A candidate pair is
judged by comparing its signatures batch after batch: after m matches in n hashes the posterior of
the similarity (uniform prior) is Beta(m + 1, n - m + 1), and a pair whose posterior chance of
reaching the threshold is below `miss` is pruned. Survivors are verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm import kernels as K
from pairmend.llm.common import settle, small
from pairmend.llm.components import connected_components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 20
#: Members of a bucket in a block, when they are compared with each other.
AMONG = 500
_rng = np.random.default_rng(7)
_MULT = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)

SIGNED = "doc_id long, mark long, n_shingles long, set_key binary, sig binary, bands array<long>"


def least_matches(threshold: float, miss: float, batch: int = BATCH, hashes: int = HASHES) -> list[int]:
    """For each batch end n, the fewest matches whose posterior chance of the threshold is miss or more."""

    def chance(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if chance(m, n) >= miss) for n in range(batch, hashes + 1, batch)]


def _bounds(shingles: int):
    """A function from Arrow batches of (doc_id, mark, text) to batches of SIGNED."""

    def run(batches):
        for batch in K.released(batches):
            about, (data, at) = batch.select([0, 1]), K.text_bytes(batch.column(2))
            for i, j in K.slices(at):
                part = data[at[i] : at[j]]
                starts, ends, words_at = K.word_bounds(part, at[i : j + 1] - at[i])
                words = K.word_lanes(part, starts, ends, lower=True)
                yield _sign(about.slice(i, j - i), words, words_at, shingles)

    return run


def _sign(about: pa.RecordBatch, words: list[np.ndarray], words_at: np.ndarray, size: int) -> pa.RecordBatch:
    sets, keys = [], []
    for a, b in zip(words_at[:-1], words_at[1:], strict=True):
        runs = [K.window_hashes(w[a:b], min(size, int(b - a))) for w in words]
        own, first, which = np.unique(runs[0], return_index=True, return_inverse=True)
        second = runs[1][first]
        if (second[which] != runs[1]).any():  # different shingles with one hash: both hashes tell them apart
            own, second = np.unique(np.stack(runs, 1), axis=0).T
            own, second = np.ascontiguousarray(own), np.ascontiguousarray(second)
        sets.append(own)
        # Equal sets only: a digest of both 64-bit hashes of every shingle.
        keys.append(hashlib.blake2b(own.tobytes() + second.tobytes(), digest_size=24).digest() if len(own) else None)
    counts = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(counts)
    sigs = np.zeros((len(full), HASHES), np.uint32)
    if len(full):
        every = np.concatenate([sets[k] for k in full])
        at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        short = (every >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            sigs[:, k] = np.minimum.reduceat(short * _MULT[k] + _PLUS[k], at)
    bands = np.zeros((len(full), BANDS), np.uint64)
    for k in range(ROWS):
        bands = K.mix(bands * np.uint64(31) + sigs[:, k::ROWS].astype(np.uint64) + np.uint64(k + 1))
    bands = K.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sig = ((sigs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    mark, band = [None] * len(sets), [None] * len(sets)
    for row, k in enumerate(full):
        mark[k], band[k] = sig[row].tobytes(), bands[row].view(np.int64)
    columns = [*about.columns, pa.array(counts), pa.array(keys, pa.binary()), pa.array(mark, pa.binary()), pa.array(band, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "set_key", "sig", "bands"])


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): mark, a hash of the text, tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def signatures(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """SIGNED rows: set size, a 192-bit key of the set (equal sets only), signature and band keys."""
    return _marked(docs).mapInArrow(_bounds(shingle_words), SIGNED)


def _matches(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Matches of paired signatures, compared by batches; -1 once a pair is pruned."""
    out, alive = np.zeros(len(left), np.int32), np.arange(len(left))
    for step, need in enumerate(least):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        out[alive] += (left[alive, cut] == right[alive, cut]).sum(1, dtype=np.int32)
        lost = out[alive] < need
        out[alive[lost]] = -1
        alive = alive[~lost]
        if not len(alive):
            break
    return out


def _bytes_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), HASHES)


def _judge(pairs: DataFrame, signed: DataFrame, least: list[int]) -> DataFrame:
    """(a, b, matches) for the pairs that no batch prunes."""

    @F.pandas_udf("int")
    def matches(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(_matches(_bytes_of(left), _bytes_of(right), least))

    sig = signed.select("doc_id", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return both.select("a", "b", matches("sig_a", "sig_b").alias("matches")).filter("matches >= 0")


def _shingle_set(text: str, size: int) -> set[str]:
    words = [w for w in text.translate(_ASCII_LOWER).translate(_ASCII_SPACE).split(" ") if w]
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _linked(left: set, right: set, percent: int) -> bool:
    few, many = sorted((len(left), len(right)))
    if 100 * few < percent * many:
        return False
    shared = len(left & right)
    return 100 * shared >= percent * (few + many - shared)


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_ASCII_SPACE = dict.fromkeys(range(0x09, 0x0E), " ")


def _verify(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        known, out = ("", set()), []
        for x, y in zip(left, right, strict=True):
            if known[0] != x:
                known = (x, _shingle_set(x, shingle_words))
            out.append(_linked(known[1], _shingle_set(y, shingle_words), percent))
        return pd.Series(out)

    t = texts.select("doc_id", "text")
    both = pairs.select("a", "b").join(t.toDF("b", "text_b"), "b").join(t.toDF("a", "text_a"), "a")
    return both.filter(linked("text_a", "text_b")).select("a", "b")


def _texts(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text): whole texts of the classes in the pairs, written once."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rep = F.col("rep" if "rep" in reps.columns else "doc_id").alias("rep")
    want = settle(reps.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("class"), rep, "mark"))
    rows = _marked(docs).withColumnRenamed("doc_id", "rep").join(small(want), ["rep", "mark"])
    return settle(rows.select(F.col("class").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"]))


def _judged(docs: DataFrame, shingle_words: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, chosen) of each row; chosen: the mark of the component's
    smallest doc_id. component_id and chosen are null where there is no set or no doc_id."""
    least = least_matches(percent / 100, miss)
    signed = settle(signatures(docs, shingle_words))
    whole = signed.filter("sig is not null and doc_id is not null")
    # The row that stands for a class: its smallest doc_id, and of that the smallest mark.
    of_class = whole.groupBy("set_key").agg(F.min(F.struct("doc_id", "mark", "n_shingles", "sig", "bands")).alias("x"))
    reps = of_class.select("set_key", "x.*").withColumnRenamed("doc_id", "rep").withColumn("doc_id", F.monotonically_increasing_id())
    reps = settle(reps)
    members = reps.select("doc_id", F.explode("bands").alias("band"))
    crowds = settle(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = settle(members.join(crowds, "band"))
    # What copies were made from meets more of them than they meet each other.
    known = shared.groupBy("doc_id").agg(F.sum("n").alias("meets"))
    leader = F.max_by("doc_id", F.struct("meets", "doc_id")).alias("leader")
    buckets = settle(shared.join(known, "doc_id").groupBy("band").agg(leader))
    pairs = shared.join(buckets, "band").filter("doc_id <> leader")
    pairs = pairs.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))
    likely = settle(_judge(pairs.distinct(), reps, least))
    texts = _texts(docs, reps, likely)
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
    links = settle(_verify(best.select("a", "b"), texts, shingle_words, percent))
    near = links.select(F.col("b").alias("id"), F.col("a").alias("component_id"))  # one step of the way is enough here
    rest = _across(likely.select("a", "b").join(best, ["a", "b"], "left_anti"), near)
    links = settle(links.union(_verify(rest, texts, shingle_words, percent)))
    found = settle(connected_components(links))
    minor = settle(_minor(shared.join(buckets, "band"), found))
    if not minor.isEmpty():
        more = settle(_against_components(docs, minor, found, reps, least, shingle_words, percent))
        late = settle(_among(docs, minor, found, more, reps, least, shingle_words, percent))
        found = settle(connected_components(links.union(more.select("a", "b")).union(late)))
    # From numbers of classes to doc_ids: a component is named by the smallest of its classes' rows.
    joined = found.select(F.col("id").alias("doc_id"), F.col("component_id").alias("comp")).join(reps.select("doc_id", "rep", "mark"), "doc_id")
    named = small(settle(joined.groupBy("comp").agg(F.min(F.struct(F.col("rep").alias("doc_id"), "mark")).alias("x"))))
    joined = joined.join(named, "comp").select("doc_id", F.col("x.doc_id").alias("component_id"), F.col("x.mark").alias("chosen"))
    of_set = reps.select("doc_id", "set_key", "rep", "mark").join(small(settle(joined)), "doc_id", "left")
    of_set = settle(of_set.select("set_key", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("chosen", "mark").alias("chosen")))
    slim = signed.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return slim.join(of_set, "set_key", "left").select("doc_id", "mark", "n_shingles", "component_id", "chosen")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are left alone, whatever their names. Documents with
    equal shingle sets form one class with a number of its own, so copies cost nothing
    more. Each class is compared with one member of each of its buckets, the one that meets most others;
    the likeliest candidate of each class is verified first, then the pairs that still join different
    components. In buckets that hold more components after that, the members outside the leader's
    component are compared with all of it and with each other, in bounded blocks. Only pairs that are
    in one component already, or that hold too few shingles that any two of those members share, are left
    out, so no component misses a link.

    Defined results: a null or empty text, or one of white space, has n_shingles 0, links with
    nothing and is kept; a null doc_id links with nothing, has a null component_id and is kept. Rows that
    repeat a doc_id come back as often, each judged by its own text; a component is named by the smallest
    doc_id of the rows that are reachable from a row's text. No rows in, no rows out.
    """
    out = _judged(docs, shingle_words, percent, miss).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """docs with one row of each component: one of the text that goes with its smallest doc_id.

    Rows without words or without a doc_id all stay. Of rows that repeat doc_id and text one stays, any
    one if other columns differ. Columns and their names are those of docs.
    """
    judged = settle(_judged(docs, shingle_words, percent, miss).filter("component_id is not null"))
    won = F.expr("doc_id = component_id and mark = chosen")
    gone = small(settle(judged.filter(~won).select(F.col("doc_id").alias("__i"), F.col("mark").alias("__m")).distinct()))
    again = settle(judged.filter(won).groupBy(F.col("doc_id").alias("__i"), F.col("mark").alias("__m")).count().filter("count > 1").drop("count"))
    id_, mark = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    same = (id_ == F.col("__i")) & (mark == F.col("__m"))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    again = small(again)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    one = kept.join(again, same, "left_semi").select(whole, id_.alias("__i"), mark.alias("__m")).groupBy("__i", "__m").agg(F.first("__doc").alias("__doc"))
    rest = kept.join(again, same, "left_anti").select(whole)
    return rest.union(one.select("__doc")).select("__doc.*")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    for end in ("a", "b"):
        own = found.select(F.col("id").alias(end), F.col("component_id").alias(f"of_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return pairs.filter("of_a <> of_b").select("a", "b")


def _minor(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(band, doc_id, lead_comp): bucket members outside the component of their bucket's leader."""
    comp = found.select(F.col("id").alias("doc_id"), F.col("component_id").alias("comp"))
    lead = comp.select(F.col("doc_id").alias("leader"), F.col("comp").alias("lead_comp"))
    rows = shared.filter("n > 2").join(comp, "doc_id", "left").join(lead, "leader", "left")
    rows = rows.withColumns({"comp": F.coalesce("comp", "doc_id"), "lead_comp": F.coalesce("lead_comp", "leader")})
    return rows.filter("comp <> lead_comp").select("band", "doc_id", "lead_comp")


def _against_components(docs: DataFrame, minor: DataFrame, found: DataFrame, reps: DataFrame, least: list[int], shingle_words: int, percent: int, block: int = 500) -> DataFrame:
    """For each minor member one link (a, b, comp), if there is any, to each block of its bucket leader's component.

    Both sides are dealt into blocks; a group holds one block of each. What no batch of hashes prunes
    is verified there, the likeliest first, until one is linked.
    """
    want = minor.select("doc_id", F.col("lead_comp").alias("comp")).distinct()
    full = found.select(F.col("id").alias("doc_id"), F.col("component_id").alias("comp"))
    alone = want.select("comp").join(full.select("comp").distinct(), "comp", "left_anti").distinct()
    full = full.union(alone.select(F.col("comp").alias("doc_id"), "comp"))
    n_want = settle(want.groupBy("comp").agg(F.expr(f"1 + count(*) div {block}").alias("w")))
    n_full = full.join(small(n_want), "comp").groupBy("comp").agg(F.first("w").alias("w"), F.expr(f"1 + count(*) div {block}").alias("f"))
    n_full = small(settle(n_full))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).alias("own")
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    left = want.join(n_full, "comp").select("doc_id", "comp", own(F.col("w")), other("f")).select("doc_id", "comp", F.col("own").alias("x"), F.col("other").alias("y"), F.lit(True).alias("outer"))
    right = full.join(n_full, "comp").select("doc_id", "comp", own(F.col("f")), other("w")).select("doc_id", "comp", F.col("other").alias("x"), F.col("own").alias("y"), F.lit(False).alias("outer"))
    both = settle(left.union(right))
    texts = _texts(docs, reps, both.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        out, rows, cols = [], group[group["outer"]], group[~group["outer"]].reset_index(drop=True)
        if len(rows) and len(cols):
            every, sets = _bytes_of(cols["sig"]), [None] * len(cols)
            for doc_id, sig, text in rows[["doc_id", "sig", "text"]].itertuples(index=False):
                score = _matches(np.broadcast_to(np.frombuffer(sig, np.uint8), every.shape), every, least)
                own = _shingle_set(text, shingle_words)
                for k in np.argsort(-score, kind="stable")[: int((score >= 0).sum())]:
                    if sets[k] is None:
                        sets[k] = _shingle_set(cols["text"].iat[k], shingle_words)
                    if _linked(own, sets[k], percent):
                        out.append((doc_id, cols["doc_id"].iat[k], cols["comp"].iat[k]))
                        break
        return pd.DataFrame(out, columns=["a", "b", "comp"]).astype("int64")

    both = both.join(reps.select("doc_id", "sig"), "doc_id").join(texts, "doc_id")
    return both.groupBy("comp", "x", "y").applyInPandas(meet, "a long, b long, comp long")


def _shingle_rows(shingles: int):
    """A function from Arrow batches of (doc_id, text) to batches of (doc_id, shingle), each shingle once."""

    def run(batches):
        for batch in batches:
            ids, (data, at) = batch.column(0).to_numpy(), K.text_bytes(batch.column(1))
            for i, j in K.slices(at):
                part = data[at[i] : at[j]]
                starts, ends, words_at = K.word_bounds(part, at[i : j + 1] - at[i])
                words, sets = K.word_hashes(part, starts, ends, lower=True), []
                for a, b in zip(words_at[:-1], words_at[1:], strict=True):
                    own = words[a:b]
                    sets.append(np.unique(K.window_hashes(own, min(shingles, len(own)))) if len(own) else own)
                whose = np.repeat(ids[i:j], [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(whose), pa.array(np.concatenate(sets).view(np.int64))], ["doc_id", "shingle"])

    return run


def _sharing(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, single): how many shingles no other of the texts has (those with none have no row)."""
    each = texts.select("doc_id", "text").mapInArrow(_shingle_rows(shingle_words), "doc_id long, shingle long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("single"))


def _among(docs: DataFrame, minor: DataFrame, found: DataFrame, more: DataFrame, reps: DataFrame, least: list[int], shingle_words: int, percent: int) -> DataFrame:
    """Links (a, b) of minor members of one bucket: enough of them in each block to join what belongs together.

    What two linked sets share is at most what either shares with any member at all. So a member with too
    few such shingles is left out, and a bucket in which none could be the smaller end of a link as well.
    Buckets are dealt into blocks; a group holds two blocks, or one. What no batch of hashes
    prunes is verified there, the likeliest first, in the first bucket that a pair has in common,
    unless its components were joined in the group.
    """
    comp = found.select(F.col("id").alias("doc_id"), F.col("component_id").alias("comp"))
    new = more.groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("new"))
    rows = minor.select("band", "doc_id").join(comp, "doc_id", "left").join(new, "doc_id", "left")
    rows = settle(rows.select("band", "doc_id", F.coalesce("new", "comp", "doc_id").alias("comp")))
    many = settle(rows.groupBy("band").agg(F.count_distinct("comp").alias("c")).filter("c > 1").select("band"))
    rows = rows.join(small(many), "band", "left_semi")
    texts = _texts(docs, reps, rows.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))
    about = reps.select("doc_id", "n_shingles").join(texts.select("doc_id"), "doc_id", "left_semi").join(_sharing(texts, shingle_words), "doc_id", "left")
    about = about.withColumn("met", F.col("n_shingles") - F.coalesce("single", F.lit(0)))
    about = about.filter(f"100 * met >= {percent} * n_shingles").select("doc_id", "n_shingles", "met")
    rows = settle(rows.join(about, "doc_id"))
    least_end = F.expr(f"bool_or({100 + percent} * met >= {2 * percent} * n_shingles)")
    crowds = rows.groupBy("band").agg(F.expr(f"1 + (count(*) - 1) div {AMONG}").alias("blocks"), F.count_distinct("comp").alias("c"), least_end.alias("any"))
    rows = settle(rows.join(small(settle(crowds.filter("c > 1 and any").drop("c", "any"))), "band"))
    own = rows.groupBy("doc_id").agg(F.collect_set("band").alias("own"))
    places = F.transform("bands", lambda b: F.when(F.array_contains("own", b), b).otherwise(F.lit(0)))
    held = reps.join(own, "doc_id").select("doc_id", "sig", places.alias("bands")).join(texts, "doc_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "doc_id", "comp", "n_shingles", "met", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        out, band, across = [], group["band"].iat[0], group["i"].iat[0] != group["j"].iat[0]
        sigs, bands = _bytes_of(group["sig"]), np.array(group["bands"].tolist())
        ids, n, met, block = (group[c].to_numpy() for c in ("doc_id", "n_shingles", "met", "own"))
        part = np.unique(group["comp"], return_inverse=True)[1]
        texts, sets = group["text"].tolist(), [None] * len(ids)
        for k in range(len(ids)):
            fits = (100 + percent) * np.minimum(met, met[k]) >= percent * (n + n[k])
            near = np.flatnonzero(fits & (part != part[k]) & (ids > ids[k]) & ((block != block[k]) if across else True))
            alike = (bands[near] == bands[k]) & (bands[k] != 0)
            near = near[bands[k][alike.argmax(1)] == band] if len(near) else near
            if not len(near):
                continue
            score = _matches(np.broadcast_to(sigs[k], (len(near), HASHES)), sigs[near], least)
            for z in near[np.argsort(-score, kind="stable")[: int((score >= 0).sum())]]:
                if part[z] == part[k]:
                    continue
                for x in (k, z):
                    sets[x] = _shingle_set(texts[x], shingle_words) if sets[x] is None else sets[x]
                if _linked(sets[k], sets[z], percent):
                    out.append((ids[k], ids[z]))
                    part[part == part[z]] = part[k]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.join(held, "doc_id").groupBy("band", "i", "j").applyInPandas(meet, "a long, b long").distinct()

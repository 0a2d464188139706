"""Set-similarity join of documents on word shingles, without missed links: a grouped prefix join.

Method. Tokens (52-bit shingle hashes) get one global order: those found to be frequent come last, by frequency; the rest
stand in hash order. Any fixed order gives exact results; this one only keeps frequent shingles out of the prefixes. With
similarity ``t`` two sets can only link when they share one of their first ``n - ceil(t n) + 1`` tokens. Prefixes here are
a third longer, which makes the guarantee a count: linked sets share at least ``needed(n)`` of their prefix tokens.
Documents with the same prefix and size collapse into one group and are posted once. A group leaves when fewer than
``needed(n)`` of its prefix tokens are posted by another group that is still there (two rounds). The posting lists of the
rest, sorted by size, link neighbours of compatible size (``|a| >= t |b|``), which filters group pairs; the connected
components of these candidate links are *families*: no link can cross two of them. The distinct sets of a family are
fetched once each; inside a task the pairs of its groups are formed through an index of prefix tokens, filtered by size and
by ``needed``, expanded to their members and verified by integer arithmetic. A family above ``block_tokens`` is dealt in
blocks by size and each pair of size-compatible blocks is one task, so that no task holds more than two blocks.

Equal sets are one class, so that exact copies cost nothing; the result has a row for every document. Shingles are known by
hashes of 52 bits: results are exact but for clashes of these.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.session import bounded_batches

from .common import blocks, list_array, mix, ranges, shingles, temporary, utf8, written
from .components import components

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
#: Frequent tokens kept for the global order: in each task, and at last (the bound on what is broadcast: 16 bytes each).
FREQUENT_TASK, FREQUENT = 4096, 65536
#: Tokens of sets in one block of a family; 8 bytes each.
BLOCK_TOKENS = 1_500_000
#: Members that are verified against one set at a time.
_SLICE = 64
#: A posting list of a token that is this frequent is dealt over SALTS lists, whose heads are then linked.
HOT, SALTS = 2000, 64


def _frequent(size: int):
    def run(batches):
        token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            raw, offs = utf8(batch.column(0))
            for i, j in blocks(offs):
                new, _ = shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                new, n = np.unique(new, return_counts=True)
                token, count = np.concatenate([token, new[n > 1]]), np.concatenate([count, n[n > 1]])
            token, back = np.unique(token, return_inverse=True)
            count = np.bincount(back, weights=count, minlength=len(token)).astype(np.int64)
            if len(token) > 4 * FREQUENT_TASK:
                top = np.argpartition(-count, 4 * FREQUENT_TASK)[: 4 * FREQUENT_TASK]
                top.sort()
                token, count = token[top], count[top]
        top = np.argsort(-count, kind="stable")[:FREQUENT_TASK]
        yield pa.RecordBatch.from_arrays([pa.array(token[top].view(np.int64)), pa.array(count[top])], names=["token", "n"])

    return run


def frequent_tokens(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) and estimated document counts of those that repeat most; at most ``FREQUENT``."""
    found = texts.mapInArrow(_frequent(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["n"].to_numpy(np.int64)[order]


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    """floor(4/3 (1 - t) n) + 1, never below the classic n - ceil(t n) + 1."""
    return n * 4 * (t.denominator - t.numerator) // (3 * t.denominator) + 1


def needed(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Prefix tokens that a set of n shingles shares at least with any set that it links with.

    Of a set's prefix of q tokens at most n - overlap are alone, so that both prefixes hold the first
    min(q_a - n_a, q_b - n_b) + overlap common tokens; overlap >= t / (1 + t) (n_a + n_b), and n_b lies in [t n_a, n_a / t].
    """
    share, part = float(t / (1 + t)), float(1 - t) * 4 / 3
    own = prefix_length(n, t) - n + share * (n + np.ceil(n * float(t) - 1e-9))
    most = np.floor(n / float(t) + 1e-9)
    other = (part - 1) * most + share * (n + most)
    return np.maximum(1, np.ceil(np.minimum(own, other) - 1e-6)).astype(np.int64)


def _sets(size: int, t: Fraction, tokens, counts):
    """(id, text) batches -> id, n, needed, sig1, sig2 of the set, p1, p2 of the prefix, prefix, cold: how many of it aren't hot."""

    def run(batches):
        known, seen = tokens.value, counts.value
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            for i, j in blocks(offs):
                h, row = shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                rows = j - i
                n = np.bincount(row, minlength=rows)
                order, freq = _in_order(h, row, known, seen)
                ends = np.cumsum(n)
                p = np.where(n > 0, prefix_length(n, t), 0)
                take = order[np.repeat(ends - n, p) + ranges(p)]
                token = h[take]
                cold = np.bincount(np.repeat(np.arange(rows), p), weights=freq[take] < HOT, minlength=rows).astype(np.int32)
                sums = [
                    np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64),
                    np.zeros(len(token) + 1, np.uint64), np.zeros(len(token) + 1, np.uint64)
                ]
                for out, of, salt in zip(
                    sums, (h, h, token, token),
                    (0x9E6C63D0676A9A99, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
                ):
                    np.cumsum(mix(of ^ np.uint64(salt)), out=out[1:])
                pend = np.cumsum(p)
                spans = [s[e] - s[e - c] for s, e, c in zip(sums, (ends, ends, pend, pend), (n, n, p, p))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, rows), pa.array(n.astype(np.int64)), pa.array(needed(n, t)),
                        *(pa.array(x.view(np.int64)) for x in spans), list_array(pa.array(token.view(np.int64)), p),
                        pa.array(cold)
                    ],
                    names=["id", "n", "needed", "sig1", "sig2", "p1", "p2", "prefix", "cold"],
                )

    return run


def _posted(groups: DataFrame, t: Fraction) -> DataFrame:
    """(gid, n, token, salt) of prefix tokens that are posted by several groups which may still link with another."""
    posted = groups.select("gid", "cold", F.posexplode("prefix").alias("pos", "token"))
    salt = F.when(F.col("pos") < F.col("cold"), 0).otherwise(1 + F.pmod(F.xxhash64("gid"), F.lit(SALTS))).cast("int")
    posted = posted.select("gid", "token", salt.alias("salt"))
    sizes = groups.select("gid", "n", "needed")
    for _ in range(2):
        # Lists of hot tokens are dealt by salt; their tokens always count as shared.
        shared = F.count("*").over(Window.partitionBy("token", "salt"))
        posted = written(posted.withColumn("c", shared).where("c > 1 or salt > 0").drop("c"), "jaccard-posted")
        counted = posted.groupBy("gid").agg(F.count("*").alias("c"))
        alive = written(counted.join(sizes, "gid").where("c >= needed").select("gid", "n"), "jaccard-alive")
        posted = posted.join(alive.select("gid"), "gid", "left_semi")
    return posted.join(alive, "gid")


def _candidate_links(posted: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) group ids that share a prefix token and whose sizes allow a link, neighbours in each list only."""
    by = Window.partitionBy("token", "salt").orderBy("n", "gid")
    fits = F.expr(f"before.n * {t.denominator}L >= n * {t.numerator}L")
    chain = posted.select("gid", "n", "token", "salt", F.lag(F.struct("gid", "n")).over(by).alias("before"))
    chain = chain.where("before is not null or salt > 0")
    links = chain.where(
        F.col("before").isNotNull() & (fits | (F.col("salt") > 0))
    ).select(F.col("before.gid").alias("a"), F.col("gid").alias("b"))
    heads = chain.where("salt > 0 and before is null").select("token", "salt", "gid")
    ahead = F.lag("gid").over(Window.partitionBy("token").orderBy("salt"))
    return links.unionAll(heads.select(ahead.alias("a"), F.col("gid").alias("b")).where("a is not null")).distinct()


def linked_within(left: list[np.ndarray], right: list[np.ndarray] | None, t: Fraction) -> np.ndarray:
    """Labels (positions) of sets joined by links: within ``left``, or between ``left`` and ``right`` (numbered on).

    Sets come in the global order of tokens. Those of one prefix and size are one group; pairs of groups are formed through
    an index of prefix tokens and filtered by size and by the number of prefix tokens that they share; the members of pairs
    that are left are verified by exact overlaps, a bounded slice at a time. Members whose labels agree by then need none.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    if not len(sets):
        return label
    prefixes, need = prefix_length(sizes, t), needed(sizes, t)
    groups: dict[tuple[int, bytes], int] = {}
    group = np.array([groups.setdefault((len(s), s[:q].tobytes()), len(groups)) for s, q in zip(sets, prefixes.tolist())])
    _, first = np.unique(group, return_index=True)
    by_group = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[by_group], np.arange(len(groups) + 1))
    split = len(left) if right is not None else 0

    def members(g: int, side: int) -> np.ndarray:
        mine = by_group[cuts[g] : cuts[g + 1]]
        return mine if right is None else mine[mine < split] if side == 0 else mine[mine >= split]

    # Postings of prefix tokens: a row for each group that has a partner.
    posted = [g for g in range(len(groups)) if len(members(g, 1))]
    values = np.concatenate([sets[first[g]][: prefixes[first[g]]] for g in posted])
    owner = np.repeat(np.array(posted), prefixes[first[posted]])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    num, den = t.numerator, t.denominator
    n, least = sizes[first], need[first]
    for g in range(len(groups)):
        asked = members(g, 0)
        if not len(asked):
            continue
        prefix = sets[first[g]][: prefixes[first[g]]]
        low, high = np.searchsorted(values, prefix), np.searchsorted(values, prefix, side="right")
        shared = np.bincount(owner[np.repeat(low, high - low) + ranges(high - low)], minlength=len(groups))
        near = np.flatnonzero(shared >= np.maximum(least, least[g]))
        near = near[(den * np.minimum(n[near], n[g]) >= num * np.maximum(n[near], n[g]))]
        if right is None:
            near = near[near >= g]  # each pair of groups once, and a group with itself
        if not len(near):
            continue
        partners = np.concatenate([members(x, 1) for x in near.tolist()])
        for x in asked.tolist():
            open_ = partners[(label[partners] != label[x]) & (partners != x)]
            own = np.sort(sets[x])
            while len(open_):
                some, open_ = open_[:_SLICE], open_[_SLICE:]
                tokens = np.concatenate([sets[y] for y in some.tolist()])
                at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                both = np.bincount(
                    np.repeat(np.arange(len(some)), sizes[some]), weights=own[at] == tokens, minlength=len(some)
                ).astype(np.int64)
                for y in some[both * den >= num * (sizes[x] + sizes[some] - both)].tolist():
                    if label[x] != label[y]:
                        a, b = sorted((label[x], label[y]))
                        label[label == b] = a
                open_ = open_[label[open_] != label[x]]
    return label


def _verify(t: Fraction):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "side"]).sort_values(["side", "rep"], kind="stable")
        rep = pdf["rep"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        k = int((pdf["side"] == 0).sum())
        label = linked_within(sets[:k], sets[k:] if k < len(sets) else None, t)
        far = label != np.arange(len(label))
        return pd.DataFrame({"a": rep[far], "b": rep[label[far]]})

    return run


def _in_order(h: np.ndarray, row: np.ndarray, known: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the tokens in the global order, row by row; frequency of each); tokens come in hash order within a row."""
    freq = np.zeros(len(h), np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        freq = np.where(known[at] == h, seen[at], 0)
    return np.argsort((row << 40) | freq, kind="stable"), freq


def _fetch(size: int, tokens, counts):
    """(rep, n, sig1, sig2, unit, side, text) -> (rep, unit, side, tokens): the set again, if it is the one meant."""

    def run(batches):
        known, seen = tokens.value, counts.value
        for batch in batches:
            raw, offs = utf8(batch.column(batch.schema.get_field_index("text")))
            units = batch.column(batch.schema.get_field_index("units"))
            for i, j in blocks(offs):
                h, row = shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                n = np.bincount(row, minlength=j - i)
                ends = np.cumsum(n)
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ np.uint64(0x9E6C63D0676A9A99)), out=sums[1:])
                sig = (sums[ends] - sums[ends - n]).view(np.int64)
                same = np.flatnonzero(sig == batch.column(batch.schema.get_field_index("sig1")).slice(i, j - i).to_numpy())
                data, reps = h[_in_order(h, row, known, seen)[0]].tobytes(), batch.column(
                    batch.schema.get_field_index("rep")
                ).slice(i, j - i).to_pylist()
                out = [
                    (reps[k], u["unit"], u["side"], data[8 * (ends[k] - n[k]) : 8 * ends[k]]) for k in same.tolist()
                    for u in units[i + k].as_py()
                ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, kind)
                            for c, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.binary()))
                        ],
                        names=["rep", "unit", "side", "tokens"]
                    )

    return run


def ngram_jaccard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
    similarity: Fraction = SIMILARITY, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Shingle counts and connected components of documents whose shingle sets have a Jaccard index of ``similarity`` or more.

    Returns (id long, n_shingles long, component_id long), one row for every input row; other columns aren't read.
    Null or empty texts and texts of white space only have n_shingles 0 and link with nothing (component_id is their own
    id). A null id gives a row with a null component_id and links with nothing. Repeated rows and equal texts link with
    one another. An empty table gives an empty one. Shingles are compared by 52-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with temporary() as keep:
        tokens, counts = frequent_tokens(texts.select("text"), size)
        shared = spark.sparkContext.broadcast(tokens), spark.sparkContext.broadcast(counts)
        sets = written(
            texts.mapInArrow(
                _sets(size, similarity, *shared),
                "id long, n long, needed long, sig1 long, sig2 long, p1 long, p2 long, prefix array<long>, cold int"
            ),
            "jaccard-sets"
        )
        keep(sets)
        info = sets.select("id", "n", "sig1", "sig2", "p1", "p2")
        full = info.where("n > 0 and id is not null")

        # Groups of one prefix and size; classes of one set. Both are named by their smallest id.
        group_of = full.groupBy("n", "p1", "p2").agg(F.min("id").alias("gid"))
        one = sets.where("n > 0 and id is not null").groupBy("n", "p1", "p2").agg(
            F.min("id").alias("gid"), F.any_value("prefix").alias("prefix"), F.any_value("cold").alias("cold"),
            F.max("needed").alias("needed")
        )
        links = _candidate_links(_posted(one, similarity), similarity)
        families = written(components(links, "jaccard-families"), "jaccard-family")
        classes = full.groupBy("n", "p1", "p2", "sig1", "sig2").agg(F.min("id").alias("rep"))
        classes = classes.join(group_of, ["n", "p1", "p2"]).join(
            families.select(F.col("node").alias("gid"), F.col("component").alias("family")), "gid", "left"
        )
        classes = written(
            classes.select("rep", "n", "sig1", "sig2", F.coalesce("family", "gid").alias("family")), "jaccard-classes"
        )

        keep(classes)
        # Units of work: a family whole, or pairs of its blocks.
        sizes = classes.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).where("members > 1")
        # Written, so that the join meets a plain exchange, which Spark can split where a family is hot.
        sizes = written(sizes.select("family", "tokens"), "jaccard-sizes")
        placed = classes.join(sizes, "family")
        whole = placed.where(F.col("tokens") <= block_tokens).select(
            "rep", "sig1",
            F.array(F.struct(F.col("family").cast("string").alias("unit"), F.lit(0).alias("side"))).alias("units")
        )
        large = _block_units(placed.where(F.col("tokens") > block_tokens), similarity, block_tokens)
        units = whole.unionAll(large)
        fetched = units.join(texts.withColumnRenamed("id", "rep"), "rep").mapInArrow(
            _fetch(size, *shared), "rep long, unit string, side int, tokens binary"
        )
        found = fetched.groupBy("unit").applyInPandas(_verify(similarity), "a long, b long")
        joined = keep(components(found, "jaccard-links"))

    rep_of = classes.select("n", "sig1", "sig2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    rep_of = rep_of.select("n", "sig1", "sig2", F.coalesce("component", "rep").alias("component_id"))
    out = full.select("id", "n", "sig1", "sig2").join(rep_of, ["n", "sig1", "sig2"]).select(
        "id", F.col("n").alias("n_shingles"), "component_id"
    )
    rest = info.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionAll(rest)


def _block_units(placed: DataFrame, t: Fraction, block_tokens: int) -> DataFrame:
    """Units for families above one block: every class joins the units of its block with each size-compatible block.

    Blocks are cut by size, from a histogram of sizes that is pre-aggregated, so that no task sorts a whole family; many
    classes of one size are dealt over several blocks by hash.
    """
    histogram = placed.groupBy("family", "n").agg(F.count("*").alias("c"))
    before = F.sum(F.col("c") * F.col("n")).over(
        Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    )
    half = block_tokens // 2
    spread = histogram.select(
        "family", "n", F.floor(F.coalesce(before, F.lit(0)) / half).alias("block"),
        F.ceil(F.col("c") * F.col("n") / half).cast("int").alias("parts")
    )
    at = placed.join(spread, ["family", "n"]).select(
        "family", "rep", "n", "sig1",
        F.concat_ws(
            ".", "block",
            F.when(F.col("parts") > 1, F.concat(F.lit("s"), "n", F.lit("-"), F.pmod(F.xxhash64("rep"), "parts")))
        ).alias("block")
    )
    known = at.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = known.alias("a"), known.alias("b")
    compatible = F.expr(
        f"a.family = b.family and a.block <= b.block and a.high * {t.denominator}L >= b.low * {t.numerator}L and b.high * {t.denominator}L >= a.low * {t.numerator}L"
    )
    pairs = a.join(b, compatible).select(
        F.col("a.family").alias("family"), F.col("a.block").alias("left"), F.col("b.block").alias("right")
    )
    unit = F.concat_ws("|", "family", "left", "right")
    mine = pairs.select(
        "family", F.col("left").alias("block"), F.struct(unit.alias("unit"), F.lit(0).alias("side")).alias("u")
    )
    other = pairs.where("left <> right").select(
        "family", F.col("right").alias("block"), F.struct(unit.alias("unit"), F.lit(1).alias("side")).alias("u")
    )
    todo = mine.unionAll(other).groupBy("family", "block").agg(F.collect_list("u").alias("units"))
    return at.join(todo, ["family", "block"]).select("rep", "sig1", "units")

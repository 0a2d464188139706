"""Improbable-feature digests of documents.

Every 64-byte window of a text gets the Shannon entropy of its bytes, kept exactly in integers while the window slides.
Windows rank by how rare their entropy is over all documents (a corpus histogram of ``LEVELS`` entropy levels); in each run
of 64 consecutive windows the rarest one scores a point, the first of equals, and windows with ``POPULAR`` points are the
features. Each feature's hash sets ``PROBES`` bits in a Bloom filter of 2048 bits; a filter that holds ``FULL`` features
is closed and the next one in the chain begins. Likeness of two digests: every filter of the shorter chain takes its best
bit overlap with a filter of the other, normalised from what chance gives to what is possible; the mean is the likeness.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import bounded_batches

from .common import byte_codes, parts_for, prefix_hash, span_hash, utf8, written

WINDOW = 64
LEVELS = 1024
POPULAR = 16
BITS, PROBES, FULL = 2048, 5, 160
_PIECE = 1 << 18
_ONE = 1 << 20
_C = np.arange(WINDOW + 1)
#: count * log2(count), in units of 2**-20.
_COST = np.round(_C * np.log2(np.maximum(_C, 1)) * _ONE).astype(np.int64)
_LOSE, _GAIN = np.append(0, _COST[:-1] - _COST[1:]), np.append(_COST[1:] - _COST[:-1], 0)


def entropy_levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS - 1) of each 64-byte window of the bytes."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    # Equal bytes among the 63 before and the 63 after each byte; both updates of a step of the window need only these.
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (raw[d:] == raw[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    m = n - WINDOW + 1
    total = np.empty(m, np.int64)
    total[0] = _COST[np.bincount(raw[:WINDOW])].sum()
    if m > 1:
        step = _LOSE[after[: m - 1] + np.int64(1)] + _GAIN[before[WINDOW : WINDOW + m - 1]]
        np.cumsum(step, out=total[1:])
        total[1:] += total[0]
    # Entropy is 6 - total / 64 bits, from 0 to 6.
    level = ((6 * WINDOW * _ONE - total) * (LEVELS - 1)) // (6 * WINDOW * _ONE)
    return level.astype(np.int16)


def entropy_histogram(texts: DataFrame) -> np.ndarray:
    """Windows of each entropy level over all rows of the one text column; LEVELS numbers."""

    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            raw, offs = utf8(batch.column(0))
            for i in range(0, len(raw), _PIECE):
                part = raw[i : i + _PIECE + WINDOW - 1]
                level = entropy_levels(part)
                if len(level):
                    start = i + np.arange(len(level))
                    inside = start + WINDOW <= offs[np.searchsorted(offs, start, side="right")]
                    total += np.bincount(level[inside], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["level", "n"])

    rows = texts.mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS, np.int64)
    for r in rows:
        out[r["level"]] = r["n"]
    return out


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each level: 0 for the rarest; levels of equal counts rank by level."""
    out = np.empty(LEVELS, np.int64)
    out[np.lexsort((np.arange(LEVELS), histogram))] = np.arange(LEVELS)
    return out


def features(raw: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows, in order; a text below a window is one feature, an empty one none."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64)
    if len(raw) < WINDOW:
        return span_hash(prefix_hash(byte_codes(raw)), np.array([0]), np.array([len(raw)]))
    out = []
    overlap = 4 * WINDOW  # a window's points come from the 63 windows before and after it
    for i in range(0, len(raw), _PIECE):
        lo, hi = max(0, i - overlap), min(len(raw), i + _PIECE + overlap)
        part = raw[lo:hi]
        r = rank[entropy_levels(part)]
        key = (r << 32) | np.arange(len(r))
        width = min(WINDOW, len(key))
        pad = np.concatenate([key, np.full(-len(key) % width, 1 << 62)]).reshape(-1, width)
        ahead, behind = np.minimum.accumulate(pad, axis=1).ravel(), np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        runs = len(key) - width + 1
        won = np.minimum(behind[:runs], ahead[width - 1 : width - 1 + runs]) & 0xFFFFFFFF
        points = np.bincount(won, minlength=len(key))
        chosen = np.flatnonzero(points >= min(POPULAR, runs))
        chosen = chosen[(chosen + lo >= i) & (chosen + lo < i + _PIECE)]
        out.append(span_hash(prefix_hash(byte_codes(part)), chosen, chosen + WINDOW))
    return np.concatenate(out)


def features_of(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """:func:`features` of many texts; short ones share the passes over one buffer."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    group, size = [], 0
    for k, text in enumerate(texts):
        if len(text) > _PIECE:
            out[k] = features(np.frombuffer(text, np.uint8), rank)
            continue
        if size + len(text) > _PIECE:
            _features_of_group(texts, group, rank, out)
            group, size = [], 0
        group.append(k)
        size += len(text)
    _features_of_group(texts, group, rank, out)
    return out


def _features_of_group(texts: list[bytes], group: list[int], rank: np.ndarray, out: list[np.ndarray]) -> None:
    raw = np.frombuffer(b"".join(texts[k] for k in group), np.uint8)
    size = np.array([len(texts[k]) for k in group], np.int64)
    start = np.cumsum(size) - size
    prefix = prefix_hash(byte_codes(raw))
    tiny = np.flatnonzero((size > 0) & (size < WINDOW))
    for k, h in zip(tiny.tolist(), span_hash(prefix, start[tiny], start[tiny] + size[tiny])):
        out[group[k]] = np.array([h], np.uint64)
    level = entropy_levels(raw)
    if not len(level):
        return
    windows = np.maximum(size - WINDOW + 1, 0)
    key = (rank[level] << 32) | np.arange(len(level))
    won = []
    # Texts of fewer windows than a run has are one run; the runs of others are all of 64 windows inside the text.
    for k in np.flatnonzero((windows > 0) & (windows <= WINDOW)).tolist():
        won.append(np.array([key[start[k] : start[k] + windows[k]].min() & 0xFFFFFFFF]))
    if len(key) > WINDOW:
        pad = np.concatenate([key, np.full(-len(key) % WINDOW, 1 << 62)]).reshape(-1, WINDOW)
        ahead, behind = np.minimum.accumulate(pad, axis=1).ravel(), np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        runs = np.where(windows > WINDOW, windows - WINDOW + 1, 0)
        at = np.repeat(start, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        won.append(np.minimum(behind[at], ahead[at + WINDOW - 1]) & 0xFFFFFFFF)
    if not won:
        return
    points = np.bincount(np.concatenate(won), minlength=len(key))
    chosen = np.flatnonzero(points)
    owner = np.searchsorted(start, chosen, side="right") - 1
    enough = points[chosen] >= np.minimum(POPULAR, np.maximum(windows[owner] - WINDOW + 1, 1))
    chosen, owner = chosen[enough], owner[enough]
    hashes = span_hash(prefix, chosen, chosen + WINDOW)
    cuts = np.searchsorted(owner, np.arange(len(group) + 1))
    for k in np.flatnonzero(windows).tolist():
        out[group[k]] = hashes[cuts[k] : cuts[k + 1]]


def digest(feature: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, (filters, BITS / 8) bytes. A feature that the open filter holds already isn't counted again."""
    filters = []
    while len(feature):
        # As many features as fill one filter with FULL distinct ones.
        _, first = np.unique(feature, return_index=True)
        end = len(feature) if len(first) <= FULL else np.sort(first)[FULL]
        bits = np.zeros(BITS, bool)
        for k in range(PROBES):
            bits[((feature[:end] >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        filters.append(np.packbits(bits))
        feature = feature[end:]
    return np.array(filters, np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests, two empty ones included; 0 where just one is empty."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    one, two = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    total = 0.0
    for k in range(len(a)):
        both = np.bitwise_count(a[k] & b).sum(axis=1)
        most = np.minimum(one[k], two)
        chance = one[k] * two / BITS
        total += max(0.0, float(((both - chance) / np.maximum(most - chance, 1e-9)).max()))
    return min(1.0, total / len(a))


def encoded(filters: np.ndarray) -> str:
    """``filters:base64``."""
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def edited(own: str, following: str) -> str:
    """The text whose last floor(n / 2) code points are replaced by the first as many, or all, of the next one."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def _rows(pairs: list[tuple], rank: np.ndarray) -> list[tuple]:
    """Result rows of (id, text, digest, next text, next digest)."""
    changed = [edited(own, following).encode() for _, own, _, following, _ in pairs]
    out = []
    for (doc_id, own, mine, _, other), data, found in zip(pairs, changed, features_of(changed, rank)):
        new = digest(found)
        out.append(
            (
                doc_id, len(own), hashlib.sha256(data).hexdigest(), encoded(mine), encoded(new), likeness(mine, new),
                likeness(mine, other)
            )
        )
    return out


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())
]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chained(shared):
    """Rows of one range of ids, in descending order: a result for each but the last, and the range's two ends."""

    def run(batches):
        rank, part = shared.value, TaskContext.get().partitionId()
        last = None

        def out(rows, ends=()):
            cols = [
                pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)
            ] if rows else [pa.array([], kind) for _, kind in _FIELDS]
            n, m = len(rows), len(ends)
            cols = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in cols]
            end_cols = list(zip(*ends)) if ends else [(), (), (), ()]
            extra = [
                pa.concat_arrays([pa.nulls(n, kind), pa.array(c, kind)])
                for c, kind in zip(end_cols, (pa.int64(), pa.string(), pa.int64(), pa.string()))
            ]
            return pa.RecordBatch.from_arrays(
                cols + extra, names=[f for f, _ in _FIELDS] + ["part", "end", "end_id", "end_text"]
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                ids, texts = batch.column(0).slice(i, 128).to_pylist(), [
                    x or "" for x in batch.column(1).slice(i, 128).to_pylist()
                ]
                digests = [digest(f) for f in features_of([x.encode() for x in texts], rank)]
                if last is None:
                    yield out([], [(part, "first", ids[0], texts[0])])
                chain = [last] * (last is not None) + list(zip(ids, texts, digests))
                last = chain[-1]
                yield out(_rows([(*a, b[1], b[2]) for a, b in zip(chain, chain[1:])], rank))
        if last is not None:
            yield out([], [(part, "last", last[0], last[1])])

    return run


def _joined(shared):
    """The last row of each range with the first text of the next."""

    def run(batches):
        rank = shared.value
        for batch in batches:
            rows = []
            for doc_id, own, following in zip(*(batch.column(k).to_pylist() for k in range(3))):
                a, b = (digest(f) for f in features_of([own.encode(), following.encode()], rank))
                rows += _rows([(doc_id, own, a, following, b)], rank)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)], names=[f for f, _ in _FIELDS]
                )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """Digest of every text and of its edited text (see :func:`edited`; the next document in descending id order).

    Returns (doc_id long, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next
    double), one row for every input row. Null texts count as empty; a null id comes last in the order; rows of equal ids
    order by a hash of the text. The only row of a table is its own next. Equal texts have equal digests. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size, = given.agg(F.sum(F.octet_length("text"))).first()
    rank = spark.sparkContext.broadcast(ranks(entropy_histogram(given.select("text"))))
    parts = parts_for(size or 0, part_bytes)
    # Ranges are found from a sample that goes to the driver: of ids and hashes, not of texts.
    order = [F.desc_nulls_last("id"), F.asc("h")]
    ranged = given.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    done = written(
        ranged.mapInArrow(_chained(rank), _SCHEMA + ", part long, end string, end_id long, end_text string"),
        "fingerprints"
    )
    # Two short rows for each range at most; empty ranges have none. Only their numbers come here.
    firsts = sorted(r["part"] for r in done.where("end = 'first'").select("part").collect())
    following = dict(zip(firsts, [*firsts[1:], *firsts[:1]]))
    if not firsts:
        return done.drop("part", "end", "end_id", "end_text")
    pairs = spark.createDataFrame(list(following.items()), "part long, next long")
    lasts = done.where("end = 'last'").select("part", "end_id", F.col("end_text").alias("own"))
    heads = done.where("end = 'first'").select(F.col("part").alias("next"), F.col("end_text").alias("following"))
    ends = lasts.join(pairs, "part").join(heads, "next").select(
        "end_id", "own", "following"
    ).mapInArrow(_joined(rank), _SCHEMA)
    return done.where("end is null").drop("part", "end", "end_id", "end_text").unionAll(ends)

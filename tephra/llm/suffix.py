"""Exact removal of long repeated strings with a logarithmic family of suffix arrays.

A rule names a unit (bytes or words) and a length. A symbol goes when it lies in a string of that many symbols that starts
anywhere else too. Whether the string that starts at one position repeats is a question to a suffix array: does a neighbour
in suffix order share the whole length?

Dealing out. Every string of ``length`` symbols has one *anchor*: of all spans of ``span`` symbols in it, the first with the
smallest hash. Equal strings have equal anchors at equal places, so strings with different anchor hashes never need to
meet. One scan turns each text into runs of starts that share an anchor (about one run per half span); counting anchor
hashes (pre-aggregated) drops all runs whose anchor occurs once. Runs over equal symbols form a class, which is collapsed
into one run that counts as often: a copy adds nothing to a suffix array. The bytes of one run of each class are fetched
and dealt into buckets of bounded size by anchor, and each bucket keeps an index family: a new batch gets a suffix array
(offsets into one shared buffer, compared up to ``length``), is merge-scanned against the existing levels for matches of
full length, and levels of equal rank merge geometrically. What the family finds in a class holds for all its runs. An
anchor with more classes than ``MOST_CLASSES`` is dealt by the hash of the whole string, which splits any hot anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import bounded_batches

from .common import blocks, byte_codes, mix, prefix_hash, ranges, span_hash, temporary, utf8, words, written

MOST_CLASSES = 4096
#: Runs that make a class hot, and ranges of hot classes that may be broadcast (32 bytes each).
HOT_RUNS, HOT_CLASSES = 1000, 200_000
#: Suffixes in a bucket on average, and in a batch of the index family.
BUCKET_SUFFIXES, BATCH_SUFFIXES = 65_536, 16_384
_POSITION_BITS = 22
_PIECE = 1 << 18
#: First bytes of code points that are symbols of their own among words: from U+3000, scripts without spaces.
_WIDE = 0xE3


@dataclass(frozen=True)
class Rule:
    """What counts as one string: ``length`` symbols of a unit, dealt out by spans of ``span`` symbols."""

    unit: str
    length: int
    span: int

    def __post_init__(self):
        if self.unit not in ("bytes", "words") or not 0 < self.span <= self.length or self.unit == "bytes" and self.length < 8:
            raise ValueError(f"not a rule: {self}")


#: Strings of 400 bytes, and passages of over 50 words.
BYTES, PASSAGES = Rule("bytes", 400, 128), Rule("words", 51, 17)


def symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code, offsets per row) of words; a code point from U+3000 on is a word of its own."""
    found, n = [], len(raw)
    p = 0
    while p < n:  # at most about _PIECE bytes at a time, cut before white space
        q = min(n, p + _PIECE)
        while q < n:
            space = np.flatnonzero(raw[p + 1 : q] <= 32)
            if len(space):
                q = p + 1 + int(space[-1])
                break
            q = min(n, q + _PIECE)
        part = raw[p:q]
        inner = np.append(0, np.append(offs[(offs > p) & (offs < q)] - p, q - p))
        start, end, _ = words(part, inner)
        wide = np.flatnonzero(part >= _WIDE)
        if len(wide):
            cuts = np.union1d(wide, wide + np.where(part[wide] >= 0xF0, 4, 3))
            k = np.searchsorted(start, cuts, side="right") - 1
            cuts = cuts[(k >= 0) & (cuts > start[k]) & (cuts < end[k])]
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        found.append((start + p, end + p, span_hash(prefix_hash(byte_codes(part)), start, end)))
        p = q
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), np.zeros(len(offs), np.int64)
    start, end, code = (np.concatenate(x) for x in zip(*found))
    return start, end, code, np.searchsorted(start, offs)


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` entries, by prefix and suffix minima of blocks of that width."""
    pad = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(codes: np.ndarray, offs: np.ndarray, rule: Rule = BYTES):
    """(row, first start in the row, number of starts, anchor hash, hash of the run's symbols) of each run of starts."""
    n, length, span = len(codes), rule.length, rule.span
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hash(codes)
    at = np.arange(n - span + 1)
    h = span_hash(prefix, at, at + span)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = _sliding_least((mix(h) & ~low) | at.astype(np.uint64), length - span + 1)
    # Runs: of each row the starts that leave room for a string, cut where the anchor changes.
    first, end = offs[:-1], offs[1:] - length + 1
    first, end = first[first < end], end[first < end]
    if not len(first):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    inside = np.searchsorted(first, change, side="right") - 1
    change = change[(inside >= 0) & (change < end[inside]) & (change > first[inside])]
    s = np.sort(np.concatenate([first, change]))
    row = np.searchsorted(offs, s, side="right") - 1
    # A row's last run ends where its starts do; all others where the next begins.
    count = np.minimum(np.append(s[1:], n), offs[row + 1] - length + 1) - s
    a = (least[s] & low).astype(np.int64)
    return row, s - offs[row], count, h[a], span_hash(prefix, s, s + count + length - 1)


def _pieces(raw: np.ndarray, offs: np.ndarray, rule: Rule):
    """(first row, first symbol in the row, codes, offsets): blocks of rows; a longer text in pieces that overlap."""
    for i, j in blocks(offs, _PIECE):
        part, o, code = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], byte_codes
        if rule.unit == "words":
            _, _, part, o = symbols(part, o)
            code = np.asarray
        size = int(o[-1])
        if j == i + 1 and size > 2 * _PIECE:
            for p in range(0, size - rule.length + 1, _PIECE):
                q = min(size, p + _PIECE + rule.length - 1)
                yield i, p, code(part[p:q]), np.array([0, q - p])
        else:
            yield i, 0, code(part), o


def _of_rule(anchor: np.ndarray, k: int) -> np.ndarray:
    """Anchors of different rules never meet."""
    return (anchor ^ mix(np.full(1, k + 1, np.uint64))).view(np.int64)


def _anchors(rules: tuple[Rule, ...]):
    """(text) -> (anchor, how many runs have it), summed over pieces of a batch."""

    def run(batches):
        for batch in batches:
            raw, offs = utf8(batch.column(0))
            for k, rule in enumerate(rules):
                for _, _, codes, o in _pieces(raw, offs, rule):
                    anchor, c = np.unique(anchor_runs(codes, o, rule)[3], return_counts=True)
                    if len(anchor):
                        yield pa.RecordBatch.from_arrays([pa.array(_of_rule(anchor, k)), pa.array(c)], names=["anchor", "c"])

    return run


def _runs(rules: tuple[Rule, ...]):
    """(id, crc, text) -> a row for each run of starts of each rule."""
    names = ["id", "crc", "rule", "start", "count", "anchor", "content"]

    def run(batches):
        for batch in batches:
            raw, offs = utf8(batch.column(2))
            for k, rule in enumerate(rules):
                for i, p, codes, o in _pieces(raw, offs, rule):
                    row, start, count, anchor, content = anchor_runs(codes, o, rule)
                    if len(row):
                        at = pa.array(row + i)
                        columns = [np.full(len(row), k, np.int8), (start + p).astype(np.int64), count.astype(np.int32)]
                        columns += [_of_rule(anchor, k), content.view(np.int64)]
                        columns = [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class SuffixLevels:
    """Suffix arrays, at levels of doubling size, of offsets into one buffer; ``repeated`` marks offsets met twice.

    ``keys[o + s]`` for s in ``shifts`` are the numbers that spell the string at offset o; they order the suffixes. A level
    keeps one of several equal suffixes, once all of them are marked.
    """

    def __init__(self, keys: np.ndarray, shifts: np.ndarray) -> None:
        self.keys, self.shifts = keys, shifts
        self.levels: list[np.ndarray | None] = []
        self.repeated = np.zeros(len(keys), bool)

    def _sorted(self, offsets: np.ndarray) -> np.ndarray:
        """The suffix array of a batch: refined key by key, and only where a key still tells tied suffixes apart."""
        first = self.keys[offsets + self.shifts[0]]
        order = np.argsort(first, kind="stable")
        out, first = offsets[order], first[order]
        tied = np.append(False, first[1:] == first[:-1])  # with the entry before
        for shift in self.shifts[1:]:
            again = np.flatnonzero(tied)
            if not len(again):
                break
            differ = again[self.keys[out[again] + shift] != self.keys[out[again - 1] + shift]]
            if not len(differ):
                continue
            group = np.cumsum(~tied)
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[differ]] = True
            mine = np.flatnonzero(mixed[group])
            key = self.keys[out[mine] + shift]
            order = np.lexsort((key, group[mine]))
            out[mine], key = out[mine][order], key[order]
            tied[mine[1:]] &= key[1:] == key[:-1]
        again = np.flatnonzero(tied)
        self.repeated[out[again]] = True
        self.repeated[out[again - 1]] = True
        return out[~tied]

    def _merged(self, level: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """Merge-scan: each suffix of the batch narrows its range in the level key by key; a range left over is a match."""
        key = self.keys[level + self.shifts[0]]
        mine = self.keys[batch + self.shifts[0]]
        low, high = np.searchsorted(key, mine, side="left"), np.searchsorted(key, mine, side="right")
        open_ = np.flatnonzero(low < high)
        for shift in self.shifts[1:]:
            if not len(open_):
                break
            mine = self.keys[batch[open_] + shift]
            bounds = []
            for right in (False, True):
                a, b = low[open_].copy(), high[open_].copy()
                while True:
                    wide = np.flatnonzero(a < b)
                    if not len(wide):
                        break
                    middle = (a[wide] + b[wide]) // 2
                    found = self.keys[level[middle] + shift]
                    up = (found <= mine[wide]) if right else (found < mine[wide])
                    a[wide] = np.where(up, middle + 1, a[wide])
                    b[wide] = np.where(up, b[wide], middle)
                bounds.append(a)
            low[open_], high[open_] = bounds
            open_ = open_[bounds[0] < bounds[1]]
        self.repeated[batch[open_]] = True
        self.repeated[level[low[open_]]] = True
        fresh = np.ones(len(batch), bool)
        fresh[open_] = False
        return np.insert(level, low[fresh], batch[fresh])

    def add(self, offsets: np.ndarray) -> None:
        batch = carried = self._sorted(offsets)
        rising = True
        for k, level in enumerate(self.levels):
            if level is None:
                if rising:
                    self.levels[k], rising = carried, False
            elif rising:
                carried, self.levels[k] = self._merged(level, carried), None
            else:
                self._merged(level, batch)
        if rising:
            self.levels.append(carried)


def _spelled(raw: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, shifts, first symbol of each row): hashes of words, or of each byte the number that 8 bytes from it spell."""
    if rule.unit == "words":
        _, _, keys, at = symbols(raw, offs)
        return keys, np.arange(rule.length), at
    padded = np.append(raw, np.zeros(7, np.uint8)).astype(np.uint64)
    keys = padded[: len(raw)].copy()
    for k in range(1, 8):
        keys = (keys << np.uint64(8)) | padded[k : k + len(raw)]
    return keys, np.append(np.arange(0, rule.length - 8, 8), rule.length - 8), offs


_FOUND = "anchor long, content long, `from` long, `to` long"


def _scan_bucket(rules: tuple[Rule, ...], batch_suffixes: int):
    """One bucket of runs, one for each class -> the ranges of starts in them that repeat."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        which = table.column("rule").to_numpy()
        for k in np.unique(which).tolist():
            mine, rule = table.filter(pa.array(which == k)), rules[k]
            raw, offs = utf8(mine.column("bytes"))
            counts, copies = mine.column("count").to_numpy().astype(np.int64), mine.column("n").to_numpy()
            keys, shifts, base = _spelled(raw, offs, rule)
            at = np.repeat(base[:-1], counts) + ranges(counts)
            family = SuffixLevels(keys, shifts)
            for i in range(0, len(at), batch_suffixes):
                family.add(at[i : i + batch_suffixes])
            owner = np.repeat(np.arange(len(counts)), counts)
            found = np.flatnonzero(family.repeated[at] | (copies > 1)[owner])
            if not len(found):
                continue
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]])
            first = np.flatnonzero(new)
            last = found[np.append(first[1:], len(found)) - 1]
            first = found[first]
            rows = owner[first]
            base = (np.cumsum(counts) - counts)[rows]
            take = pa.array(rows)
            columns = [mine.column("anchor").combine_chunks().take(take), mine.column("content").combine_chunks().take(take)]
            out.append(
                pa.Table.from_arrays(
                    [*columns, pa.array(first - base), pa.array(last - base + 1)],
                    names=["anchor", "content", "from", "to"]
                )
            )
        if out:
            return pa.concat_tables(out)
        return pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "content", "from", "to")})

    return run


_FETCHED = "rule tinyint, count int, anchor long, content long, hot boolean, n long, bytes binary"


def _fetch(rules: tuple[Rule, ...]):
    """(id, crc, text, runs) -> a row for each run, with its bytes."""
    names = ["rule", "count", "anchor", "content", "hot", "n"]

    def run(batches):
        for whole in batches:
            sizes = utf8(whole.column(whole.schema.get_field_index("text")))[1]
            for i, j in blocks(sizes):
                yield from fetch(whole.slice(i, j - i))

    def fetch(batch):
        raw, offs = utf8(batch.column(batch.schema.get_field_index("text")))
        runs = batch.column(batch.schema.get_field_index("runs"))
        per_row = np.diff(runs.offsets.to_numpy())
        row = np.repeat(np.arange(len(per_row)), per_row)
        flat = runs.flatten()
        kind, start, count = (flat.field(c).to_numpy() for c in ("rule", "start", "count"))
        for k, rule in enumerate(rules):
            mine = np.flatnonzero(kind == k)
            if not len(mine):
                continue
            size = count[mine].astype(np.int64) + rule.length - 1
            if rule.unit == "words":
                first, end, _, base = symbols(raw, offs)
                at = base[row[mine]] + start[mine]
                begin, size = first[at], end[at + size - 1] - first[at]
            else:
                begin = offs[row[mine]] + start[mine]
            # A slice of runs at a time, so that no batch outgrows 32-bit offsets.
            for a, b in blocks(np.append(0, np.cumsum(size)), 1 << 23):
                at = np.repeat(begin[a:b], size[a:b]) + ranges(size[a:b])
                ends = np.append(0, np.cumsum(size[a:b])).astype(np.int32)
                bytes_ = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(raw[at])])
                take = pa.array(mine[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*(flat.field(c).take(take) for c in names), bytes_], names=[*names, "bytes"]
                )

    return run


def _strings(rules: tuple[Rule, ...]):
    """Runs of hot anchors -> a row for each start, with 128 bits of hash of its string."""

    def run(batches):
        for whole in batches:
            for i, j in blocks(utf8(whole.column(whole.schema.get_field_index("bytes")))[1], 1 << 20):
                yield from strings(whole.slice(i, j - i))

    def strings(batch):
        kind = batch.column(batch.schema.get_field_index("rule")).to_numpy()
        for k, rule in enumerate(rules):
            part = batch.filter(pa.array(kind == k))
            if not len(part):
                continue
            raw, offs = utf8(part.column(part.schema.get_field_index("bytes")))
            count = part.column(part.schema.get_field_index("count")).to_numpy().astype(np.int64)
            within = ranges(count)
            if rule.unit == "words":
                _, _, codes, offs = symbols(raw, offs)
            else:
                codes = byte_codes(raw)
            at = np.repeat(offs[:-1], count) + within
            pair = (
                span_hash(prefix_hash(x), at, at + rule.length)
                for x in (codes, mix(codes ^ np.uint64(0xA0761D6478BD642F)))
            )
            owner = pa.array(np.repeat(np.arange(len(count)), count))
            kept = [part.column(part.schema.get_field_index(c)).take(owner) for c in ("anchor", "content", "n")]
            columns = [*kept, pa.array(within), *(pa.array(h.view(np.int64)) for h in pair)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "n", "from", "h1", "h2"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of (id, crc) that tells texts apart also where ids are null or repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))
    return docs.withColumns({"__key": key, "__crc": F.crc32(text.cast("binary"))})


def _members(runs: DataFrame, found: DataFrame) -> DataFrame:
    """All runs with what was found in their class. Hot classes are told in the map stage, so that no task gathers one."""
    by = ["anchor", "content"]
    hot = found.where(F.col("n") > HOT_RUNS)
    if hot.limit(HOT_CLASSES + 1).count() > HOT_CLASSES:
        hot = hot.limit(0)  # too many to broadcast; then none of them is a large part, and the exchange below takes all
    hot = F.broadcast(hot.drop("n"))
    cold = runs.join(hot.select(*by).distinct(), by, "left_anti")
    joined = runs.join(hot, by).unionByName(cold.join(found.drop("n"), by))
    return joined.select(
        "id", "crc", "rule", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to")
    )


def repeated_ranges(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = (BYTES,),
    most_classes: int = MOST_CLASSES, batch_suffixes: int = BATCH_SUFFIXES, bucket_suffixes: int = BUCKET_SUFFIXES,
) -> DataFrame:
    """(id, crc, rule, from, to): ranges of starts whose string also starts elsewhere; see :func:`_keyed`."""
    bounded_batches(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col).select(
        F.col("__key").alias("id"), F.col("__crc").alias("crc"), F.col(text_col).cast("string").alias("text")
    )
    least = min(r.length * (1 if r.unit == "bytes" else 2) - (r.unit == "words") for r in rules)
    schema = "id long, crc long, rule tinyint, start long, count int, anchor long, content long"
    # A passage of wide code points has three bytes a symbol; of other words a letter and a space.
    long = texts.where(F.octet_length("text") >= least)
    counted = long.select("text").mapInArrow(_anchors(rules), "anchor long, c long")
    shared = counted.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor")
    runs = long.mapInArrow(_runs(rules), schema)
    with temporary() as keep:
        # Written first, so that both sides of the join are plain exchanges and Spark can split a hot anchor's rows.
        shared = written(shared, "suffix-shared")
        runs = keep(written(runs.join(shared, "anchor", "left_semi"), "suffix-runs"))

        one = F.min(F.struct("id", "crc", "start", "rule", "count")).alias("one")
        classes = keep(written(runs.groupBy("anchor", "content").agg(F.count("*").alias("n"), one), "suffix-classes"))
        anchors = classes.groupBy("anchor").agg(F.count("*").alias("k"))
        total = classes.agg(F.sum("one.count")).first()[0] or 0
        hot = written(anchors.where(F.col("k") > most_classes).select("anchor"), "suffix-hot")
        chosen = classes.join(hot.withColumn("hot", F.lit(True)), "anchor", "left")
        chosen = chosen.select("one.*", "anchor", "content", F.coalesce("hot", F.lit(False)).alias("hot"), "n")
        run = F.struct("rule", "start", "count", "anchor", "content", "hot", "n")
        chosen = chosen.groupBy("id", "crc").agg(F.collect_list(run).alias("runs"))
        # Equal rows of one key hold the same symbols: one of them is enough here.
        fetched = texts.join(chosen.hint("shuffle_hash"), ["id", "crc"]).mapInArrow(_fetch(rules), _FETCHED)
        fetched = written(fetched, "suffix-fetched").dropDuplicates(["anchor", "content"])
        buckets = total // bucket_suffixes + 1
        by = F.pmod("anchor", F.lit(buckets)).alias("bucket")
        scanned = fetched.where("not hot").groupBy(by).applyInArrow(_scan_bucket(rules, batch_suffixes), _FOUND)
        strings = fetched.where("hot").mapInArrow(
            _strings(rules), "anchor long, content long, n long, `from` long, h1 long, h2 long"
        )
        # A string of a hot anchor repeats when it occurs twice; told by an aggregate that combines in the map stage.
        twice = strings.groupBy("h1", "h2").agg(F.sum("n").alias("c")).where("c > 1").select("h1", "h2")
        split = strings.join(twice, ["h1", "h2"], "left_semi").select(
            "anchor", "content", "from", F.expr("`from` + 1").alias("to")
        )
        found = keep(written(scanned.unionByName(split), "suffix-found"))
        found = found.join(classes.select("anchor", "content", "n"), ["anchor", "content"])
    return _members(runs, found)


def _merged(parts) -> list[list[int]]:
    """Spans sorted, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(rules: tuple[Rule, ...], columns: list[str], as_text: bool):
    """(..., text, ranges) -> n_bytes, n_removed, spans, kept (first rule) and clean (all rules) beside what passes."""

    def run(batches):
        for batch in batches:
            for i, j in blocks(utf8(batch.column(batch.schema.get_field_index("__text")))[1]):
                yield cut(batch.slice(i, j - i))

    def in_bytes(part: np.ndarray, kind: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[list[list[int]]]:
        """Byte spans of one text, by rule."""
        out = []
        for k, rule in enumerate(rules):
            mine = kind == k
            a, b = begin[mine], end[mine] + rule.length - 1
            if len(a) and rule.unit == "words":
                first, last, _, _ = symbols(part, np.array([0, len(part)]))
                a, b = first[a], last[b - 1]
            out.append(list(zip(a.tolist(), b.tolist())))
        return out

    def cut(batch):
        raw, offs = utf8(batch.column(batch.schema.get_field_index("__text")))
        data = raw.tobytes()
        sizes, spans, kept, clean = np.diff(offs), [], [], []

        def rest(begin: int, size: int, gone: list[list[int]]) -> bytes:
            edges = [0, *(e for m in gone for e in m), size]
            return b"".join(data[begin + a : begin + b] for a, b in zip(edges[::2], edges[1::2]))

        def whole(begin: int, size: int, gone: list[list[int]]) -> list[list[int]]:
            """The spans, widened to whole characters."""
            out = []
            for a, b in gone:
                while a > 0 and data[begin + a] & 0xC0 == 0x80:
                    a -= 1
                while b < size and data[begin + b] & 0xC0 == 0x80:
                    b += 1
                out.append((a, b))
            return _merged(out)

        found = batch.column(batch.schema.get_field_index("__ranges"))
        many = found.value_lengths().fill_null(0).to_numpy()
        flat = found.flatten()
        columns_ = [flat.field(c).to_numpy() for c in ("rule", "from", "to")]
        ends = np.cumsum(many)
        removed = np.zeros(len(many), np.int64)
        for k, (i, j) in enumerate(zip((ends - many).tolist(), ends.tolist())):
            begin, size = int(offs[k]), int(sizes[k])
            first, every = [], []
            if i < j:
                by_rule = in_bytes(raw[begin : begin + size], *(c[i:j] for c in columns_))
                first = _merged(by_rule[0])
                every = _merged(x for part in by_rule for x in part) if any(by_rule[1:]) else first
            spans.append([{"start": a, "end": b} for a, b in first])
            removed[k] = sum(b - a for a, b in first)
            kept.append(rest(begin, size, whole(begin, size, first) if as_text else first))
            if len(rules) > 1:
                clean.append(rest(begin, size, whole(begin, size, every)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        as_strings = lambda texts: pa.array([x.decode() for x in texts], pa.string())
        values = [
            pa.array(sizes), pa.array(removed), pa.array(spans, kind),
            as_strings(kept) if as_text else pa.array(kept, pa.binary())
        ]
        if len(rules) > 1:
            values.append(as_strings(clean))
        passed = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        names = ["n_bytes", "n_removed", "spans", "kept", "clean"][: len(values)]
        return pa.RecordBatch.from_arrays([*passed, *values], names=[*columns, *names])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    rules: tuple[Rule, ...] = (BYTES,), as_text: bool = False, **sizes: int,
) -> DataFrame:
    """The columns ``keep`` (the id by default) and n_bytes long, n_removed long, spans array<struct<start, end>>, kept binary.

    Spans and ``kept`` are in bytes of UTF-8 and by the first rule. With more rules there is ``clean`` too, a string: what
    no rule removes. A null or empty text has 0 bytes and no spans; texts shorter than a rule's length keep all. A null id
    is allowed. Repeated rows repeat one another, so both lose their texts. An empty table gives an empty one. Spans of a
    rule on bytes may cut inside a UTF-8 sequence, therefore ``kept`` is binary; with ``as_text`` it is text without the
    characters of which a byte goes, as is ``clean``. A rule on words removes from the first byte of the first to the last byte of the last
    word, and takes words for equal whatever white space stands between. One row for every input row.
    """
    keep = [id_col] if keep is None else keep
    found = repeated_ranges(docs, id_col, text_col, rules, **sizes)
    one = F.collect_list(F.struct("rule", "from", "to")).alias("__ranges")
    ranges_ = found.groupBy("id", "crc").agg(one).withColumnsRenamed({"id": "__key", "crc": "__crc"})
    renamed = [f"__{i}" for i in range(len(keep))]
    text = F.col(text_col).cast("string").alias("__text")
    keyed = _keyed(docs, id_col, text_col).select(
        "__key", "__crc", text, *(F.col(c).alias(r) for c, r in zip(keep, renamed))
    )
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = [*(f"{r} {kinds[c]}" for c, r in zip(keep, renamed)), "n_bytes long", "n_removed long"]
    schema += ["spans array<struct<start: long, end: long>>", "kept " + ("string" if as_text else "binary")]
    schema += ["clean string"] if len(rules) > 1 else []
    given = keyed.join(ranges_.hint("shuffle_hash"), ["__key", "__crc"], "left").select(*renamed, "__text", "__ranges")
    return given.mapInArrow(_cut(rules, renamed, as_text), ", ".join(schema)).withColumnsRenamed(dict(zip(renamed, keep)))

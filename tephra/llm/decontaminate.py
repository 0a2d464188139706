"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND by every passage.

Each text is cut into passages of ``PASSAGE`` words that overlap by half, at least twice the longest item, so that an
item that stands in a text stands whole in one passage. A passage is a query of its distinct words. For an item the
search must reach ``SHARE`` of the item's own score. As that threshold is known when the index is built, so is the pivot of
each item: its terms by falling impact up to the first that those after can't do without. Postings of terms up to the pivot
are the only ones that start a candidate. For each candidate block of items the sum of the block's maximal impacts over the
passage's terms bounds the score (the maxima are kept sparsely, one for each term and block that meet); blocks below their
smallest threshold are skipped, the others are scored in full. Everything above the threshold is verified: distinct word
shingles of the item's question and of its answer found in the passage. Where either has so few shingles that one changed
word could take more than the allowed part of them, the item is verified as a whole.

Document frequencies, lengths and the width of passages come from all items. An index holds ``INDEX_ITEMS`` of them; one
pass over the texts searches as many indexes as fit in ``PASS_BYTES``, with each text tokenized once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import bounded_batches

from .common import blocks, byte_codes, prefix_hash, ranges, span_hash, utf8, words

K1, B = 1.2, 0.75
SHARE = 0.6
#: Verification: share of an item's shingles (of five words) in the passage, for its question and its answer.
SHINGLE, OVERLAP = 5, 0.75
#: Shingles of a part below which one changed word takes more than 1 - OVERLAP of them.
SHORT = int(SHINGLE / (1 - OVERLAP))
BLOCK_ITEMS = 64
#: Items in one index, and bytes of indexes that are broadcast for one pass (measured; about 1.2 KB an item).
INDEX_ITEMS, PASS_BYTES = 20_000, 512 << 20
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of words: runs of ASCII letters and digits and of all bytes above ASCII, A-Z in lower case."""
    clean = np.where(_KEEP[raw], raw, 32).astype(np.uint8)
    start, end, row = words(clean, offs)
    return span_hash(prefix_hash(byte_codes(clean, lower=True)), start, end), row


@dataclass
class ItemIndex:
    items: np.ndarray  # item ids
    terms: np.ndarray  # sorted distinct term hashes
    essential_at: np.ndarray  # items that term k can start: essential_item[essential_at[k]..essential_at[k + 1]]
    essential_item: np.ndarray
    block_key: np.ndarray  # sorted term * blocks + block of the pairs that meet
    block_max: np.ndarray  # their maximal impact, float32, rounded up
    threshold: np.ndarray
    block_least: np.ndarray
    item_at: np.ndarray  # terms of item k: item_at[k]..item_at[k + 1], ascending
    item_term: np.ndarray
    item_impact: np.ndarray
    shingle_at: np.ndarray  # shingles of item k, the last bit of each tells question (0) and answer (1)
    shingle: np.ndarray
    item_words: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.block_least)

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))


@dataclass
class Statistics:
    """Of all items: term hashes and in how many items each stands, items, their mean and largest number of words."""

    terms: np.ndarray
    df: np.ndarray
    items: int = 0
    words: int = 0
    longest: int = 0

    @classmethod
    def empty(cls) -> Statistics:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, texts: list[str]) -> None:
        raw, offs = utf8(pa.array(texts, pa.large_string()))
        h, row = tokens(raw, offs)
        order = np.lexsort((h, row))
        once = np.ones(len(h), bool)  # of each item and term
        once[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        met = h[order][once]
        terms, inverse = np.unique(np.concatenate([self.terms, met]), return_inverse=True)
        self.df = np.bincount(
            inverse, weights=np.concatenate([self.df, np.ones(len(met))]), minlength=len(terms)
        ).astype(np.int64)
        self.terms = terms
        length = np.bincount(row, minlength=len(texts))
        self.items, self.words = self.items + len(texts), self.words + int(length.sum())
        self.longest = max(self.longest, int(length.max()) if len(length) else 0)


def _answer_from(text: str) -> int:
    """Where the answer begins: the last line; of a single line the last sentence; else the last half of the words."""
    body = text.rstrip()
    cut = body.rfind("\n")
    if cut < 0:
        cut = max(body.rfind(x, 0, len(body) - 1) for x in (". ", "? ", "! "))
    return cut + 1 if cut >= 0 else 0


def build_index(ids: list[int], texts: list[str], known: Statistics | None = None) -> ItemIndex:
    """Index of items, with the statistics of all (of these by default); items without words are never found."""
    if known is None:
        known = Statistics.empty()
        known.add(texts)
    raw, offs = utf8(pa.array(texts, pa.large_string()))
    h, row = tokens(raw, offs)
    n = len(ids)
    length = np.bincount(row, minlength=n)
    terms, of = np.unique(h, return_inverse=True)
    pair, tf = np.unique(row.astype(np.int64) * max(len(terms), 1) + of, return_counts=True)
    item, term = pair // max(len(terms), 1), pair % max(len(terms), 1)
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * length / max(known.words / max(known.items, 1), 1e-9))
    impact = (idf[term] * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32).astype(np.float64)
    threshold = SHARE * np.bincount(item, weights=impact, minlength=n)
    # The terms up to the pivot: all but the smallest impacts that together stay below the threshold.
    order = np.lexsort((impact, item))
    sums = np.cumsum(impact[order])
    starts = np.searchsorted(item[order], np.arange(n))
    before = np.concatenate([[0.0], sums])[starts]
    essential = np.zeros(len(item), bool)
    essential[order] = sums - before[item[order]] >= threshold[item[order]] - 1e-6
    by_term = np.lexsort((item, term))
    ess = by_term[essential[by_term]]
    blocks = max(-(-n // BLOCK_ITEMS), 1)
    block_key, at = np.unique(term * blocks + item // BLOCK_ITEMS, return_inverse=True)
    block_max = np.zeros(len(block_key), np.float32)
    np.maximum.at(block_max, at, impact.astype(np.float32) * np.float32(1.000001))
    padded = np.full(blocks * BLOCK_ITEMS, np.inf)
    padded[:n] = threshold
    # Shingles of question and answer; a shingle that crosses the cut belongs to the answer.
    cut = np.array([len(t[: _answer_from(t)].encode()) for t in texts], np.int64)
    clean = np.where(_KEEP[raw], raw, 32).astype(np.uint8)
    start, _, _ = words(clean, offs)
    size = np.minimum(length, SHINGLE)
    begin = np.arange(len(h))
    first = np.concatenate([[0], np.cumsum(length)])
    begin = begin[begin + size[row] <= first[row + 1]] if len(begin) else begin
    owner = row[begin]
    last = begin + size[owner] - 1
    answer = (start[last] - offs[owner] >= cut[owner]).astype(np.uint64) if len(begin) else np.zeros(0, np.uint64)
    shingle = (span_hash(prefix_hash(h), begin, begin + size[owner]) & ~np.uint64(1)) | answer
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[new], shingle[new]
    return ItemIndex(
        np.array(ids, np.int64), terms, np.searchsorted(term[ess], np.arange(len(terms) + 1)),
        item[ess].astype(np.int32), block_key, block_max,
        threshold, padded.reshape(-1, BLOCK_ITEMS).min(axis=1), np.searchsorted(item, np.arange(n + 1)),
        term.astype(np.int32), impact.astype(np.float32),
        np.searchsorted(owner, np.arange(n + 1)), shingle, length.astype(np.int32),
    )


def _expand(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in keys, position in the postings) of all postings of the keys."""
    count = at[keys + 1] - at[keys]
    return np.repeat(np.arange(len(keys)), count), np.repeat(at[keys], count) + ranges(count)


def search(index: ItemIndex, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all items that reach their threshold; (passage, term) pairs are distinct and sorted."""
    who, post = _expand(index.essential_at, term)
    wide = index.blocks
    item = index.essential_item[post].astype(np.int64)
    mine = passage[who] * wide + item // BLOCK_ITEMS
    block, which = np.unique(mine, return_inverse=True)  # candidate (passage, block)
    if not len(block):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    p, b = block // wide, block % wide
    at = np.searchsorted(passage, np.arange(n + 1))
    live = np.empty(len(p), bool)
    for i in range(0, len(p), 4096):  # the bound of each candidate block
        pair, pos = _expand(at, p[i : i + 4096])
        wanted = term[pos] * wide + b[i : i + 4096][pair]
        found = np.minimum(np.searchsorted(index.block_key, wanted), len(index.block_key) - 1)
        weight = index.block_max[found] * (index.block_key[found] == wanted)
        live[i : i + 4096] = np.bincount(
            pair, weights=weight, minlength=len(p[i : i + 4096])
        ) >= index.block_least[b[i : i + 4096]] - 1e-6
    open_ = live[which]
    pair = np.unique(passage[who][open_] * len(index.items) + item[open_])
    p, item = pair // len(index.items), pair % len(index.items)
    # Full scores: the item's terms that the passage has.
    key = passage * max(len(index.terms), 1) + term
    score = np.zeros(len(p))
    for i in range(0, len(p), 65536):
        who, pos = _expand(index.item_at, item[i : i + 65536])
        wanted = p[i : i + 65536][who] * len(index.terms) + index.item_term[pos]
        found = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        score[i : i + 65536] = np.bincount(
            who, weights=index.item_impact[pos] * (key[found] == wanted), minlength=len(p[i : i + 65536])
        )
    hit = score >= index.threshold[item] - 1e-6
    return p[hit], item[hit], score[hit]


def _find(shared: list, longest: int, overlap: float):
    """(id, text) -> pairs found; every text is tokenized once and searched in all indexes."""
    # At least twice the longest item: then half of it, the overlap, holds any item whole.
    step = max(64, 2 * longest) // 2

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw_all, offs_all = utf8(batch.column(1))
            for i, j in blocks(offs_all) if longest else ():
                h, row = tokens(raw_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i])
                count = np.bincount(row, minlength=j - i)
                cells = -(-count // step)  # words of a text in cells of half a passage; passage k is cells k and k + 1
                base = np.cumsum(cells) - cells
                cell = base[row] + ranges(count) // step
                for index in (x.value for x in shared):
                    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
                    known = np.flatnonzero(index.terms[at] == h) if len(index.terms) else ()
                    if not len(known):
                        continue
                    cell_of, term = cell[known], at[known]
                    before = cell_of > base[row[known]]
                    key = np.unique(
                        np.concatenate(
                            [cell_of, cell_of[before] - 1]
                        ) * len(index.terms) + np.concatenate([term, term[before]])
                    )
                    passage, item, score = search(index, key // len(index.terms), key % len(index.terms), int(cells.sum()))
                    if len(passage):
                        owner = np.repeat(np.arange(j - i), cells)[passage]
                        yield from _verified(
                            index, ids, i, h, count, owner, passage, passage - base[owner], item, score, step, overlap
                        )

    return run


def _verified(index, ids, i, h, count, owner, passage, place, item, score, step, overlap):
    """Shares of the item's question and answer shingles in each passage found, for those that have enough of them."""
    first = np.cumsum(count) - count
    prefix = prefix_hash(h)
    sets: dict[tuple[int, int], np.ndarray] = {}  # of one passage at a time
    shares, good, last = np.ones((len(passage), 2)), [], -1
    for k in np.argsort(passage, kind="stable").tolist():
        if passage[k] != last:
            sets, last = {}, passage[k]
        o = owner[k]
        low = first[o] + place[k] * step
        high = min(first[o] + count[o], low + 2 * step)
        size = min(SHINGLE, int(index.item_words[item[k]]))
        have = sets.get((low, size))
        if have is None:
            begin = np.arange(low, max(low, high - size + 1))
            have = sets[low, size] = np.unique(span_hash(prefix, begin, begin + size) & ~np.uint64(1))
        mine = index.shingle[index.shingle_at[item[k]] : index.shingle_at[item[k] + 1]]
        part = (mine & np.uint64(1)).astype(np.int64)
        got = np.bincount(part[np.isin(mine & ~np.uint64(1), have)], minlength=2)
        full = np.bincount(part, minlength=2)
        shares[k] = np.where(full > 0, got / np.maximum(full, 1), 1.0)
        if (full < SHORT).any():
            enough = got.sum() >= overlap * full.sum()
        else:
            enough = (shares[k] >= overlap).all()
        if enough:
            good.append(k)
    if good:
        m = np.array(good)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(owner[m] + i)), pa.array(index.items[item[m]]), pa.array(score[m]),
                pa.array(shares[m, 0]), pa.array(shares[m, 1])
            ],
            names=["id", "item_id", "bm25", "question_overlap", "answer_overlap"],
        )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", overlap: float = OVERLAP
) -> DataFrame:
    """(id long, item_id long, bm25, question_overlap, answer_overlap double): test items found in texts, one row a pair.

    Null, empty and wordless texts and items give no rows, nor do items of null id; texts of null id keep it. An item shorter
    than five words is one shingle of all its words. Items in which question or answer has fewer than ``SHORT`` shingles need
    ``overlap`` of all their shingles, others of both parts. Repeated items of one id, and texts of one id, count once, with
    the best passage. Texts of any length are searched whole; no column of either table but id and text is looked at.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = items.select(
        F.col(item_col).cast("long").alias("item_id"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")
    )
    known = known.where("item_id is not null").distinct()
    parts = -(-max(known.count(), 1) // INDEX_ITEMS)

    def part(k: int):
        return known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").toPandas()

    total = Statistics.empty()
    kept = {}
    for k in range(parts):
        rows = part(k)
        total.add(rows["text"].tolist())
        kept = {k: rows}  # of several parts only the last is held
    schema = "id long, item_id long, bm25 double, question_overlap double, answer_overlap double"
    out, shared, size = None, [], 0
    for k in reversed(range(parts)):
        rows = kept.pop(k, None)
        rows = part(k) if rows is None else rows
        index = build_index(rows["item_id"].astype(int).tolist(), rows["text"].tolist(), total)
        shared.append(spark.sparkContext.broadcast(index))
        size += index.nbytes()
        if size >= PASS_BYTES or k == 0:
            found = given.mapInArrow(_find(shared, total.longest, overlap), schema)
            out = found if out is None else out.unionAll(found)
            shared, size = [], 0
    return out.groupBy("id", "item_id").agg(*(F.max(c).alias(c) for c in ("bm25", "question_overlap", "answer_overlap")))

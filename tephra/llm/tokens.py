"""Token ids as binary shards with a minimal perfect hash index.

Documents are dealt out by ranges of ids, sorted, tokenized with a public tokenizer file and packed: a *shard* is one raw
payload of little-endian ids of consecutive documents, of bounded size (two bytes an id where the vocabulary allows it).
Payloads are rows of a Parquet table, which gives Spark's commit protocol and any file system that Spark knows. The index
maps a document's key to (shard, offset, length): keys
are dealt into buckets by hash, and each bucket is a minimal perfect hash of cascaded bit arrays; a key's slot is the
number of set bits before its bit. A slot stores a 32-bit fingerprint of its key, which tells absent keys, and no key.

Tokenizing. The tokenizer's pattern never crosses white space, so a text's ids are those of its words one after the other;
each batch encodes only words that its worker hasn't met yet, with an end token between them.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.session import bounded_batches

from .common import blocks, byte_codes, mix, parts_for, prefix_hash, ranges, span_hash, utf8, written

END_ID = 2
#: Ids in a shard, unless one document has more; and keys in a bucket of the index on average.
SHARD_IDS, BUCKET_KEYS = 2_000_000, 2000
_GAMMA, _LEVELS = 2.0, 64
#: Bytes of bits between two stored ranks.
_RANK_BYTES = 32
_JOINED = 2000
_BLOCK = 2 << 20
_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        # A task has one core; threads of the tokenizer's own would only take others' and an allocator's arena each.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, where each word's begin, how many). Words are encoded in long lines, told apart by a special token that none contains."""
    tokenizer = _encoder(path)
    mark = "<|endoftext|>"
    special = tokenizer.token_to_id(mark)
    odd = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False) if special is not None else np.ones(len(words), bool)
    plain = words.filter(pa.array(~odd)).to_pylist()
    ids, sizes = [], []
    for i in range(0, len(plain), 32 * _JOINED):
        lines = [
            f" {mark} ".join(plain[k : k + _JOINED]) + f" {mark}"
            for k in range(i, min(len(plain), i + 32 * _JOINED), _JOINED)
        ]
        for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            found = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(found == special)
            sizes.append(np.diff(cuts, prepend=-1) - 1)
            ids.append(np.delete(found, cuts))
    lengths = np.zeros(len(words), np.int64)
    if plain:
        sizes = np.concatenate(sizes)
        if len(sizes) != len(plain):
            raise ValueError("a word's ids hold the mark between words")
        lengths[~odd] = sizes
    at = np.zeros(len(words), np.int64)
    at[~odd] = np.cumsum(lengths[~odd]) - lengths[~odd]
    end = int(lengths.sum())
    for k in np.flatnonzero(odd).tolist():
        ids.append(np.array(tokenizer.encode(words[k].as_py(), add_special_tokens=False).ids, np.uint32))
        at[k], lengths[k] = end, len(ids[-1])
        end += len(ids[-1])
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), at, lengths


class Vocabulary:
    """Ids of words met before, kept in the worker from task to task; at most ``MOST_WORDS``.

    Words are found by a 64-bit hash and then compared, so that two of one hash never get each other's ids.
    """

    MOST_WORDS = 1_500_000

    def __init__(self, path: str):
        self.path = path
        self.hashes, self.at, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.place, self.words, self.ids = np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(0, np.uint32)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :func:`encode_words`, for distinct words; only those not met before reach the tokenizer."""
        h = self.hash(words)
        where = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[where] == h if len(self.hashes) else np.zeros(len(h), bool)
        held = np.flatnonzero(known)
        same = pc.equal(
            self.words.take(pa.array(self.place[where[held]])), words.take(pa.array(held))
        ) if len(held) else pa.array([], pa.bool_())
        known[held] = same.to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(~known)
        new = words.take(pa.array(fresh))
        ids, at, lengths = encode_words(new, self.path)
        out_at, out_n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        out_at[known], out_n[known] = self.at[where[known]], self.lengths[where[known]]
        out_at[fresh], out_n[fresh] = at + len(self.ids), lengths
        every = np.concatenate([self.ids, ids])
        if len(self.hashes) + len(fresh) <= self.MOST_WORDS:
            order = np.argsort(h[fresh], kind="stable")
            # Of words of one hash the first stays.
            first = np.append(True, h[fresh][order][1:] != h[fresh][order][:-1]) if len(order) else np.zeros(0, bool)
            order = order[first]
            put = np.searchsorted(self.hashes, h[fresh][order])
            order, put = (x[~self._has(h[fresh][order])] for x in (order, put))
            values = (h[fresh], out_at[fresh], lengths, np.arange(len(self.words), len(self.words) + len(fresh)))
            olds = (self.hashes, self.at, self.lengths, self.place)
            self.hashes, self.at, self.lengths, self.place = (
                np.insert(old, put, v[order].astype(old.dtype)) for old, v in zip(olds, values)
            )
            self.words = pa.concat_arrays([self.words, new])
            self.ids = every
        return every, out_at, out_n

    @staticmethod
    def hash(words: pa.Array) -> np.ndarray:
        raw, offs = utf8(words)
        return span_hash(prefix_hash(byte_codes(raw)), offs[:-1], offs[1:])

    def _has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h


_vocabularies: dict[str, Vocabulary] = {}


def encode_texts(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets); null counts as empty; ``end_id`` closes each text."""
    # A letter or digit always ends before punctuation, so a space between them changes no id and fewer words differ.
    spread = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([\pL\pN])([.,!?;:]+)", r"\1 \2")
    split = pc.ascii_split_whitespace(spread)
    per_text = np.diff(split.offsets.to_numpy().astype(np.int64))
    coded = split.flatten().cast(pa.string()).dictionary_encode()
    ids, at, lengths = _vocabularies.setdefault(path, Vocabulary(path)).encode(coded.dictionary)
    word = coded.indices.to_numpy(zero_copy_only=False)
    n = lengths[word]
    total = np.append(0, np.cumsum(n))
    ends = np.cumsum(per_text)
    size = total[ends] - total[ends - per_text] + (end_id is not None)
    offs = np.append(0, np.cumsum(size)).astype(np.int64)
    out = np.empty(offs[-1], np.uint32)
    if end_id is not None:
        out[offs[1:] - 1] = end_id
        body = np.ones(offs[-1], bool)
        body[offs[1:] - 1] = False
        out[body] = ids[np.repeat(at[word], n) + ranges(n)]
    else:
        out[:] = ids[np.repeat(at[word], n) + ranges(n)]
    return out, offs


def _shards(path: str, end_id: int, wide: bool, most: int):
    """Sorted (id, text) of one range -> shards: (shard, n_ids, payload, entries of id, occurrence, offset, length)."""
    kind = pa.struct([("id", pa.int64()), ("occurrence", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        shard = TaskContext.get().partitionId() << 24
        payload, entries, n, last, times = [], [], 0, (object(),), 0

        def out():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()), pa.array([n], pa.int64()),
                    pa.array([b"".join(payload)], pa.binary()), pa.array([entries], pa.list_(kind))
                ],
                names=["shard", "n_ids", "payload", "entries"]
            )

        for batch in batches:
            for lo, hi in blocks(utf8(batch.column(1))[1], _BLOCK):
                keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                ids, offs = encode_texts(batch.column(1).slice(lo, hi - lo), path, end_id)
                raw = ids.astype("<u4" if wide else "<u2")
                for k, key in enumerate(keys):
                    length = int(offs[k + 1] - offs[k])
                    if n and n + length > most:
                        yield out()
                        shard, payload, entries, n = shard + 1, [], [], 0
                    times = times + 1 if (key,) == last else 0
                    last = (key,)
                    # Rows of null id are told from those of id 0 by negative occurrences.
                    entries.append(
                        {
                            "id": key, "occurrence": times if key is not None else -1 - times, "offset": n,
                            "length": length
                        }
                    )
                    payload.append(raw[offs[k] : offs[k + 1]].tobytes())
                    n += length
        if entries:
            yield out()

    return run


def key_hashes(ids: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) ^ mix(occurrences.astype(np.int64).view(np.uint64)))


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct keys, and each key's slot."""
    levels, slot, left, base = [], np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    while len(left):
        if len(levels) == _LEVELS:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        size = max(8, int(_GAMMA * len(left)) | 7)
        at = (
            mix(keys[left] + np.uint64(len(levels) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)
        ).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        levels.append(bits)
        base += int(bits.sum())
        left = left[~alone]
    return levels, slot


def packed(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, bits, ranks): bits of all levels as bytes, each level in whole blocks, and the set bits before each block."""
    sizes = np.array([len(x) for x in levels], np.int64)
    padded = [np.append(x, np.zeros(-len(x) % (8 * _RANK_BYTES), bool)) for x in levels]
    bits = np.packbits(np.concatenate(padded)) if padded else np.zeros(0, np.uint8)
    counts = np.bitwise_count(bits.reshape(-1, _RANK_BYTES)).sum(axis=1, dtype=np.int64)
    return sizes, bits, np.cumsum(counts) - counts


def look_up(sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit. Keys that were not built in may get any slot: see fingerprints.

    The work for a key doesn't grow with the number of keys that were built in: on average about two levels, and in its own
    a count of the bits of one block.
    """
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, size in enumerate(sizes.tolist()):
        at = base + (mix(keys[left] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)
        hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        mine = at[hit]
        block = mine // (8 * _RANK_BYTES)
        inside = bits.reshape(-1, _RANK_BYTES)[block]
        before = np.unpackbits(inside, axis=1) & (np.arange(8 * _RANK_BYTES) < (mine % (8 * _RANK_BYTES))[:, None])
        slot[left[hit]] = ranks[block] + before.sum(axis=1)
        left = left[~hit]
        if not len(left):
            break
        base += -(-size // (8 * _RANK_BYTES)) * 8 * _RANK_BYTES
    return slot


def fingerprint_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = key_hashes(pdf["id"].to_numpy(), pdf["occurrence"].to_numpy())
    levels, slot = build_hash(keys)
    sizes, bits, ranks = packed(levels)
    put = lambda values, kind: _placed(values, slot, kind)
    return pd.DataFrame(
        {
            "bucket": [pdf["bucket"].iloc[0]], "sizes": [sizes.astype("<i8").tobytes()], "bits": [bits.tobytes()],
            "ranks": [ranks.astype("<i8").tobytes()],
            "fingerprints": [put(fingerprint_of(keys), "<u4")], "shards": [put(pdf["shard"], "<i8")],
            "offsets": [put(pdf["offset"], "<i8")], "lengths": [put(pdf["length"], "<i8")],
        }
    )


def _placed(values, slot: np.ndarray, kind: str) -> bytes:
    out = np.zeros(len(slot), kind)
    out[slot] = np.asarray(values)
    return out.tobytes()


def _find_bucket(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Locations of keys through one bucket of the index; absent keys give no row."""
    if not len(index) or not len(keys):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "occurrence", "shard", "offset", "length")})
    row = index.iloc[0]
    hashes = key_hashes(keys["id"].to_numpy(), keys["occurrence"].to_numpy())
    # The stored bytes are looked into as they are; nothing of the bucket is decoded.
    slot = look_up(
        np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["ranks"], "<i8"),
        hashes
    )
    known = slot >= 0
    known[known] = np.frombuffer(row["fingerprints"], "<u4")[slot[known]] == fingerprint_of(hashes[known])
    slot = slot[known]
    at = {c: np.frombuffer(row[c], "<i8")[slot] for c in ("shards", "offsets", "lengths")}
    return pd.DataFrame(
        {
            "id": keys["id"].to_numpy()[known], "occurrence": keys["occurrence"].to_numpy()[known],
            "shard": at["shards"], "offset": at["offsets"], "length": at["lengths"]
        }
    )


class TokenStore:
    """Written token ids: ``payloads`` (shard, n_ids, payload, entries), ``index`` (a row for each bucket) and ``buckets``."""

    def __init__(self, payloads: DataFrame, index: DataFrame, buckets: int, wide: bool):
        self.payloads, self.index, self.buckets, self.wide = payloads, index, buckets, wide

    @staticmethod
    def write(
        docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
        shard_ids: int = SHARD_IDS, part_bytes: int = 16 << 20
    ) -> TokenStore:
        """Tokenize and write every text in ascending order of ids; see the module. Null ids come first, then rows by id."""
        bounded_batches(docs.sparkSession)
        given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        size, = given.agg(F.sum(F.octet_length("text"))).first()
        parts = parts_for(size or 0, part_bytes)
        wide = _encoder(path).get_vocab_size() > 1 << 16
        order = [F.asc_nulls_first("id"), F.asc_nulls_first("text")]
        ranged = given.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
        shards = ranged.mapInArrow(
            _shards(path, end_id, wide, shard_ids),
            "shard long, n_ids long, payload binary, entries array<struct<id: long, occurrence: long, offset: long, length: long>>"
        )
        payloads = written(shards, "token-shards")
        entries = payloads.select("shard", F.explode("entries").alias("e")).select("shard", "e.*")
        entries = entries.withColumn("id", F.coalesce("id", F.lit(0)))
        buckets = entries.count() // BUCKET_KEYS + 1
        entries = entries.withColumn("bucket", F.pmod(F.xxhash64("id", "occurrence"), F.lit(buckets)))
        index = entries.groupBy("bucket").applyInPandas(
            _build_bucket,
            "bucket long, sizes binary, bits binary, ranks binary, fingerprints binary, shards binary, offsets binary, lengths binary"
        )
        return TokenStore(payloads, written(index, "token-index"), buckets, wide)

    def locate(self, keys: DataFrame) -> DataFrame:
        """(id, occurrence, shard, offset, length) of keys (id, occurrence) that are in the store."""
        keyed = keys.withColumn("bucket", F.pmod(F.xxhash64("id", "occurrence"), F.lit(self.buckets)))
        return keyed.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(
            _find_bucket, "id long, occurrence long, shard long, offset long, length long"
        )

    def read(self, keys: DataFrame) -> DataFrame:
        """(id, occurrence, start, n_tokens, ids_crc32) for keys (id, occurrence), from payloads at the index's locations."""
        found = self.locate(keys).groupBy("shard").agg(
            F.collect_list(F.struct("id", "occurrence", "offset", "length")).alias("wanted")
        )
        # Ids before a shard: those of the ranges before, one sum for each, and of the shards before in its own range.
        sizes = self.payloads.select("shard", "n_ids", F.shiftright("shard", 24).alias("range"))
        sums = sorted(sizes.groupBy("range").agg(F.sum("n_ids")).collect())
        ahead = np.cumsum([0, *(n for _, n in sums)]).tolist()
        starts = self.payloads.sparkSession.createDataFrame(
            [(r, a) for (r, _), a in zip(sums, ahead)] or [(-1, 0)], "range long, ahead long"
        )
        inner = F.sum("n_ids").over(Window.partitionBy("range").orderBy("shard")) - F.col("n_ids")
        base = sizes.withColumn("inner", inner).join(F.broadcast(starts), "range").select(
            "shard", (F.col("ahead") + F.col("inner")).alias("base")
        )
        wide = self.wide

        def run(batches):
            for batch in batches:
                for payload, start, wanted in zip(
                    *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("payload", "base", "wanted"))
                ):
                    ids = np.frombuffer(payload, "<u4" if wide else "<u2").astype("<u4")
                    at = [
                        (
                            w["id"], w["occurrence"], start + w["offset"], w["length"],
                            zlib.crc32(ids[w["offset"] : w["offset"] + w["length"]])
                        )
                        for w in wanted
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*at)],
                        names=["id", "occurrence", "start", "n_tokens", "ids_crc32"]
                    )

        # As many partitions as the payloads need, whatever the session's number is.
        parts = parts_for(ahead[-1] * (4 if wide else 2))
        wanted = found.join(base, "shard").repartition(parts, "shard").hint("shuffle_hash")
        joined = self.payloads.select("shard", "payload").repartition(parts, "shard").join(wanted, "shard")
        return joined.mapInArrow(run, "id long, occurrence long, start long, n_tokens long, ids_crc32 long")


def keys_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, occurrence) of every row, as :meth:`TokenStore.write` names them."""
    counted = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")
    return counted.select("id", at).select(
        F.coalesce("id", F.lit(0)).alias("id"),
        F.when(F.col("id").isNull(), -1 - F.col("k")).otherwise(F.col("k")).alias("occurrence")
    )

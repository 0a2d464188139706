"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by numpy SGD.

A text's features are its words and their substrings of 2 to 4 bytes of UTF-8 (A-Z lower-cased, told apart at the start and
the end of a word), hashed into ``BUCKETS`` rows of an embedding table; their mean goes through a linear layer and a softmax. Training is mini-batch stochastic gradient descent on a bounded sample of labelled rows. As the layers are
linear, the trained model is folded into one table of class scores per bucket, so that a prediction is a table look-up and
a mean over the whole text. A temperature and two rejection thresholds are fitted on a part of the sample kept from
training: one for the score of the likeliest language, one for the text's familiarity, the mean log2 of how much more often
than by chance the training texts have its subwords. A softmax is sure of texts unlike all it has learned; familiarity isn't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import bounded_batches

from .common import byte_codes, blocks, prefix_hash, span_hash, utf8, words

#: Labelled rows used for training at most, and the size in bytes up to which a row is taken: the bound on the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8000
BUCKETS, DIMENSIONS = 1 << 15, 16
LENGTHS = (2, 3, 4)
EPOCHS, BATCH, RATE = 12, 64, 2.0
#: Steps that a small sample is trained for at least: with fewer, scores stay near the languages' shares and can't reject.
LEAST_STEPS = 120
#: Share of kept-out correct answers that calibrated rejection must accept, and its place in standard deviations.
ACCEPT, DEVIATIONS = 0.999, 3.09
#: Weight of an even draw in the frequencies of subwords, and kept-out rows that calibrated familiarity needs.
EVEN, LEAST_ROWS = 0.02, 10
UNKNOWN = "und"


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # class scores of each bucket, float32
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: np.ndarray  # log2 of frequency in training over chance of each bucket, float32
    least: float = 0.0
    lengths: tuple[int, ...] = LENGTHS

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Class probabilities for each row."""
        return softmax(self.measures(raw, offs)[0] / self.temperature)

    def judge(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of each row, and whether both its best score and its familiarity reach their thresholds."""
        logits, familiarity = self.measures(raw, offs)
        p = softmax(logits / self.temperature)
        return p, (p.max(axis=1) >= self.threshold) & (familiarity >= self.least)

    def measures(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class scores, familiarity) for each row."""
        bucket, row = features(raw, offs, len(self.table), self.lengths)
        n = np.bincount(row, minlength=len(offs) - 1)
        ends = np.cumsum(n)

        def means(values: np.ndarray) -> np.ndarray:
            total = np.zeros(len(bucket) + 1)
            np.cumsum(values[bucket], out=total[1:], dtype=np.float64)
            return (total[ends] - total[ends - n]) / np.maximum(n, 1)

        out = np.zeros((len(offs) - 1, len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = means(self.table[:, k])
        return out + self.bias, means(self.familiar)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(
    raw: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, lengths: tuple[int, ...] = LENGTHS
) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword and every whole word, sorted by row."""
    start, end, owner = words(raw, offs)
    prefix = prefix_hash(byte_codes(raw, lower=True))
    size = end - start
    found, rows = [span_hash(prefix, start, end) ^ np.uint64(0x5851F42D4C957F2D)], [owner]
    for k in lengths:
        many = np.maximum(size - k + 1, 0)
        total = np.cumsum(many)
        at = np.repeat(start - (total - many), many) + np.arange(total[-1] if len(total) else 0)
        h = span_hash(prefix, at, at + k)
        which = np.repeat(np.arange(len(start)), many)
        h ^= (at == start[which]).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        h ^= (at + k == end[which]).astype(np.uint64) * np.uint64(0xDA942042E4DD58B5)
        found.append(h)
        rows.append(owner[which])
    bucket = (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int32)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return bucket[order], row[order]


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text; a bounded slice of texts is hashed at a time."""
    raw, offs = utf8(pa.array(texts, pa.large_string()))
    out = []
    for i, j in blocks(offs, 1 << 18):
        bucket, row = features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], buckets)
        pair, times = np.unique(row * buckets + bucket, return_counts=True)
        cuts = np.searchsorted(pair, np.arange(j - i + 1) * buckets)
        for a, b in zip(cuts[:-1], cuts[1:]):
            out.append(((pair[a:b] % buckets).astype(np.int32), (times[a:b] / max(times[a:b].sum(), 1)).astype(np.float32)))
    return out


def train(
    texts: list[str], langs: list[str], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
    seed: int = 17
) -> LanguageModel:
    """Fit on texts and their languages; every fifth row is kept for calibration. One language, or none, is allowed."""
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(buckets, np.float32))
    target = np.array([labels.index(x) for x in langs])
    bags = _bags(texts, buckets)
    n = np.array([len(ids) for ids, _ in bags])
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4
    chosen = np.flatnonzero(~held & (n > 0))
    embed = rng.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    layer = np.zeros((dimensions, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    each = max(1, -(-len(chosen) // BATCH))
    epochs = max(epochs, -(-LEAST_STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            rows = chosen[i : i + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            # Sums by reduceat over sorted rows: large products would go to the threads of a BLAS, which fight for a busy driver.
            ids, weight = (np.concatenate([bags[r][k] for r in rows]) for k in (0, 1))
            who = np.repeat(np.arange(len(rows)), n[rows])
            hidden = np.add.reduceat(embed[ids] * weight[:, None], np.cumsum(n[rows]) - n[rows])
            wrong = softmax(hidden @ layer + bias).astype(np.float32)
            wrong[np.arange(len(rows)), target[rows]] -= 1
            wrong /= len(rows)
            back_to = wrong @ layer.T
            layer -= rate * hidden.T @ wrong
            bias -= rate * wrong.sum(axis=0)
            by_id = np.argsort(ids, kind="stable")
            sorted_ids = ids[by_id]
            first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
            embed[sorted_ids[first]] -= rate * len(rows) * np.add.reduceat((weight[:, None] * back_to[who])[by_id], first)
    often = np.zeros(buckets)
    for r in np.sort(chosen):
        often[bags[r][0]] += bags[r][1]
    familiar = np.log2((1 - EVEN) * often * buckets / max(often.sum(), 1) + EVEN).astype(np.float32)
    model = LanguageModel(labels, (embed @ layer).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, familiar)
    test = np.flatnonzero(held & (n > 0))
    if len(test):
        raw, offs = utf8(pa.array([texts[i] for i in test], pa.large_string()))
        found = [model.measures(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in blocks(offs, 1 << 18)]
        calibrate(model, np.vstack([x for x, _ in found]), np.concatenate([x for _, x in found]), target[test])
    return model


def tail(x: np.ndarray) -> float:
    """The value that a share ``ACCEPT`` of rows like the given ones reaches.

    A sample smaller than 1 / (1 - ACCEPT) has no row there: then the tail below its lowest decile is carried on, as an
    exponential one, where that lies lower than the lowest row.
    """
    low = float(np.quantile(x, 1 - ACCEPT))
    if len(x) * (1 - ACCEPT) >= 1:
        return low
    decile = float(np.quantile(x, 0.1))
    return min(low, decile - float(np.mean(decile - x[x <= decile])) * float(np.log(0.1 / (1 - ACCEPT))))


def calibrate(model: LanguageModel, logits: np.ndarray, familiarity: np.ndarray, target: np.ndarray) -> None:
    """Temperature of least log loss on rows kept from training; the thresholds then accept ``ACCEPT`` of right answers."""
    best = None
    for temperature in np.geomspace(0.02, 20, 61):
        p = softmax(logits / temperature)
        loss = -np.log(np.maximum(p[np.arange(len(target)), target], 1e-12)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = loss, float(temperature)
    model.temperature = best[1]
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == target
    if right.any():
        # Log odds straight from the class scores: of probabilities that round to 1 they still tell how sure they are.
        z = np.sort(logits[right] / model.temperature, axis=1)
        others = z[:, :-1] - z[:, -1:]
        odds = -np.log(np.maximum(np.exp(others).sum(axis=1), 1e-300))
        model.threshold = float(1 / (1 + np.exp(-tail(odds)))) - 1e-12
    if len(target) >= LEAST_ROWS:
        model.least = min(
            float(np.quantile(familiarity, 1 - ACCEPT)),
            float(familiarity.mean() - DEVIATIONS * familiarity.std(ddof=1))
        )


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES
) -> LanguageModel:
    """Train on at most ``rows`` labelled rows of at most ``most_bytes`` bytes, chosen by hash alike at every size."""
    known = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.octet_length(text_col) <= most_bytes)
    )
    sample = known.select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(order_col).cast("string")).alias("h")
    )
    # The hash of the last row taken is found first, so that only texts of the sample reach the driver.
    last = sample.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return train([], [])
    found = sample.where(F.col("h") <= last).orderBy("h", "lang", F.xxhash64("text")).limit(rows).collect()
    return train([r["text"] for r in found], [r["lang"] for r in found])


def _predict(shared, columns: list[str]):
    def run(batches):
        model = shared.value
        labels = np.array(model.labels or [UNKNOWN], object)
        for batch in batches:
            raw, offs = utf8(batch.column(batch.schema.get_field_index("__text")))
            letters = batch.column(batch.schema.get_field_index("__letters")).to_numpy(zero_copy_only=False).astype(bool)
            lang, score, taken = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.zeros(len(letters), bool)
            for i, j in blocks(offs, 1 << 18) if model.labels else ():
                p, taken[i:j] = model.judge(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lang[i:j], score[i:j] = labels[p.argmax(axis=1)], p.max(axis=1)
            lang[~letters], score[~letters] = UNKNOWN, 0.0
            taken &= letters
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(lang, pa.string()),
                    pa.array(np.clip(score, 0, 1)), pa.array(taken)
                ],
                names=[*columns, "lang_pred", "score", "accepted"]
            )

    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but those of these names by default) and lang_pred string, score double, accepted boolean.

    A null text and one without a letter get ``und``, score 0 and are not accepted; nor are texts whose calibrated score or
    familiarity is below the model's threshold, although these keep their likeliest language. A model without languages
    gives ``und``. One row for every input row, ties, null ids and repeated rows included; texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")] if keep is None else keep
    renamed = [f"__{i}" for i in range(len(keep))]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    given = docs.select(
        *(F.col(c).alias(r) for c, r in zip(keep, renamed)), F.col(text_col).cast("string").alias("__text"),
        letters.alias("__letters")
    )
    schema = ", ".join(
        [*(f"{r} {kinds[c]}" for c, r in zip(keep, renamed)), "lang_pred string", "score double", "accepted boolean"]
    )
    out = given.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), renamed), schema)
    return out.withColumnsRenamed(dict(zip(renamed, keep)))


def is_held_out(id_col: str = "doc_id"):
    """True for the documents that no model here learns from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))

"""op7 and op10 against brute force, on every edge case of their docstrings."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tephra.llm import jaccard, suffix
from tephra.llm.components import components

SCHEMA = "doc_id long, text string, id string, n long, token long, component_id long, kept string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 130, 10_000))
    docs = []
    for k in range(30):
        w = words(rng, rng.randrange(1, 120), 10_000)
        docs.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = "edit%d" % rng.randrange(99)
            docs.append(" ".join(v))
    docs += [passage, "x " + passage, passage + " y", "été " + passage[50:], "aaaa" * 400, "aaaa" * 400 + "b", "é" * 600]
    docs += [
        None, "", "  \n\t ", "one", "one", "ONE", "one two three four", "one two three four five",
        "One Two\tThree\nFour  Five"
    ]
    docs += [" ".join(words(rng, 20_000, 10**6))]
    return [(i, t, "clash", 7, 8, 9, "clash") for i, t in enumerate(docs)] + [
        (3, docs[3], "clash", 7, 8, 9, "clash"), (None, docs[5], "x", 1, 1, 1, ""), (None, None, "x", 1, 1, 1, "")
    ]


def brute_jaccard(rows, size=5):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(
        ((r[0] is None, r[0] or 0, len(sets[i]), None if r[0] is None else least[root(i)]) for i, r in enumerate(rows)),
        key=str
    )


@pytest.mark.parametrize("block_tokens, hot", [(1_500_000, 2000), (300, 2)])
def test_jaccard_is_exact(spark, monkeypatch, block_tokens, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = corpus()
    got = jaccard.ngram_jaccard(spark.createDataFrame(rows, SCHEMA), block_tokens=block_tokens).collect()
    assert sorted(((r.id is None, r.id or 0, r.n_shingles, r.component_id) for r in got), key=str) == brute_jaccard(rows)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.ngram_jaccard(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_links_within_and_between(seed):
    """Labels against all pairs: families of edited sets, many of one prefix, in an order in which rare tokens come first."""
    rng = np.random.default_rng(seed)
    t, sets = Fraction(3, 4), []
    for _ in range(12):
        base = rng.choice(5000, rng.integers(1, 60), replace=False)
        for _ in range(rng.integers(1, 9)):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.2])]
            more = rng.choice(np.arange(5000, 9000), rng.integers(0, 4), replace=False)
            mine = np.unique(np.concatenate([keep, more]))
            if len(mine):
                sets.append(mine.astype(np.uint64))
    sets = [np.array(s, np.uint64) for s in {tuple(s.tolist()) for s in sets}]  # distinct sets, tokens ascending: one order for all
    linked = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))

    def want(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            if linked(sets[i], sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
        return label

    n = len(sets)
    assert jaccard.linked_within(sets, None, t).tolist() == want([(i, j) for i in range(n) for j in range(i)])
    k = n // 2
    assert jaccard.linked_within(sets[:k], sets[k:], t).tolist() == want([(i, j) for i in range(k) for j in range(k, n)])
    assert len(jaccard.linked_within([], None, t)) == 0


def test_bounds_of_prefixes():
    t = Fraction(3, 4)
    n = np.arange(1, 500)
    q, need = jaccard.prefix_length(n, t), jaccard.needed(n, t)
    assert (q >= n - -(-n * 3 // 4) + 1).all() and (q <= n).all()
    for a in range(1, 120):
        for b in range(-(-a * 3 // 4), a * 4 // 3 + 1):
            overlap = -(-3 * (a + b) // 7)
            sure = min(q[a - 1] - a, q[b - 1] - b) + overlap
            assert max(1, sure) >= need[a - 1], (a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [
        (rng.randrange(300), rng.randrange(300)) for _ in range(220)
    ] + [(k, k + 1) for k in range(1000, 1200)] + [(5, None), (7, 7)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(label)}


def brute_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append(
            (
                str(r[0]), len(t), int(gone.sum()), spans,
                hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()
            )
        )
    return sorted(out)


def repeats_corpus():
    rng = random.Random(5)
    rows = corpus(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    for k in range(40):
        a = rng.randrange(2000)
        piece = list(base[a : a + rng.randrange(300, 900)])
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = "#"
        rows.append((1000 + k, "".join(piece), "c", 1, 1, 1, "c"))
    return rows


@pytest.mark.parametrize("most_classes, batch, hot", [(4096, 8192, 1000), (1, 64, 1), (3, 64, 2)])
def test_repeats_are_exact(spark, monkeypatch, most_classes, batch, hot):
    monkeypatch.setattr(suffix, "HOT_RUNS", hot)
    rows = repeats_corpus()
    got = suffix.remove_repeats(
        spark.createDataFrame(rows, SCHEMA), most_classes=most_classes, batch_suffixes=batch, bucket_suffixes=3000
    ).collect()
    assert sorted(
        (str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got
    ) == brute_repeats(rows, 400)


WORD = re.compile(rb"(?:[\xe3-\xef]..|[\xf0-\xf4]...)|(?:(?![\xe3-\xf4])[^\x20\x09-\x0D])+", re.S)


def brute_passages(texts, length, gone=None):
    """Bytes of each text that stand in a passage of so many words that occurs twice."""
    found = [list(WORD.finditer(t)) for t in texts]
    counts = Counter(tuple(m[0] for m in f[i : i + length]) for f in found for i in range(len(f) - length + 1))
    out = gone or [np.zeros(len(t), bool) for t in texts]
    for f, g in zip(found, out):
        for i in range(len(f) - length + 1):
            if counts[tuple(m[0] for m in f[i : i + length])] > 1:
                g[f[i].start() : f[i + length - 1].end()] = True
    return out


def passages_corpus():
    rng = random.Random(11)
    rows = corpus(5)
    passage = words(rng, 51, 10**6)
    for k in range(12):
        own = words(rng, 60, 10**6)
        joined = rng.choice([" ", "\n", "  "]).join(passage[k % 3 == 2 :])  # a word less: too short
        rows.append((2000 + k, " ".join(own[:30]) + " " + joined + "\t" + " ".join(own[30:]), "c", 1, 1, 1, "c"))
    wide = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(80))
    return [*rows, (3000, "x" + wide + " y", "c", 1, 1, 1, "c"), (3001, wide[5:] + "\U0001f600", "c", 1, 1, 1, "c")]


@pytest.mark.parametrize("most_classes", [4096, 1])
def test_passages_are_exact_beside_strings_of_bytes(spark, most_classes):
    rows = passages_corpus()
    texts = [(r[1] or "").encode() for r in rows]
    frame = spark.createDataFrame(rows, SCHEMA)
    alone = suffix.remove_repeats(
        frame, keep=["doc_id", "kept"], rules=(suffix.PASSAGES,), most_classes=most_classes
    ) if most_classes > 1 else None
    gone = brute_passages(texts, 51)
    left = [bytes(np.frombuffer(t, np.uint8)[~g]).decode() for t, g in zip(texts, gone)]
    assert sum(g.any() for g in gone) > 20
    if alone is not None:
        assert alone.columns.count("kept") == 2  # a clash is the caller's to solve: both columns are there
        place = alone.columns.index("n_removed")
        assert sorted((str(r[0]), r[place]) for r in alone.collect()) == sorted(
            (str(r[0]), int(g.sum())) for r, g in zip(rows, gone)
        )
    got = suffix.remove_repeats(
        frame, rules=(suffix.PASSAGES, suffix.BYTES), as_text=True, most_classes=most_classes
    ).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(r[0]), x) for r, x in zip(rows, left))
    data = [(str(r[0]), len(t)) for r, t in zip(rows, texts)]
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted(data)
    for t, g in zip(texts, gone):
        c = brute_cover(texts, 400, t)
        g |= c
    both = [whole_characters(t, g) for t, g in zip(texts, gone)]
    assert sorted((str(r.doc_id), r.clean) for r in got) == sorted((str(r[0]), x) for r, x in zip(rows, both))


def whole_characters(text, gone):
    """Characters of which no byte is gone."""
    out, at = [], 0
    for c in text.decode():
        size = len(c.encode())
        if not gone[at : at + size].any():
            out.append(c)
        at += size
    return "".join(out)


def brute_cover(texts, length, text, known={}):
    key = id(texts), length
    if key not in known:
        known[key] = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = np.zeros(len(text), bool)
    for i in range(len(text) - length + 1):
        if known[key][text[i : i + length]] > 1:
            out[i : i + length] = True
    return out


@pytest.mark.parametrize("rule", [suffix.BYTES, suffix.PASSAGES])
def test_repeats_of_long_texts_in_pieces(monkeypatch, rule):
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(20_000)).encode()
    raw = np.frombuffer(text, np.uint8)

    def found():
        runs = [
            (p, suffix.anchor_runs(codes, o, rule))
            for _, p, codes, o in suffix._pieces(raw, np.array([0, len(raw)]), rule)
        ]
        return {int(s) + p + d: int(h) for p, (_, s, n, h, _) in runs for s, n, h in zip(s, n, h) for d in range(n)}

    whole = found()
    monkeypatch.setattr(suffix, "_PIECE", 700)
    assert found() == whole
    size = len(text) if rule.unit == "bytes" else len(text.split())
    assert len(whole) == size - rule.length + 1


def test_symbols_by_brute_force(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é日本😀—\t\n x") for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    raw, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    for piece in (1 << 18, 16):
        monkeypatch.setattr(suffix, "_PIECE", piece)
        start, end, code, at = suffix.symbols(raw, offs)
        data = raw.tobytes()
        for k, t in enumerate(texts):
            mine = [data[a:b] for a, b in zip(start[at[k] : at[k + 1]], end[at[k] : at[k + 1]])]
            assert mine == [m[0] for m in WORD.finditer(t.encode())]
        same = {}
        for a, b, c in zip(start, end, code):
            assert same.setdefault(data[a:b], c) == c
        assert len(set(same.values())) == len(same)


def test_repeats_of_an_empty_table_and_as_text(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "é" + "ab" * 300
    got = suffix.remove_repeats(
        spark.createDataFrame([(1, text, "", 0, 0, 0, "k"), (2, "x" + text, "", 0, 0, 0, "k")], SCHEMA), as_text=True
    )
    assert {(r.doc_id, r.n_removed, r.kept) for r in got.collect()} == {(1, 602, ""), (2, 602, "x")}


def test_text_loses_characters_whole(spark):
    """Both texts share bytes from within a character on; no character is left or made up out of its rest."""
    tail = "ab" * 300
    pair = ["xé" + tail, "yã" + tail]  # é is C3 A9, ã is C3 A3: nothing of them is shared but their first byte
    other = ["wũ" + tail, "vé" + tail]  # ũ is C5 A9: shares its last byte with é
    rows = [(k, t, "", 0, 0, 0, "") for k, t in enumerate(pair + other)]
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA), as_text=True).collect()}
    assert {k: r.kept for k, r in got.items()} == {0: "x", 1: "yã", 2: "w", 3: "v"}
    assert got[2].n_removed == 601 and got[0].n_removed == 602


def test_suffix_levels_double():
    rng = random.Random(1)
    for length in (8, 9, 13, 16):
        rule = suffix.Rule("bytes", length, 4)
        text = bytes(rng.choice(b"ab") for _ in range(600))
        keys, shifts, _ = suffix._spelled(np.frombuffer(text, np.uint8), np.array([0, len(text)]), rule)
        family = suffix.SuffixLevels(keys, shifts)
        at = np.arange(len(text) - length + 1)
        for i in range(0, len(at), 8):
            family.add(at[i : i + 8])
        seen = Counter(text[i : i + length] for i in at)
        assert family.repeated[: len(at)].tolist() == [seen[text[i : i + length]] > 1 for i in at]
        for level in family.levels:
            keys = [text[o : o + length] for o in level] if level is not None else []
            assert keys == sorted(set(keys))
        assert len(family.levels) <= 8


def test_rules_are_checked():
    for bad in (("lines", 4, 2), ("bytes", 4, 2), ("words", 3, 4)):
        with pytest.raises(ValueError):
            suffix.Rule(*bad)

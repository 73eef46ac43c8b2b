import random

import numpy as np
import pytest

from spanweave.llm import spans


def brute(texts, length):
    where = {}
    for k, t in texts:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(k)
    out = set()
    for k, t in texts:
        n = len(t or "")
        cover = [False] * n
        for i in range(n - length + 1):
            if len(where[t[i : i + length]]) > 1:
                cover[i : i + length] = [True] * length
        s = None
        for i in range(n + 1):
            if i < n and cover[i]:
                s = i if s is None else s
            elif s is not None:
                out.add((k, s, i))
                s = None
    return out


def corpus(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcdefgh", "xé\U0001f600 "])
    base = ["".join(rng.choices(alphabet, k=rng.randint(20, 90))) for _ in range(6)]
    texts = []
    for k in range(30):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i, j = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
            t += b[i:j] + "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        texts.append((k, t))
    return [*texts, (100, "a" * 200), (101, "a" * 77), (102, None), (103, ""), (104, texts[0][1]), (105, base[0] + base[0])]


@pytest.mark.parametrize("together", [4096, 1])
def test_brute_force(spark, together, monkeypatch):
    monkeypatch.setattr(spans, "TOGETHER", together)
    monkeypatch.setattr(spans, "CHUNK", 500)
    monkeypatch.setattr(spans, "PIECE", 64)
    for seed in range(3):
        texts = corpus(seed)
        df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, h int").repartition(3)
        got = {tuple(r) for r in spans.shared_spans(df, length=24, gram=7).collect()}
        assert got == brute(texts, 24)


def test_shares_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 10 + "abcdefghij" * 40), (2, "abcdefghij" * 40), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.n_shared, round(r.share, 3)) for r in spans.shared_share(df).collect()}
    assert got == {1: (410, 400, 0.976), 2: (400, 400, 1.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}
    assert spans.shared_spans(df.limit(0)).count() == 0


def thue_morse(n, one, other):
    return "".join((one, other)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("together", [4096, 1])
def test_unequal_texts_of_equal_hash(spark, together, monkeypatch):
    monkeypatch.setattr(spans, "TOGETHER", together)
    rng = random.Random(4)
    left, right = ("".join(rng.choices("abcdefghij ", k=150)) for _ in range(2))
    t, u = (thue_morse(128, *x) for x in (("\U00062293", "\U000f3c56"), ("\U000f3c56", "\U00062293")))
    texts = [(1, left + t + right), (2, left + u + right)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert spans.shared_spans(df).count() == 0 == len(brute(texts, 300))
    texts += [(3, "x" + left + u + right + "y"), (4, left + t + right[:-1] + "z")]
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute(texts, 300)


def test_hashes_that_all_collide(spark, monkeypatch):
    monkeypatch.setattr(spans.Hasher, "all", lambda self, size: np.zeros(len(self.sums) - size, np.uint64))
    hasher = spans.Hasher()
    for seed in range(6):
        rng = random.Random(seed)
        texts = ["".join(rng.choices("ab", k=rng.randint(9, 14))) for _ in range(12)]
        doc = np.arange(12) // 2
        before = np.array([rng.randint(0, len(t) - 5) for t in texts])
        got = spans.factors(hasher, np.zeros(12, int), doc, np.zeros(12, bool), before, texts, 5)
        have = {(int(b), i) for b, s, n in zip(*got) for i in range(int(s), int(s + n - 4))}
        at = [{(int(before[k]) - i, t[i : i + 5]) for i in range(len(t) - 4)} for k, t in enumerate(texts)]
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 4) if any((int(before[k]) - i, t[i : i + 5]) in at[j] for j in range(12) if doc[j] != doc[k])}
        assert have == want


def test_hot_anchor_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(spans, "TOGETHER", 20)
    rng = random.Random(7)
    foot = "".join(rng.choices("abcdefgh", k=40))
    texts = [(k, "".join(rng.choices("xyz", k=30)) * (k % 3) + foot + "".join(rng.choices("xy", k=k % 12))) for k in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in spans.shared_spans(df, length=24, gram=7).collect()} == brute(texts, 24)

"""Importance resampling, periodic runs and the n-gram Jaccard join against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import prose, sentences
from pyspark.sql import functions as F

from shiftledger.llm import common, jaccard, periodic, resample, signature_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


# -- importance resampling -----------------------------------------------------------------------------------------
def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return w, [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resampled(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in brute_features(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, fs = brute_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_crc_matrices_match_zlib():
    r = random.Random(1)
    data = np.frombuffer(r.randbytes(20_000), np.uint8)
    starts = np.array([r.randrange(20_000) for _ in range(500)] + [0, 7, 5, 3])
    ends = np.array([min(20_000, a + r.choice([0, 1, 2, 9, 9, 40])) for a in starts[:-4]] + [20_000, 7 + resample.LONG, 5 + resample.LONG + 1, 3 + 5 * resample.LONG])
    got = resample.crc32_spans(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_resampling_matches_brute_force(docs_of, odd_rows, spark):
    r = random.Random(8)
    bits = ["Ab ", "c", "é", "- ", "\n", "zz9 ", "Ünï ", "日本 ", "x_y ", "\x00"]
    rows = odd_rows + [(100 + k, "".join(r.choices(bits, k=r.randint(0, 120)))) for k in range(150)] + [(7000, "w" * 5000 + " " + "v" * 1300)]
    rows += [(8000, sentences(3, 60))] * 40
    target = [None, "", sentences(3, 60), "ab c zz9 x y", "日本 zz9"]
    got = resample.resampled(docs_of(rows), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")).collect()
    assert Counter(map(tuple, got)) == brute_resampled(rows, target)


def test_resampling_without_rows(docs_of, spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(docs_of([]), none).count() == 0
    got = resample.resampled(docs_of([(1, sentences(1, 40))]), none).collect()
    assert len(got) == 1 and got[0]["rank"] is None


# -- periodic runs -------------------------------------------------------------------------------------------------
def least_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(12, 2 * q) and least_period(w[i:i + n]) == q:
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(r, most=90):
    w = []
    while len(w) < r.randint(0, most):
        some = [r.choice("abc") for _ in range(r.randint(1, 14))]
        w += (some * r.randint(1, 6))[:r.randint(1, 60)] if r.random() < 0.6 else r.choices("abcdefgh", k=r.randint(1, 10))
    return w


def brute_answer(text):
    w = WORD.findall(text or "")
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_match_brute_force():
    r = random.Random(4)
    for _ in range(300):
        docs = [periodic_words(r) for _ in range(r.randint(1, 5))]
        found, _ = periodic.text_runs(*held([" ".join(w) for w in docs]))
        assert found == [brute_runs(w) for w in docs]


def test_runs_of_long_periodic_texts():
    n = 100_000
    assert periodic.text_runs(*held([" ".join(["x"] * n)]))[0] == [[(0, n, 1)]]
    week = (["a", "b", "c", "d", "e", "f", "g"] * 6000 + ["z"]) * 2
    assert periodic.text_runs(*held([" ".join(week)]))[0] == [[(0, 42000, 7), (0, 84002, 42001), (42001, 42000, 7)]]


def test_answers_match_brute_force(docs_of, odd_rows):
    r = random.Random(6)
    rows = [x for x in odd_rows if x[0] != 5] + [(100 + k, r.choice([" ", "\n\t"]).join(periodic_words(r))) for k in range(200)] + [(None, "a " * 30)]
    got = periodic.periodic_runs(docs_of(rows)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_answer(t)) for i, t in rows)
    assert periodic.periodic_runs(docs_of([])).count() == 0


def test_collapsed_texts(docs_of):
    docs = docs_of([(1, "x " + "a b " * 9 + "y"), (2, " no  repeats\n"), (3, None), (4, "")])
    out = periodic.collapsed(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {x["doc_id"]: (x["text"], x["source"], x["key"]) for x in out.collect()} == {
        1: ("x a b y", "a", 7), 2: (" no  repeats\n", "a", 7), 3: ("", "a", 7), 4: ("", "a", 7)}


def test_planted_tails(docs_of):
    def brute(i, text):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        w = WORD.findall(text or "")
        if h % 10 or not w:
            return w
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]

    rows = [(k, " ".join(prose(k, k % 50))) for k in range(300)] + [(None, "a b c"), (301, None), (302, "")]
    got = docs_of(rows).select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert {x["doc_id"]: WORD.findall(x["t"] or "") for x in got} == {i: brute(i, t) for i, t in rows}
    assert any(brute(i, t) != WORD.findall(t or "") for i, t in rows)


# -- n-gram Jaccard join -------------------------------------------------------------------------------------------
def shingles(text):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute_components(rows):
    sets = sorted({s for s in map(shingles, (t for _, t in rows)) if s}, key=sorted)
    up = list(range(len(sets)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    place = {s: find(k) for k, s in enumerate(sets)}
    least, first = {}, {}
    for i, t in rows:
        s = shingles(t)
        if s and i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
            first[s] = min(i, first.get(s, i))
    out = Counter((i, len(shingles(t)), least.get(place[shingles(t)]) if shingles(t) else i) for i, t in rows)
    return out, Counter(tuple(sorted((first[sets[a]], first[sets[b]]))) for a, b in linked)


def near_rows(r):
    rows = []
    for g in range(40):
        base = prose(300 + g, r.randint(3, 200))
        for c in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 50))):
                w[r.randrange(len(w))] = f"Edit{g}x{c}"
            rows.append((1000 + 10 * g + c, " ".join(w)))
    chain = prose(7000, 500)
    rows += [(3000 + k, " ".join(chain[8 * k:8 * k + 220])) for k in range(30)]  # each similar only to the next ones
    passage = prose(1, 150)
    rows += [(5000 + k, " ".join(prose(8000 + k, 40) + passage)) for k in range(60)]  # a passage alone links nothing
    return rows


@pytest.mark.parametrize("shard", [8, jaccard.SHARD])
def test_components_match_brute_force(docs_of, odd_rows, monkeypatch, shard):
    """With tiny shards most links are between shards."""
    monkeypatch.setattr(jaccard, "SHARD", shard)
    rows = odd_rows + near_rows(random.Random(7)) + [(6000, "A b C"), (6001, "a B c"), (6002, "a b c d")]
    r = random.Random(1)
    r.shuffle(rows)
    got = jaccard.component_ids(docs_of(rows)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)[0]


def test_every_link_is_found(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARD", 16)
    rows = near_rows(random.Random(9))
    got = jaccard.links(docs_of(rows)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)[1]


def test_join_without_words(docs_of):
    got = jaccard.component_ids(docs_of([(1, None), (2, ""), (2, " "), (None, "")])).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 0, 1), (2, 0, 2), (2, 0, 2), (None, 0, None)])
    assert jaccard.component_ids(docs_of([])).count() == 0


def test_similar_sets_share_a_key():
    """Partners of each size that lack and add as many tokens as the threshold lets them."""
    rng, r, seen = np.random.default_rng(5), random.Random(5), 0
    fresh = lambda n, odd: np.unique(rng.integers(0, 2**62, n).astype(np.uint64) * np.uint64(2) + np.uint64(odd))
    for n in [*range(1, 60), 150, 455, 2000]:
        for _ in range(20):
            base, lacks = fresh(n, 1), r.randint(0, n * 15 // 100)
            most = 100 * (n - lacks) // 85 - n  # of those it adds
            other = np.unique(np.concatenate([rng.permutation(base)[lacks:], fresh(r.choice([most, r.randint(0, most)]), 0)]))
            if np.array_equal(base, other):
                continue
            assert 100 * len(np.intersect1d(base, other)) >= 85 * len(np.union1d(base, other))
            keys, owner = jaccard.part_keys(np.concatenate([base, other]), np.cumsum([0, len(base), len(other)]))
            assert len(np.intersect1d(keys[owner == 0], keys[owner == 1]))
            seen += 1
    assert seen > 800
    assert len(jaccard.part_keys(np.zeros(0, np.uint64), np.zeros(3, np.int64))[0]) == 0


def test_shared_tokens_alone_bring_no_sets_together(docs_of, monkeypatch):
    """Nearly every shingle is in two documents, but no two documents have more than a tenth of theirs in common."""
    class Stop(Exception):
        pass

    def shards(sets, count, *_):
        raise Stop(count, sets.count())

    monkeypatch.setattr(jaccard, "Shards", shards)
    passage = [[" ".join(prose(10_000 + 10 * i + j, 40)) for j in range(10)] for i in range(10)]
    rows = [(i, " ".join(passage[i])) for i in range(10)] + [(10 + j, " ".join(p[j] for p in passage)) for j in range(10)]
    with pytest.raises(Stop) as stopped:
        jaccard.component_ids(docs_of(rows))
    assert max(stopped.value.args) <= 2


def test_tables_leave_no_shuffles_and_can_be_dropped(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in Path(d).rglob("shuffle_*")}

    before, setting = files(), spark.conf.get(common.CLEANUP)
    table = common.saved(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "sums")
    assert sorted(map(tuple, table.collect())) == [(k, 100) for k in range(10)]
    assert spark.conf.get(common.CLEANUP) == setting
    for _ in range(100):  # Spark deletes them in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    path = Path(table.saved_at.removeprefix("file:"))
    assert path.exists()
    common.drop(table)
    assert not path.exists()


def test_trees_lose_no_pair():
    rng, r = np.random.default_rng(1), random.Random(3)
    fresh = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for every in (True, False):
        sets = []
        for _ in range(25):
            base = fresh(r.randint(1, 60))
            sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], fresh(r.randint(0, 3))])) for _ in range(r.randint(1, 9))]
        sets = [s for s in sets if len(s)]
        r.shuffle(sets)
        n = len(sets)
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        got = list(signature_tree.joined(signature_tree.Forest(sets, list(range(n))), None, 85, every))
        if every:
            assert sorted(got) == want
        else:
            up = signature_tree.Forest(sets, list(range(n)))
            for i, j in want:
                up.parent[max(up.find(i), up.find(j))] = min(up.find(i), up.find(j))
            assert len(got) == n - len({up.find(k) for k in range(n)})

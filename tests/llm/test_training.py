"""Scores, packing, mixing, page text, chat windows and search, against brute force or round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, sentences
from pyspark.sql import functions as F

from shiftledger.llm import chat, html_crf, html_pages, mil, mixing, mtree, packing
from shiftledger.llm import text as T
from shiftledger.llm.tokens import encoder


# -- attention-based scores ----------------------------------------------------------------------------------------
def junk(seed, n):
    return " ".join(f"{w}###" for w in prose(seed, n))


def test_model_separates_held_out_documents(docs_of, spark):
    rows = [(k, junk(k, 80) if k % 3 == 0 else sentences(k, 150)) for k in range(240)] + [(900, None), (901, ""), (902, sentences(9, 20_000))]
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(160)] + [(0, 0), (None, 1)], "doc_id bigint, label int")
    docs = docs_of(rows)
    model = mil.learn(docs, labels, sample=150)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", mil.score("text", model).alias("s")).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.5) == (k % 3 != 0) for k in range(160, 240))
    assert got[900] == got[901] and got[902] >= 0.5
    again = mil.learn(docs, labels, sample=150)
    assert np.allclose(again.parts[0], model.parts[0])


def test_a_score_does_not_depend_on_neighbours():
    texts = [sentences(1, 300), "", junk(2, 70), sentences(3, 64)]
    model = mil._constant(0.5)
    model = mil.Model(model.mean, model.scale, tuple(np.full_like(p, 0.1) for p in model.parts))
    together = [mil.encode(d, at) for _, _, d, at in T.segments(pa.array(texts))]
    alone = [mil.encode(d, at) for t in texts for _, _, d, at in T.segments(pa.array([t]))]
    assert np.allclose(model.score(*together[0]), np.concatenate([model.score(*x) for x in alone]))


def test_gradients_lower_the_loss():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 6, 60)
    before = np.concatenate([[0], np.cumsum(sizes)])
    y = (np.arange(60) % 2).astype(float)
    x = r.normal(0, 1, (before[-1], mil.WIDTH))
    x[before[:-1], 0] += 4 * y  # one passage of a bag tells its label
    p = mil.fit(x.astype(np.float32), before, y, rounds=200).score(x, before)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95


def test_labels_of_one_kind(docs_of, spark):
    docs = docs_of([(1, "a b c"), (2, None)])
    assert mil.learn(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, label int")).score(np.zeros((1, mil.WIDTH)), np.array([0, 1]))[0] > 0.99
    none = mil.learn(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    assert docs_of([]).select(mil.score("text", none)).count() == 0
    assert none.score(np.zeros((1, mil.WIDTH)), np.array([0, 1]))[0] == 0.5


# -- packing -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(8))
def test_patterns_hold_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    counts = Counter(r.randint(1, capacity) for _ in range(r.randint(0, 60)))
    patterns = packing.pack(dict(counts), capacity)
    held = Counter()
    for filling, n in patterns:
        assert sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            held[x] += k * n
    assert held == counts
    assert sum(n for _, n in patterns) <= sum(n for _, n in packing.best_fit(dict(counts), capacity))


def test_search_beats_best_fit_to_the_optimum():
    counts = Counter([7, 5, 5, 4, 4, 3, 2])  # 30 in three bins of 10
    assert sum(n for _, n in packing.pack(dict(counts), 10)) == 3


def test_tokens_match_the_tokenizer():
    texts = ["", None, "  \n", "it's DON'T 12ab3 <|endoftext|> «!x y ź éÅ …a.b've 'S ΣΑΣΣ. İx a\u0085b", "x" * 5000, "a" + "̊" + " b.c"] * 3
    e = encoder()
    for first, last, data, at in T.segments(pa.array(texts)):
        ids, counts = e.encode(data, at, 0)
        ends = np.cumsum(counts)
        for k, text in enumerate(texts[first:last]):
            assert ids[ends[k] - counts[k]:ends[k]].tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_packed_pieces(docs_of, odd_rows):
    rows = odd_rows + [(100 + k, sentences(k, k % 90)) for k in range(150)] + [(7777, "same text")] * 40
    got = packing.packed(docs_of(rows)).collect()
    e = encoder().tokenizer
    want = Counter()
    for i, text in rows:
        ids = e.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed(docs_of([])).count() == 0


# -- mixing --------------------------------------------------------------------------------------------------------
def brute_targets(sizes):
    """Shares by weight, stopped at twice the size, the excess shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_match_resharing(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 1000, r.randint(1, 10**6)]) for s in r.sample(["a", "B", "é", "\U0001f600", "z", "", "aa", None], r.randint(1, 8))}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert {x["source"] for x in got} == set(sizes)
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]])


def mix(docs):
    s = mixing.sampling(F.col("text"), F.col("doc_id"))
    rows = docs.select("doc_id", "source", s.alias("s")).select("doc_id", "source", "s.size", "s.at")
    plan = mixing.targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    return mixing.taken(rows, plan).collect(), {r["doc_id"]: r["at"] for r in rows.collect()}


def test_mix_takes_epochs_and_then_smallest_keys(docs_of):
    r = random.Random(4)
    rows = [(k, sentences(k, r.randint(0, 60)), r.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    got, keys = mix(docs_of(rows))
    again, _ = mix(docs_of(rows[::-1]))
    assert sorted((x["doc_id"], x["copies"]) for x in got) == sorted((x["doc_id"], x["copies"]) for x in again)
    groups = defaultdict(list)
    for x in got:
        groups[x["source"]].append(x)
    for g in groups.values():
        taken, target = sum(x["size"] * x["copies"] for x in g), g[0]["target"]
        assert abs(taken - target) <= max(x["size"] for x in g) / 2 + 1e-6
        low = min(x["copies"] for x in g)
        assert {x["copies"] for x in g} <= {low, low + 1} and low + 1 <= 3
        more, less = [keys[x["doc_id"]] for x in g if x["copies"] > low and x["size"]], [keys[x["doc_id"]] for x in g if x["copies"] == low and x["size"]]
        assert not more or not less or max(more) < min(less)


def test_mix_of_odd_rows(docs_of, odd_rows):
    got, _ = mix(docs_of([(*x, None) for x in odd_rows]))
    assert len(got) == len(odd_rows) and all(0 <= x["copies"] <= 2 for x in got)
    assert mix(docs_of([]))[0] == [] and [x["copies"] * x["size"] for x in mix(docs_of([(1, None), (2, "")]))[0]] == [0, 0]


# -- pages ---------------------------------------------------------------------------------------------------------
def test_blocks_are_right_on_unseen_layouts():
    model = html_pages.default_model()
    wrong = total = 0
    for blocks, labels in html_pages.examples(120, seed=11):
        wrong += sum(a != b for a, b in zip(labels, model.decode(blocks)))
        total += len(labels)
    assert total > 1000 and wrong <= 0.01 * total


def test_viterbi_finds_the_best_chain():
    model = html_pages.default_model()
    r = random.Random(1)
    for blocks, _ in html_pages.examples(20, seed=3):
        blocks = blocks[:8]
        scores = model.scores(blocks)

        def value(labels):
            v = model.first[labels[0]] + sum(s[y] for s, y in zip(scores, labels))
            return v + sum(model.step[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value([k >> j & 1 for j in range(len(blocks))]) for k in range(1 << len(blocks)))
        assert value(model.decode(blocks)) == pytest.approx(best)
    assert r


def test_text_of_a_page(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></ul></nav>
        <div class="ad">Buy this now.</div><article><h1>A &amp; B&nbsp;&lt;3</h1><p>First   <b>bold</b>\n text.<br>More.<p>Second.
        <script>var x = "</p>";</script><aside>Related things.</aside><form><label>Mail</label><input></form><!-- no --></article>
        <section id="comments"><p>I like it.</p></section><footer>&copy; me</footer>"""
    rows = [(1, page), (2, None), (3, ""), (4, "plain"), (5, page), (6, "<p>a</p>" * 3000), (7, "<a href='x>y"), (8, "<" * 2000)]
    out = spark.createDataFrame(rows, "page_id int, html string").select("page_id", html_crf.main_text("html", html_pages.default_model()).alias("t"))
    got = {r["page_id"]: r["t"] for r in out.collect()}
    assert got[1] == got[5] == "A & B <3\nFirst bold text. More.\nSecond."
    assert got[2] == got[3] == "" and len(got) == len(rows)


# -- chat ----------------------------------------------------------------------------------------------------------
TURNS = "conv_id bigint, turn bigint, role string, text string, window int, loss string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], TURNS)


def test_escapes_are_reversible():
    r = random.Random(8)
    bits = [*chat.CONTROL, "\\", "<", ">", "s>", "/s>", "[", "INST]", "\n", "a", "|"]
    for _ in range(2000):
        s = "".join(r.choices(bits, k=r.randint(0, 8)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)
        assert chat.parse(chat.render([(s, s, 1), ("assistant", s, 1)], 0)[0]) == [(s, s), ("assistant", s)]


def test_windows_round_trip(spark):
    r = random.Random(9)
    rows = []
    for c in [*range(60), None]:
        roles = (["system"] if r.random() < 0.5 else []) + ["user", "assistant"] * r.randint(0, 20) + r.choice([[], ["user"], [None]])
        rows += [(c, k, role, r.choice([None, "", "</s>[INST] ok", sentences(k, r.randint(1, 300)), "\\"])) for k, role in enumerate(roles)]
    rows += [(500, 0, "user", sentences(1, 5000)), (500, 1, "assistant", sentences(2, 5000)), (501, 1, "user", "twice"), (501, 1, "user", "twice")]
    frame = turns_of(spark, r.sample(rows, len(rows)))
    shown = chat.windows(frame, budget=300, history=80)
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want[c].append((role or "", text or ""))
    got = {x["conv_id"]: x for x in chat.digests(shown).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in shown.collect():
        turns = chat.parse(w["text"])
        new = len(turns) - w["n_repeated"]
        assert new >= 1 and (w["n_tokens"] <= 300 or new == 1)
        if want[w["conv_id"]][0][0] == "system":
            assert turns[0] == want[w["conv_id"]][0]
    assert chat.digests(chat.windows(turns_of(spark, []))).count() == 0


# -- search --------------------------------------------------------------------------------------------------------
def brute_top(rows, k=5):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            out[q] = sorted((-int(v @ w), i) for i, w in good if i != q)[:k]
    return out


@pytest.mark.parametrize("kind", ["normal", "few", "equal", "odd"])
def test_search_matches_brute_force(spark, kind):
    r = np.random.default_rng(5)
    n, d = {"normal": (1500, 16), "few": (4, 3), "equal": (900, 8), "odd": (300, 5)}[kind]
    v = np.floor(r.normal(0, 40, (n, d)))
    if kind == "equal":
        v[r.random(n) < 0.6] = v[0]
    rows = [(int(i), x.tolist()) for i, x in zip(r.permutation(n), v)]
    if kind == "odd":
        rows += [(1001, None), (1000, [1.0, None, 2.0, 3.0, 4.0]), (1050, [float("nan")] * 5), (1100, [float("inf")] * 5), (1150, [5.0, 6.0]), (1200, [])]
        rows += [(7, rows[0][1]), (7, rows[0][1]), (None, [1.0] * 5)]
    frame = spark.createDataFrame([(i, x, 9, 9) for i, x in rows], "vec_id bigint, embedding array<double>, rank int, score int")
    got = defaultdict(list)
    for x in mtree.top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=400, block_rows=20).collect():
        got[x["query_id"]].append((x["rank"], -x["score"], x["vec_id"]))
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == {q: x for q, x in brute_top(rows).items() if x}


def test_search_without_rows(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert mtree.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_skip_most_of_a_clustered_tree():
    r = np.random.default_rng(1)
    centers = r.normal(0, 300, (20, 6))
    points = np.floor(np.concatenate([c + r.normal(0, 5, (100, 6)) for c in centers]))
    tree = mtree.MTree(np.arange(2000), points)
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree.vectors = tree.vectors.view(Counted)
    best = int(np.argmax(points @ points[0]))
    assert tree.search(-1, points[0], 1)[0][1] in np.flatnonzero(points @ points[0] == points[best] @ points[0])
    assert sum(seen) < 1000


def test_a_block_of_queries_enters_a_page_once():
    r = np.random.default_rng(2)
    points = np.floor(r.normal(0, 40, (1000, 8)))
    tree = mtree.MTree(np.arange(1000), points)
    entered = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            entered.append(len(self))
            return np.asarray(self) @ other

    tree.vectors = tree.vectors.view(Counted)
    place, scores, ids = tree.search_all(np.arange(0, 1000, 5), points[::5], 3)
    got = list(zip(place.tolist(), scores.tolist(), ids.tolist()))
    assert got == [(q, -s, i) for q in range(200) for s, i in sorted((-int(points[5 * q] @ points[i]), i) for i in range(1000) if i != 5 * q)[:3]]
    assert sum(entered) <= 1000

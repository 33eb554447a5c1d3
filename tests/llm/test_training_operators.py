"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import re
import uuid
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, and odd rows: (doc_id, text)."""
    rng = np.random.default_rng(5)
    made = lambda n: " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))
    passage, long = made(60), made(400)
    rows = [(i, made(int(rng.integers(3, 80)))) for i in range(30)]
    rows += [(40 + i, f"{made(20)} {passage}\n{made(10)}") for i in range(8)]
    near = long.split()
    for i in range(8):
        copy = list(near)
        for at in rng.choice(len(copy), 2 + i, replace=False):
            copy[at] = "changed"
        rows.append((60 + i, " ".join(copy)))
    rows += [(80, long), (81, long.upper()), (82, long + " tail"), (83, None), (84, ""), (85, "  \n "), (86, "two words"), (87, "Two  Words"), (None, long), (None, None), (80, long), (90, "a " * 3000), (91, "a " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, kept string, tag int")


def test_substring_dedup(docs, corpus):
    from tidemark.llm.substring_dedup import dedup_substrings

    least = {}
    for i, t in corpus:
        w = words(t)
        for p in range(len(w) - 12):
            if i is not None:
                least[tuple(w[p : p + 13])] = min(i, least.get(tuple(w[p : p + 13]), i))
    want = []
    for i, t in corpus:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if i is not None and least[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        want.append((i if i is not None else -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs).collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicates(docs, corpus):
    from tidemark.llm.minhash_dedup import near_duplicates

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = defaultdict(list)
    for i, t in corpus:
        w = words(lower(t))
        sets[i].append({" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[p : p + 5]) for p in range(len(w) - 4)})
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert find(67) == find(80) == 60


@pytest.mark.parametrize("hot", [1, 1 << 20])
def test_substring_dedup_of_hot_runs_and_shared_ids(spark, monkeypatch, hot):
    """A run of words in every text (its minimisers are split at hot = 1), and many texts of one id, which stay apart."""
    from tidemark.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = np.random.default_rng(21)
    made = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 500, n))
    passage = made(40)
    rows = [(i, f"{made(30)} {passage} {made(5)}") for i in range(60)] + [(7, f"{made(int(n))} {passage}") for n in rng.integers(1, 60, 300)] + [(3, None), (None, passage)]
    rows += [(500, "z " * 40_000), (501, "z " * 40)]
    least = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            if i is not None:
                least[tuple(w[p : p + 13])] = min(i, least.get(tuple(w[p : p + 13]), i))
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if i is not None and least[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        want.append((i if i is not None else -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, tag int")
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(df).collect()) == sorted(want)
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_registers_match_with_the_probability_of_the_similarity():
    from tidemark.llm.minhash_dedup import REGISTERS, collision, estimate, registers

    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    for n, m, shared in ((9, 8, 8), (40, 36, 33), (400, 380, 350), (3000, 2900, 2600), (6, 5, 0), (900, 300, 0)):
        got = []
        for _ in range(120):
            both = draw(shared)
            a, b = np.sort(np.concatenate([both, draw(n - shared)])), np.sort(np.concatenate([both, draw(m - shared)]))
            x = registers(np.concatenate([a, b]), np.array([0, n]))
            got.append(float(estimate(x[0], x[1], np.array(n), np.array(m))))
        assert abs(np.mean(got) - shared / (n + m - shared)) < 0.01
    # disjoint sets: the share of equal registers is the derived probability
    for n, m in ((2000, 2000), (5000, 500), (64, 64)):
        equal = []
        for _ in range(600):
            x = registers(np.concatenate([draw(n), draw(m)]), np.array([0, n]))
            equal.append((x[0] == x[1]).mean())
        want = float(collision(np.array(n), np.array(m)))
        assert abs(np.mean(equal) - want) < 6 * (want / (600 * REGISTERS)) ** 0.5 + 1e-4


def test_near_copies_around_the_threshold_lose_no_link(spark, monkeypatch):
    """A chain of near copies, most pairs of which are just above or below the threshold, in blocks of a few members."""
    from tidemark.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(240):
        w = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[at] = f"x{int(rng.integers(0, 30))}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"a{i % 7} b c d e f g h{i % 3}") for i in range(40)]
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) > 20


def test_token_counts(spark, corpus):
    import public_tokenizers

    from tidemark.llm.token_counts import count_tokens, load

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = load(path)
    odd = ["it's we'll 'S", "a<|endoftext|>b", "　 x\x85y\x1cz  ", "日本 ٣ \U0001f600", "\n\n  x\t", "x" * 5000, " " * 300]
    rows = [(i, x) for i, x in corpus] + [(200 + k, x) for k, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, path, keep=("doc_id",)).collect())
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert got == sorted((i or -1, len((x or "").encode()), n(x), n(x) > 1024) for i, x in rows)


@pytest.mark.parametrize("lines", [1, 2, 3])
def test_line_dedup(spark, lines):
    from tidemark.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(2)
    texts = ["\n".join(rng.choice(list("abcdef"), int(rng.integers(1, 9)))) for _ in range(25)] + [None, "", "\n\n", "y" * 120, "q\n" + "y" * 120]
    rows = list(enumerate(texts))
    seen, longs, want, removed = set(), set(), [], []
    for _, t in rows:
        own, gone = (t.split("\n") if t is not None else []), set()
        for p in range(len(own)):
            run = tuple(own[p : p + lines])
            if len(run) == lines:
                if run in seen:
                    gone.update(range(p, p + lines))
                seen.add(run)
            if len(own[p]) >= 100:
                if own[p] in longs:
                    gone.add(p)
                longs.add(own[p])
        want.append(None if t is None else "\n".join(x for p, x in enumerate(own) if p not in gone))
        removed.append(len(gone))
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows] + [(None, "a\nb", 0, "k")], "doc_id long, text string, n_removed int, key string")
    got = {r.doc_id: r for r in dedup_lines(df, lines=lines).collect()}
    assert [got[i].text for i, _ in rows] == want
    assert got[None].text == "a\nb"
    assert [got[i].n_removed for i, _ in rows] == removed


def test_line_dedup_of_rows_that_share_an_id(spark):
    from tidemark.llm.line_dedup import dedup_lines, repeated_runs

    rows = [(1, "a\nb\nc\nd\ne"), (1, "a\nb\nc\nd\ne"), (1, "x\na\nb\nc\nd\ny"), (2, "q\nb\nc\nd\ne\nr\nq\nb"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in dedup_lines(df).collect()) == sorted([(1, rows[0][1]), (1, rows[0][1]), (1, "x\ny"), (2, "q\nr"), (3, "")])
    runs = sorted((r.doc, r.lo, r.hi, r.source.doc, r.source.at) for r in repeated_runs(df).collect())
    assert runs == [(1, 1, 5, 1, 0), (2, 1, 5, 1, 1), (2, 6, 8, 2, 0)]
    assert dedup_lines(df.limit(0)).count() == 0


def test_decontamination(spark):
    from tidemark.llm.decontamination import decontaminate

    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    made = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, made(int(rng.integers(10, 25)))) for i in range(12)] + [(20, made(4)), (21, []), (22, ["w1"] * 14)]
    texts = [made(int(rng.integers(0, 60))) for _ in range(40)]
    for k in range(15):
        i = int(rng.integers(0, 12))
        texts[k] = texts[k][:5] + items[i][1][: int(rng.integers(9, 20))] + texts[k][5:]
    texts += [items[12][1] + ["x"], ["w1"] * 30]
    item_rows = [(i, "  ".join(w)) for i, w in items] + [(30, None)]
    rows = [(i, "-".join(w).upper()) for i, w in enumerate(texts)] + [(99, None), (3, "w1 w2"), (None, " ".join(items[0][1])), (3, "x " * 30_000 + " ".join(items[1][1]) + " y" * 9)]
    windows = {i: {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9))} for i, w in items if w}
    want = []
    for i, t in rows:
        w, hit, found = re.findall(r"[a-z0-9]+", (t or "").lower()), set(), set()
        for item, wins in windows.items():
            for win in wins:
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        want.append((i, len(w), len(hit), sorted(found), bool(hit)))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, item_id long")
    it = spark.createDataFrame(item_rows, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(df, it).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[4] for x in want) and not all(x[4] for x in want)
    assert decontaminate(df.limit(0), it).count() == 0
    assert {r.contaminated for r in decontaminate(df, it.limit(0)).collect()} == {False}


def test_mixing(spark):
    from tidemark.llm.mixing import mix

    rows = [(i, "w " * (i % 50), ["a", "b", "c", None][min(i % 7, 3)]) for i in range(400)] + [(None, "x y", "a"), (1, None, "b"), (1, "z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, block=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df, block=8).collect()), key=str)
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] += r["size"]
    total = sum(r["size"] for r in got)
    for (size, target), (taken, own) in by.items():
        assert own == size and target <= 2 * size and abs(taken - target) <= 16
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    assert mix(df.limit(0)).count() == 0


def test_mixed_text_holds_what_the_plan_takes(spark):
    from tidemark.llm.mixing import mix, mixed_text

    df = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(20 + i)), "ab"[i % 2]) for i in range(12)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mix(df, block=8).collect()}
    seen = defaultdict(int)
    for r in mixed_text(df, block=8).collect():
        for w in r.text.split():
            seen[int(w[1 : w.index("w")])] += 1
    assert {k: v for k, v in taken.items() if v} == dict(seen)
    # repeated and null ids, and a text of many blocks, take part as rows of their own
    odd = spark.createDataFrame([(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, "n m", "x", 9), (2, "w " * 5000, None, 9), (3, None, "x", 9)], "doc_id long, text string, source string, shard int")
    assert sum(len(r.text.split()) for r in mixed_text(odd, block=8).collect()) == sum(r.taken for r in mix(odd, block=8).collect()) > 5000


def test_shuffle_is_a_permutation(spark):
    from tidemark.llm.mixing import points, shuffled

    for n in (1, 2, 37, 1000):
        got = [r.x for r in spark.range(n).select(shuffled(F.col("id"), F.lit(n).cast("long"), F.lit("k"), points(F.lit("k"))).alias("x")).collect()]
        assert sorted(got) == list(range(n))
    assert abs(np.corrcoef(got, range(n))[0, 1]) < 0.1


def test_shards_draw_multinomial_counts_that_meet_the_totals(spark):
    from tidemark.llm.mixing import shard_counts

    slots, width = [30_000, 20_000, 9_000, 1_000, 0, 7], 400
    ends = np.cumsum(slots).tolist()
    sources = spark.createDataFrame([(k + 1, 20_000, n, e - n, e) for k, (n, e) in enumerate(zip(slots, ends))], "rank int, blocks long, slots long, begin long, end long")
    ratios = []
    for seed in (1, 2, 3):
        got = shard_counts(sources, width, seed).collect()
        by = defaultdict(dict)
        for r in got:
            by[r["rank"]][r.shard] = (r.n, r["first"])
        assert {k: sum(n for n, _ in v.values()) for k, v in by.items()} == {k + 1: n for k, n in enumerate(slots) if n}
        shards = defaultdict(int)
        for v in by.values():
            at = 0
            for shard in sorted(v):
                assert v[shard][1] == at  # numbered on from the shard before
                at += v[shard][0]
                shards[shard] += v[shard][0]
        assert set(list(shards.values())[:-1]) <= {width, sum(slots) % width} and sum(shards.values()) == sum(slots)
        for k in (1, 2, 3):
            p = slots[k - 1] / sum(slots)
            ratios.append(np.var([by[k].get(s, (0, 0))[0] for s in range(sum(slots) // width)]) / (width * p * (1 - p)))
    assert all(0.6 < x < 1.5 for x in ratios) and 0.8 < np.mean(ratios) < 1.2


def test_nearest_neighbours(spark):
    from tidemark.llm.ann import nearest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0] * 3), (None, x[3].tolist())]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = nearest(df, df.where("vec_id % 50 = 0")).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.query_id][r["rank"]] = (r.vec_id, r.score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(by) == set(range(0, 1500, 50))
    hit = 0
    for q, found in by.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hit += len({v for v, _ in found.values()} & set(best.tolist()))
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for v, c in found.values())
    assert hit / (5 * len(by)) >= 0.9
    assert [v for v, _ in (by[150][k] for k in range(1, 6))] == [7, 100, 101, 102, 103]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    from tidemark.llm.toxicity import score, train

    rng = np.random.default_rng(8)
    clean = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    bad = ["vil" + "".join(rng.choice(list("abcdefghij"), 3)) for _ in range(60)]
    rows = []
    for i in range(1200):
        w = list(rng.choice(clean, int(rng.integers(5, 120))))
        if i % 6 == 0:
            for at in rng.choice(len(w), 3):
                w[at] = str(rng.choice(bad[:40] if i % 12 else bad[40:]))
        rows.append((i, " ".join(w), int(i % 6 == 0), "x"))
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows] + [(5001, None, "x"), (5002, "", "x"), (None, "a", "x"), (1, rows[1][1], "x")], "doc_id long, text string, score string").drop("score")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows if i % 5] + [(9999, 1), (5001, None)], "doc_id long, toxic int")
    out = score(docs, train(docs, labels)).collect()
    assert len(out) == len(rows) + 4
    y = {i: t for i, _, t, _ in rows}
    tested = [r for r in out if r.doc_id in y and r.doc_id % 5 == 0]
    assert sum(r.predicted == y[r.doc_id] for r in tested) / len(tested) > 0.9
    assert all(0 <= r.score <= 1 for r in out)
    assert score(docs.limit(0), train(docs, labels.limit(0))).count() == 0


def test_kept_text_digest_is_of_utf8(docs):
    from tidemark.llm.substring_dedup import dedup_substrings

    r = dedup_substrings(docs.where("doc_id = 3")).select("kept", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).first()
    assert r.h == hashlib.sha256(r.kept.encode()).hexdigest()


def test_toxicity_sees_what_lies_behind_long_beginnings(spark):
    from tidemark.llm.toxicity import Model, Scorer, marked_words, n_grams, score, train

    rng = np.random.default_rng(9)
    start = "plain simple common words " * 600  # 15,600 characters
    made = lambda i, bad: start + " ".join([*rng.choice(["tree", "house", "river", "cloud", "stone"], 15), "vilhorrid" if bad else f"calm{i % 9}"])
    docs = spark.createDataFrame([(i, made(i, i % 2)) for i in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160) if i % 5], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score(docs, train(docs, labels)).collect()}
    tested = [i for i in got if i % 5 == 0]
    assert min(got[i] for i in tested if i % 2) > max(got[i] for i in tested if not i % 2) + 0.3
    # behind the 64th character of an unspaced run, too, and across the pieces' edges
    model = Model(np.zeros(1 << 17, np.float32), 0.0)
    model.weight[n_grams("vilhor")] = 50.0
    for n in (0, 50, 60, 64, 500):
        for run in ("x" * n + "vilhorrid" + "x" * 70, "日本" * n + "vilhorrid"):
            assert Scorer(model)(run) > Scorer(model)(run.replace("vilhorrid", "x")) + 0.1
    assert {w for w in marked_words("ab cd-e")} == {"<ab>", "<cd-e>"}


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_of_the_forest_alone(spark, kind):
    """More vectors than are fitted on and than any bound is taken from; recall follows `miss`, so it is the forest that decides."""
    from tidemark.llm.ann import nearest

    rng = np.random.default_rng(12)
    n, dim = 24_000, 24
    x = rng.normal(size=(n, dim)) if kind == "isotropic" else rng.normal(size=(200, dim)).repeat(n // 200, axis=0) + 0.7 * rng.normal(size=(n, dim))
    path = f"/tmp/tidemark-tests/{uuid.uuid4().hex}"
    spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})).repartition(8).write.parquet(path)
    df = spark.read.parquet(path)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, n, 100)
    want = {q: set(np.argsort(-(u @ u[q]))[:6].tolist()) - {q} for q in asked}

    def recall(**how):
        by = defaultdict(set)
        for r in nearest(df, df.where("vec_id % 100 = 0"), max_fit=6000, **how).collect():
            assert abs(u[r.query_id] @ u[r.vec_id] - r.score) < 1e-12
            by[r.query_id].add(r.vec_id)
        return sum(len(by[q] & want[q]) for q in asked) / (5 * len(asked))

    assert recall(miss=0.7) < 0.7
    assert recall() >= 0.93


def test_language_models_against_brute_force(spark):
    import math

    from tidemark.llm import lm_scoring

    long = " ".join(f"w{i % 977}" for i in range(90_000))  # of several chunks' size
    rows = [(1, "a b a c", True), (2, "a b d é 日本 | ok", None), (3, "", True), (4, None, False), (5, "z\n z  z", False), (5, "z\n z  z", False), (None, "b a", True), (7, long, False), (8, long, False)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, good boolean, n int")
    marked = lambda t: ["", *words(t), ""]
    vocabulary = {w for _, t, _ in rows for w in marked(t)}

    def model(texts):
        one, two, before = defaultdict(int), defaultdict(int), defaultdict(int)
        for t in texts:
            for b, c in zip(marked(t), marked(t)[1:]):
                one[c] += 1
                two[b, c] += 1
                before[b] += 1
        total = sum(one.values())
        return lambda b, c: (two[b, c] + lm_scoring.BACK * (one[c] + 1) / (total + len(vocabulary))) / (before[b] + lm_scoring.BACK)

    for labels in ([g for *_, g in rows], [False] * len(rows)):
        good = [t for (_, t, _), g in zip(rows, labels) if g] or [t for _, t, _ in rows]
        models = model(good), model([t for _, t, _ in rows])
        ours = df.drop("good").withColumn("good", F.col("doc_id").isin(1, 3) | F.col("doc_id").isNull() if any(labels) else F.lit(False))
        got = lm_scoring.cross_entropy_difference(ours, "good", keep=("doc_id", "text", "n")).collect()
        assert len(got) == len(rows)
        for r in got:
            m = marked(r.text)
            assert r.n_tokens == len(m) - 1
            for loss, p in zip((r.target_loss, r.background_loss), models):
                assert abs(loss - -sum(math.log(p(b, c)) for b, c in zip(m, m[1:])) / (len(m) - 1)) < 1e-9
            assert abs(r.score - (r.target_loss - r.background_loss)) < 1e-12
    assert lm_scoring.cross_entropy_difference(df.limit(0), "good").count() == 0


def test_language_model_scores_every_whole_text(spark):
    from tidemark.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = {r.doc_id: r.n_tokens for r in QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    assert tokens == {r.doc_id: len(words(r.text)) + 1 for r in docs.collect()}


@pytest.mark.parametrize("segment", [4, 16, 10_000])
def test_toxicity_scores_against_brute_force(spark, segment):
    """The score is the worst segment's mean over all n-grams of all words, recomputed word by word; ties, repeated and odd rows."""
    import math
    from zlib import crc32

    from tidemark.llm.toxicity import BUCKETS, Model, score

    rng = np.random.default_rng(31)
    model = Model(rng.normal(0, 2, BUCKETS).astype(np.float32), -0.7)
    texts = [" ".join("".join(rng.choice(list("abé1"), int(rng.integers(1, 8)))) for _ in range(int(n))) for n in rng.integers(0, 60, 60)]
    texts += [None, "", "?! --", "a", texts[3], texts[3], "b " * 20_000]

    def grams(word):
        w = f"<{word}>".encode()
        return {w} | {w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)}

    def brute(text):
        own = [[float(model.weight[crc32(g) % BUCKETS]) for g in grams(w)] for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", (text or "").lower())]
        starts = {min(i, max(0, len(own) - segment)) for i in range(0, len(own), segment)}
        means = [sum(map(sum, own[i : i + segment])) / sum(map(len, own[i : i + segment])) for i in starts]
        return 1 / (1 + math.exp(-(max(means, default=0.0) + model.bias)))

    df = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, predicted double")
    got = {r.doc_id: r for r in score(df, model, segment=segment).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i].score - brute(t)) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.3)


def test_toxicity_hashes_the_words_of_many_texts_together(monkeypatch):
    """Words that are met once make up most of what scoring costs: all of it takes less than half of hashing them one by one. The n-grams, the sums and the scores are those of single words, whatever is looked up together or forgotten."""
    import time

    from tidemark.llm import toxicity
    from tidemark.llm.toxicity import BUCKETS, Model, Scorer, marked_words, n_grams

    rng = np.random.default_rng(5)
    model = Model(rng.normal(0, 2, BUCKETS).astype(np.float32), -0.7)
    texts = [" ".join("".join(rng.choice(list("abcdefgé日𐐷"), int(n))) for n in rng.integers(1, 24, 400)) for _ in range(60)]
    texts += [None, "", "?!", "a", "aaaaaaaaaaaaaa abababababab", "x" * 63, "x" * 64, "x" * 65, "日本" * 300 + " ab", texts[0]]

    def timed(f):
        began = time.process_time()
        return f(), time.process_time() - began

    together, alone = [], []
    for _ in range(3):
        together.append(timed(lambda: [Scorer(model)(" ".join(t or "" for t in texts))]))
        alone.append(timed(lambda: [n_grams(w) for w in {w for t in texts for w in marked_words(t)}]))
    assert min(s for _, s in together) < 0.5 * min(s for _, s in alone)

    words = sorted({w for t in texts for w in marked_words(t)} | {"a", "ab", "abc", "abcdef", "abcdefg"})
    parts = [*toxicity.n_grams_of(words)]
    assert len(parts) > 2
    single = [n_grams(w) for w in words]
    assert np.array_equal(np.concatenate([g for g, _ in parts]), np.concatenate(single))
    assert np.concatenate([n for _, n in parts]).tolist() == [len(g) for g in single]

    def score(text):  # word by word
        own = [(float(model.weight[g].sum()), len(g)) for g in map(n_grams, marked_words(text))]
        starts = {min(i, max(0, len(own) - 16)) for i in range(0, len(own), 16)}
        worst = max((sum(s for s, _ in own[i : i + 16]) / sum(n for _, n in own[i : i + 16]) for i in starts), default=0.0)
        return 1 / (1 + np.exp(-(worst + model.bias)))

    want = [score(t) for t in texts]
    got = Scorer(model).scores(texts)
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    scorer = Scorer(model)
    assert [scorer(t) for t in texts] == got
    monkeypatch.setattr(toxicity, "_MEMO", 500)
    monkeypatch.setattr(toxicity, "LOOKUP", 300)
    assert Scorer(model).scores(texts) == got


def test_held_out_rows_are_never_learned_from(spark):
    from zlib import crc32

    from tidemark.llm.toxicity import held_out, score, train

    ids = [*range(400)]
    assert [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy("i").select(held_out(F.col("i")).alias("h")).collect()] == [crc32(str(i).encode()) % 4 == 2 for i in ids]
    rng = np.random.default_rng(2)
    made = lambda i: " ".join(rng.choice(["tree", "house", "river", "vilhorrid"[: 9 if i % 3 == 0 else 3]], 12))
    docs = spark.createDataFrame([(i, made(i)) for i in ids], "doc_id long, text string")
    y = {i: int(i % 3 == 0) for i in ids}
    swapped = {i: 1 - v if crc32(str(i).encode()) % 4 == 2 else v for i, v in y.items()}
    a, b = (score(docs, train(docs, spark.createDataFrame(list(x.items()), "doc_id long, toxic int"))).orderBy("doc_id").collect() for x in (y, swapped))
    assert a == b


def test_mixed_pieces_are_the_documents_words_in_order(spark):
    """Odd white space, long and short texts: the pieces of a document, put together by their places, are its words."""
    from tidemark.llm.mixing import mixed_text

    rows = [(i, "\n " * (i % 2) + "\t \n".join(f"d{i}w{k}é" for k in range(n)) + "  " * (i % 3)) for i, n in enumerate((1, 7, 8, 9, 40, 700, 3))]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = defaultdict(dict)
    for r in mixed_text(df, block=8).collect():
        assert got[r.doc_id].setdefault(r.part, r.text) == r.text
    for i, t in rows:
        if got[i]:
            whole = [w for part in sorted(got[i]) for w in got[i][part].split(" ")]
            assert whole == [w for w in words(t) if w in set(whole)]
            assert all(0 < len(x.split(" ")) <= 8 for x in got[i].values())
    assert len(got) >= 5


def test_toxicity_learns_from_at_most_max_rows_documents(spark, monkeypatch):
    from tidemark.llm import toxicity

    rows = [(1, "you are a fool", 1)] * 300 + [(k, f"calm words {k}", 0) for k in range(2, 40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame(sorted({(i, y) for i, _, y in rows}), "doc_id long, toxic int")
    sent, learned = [], toxicity._learned
    monkeypatch.setattr(toxicity, "_learned", lambda texted, segment: sent.append(texted.count()) or learned(texted, segment))
    model = toxicity.train(docs, labels, max_rows=10)
    once = toxicity.train(docs.distinct(), labels, max_rows=10)
    assert sent == [11, 11]
    assert np.array_equal(model.weight, once.weight)
    assert model.bias == once.bias


def test_line_dedup_counts_alike_in_both_sql_modes_and_refuses_texts_as_ids(spark):
    from tidemark.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, "alone"), (4, None), (5, "")], "doc_id long, text string")
    got = []
    before = spark.conf.get("spark.sql.ansi.enabled")
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        got.append(sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(docs).collect()))
    spark.conf.set("spark.sql.ansi.enabled", before)
    assert got[0] == got[1]
    assert [r[2] for r in got[0]] == [0, 3, 0, 0, 0]
    with pytest.raises(ValueError, match="whole number"):
        dedup_lines(docs.withColumn("doc_id", F.col("doc_id").cast("string")))

"""Source divergence, SentencePiece and hard negatives against brute force and the library."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.divergence import _share, source_divergence
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.pieces import Pieces, decode, encode

DOCS = "doc_id long, text string, lang string, source string, rank string"


def divergence(rows, least, top):
    docs = [(t or "", a or "", s or "") for _, t, a, s, *_ in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, n = defaultdict(Counter), Counter()
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        seen[lang].update(set(words))
        n.update((lang, source, w) for w in words)
    out = set()
    for lang in {a for _, a, _ in docs}:
        kept = [w for w, k in seen[lang].items() if k >= least]
        sources = sorted({s for _, a, s in docs if a == lang})

        def shares(of):
            total = sum(n[lang, s, w] for s in of for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (sum(n[lang, s, w] for s in of) + 5) // total for w in kept}

        p, q = {s: shares([s]) for s in sources}, shares(sources)
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(q[w] - p[s][w], w) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def test_divergence(spark):
    rng = random.Random(5)
    words = ["tide", "Mark", "été", "ÉTÉ", "x1y", "a-b", "日本", "rare%d", "Zz"]
    rows = [(k, " ".join(rng.choice(words[: 2 + k % 8]) for _ in range(rng.randrange(12))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None]), "x") for k in range(300)]
    rows += [(None, None, "en", "only", "x"), (1, "tide " * 5_000, "en", "s1", "x"), (1, "tide tide", "en", "s1", "x"), (1, "tide tide", "en", "s1", "x"), (2, "alone", "xx", "a", "x"), (2, None, "xx", "b", "x")]
    for least, top in ((30, 50), (5, 2), (1, 3)):
        got = [tuple(r) for r in source_divergence(spark.createDataFrame(rows, DOCS).repartition(7), least, top).collect()]
        assert len(got) == len(set(got))
        assert set(got) == divergence(rows, least, top)
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact():
    totals = [7, 10**9 + 7, 8 * 10**15]
    for t in totals:
        for c in (1, t // 3, t - 1, t):
            assert _share(np.array([c]), np.array([t]))[0] == 1 + 10**9 * c // t


ODD = ["", "a", "   ", " a  b ", "日本語 ▁ x▁y", "\0x\0", "<s>hi</s><unk>", "😀👍🏽 é ﬁ ①𓀀", "\t\n\r  x　y ", "▁" * 9, "a" * 5_000, " " * 5_000 + "b", "﻿abc", "in 1995 the l33t  tide"]


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, None, "twice", "twice"])], "doc_id long, text string")
    coded = encode(df, model_path(), keep=("doc_id", "text"))
    for r in decode(coded, model_path(), keep=tuple(coded.columns)).collect():
        want = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want
        assert r["decoded"] == lib.decode(want)
        raw = (r["text"] or "").encode()
        assert b"".join(raw[a:z] for a, z in zip(r["starts"], r["ends"], strict=True)) == raw
    packed = decode(encode(df, model_path(), keep=("doc_id",), packed=True, round_trip=True).withColumnRenamed("decoded", "same"), model_path(), keep=("doc_id", "ids", "same"))
    for r in packed.collect():
        assert r["decoded"] == r["same"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode((*ODD, "", "twice", "twice")[r["doc_id"]], add_bos=True, add_eos=True)
    assert encode(df.limit(0), model_path(), keep=("doc_id",)).count() == 0
    with pytest.raises(ValueError, match="names of results"):
        encode(df.withColumn("Starts", F.lit(1)), model_path(), keep=("Starts",))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize(("dummy", "squeeze"), [(True, True), (False, True), (True, False)])
def test_pieces_normalise_by_the_models_map(tmp_path, rule, dummy, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.CopyFrom(rules.normalizer_spec)
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = dummy, squeeze, True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    own, lib = Pieces(str(tmp_path / "m")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    for text in [*ODD, "Ｆｕｌｌ　ｗｉｄｔｈ ½ ﷺ  Ⅷ é"]:
        ids, starts, ends = own.encode(text)
        want = lib.encode(text, return_type="proto").pieces
        assert ids[1:-1].tolist() == [p.id for p in want]
        assert list(zip(starts[1:-1], ends[1:-1], strict=True)) == [(p.begin, p.end) for p in want]
        assert own.decode(ids) == lib.decode([p.id for p in want])
    for ids in ([240, 65, 243, 300, 131], [259 + 3, 130, 400]):  # bytes that are no UTF-8
        assert own.decode(np.array(ids)) == lib.decode(ids)


def negatives(rows, k, positives):
    rows = list(dict.fromkeys((i, y, tuple(int(np.floor(256 * x)) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    out = Counter()
    for a in rows:
        if a[0] % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in rows if b != a)
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fit = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out.update((a[0], i, n, j, -s, -t) for n, (t, j, _) in enumerate(fit, 1))
    return out


@pytest.mark.parametrize(("block", "leaf", "fit"), [(40, 4, 64), (10_000, 16, 16_384)])
def test_hard_negatives(spark, block, leaf, fit):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(int(k), (centres[k % 6] + 0.3 * rng.normal(size=8)).tolist(), int(k % 4)) for k in range(1, 400)]
    hot = rng.normal(size=8).tolist()
    rows += [(1_000 + k, hot, k % 3) for k in range(90)]  # copies, anchors among them
    rows += [(2_000 + 10 * k, [0.5 * x for x in hot], 1) for k in range(3)] + [(10, rows[9][1], rows[9][2])]  # a repeated row
    rows += [(None, hot, 1), (3_000, None, 1), (3_010, hot, None), (3_020, [1.0, float("nan")], 1), (3_030, [1.0, None], 1), (3_040, [float("inf")], 1), (3_050, [1.0, 2.0], 1), (3_060, [0.0] * 8, 2), (3_070, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("win", F.lit("x"))
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, leaf=leaf, max_fit=fit)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == negatives(rows, 5, 5)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(10, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError, match="62 bits"):
        hard_negatives(spark.createDataFrame([(10, [1e8], 1)], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0)

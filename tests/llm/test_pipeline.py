"""The pipeline's stages on a small table set, and the operator queries against their SQL."""

import compare
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_line_dedup", "op6_decontamination", "op8_minhash_dedup", "op9_mixing"])
def test_query_matches_sql(spark, name):
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, SF)
    names, want = compare.sql_rows(SF, ORACLE_SQL[name], ["documents", "benchmark", "labels"])
    assert names == sorted(df.columns)
    assert compare.rows_of(df) == want


def test_stages_filter_and_keep_the_columns(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(p.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= n
        n = docs.count()
    mixed = p.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("taken"))
    both = docs.join(mixed, "doc_id", "left").select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("size"), F.coalesce("taken", F.lit(0)).alias("taken"))
    assert both.where("taken > 2 * size").count() == 0
    total = both.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[1] / total[0] - 1.5) < 0.1


def test_stages_on_odd_rows_against_brute_force(spark):
    """Nulls, empty and long texts, repeated rows, rows that share an id, and columns named like results."""
    import corpus_pipeline as p

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    plain = " ".join(f"word{i}" for i in range(40))
    near = plain.replace("word39", "other")
    texts = [(1, plain), (1, plain), (2, near), (3, None), (4, ""), (None, plain), (None, None), (5, f"so {item} it is"), (None, f"so {item} it is"), (6, "q " * 30_000), (7, "first line\nsecond line\nthird"), (8, "x\nfirst line\nsecond line\ny"), (9, "first line\nsecond line")]
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "a", None, True, 3, "z") for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_removed long, key string")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stage = dict(p.STAGES)
    got = rows(stage["line_dedup"](spark, docs, SF))
    want = [(i, {8: "x\ny"}.get(i, t)) for i, t in texts if i not in (2, 9)]
    assert got == sorted([*want, (2, near)], key=str)
    assert rows(stage["near_dedup"](spark, docs, SF)) == sorted([x for k, x in enumerate(texts) if k not in (1, 2)], key=str)
    assert rows(stage["decontamination"](spark, docs, SF)) == sorted([x for x in texts if item not in (x[1] or "")], key=str)
    stays = rows(stage["toxicity"](spark, docs, SF))
    assert len(stays) <= len(texts) and set(stays) <= set(texts) and (3, None) in stays
    taken = stage["mixing"](spark, docs, SF).collect()
    assert {r.doc_id for r in taken} <= {i for i, t in texts if t}
    assert all(len(r.text.split()) <= 128 for r in taken)


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0

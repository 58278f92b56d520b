"""The pipeline on small tables with planted cases, and the registered queries against DuckDB."""

import random

import duckdb
import pytest

import corpus_pipeline
from triloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple("" if x is None or x != x else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_planted_cases(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    rnd = random.Random(1)
    clean = next(r[1] for r in rows if r[2] == "en" and 600 < r[4] < 3000 and "@" not in r[1])
    words = clean.split()
    near = list(words)
    near[len(near) // 2] = "changed"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = [(10_000, clean + " unique words that nobody else has here", "en", "p", 1), (10_001, " ".join(near) + " unique words that nobody else has here", "en", "p", 1), (10_002, " ".join(rnd.sample(words, len(words))) + " " + item, "en", "p", 1), (10_003, " ".join(rnd.sample(words, len(words))) + " write to someone@mail.example.com soon", "en", "p", 1), (10_004, "12345 ... !!", "en", "p", 1), (10_005, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows + planted, base.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == base.columns
    language, near_dup, bench, private, _ = kept
    assert 10_004 not in language and 10_005 not in language and {10_000, 10_001, 10_002, 10_003} <= set(language)
    assert len(language) >= len(rows) * 0.98
    assert 10_001 not in near_dup
    assert item not in bench[10_002] and len(bench[10_002]) > len(clean) // 2
    assert "<email>" in private[10_003] and "@mail" not in private[10_003]
    untouched = [i for i in bench if near_dup[i] == bench[i]]
    assert len(untouched) > len(bench) * 0.8


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    extra = ["row", "row_key", "copy", "copies", "n_shingles", "component_id", "id", "place", "spans", "score", "probability", "kept"]
    text = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 600 and 3000").first().text
    base = spark.createDataFrame([(1, text, "en", "p", 1), (1, text, "en", "p", 1), (2, text, "en", "p", 1), (3, "", "en", "p", 0), (3, "", "en", "p", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in extra:
        base = base.selectExpr("*", f"concat('{name} ', doc_id) as {name}")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, base, folder)
        assert got.columns == base.columns
        rows = got.collect()
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in extra)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in rows) == [1, 3, 3]

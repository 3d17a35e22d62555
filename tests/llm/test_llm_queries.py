"""The registered queries: every one with SQL gives the rows that DuckDB gives; the others give their contract's columns."""

import base64
import os

import brute
import duckdb
import public_tokenizers
import pytest
import tiktoken

from slidespark.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op4_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_hmm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op12_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
        assert COLUMNS[name] <= set(found.columns) and {r["doc_id"] for r in found.collect()} == set(docs["doc_id"])
        return
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    cols = sorted(found.columns)
    assert cols == sorted(want.columns)
    a = sorted(tuple(map(str, r)) for r in found.select(*cols).collect())
    b = sorted(tuple(map(str, r)) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b


def test_suffix_dedup_judges_bytes_not_words(spark, tmp_path):
    """Passages of over 50 words, each in two documents: the query removes those of 400 bytes or more, and nothing else."""
    rows, repeats = [], []
    for n in range(6):
        # 60 words of 4 or of 8 bytes: 299 or 539 bytes
        passage = " ".join(f"{'p' if n % 2 else 'passa'}{n}{k:02d}" for k in range(60))
        for _ in range(2):
            own = chr(ord("a") + len(rows))
            rows.append((len(rows), f"before{own} {passage} {own}after"))
            repeats.append(f" {passage} " if n % 2 == 0 else "")
    rows.append((len(rows), " ".join(f"clean{k}" for k in range(100))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect()))
    assert found == sorted(brute.op4(rows))
    assert [(r[2], r[3]) for r in found] == [(len(p), int(p != "")) for p in [*repeats, ""]]


def test_suffix_dedup_against_all_windows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op4_suffix_dedup"](spark, SF).collect())) == sorted(brute.op4(rows))


def test_byte_bpe_against_the_library(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(brute.op12(docs, encoding))

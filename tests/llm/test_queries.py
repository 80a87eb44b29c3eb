"""The thin queries: SQL where there is some, columns of the rest."""

import pytest

from spanforge.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", queries.SQL)
def test_query_against_sql(spark, name):
    oracle.agree(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op4_edit_aware_counts", ["doc_id", "n_before", "n_after", "n_pretokens", "n_reencoded", "edited_sha256"]),
        ("op5_deobfuscated_toxicity", ["doc_id", "held_out", "score", "predicted"]),
        ("op7_site_style_tree", ["page_id", "url", "text", "n_chars"]),
        ("op8_pseudo_likelihood", ["doc_id", "n_words", "log_likelihood", "per_word"]),
        ("op10_bpe_round_trip", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    ],
)
def test_rows(spark, name, columns):
    df = queries.QUERIES[name](spark, oracle.DATA)
    assert df.columns == columns
    assert df.count() == queries.table(spark, oracle.DATA, "pages" if "page_id" in columns else "documents").count()


def test_bpe_query_is_the_library(spark):
    from hashlib import sha256

    import numpy as np
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.BPE_FILE)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_bpe_round_trip(spark, oracle.DATA).collect()}
    for r in queries.table(spark, oracle.DATA, "documents").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest())


def test_held_out_accuracy(spark):
    df = queries.op5_deobfuscated_toxicity(spark, "/root/testdata/sf0.1").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out")
    rows = [(r["predicted"], r["toxic"]) for r in df.collect()]
    assert sum(p == y for p, y in rows) / len(rows) > 0.95
    assert sum(p for p, y in rows if y) / sum(y for _, y in rows) > 0.85


def test_whitening_rows(spark):
    df = queries.op11_spectrum_slicing(spark, oracle.DATA)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert df.count() == 16 * queries.table(spark, oracle.DATA, "embeddings").count()
    assert df.agg({"identity_error": "max"}).first()[0] < 1e-4

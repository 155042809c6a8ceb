"""The registered queries: against their SQL where there is one, against plain versions where there isn't."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import queries
from tests.oracle import connect, kinds, kinds_of_sql, rows_of, rows_of_sql

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duck, sql = connect(SF), queries.oracle_sql()[name]
    df = queries.queries()[name](spark, SF)
    assert rows_of(df) == rows_of_sql(duck, sql)
    assert kinds(df) == kinds_of_sql(duck, sql)


def texts():
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return sorted(zip(table["doc_id"], (t or "" for t in table["text"])))


def library(name):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_against_the_library(spark):
    tok, want = library("word_bpe_49k.json"), []
    for i, t in texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = queries.op1_bpe_lexicon(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_op8_against_the_library(spark):
    tok, want, at = library("byte_bpe_50k.json"), [], 0
    for i, t in texts():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = queries.op8_token_files(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


def test_op4_columns(spark):
    rows = queries.op4_toxicity(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in texts()]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1


def test_op2_finds_what_asks(spark):
    rows = queries.op2_chroma_fingerprints(spark, SMALL).collect()
    asked = [r for r in rows if r["match"] is not None]
    assert len(asked) >= 0.9 * math.ceil(len(rows) / 20) and all(r["vec_id"] % 20 == 0 for r in asked)
    assert sum(r["offset"] == asked[0]["offset"] for r in asked) >= 0.9 * len(asked)

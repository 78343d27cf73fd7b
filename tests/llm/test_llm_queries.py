"""The registered corpus queries and the pipeline on the smallest tables, against SQL or brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from periodica.llm import queries as Q
from periodica.llm import langid, quality
from tests.llm.test_llm_small import awkward, brute_lm, brute_near

NAMES = ("op1_url_filter", "op2_packing", "op3_bpe", "op4_token_files", "op5_minhash_dedup", "op6_quality_rules", "op7_lm_scoring", "op8_vector_dedup", "op9_language_id", "op10_warc")


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(NAMES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = Q.queries()[name](spark, sf_dir).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None))) for f in (a, b)]
    assert rows[0] == rows[1]


def test_op1(spark, sf_dir):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    got = {r.page_id: r for r in Q.op1_url_filter(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for p in pages:
        _, sep, rest = (p.url or "").partition("://")
        host = re.split("[/?#]", rest)[0] if sep else ""
        path = re.split("[?#]", rest[len(host) :])[0] if sep else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
        if best is None and "spam-farm" in host:
            assert r.verdict == "block"


def packed_well(rows, ids, size):
    seqs = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * size and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    return len(seqs), -(-total // size)


def test_op2(spark, sf_dir, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    made, bound = packed_well(Q.op2_packing(spark, sf_dir).collect(), ids, 2048)
    assert made <= bound * 1.02 + 1


def test_op3_and_op4(spark, sf_dir, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in Q.op3_bpe(spark, sf_dir).collect():
        assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    got = {r.doc_id: r for r in Q.op4_token_files(spark, sf_dir).collect()}
    at = 0
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 0], "<u4").tobytes()))
        at += len(ids[i]) + 1


def test_op7(spark, sf_dir, texts):
    keys = sorted(texts)
    want = dict(zip(keys, brute_lm([texts[i] for i in keys], [zlib.crc32(str(i).encode()) % 7 != 2 for i in keys]), strict=True))
    rows = Q.op7_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(keys)
    for r in rows:
        n, k, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, n, k, total) and abs(r.base_score - base) < 1e-6 * abs(base)


def test_op9(spark, sf_dir, texts):
    rows = Q.op9_language_id(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))


def stage_by_stage(spark, docs, sf_dir):
    rng_docs = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rng_docs.orderBy("doc_id").collect()
        rng_docs = stage(spark, rng_docs, sf_dir)
        yield name, before, rng_docs


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_pipeline_stages(spark, sf_dir, table):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if table == "awkward":
        docs = awkward(spark)[0].selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'en' END AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars").unionByName(docs.where("doc_id >= 50"))
    for name, before, after in stage_by_stage(spark, docs, sf_dir):
        rows = after.collect()
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        kept = {r.doc_id for r in rows}
        if name == "language_id":
            model = langid.fit_on(docs)
            found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
            assert kept == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text) and found[r.doc_id].score >= 0.5 - 1e-6}
            assert len(kept) > 0.95 * sum(bool(r.text and any(c.isalpha() for c in r.text)) for r in before)
            old = {r.doc_id: r.lang for r in before}
            assert all(r.lang == (old[r.doc_id] or found[r.doc_id].lang_pred) for r in rows)
        elif name == "quality_rules":
            con = duckdb.connect()
            documents = spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string").toPandas()  # noqa: F841  read by name
            assert kept == {r[0] for r in con.sql(f"select doc_id from ({quality.ORACLE.format(docs='documents')}) where kept").fetchall()}
        elif name == "minhash_dedup":
            _, comp = brute_near([r.text for r in before], 5, 80)
            assert kept == {r.doc_id for r, c in zip(before, comp, strict=True) if before[c] is r}
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            made, bound = packed_well(rows, {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 0] for r in before}, 2048)
            assert made <= bound * 1.02 + 1


def test_pipeline_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, _, out in stage_by_stage(spark, docs, sf_dir):
        assert out.count() == 0

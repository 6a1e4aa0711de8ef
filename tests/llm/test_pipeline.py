"""The pipeline's stages on a small part of the tables, each against a brute-force version of its decision."""

import base64
import glob
import hashlib
import os
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_targets

from panelweave.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != "encode":
            assert out.columns == docs.columns
        if name == "quality":
            kept = {r["doc_id"] for r in out.collect()}
            clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
            assert sum(d in kept for d in clean) >= 0.97 * len(clean)
            assert sum(d in kept for d, r in labels.items() if r["quality"] == 0) <= 2
        if name == "language":
            assert out.count() >= 0.99 * docs.count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            parts = brute_components(rows, 4, 5)
            assert {r["doc_id"] for r in out.collect()} == {d for d, (_, c) in parts.items() if c == d}
        if name == "mix":
            sizes = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in docs.collect()}
            total, taken, largest = Counter(), Counter(), Counter()
            for s, n in sizes.values():
                total[s] += n
                largest[s] = max(largest[s], n)
            copies = Counter(r["doc_id"] for r in out.collect())
            for d, c in copies.items():
                assert c <= 3
                taken[sizes[d][0]] += c * sizes[d][1]
            want = brute_targets(dict(total))
            assert all(abs(taken[s] - want[s]) <= largest[s] for s in total) and sum(taken.values()) <= sum(total.values())
        if name == "encode":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in out.collect():
                ids = np.array(own.encode_ordinary(texts[r["doc_id"]] or ""), "<u4").tobytes()
                assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        counts.append(out.count())
        docs = out
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "mix", "encode"]
    assert counts[1] < counts[0] and counts[3] <= counts[2] and counts[5] == counts[4]


def test_search_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(queries.oracle_sql()["op9_topk_search"]).fetchall()
    got = queries.queries()["op9_topk_search"](spark, DATA).select("query_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_query_for_each_operator():
    assert [int(q[2:].split("_")[0]) for q in queries.queries()] == list(range(1, 11))


def test_stages_take_hard_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clash = ["row", "key", "size", "copies", "p_top", "expected_grade", "lang_pred", "node", "component", "text_key", "id", "_order"]
    hard = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", None, 0), (900002, "", None, "src1", 0), (900003, "x" * 200_000, "en", "src1", 200_000), (900004, "the end of it", "en", None, 13), (900004, "the end of it", "en", None, 13), (900005, "12 34", "", "", 5)], docs.schema)
    docs = docs.union(hard).withColumns({c: F.lit("mine") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name == "encode":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns and out.where(" or ".join(f"`{c}` <> 'mine'" for c in clash)).count() == 0, name
        nothing = stage(spark, docs.limit(0), DATA)
        assert nothing.columns == docs.columns and nothing.count() == 0, name
        docs = out


def rows_of(spark, name):
    return queries.queries()[name](spark, DATA).collect()


def test_text_queries_on_whole_tables(spark):
    """The contract queries against plain Python over the smallest tables."""
    import tiktoken
    from tokenizers import Tokenizer

    docs = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    texts = {d: t or "" for d, t, _, _ in docs}
    parts = brute_components([(d, t) for d, t, _, _ in docs], 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(spark, "op1_minhash_near_dedup")} == {d: (n, c, c == d) for d, (n, c) in parts.items()}
    phrases = {r["doc_id"]: (r["n_base"], r["base_labels"], r["labels"]) for r in rows_of(spark, "op2_license_scan")}
    assert phrases.keys() == texts.keys() and all((n > 0) == bool(base) and set(base.split(",")) <= set(labels.split(",")) for n, base, labels in phrases.values() if base)
    assert {r["doc_id"] for r in rows_of(spark, "op3_quality_classifier")} == set(texts)
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op4_token_records")}
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    spoken = {r["doc_id"]: (r["held_out"], r["lang_pred"]) for r in rows_of(spark, "op5_language_id")}
    assert all(spoken[d][0] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in texts)
    known = [(spoken[d][1], lang) for d, t, lang, _ in docs if lang is not None and spoken[d][0] and any(c.isalpha() for c in t or "")]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows_of(spark, "op7_byte_bpe"):
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    mixed = {r["doc_id"]: r for r in rows_of(spark, "op8_source_mixing")}
    total = Counter()
    for d, t, _, s in docs:
        total[s] += len((t or "").split())
    want = brute_targets(dict(total))
    assert all(mixed[d]["target"] == pytest.approx(want[s]) and mixed[d]["source_size"] == total[s] and mixed[d]["size"] == len((t or "").split()) for d, t, _, s in docs)
    prints = {r["doc_id"]: r for r in rows_of(spark, "op10_document_fingerprints")}
    order = sorted(texts)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[d], texts[after]
        assert prints[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() and prints[d]["n_chars"] == len(t)


def test_page_query_on_the_whole_table(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    last = {}
    for p, body in sorted(pages.items()):
        last[body] = p
    for r in rows_of(spark, "op6_warc"):
        body = pages[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[body] == r["page_id"] else ("revisit", last[body]))

"""The pipeline against plain Python, stage by stage, and as a whole."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from test_lines_rules import slow_lines
from test_search import slow_components, slow_matches, words_of

import corpus_pipeline
from lakeforge.llm import packing, quality
from lakeforge.llm.common import table


def slow_quality_stage(docs):
    out = []
    for r in docs:
        *_, kept, stay = quality.judge((r.text or "").encode())
        if kept:
            out.append((r.doc_id, r.text if stay is None else b"\n".join(stay).decode()))
    return out


def pairs(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_stages_match_brute_force(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{k}")
        after = spark.read.parquet(f"file://{tmp_path}/{k}")
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "packing":
            assert after.columns == columns
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "quality rules":
            assert pairs(after) == Counter(slow_quality_stage(docs.collect()))
        elif name == "line dedup":
            want = {(i, n - gone) for i, n, gone, _ in slow_lines(before)}
            got = {(r.doc_id, r.text.count("\n") + 1 if r.text or n_left(want, r.doc_id) else 0) for r in after.collect()}
            assert got == want
        elif name == "near duplicates":
            kept = {i for i, _, _, stays in slow_components(before) if stays}
            assert pairs(after) == Counter(x for x in before if x[0] in kept)
        elif name == "decontamination":
            found = {i for i, _ in slow_matches(before, [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])}
            assert pairs(after) == Counter(x for x in before if x[0] not in found)
        else:
            encode = packing.encoder(packing.default_tokenizer())
            pieces = defaultdict(list)
            for r in after.collect():
                pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
            for i, text in before:
                ids = np.frombuffer(encode((text or "").encode()), encode.kind)
                at = 0
                for start, length, crc in sorted(pieces[i]):
                    assert start == at and zlib.crc32(ids[at : at + length].astype("<u4").tobytes()) == crc
                    at += length
                assert at == len(ids)
        docs = after


def n_left(want, doc_id):
    return any(i == doc_id and n for i, n in want)


def test_odd_and_empty_documents_pass_all_stages(spark, sf, odd_docs, no_docs):
    shape = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (shape, shape.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.count()
            if name != "packing":
                assert out.columns == docs.columns and rows <= docs.count()
    assert words_of(None) == []


def test_run_and_query(spark, sf):
    import __spark_entry__

    rows = __spark_entry__.queries()["pipeline"](spark, sf).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_oracles_match(spark, sf):
    import duckdb
    from pyspark.sql import functions as F

    from lakeforge.llm import entries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in entries.ORACLE.items():
        got, want = entries.QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        kinds = {c: k for c, k in got.dtypes}
        assert all(k != "binary" for k in kinds.values())
        rows = Counter(tuple(r) for r in got.select(*(F.col(c) for c in want.columns)).collect())
        assert rows == Counter(want.fetchall()), name

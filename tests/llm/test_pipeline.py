"""The pipeline against its stages done by brute force, and the registered queries on a small table."""

from collections import Counter

import numpy as np

import __spark_entry__ as driver
import corpus_pipeline
from quernal.llm import bpe, mixing, quality
from quernal.llm.queries import TOKENIZERS, VOCABULARY
from tests.llm.test_dedup import ascii_lower, brute_near

PATH = f"{TOKENIZERS}/{VOCABULARY}"


def test_pipeline(spark, prose, tmp_path):
    rows, marks = [], []
    for i in range(160):
        good = i % 5 != 0
        rows.append((i, prose(i, 70).capitalize() + "." if good else " | ".join(prose(i, 60).split()), "en", f"s{i % 4}", 0))
        marks.append((i, int(good), 0))
    for i in range(1, 30):
        w = rows[i][1].split()
        w[3] = "changed"
        rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s1", 0), (400 + i, " ".join(w), "en", None, 0)]
    rows += [(600, None, None, None, None), (601, "", "en", "s1", 0), (602, rows[2][1], "en", "s2", 0), (602, rows[2][1], "en", "s2", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1)
    labels.write.parquet(f"{sf}/labels.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = Counter((r.id, r.predicted) for r in quality.classify(docs, labels).collect())
    left = [r for r in rows if good[r[0], 1]]
    assert any(good[i, 0] for i in range(160)) and len(left) > 120
    best = {}
    for r in left:
        key = ascii_lower(r[1])
        if key not in best or r[0] > best[key][0]:
            best[key] = r
    left = list(best.values())
    _, roots = brute_near([(r[0], r[1], r[3]) for r in left])
    left = [r for r in left if roots[r[0]] == r[0]]
    sized = spark.createDataFrame([(r[0], r[3], len((r[1] or "").split())) for r in left], "id long, source string, size long")
    copies = {r.id: r.copies for r in mixing.mix(sized).collect()}
    tok = bpe.tokenizer(PATH)
    want = Counter()
    for r in left:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        if copies[r[0]]:
            want[r[0], len(ids), np.array(ids, "<u4").tobytes()] = copies[r[0]]
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_columns(spark, prose, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 30), "en", "s", 0) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_last_stage_encodes_and_decodes(spark, make, prose, tmp_path):
    texts = [prose(1, 50), "Don't, <|startoftext|>É  12!!<|endoftext|>", "", None, " \n", "ab" * 40_000, prose(2, 20_000), prose(1, 50)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "one id, another text", None), (None, "no id", "s")]
    got = corpus_pipeline.STAGES[-1][1](spark, make(rows), str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    tok, want = bpe.tokenizer(PATH), Counter()
    for i, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got.collect()) == want


def test_registered():
    names = list(driver.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {n for n in driver.oracle_sql() if n.startswith("op")} == {"op1_embedding_dedup", "op2_exact_dedup", "op4_mixing", "op9_near_dedup"}

"""The pipeline as a whole, stage by stage from scratch in plain Python."""

import random
import re

import corpus_pipeline
import numpy as np
from tessera.llm import language_id, secret_scan
from test_models import brute_language
from test_similar_texts import groups
from test_texts import base, check_documents, check_sequences, whole

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(documents):
    """Documents with exact and near copies, secrets, texts of other languages, and rows without text or identifier."""
    rng = random.Random(21)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents.where("length(text) < 4000").limit(70).collect()]
    texts = [r[1] for r in rows if len(r[1].split()) > 60][:12]
    at = 1000
    for k, t in enumerate(texts):
        words = t.split()
        for changed in (0, 1, 2, 40):
            copy = list(words)
            for p in rng.sample(range(len(copy)), min(changed, len(copy))):
                copy[p] = f"new{rng.randrange(10**6)}"
            rows.append((at, t if changed == 0 else " ".join(copy), rows[k][2], "src1", None))
            at += 1
    text = texts[0]
    rows += [
        (at, f"password = 'hunter2hunter{k}'\n{texts[k % 5][:150]} zq{k}", "en", "src2", 10) for k, at in enumerate(range(2000, 2006))
    ] + [
        (3000, "Questa è una frase scritta in lingua italiana che parla del tempo e delle stagioni dell'anno", "it", "src3", 5), (3001, "これは日本語の文章です。天気と季節について書いています。", None, None, 5),
        (3002, None, "en", "src1", None), (3003, "", "en", "src1", 0), (3004, "12345 67890", "en", "src1", 3), (None, text, "en", "src1", 7), (None, text, "en", "src1", 7), (3005, text, "en", "src1", 7), (3005, text, "en", "src1", 7),
    ]
    return rows


def expected(rows, model):
    """Documents that reach packing, by the definitions of the stages."""
    said = brute_language([{"text": t, "host": s, "declared": None, "address": None} for _, t, _, s, _ in rows], model)
    rows = [r for r, (lang, p) in zip(rows, said, strict=True) if lang != language_id.OTHER and p >= language_id.ACCEPT and any(c.isalpha() for c in r[1] or "")]
    keep = {}
    for i, t, *_ in rows:
        keep[t] = max(keep.get(t, -1), i if i is not None else -1)
    once, left = set(), []
    for r in rows:
        if r[0] is None:
            left.append(r)  # can't be told apart, so it stays
        elif keep[r[1]] == r[0] and (r[0], r[1]) not in once:
            once.add((r[0], r[1]))
            left.append(r)
    group = groups([r[:2] for r in left if r[0] is not None])
    left = [r for r in left if r[0] is None or group[r[0]] == r[0]]
    out = []
    for i, t, *_ in left:
        hidden = np.zeros(len(t), dtype=bool)
        for _, a, b in [*base(t), *((k, a, b) for a, b, k in secret_scan.lexed_spans(t))]:
            hidden[a:b] = True
        clean = "".join("\0" if h else c for c, h in zip(t, hidden, strict=True))
        out.append((i, "[REDACTED]".join(re.split("\0+", clean))))
    return out


def test_run_matches_brute_force(spark, documents, tmp_path):
    rows = corpus(documents)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = expected(rows, language_id.train(docs))
    assert 20 < len(want) < len(rows) - 20
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_documents([r for r in want if r[0] is not None], [p for p in got if p["doc_id"] is not None])
    check_sequences(got)
    lost = [r for r in want if r[0] is None]
    assert len(lost) == 2 and sum(p["length"] for p in got if p["doc_id"] is None) == sum(len(whole(t)) + 1 for _, t in lost)


def test_stages_keep_the_columns_of_documents(spark, documents, tmp_path):
    empty = documents.limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, empty, "")
        assert out.collect() == []
        if name != "packing":
            assert out.schema.simpleString() == documents.schema.simpleString()

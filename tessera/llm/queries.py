"""Registered queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio_fingerprint import linked
from .common import table
from .exact_dedup import exact_duplicates
from .html_extract import extract_pages
from .language_id import identify, markup_language, page_words, url_host
from .language_id import train as train_language
from .lexical_search import search
from .packing import pack, word_encoder
from .piece_tokens import encode_documents
from .secret_scan import scan_secrets
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats
from .toxicity import score_documents, train
from .vector_codes import encode as encode_vectors
from .vector_join import near_vectors


#: Vocabulary files of public tokenizers.
WORD_VOCABULARY, PIECE_VOCABULARY = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without site templates and furniture."""
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings (a word a frame): each one's class of equal fingerprints, and its links to those
    with an identifier divisible by 100."""
    return linked(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document (by its text and its source) and of every page (by its text, its declared
    language, its address and its host's domains).  What ``lang`` says of a document only trains the model."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    model = train_language(docs)
    found = ["lang", "confidence", "text_lang", "accepted"]
    of_docs = identify(docs, model, F.col("text"), host=F.col("source"), keep=["doc_id"])
    of_pages = identify(pages, model, page_words(F.col("html")), host=url_host(F.col("url")), declared=markup_language(F.col("html")), url=F.col("url"), keep=["page_id"])
    none = F.lit(None).cast("long")
    return of_docs.select("row.doc_id", none.alias("page_id"), *found).unionByName(of_pages.select(none.alias("doc_id"), "row.page_id", *found))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of three-word shingles of every document and its component at 3 or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that also start earlier."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), length=20)


def op6_piece_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """Piece ids of every document (their number and a checksum), and whether its text comes back."""
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary, with_ids=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the document with the largest identifier stays."""
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), keep="max")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by the base patterns and by assignments."""
    return scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    """Pieces of training windows of 4096 tokens that hold every document."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), word_encoder(vocabulary), end_id=2, window=4096)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), k=50)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 16 parts, 64 entries, two rounds."""
    return encode_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector with those of its label at a cosine of 0.98 or more, and its component."""
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), cosine_at_least=0.98)


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS rn FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE rn > 1),
x AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda v, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h, t)
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def _assigned(rows: str, book: str) -> str:
    """SQL: every part of ``rows`` with its nearest entry of ``book``."""
    return f"""SELECT vec_id, label, r.p, r.x, arg_min(b.k, (list_sum(list_transform(range(1, len(r.x) + 1), lambda i: (r.x[i] - b.x[i]) * (r.x[i] - b.x[i]))), b.k)) AS k,
       CAST(min(list_sum(list_transform(range(1, len(r.x) + 1), lambda i: (r.x[i] - b.x[i]) * (r.x[i] - b.x[i])))) AS BIGINT) AS far
FROM {rows} r JOIN {book} b ON r.p = b.p GROUP BY vec_id, label, r.p, r.x"""


def _moved(book: str, assigned: str) -> str:
    """SQL: ``book`` with every used entry at the floored mean of its parts."""
    return f"""SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
  SELECT p, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (SELECT p, k, i, sum(v)::DOUBLE AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {assigned}) GROUP BY p, k, i) GROUP BY p, k
) m ON b.p = m.p AND b.k = m.k"""


OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
r AS MATERIALIZED (SELECT vec_id, label, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM r) WHERE k < 64),
a0 AS MATERIALIZED ({_assigned("r", "b0")}),
b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("r", "b1")}),
b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("r", "b2")}),
o AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM o
"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS vec_id, CAST((SELECT count(*) FROM l WHERE l.a = r.a) AS BIGINT) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM r GROUP BY a
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_audio_fingerprint": op2_audio_fingerprint,
        "op3_language_id": op3_language_id,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_piece_tokens": op6_piece_tokens,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_lexical_search": op11_lexical_search,
        "op12_vector_codes": op12_vector_codes,
        "op13_vector_dedup": op13_vector_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op11_lexical_search": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_vector_dedup": OP13_SQL}

"""Language identification by Bayesian fusion of four kinds of evidence.

- text: naive Bayes over hashed character trigrams, tempered because trigrams aren't independent;
- the language that the markup (or the source's metadata) declares, with a stated reliability;
- the address: a country suffix or a language segment of its path;
- the host: a prior from all documents of the host, smoothed towards its parent domain's, that
  towards the next one's, up to the corpus as a whole.

Beside the languages of the model there is one outcome more, OTHER: under it all trigrams are equally
likely, and it is what a declaration of any other language speaks for.

Host priors are sums of text posteriors grouped by host (combined before the shuffle); the
hierarchy is worked out over distinct domains only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from .common import limit_batches, stage

LANGUAGES, OTHER = ("en", "de", "fr", "es"), "other"
#: About so many labelled texts of each language, taken by a hash of the identifier, fit the trigram model.
SAMPLE = 1500
#: Buckets of trigrams.
BUCKETS = 1 << 15
#: Weight of a trigram's log-likelihood, and the most that text evidence may say for one language over another.
TEMPER, MOST_TEXT = 0.25, 30.0
#: Share of declarations, and of addresses with a language, that are right.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.85, 0.8
#: Documents' worth of parent prior that a host's own counts are smoothed with, at each level.
SMOOTHING = 5.0
#: A document is accepted if it has a letter and its best outcome is a language with at least this probability.
ACCEPT = 0.5
#: Host tables of up to so many rows are broadcast.
BROADCAST_ROWS = 50_000
_CHUNK = 1 << 18
#: Parts that a hash of identifiers deals labelled texts into.
SHARES = 1 << 20
# Country suffixes of the languages.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "li": "de", "fr": "fr", "be": "fr", "lu": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}
_LETTER = re.compile(r"[^\W\d_]")
# what stands between white space, if it holds no digit or sign of addresses and code
_TOKEN = re.compile(r"(?<!\S)[^\s\d@/\\=_#<>|{}]+(?!\S)")
_SIGNS = re.compile(r"[\W\d_]+")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of all texts' letters (lower case, a space for whatever stands between;
    numbers, addresses and other words with digits or signs of code are left out) and the text of each trigram."""
    flat = [_SIGNS.sub(" ", " " + " ".join(_TOKEN.findall(t.lower())) + " ") for t in texts]
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    sizes = np.array([len(t) for t in flat])
    owner = np.repeat(np.arange(len(flat)), sizes)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    mix = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mix ^= mix >> np.uint32(15)
    within = owner[:-2] == owner[2:]
    return (mix[within] % np.uint32(BUCKETS)).astype(np.int64), owner[:-2][within]


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about _CHUNK characters, with the place of the first."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _CHUNK:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


@dataclass
class TextModel:
    """Log-likelihoods of trigrams by outcome, the languages and OTHER last."""

    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x outcomes

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Tempered log-likelihood of each text by language, the best at 0 and none under -MOST_TEXT."""
        out = np.zeros((len(texts), self.table.shape[1]))
        for at, part in _parts(texts):
            bucket, owner = trigrams(part)
            for k in range(self.table.shape[1]):
                out[at : at + len(part), k] = np.bincount(owner, weights=self.table[bucket, k], minlength=len(part))
        out *= TEMPER
        return np.maximum(out - out.max(axis=1, keepdims=True), -MOST_TEXT) if len(texts) else out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> TextModel:
    """Trigram model from about ``sample`` texts declared to be in each language (all, where there are
    fewer): one scan counts the labels, one reads the texts.  Rows without an identifier are left out."""
    of = F.coalesce(*[F.when(F.col(label_col) == l, k) for k, l in enumerate(languages)])
    labelled = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"), of.alias("k")).where("k is not null")
    found = {r["k"]: r["count"] for r in labelled.groupBy("k").count().collect()}
    most = {k: min(SHARES, -(-SHARES * sample // n)) for k, n in found.items()}
    share = F.coalesce(*[F.when(F.col("k") == k, m) for k, m in most.items()], F.lit(0))
    rows = limit_batches(labelled.where(F.pmod(F.xxhash64("row_id"), F.lit(SHARES)) < share)).select("k", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, dtype=np.int64)
        for batch in batches:
            k = np.array(batch.column("k").to_pylist(), dtype=np.int64)
            texts = [t or "" for t in batch.column("body").to_pylist()]
            for at, part in _parts(texts):
                bucket, owner = trigrams(part)
                total += np.bincount(k[at : at + len(part)][owner] * BUCKETS + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    counts = np.zeros(len(languages) * BUCKETS)
    for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(len(languages), BUCKETS)
    # every language's counts lean on all languages' together
    shared = counts.sum(axis=0) + 1.0
    shared /= shared.sum()
    p = (counts + 2000.0 * shared) / (counts.sum(axis=1, keepdims=True) + 2000.0)
    return TextModel(tuple(languages), np.log(np.concatenate([p, np.full((1, BUCKETS), 1 / BUCKETS)])).T.copy())


def with_text_evidence(df: DataFrame, model: TextModel, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` plus ``evidence`` (array of log-likelihoods by language) and ``letters``."""
    source = limit_batches(df).select(*keep, text.alias("body"))
    kept = [f.name for f in source.schema.fields if f.name != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("body").to_pylist()]
            e = model.evidence(texts)
            cols = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(e), pa.list_(pa.float64())), pa.array([_LETTER.search(t) is not None for t in texts], pa.bool_())], names=[*kept, "evidence", "letters"])

    schema = source.drop("body").schema.add("evidence", ArrayType(DoubleType())).add("letters", BooleanType())
    return source.mapInArrow(run, schema)


def host_priors(by_host: DataFrame, n_languages: int, smoothing: float = SMOOTHING) -> DataFrame:
    """``host, prior`` (array of log-probabilities) from ``host, counts`` (array of soft counts).

    Every host's counts are added to each of its domains (``a.b.c``: ``c``, ``b.c``, ``a.b.c``), however many it has;
    from the corpus downwards, each level's distribution is its own counts plus ``smoothing``
    documents distributed like its parent.
    """
    n = n_languages
    # element 0 is the corpus itself, which no domain can be called
    domains = F.expr("concat(array('.'), transform(sequence(1, size(split(host, '[.]'))), d -> array_join(slice(split(host, '[.]'), -d, d), '.')))")
    node = stage(by_host.select("host", "counts", F.posexplode(domains).alias("depth", "node")), "host-domains")
    sums = node.groupBy("depth", "node").agg(F.array(*[F.sum(F.col("counts")[k]) for k in range(n)]).alias("c"))
    of_host = node.select("host", "depth", "node").join(sums, ["depth", "node"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("depth", "c"))).alias("way"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    start = F.transform(F.array_repeat(F.lit(1.0 / n), n), lambda x: x)
    level = lambda p, x: F.zip_with(x["c"], p, lambda c, q: (c + F.when(x["depth"] == 0, float(n)).otherwise(smoothing) * q) / (total(x["c"]) + F.when(x["depth"] == 0, float(n)).otherwise(smoothing)))
    return of_host.select("host", F.transform(F.aggregate("way", start, level), lambda p: F.log(p)).alias("prior"))


def _posterior(evidence: Column) -> Column:
    top = F.array_max(evidence)
    e = F.transform(evidence, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _told(language: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log-likelihoods of a statement of the language by outcome: one of none that is known speaks for OTHER,
    '' for nothing."""
    wrong = float(np.log((1 - right) / len(languages)))
    said = F.when(language.isin(*languages), language).otherwise(OTHER)
    return F.array(*[F.when(language == "", 0.0).when(said == l, float(np.log(right))).otherwise(wrong) for l in (*languages, OTHER)])


def declared_language(column: Column) -> Column:
    """Primary subtag of a declared language, in lower case; null stays null."""
    return F.lower(F.regexp_extract(F.trim(column), r"^([A-Za-z]{2,3})\b", 1))


def markup_language(html: Column) -> Column:
    """What a page's root element, the first of its kind, declares, '' if nothing."""
    root = F.regexp_extract(html, r"(?i)<html\b([^>]*+)", 1)
    return F.regexp_extract(root, r"""(?i)\blang\s*+=\s*+["']?([A-Za-z-]+)""", 1)


def page_words(html: Column) -> Column:
    """A page's words for its language: without scripts, styles, comments and tags (character references stay).
    A tag that another one begins in is none."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)", " ")
    return F.regexp_replace(bare, r"<[^<>]*+>|&[#\w]*+;", " ")


def url_host(url: Column) -> Column:
    """Host of an address in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


def address_language(url: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Language by the first or second path segment, else by a query value (``lang``, ``hl``, ``locale``, ``language``),
    else by the host's country suffix; null if none tells."""
    listed = "|".join(languages)
    path = F.regexp_extract(url, rf"(?i)//[^/]++/(?:[^/]++/)?({listed})(?=[/?#.]|$)", 1)
    asked = F.regexp_extract(url, rf"(?i)[?&](?:lang|hl|locale|language)=({listed})(?![A-Za-z])", 1)
    suffix = F.lower(F.regexp_extract(url, r"(?i)//[^/?#]*?\.([a-z]{2})(?::\d+)?(?=[/?#]|$)", 1))
    country = F.coalesce(*[F.when(suffix == s, l) for s, l in SUFFIXES.items() if l in languages], F.lit(None).cast("string"))
    return F.when(path != "", F.lower(path)).when(asked != "", F.lower(asked)).otherwise(country)


def identify(df: DataFrame, model: TextModel, text: Column, host: Column | None = None, declared: Column | None = None, url: Column | None = None, accept: float = ACCEPT, keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``row`` (a struct of the columns ``keep`` of ``df``, by default all), ``lang``, ``confidence``,
    ``text_lang``, ``accepted`` for each row of ``df``.

    Texts are read once: their evidence is kept as a table, from which the hosts' priors and the result
    come.  A null text is empty; without letters there is no text evidence and the row isn't accepted.
    Null declarations, addresses and hosts are no evidence (rows without a host share one).  Ties
    go to the language named first.  Repeated rows count each.  Columns of any name may be kept.  An empty
    table gives an empty result.
    """
    languages, n = model.languages, len(model.languages) + 1
    none = F.lit(None).cast("string")
    host = F.lower(F.coalesce(host if host is not None else none, F.lit("")))
    columns = [F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"), host.alias("host"), F.coalesce(declared_language(declared) if declared is not None else none, F.lit("")).alias("declared"),
               F.coalesce(address_language(url, languages) if url is not None else none, F.lit("")).alias("address")]
    rows = stage(with_text_evidence(df, model, text, columns), "text-evidence")
    by_host = rows.select("host", _posterior(F.col("evidence")).alias("p")).groupBy("host").agg(*[F.sum(F.col("p")[k]).alias(f"c{k}") for k in range(n)])
    priors = stage(host_priors(by_host.select("host", F.array(*[f"c{k}" for k in range(n)]).alias("counts")), n), "host-priors")
    small = priors.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = rows.join(F.broadcast(priors) if small else priors, "host", "left")
    told = F.zip_with(_told(F.col("declared"), languages, DECLARED_RIGHT), _told(F.col("address"), languages, ADDRESS_RIGHT), lambda a, b: a + b)
    evidence = F.zip_with(F.zip_with("evidence", "prior", lambda a, b: a + F.coalesce(b, F.lit(0.0))), told, lambda a, b: a + b)
    rows = rows.select("row", "letters", "evidence", _posterior(evidence).alias("p"))
    names = F.array(*[F.lit(l) for l in (*languages, OTHER)])
    best = F.array_max("p")
    lang = names[F.array_position("p", best).cast("int") - 1]
    return rows.select(
        "row", lang.alias("lang"), best.alias("confidence"),
        F.when(F.col("letters"), names[F.array_position("evidence", F.array_max("evidence")).cast("int") - 1]).alias("text_lang"),
        (F.col("letters") & (best >= accept) & (lang != OTHER)).alias("accepted"))

"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a document's language are combined:

* the text: hashed byte-trigram likelihoods of a multinomial model for each
  language, tempered so that a long text doesn't drown everything else;
* the language that the markup declares;
* the suffix of the address (top-level domain);
* the host, by a prior that is smoothed hierarchically: a host's counts back
  off to those of its suffix, and these to the counts of all documents.

How far a declaration or a suffix is to be trusted isn't set by hand: grouped
aggregation counts how often each goes with each language of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, written

LANGUAGES = ("en", "fr", "de", "es")
#: Buckets of the hashed byte trigrams.
BUCKETS = 1 << 16
#: Bytes of a text that are looked at together.
BLOCK = 1 << 16
#: The text model is fitted on about this many labelled documents a language, taken by the hash of their id.
FIT_DOCS = 500
#: A text counts as at most this many independent trigrams.
EVIDENCE = 60.0
#: Pseudo-counts with which a host leans on its suffix, and a suffix on all documents.
SMOOTH = 20.0
ADD = 0.5
LEAST_POSTERIOR = 0.5


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram of lower-cased text; data is uint8."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    low = np.where((low >= 48) & (low <= 57), np.uint32(48), low)  # digits alike
    mixed = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA6B) + low[2:] * np.uint32(0xC2B2AE35)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def fit_text_model(docs: DataFrame, id_col: str, text_col: str, label_col: str, languages: tuple[str, ...] = LANGUAGES, fit_docs: int = FIT_DOCS) -> np.ndarray:
    """log P(bucket | language), BUCKETS x languages, of a bounded sample of labelled rows; add-ADD smoothing.

    A language's rows are taken by the hash of their id, whole texts, about
    ``fit_docs`` of them. Only sums by bucket come to the driver. A language
    without texts gets a uniform model.
    """
    rows = docs.where(F.col(label_col).isin(*languages) & F.col(text_col).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}  # one row a language
    place = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    share = reduce(lambda c, k: c.when(F.col(label_col) == k, F.lit(min(1.0, fit_docs / n[k]) * 2.0**32)), n, F.when(F.lit(False), F.lit(0.0)))
    taken = rows.where(place < share).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_py().encode("utf-8"), np.uint8)
                for at in range(0, max(0, len(data) - 2), BLOCK):
                    seen[languages.index(label)] += np.bincount(trigram_buckets(data[at : at + BLOCK + 2]), minlength=BUCKETS)
        which, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(seen[which, bucket])], names=["which", "bucket", "n"])

    sums = taken.mapInArrow(count, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS x languages at most
    counts = np.full((BUCKETS, len(languages)), ADD)
    counts[sums.column("bucket").to_numpy(), sums.column("which").to_numpy()] += sums.column("n").to_numpy()
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_likelihoods(docs: DataFrame, columns: dict[str, Column], text_col: str, model: np.ndarray, evidence: float) -> DataFrame:
    """columns of docs with ``ll`` (tempered log-likelihood by language), ``noise_ll`` (of a uniform model) and ``n_grams``."""
    carried = list(columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, 1 MB for four

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        width = table.shape[1]
        for batch in batches:
            texts = batch.column("_text")
            ll, noise, n_grams = [], [], []
            for text in texts:
                data = np.frombuffer((text.as_py() or "").encode("utf-8"), np.uint8)
                total, n = np.zeros(width), max(0, len(data) - 2)
                for at in range(0, n, BLOCK):
                    total += table[trigram_buckets(data[at : at + BLOCK + 2])].sum(axis=0, dtype=np.float64)
                weight = min(1.0, evidence / n) if n else 0.0
                ll.append((total * weight).tolist())
                noise.append(-np.log(BUCKETS) * n * weight)
                n_grams.append(n)
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ll, pa.list_(pa.float64())), pa.array(noise, pa.float64()), pa.array(n_grams, pa.int64())], names=[*carried, "ll", "noise_ll", "n_grams"])

    rows = docs.select(*[c.alias(k) for k, c in columns.items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(score, f"{schema}, ll array<double>, noise_ll double, n_grams long")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    label_col: str | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    model: np.ndarray | None = None,
    fit_docs: int = FIT_DOCS,
    evidence: float = EVIDENCE,
    smooth: float = SMOOTH,
    least_posterior: float = LEAST_POSTERIOR,
) -> DataFrame:
    """One row for each row of docs: ``doc_id, language, posterior, text_language, declared, host, n_grams, rejected``.

    ``declared``, ``suffix`` and ``host`` are columns over docs; one that is
    None, or null or empty in a row, is no evidence there. The text model is
    ``model``, or is fitted on a bounded sample of rows labelled by
    ``label_col`` (see FIT_DOCS), which then shouldn't be evidence as well;
    all counts for the other evidence cover all rows. ``text_language`` is the language by text alone, of equal ones the
    first in ``languages``; ``language`` the one with the largest posterior.

    Null and empty values of host, suffix and declaration are one value, no
    evidence. A document is rejected if its text is null or empty, if a uniform model
    explains its bytes better than every language does, or if no language
    reaches ``least_posterior``; its ``language`` is then 'und'. A text of one
    or two bytes has no trigram and goes by the other evidence. Whole texts are read. Repeated rows each get
    their row; an empty table gives no rows; other columns are not looked at.
    """
    if model is None:
        model = fit_text_model(docs, id_col, text_col, label_col, languages, fit_docs)

    def or_empty(c: Column | None) -> Column:
        return F.coalesce((c if c is not None else F.lit("")).cast("string"), F.lit(""))

    columns = {"doc_id": F.col(id_col), "declared": or_empty(declared), "suffix": or_empty(suffix), "host": or_empty(host), "filled": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) > 0}
    rows = written(text_likelihoods(docs, columns, text_col, model, evidence).withColumn("best", F.array_position("ll", F.array_max("ll")).cast("int") - 1), "language-text")
    sure = rows.where((F.col("n_grams") > 0) & (F.array_max("ll") > F.col("noise_ll")))
    width = range(len(languages))
    counted = [F.count_if(F.col("best") == k).cast("double") for k in width]

    def counts_by(*keys: str) -> DataFrame:
        return sure.groupBy(*keys).agg(F.array(*counted).alias("_c"))

    total = sure.agg(*counted).first()
    of_all = [(x or 0.0) + 1.0 for x in total] if total else [1.0] * len(languages)
    base = [x / sum(of_all) for x in of_all]

    def share(c: Column, prior: Column) -> Column:
        n = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(c, prior, lambda x, p: (x + F.lit(smooth) * p) / (n + F.lit(smooth)))

    everywhere = F.array(*[F.lit(x) for x in base])
    suffixes = counts_by("suffix").select("suffix", share(F.col("_c"), everywhere).alias("_suffix_prior"), F.col("_c").alias("_suffix_c"))
    hosts = counts_by("suffix", "host").join(suffixes.select("suffix", "_suffix_prior"), "suffix").select("suffix", "host", share(F.col("_c"), F.col("_suffix_prior")).alias("_host_prior"))
    # P(declared value | language): how the rows of a language of the text declare themselves
    says = counts_by("declared")
    likes = says.select("declared", F.array(*[(F.get("_c", F.lit(k)) + F.lit(ADD)) / F.lit(of_all[k] + ADD) for k in width]).alias("_declared_like"))

    out = keyed_join(rows, hosts, ["suffix", "host"], "left", "language-hosts")
    out = keyed_join(out, suffixes.select("suffix", "_suffix_prior"), ["suffix"], "left", "language-suffixes")
    out = keyed_join(out, likes, ["declared"], "left", "language-declared")
    even = F.array(*[F.lit(1.0) for _ in width])
    prior = F.when(F.col("host") != "", F.col("_host_prior")).otherwise(F.col("_suffix_prior"))
    prior = F.coalesce(prior, F.col("_suffix_prior"), everywhere)
    said = F.when(F.col("declared") != "", F.coalesce("_declared_like", even)).otherwise(even)
    joint = F.zip_with(F.zip_with("ll", prior, lambda a, p: a + F.log(p)), said, lambda a, p: a + F.log(p))
    out = out.withColumn("_joint", joint).withColumn("_top", F.array_max("_joint"))
    norm = F.aggregate("_joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    names = F.array(*[F.lit(x) for x in languages])
    posterior = F.lit(1.0) / norm
    rejected = ~F.col("filled") | ((F.col("n_grams") > 0) & (F.array_max("ll") <= F.col("noise_ll"))) | (posterior < least_posterior)
    return out.select(
        "doc_id",
        F.when(rejected, F.lit("und")).otherwise(F.get(names, F.array_position("_joint", F.col("_top")).cast("int") - 1)).alias("language"),
        posterior.alias("posterior"),
        F.when(F.col("n_grams") > 0, F.get(names, F.col("best"))).otherwise(F.lit("und")).alias("text_language"),
        "declared",
        "host",
        "n_grams",
        rejected.alias("rejected"),
    )


def page_declared(html: Column) -> Column:
    """The lang attribute of a page's html tag: its primary subtag in lower case, '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")


def address_suffix(host: Column) -> Column:
    """Last label of a host name, '' if there is none."""
    return F.coalesce(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))

"""Language identification: Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, by_bytes, keep, lean, lookup, small_batches, url_parts, utf8_buffer

#: Labelled rows per language that the text model is fitted on; beyond LANGUAGES they share the rows of so many, LEAST_ROWS each at least.
ROWS_PER_LANGUAGE = 400
LANGUAGES = 64
LEAST_ROWS = 25
BITS = 16
#: Trigrams that a text counts for at most: neighbours are not independent.
EVIDENCE = 50.0
#: Rows that a parent's prior weighs against a host's own.
STRENGTH = 20.0
UNKNOWN = "und"
SPACE = 32
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)], dtype=np.uint8)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams around every letter byte: (ids, valid, first position of each text)."""
    n = len(offsets) - 1
    text = np.full(len(raw) + n + 2, SPACE, np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(n) + 1, np.diff(offsets))] = LETTERS[raw]
    t = text.astype(np.uint32)
    h = (t[:-2] * np.uint32(0x9E3779B1)) ^ (t[1:-1] * np.uint32(0x85EBCA77)) ^ (t[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS), text[1:-1] != SPACE, offsets[:-1] + np.arange(n)


def text_counts(texts: list[bytes]) -> np.ndarray:
    """How often some texts have each trigram."""
    ids, valid, _ = trigrams(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64))
    return np.bincount(ids[valid], minlength=1 << BITS)


@dataclass
class TrigramModel:
    """Log probabilities of hashed trigrams for each language, and a flat one for unknown."""

    languages: list[str]
    log_probs: np.ndarray

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str]) -> TrigramModel:
        names = sorted(set(labels))
        return cls.of_counts({name: text_counts([x for x, y in zip(texts, labels, strict=True) if y == name]) for name in names})

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> TrigramModel:
        """From the trigram counts of each language."""
        names, size = sorted(counts), 1 << BITS
        table = np.full((len(names) + 1, size), -np.log(size), np.float32)
        for k, name in enumerate(names):
            count = counts[name] + 0.01
            table[k] = np.log(count / count.sum())
        return cls([*names, UNKNOWN], table)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts, languages), tempered to EVIDENCE trigrams, and how many trigrams a text has."""
        n = len(offsets) - 1
        ids, valid, first = trigrams(raw, offsets)
        if not n:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        count = np.add.reduceat(valid.astype(np.int64), first)
        total = np.stack([np.add.reduceat(np.where(valid, row[ids], np.float32(0)).astype(np.float64), first) for row in self.log_probs], axis=1)
        return total * np.minimum(1.0, EVIDENCE / np.maximum(count, 1))[:, None], count


def _sums(n: int, by: str) -> list[Column]:
    return [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(n)] + [F.count("*").alias("rows")]


def fuse(scored: DataFrame, languages: list[str], threshold: float) -> DataFrame:
    """Posterior of every row: text likelihood, markup and suffix likelihoods, and the host's prior.

    scored has id, host, domain, suffix, markup, loglik, share (the text-only posterior) and
    trigrams. Tables of summed shares per host, domain, suffix and markup language come from
    grouped aggregation over all rows. A host's prior is its own shares (without the row at
    hand) smoothed by its domain's, and those by the corpus'.
    """
    n = len(languages)
    corpus = scored.agg(*_sums(n, "all")).first()
    total = float(corpus["rows"] or 0)
    overall = [((corpus[f"s{i}"] or 0.0) + 1.0) / (total + n) for i in range(n)]
    rows = scored
    for level in ("domain", "host", "suffix", "markup"):
        table = scored.where(F.col(level).isNotNull()).groupBy(level).agg(*_sums(n, level))
        table = keep(table.select(level, F.array(*[f"s{i}" for i in range(n)]).alias(f"{level}_shares"), F.col("rows").cast("double").alias(f"{level}_rows")))
        rows = lookup(rows, table, level)
    prior = [F.lit(p) for p in overall]
    for level in ("domain", "host"):
        known = F.col(f"{level}_rows").isNotNull()
        own = [F.col(f"{level}_shares")[i] - F.col("share")[i] for i in range(n)]
        prior = [F.when(known, (F.greatest(own[i], F.lit(0.0)) + F.lit(STRENGTH) * prior[i]) / (F.col(f"{level}_rows") - 1 + F.lit(STRENGTH))).otherwise(prior[i]) for i in range(n)]
        rows = rows.withColumn(f"{level}_prior", F.array(*prior))
        prior = [F.col(f"{level}_prior")[i] for i in range(n)]
    logit = []
    for i in range(n):
        value = F.col("loglik")[i] + F.log(prior[i])
        for level in ("suffix", "markup"):
            seen = F.greatest(F.col(f"{level}_shares")[i] - F.col("share")[i], F.lit(0.0))
            value = value + F.when(F.col(f"{level}_rows").isNotNull(), F.log((seen + 0.5) / F.lit((corpus[f"s{i}"] or 0.0) + 1.0))).otherwise(0.0)
        logit.append(value)
    rows = rows.withColumn("logit", F.array(*logit)).withColumn("peak", F.array_max("logit"))
    rows = rows.withColumn("best", F.array_position("logit", F.col("peak")).cast("int") - 1)
    mass = F.aggregate("logit", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("peak")))
    names = F.array(*[F.lit(x) for x in languages])
    rows = rows.withColumn("confidence", F.lit(1.0) / mass).withColumn("language", F.when(F.col("trigrams") > 0, names[F.col("best")]).otherwise(UNKNOWN))
    accepted = (F.col("language") != UNKNOWN) & (F.col("confidence") >= threshold)
    return rows.select("id", "language", F.round("confidence", 6).alias("confidence"), "trigrams", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> TrigramModel:
    """Trigram tables of every label, from about ROWS_PER_LANGUAGE rows of each (fewer beyond LANGUAGES labels).

    A row is taken if a hash of its id and text falls below its language's share, so the
    sample is the same at every run. Executors count its trigrams: the driver gets sums, at
    most 65,536 a label, and no text.
    """
    label = F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), label.alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return TrigramModel.fit([], [])
    each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, ROWS_PER_LANGUAGE * LANGUAGES // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], each / r["count"])])[F.col("lang")]
    unit = F.shiftrightunsigned(F.xxhash64("_id", "text"), 11) / F.lit(float(1 << 53))

    def counted(batches):
        for batch in by_bytes(batches, "text", 2 << 20):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                n = text_counts([t.encode() for t, x in zip(texts, langs, strict=True) if x == lang])
                ids = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids.astype(np.int32)), pa.array(n[ids])], names=["lang", "trigram", "n"])

    seen = small_batches(rows.where(unit < share).select("lang", "text")).mapInArrow(lean(counted), "lang string, trigram int, n long")
    table = seen.groupBy("lang", "trigram").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("trigram", "n")).alias("counts")).toArrow()
    found = {r["lang"]: np.zeros(1 << BITS, np.int64) for r in counts}
    for lang, column in zip(table["lang"].to_pylist(), table["counts"].to_pylist() if table.num_rows else [], strict=True):
        found[lang][[c["trigram"] for c in column]] = [c["n"] for c in column]
    return TrigramModel.of_counts(found)


def identify(rows: DataFrame, model: TrigramModel, threshold: float = 0.5) -> DataFrame:
    """(id, language, confidence, trigrams, accepted) for rows of id, text, host, domain, suffix and markup."""

    def run(batches):
        for batch in by_bytes(batches, "text", 2 << 20):
            loglik, count = model.score(*utf8_buffer(batch.column(batch.schema.get_field_index("text"))))
            share = np.exp(loglik - loglik.max(1, keepdims=True)) if len(loglik) else loglik
            share /= share.sum(1, keepdims=True) if len(loglik) else 1
            n = loglik.shape[1]
            ends = pa.array(np.arange(0, n * (len(loglik) + 1), n), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (loglik, share)]
            others = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "host", "domain", "suffix", "markup")]
            yield pa.RecordBatch.from_arrays([*others, *lists, pa.array(count)], names=["id", "host", "domain", "suffix", "markup", "loglik", "share", "trigrams"])

    scored = small_batches(rows).select("id", "text", "host", "domain", "suffix", "markup").mapInArrow(lean(run), "id long, host string, domain string, suffix string, markup string, loglik array<double>, share array<double>, trigrams long")
    return fuse(keep(scored), model.languages, threshold)


def declared(text: Column) -> Column:
    """Primary subtag of the ``lang`` attribute of an html tag, in lower case; null if there is none."""
    tag = F.lower(F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(text.rlike(r"(?i)<html\b") & (tag != ""), tag)


def identify_documents(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Language of every document: (doc_id, language, confidence, trigrams, accepted).

    The text model learns from the ``lang`` column of a bounded sample; a row's own ``lang``
    is no evidence for it. The source is the host; markup counts where a text holds an html
    tag. Rejected are texts without letters, texts whose trigrams fit no language better
    than chance (``und``), and posteriors below the threshold. Answers carry ``row_col`` for
    an id if one is given.

    Defined cases: null and empty texts are rejected as ``und``; rows without source take the
    corpus' prior; with no labelled row every text is ``und``; repeated rows get one answer
    each; an empty table gives no rows.
    """
    model = fit_text_model(docs, text_col, lang_col, id_col)
    text = F.col(text_col).cast("string")
    null = F.lit(None).cast("string")
    rows = docs.select(F.col(row_col or id_col).cast("long").alias("id"), text.alias("text"), F.col(source_col).cast("string").alias("host"), null.alias("domain"), null.alias("suffix"), declared(text).alias("markup"))
    return identify(rows, model, threshold).withColumnRenamed("id", "doc_id")


def identify_pages(pages: DataFrame, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Language of web pages, with all four kinds of evidence; the text model comes from docs.

    Text is the page without scripts, styles and tags; host, registered domain (its last two
    labels) and suffix come from the url.
    """
    model = fit_text_model(docs)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host, _ = url_parts(F.col("url").cast("string"))
    host = F.when(host != "", host)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"), declared(html).alias("markup"))
    return identify(rows, model, threshold).withColumnRenamed("id", "page_id")


def accepted_documents(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents whose language is accepted, all columns kept.

    Each row is judged by itself, under a hash of its id, text and source: rows that share
    an id, or have none, do not go with one another.
    """
    parts = [F.col(c).cast("string") for c in (id_col, text_col, source_col)]
    rows = docs.withColumn("_judged", F.xxhash64(*parts, *[c.isNull() for c in parts]))
    found = identify_documents(rows, threshold, id_col, text_col, lang_col, source_col, "_judged")
    gone = keep(found.where(~F.col("accepted")).select(F.col("doc_id").alias("_gone")).distinct())
    right = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(right, rows["_judged"] == F.col("_gone"), "left_anti").drop("_judged")

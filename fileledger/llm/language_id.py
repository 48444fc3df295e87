"""Language ID by fusing evidence: text likelihoods, declared markup language, address suffix and host priors.

Text likelihoods come from byte trigrams counted over all labelled rows outside
the held-out fold, smoothed by add-one.  How far a declared language or a suffix
speaks for each language, and what languages a host writes, is learnt from the
corpus itself: the text-only posteriors of all rows are summed by declared value,
by suffix, by host, by domain and in all.  A host's prior is smoothed towards its
domain's and that towards the corpus's, each without the row's own share.

Rules.  Null or empty text says nothing: the other evidence decides, and without
any the corpus prior does.  A missing or malformed declaration, suffix or host is
its own value ''.  Ties go to the alphabetically first language.  Repeated rows
are judged alike.  Without labelled rows the language is 'und' at confidence 0.
An empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileledger.llm.kernel import slices, text_column
from fileledger.sources.scratch import written

BUCKETS = 1 << 14
#: More labelled languages than this are an error; none is ever left out.  A language takes 64 KB of the broadcast table.
LANGUAGES_MOST = 4096
SALTS = 16
#: A text speaks with at most this many independent trigrams.
TEXT_WEIGHT = 40.0
SMOOTHING = 20.0
#: No evidence makes a language less likely than this.
FLOOR = 1e-3

_DROP = re.compile(r"<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])"


def _trigrams(piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte and the document of each; none crosses documents, holds a digit or mark, or is all spaces."""
    d = piece.data.astype(np.uint32)
    d[(d >= 65) & (d <= 90)] += 32
    plain = (d >= 128) | ((d >= 97) & (d <= 122)) | (d == 32) | (d == 10)
    d[d == 10] = 32
    n = len(d)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(piece)), np.diff(piece.bounds))
    letter = d > 32
    ok = plain[:-2] & plain[1:-1] & plain[2:] & (doc[:-2] == doc[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h[ok] >> np.uint32(12)).astype(np.int64) % BUCKETS, doc[:-2][ok]


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def count_trigrams(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for piece in slices(b.column(0)):
                bucket, doc = _trigrams(piece)
                names = langs[piece.first : piece.first + len(piece)]
                for lang in set(names):
                    mine = np.array([x == lang for x in names])
                    seen[lang] = seen.get(lang, 0) + np.bincount(bucket[mine[doc]], minlength=BUCKETS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """All labelled languages that have a trigram, and log likelihoods, language by bucket; as large as there are languages, whatever the input."""
    counts = written(count_trigrams(labelled, text_col, lang_col), "language-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(LANGUAGES_MOST + 1).collect())
    if len(langs) > LANGUAGES_MOST:
        raise ValueError(f"more than {LANGUAGES_MOST} languages are labelled")
    table = np.ones((len(langs), BUCKETS))
    at = {x: i for i, x in enumerate(langs)}
    for lang, bucket, n in counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toLocalIterator():  # BUCKETS at most each
        table[at[lang], bucket] += n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def visible_text(html: str) -> str:
    return _DROP.sub(" ", html)


def text_posteriors(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """rows (.., text, is_markup) with p_text array<double> in place of both: flat where the text has no trigram."""
    shared = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32).T.copy())
    kept = [c for c in rows.columns if c not in ("text", "is_markup")]
    at, markup = rows.columns.index("text"), rows.columns.index("is_markup")
    where = [rows.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = shared.value
        n_langs = like.shape[1]
        for b in batches:
            text = text_column(b.column(at))
            if pc.any(b.column(markup)).as_py():
                text = pa.array([visible_text(t) if m else t for t, m in zip(text.to_pylist(), b.column(markup).to_pylist())], pa.large_string())
            parts = []
            for piece in slices(text):
                bucket, doc = _trigrams(piece)
                n = np.bincount(doc, minlength=len(piece))
                sums = np.stack([np.bincount(doc, weights=like[bucket, k], minlength=len(piece)) for k in range(n_langs)], axis=1)
                score = sums * (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
                p = np.exp(score - score.max(axis=1, keepdims=True))
                parts.append(p / p.sum(axis=1, keepdims=True))
            if parts:
                p = np.concatenate(parts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, n_langs), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in where), lists], names=[*kept, "p_text"])

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in rows.select(*kept).dtypes), "p_text array<double>"]))


def _sums(e: DataFrame, n: int, by: list[str]) -> DataFrame:
    """(by, _salt, sums): summed posteriors by the given columns, once for each salt of e that has rows.

    Partial sums go before the shuffle, and the parts of a group meet their sum by
    salt, so a hot host is no single task.
    """
    part = e.groupBy(*by, "_salt").agg(*(F.sum(F.col("p_text")[i]).alias(f"s{i}") for i in range(n)))
    whole = part.groupBy(*by).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n))).select(*by, F.array(*(f"s{i}" for i in range(n))).alias("sums"))
    return part.select(*by, "_salt").join(whole, by)


def fuse(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """rows (id columns, text, is_markup, declared, suffix, host, domain) -> (id columns, lang, confidence, text_lang)."""
    keys = [c for c in rows.columns if c not in ("text", "is_markup", "declared", "suffix", "host", "domain")]
    if not langs:
        return rows.select(*keys, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"))
    n = len(langs)
    e = written(text_posteriors(rows, langs, table).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS))), "language-evidence")
    total = e.agg(F.array(*(F.sum(F.col("p_text")[i]) for i in range(n))).alias("all_sums"))
    for name, by in (("declared", ["declared"]), ("suffix", ["suffix"]), ("host", ["host", "domain"]), ("domain", ["domain"])):
        e = e.join(_sums(e.select(*by, "_salt", "p_text"), n, by).withColumnRenamed("sums", f"{name}_sums"), [*by, "_salt"])
    e = e.crossJoin(F.broadcast(total))  # one row
    plus = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    # Sums and counts without the row's own share.
    less = lambda name: F.zip_with(f"{name}_sums", "p_text", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    count = lambda name: F.greatest(plus(f"{name}_sums") - 1, F.lit(0.0))
    smoothed = lambda name, towards: F.zip_with(less(name), towards, lambda s, t: (s + SMOOTHING * t) / (count(name) + SMOOTHING))
    e = e.withColumn("prior", F.transform("all_sums", lambda s: (s + 1) / (plus("all_sums") + n)))
    e = e.withColumn("by_domain", smoothed("domain", "prior"))
    e = e.withColumn("by_host", smoothed("host", "by_domain"))

    def speaks(name: str) -> Column:
        """log of P(value | language) against P(value): how far the value speaks for each language."""
        ratio = F.zip_with(smoothed(name, "prior"), "prior", lambda share, p: F.log(F.greatest(share / p, F.lit(FLOOR))))
        return F.when(F.col(name) == "", F.transform("prior", lambda _: F.lit(0.0))).otherwise(ratio)

    score = F.zip_with("p_text", "by_host", lambda p, h: F.log(F.greatest(p, F.lit(1e-12))) + F.log(F.greatest(h, F.lit(FLOOR))))
    for name in ("declared", "suffix"):
        score = F.zip_with(score, speaks(name), lambda a, b: a + b)
    e = e.withColumn("score", score)
    best = F.array_max("score")
    norm = plus(F.transform("score", lambda s: F.exp(s - best)))
    names = F.array(*map(F.lit, langs))
    first = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return e.select(*keys, first(F.col("score")).alias("lang"), F.round(1 / norm, 6).alias("confidence"), first(F.col("p_text")).alias("text_lang"))


def page_rows(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Evidence columns of raw pages; suffix: the host's last label, or the first path step where that is a two-letter one."""
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    step = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([A-Za-z]{2})(?:/|$)", 1))
    suffix = F.when(step != "", F.concat(F.lit("/"), step)).otherwise(F.regexp_extract(host, r"\.([a-z]{2,24})$", 1))
    return pages.withColumns({"text": html, "is_markup": F.lit(True), "declared": F.lower(F.regexp_extract(html, _DECLARED, 1)), "suffix": suffix, "host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)})


def document_rows(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Evidence columns of plain documents, whose source stands for the host."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "is_markup": F.lit(False), "declared": F.lower(F.regexp_extract(text, _DECLARED, 1)), "suffix": F.lit(""), "host": F.coalesce(F.col(host_col).cast("string"), F.lit("")), "domain": F.lit("")})

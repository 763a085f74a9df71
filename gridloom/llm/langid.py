"""Language identification by Bayesian fusion of several kinds of evidence.

The log posterior of a language adds the likelihood of the text's byte
trigrams (tempered, as neighbouring trigrams aren't independent), the
likelihood of the declared markup language, and a prior of the address: host
counts smoothed by those of its domain (the last two names), these by those
of the suffix (the last name), these by all rows'. Counts are grouped
aggregates of the languages that the text alone suggests, over all rows; a
row's own count is left out of its priors.

Texts are read once, where they lie; what moves is a few numbers a row.
Totals are one row for each host, domain and suffix; Spark broadcasts them
where they are small and splits a host with a third of all rows where not
(skew join). The languages are those of all labelled documents; their
trigrams come from about ``sample`` documents of each (a parameter).

Defined results: null and empty texts say nothing, nor does an undeclared
language or a missing address, so other evidence or the prior of all rows
decides; equal beliefs go to the first language in alphabetical order;
repeated rows keep a result each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches, staged

BUCKETS = 1 << 13
SAMPLE = 4000
TEMPER = 60.0
#: From the widest to the narrowest, with how many rows the next wider one counts for.
LEVELS = (("suffix", 32.0), ("domain", 16.0), ("host", 8.0))

_HIDDEN = re.compile(r"<(?:!--|(script|style|nav|head)\b)", re.I)
_CLOSE = {"": re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "nav", "head")}
_TAG = re.compile(r"<[^>]*>")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def visible_text(html: str) -> str:
    """Markup's text without scripts, styles, navigation, comments and tags, in time linear in it."""
    shown, at, open_ended = [], 0, set()
    for m in _HIDDEN.finditer(html):
        kind = (m.group(1) or "").lower()
        if m.start() < at or kind in open_ended:
            continue
        close = _CLOSE[kind].search(html, m.end())
        if close:
            shown.append(html[at : m.start()])
            at = close.end()
        else:
            open_ended.add(kind)
    text = " ".join([*shown, html[at:]])
    tags = text.rfind(">") + 1
    return _TAG.sub(" ", text[:tags]) + text[tags:]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams of lower-cased letters (anything else counts as one blank), and bounds between texts."""
    data, offs = tv.buffers(column)
    b = _LOWER[data]
    b = np.where(_LETTER[b], b, 32).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    key = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    ok = ~((b[:-2] == 32) & (b[1:-1] == 32) | (b[1:-1] == 32) & (b[2:] == 32))
    cut = offs[1:-1]
    for back in (1, 2):
        at = cut - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return (key[at] >> np.uint32(19)).astype(np.int64), np.searchsorted(at, offs)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities languages x BUCKETS): every language that a labelled row has, trigrams from about ``sample`` rows of each.

    A language's rows are taken by a bound on the hash of the id (of the text
    where there is no id), all of them up to ``sample``; the row with the
    smallest hash is always among them.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.withColumn("hash", F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text")), F.lit(3)))
    held = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low")).collect()  # a row per language
    languages = sorted(r.lang for r in held) or ["und"]
    bounds = [(r.lang, max(r.low, (1 << 63) - 1 if r.n <= sample else int(-(1 << 63) + (1 << 64) * (sample / r.n)))) for r in held]
    few = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            column, lang = tv.texts(batch.column(0)), batch.column(1).to_pylist()
            for a, z in tv.slices(column):
                key, bound = trigrams(column.slice(a, z - a))
                row = np.repeat(np.array([languages.index(x) if x in languages else -1 for x in lang[a:z]]), np.diff(bound))
                total += np.bincount((row * BUCKETS + key)[row >= 0], minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    out = np.zeros((len(languages), BUCKETS))
    read = labelled.join(few, "lang").where("hash <= bound").select("text", "lang")
    for r in read.mapInArrow(tv.freeing(count), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    out += 0.5
    return languages, np.log(out / out.sum(1, keepdims=True))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, keys: list[str], text_col: str = "text", markup: str | None = None, declared_col: str | None = None, address_col: str | None = None) -> DataFrame:
    """(keys..., lang, confidence, text_lang, declared, host, suffix) of every row.

    ``markup`` names a column that is true where the text is HTML, whose
    ``lang`` attribute then counts as declared. ``address_col`` is a URL or a
    bare host name.
    """
    small_batches(rows.sparkSession)
    n = len(languages)
    blank = F.lit(None).cast("string")
    address = F.col(address_col).cast("string") if address_col else blank
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    said = F.lower(F.regexp_extract(F.col(text_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)) if markup else blank
    said = F.when(F.col(markup), said).otherwise(F.lower(F.col(declared_col).cast("string")) if declared_col else blank) if markup else F.lower(F.col(declared_col).cast("string")) if declared_col else blank
    base = rows.select(*keys, F.col(text_col).alias("_text"), (F.col(markup) if markup else F.lit(False)).alias("_markup"), said.alias("declared"), F.when(host != "", host).alias("host"))
    base = base.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared"))).withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))
    base = base.withColumn("domain", F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)))
    carried = [*keys, "declared", "host", "domain", "suffix"]
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    table = [np.ascontiguousarray(m) for m in model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            column = tv.texts(at["_text"])
            for a, z in tv.slices(column):
                part = column.slice(a, z - a)
                markup = at["_markup"].slice(a, z - a).to_pylist()
                if any(markup):
                    part = pa.array([visible_text(t) if m else t for t, m in zip(part.to_pylist(), markup, strict=True)], pa.string())
                key, bound = trigrams(part)
                size = np.diff(bound)
                like = np.stack([tv.fold(rows_of[key], bound) for rows_of in table], 1) / np.maximum(size, 1)[:, None]
                like = np.round(like * np.minimum(size, TEMPER)[:, None], 6)
                yield pa.record_batch([*(at[c].slice(a, z - a) for c in carried), pa.ListArray.from_arrays(pa.array(np.arange(0, like.size + 1, n), pa.int32()), pa.array(like.ravel()))], [*carried, "like"])

    read = staged(base.mapInArrow(tv.freeing(run), ", ".join(f"`{c}` {types[c]}" for c in carried) + ", like array<double>"), "likelihoods")
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int") - 1
    known = F.array_max("like") != F.array_min("like")
    read = read.withColumn("guess", F.when(known, best(F.col("like"))))

    counts = [F.sum(F.when(F.col("guess") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(n)]
    as_array = F.array(*[F.col(f"n{i}") for i in range(n)])
    stirred = read.groupBy("declared").agg(*counts).collect()  # at most languages + 1 rows
    total = np.array([[r[f"n{i}"] for i in range(n)] for r in stirred], float).reshape(len(stirred), n).sum(0) + 1.0
    everyone = total / total.sum()
    said_given = {r.declared: np.log([(r[f"n{i}"] + 0.5) / (total[i] + 0.5 * (n + 1)) for i in range(n)]) for r in stirred if r.declared}
    logs = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    markup_log = logs([0.0] * n)
    for name, values in said_given.items():
        markup_log = F.when(F.col("declared") == name, logs(values)).otherwise(markup_log)

    out = read
    for name, _ in LEVELS:
        by = read.where(F.col(name).isNotNull() & F.col("guess").isNotNull()).groupBy(F.col(name).alias(f"_{name}")).agg(*counts)
        out = out.join(by.select(f"_{name}", as_array.alias(f"{name}_n")), F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    own = lambda i: F.when(F.col("guess") == i, 1.0).otherwise(0.0)
    one = F.when(F.col("guess").isNotNull(), 1.0).otherwise(0.0)
    prior = [F.lit(float(x)) for x in everyone]
    for name, weight in LEVELS:
        all_n = F.aggregate(f"{name}_n", F.lit(0.0), lambda a, x: a + x)
        prior = [F.when(F.col(f"{name}_n").isNull(), p).otherwise((F.col(f"{name}_n")[i] - own(i) + F.lit(weight) * p) / (all_n - one + F.lit(weight))) for i, p in enumerate(prior)]
    out = out.withColumn("prior", F.array(*prior)).withColumn("markup", markup_log)
    belief = F.transform(F.arrays_zip("like", "prior", "markup"), lambda x: x["like"] + F.log(x["prior"]) + x["markup"])
    out = out.withColumn("belief", belief).withColumn("at", best(F.col("belief")))
    top = F.array_max("belief")
    confidence = F.round(1 / F.aggregate("belief", F.lit(0.0), lambda a, x: a + F.exp(x - top)), 6)
    names = F.array(*map(F.lit, languages))
    return out.select(*keys, names[F.col("at")].alias("lang"), confidence.alias("confidence"), F.when(F.col("guess").isNotNull(), names[F.col("guess")]).alias("text_lang"), "declared", "host", "suffix")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Every page and every document; a document's source stands for its host."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    languages, model = fit(docs)
    none = F.lit(None).cast("long")
    rows = pages.select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("text"), F.lit(True).alias("markup"), F.col("url").alias("address"))
    rows = rows.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), "text", F.lit(False).alias("markup"), F.col("source").alias("address")))
    return identify(rows, languages, model, ["doc_id", "page_id"], markup="markup", address_col="address")

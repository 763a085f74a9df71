"""Secret scans with an incremental blob ledger.

Every text is addressed by its SHA-256. A ledger is a folder of two Parquet
tables: ``scans`` says which rule versions have read which blob and what each
found, ``versions`` which id has held which blob. A call reads only blob and
rule-version pairs that the ledger lacks and appends them, notes the versions
that are new, and joins the findings back to every row that holds the blob.
``history`` joins them back to every version of every id that any call saw.

A finding bears the version of its rule, so findings of a version that is no
longer asked for count for nothing. Copies meet in a ``groupBy`` on the
address that is combined before its shuffle; texts move once, keyed by (id,
address) of one representative. The join back moves ids and addresses; blobs
without findings are no rows of its other side, and a blob held by a third of
all rows is split by Spark's skew join or broadcast.

Defined results: null texts count as empty and have no findings; repeated
rows keep a result each; an empty table gives an empty result and no ledger
rows; other columns are ignored, and kept by ``redact`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import new_path, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Raising ``version`` makes every blob unseen for it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    any_case: bool = False
    span: int = 0  # group whose place is reported
    hint: str = ""  # RE2 pattern that any text with a finding holds

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: A key from BEGIN through the END line of its name; without one, its header fields and the run of base64 lines (a last line may be short).
_SEP = r"""(?:\\[nrt]|[\s"'>#,])"""
PEM = (
    r"-----BEGIN ((?:[A-Z]+ )?)PRIVATE KEY-----"
    r"(?:(?>[^-]*+(?:-(?!----)[^-]*+)*+)-----END \1PRIVATE KEY-----"
    rf"|(?:{_SEP}*+[A-Za-z]++-[A-Za-z]++: [^\n\\]*+)*+(?:{_SEP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_SEP}++(?:[A-Za-z0-9+/]{{4}}){{0,3}}(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=|(?<=[A-Za-z0-9+/]{{4}})(?=\s*(?:\n|\Z))))?)"
)

#: The kinds in the order that breaks ties of spans with one start. Each pattern takes time linear in the text.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, any_case=True, hint=r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, hint=r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, hint=r"[0-9a-f]{32}"),
    Rule("pem", PEM, version=2, hint=r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 1, 8, version=3, span=1, hint=r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8}"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}", hint=r"[Bb]earer [A-Za-z0-9._~+/-]{20}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,31}://[^\s/:@]+:[^\s/:@]{4,}@", version=2, hint=r"://[^\s/:@]+:[^\s/:@]{4,}@"),
)
BASE = ("assign", "access", "hex")
FINDING = "struct<kind:string,start:int,end:int>"


def _scan(rule: Rule, text: str, regex: re.Pattern) -> Iterator[tuple[int, int]]:
    for m in regex.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span(rule.span)


def _scanner(rules: tuple[Rule, ...]):
    compiled = {r.key: (r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            blobs = batch.column("blob").to_pylist()
            batch = batch.filter(pa.array([b != a for a, b in zip([last, *blobs], blobs, strict=False)], pa.bool_()))  # rows repeated whole lie together
            last = blobs[-1] if blobs else last
            column = tv.texts(batch.column("text"))
            wanted = batch.column("rules").to_pylist()
            found: list[list[dict]] = [[] for _ in wanted]
            for key, (rule, regex) in compiled.items():
                held = pc.match_substring_regex(column, rule.hint) if rule.hint else pa.array([True] * len(column))
                for i in pc.indices_nonzero(held).to_pylist():
                    if key in wanted[i]:
                        found[i] += [{"rule": key, "start": a, "end": z} for a, z in _scan(rule, column[i].as_py(), regex)]
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column("blob"), batch.column("rules"), pa.array(found, kind)], ["blob", "rules", "findings"])

    return run


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


SCANS = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def record(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scans the blob and rule-version pairs of ``docs`` that the ledger lacks, and notes its new versions."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _addressed(docs, id_col, text_col)
    wanted = [r.key for r in rules]
    unseen = rows.groupBy("blob").agg(F.min(F.struct("id")).alias("first")).select("blob", F.col("first.id").alias("id"))
    scans, versions = f"{ledger}/scans", f"{ledger}/versions"
    if _exists(spark, scans):
        seen = spark.read.schema(SCANS).parquet(scans).select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        unseen = unseen.join(seen, "blob", "left").withColumn("rules", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.expr("cast(array() as array<string>)")))).where(F.size("rules") > 0).drop("seen")
    else:
        unseen = unseen.withColumn("rules", F.array(*map(F.lit, wanted)))
    same = rows.alias("r").join(unseen.alias("u"), F.col("r.id").eqNullSafe(F.col("u.id")) & (F.col("r.blob") == F.col("u.blob")))
    same.select("r.blob", "u.rules", "r.text").mapInArrow(tv.freeing(_scanner(rules)), SCANS).write.mode("append").parquet(scans)
    held = rows.select("id", "blob")
    if _exists(spark, versions):
        noted = spark.read.parquet(versions).distinct().alias("n")
        held = held.alias("h").join(noted, F.col("h.id").eqNullSafe(F.col("n.id")) & (F.col("h.blob") == F.col("n.blob")), "left_anti")
    held.write.mode("append").parquet(versions)


def _joined_back(held: DataFrame, ledger: str, rules: tuple[Rule, ...], id_col: str) -> DataFrame:
    """(id, blob, findings) of every row of ``held`` (id, blob): what these versions of the rules found in the blob."""
    keys = [r.key for r in rules]
    place = lambda values: F.element_at(F.create_map(*[x for k, v in zip(keys, values, strict=True) for x in (F.lit(k), F.lit(v))]), F.col("f.rule"))
    found = held.sparkSession.read.schema(SCANS).parquet(f"{ledger}/scans").where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(keys))
    found = found.select("blob", F.struct(F.col("f.start").alias("start"), place(range(len(keys))).alias("rank"), F.col("f.end").alias("end"), place([r.kind for r in rules]).alias("kind")).alias("f"))
    found = found.groupBy(F.col("blob").alias("of")).agg(F.array_sort(F.collect_set("f")).alias("found"))
    listed = F.coalesce(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.expr(f"cast(array() as array<{FINDING}>)"))
    return held.join(found, F.col("blob") == F.col("of"), "left").select(F.col("id").alias(id_col), F.lower(F.hex("blob")).alias("blob"), listed.alias("findings"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, findings array<struct<kind, start, end>>) of every row; positions are code points, end exclusive.

    ``ledger`` is the folder's path: blobs that it has seen with every one of
    ``rules`` aren't read again. Without one, a new ledger is made in the
    shared folder. Findings are sorted by start, then by the order of rules.
    """
    path = ledger or new_path(docs.sparkSession, "ledger")
    record(docs, path, rules, id_col, text_col)
    return _joined_back(_addressed(docs, id_col, text_col).select("id", "blob"), path, rules, id_col)


def history(spark, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """(id, blob, findings) of every version that the ledger has noted, by the given versions of the rules; no text is read."""
    return _joined_back(spark.read.parquet(f"{ledger}/versions"), ledger, rules, id_col)


def joined(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each finding's code points replaced by ``mark``; overlapping findings become one. Other columns stay."""
    hits = scanned.where(F.size("findings") > 0).groupBy(F.col(id_col).alias("id"), F.col("blob").alias("of")).agg(F.first("findings").alias("findings")).hint("shuffle_hash")
    merged = F.aggregate("findings", F.expr("cast(array() as array<struct<a:int,z:int>>)"), lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= F.element_at(out, -1)["z"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["z"], x["end"]).alias("z"))))).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("a"), x["end"].alias("z"))))))
    first = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    whole = F.coalesce(F.col("row")[text_col], F.lit(""))
    text = F.aggregate(merged, first, lambda acc, x: F.struct(F.concat(acc["text"], whole.substr(acc["at"] + 1, x["a"] - acc["at"]), F.lit(mark)).alias("text"), x["z"].alias("at")), lambda acc: F.concat(acc["text"], whole.substr(acc["at"] + 1, F.length(whole))))
    # the row travels as one column, so that no name of its own can clash with ours
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("blob", F.sha2(whole, 256))
    out = keyed.join(hits, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.col("blob") == F.col("of")), "left")
    clean = F.when(F.col("findings").isNotNull(), text).otherwise(F.col("row")[text_col])
    return out.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def _count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda x: x["kind"] == kind))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Two increments into one ledger, each scanned when it comes; the ledger gives the result for all rows."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "ledger")
    later = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0))
    for turn in (0, 1):
        record(docs.where(later == turn), path)
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return history(spark, path).select("doc_id", *(_count(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))

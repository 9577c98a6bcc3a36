"""Secrets: multipart credential linking.

Native DataFrame functions only.  Base patterns stand alone.  Weak candidates
(access identifiers of other prefixes, unlabelled high-variety strings) are
reported only where their complement lies within `SCOPE` characters, measured
between the nearest ends: an interval join of the parts of one document, by the
first start after and the last end before.
Where both parts of a pair are weak, an endpoint in the scope is needed too.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.llm._spark import table, texts
from inkstrata.llm.spans import candidates, clear_of, joined

SCOPE = 200
KINDS = ["assign", "access", "hex"]

# The base patterns, then the weak parts and endpoints.
PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
    "weak_access": r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA|AKIA)[A-Z0-9]{12,}(?![A-Za-z0-9])",
    "weak_secret": r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/=_-]{24,}(?![A-Za-z0-9+/=_-]|\.[A-Za-z0-9+/=_-])",
    "endpoint": r"(?i)(?:https?|ftps?|jdbc:[a-z0-9]{1,20}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]{3,}|(?<![a-z0-9.-])[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}\.(?:com|net|org|io|internal|local)(?![a-z0-9-])",
}
#: What a weak secret is made of, and how many different ones it holds at least.
LETTERS = string.ascii_letters + string.digits + "+/=_-"
VARIETY = 12
KIND = {"assign": "assign", "access": "access", "hex": "hex", "weak_access": "access", "weak_secret": "assign"}


def gates() -> dict[str, tuple[str, Column]]:
    t = F.col("text")
    access = (t.contains("ASIA") | t.contains("AIDA") | t.contains("AROA") | t.contains("AGPA") | t.contains("AKIA")) & t.rlike(r"A(?:SIA|IDA|ROA|GPA|KIA)[A-Z0-9]{12}")
    mixed = t.rlike(r"[A-Za-z0-9+/=_-]{24}")
    cond = {
        "assign": t.rlike(r"(?i)(?:passw|secret|token|api_?key)"),
        "access": access,
        "hex": t.rlike(r"[0-9a-f]{16}"),
        "weak_access": access,
        "weak_secret": mixed,
        "endpoint": (access | mixed) & (t.contains("://") | t.rlike(r"\.(?i:com|net|org|io|internal|local)")),
    }
    return {g: (p, cond[g]) for g, p in PATTERNS.items()}


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Keep base matches and the weak candidates whose complement is within the scope."""
    m, gen = F.col("m"), F.col("gen")
    value = F.regexp_extract(m, r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$""", 1)
    # over the whole key, however long, without an array of its characters
    kinds = sum((m.contains(c).cast("int") for c in LETTERS), F.lit(0))
    varied = m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & (kinds >= VARIETY)
    base = F.when(gen == "assign", F.length(value) >= 12).otherwise(gen.isin("access", "hex"))
    weak = F.when(gen == "weak_access", F.lit(True)).when(gen == "weak_secret", varied)
    rows = found.withColumn("base", F.coalesce(base, F.lit(False))).withColumn("weak", F.coalesce(weak, F.lit(False)))
    part = F.col("base") | F.col("weak") | (gen == "endpoint")
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def there(*gens: str) -> Column:
        one = gen.isin(*gens) & part
        before, after = F.max(F.when(one, F.col("end"))).over(upto), F.min(F.when(one, F.col("start"))).over(onward)
        return F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("end") <= scope, F.lit(False))

    point = there("endpoint")
    rows = rows.withColumn("pair", F.when(gen == "weak_access", there("assign", "hex") | (there("weak_secret") & point)).when(gen == "weak_secret", there("access") | (there("weak_access") & point)))
    rows = rows.withColumn("kind", F.coalesce(*[F.when(gen == g, F.lit(KINDS.index(k))) for g, k in KIND.items()]))
    return rows.withColumn("extra", F.col("weak") & F.coalesce(F.col("pair"), F.lit(False)))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, doc_id, base and spans: arrays of (kind, start, end) in order of start and kind.

    A weak span that overlaps a base span, or an earlier weak one, is not
    added.  Null texts are empty; one row per input row; other columns are
    ignored.
    """
    rows = link(candidates(texts(docs), gates()), scope)
    by = Window.partitionBy("row").orderBy("start", "end", "gen")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    base_end, base_start = clear_of("base", "row")
    clear = F.coalesce(base_end <= F.col("start"), F.lit(True)) & F.coalesce(base_start >= F.col("end"), F.lit(True))
    rows = rows.withColumn("extra", F.col("extra") & clear)
    rows = rows.withColumn("extra", F.col("extra") & F.coalesce(F.max(F.when(F.col("extra"), F.col("end"))).over(past) <= F.col("start"), F.lit(True)))
    one = F.struct("start", "kind", "end")
    per_doc = rows.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("base") | F.col("extra"), one))).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(c: str) -> Column:
        return F.transform(c, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return per_doc.select("row", "doc_id", named("base").alias("base"), named("spans").alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

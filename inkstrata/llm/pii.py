"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Native DataFrame functions only.  Seven generators propose overlapping spans;
four of them are the base patterns, whose valid matches always stand.  Every
candidate is described by format and context features; no check is among them.
The trees learn from the base candidates of the whole corpus, labelled by
their own checks (Luhn, octets, number of digits), and from written examples
of the formats no check covers: contexts times values.  A third of both, by
hash, is kept from the trees; on that third one threshold per generator is
calibrated to a precision.  Accepted spans join the base ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.llm import boosting
from inkstrata.llm._spark import staged, table, texts
from inkstrata.llm.spans import candidates, clear_of, digits, joined, luhn

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.97

# The base patterns, written without backtracking, then the wider generators.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z0-9-]++)++",
    "phone_local": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "card_dotted": r"(?<![0-9._/-])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
}
KIND = {g: g.split("_")[0] for g in PATTERNS}
WIDE = [g for g in PATTERNS if g not in KINDS]

# Words before a candidate that speak for its kind, and for something else.
GOOD = {
    "email": "e-?mail|mailto|mail|contact|write|reach|address|from|by|ask|send",
    "phone": "tel|telephone|phone|call|fax|mobile|cell|ring|dial|text|sms|reach|contact|hotline|whatsapp",
    "card": "card|visa|credit|debit|amex|mastercard|pay|paid|payment|charge|charged|billing",
    "ip": "ip|host|address|addr|server|gateway|client|from|ping|route",
}
BAD = "order|invoice|isbn|issn|version|ver|release|part|serial|ref|reference|page|sku|model|no|nos|number|id|rfc|section|dates?|values?|says|figures?|totals?|build|case|ticket|lot|batch|rows?"
TLD = "com|org|net|edu|gov|info|biz|io|dev|app|co|eu|de|at|ch|fr|es|it|nl|be|pl|se|no|dk|fi|uk|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|za"

#: Written examples, as contexts ({} is the value) times values: generator -> contexts for, against; values for, against.
#: An example counts as personal only where neither its context nor its value speaks against it.
EXAMPLES = {
    "email_spelled": (
        ["contact {} today", "mail: {}.", "write to {}", "e-mail {} now", "{} wrote this", "reach me by mail, {}", "posted by {}", "from {}", "questions? {}", "the author ({})", "ask {} about it", "send it to {}", "room 12, {}, floor 3", "ring 30 22 11 7 or {}", "5 June; {}; 12 copies", "the office 14 b, {} 9 to 5"],
        [],
        ["jane.roe (at) example (dot) org", "bob at example dot com", "sales[at]shop[dot]example[dot]net", "ann at mail dot example dot com", "sam (at) example (dot) com", "k_lee [at] uni [dot] edu", "info (at) firm (dot) de", "j.doe at corp dot io", "support(at)help(dot)info", "max [at] post [dot] at"],
        ["met at noon dot then", "looked at the dot on", "aim at red dot sights", "stop at each dot or", "arrive at ten dot sharp", "stared at one dot until", "point at every dot between", "meet at station dot please"],
    ),
    "phone_local": (
        ["call {} now", "phone: {}", "tel {}", "fax {}", "mobile {} any time", "ring {} after six", "dial {}", "text me at {}", "contact {}", "{} is my cell", "our new number: {}", "office {}", "she left {} on the desk", "call {} or 7 12 after 5", "tel {} ext 12, room 4"],
        ["order {} shipped", "part {}", "isbn {}", "serial {}", "the table says {} and", "values {} were", "invoice {} is due", "ref {}", "sku {}", "case {} closed", "rows 12 40 {} 77 81", "3 9 {} 5 8", "version {}", "ticket {}"],
        ["555-123-4567", "(212) 555-0199", "212.555.0134", "415 555 0101", "646-329-8810", "(305) 867 5309", "702.431.9926", "917 284 6630", "(408)555-0177", "503-226-7719"],
        ["100 200 3000", "120 340 5600", "111.222.3333", "000-000-0000", "123 123 1234", "101.102.1030", "150-160-1700"],
    ),
    "card_dotted": (
        ["card {} exp", "visa {}", "pay with {}", "credit card {}", "charged to {}", "debit {}", "amex: {}", "paid by {} today", "{} was charged", "billing {}", "my {} is lost", "visa {} 12/27 301", "pay 40 by card {} today", "credit {} valid 09 28"],
        ["serial {}", "model {}", "dates {}", "part {}", "build {}", "lot {}", "ref {}", "sku {}", "rows 1200 1300 {} 1500", "version {}", "batch {} passed"],
        ["4111.1111.1111.1111", "4012/8888/8888/1881", "5555.5555.5555.4444", "4111_1111_1111_1111", "6011.0009.9013.9424", "5105/1051/0510/5100", "3530.1113.3330.0000", "4222_2222_2222_2220", "5425.2334.3010.9903"],
        ["4111.1111.1111.1112", "1234_5678_9012_3456", "2001/2002/2003/2004", "0000.0000.0000.0000", "1990/1995/2000/2005", "9999_0001_9999_0002", "1000.2000.3000.4000"],
    ),
}

#: Feature sizes; their product bounds the number of distinct vectors whatever the corpus.
FEATURES = {"f_gen": 8, "f_mark": 5, "f_word": 4, "f_left": 2, "f_right": 2, "f_near": 3, "f_lead": 4, "f_next": 3, "f_same": 3, "f_tail": 3}
FOLDS = 3


def gates() -> dict[str, tuple[str, Column]]:
    """Each pattern with a cheap condition that every match of it needs."""
    t = F.col("text")
    dot_quad = t.rlike(r"[0-9]\.[0-9]")
    cond = {
        "email": F.instr("text", "@") > 0,
        "ip": dot_quad,
        "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.instr("text", "+") > 0,
        "email_spelled": t.rlike(r"(?i)(?:\(dot\)|\[dot\]|\x20dot\x20)"),
        "phone_local": t.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"),
        "card_dotted": t.rlike(r"[0-9]{4}[._/][0-9]{4}"),
    }
    return {g: (p, cond[g]) for g, p in PATTERNS.items()}


def valid(gen: Column, m: Column) -> Column:
    """The checks of the base patterns, and the like ones of the wider generators."""
    number = digits(m)
    n = F.length(number)
    octet = F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    return (
        F.when(gen.isin("email", "email_spelled"), F.lit(True))
        .when(gen == "ip", octet)
        .when(gen.isin("card", "card_dotted"), n.between(13, 19) & luhn(F.when(n.between(13, 19), number).otherwise("")))
        .when(gen == "phone", n.between(9, 15))
        .otherwise(n == 10)
    )


def described(found: DataFrame) -> DataFrame:
    """Format and context features of each candidate, small integers from zero; the checks stay apart in `ok`."""
    m, pre, post, gen = F.col("m"), F.col("pre"), F.col("post"), F.col("gen")
    number = digits(m)
    ahead = r"\W{0,3}(?:\w{1,4}\W{1,3})?$"
    kind = F.coalesce(*[F.when(gen == g, F.lit(k)) for g, k in KIND.items()])
    own = F.coalesce(*[F.when((kind == k) & pre.rlike(rf"(?i)\b(?:{words}){ahead}"), F.lit(1)) for k, words in GOOD.items()])
    groups = F.size(F.regexp_extract_all(F.concat(pre, F.lit(" "), post), F.lit(r"(?<![0-9])[0-9]++"), F.lit(0)))
    lead = F.left(number, F.lit(1))
    second = F.left(F.regexp_extract(m, r"^[^0-9]*[0-9]+[^0-9]+([0-9])", 1), F.lit(1))
    kinds = F.size(F.array_distinct(F.split(number, "")))
    tail = F.regexp_extract(m, r"([A-Za-z]+)$", 1)
    return (
        found.withColumn("ok", valid(gen, m))
        .withColumn("f_gen", F.array_position(F.array(*[F.lit(g) for g in PATTERNS]), gen).cast("int"))
        .withColumn("f_mark", F.when(m.rlike(r"[(\[]"), 3).when(m.rlike("[/_]"), 4).when(m.contains("."), 2).when(m.rlike(r"[\x20-]"), 1).otherwise(0))
        .withColumn("f_word", F.when(pre.rlike(rf"(?i)\b(?:{BAD})\W{{0,3}}$"), 2).otherwise(F.coalesce(own, F.when(pre.rlike(r"[A-Za-z]\W{0,3}$"), 3), F.lit(0))))
        .withColumn("f_left", pre.rlike(r"[A-Za-z0-9_]$").cast("int"))
        .withColumn("f_right", post.rlike(r"^[A-Za-z0-9_]").cast("int"))
        .withColumn("f_near", F.least(groups, F.lit(2)))
        .withColumn("f_lead", F.when(lead == "", 0).when(lead.isin("0", "1"), 1).when(lead.isin("3", "4", "5", "6"), 2).otherwise(3))
        .withColumn("f_next", F.when(second == "", 0).when(second.isin("0", "1"), 1).otherwise(2))
        .withColumn("f_same", F.when(kinds <= 3, 0).when(kinds <= 5, 1).otherwise(2))
        .withColumn("f_tail", F.when(tail == "", 0).when(tail.rlike(rf"^(?i:{TLD})$"), 2).otherwise(1))
        .drop("m", "pre", "post")
    )


def kept_out(key: Column) -> Column:
    """The third that the trees do not see."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def written() -> list[tuple[str, str, int]]:
    """(text, generator, label) of every written example."""
    return [(c.format(v), g, int(c in good and v in yes)) for g, (good, bad, yes, no) in EXAMPLES.items() for c in good + bad for v in yes + no]


def seed_rows(spark: SparkSession) -> DataFrame:
    """The written examples that pass their check, as described candidates with label and fold."""
    rows = json.dumps([{"doc_id": k, "text": t, "want": g, "label": y} for k, (t, g, y) in enumerate(written())])
    seeds = staged(spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<doc_id:long,text:string,want:string,label:int>>"))), "pii-seeds")
    found = described(candidates(seeds.select("doc_id", "text"), gates()))
    return found.join(F.broadcast(seeds.select("doc_id", "text", "want", "label")), "doc_id").where("gen = want and ok").withColumn("out", kept_out(F.col("text")))


def summary(found: DataFrame) -> DataFrame:
    """How many candidates have each vector, label (null: no check decides) and fold; bounded by the product of FEATURES."""
    label = F.when(F.col("gen").isin(*KINDS), F.col("ok").cast("int"))
    return found.where("gen is not null").groupBy(*FEATURES, label.alias("label"), kept_out(F.col("doc_id")).alias("out")).agg(F.count(F.lit(1)).alias("n"))


def learn(counted: DataFrame) -> tuple[tuple[float, list], dict[str, float]]:
    """(trees, threshold per generator) from the summary of a corpus and the written examples."""
    vector = [*FEATURES, "label", "out"]
    corpus = counted.where("label is not null").select(*vector, F.log1p("n").alias("w"))
    seeds = seed_rows(counted.sparkSession).groupBy(*vector).agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = [(tuple(r[f] for f in FEATURES), int(r["label"]), float(r["w"]), r["out"]) for r in corpus.union(seeds).collect()]
    rows.sort()
    model = boosting.boost([r[:3] for r in rows if not r[3]], rounds=40, depth=3)
    return model, {g: boosting.threshold(model, [r[:3] for r in rows if r[3] and r[0][0] == k + 1], PRECISION) for k, g in enumerate(PATTERNS)}


def accepted(counted: DataFrame, model: tuple[float, list], limits: dict[str, float]) -> DataFrame:
    """The distinct vectors of wider generators that the trees accept: each is scored once, however many rows have it."""
    limit = F.coalesce(*[F.when(F.col("f_gen") == k + 1, F.lit(limits[g])) for k, g in enumerate(PATTERNS)])
    wide = [k + 1 for k, g in enumerate(PATTERNS) if g in WIDE]
    return counted.where(F.col("f_gen").isin(*wide)).select(*FEATURES).distinct().where(boosting.column(model, [*FEATURES]) >= limit)


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, base and spans: arrays of (kind, start, end) in order of kind and start.

    base holds the valid matches of the base patterns; spans also holds the
    accepted other candidates, those of one kind that overlap being one span,
    and none that overlaps a base span of its kind.  Null texts are empty; a
    row per input row, repeated doc_ids included; other columns are ignored.
    """
    found = staged(described(candidates(texts(docs), gates())), "pii")
    counted = staged(summary(found), "pii-vectors")
    good = accepted(counted, *learn(counted)).withColumn("accepted", F.lit(True))
    kind = F.coalesce(*[F.when(F.col("gen") == g, F.lit(KINDS.index(k))) for g, k in KIND.items()])
    judged = (
        found.join(F.broadcast(good), [*FEATURES], "left")  # bounded by the product of FEATURES
        .withColumn("kind", kind)
        .withColumn("base", F.coalesce(F.col("gen").isin(*KINDS) & F.col("ok"), F.lit(False)))
        .withColumn("extra", F.coalesce(F.col("ok") & F.col("accepted"), F.lit(False)))
        .select("row", "doc_id", "text_hash", "gen", "kind", "start", "end", "base", "extra")
    )
    by = Window.partitionBy("row", "kind").orderBy("start", "end", "gen")
    before, after = clear_of("base", "row", "kind")
    clear = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    judged = judged.withColumn("extra", F.col("extra") & clear)
    chain = F.max(F.when(F.col("extra"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("head", F.col("base") | (F.col("extra") & F.coalesce(chain <= F.col("start"), F.lit(True))))
    group = F.sum(F.col("head").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumn("part", F.when(F.col("base") | F.col("extra"), group))
    merged = judged.groupBy("row", "doc_id", "text_hash", "kind", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("base").alias("base"))
    one = F.when(F.col("part").isNotNull(), F.struct("kind", "start", "end"))
    per_doc = merged.groupBy("row", "doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(one)).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(c: str) -> Column:
        return F.transform(c, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return per_doc.select("row", "doc_id", "text_hash", named("base").alias("base"), named("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], -s["minus"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


BLOCK = 4096


def cut_out(text: Column, spans: Column) -> Column:
    """Text with disjoint spans (start, end, kind; in order) replaced by their kind in brackets.

    Worked off in blocks of BLOCK characters, so a text with very many spans
    costs no more than its blocks times its spans.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(block: Column, i: Column) -> Column:
        low = i.cast("long") * BLOCK
        own = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < low + BLOCK))
        begin = F.struct(low.alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            kept = F.substr(block, (acc["at"] - low + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            mark = F.when(s["start"] >= low, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")  # a span that began in an earlier block is marked there
            return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, mark).alias("out"))

        return F.aggregate(own, begin, step, lambda acc: F.concat(acc["out"], F.substr(block, (acc["at"] - low + 1).cast("int"))))

    return F.array_join(F.transform(blocks, piece), "")


def disjoint(found: DataFrame) -> DataFrame:
    """doc_id, text_hash and spans without overlap: of overlapping ones the first, then the longest, gives the kind."""
    flat = found.where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline("spans"))
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("head", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    flat = flat.withColumn("part", F.sum("head").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    one = flat.groupBy("doc_id", "text_hash", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    return one.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Every row of docs with its personal data replaced, rows without doc_id too; n_chars, where there is one, follows the text."""
    found = disjoint(find(docs)).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), F.col("spans").alias("found_spans"))
    both = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("found_id")) & (F.xxhash64("text") == F.col("found_hash")), "left")
    text = F.when(F.col("found_spans").isNull(), F.col("text")).otherwise(cut_out(F.col("text"), F.col("found_spans")))
    out = both.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], F.col("found_spans").isNotNull().alias("changed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("changed"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("changed")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

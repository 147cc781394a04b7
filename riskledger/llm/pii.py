"""Personal data in texts: generated candidates, boosted trees, calibrated thresholds.

Generators propose spans, many and overlapping: whatever looks a little like an e-mail address, an IP
address, a card or a phone number. The base spans are those of four fixed patterns that pass their
check (ranges, Luhn digits, number of digits); they are always kept. Every other proposal is scored by
gradient boosted trees over its format (lengths, digits, groups, checks) and its context (neighbouring
characters and words).

The trees are trained in each call, on all distinct proposals of either label: a base
span is a positive, a proposal that touches no base span a negative, unless it is part of a longer match of a
fixed pattern that failed its check and so may hide something. One proposal in HELD_OUT is kept
out of training; on these each kind gets the least threshold at which so large a share of what it
selects is positive as PRECISION asks. A proposal that touches no base span and reaches its kind's
threshold is added; of proposals that overlap in a chain the best scored one.

All of it is column expressions, windows and a fitted JVM model; no Python runs in the tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskledger.session import scratch

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, in forms that neither recurse per character nor start again inside a run.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: (kind, pattern) of further proposals: looser shapes, and the shapes inside a base match that fails its check.
MORE = (
    (0, r"(?<![^\s<>()\[\],;:\"'@])[^\s<>()\[\],;:\"'@]++@[^\s<>()\[\],;:\"'@]++"),
    (1, r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    (1, r"(?<![0-9])[0-9]++(?:\.[0-9]++)++"),
    (2, r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    (3, r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    (3, r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
#: What a text must hold for a generator of the kind to be tried.
NEEDS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"[0-9][0-9().\x20-]+[0-9]")
CONTEXT = 24
WORDS_NEAR = (r"mail|contact|write to|@", r"\bip\b|address|server|host", r"card|visa|credit|kredit|carte|tarjeta", r"tel|phone|fon|call|fax|mobil")

HELD_OUT = 5
#: Thresholds are looked for from 0.5 on.
PRECISION = 0.95
#: Held-out positives that a kind needs before anything of it is added.
ENOUGH = 5
TREES, DEPTH, SEED = 20, 4, 13

FEATURES = (
    "kind", "size", "digits", "letters", "dots", "gaps", "groups", "longest", "plus", "paren", "luhn", "quad", "named_end",
    "letter_before", "digit_before", "letter_after", "digit_after", "quoted", "word_near",
)
#: Numbers in one block of a running sum.
BLOCK = 256


def _running(lengths: Column) -> Column:
    """The sum before each number of an array, by blocks, so that long arrays are not copied per number."""

    def within(numbers: Column, base: Column) -> Column:
        first = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(numbers, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    count = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: F.slice(lengths, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, within(sums, F.lit(0)), within))


def _spans(matches: Column, gaps: Column, kind: int, base: bool) -> Column:
    """One struct per match: kind, base, fixed (whether of a fixed pattern), start, end (code points), match, before, after (what stands between it and the next ones)."""
    n = F.size(matches)
    steps = F.zip_with(matches, F.slice(gaps, 1, n), lambda m, g: F.char_length(m) + F.char_length(g))
    starts = F.zip_with(_running(steps), F.slice(gaps, 1, n), lambda at, g: at + F.char_length(g))
    around = F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda b, a: F.struct(F.right(b, F.lit(CONTEXT)).alias("before"), F.left(a, F.lit(CONTEXT)).alias("after")))
    placed = F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("match")))
    return F.zip_with(placed, around, lambda p, c: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.lit(base).alias("fixed"), p["start"].alias("start"), p["end"].alias("end"), p["match"].alias("match"), c["before"].alias("before"), c["after"].alias("after")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    n = F.char_length(digits)
    doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.when(n.between(13, 19), F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0).otherwise(F.lit(False))


def _quad(match: Column) -> Column:
    """Whether four dotted parts are at most 255."""
    return match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?(?:\.|$)){4}$") & match.rlike(r"^[0-9]++(?:\.[0-9]++){3}$")


def _passes(kind: int, match: Column) -> Column:
    if kind == 1:
        return _quad(match)
    if kind == 2:
        return _luhn(_digits(match))
    if kind == 3:
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: s.withField("base", _passes(kind, s["match"])))


def proposals(docs: DataFrame) -> DataFrame:
    """``docs`` (key, id, text) as key, id, spans: the proposals of all generators, in their order."""
    generators = [*((k, p, True) for k, p in enumerate(BASE)), *((k, p, False) for k, p in MORE)]
    none = F.array().cast("array<string>")
    some, matches, gaps = {}, {}, {}
    for g, (kind, pattern, _) in enumerate(generators):
        there = F.col("text").contains(NEEDS[kind]) if kind == 0 else F.col("text").rlike(NEEDS[kind])
        some[f"has{g}"] = F.col("text").contains("+") & there if pattern.startswith(r"\+") else there
        matches[f"m{g}"] = F.when(F.col(f"has{g}"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        gaps[f"g{g}"] = F.when(F.size(f"m{g}") > 0, F.split("text", pattern, -1))
    out = docs.withColumns(some).withColumns(matches).withColumns(gaps)
    found = []
    for g, (kind, _, base) in enumerate(generators):
        spans = _spans(F.col(f"m{g}"), F.col(f"g{g}"), kind, base)
        if base:
            spans = _checked(spans, kind)
        found.append(F.when(F.size(f"m{g}") > 0, spans))
    empty = F.array().cast("array<struct<kind:int,base:boolean,fixed:boolean,start:int,end:int,match:string,before:string,after:string>>")
    return out.select("key", "id", F.concat(*[F.coalesce(f, empty) for f in found]).alias("spans"))


def features(spans: DataFrame) -> DataFrame:
    """The format and context of each span (kind, match, before, after) as numbers."""
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    digits = F.char_length(_digits(m))
    runs = F.split(m, "[^0-9]+")

    def of(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(m, f"[^{pattern}]", ""))

    near = F.lower(F.concat(before, F.lit(" "), after))
    values = {
        "size": F.char_length(m),
        "digits": digits,
        "letters": of("A-Za-z"),
        "dots": of("."),
        "gaps": of(r"\x20-"),
        "groups": F.size(F.filter(runs, lambda x: x != "")),
        "longest": F.array_max(F.transform(runs, lambda x: F.char_length(x))),
        "plus": m.startswith("+"),
        "paren": m.contains("("),
        "luhn": _luhn(_digits(m)),
        "quad": _quad(m),
        "named_end": m.rlike(r"\.[A-Za-z]{2,}$"),
        "letter_before": before.rlike(r"\p{L}$"),
        "digit_before": before.rlike(r"[0-9][.+-]?$"),
        "letter_after": after.rlike(r"^\p{L}"),
        "digit_after": after.rlike(r"^[.-]?[0-9]"),
        "quoted": before.rlike("[\"'=/]$"),
        "word_near": reduce(lambda a, b: a | b, [(F.col("kind") == k) & near.rlike(w) for k, w in enumerate(WORDS_NEAR)]),
    }
    return spans.withColumns({k: v.cast("double") for k, v in values.items()})


def _labelled(found: DataFrame) -> DataFrame:
    """Proposals with label: 1 for base spans, 0 for those that touch none; the others are left out.

    ``hidden`` are those of label 0 inside a longer match of a fixed pattern: they are scored, not learned from.
    """
    spans = found.select("key", F.explode("spans").alias("s")).select("key", "s.*")
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), "kind", F.desc("fixed"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    earlier, later = F.max(F.when(F.col("base"), F.col("end"))).over(before), F.min(F.when(F.col("base"), F.col("start"))).over(after)
    touched = F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))
    failed = F.max(F.when(F.col("fixed") & ~F.col("base"), F.col("end"))).over(before)
    hidden = ~F.col("fixed") & F.coalesce(failed >= F.col("end"), F.lit(False))
    spans = spans.withColumns({"touched": touched, "hidden": hidden}).where("base or not touched").withColumn("label", F.col("base").cast("double"))
    # the same words in copies of a text are one example
    return features(spans).withColumn("mark", F.xxhash64("kind", "match", "before", "after"))


def fit(labelled: DataFrame, folder: str):
    """The trees, and the threshold of each kind; None without examples of both labels.

    Every distinct example counts. Examples alike in all features, label and side are one row that weighs their number.
    """
    spark = labelled.sparkSession
    distinct = labelled.where("not hidden").groupBy("label", "mark").agg(*[F.first(c).alias(c) for c in FEATURES])
    held = F.pmod(F.xxhash64("mark", F.lit(SEED + 1)), F.lit(HELD_OUT)) == 0
    alike = ["label", "held", *FEATURES]
    examples = distinct.withColumn("held", held).groupBy(*alike).agg(F.count("*").cast("double").alias("weight")).sortWithinPartitions(*alike)
    examples.write.parquet(f"{folder}/examples")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(spark.read.schema(examples.schema).parquet(f"{folder}/examples"))
    train = rows.where("not held")
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(train)
    scored = _scored(model, rows.where("held")).select("kind", "label", "weight", "score", F.explode(F.sequence(F.lit(50), F.lit(95), F.lit(5))).alias("t"))
    hits = F.sum(F.col("label") * F.col("weight"))
    taken = scored.where(F.col("score") * 100 >= F.col("t")).groupBy("kind", "t").agg((hits / F.sum("weight")).alias("share"), hits.alias("hits"))
    limits = taken.where((F.col("share") >= PRECISION) & (F.col("hits") >= ENOUGH)).groupBy("kind").agg(F.min("t").alias("t"))
    return model, {int(r["kind"]): r["t"] / 100 for r in limits.collect()}


def _scored(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def _added(labelled: DataFrame, folder: str) -> DataFrame:
    """key, kind, start, end, score of the proposals beyond the base spans that are selected."""
    fitted = fit(labelled, folder)
    empty = labelled.where("false").select("key", "kind", "start", "end", F.lit(0.0).alias("score"))
    if fitted is None or not fitted[1]:
        return empty
    model, limits = fitted
    limit = reduce(lambda a, b: a.when(F.col("kind") == b[0], b[1]), limits.items(), F.when(F.lit(False), 2.0)).otherwise(2.0)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(labelled.where("label = 0"))
    taken = _scored(model, rows).where(F.col("score") >= limit).select("key", "kind", "start", "end", "score")
    order = Window.partitionBy("key").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = taken.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("chain", F.sum("new").over(order))
    best = Window.partitionBy("key", "chain").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    return chained.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("key", "kind", "start", "end", "score")


def as_text(spans: Column) -> Column:
    """Spans (kind, start, end) as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def counts(column: str) -> list[Column]:
    """n_email, n_ip, n_card, n_phone of an array of spans."""

    def of(kind: int) -> Column:
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return [of(k) for k in range(len(KINDS))]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and added: arrays of (kind, start, end), by kind and start; kind is a place in KINDS.

    Places count code points, the end is exclusive. A null text is empty and has no spans. Repeated rows
    are rows of their own; an empty table gives an empty result; no other column is read. Without
    examples of both labels, and for kinds with few held-out positives, nothing is added.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "pii")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = proposals(rows)
    found.write.parquet(f"{folder}/found")
    found = spark.read.schema(found.schema).parquet(f"{folder}/found")
    labelled = _labelled(found)
    labelled.write.parquet(f"{folder}/labelled")
    labelled = spark.read.schema(labelled.schema).parquet(f"{folder}/labelled")
    added = _added(labelled, folder).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    place = "array<struct<kind:int,start:int,end:int>>"
    base = F.sort_array(F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("key", "id", base.alias("base")).join(added, "key", "left").select("id", "base", F.coalesce("added", F.array().cast(place)).alias("added"))


def _replaced(text: Column, kind: int) -> Column:
    """``text`` with its base spans of a kind replaced by the kind in brackets."""
    matches = F.concat(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), F.array(F.lit("")))
    name = F.lit(f"[{KINDS[kind]}]")
    return F.array_join(F.zip_with(F.split(text, BASE[kind], -1), matches, lambda g, m: F.concat(g, F.when((m != "") & _passes(kind, m), name).otherwise(m))), "")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every base span of the text replaced by its kind in brackets; nulls stay null.

    Phones go first, since a card or an address may lie inside one.
    """
    return docs.withColumn(text_col, reduce(_replaced, (0, 3, 1, 2), F.col(text_col)))

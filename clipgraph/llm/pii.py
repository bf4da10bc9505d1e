"""Personal data: base rules, and boosted trees over further candidate spans, in DataFrame functions only.

The base rules find e-mail addresses, IP addresses, card and phone numbers exactly. Beside them,
generators with wide patterns propose candidates, which may overlap; gradient-boosted trees judge
each by its format and the text around it. The trees learn from the corpus itself, a candidate that
coincides with a base span is an example of personal data; the features leave out the signs that
the base rules look at, so that what merely lacks such a sign is found. Scores are turned into
shares of true spans on rows kept apart, and a span is added where that share reaches a limit.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import stored, tag

KINDS = ["email", "ip", "card", "phone"]

# fixed values: patterns of the base rules. Where a run of a pattern's first characters could be entered in the middle, the
# match must begin at the start of the run or where the last match ended: that is where the leftmost match begins anyway,
# and it keeps long runs from being read again from each of their characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns; a candidate of a kind is proposed for redaction as that kind.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?)[A-Za-z0-9-]{1,64}"
             r"(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]{1,32}){1,5}",
    "ip": r"(?<![0-9.:])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[\x20./-]{1,2}[(]?[0-9]{2,5}[)]?){2,5}(?![0-9A-Za-z])",
}

FEATURES = [
    "length", "digits", "letters", "spaces", "groups", "word_groups", "brackets", "dots", "hyphens", "slashes",
    "left_space", "right_space", "left_letter", "right_letter", "left_digit", "right_digit", "is_email", "is_ip", "is_card", "is_phone",
]


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows by a tag of the key and a hash of the text; null texts count as empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("__k"), tag(F.col(f"`{key}`")).alias("__t"), F.xxhash64(body).alias("__h"), body.alias("__text"))


def matches(rows: DataFrame) -> DataFrame:
    """(__t, __h, layer, kind, start, end, value, left, right): matches of the base and the wide patterns.

    ``left`` and ``right`` are up to 8 characters beside a match; places are in code points. The
    pieces between a text's matches and the matches give the places by a running sum. Texts are
    read where they lie, and only matches move.
    """
    body = F.col("__text")
    patterns = [("base", k, p) for k, p in BASE.items()] + [("wide", k, p) for k, p in WIDE.items()]
    values, pairs = [], []
    for i, (layer, kind, pattern) in enumerate(patterns):
        # texts without a character that every match has are not searched
        may = {"email": body.rlike(r"[@\[({]"), "phone": body.contains("+")}.get(kind) if (layer, kind) != ("wide", "phone") else None
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        values.append((found if may is None else F.when(may, found)).alias(f"__v{i}"))
        pairs.append(F.when(F.size(f"__v{i}") > 0, F.struct(
            F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), F.col(f"__v{i}").alias("v"), F.split("__text", pattern, -1).alias("b"))))
    found = rows.select("__t", "__h", "__text", *values).select(
        "__t", "__h", F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("__p"))
    each = found.select("__t", "__h", "__p.layer", "__p.kind", F.posexplode(F.arrays_zip(
        F.col("__p.v").alias("v"), F.col("__p.b").alias("b"), F.slice("__p.b", F.lit(2), F.greatest(F.size("__p.v"), F.lit(1))).alias("n"))).alias("i", "m"))
    each = each.select("__t", "__h", "layer", "kind", "i", F.col("m.v").alias("value"), F.length("m.b").alias("gap"),
                       F.right("m.b", F.lit(8)).alias("left"), F.left("m.n", F.lit(8)).alias("right")).filter("value is not null")
    once = each.groupBy("__t", "__h", "layer", "kind", "i").agg(*[F.first(c).alias(c) for c in ("value", "gap", "left", "right")])
    upto = Window.partitionBy("__t", "__h", "layer", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return once.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto)).select(
        "__t", "__h", "layer", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "left", "right")


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern passes the kind's test."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(n.between(16, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True)))


def featured(candidates: DataFrame) -> DataFrame:
    """Format and context of candidates, as numbers; the signs that base rules ask for are not among them."""
    def count(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)).cast("double")

    first, last = F.right("left", F.lit(1)), F.left("right", F.lit(1))
    flags = {"left": first, "right": last}
    cols = {
        "length": F.length("value").cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "spaces": count(r"\x20"),
        "groups": count("[0-9]+"), "word_groups": count("[A-Za-z]+"), "brackets": count(r"[()\[\]{}]"), "dots": count(r"[.]"),
        "hyphens": count("-"), "slashes": count("/"),
    }
    for side, c in flags.items():
        cols[f"{side}_space"] = ((c == "") | c.rlike(r"\s")).cast("double")
        cols[f"{side}_letter"] = c.rlike(r"\p{L}").cast("double")
        cols[f"{side}_digit"] = c.rlike("[0-9]").cast("double")
    for kind in KINDS:
        cols[f"is_{kind}"] = (F.col("kind") == kind).cast("double")
    return candidates.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in cols.items()})


def learn(labelled: DataFrame, precision: float = 0.95) -> tuple[GBTClassificationModel | None, dict[str, float]]:
    """Boosted trees on featured candidates with ``label``, and for each kind the score from which spans are added.

    Every candidate counts: those with equal features and label are one row whose weight is their number, which
    keeps the table of examples small. The candidates of a third of the places, by a hash, are kept apart: the
    limit of a kind is the lowest of 100 score steps from which on the share of true candidates among them is
    ``precision`` or more; a kind without such a step adds nothing. None if the candidates all have one label.
    """
    apart = (F.pmod(F.xxhash64("__h", "start"), F.lit(3)) == 0).alias("apart")
    examples = stored(labelled.groupBy("kind", *FEATURES, "label", apart).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    train = examples.filter("not apart")
    if train.select("label").distinct().count() < 2:
        return None, {}
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, seed=1, labelCol="label", featuresCol="features", weightCol="weight")
    model = trees.fit(vectors.transform(train))
    judged = scored(model, examples.filter("apart"))
    steps = judged.groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("step")).agg(
        F.sum(F.col("label") * F.col("weight")).alias("true"), F.sum("weight").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = steps.withColumn("share", F.sum("true").over(down) / F.sum("n").over(down)).filter(F.col("share") >= precision)
    return model, {r["kind"]: r["step"] / 100 for r in good.groupBy("kind").agg(F.min("step").alias("step")).collect()}


def scored(model: GBTClassificationModel, candidates: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return model.transform(vectors.transform(candidates)).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def _number(spans: Column, order: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted (order, start, end) spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", precision: float = 0.95) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and base_sha256 are those of the base rules; spans lists base and added spans by kind
    and place, as kind:start:end in code points.

    * Null and empty texts, and texts without spans: 0, the SHA-256 of the empty text, an empty list.
    * Repeated rows get the same result each; one key may have several texts. Empty table: no rows.
    * A corpus in which no candidate, or every one, is a base span teaches nothing: no span is added.
    * Added spans never overlap base spans. Other columns are not read.

    Texts are read where they lie and never move; matches are gathered for each document.
    """
    rows = _rows(df, key, text)
    found = stored(matches(rows))
    place = ["__t", "__h", "kind", "start", "end"]
    base = found.filter("layer = 'base'").filter(valid(F.col("kind"), F.col("value"))).select(*place)
    wide = found.filter("layer = 'wide'")
    labelled = featured(wide).join(base.withColumn("label", F.lit(1.0)), place, "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
    labelled = stored(labelled.drop("value", "left", "right", "layer"))
    model, limits = learn(labelled, precision)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct(order.alias("order"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spans = base.select("__t", "__h", span.alias("s"), F.lit(False).alias("added"))
    if limits:
        limit = F.lit(2.0)
        for kind, least in sorted(limits.items()):
            limit = F.when(F.col("kind") == kind, F.lit(least)).otherwise(limit)
        more = scored(model, labelled.filter("label = 0")).filter(F.col("score") >= limit)
        spans = spans.unionByName(more.select("__t", "__h", span.alias("s"), F.lit(True).alias("added")))
    each = spans.groupBy("__t", "__h").agg(
        F.sort_array(F.collect_set(F.when(~F.col("added"), F.col("s")))).alias("__base"),
        F.sort_array(F.collect_set(F.when(F.col("added"), F.col("s")))).alias("__more"))
    each = each.withColumn("__more", F.filter("__more", lambda m: ~F.exists(
        F.col("__base"), lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"]))))
    told = each.select(
        "__t", "__h", F.size("__more").cast("long").alias("n_added"), _listed(F.col("__base")).alias("__listed"),
        _listed(F.sort_array(F.concat("__base", "__more"))).alias("spans"),
        *[_number(F.col("__base"), i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS)])
    zero = F.lit(0).cast("long")
    return rows.select("__k", "__t", "__h").join(told, ["__t", "__h"], "left").select(
        F.col("__k").alias(key), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("__listed", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", zero).alias("n_added"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span of a list as above replaced by its kind in brackets; overlapping spans are covered together."""
    parts = F.array_sort(F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(parts, begin, lambda a, p: F.struct(
        F.greatest(a["at"], p["end"]).alias("at"),
        F.concat(a["out"], F.when(p["start"] >= a["at"], F.concat(
            F.substring(text, a["at"] + 1, p["start"] - a["at"]), F.lit("["), p["kind"], F.lit("]"))).otherwise(F.lit(""))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

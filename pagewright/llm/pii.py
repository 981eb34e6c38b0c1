"""Personal data: wide candidate generators, boosted trees, calibrated thresholds.

Everything is DataFrame expressions and the DataFrame form of boosted trees.
Base matches that pass their checks (digit counts, Luhn, part sizes) are always
reported.  What the base rules reject and what the wider generators propose
becomes a candidate with format and context features, unless it lies in an
accepted base span; trees fitted on the corpus's own candidates (``labelled``)
give a probability, and each kind family's threshold is the lowest that kept the
wanted precision on all labelled candidates left out of the fit
(``family_thresholds``).  What defines a base label is hidden from the trees for
its kind (Luhn for cards, digit counts for phones, part sizes for addresses), so
that they judge what the checks reject by its format and surroundings.

Spans are found with two passes of one pattern, ``split`` for the gaps and
``regexp_extract_all`` for the matches; running lengths give the offsets, in
code points.  Repeated groups are possessive, which the JVM runs as a loop, so
neither long runs nor long texts make a match expensive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# The base kinds in listed order.
BASE_KINDS = ("email", "ip", "card", "phone")
WIDER_KINDS = ("email_spelled", "phone_local", "ssn", "iban", "ip_loose", "card_loose", "phone_loose")
KINDS = BASE_KINDS + WIDER_KINDS
DECOY = "digits"
# Kinds whose labelled matches calibrate another kind.
FAMILY = {"email_spelled": "email", "phone_local": "phone", "ip_loose": "ip", "card_loose": "card", "phone_loose": "phone"}

# A local part starts where its run of letters starts, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
# Over a text in which separators without a digit behind them are masked.
CARD = r"[0-9][0-9\x20-]++"
LOOSE_SEPARATOR = r"[\x20-](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# 15 to 35 characters, in groups of four and a shorter last one, if any.
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
IBAN_REST = (r"(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})"
             r"(?![A-Za-z0-9])")
IBAN_REACH = 44         # its code points with spaces, and the one behind it
WIDER = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]++"
                     r"(?:\x20?[\[(](?:dot|DOT|\.)[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": IBAN_HEAD + IBAN_REST,
    DECOY: r"(?<![0-9A-Za-z])[0-9]{4,}+(?![0-9A-Za-z])",
}
# Whether a text can hold the kind at all; cheaper than the full pattern.
MAY_HOLD = {
    "email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][0-9\x20-]{12}"),
    "email_spelled": lambda t: t.rlike(r"[\[(](?:at|AT|@)[\])]"), "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "phone_local": lambda t: t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), DECOY: lambda t: t.rlike("[0-9]{4}"),
}
WORDS = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|card|visa|credit|account|iban|ssn|social|address|host|ip)\W{0,4}$"
# What stands before numbers that are nobody's.
OTHER_WORDS = r"(?i)(?:order|invoice|part|serial|version|build|item|sku|isbn|ticket|case|page|line|ref|no|nr|id|date)\W{0,4}$"
CONTEXT = 24            # code points before a span that its features see
FIT_ROWS = 20_000       # different candidates that the trees are fitted on, at most
PRECISION = 0.98        # wanted of each kind family's threshold
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,good:boolean,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array of struct(start, end, value), leftmost and non-overlapping."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), F.length(g).cast("long").alias("gap")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda a: a["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def iban_holds(value: Column) -> Column:
    """Whether an account number's length and check digits (mod 97) are right."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    codes = F.transform(F.filter(F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), ""), lambda c: c != ""),
                        lambda c: F.ascii(c) - F.when(F.ascii(c) < 58, 48).otherwise(55))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.pmod(a * F.when(c < 10, 10).otherwise(100) + c, F.lit(97)))
    return F.length(bare).between(15, 34) & (rest == 1)


def iban_matches(text: Column) -> Column:
    """Like ``matches``, but a number ends with the last group up to which its
    check digits hold, so that words behind it stay outside and a number behind
    it is found too.  Without such a group it is the whole match.
    """
    def cut(value: Column) -> Column:
        groups = F.split(value, " ")
        heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return F.coalesce(F.get(F.filter(heads, iban_holds), 0), value)

    values = F.transform(matches(text, f"{IBAN_HEAD}(?={IBAN_REST})"), lambda m: F.struct(m["start"].alias("start"), cut(
        F.regexp_extract(F.substring(text, (m["start"] + 1).cast("int"), F.lit(IBAN_REACH)), f"^{IBAN_HEAD}{IBAN_REST}", 0)).alias("value")))
    spans = F.transform(values, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"),
                                                   m["value"].alias("value"), iban_holds(m["value"]).alias("holds")))
    # A group inside a number may look like the head of one: ``any`` and ``sure``
    # are the furthest ends of all numbers so far and of those that hold.
    far = F.lit(0).cast("long")
    none = F.struct(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"), far.alias("any"), far.alias("sure"))
    return F.aggregate(spans, none, lambda a, s: F.struct(
        F.when((s["start"] >= a["any"]) | (s["holds"] & (s["start"] >= a["sure"])), F.concat(a["out"], F.array(F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))).otherwise(a["out"]).alias("out"),
        F.greatest(a["any"], s["end"]).alias("any"),
        F.when(s["holds"], F.greatest(a["sure"], s["end"])).otherwise(a["sure"]).alias("sure")), lambda a: a["out"])


def passes(kind: str, value: Column) -> Column:
    """The checks of a match: the base rules' and an account number's."""
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), F.call_function("luhn_check", digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    if kind == "iban":
        return iban_holds(value)
    return F.lit(True)


def kind_spans(text: Column, kind: str, pattern: str) -> Column:
    """The candidates of one kind, checked and with their surroundings."""
    seen = F.regexp_replace(text, LOOSE_SEPARATOR, "x") if kind == "card" else text
    spans = F.transform(iban_matches(text) if kind == "iban" else matches(seen, pattern), lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
        passes(kind, m["value"]).alias("good"),
        F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)).cast("int") + 1,
                    F.least(m["start"], F.lit(CONTEXT)).cast("int")).alias("before"),
        F.substring(text, (m["end"] + 1).cast("int"), F.lit(1)).alias("after")))
    return F.when(MAY_HOLD[kind](text), spans).otherwise(F.array().cast(SPAN))


def candidate_spans(text: Column) -> Column:
    """All base and wider candidates of a text."""
    rules = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), *WIDER.items())
    return F.concat(*[kind_spans(text, kind, pattern) for kind, pattern in rules])


def with_features(rows: DataFrame) -> DataFrame:
    """Format and context of a candidate, as doubles; what its kind's check looks at is zero."""
    value, kind = F.col("value"), F.col("kind")
    size, n = F.length(value), F.length(digits(value))
    parts = {
        "f_size": F.when(~kind.isin("card", "phone"), size), "f_digits": F.when(~kind.isin("card", "phone"), n), "f_share": n / F.greatest(size, F.lit(1)),
        "f_luhn": F.when((kind != "card") & n.between(1, 32), F.call_function("luhn_check", digits(value))).otherwise(False),
        "f_iban": F.when(value.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,39}$"), iban_holds(value)).otherwise(False),
        "f_groups": F.size(F.split(value, "[^0-9]+")), "f_dots": F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))),
        "f_at": value.contains("@"), "f_plus": value.startswith("+"), "f_letters": value.rlike("[A-Za-z]"),
        "f_spelled": value.rlike(r"[\[(](?:at|AT|@)[\])]"),
        "f_even": F.size(F.array_distinct(F.transform(F.split(value, "[^0-9A-Za-z]+"), F.length))),
        "f_other": F.col("before").rlike(OTHER_WORDS),
        "f_word": F.col("before").rlike(WORDS), "f_joined": F.col("before").rlike("[A-Za-z0-9]$"),
        "f_quoted": F.col("before").rlike("[\"'=:]\\s?$"), "f_next": F.col("after").rlike("[A-Za-z0-9]"),
    }
    return rows.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in parts.items()])


FEATURES = ["f_size", "f_digits", "f_share", "f_luhn", "f_iban", "f_groups", "f_dots", "f_at", "f_plus", "f_letters", "f_spelled", "f_even", "f_other",
            "f_word", "f_joined", "f_quoted", "f_next"]


def among(each: DataFrame) -> DataFrame:
    """Adds whether a candidate overlaps an accepted base span (``in_base``) or any other
    candidate that can be reported (``in_solid``), itself left out."""
    order = Window.partitionBy("_row").orderBy("start", "end", "kind")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind").isin(*BASE_KINDS) & F.col("good")

    def overlaps(which: Column) -> Column:
        return (F.coalesce(F.max(F.when(which, F.col("end"))).over(before) > F.col("start"), F.lit(False))
                | F.coalesce(F.min(F.when(which, F.col("start"))).over(behind) < F.col("end"), F.lit(False)))

    return each.withColumn("in_base", overlaps(base)).withColumn("in_solid", overlaps(base | F.col("kind").isin(*WIDER)
                                                                                   & (F.col("kind") != DECOY)))


def labelled(each: DataFrame) -> DataFrame:
    """Candidates with a ``label``.

    Good: base matches that pass, account numbers whose check digits hold, and
    what accepted matches look like when written another way (e-mails spelled out,
    phones without the country code).  Not good: the rejected ones of both, unless
    another candidate overlaps them and may be right; plain digit runs.  Such digits
    are rejected examples of the wider kinds, too.  Where
    the checks know nothing (``ssn``, ``phone_local``, ``email_spelled``), words before the
    candidate label it; the others have no label.
    """
    is_base, wider = F.col("kind").isin(*BASE_KINDS), F.col("kind").isin("ssn", "phone_local", "email_spelled") & ~F.col("in_base")
    told, other = F.col("before").rlike(WORDS), F.col("before").rlike(OTHER_WORDS)
    label = (F.when(F.col("kind") == DECOY, F.when(~F.col("in_solid"), 0.0))
             .when(is_base, F.when(F.col("good"), 1.0).when(~F.col("in_solid"), 0.0))
             .when(F.col("kind") == "iban", F.col("good").cast("double"))
             .when(wider & (told != other), told.cast("double")))
    value = F.col("value")
    spelled = F.replace(F.replace(value, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] "))
    local = F.regexp_extract(value, r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", 0)
    again = (each.where(F.col("good") & F.col("kind").isin("email", "phone"))
             .withColumn("value", F.when(F.col("kind") == "email", spelled).otherwise(local))
             .withColumn("kind", F.when(F.col("kind") == "email", "email_spelled").otherwise("phone_local"))
             .where(F.col("value") != "").withColumn("label", F.lit(1.0)))
    known = each.withColumn("label", label).where(F.col("label").isNotNull())
    # Digits that are nobody's are nobody's phone, number or address either.
    nobody = known.where((F.col("label") == 0) & F.col("kind").isin(DECOY, "card"))
    return known.unionByName(again).unionByName(nobody.withColumn("kind", F.explode(F.array(*map(F.lit, ("phone_local", "ssn", "email_spelled"))))))


def lowest(bins: list[tuple[int, float, int]], precision: float) -> float | None:
    """The lowest threshold from which upwards the share of good ones is ``precision``; bins are (bin, good, all)."""
    good = n = 0
    threshold = None
    for at, g, k in sorted(bins, reverse=True):
        good, n = good + g, n + k
        if good / n >= precision:
            threshold = at / 100
    return None if threshold is None else max(threshold, 0.5)


def family_thresholds(counts: list[tuple[str, int, float, int]], precision: float) -> dict[str, float | None]:
    """The threshold of every kind that can be added, from (kind, bin, good, all).

    A family has its own if it holds accepted and rejected candidates.  One
    without (no labels, or nothing rejected, as with e-mails) takes the
    threshold of all candidates of the families that do, and of plain digit
    runs, taken together, but for base kinds that failed their check.  None: no
    threshold keeps the precision, nothing is added.
    """
    bins: dict[str, dict[int, tuple[float, int]]] = {}
    for kind, at, good, n in counts:
        held = bins.setdefault(FAMILY.get(kind, kind), {})
        held[at] = (held.get(at, (0, 0))[0] + good, held.get(at, (0, 0))[1] + n)
    listed = {f: [(at, g, n) for at, (g, n) in held.items()] for f, held in bins.items()}
    both = [f for f, held in listed.items() if 0 < sum(g for _, g, _ in held) < sum(n for _, _, n in held)]
    own = {f: lowest(listed[f], precision) for f in both}
    together: dict[int, tuple[float, int]] = {}
    for f in dict.fromkeys([*both, DECOY]):
        for at, g, n in listed.get(f, []):
            together[at] = (together.get(at, (0, 0))[0] + g, together.get(at, (0, 0))[1] + n)
    pooled = lowest([(at, g, n) for at, (g, n) in together.items()], precision)
    return {kind: own.get(FAMILY.get(kind, kind), None if kind.endswith("_loose") else pooled) for kind in WIDER_KINDS}


def fit_trees(labelled: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION):
    """Boosted trees and one threshold per kind, or None without two classes.

    ``labelled``: candidates with features and ``label``.  The trees see three
    quarters of at most ``fit_rows`` different candidates, those with the
    smallest hashes, so the fit does not depend on the layout.  All other
    labelled candidates, copies counted, calibrate the thresholds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # Equal hashes have equal features and labels.
    hashed = labelled.withColumn("_h", F.xxhash64("kind", "value", "before", "after"))
    last = hashed.select("_h").distinct().orderBy("_h").limit(fit_rows).agg(F.max("_h")).first()[0]
    if last is None:
        return None
    seen = (F.col("_h") <= last) & (F.pmod("_h", F.lit(4)) != 0)
    inside = materialize(hashed.where(seen).select(*FEATURES, "label", "_h").dropDuplicates(["_h"])
                         .repartitionByRange(2, "_h").sortWithinPartitions("_h"), "fit")
    if inside.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, seed=7).fit(ready.transform(inside))

    def score(rows: DataFrame) -> DataFrame:
        return model.transform(ready.transform(rows)).withColumn("p", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")

    counts = score(hashed.where(~seen).select("kind", *FEATURES, "label")).groupBy(
        "kind", F.floor(F.col("p") * 100).alias("bin")).agg(F.sum("label"), F.count(F.lit(1))).collect()  # 101 rows a kind at most
    return score, family_thresholds([tuple(r) for r in counts], precision)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``added``, arrays of struct(kind,
    start, end) ordered by kind as listed, then start; offsets in code points.

    A null or empty text has no spans; repeated rows stay repeated; an empty
    table gives no rows; other columns are ignored.  Without accepted and
    rejected candidates to learn from, nothing is added to the base spans.
    """
    given = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                        candidate_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))
    at = materialize(given, "pii")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    base = F.array_sort(F.transform(
        F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS) & s["good"]),
        lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("order"),
                           s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # Candidates are short; a document's meet in one window, its text stays behind.
    each = materialize(among(at.select("_row", F.explode("found").alias("s")).select("_row", "s.*")), "candidates")
    is_base = F.col("kind").isin(*BASE_KINDS)
    fitted = fit_trees(with_features(labelled(each)))
    out = at.select("_row", F.col("_id").alias(id_col), base.alias("base"))
    empty = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string>>")
    if fitted is None:
        return out.withColumn("added", empty)
    score, thresholds = fitted
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(t))) for k, t in thresholds.items() if t is not None], F.lit(2.0))
    open_ones = (with_features(each.where((~is_base | ~F.col("good")) & ~F.col("in_base") & (F.col("kind") != DECOY)))
                 .withColumn("kind", F.when(is_base, F.concat("kind", F.lit("_loose"))).otherwise(F.col("kind"))))
    added = (score(open_ones).where(F.col("p") >= least).groupBy("_row")
             .agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "start", "end", "kind"))).alias("added")))
    return out.join(added, "_row", "left").withColumn("added", F.coalesce("added", empty))


def redacted(text: Column, spans: Column, mark: str = "[PII]") -> Column:
    """The text with all spans, overlaps joined, replaced by ``mark``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(s["start"] >= a["at"], kept).otherwise(a["out"]).alias("out"),
                        F.greatest(a["at"], s["end"]).alias("at"))

    done = F.aggregate(ordered, first, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

"""Personal data: patterned spans, and further candidates selected by boosted trees.

Everything runs as DataFrame expressions. Patterns give the base spans. Broader generators propose overlapping
candidates (each sequence of neighbouring groups of digits in a run of numbers, spelled-out addresses); gradient-boosted
trees, trained here on a bounded sample of disguised validated spans, of their parts and of numbers that are none, score
format and context features, and a threshold calibrated on a part of the sample that training has not seen selects the
candidates that are added: of those that overlap, the one of the best score. The trees are compiled into one column
expression, so candidates are scored inside their document's row and nothing is exploded or joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# Written so that a run of characters is entered once, and without loops that recurse: time is linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators of candidates: runs of digits in any layout, whose groups of digits are combined up to so many digits, and
#: addresses with their signs spelled out.
NUMBERS, MOST_DIGITS = r"(?<![0-9])[+(]?[0-9][0-9 ().-]{5,}[0-9]", 19
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[] ?(?:dot|DOT) ?[)\]] ?)[A-Za-z0-9-]++)++"

#: Most candidates that train and calibrate the trees; precision that the threshold must reach on the unseen part.
SAMPLE, PRECISION, TREES, DEPTH = 20_000, 0.99, 12, 4


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: all matches of the pattern with their code point offsets, left to right.

    The pattern cuts the text into gaps and matches; their lengths add up to the offsets.
    """

    def places(x: Column) -> Column:
        gaps = F.transform(F.split(x, pattern, -1), lambda g: F.length(g))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        kind = "array<struct<s:int,e:int,m:string>>"
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(a: Column, p: Column) -> Column:
            s = a["at"] + p["g"]
            e = s + F.length(p["m"])
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))).alias("out"))

        return F.aggregate(pairs, start, step, lambda a: a["out"])

    return let(text, places)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True where a string of digits, at least one, passes the check."""
    n = F.length(d)

    def term(i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(m: Column) -> Column:
    """True where all parts between dots are 255 at most."""
    fits = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))
    return F.forall(F.split(m, r"\."), fits)


def is_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def base_spans(text: Column) -> Column:
    """array<struct<kind, s, e, m>>: validated patterns by kind, then start."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    some = lambda on, p: F.when(on, located(text, p)).otherwise(none)
    named = lambda spans, kind, ok: F.transform(F.filter(spans, lambda x: ok(x["m"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return F.concat(
        named(some(F.contains(text, F.lit("@")), EMAIL), "email", lambda m: F.lit(True)),
        named(some(text.rlike(r"[0-9]\.[0-9]"), IP), "ip", octets),
        named(some(text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), CARD), "card", is_card),
        named(some(F.contains(text, F.lit("+")), PHONE), "phone", is_phone),
    )


FEATURES = ("length", "digits", "letters", "dots", "spaces", "dashes", "parens", "plus", "spelled", "groups", "longest", "luhn", "octets", "before", "after", "cue", "more_before", "more_after")
#: Characters behind a candidate that its features see (before it: 16).
RIGHT = 4
_CUE = r"(?i)(?:tel|phone|call|fax|mail|card|visa|ip|addr|contact)[a-z]*[ :.#]*$"


def features(text: Column, c: Column) -> Column:
    """struct of doubles: format and context of a candidate c (s, e, m) in the text."""
    m = c["m"]
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    d = digits(m)
    before, after = F.substr(text, F.greatest(c["s"] - 15, F.lit(1)), F.least(c["s"], F.lit(16))), F.substr(text, c["e"] + 1, F.lit(RIGHT))
    values = (
        F.length(m), F.length(d), count("[A-Za-z]"), count(r"\."), count(" "), count("-"), count("[()]"), m.startswith("+"), m.rlike("(?i)[(\\[] ?at"),
        F.size(runs), F.array_max(F.transform(runs, lambda r: F.length(r))), F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)),
        (F.size(runs) == 4) & (count(r"\.") == 3) & octets(F.array_join(runs, ".")), before.rlike(r"[A-Za-z0-9]$"), after.rlike("^[A-Za-z0-9]"), before.rlike(_CUE),
        before.rlike(r"[0-9][ ().-]{1,3}$"), after.rlike(r"^[ ().-]{1,3}[0-9]"),
    )
    return F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in zip(FEATURES, values, strict=True)])


def proposals(text: Column) -> Column:
    """array<array<struct<s, e, m>>>: for each run of numbers, all sequences of its neighbouring groups that have 7 to
    MOST_DIGITS digits, with a plus sign or bracket right before them; overlapping as they come. An address alone."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def parts(run: Column) -> Column:
        def sequences(groups: Column) -> Column:
            def from_group(g: Column, i: Column) -> Column:
                opens = (g["s"] > 0) & F.substr(run["m"], g["s"], F.lit(1)).isin("+", "(")
                s = g["s"] - F.when(opens, 1).otherwise(0)
                ends = F.slice(groups, i + 1, F.least(F.size(groups) - i, F.lit(MOST_DIGITS)))
                return F.transform(ends, lambda h: F.struct((run["s"] + s).alias("s"), (run["s"] + h["e"]).alias("e"), F.substr(run["m"], s + 1, h["e"] - s).alias("m")))

            return F.filter(F.flatten(F.transform(groups, from_group)), lambda c: F.length(digits(c["m"])).between(7, MOST_DIGITS))

        return let(located(run["m"], "[0-9]+"), sequences)

    numbers = F.when(text.rlike("[0-9][0-9 ().-]{5}"), F.transform(located(text, NUMBERS), parts)).otherwise(F.array().cast("array<array<struct<s:int,e:int,m:string>>>"))
    spelled = F.when(text.rlike(r"(?i)[(\[] ?at ?[)\]]"), located(text, SPELLED)).otherwise(none)
    return F.concat(numbers, F.transform(spelled, lambda c: F.array(c)))


def added(text: Column, base: Column, selector: Selector) -> Column:
    """array<struct<kind, s, e, m>>: of each run's proposals that overlap no base span and reach the threshold, the best
    (then longest, then first), and of the rest always the best that overlaps none taken."""
    free = lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    def scored(c: Column) -> Column:
        return let(features(text, c), lambda f: F.struct((-selector.score(f)).alias("score"), (c["s"] - c["e"]).alias("size"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), F.when(f["spelled"] > 0, "address").otherwise("number").alias("kind")))

    def chosen(run: Column) -> Column:
        good = F.sort_array(F.filter(F.transform(F.filter(run, free), scored), lambda c: -c["score"] >= selector.threshold))
        none = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")
        own = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"))
        taken = F.aggregate(good, none, lambda a, c: F.when(F.exists(a, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])), a).otherwise(F.concat(a, F.array(own(c)))))
        return F.array_sort(taken, lambda x, y: x["s"] - y["s"])

    return F.flatten(F.transform(proposals(text), chosen))


def _tree(node, f: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    s = node.split()
    return F.when(f[FEATURES[s.featureIndex()]] <= float(s.threshold()), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Selector:
    """Boosted trees with a calibrated threshold; score(f) is a column expression."""

    def __init__(self, model, threshold: float) -> None:
        self.threshold = threshold
        self._trees = [(float(w), t.rootNode()) for w, t in zip(model.treeWeights, model._java_obj.trees(), strict=True)]

    def score(self, f: Column) -> Column:
        margin = F.lit(0.0)
        for w, root in self._trees:
            margin = margin + F.lit(w) * _tree(root, f)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


#: Groups of a span's letters or digits by what they are taken from: the match; an address without digits, then with
#: two names of the host and no dot before them, then cut short; the digits, the last ten of them, and the digits with
#: another last one, which fail the check.
_WHOLE, _SPLIT, _FOURS, _TEN, _OCTETS = "^(.*)$", r"^([^@]+)@([^.]+)\.(.+)$", "^(.{4})(.{4})(.{4})(.{4})(.*)$", "^(.)(.)(.)(.{3})(.{4})$", r"^(.+)\.(.+)\.(.+)\.(.+)$"
#: kind, label, source, groups, layout. Label 1 keeps what was validated in a layout that the patterns miss; label 0
#: fails the check or has the layout of a date, an amount, a range, a decimal, a counter or a part.
DISGUISES = [
    *[("email", 1, of, _SPLIT, t) for of in ("m", "plain", "bare", "brief") for t in ("$1 [at] $2 [dot] $3", "$1 (at) $2 (dot) $3", "$1[at]$2[dot]$3", "$1 [at] $2.$3", "$1 (at) $2.$3", "$1(at)$2.$3", "$1 [AT] $2 [DOT] $3", "$1 (AT) $2.$3")],
    *[("email", 0, of, _SPLIT, t) for of in ("m", "plain", "bare", "brief") for t in ("$1 (at) 10.30", "$1 [at] 7.45")],
    *[("ip", 1, "m", _OCTETS, t) for t in ("$1.$2.$3.$4", "$1 . $2 . $3 . $4")],
    *[("ip", 0, "m", _OCTETS, t) for t in ("987$1.$2.$3.$4", "$1.$2.$3.$4.$1", "$1 $2 $3 $4", "$1-$2-$3-$4")],
    *[("card", 1, "d", _FOURS, t) for t in ("$1$2$3$4$5", "$1 $2 $3 $4$5", "$1-$2-$3-$4$5", "$1.$2.$3.$4$5", "$1 - $2 - $3 - $4$5")],
    *[("card", 0, "wrong", _FOURS, t) for t in ("$1$2$3$4$5", "$1 $2 $3 $4$5", "$1-$2-$3-$4$5", "$1.$2.$3.$4$5", "$1 - $2 - $3 - $4$5")],
    *[("card", 0, "d", _FOURS, t) for t in ("$1 $2 $3", "$1$2$3")],
    *[("phone", 1, "m", _WHOLE, "$1"), ("phone", 1, "m", r"^\+(.*)$", "$1")],
    *[("phone", 1, "ten", _TEN, t) for t in ("($1$2$3) $4-$5", "$1$2$3-$4-$5", "$1$2$3 $4 $5", "$1$2$3.$4.$5", "0$1$2 $3$4 $5", "(0$1$2) $3$4 $5", "0$1$2$3 $4$5")],
    *[("phone", 0, "ten", _TEN, t) for t in ("20$1$2-0$3-1$3", "1$1.0$2.19$3$1", "19$1$2-20$3$1", "19$1$2 - 20$3$1", "$1 $4 $4", "$1.$4$5", "$1.$2$3$4$5", "$1.$2$1$3$4$5", "$1$2$3.$4$5", "$1$2$3$4$5", "$1$2$4$3$1", "$4$5", "$1 $2 $3 $1 $2 $3 $1", "$1$2 $3$1 $2$3 $1$1", "$1$2$3-$5", "$1$4. $4", "$1$2$3$1 $5", "$4 ($5")],
]


def examples(spark: SparkSession, rows: DataFrame, sample: int) -> DataFrame:
    """label, features and _h of training candidates, at most so many; rows: base and text of documents.

    No label repeats the base rule, and candidates that no validated span touches are never taught as negatives, as
    missed personal data are among them. Positives are disguises of validated spans, in their context and without it;
    negatives are the layouts that fail. A kind gives a fortieth of the sample of spans at most, those of the smallest
    hashes. Of every positive with several groups, what is left without its first or its last group is a negative too,
    a whole card beside other digits a positive, and
    one glued to letters a negative. Disguises of one span share _h.
    """
    from pyspark.sql import Window

    spot = F.explode("_base").alias("b")
    near = rows.select(spot, "_t").select("b.kind", "b.m", F.substr("_t", F.greatest(F.col("b.s") - 15, F.lit(1)), F.least(F.col("b.s"), F.lit(16))).alias("left"), F.substr("_t", F.col("b.e") + 1, F.lit(RIGHT)).alias("right"))
    near = near.withColumn("_h", F.xxhash64("m")).withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("_h", "left", "right"))).where(F.col("_n") <= sample // 40)
    near = cut(spark, near)
    d = digits(F.col("m"))
    plain = F.regexp_replace("m", "[0-9]", "")
    bare = F.regexp_replace(plain, r"[.](?=[^@]*@)|(?<=[@.])[^.@]*[.](?=[^.]*[.])", "")
    turned = ((F.substr(d, F.length(d), F.lit(1)).cast("int") + 1) % 10).cast("string")
    wrong = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), turned)
    near = near.select("kind", "left", "right", "_h", F.create_map(F.lit("m"), F.col("m"), F.lit("plain"), plain, F.lit("bare"), bare, F.lit("brief"), F.regexp_replace(bare, "^([^@]{1,3})[^@]*@", "$1@"), F.lit("d"), d, F.lit("wrong"), wrong, F.lit("ten"), F.rpad(F.right(d, F.lit(10)), 10, "5")).alias("_of"))
    layouts = F.broadcast(spark.createDataFrame(DISGUISES, "kind string, label int, of string, groups string, layout string"))  # some fifty rows
    forms = near.join(layouts, "kind").where(F.rlike(F.col("_of")[F.col("of")], F.col("groups"))).select("kind", "label", "_h", "right", F.explode(F.array("left", F.lit(" "))).alias("left"), F.regexp_replace(F.col("_of")[F.col("of")], F.col("groups"), F.col("layout")).alias("m"))
    whole = (F.col("label") == 1) & F.col("kind").isin("card", "phone")
    parted = forms.where(whole & F.col("m").rlike(r"[0-9][ ().-]+[0-9]"))
    head, tail = F.regexp_extract("m", r"^([+(]*[0-9]+[ ().-]+)[+(]?[0-9].*$", 1), F.regexp_extract("m", r"^.*[0-9]([ ().-]+[0-9]+)$", 1)
    back = parted.select("kind", F.lit(0).alias("label"), "_h", "right", F.concat("left", head).alias("left"), F.substr("m", F.length(head) + 1, F.length("m")).alias("m"))
    front = parted.select("kind", F.lit(0).alias("label"), "_h", F.concat(tail, "right").alias("right"), "left", F.substr("m", F.lit(1), F.length("m") - F.length(tail)).alias("m"))
    beside = forms.where(whole & (F.col("kind") == "card")).select("kind", "label", "_h", F.concat(F.lit(" "), F.left(digits(F.col("m")), F.lit(3))).alias("right"), F.explode(F.array(F.lit(" "), F.concat(F.lit("x "), F.right(digits(F.col("m")), F.lit(13)), F.lit(" ")))).alias("left"), "m")
    parts = back.unionByName(front).where(F.length(digits(F.col("m"))).between(7, MOST_DIGITS) & ~is_card(F.col("m")))
    glued = forms.where(whole).select("kind", F.lit(0).alias("label"), "_h", F.explode(F.array(F.lit("d"), F.lit(" x"))).alias("right"), F.concat("left", F.lit("a")).alias("left"), "m")
    forms = cut(spark, forms.unionByName(parts).unionByName(beside).unionByName(glued).drop("kind"))
    at = F.length("left")
    made = forms.select("label", features(F.concat("left", "m", "right"), F.struct(at.alias("s"), (at + F.length("m")).alias("e"), "m")).alias("f"), "_h")
    return made.select("label", "f.*", "_h").orderBy(F.xxhash64("_h", "label", *FEATURES), "label").limit(sample)


def train(spark: SparkSession, rows: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Selector | None:
    """rows: base and text of documents with validated spans. None where the sample lacks one of the two labels.

    A third of the examples calibrates: the threshold is the lowest score, in steps of 0.02 from 0.5, from which on the
    share of label 1 reaches the precision; beyond 0.98 nothing is added.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    some = cut(spark, examples(spark, rows, sample).coalesce(1))
    fit, held = some.where(F.pmod("_h", F.lit(3)) != 0), some.where(F.pmod("_h", F.lit(3)) == 0)
    if fit.select("label").distinct().count() < 2 or held.isEmpty():
        return None
    to_vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    gbt = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1)
    selector = Selector(gbt.fit(to_vector.transform(fit)), 2.0)
    scored = held.select("label", F.floor(selector.score(F.struct(*FEATURES)) * 50).cast("int").alias("bin"))
    bins = {r.bin: (r.n, r.p) for r in scored.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}  # 51 rows at most
    for low in range(25, 50):
        n, p = (sum(v[i] for b, v in bins.items() if b >= low) for i in (0, 1))
        if n and p >= precision * n:
            selector.threshold = low / 50
            break
    return selector


def find(spark: SparkSession, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, _base and _spans (array<struct<kind, s, e, m>>) for each row of docs.

    Whole texts of any length are searched; a null or empty text has no spans. Base spans always stay; added ones (kind
    number or address) overlap no base span and not each other. Repeated rows get equal spans; an empty table gives
    none. Columns kept may have any names but _t, _base and _spans; others are not read.
    """
    t = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.withColumn("_base", base_spans(F.col("_t")))
    selector = train(spark, t.where(F.size("_base") > 0))
    if selector is None:
        return t.withColumn("_spans", F.col("_base"))
    return t.withColumn("_spans", F.concat("_base", added(F.col("_t"), F.col("_base"), selector)))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by [PII], overlapping ones by one; null texts stay null. Text outside of
    spans stays as it is, even where it equals a span."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_own"))
    f = find(spark, row, ["_row"], "_own")
    ordered = F.array_sort(F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    gap = lambda a, x: F.concat(a["out"], F.array(F.substr("_t", a["at"] + 1, x["s"] - a["at"]), F.lit("[PII]")))
    parts = F.aggregate(ordered, start, lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] < a["at"], a["out"]).otherwise(gap(a, x)).alias("out")), lambda a: F.concat(a["out"], F.array(F.substr("_t", a["at"] + 1, F.length("_t")))))
    text = F.when(F.col("_row")[text_col].isNull(), F.lit(None)).otherwise(F.array_join(parts, ""))
    return f.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = find(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return f.select("doc_id", *map(n, KINDS), F.sha2(shown(F.col("_base")), 256).alias("base_sha256"), shown(F.col("_spans")).alias("spans"))

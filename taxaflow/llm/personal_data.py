"""Personal data by candidate spans and boosted trees.

Generators propose spans with high recall: the four fixed patterns, and wider ones for spelled-out mail
addresses, colon-separated network addresses and numbers in national forms. A number may be proposed
as several kinds, so proposals overlap. What a pattern's own check decides (a checksum, the range of a part,
the digits of an international number) labels its proposals; boosted trees learn from the labelled ones how
true and false spans of a kind look, by format and context without those checks. On labelled
proposals that did not train, the least score at which a kind is right often enough becomes its threshold.
Proposals without a label are selected from there on. Spans that pass the fixed checks always stay, spans
that fail one are never selected. Columns, SQL functions and Spark's own tree learner only.

A proposal's place is the length of all that stands before it: the pieces between the matches of a
pattern, and the matches, are summed in order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import whole_text
from taxaflow.session import settle

# The kinds searched for, in the order they are listed, and those the trees select.
BASE = ["email", "ip", "card", "phone"]
SELECTED = [f"{kind}_like" for kind in BASE]

TRAIN_ROWS = 20_000  # distinct feature rows that the trees are fitted on, by kind and label; see ``sample``
ROUNDS, DEPTH = 12, 3
PRECISION = 0.95  # least share of true spans among a kind's selected ones
LEAST_LABELLED = 20  # labelled spans not used in training that a threshold needs
GRID = 200  # cells of the scores
BEFORE, AFTER = 24, 4  # code points of context


class Generator(NamedTuple):
    """A pattern, the kinds its spans may be, a cheap test that texts with a match pass, and whether it is a fixed one."""

    kinds: list[str]
    pattern: str
    screen: str
    fixed: bool


# The first four are the fixed patterns in possessive form: the same spans, found in one step each, so that
# a long run of letters or digits costs no more than its length.
GENERATORS = [
    Generator(["email"], r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", True),
    Generator(["ip"], r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    Generator(["card"], r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+", "[0-9][ -]?[0-9][ -]?[0-9]", True),
    Generator(["phone"], r"\+[0-9](?:[ ().-]*+[0-9]++)++", r"\+[0-9]", True),
    Generator(
        ["email"],
        r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?[\[({] ?at ?[\])}] ?[A-Z0-9-]{1,63}+(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Z0-9-]{1,63}+){1,6}+",
        r"(?i)[\[({] ?at ?[\])}]",
        False,
    ),
    Generator(["ip"], r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+::?+){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])", "[0-9A-Fa-f]:[0-9A-Fa-f:]", False),
    Generator(
        ["card", "phone"],
        r"(?<![0-9A-Za-z+])\(?[0-9](?:(?:[ ./-]|\) ?| \()?+[0-9]){6,18}+(?![0-9A-Za-z])",
        r"[0-9](?:(?:[ ./-]|\) ?| \()?[0-9]){6}",
        False,
    ),
]

OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CUES = {
    "cue_phone": r"(?i)(phone|tel|call|mobile|fax|sms)",
    "cue_mail": r"(?i)(mail|contact|write)",
    "cue_card": r"(?i)(card|visa|master|amex|credit|pay)",
    "cue_host": r"(?i)(\bip\b|host|server|addr|ping|login)",
    "cue_number": r"(?i)(version|\bv|build|release|\bid\b|order|\bref|isbn|serial|\bno\b|#)",
}


def passes_luhn(digits: Column) -> Column:
    """Whether the checksum of at most 19 digits holds."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    values = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda done, v: done + v) % 10 == 0


def proposals(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Every match of every generator: generator, span (start, stop), value, and the text before and after it."""

    def matches(g: int, generator: Generator) -> Column:
        pieces = F.split("text", generator.pattern, -1)
        values = F.regexp_extract_all("text", F.lit(generator.pattern), F.lit(0))
        zipped = F.arrays_zip(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), values)

        def row(z: Column, i: Column) -> Column:
            return F.struct(
                F.lit(g).alias("generator"),
                i.alias("i"),
                F.length(z["0"]).cast("long").alias("gap"),
                z["2"].alias("value"),
                F.right(z["0"], F.lit(BEFORE)).alias("before"),
                F.left(F.coalesce(z["1"], F.lit("")), F.lit(AFTER)).alias("after"),
            )

        made = F.filter(F.transform(zipped, row), lambda m: m["value"].isNotNull())
        return F.when(F.col("text").rlike(generator.screen), made)

    found = F.flatten(F.array_compact(F.array(*(matches(g, generator) for g, generator in enumerate(GENERATORS)))))
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", *keys, F.explode(found).alias("m")).select("row", *keys, "m.*")
    stop = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "generator").orderBy("i"))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("value"))
    kinds = F.element_at(F.array(*(F.array(*(F.lit(k) for k in g.kinds)) for g in GENERATORS)), F.col("generator") + 1)
    fixed = F.element_at(F.array(*(F.lit(g.fixed) for g in GENERATORS)), F.col("generator") + 1)
    return rows.select(*keys, "start", "stop", "value", "before", "after", fixed.alias("fixed"), F.explode(kinds).alias("kind"))


def judged(rows: DataFrame) -> DataFrame:
    """Proposals with ``base``, whether a fixed pattern's span passes its check, and a ``label`` where a check decides.

    Wide spans of a kind's fixed form are left to the fixed generator.
    """
    value, fixed = F.col("value"), F.col("fixed")
    rows = rows.withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    n = F.length("digits")
    luhn = F.when(n.between(12, 19), passes_luhn(F.col("digits"))).otherwise(F.lit(False))
    quad = value.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")
    issued = F.col("digits").rlike("^[3-6][0-9]{12,18}$")
    date = value.rlike(r"^((19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](19|20)[0-9]{2})$")
    mac = value.rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$") | value.rlike("^[0-9:]+$")
    unknown = F.lit(None).cast("boolean")
    label = (
        F.when((F.col("kind") == "email") & fixed, value.rlike(r"\.[A-Za-z]{2,}$"))
        .when((F.col("kind") == "ip") & fixed, quad)
        .when(F.col("kind") == "ip", F.when(mac, False).when(value.rlike("^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), True))
        .when(F.col("kind") == "card", F.when(~luhn, False).when(issued, True))
        .when((F.col("kind") == "phone") & fixed, n.between(9, 15))
        .when(F.col("kind") == "phone", F.when(quad | date | (luhn & issued) | (n > 15), False))
        .otherwise(unknown)
    )
    base = fixed & (
        F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", quad).when(F.col("kind") == "card", luhn).otherwise(n.between(9, 15))
    )
    return rows.withColumn("base", base).withColumn("label", label)


def featured(rows: DataFrame) -> DataFrame:
    """Proposals with their format and context as numbers; nothing that a check reads is one of them.

    A number is described without its country code and an address with its signs, so that the forms
    that a check decides teach the others.
    """
    signs = F.regexp_replace(F.regexp_replace("value", r"(?i) ?[\[({] ?at ?[\])}] ?", "@"), r"(?i) ?[\[({] ?dot ?[\])}] ?", ".")
    bare = F.when(F.col("kind") == "email", signs).otherwise(F.regexp_replace("value", r"^\+([0-9]{1,3}[ .-]+)?", ""))
    groups = F.filter(F.split(bare, "[^0-9]+"), lambda g: g != "")
    longest = F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))

    def number_of(pattern: str) -> Column:
        return F.length(bare) - F.length(F.regexp_replace(bare, pattern, ""))

    last, first = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    named = {
        **{f"is_{kind}": F.col("kind") == kind for kind in BASE},
        "length": F.length(bare),
        "n_digits": number_of("[0-9]"),
        "n_letters": number_of("[A-Za-z]"),
        "n_groups": F.size(groups),
        "longest_group": longest,
        "first_group": F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))),
        "last_group": F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))),
        "n_blanks": number_of(" "),
        "n_dots": number_of(r"\."),
        "n_dashes": number_of("-"),
        "n_brackets": number_of(r"[()\[\]{}]"),
        "n_colons": number_of(":"),
        "n_slashes": number_of("/"),
        "different_signs": F.size(F.array_distinct(F.split(bare, ""))),
        "opens": F.length("before") == 0,
        "blank_before": last.rlike(r"\s"),
        "word_before": last.rlike(r"[\p{L}\p{N}_]"),
        "ends": F.length("after") == 0,
        "blank_after": first.rlike(r"\s"),
        "word_after": first.rlike(r"[\p{L}\p{N}_]"),
        **{name: F.col("before").rlike(pattern) for name, pattern in CUES.items()},
    }
    capped = {name: F.least(column.cast("int"), F.lit(99)) for name, column in named.items()}
    return rows.withColumns(capped)


FEATURES = [
    *(f"is_{kind}" for kind in BASE), "length", "n_digits", "n_letters", "n_groups", "longest_group", "first_group", "last_group",
    "n_blanks", "n_dots", "n_dashes", "n_brackets", "n_colons", "n_slashes", "different_signs",
    "opens", "blank_before", "word_before", "ends", "blank_after", "word_after", *CUES,
]


def held_out() -> Column:
    """A quarter of the proposals, by value and context, so that copies stay together."""
    return F.pmod(F.xxhash64("value", "before"), F.lit(4)) == 0


def sample(rows: DataFrame) -> DataFrame:
    """Training rows: the different labelled feature rows, each with how many different proposals it stands for.

    Above ``TRAIN_ROWS`` of them, those of small hashes, so that about that many are left.
    """
    different = rows.where(F.col("label").isNotNull() & ~held_out()).dropDuplicates(["kind", "label", "value", "before"])
    collapsed = settle(different.groupBy(*FEATURES, F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    n = collapsed.count()
    if n <= TRAIN_ROWS:
        return collapsed
    return collapsed.where(F.pmod(F.xxhash64(*FEATURES, "label"), F.lit(1 << 20)) < (TRAIN_ROWS << 20) // n)


def fit(rows: DataFrame) -> GBTClassificationModel | None:
    """Trees over labelled proposals; None where they are all of one label."""
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample(rows).coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    if train.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="weight", minInstancesPerNode=2)
    return trees.fit(train)


def thresholds(rows: DataFrame) -> dict[str, float]:
    """Per kind the least score from which on enough of the labelled proposals held out are right."""
    checked = rows.where(F.col("label").isNotNull() & held_out()).dropDuplicates(["kind", "value", "before"])
    cells = checked.groupBy("kind", F.floor(F.col("score") * GRID).alias("cell"))
    counts = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("int")).alias("right")).collect()  # kinds x GRID rows at most
    least = {}
    for kind in BASE:
        n = right = 0
        for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["cell"]):
            n, right = n + r["n"], right + r["right"]
            if n >= LEAST_LABELLED and right >= PRECISION * n:
                least[kind] = r["cell"] / GRID
    return least


def selected(rows: DataFrame, model: GBTClassificationModel | None, keys: list[str]) -> DataFrame:
    """Spans that count: those of the fixed checks, and of the others the proposals over their kind's threshold.

    A selected span that overlaps a fixed one is left out; of equal spans the likelier kind stays.
    """
    base = rows.where("base").select(*keys, "start", "stop", "kind", F.lit(1.0).alias("score"), "base")
    if model is None:
        return base
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    scored = scored.select(*keys, "start", "stop", "kind", "value", "before", "label", "base", vector_to_array("probability")[1].alias("score"))
    least = thresholds(scored)
    if not least:
        return base
    bar = F.element_at(F.create_map(*(F.lit(x) for item in least.items() for x in item)), F.col("kind"))
    over = scored.where(~F.col("base") & F.coalesce("label", F.lit(True)) & (F.col("score") >= bar))
    likelier = F.row_number().over(Window.partitionBy(*keys, "start", "stop").orderBy(F.desc("score"), "kind"))
    over = over.withColumn("rank", likelier).where("rank = 1").select(*keys, "start", "stop", "kind", "score", "base")
    reading = Window.partitionBy(*keys).orderBy("start")
    reached = F.max(F.when(F.col("base"), F.col("stop"))).over(reading.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(reading.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = base.unionByName(over).withColumn("reached", reached).withColumn("ahead", ahead)
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("stop") <= F.coalesce("ahead", F.col("stop")))
    return both.where(F.col("base") | apart).select(*keys, "start", "stop", F.when(F.col("base"), F.col("kind")).otherwise(F.concat("kind", F.lit("_like"))).alias("kind"), "score")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its ``doc_id``, ``text_hash`` and ``found``: spans (kind, start, end, score) by start, then kind as listed.

    Spans are code points, end exclusive; kinds are ``BASE`` for the fixed patterns and ``SELECTED`` for
    what the trees add, whose score is their probability. A null or empty text has none. Rows that
    repeat an id and text get the same spans each, rows of other texts under the same id their own.
    Without labelled proposals of both outcomes nothing is added to the fixed spans. Other columns of
    ``docs`` are left out.
    """
    keys = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", whole_text("text").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = settle(featured(judged(proposals(texts, keys).distinct())))
    order = F.element_at(F.create_map(*(F.lit(x) for i, kind in enumerate(BASE + SELECTED) for x in (kind, i))), F.col("kind"))
    spans = selected(rows, fit(rows), keys).withColumn("at", order)
    listed = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "at", "kind", "stop", "score"))).alias("listed"))
    found = F.transform("listed", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("end"), s["score"].alias("score")))
    listed = listed.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), found.alias("found"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    joined = texts.select(*keys).join(listed, same, "left")
    return joined.select(*keys, F.coalesce("found", F.array().cast(listed.schema["found"].dataType)).alias("found"))

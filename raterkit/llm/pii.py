"""Personal data: proposed spans, judged by boosted trees.

Base rules find e-mail, IP, card and phone spans; they always stay. Looser generators
propose overlapping spans, none of which begins or ends inside a longer token. Gradient
boosted trees of each kind learn from format and context which proposals are personal data
that the base rules miss. Their positives are confirmed spans rewritten into their loose
forms where they stand, their negatives the corpus's proposals without a mark in their form,
whatever stands beside them, and both are joined by a small labelled sample in which cues stand beside either. On
sentences and rows kept apart, a threshold per kind is calibrated to a precision, and
proposals above it are added unless they overlap a base span of another kind. The trees are
applied as column expressions, so nothing is exploded, shuffled or run in Python.

Trees and thresholds come from every proposal of the table. Rows of the same features are
counted first and learned from as one row of their weight, which gives the same sums.

Personal data of the corpus in a loose form without a mark counts as a negative there, as
nothing tells it apart; it can only raise a threshold. Kinds that overlap among the added spans all stay.

The loose pattern of IP addresses has no form beyond the base rule's, so none is added.

Patterns are possessive forms of the rules: they match the same spans, but no long run of
letters or digits makes them backtrack or recurse.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raterkit.llm.common import ROW, packed, unpacked
from raterkit.llm.piisample import CALIBRATE, FIT, labelled
from raterkit.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: A start that no earlier start could have taken in, or the place where the last match ended.
_FRESH = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
BASE = {
    "email": _FRESH + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[\x20.-]?[0-9])++(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+|\()?[0-9](?:[\x20()./-]{0,2}+[0-9])++(?![A-Za-z0-9])",
}
_SIGN = {"email": "instr({t}, '@') > 0", "ip": "{t} RLIKE '[0-9][.][0-9]'", "card": "{t} RLIKE '[0-9]'", "phone": "instr({t}, '+') > 0"}
_LOOSE_SIGN = _SIGN | {"email": "instr({t}, '@') > 0 OR {t} RLIKE '[(\\\\[]at[)\\\\]]'", "phone": "{t} RLIKE '[0-9]'"}
_PART = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters before a proposal that count as its context.
CONTEXT = 24
_CUES = {"email": "mail|contact|write|reply", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobil"}

#: Form that makes a proposal of the corpus likely enough to be personal data that it is no
#: negative. What stands beside it plays no part.
_MARKS = {"email": r"[(\[]dot[)\]]", "ip": "^$", "card": "^$", "phone": r"^[+(]"}
#: What the rows of a table weigh together at most, the same for each kind and label, so that
#: the labelled sample, which comes on top, keeps its say beside a table of any size.
CORPUS_WEIGHT = 20_000
#: Every third row calibrates.
CALIBRATION_SHARE = 1 / 3
#: Distinct rows that one task fits.
FIT_ROWS = 50_000
PRECISION = 0.98
LEAST_ROWS = 50
TREES, DEPTH = 12, 4
_SPAN = "struct<kind:int,start:int,end:int>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        value = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = value * 2 - F.when(value > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """The base rule's check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(\.{_PART}){{3}}$")
    n = F.length(digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(digits(match))).otherwise(F.lit(False))


def _proposed(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    return {"card": n.between(12, 24), "phone": n.between(7, 15)}.get(kind, F.lit(True))


def _found(text: Column, pattern: str, sign: str, name: str) -> list[Column]:
    """Matches, and the pieces of text between them."""
    has = F.expr(sign.format(t="t"))
    none = F.array().cast("array<string>")
    matches = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return [matches.alias(f"m_{name}"), F.when(has, F.split(text, pattern, -1)).otherwise(none).alias(f"g_{name}")]


#: Matches that one inner walk appends; a text with many matches is walked in runs of them.
_RUN = 256


def _spans(name: str, kind: int, keep, context: bool) -> Column:
    """Spans of the kept matches; positions follow from the lengths of matches and pieces.

    Appending copies an array, so spans are gathered in short runs and the runs in an
    outer array: the work stays nearly linear in the matches of a text.
    """
    match, piece = f"m_{name}", f"g_{name}"
    kind_of = "struct<kind:int,start:int,end:int,match:string,before:string,after:string>" if context else _SPAN
    empty = F.array().cast(f"array<{kind_of}>")
    runs = F.array().cast(f"array<struct<pos:int,out:array<{kind_of}>>>")
    size = F.size(match)

    def step(acc: Column, k: Column) -> Column:
        m, g = F.get(F.col(match), k), F.get(F.col(piece), k)
        start = acc["pos"] + F.length(g)
        span = [F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end")]
        if context:
            span += [m.alias("match"), F.lower(F.right(g, F.lit(CONTEXT))).alias("before"), F.left(F.get(F.col(piece), k + 1), F.lit(1)).alias("after")]
        out = F.when(keep(m), F.array_append(acc["out"], F.struct(*span))).otherwise(acc["out"])
        return F.struct((start + F.length(m)).alias("pos"), out.alias("out"))

    def run(done: Column, first: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["pos"], F.lit(0))
        some = F.sequence(first, F.least(first + (_RUN - 1), size - 1))
        return F.array_append(done, F.aggregate(some, F.struct(before.alias("pos"), empty.alias("out")), step))

    walk = F.aggregate(F.sequence(F.lit(0), size - 1, F.lit(_RUN)), runs, run)
    return F.when(size > 0, F.flatten(F.transform(walk, lambda r: r["out"]))).otherwise(empty)


#: Endings of e-mail addresses that are common.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "nl", "ch", "at")

FEATURES = [
    *(f"CAST(x.kind = {i} AS DOUBLE)" for i in range(len(KINDS))),
    "CAST(length(x.match) AS DOUBLE)",
    "CAST(length(regexp_replace(x.match, '[^0-9]+', '')) AS DOUBLE)",
    "CAST(length(regexp_replace(x.match, '[^ .()-]+', '')) AS DOUBLE)",
    "CAST(length(regexp_replace(x.match, '[^.]+', '')) AS DOUBLE)",
    "CAST(length(regexp_replace(x.match, '[^A-Za-z]+', '')) AS DOUBLE)",
    "CAST(startswith(x.match, '+') AS DOUBLE)",
    "CAST(length(regexp_extract(x.match, '^[^0-9]*([0-9]*)', 1)) AS DOUBLE)",
    "CAST(length(regexp_extract(x.match, '([A-Za-z0-9]*)$', 1)) AS DOUBLE)",
    "CAST(instr(x.match, '@') > 0 AS DOUBLE)",
    "CAST(x.before RLIKE '[A-Za-z0-9]$' AS DOUBLE)",
    "CAST(x.after RLIKE '[A-Za-z0-9]' AS DOUBLE)",
    "CAST(x.before RLIKE '[+.,#$-]$' AS DOUBLE)",
    *(f"CAST(x.before RLIKE '{cue}' AS DOUBLE)" for cue in _CUES.values()),
    "CAST(x.match RLIKE '[(\\\\[]dot[)\\\\]]' AS DOUBLE)",
    f"CAST(lower(x.match) RLIKE '(?:[.]|[)\\\\]] ?)(?:{'|'.join(TOP_DOMAINS)})$' AS DOUBLE)",
    "CAST(length(regexp_extract(x.match, '([0-9]*)[^0-9]*$', 1)) AS DOUBLE)",
    "CAST(x.luhn AS DOUBLE)",
]


def _confirmed(x: Column) -> Column:
    """Whether the base rule of its kind finds a valid span in the proposal itself."""
    found = F.lit(False)
    for i, kind in enumerate(KINDS):
        hits = F.regexp_extract_all(x["match"], F.lit(BASE[kind]), F.lit(0))
        found = F.when(x["kind"] == i, F.exists(hits, partial(is_valid, kind))).otherwise(found)
    return found


def _loosened(x: Column) -> Column:
    """A confirmed match in a loose form of its kind that the base rule does not find; one of
    several, by the match's hash. Null where there is none."""
    m = x["match"]
    pick = lambda *forms: F.get(F.array(*forms), F.pmod(F.xxhash64(m), F.lit(len(forms))).cast("int"))
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    hidden = lambda at, dot: F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
    email = pick(hidden(" (at) ", " (dot) "), hidden("[at]", "[dot]"), hidden(" [at] ", " [dot] "), hidden("(at)", "(dot)"), hidden(" (at) ", "."))
    sep = r"[\x20().-]"
    bare = F.regexp_replace(m, r"^\+", "")
    local = F.regexp_replace(bare, rf"^[0-9]{{1,3}}(?:[\x20.-]+(?=[0-9(])|(?=\())", "")
    area = F.regexp_replace(bare, rf"^[0-9]{{1,3}}{sep}+0?([0-9]+){sep}*", r"(0$1) ")
    phone = pick(bare, local, area, F.regexp_replace(F.ltrim(local, F.lit("(")), rf"{sep}+", "-"))
    card = F.regexp_replace(digits(m), "([0-9]{4})(?=[0-9])", r"$1.")
    return F.when(x["kind"] == 0, email).when(x["kind"] == 2, card).when((x["kind"] == 3) & _proposed("phone", phone), phone)


def _unmarked(x: Column) -> Column:
    """Whether a proposal has no mark of its kind; for cards, that is the check digit."""
    free = F.lit(False)
    for i, kind in enumerate(KINDS):
        free = F.when(x["kind"] == i, ~x["match"].rlike(_MARKS[kind]) & ~x["luhn"]).otherwise(free)
    return free


def propose(docs: DataFrame, text: Column, carry: list[Column]) -> DataFrame:
    """``carry``, base (confirmed spans) and seen (proposals: span, features, confirmed, other:
    a negative of the trees, loose: the features of a confirmed span's loose form, h: a hash
    of match, context and start)."""
    kept = [c for c in docs.select(*carry).columns]
    rows = docs.select(*carry, F.coalesce(text, F.lit("")).alias("t"))
    found = [c for k in KINDS for c in (*_found(F.col("t"), BASE[k], _SIGN[k], f"b_{k}"), *_found(F.col("t"), LOOSE[k], _LOOSE_SIGN[k], f"l_{k}"))]
    matched = rows.select(*kept, *found)
    spanned = matched.select(
        *kept,
        F.concat(*(_spans(f"b_{k}", i, lambda m, k=k: is_valid(k, m), False) for i, k in enumerate(KINDS))).alias("base"),
        F.concat(*(_spans(f"l_{k}", i, lambda m, k=k: _proposed(k, m), True) for i, k in enumerate(KINDS))).alias("loose"),
    )
    known = ("kind", "start", "end", "match", "before", "after")
    checked = lambda x: F.struct(*(x[n].alias(n) for n in known), _confirmed(x).alias("confirmed"), ((x["kind"] == 2) & is_valid("card", x["match"])).alias("luhn"))
    fields = (*known, "confirmed", "luhn")
    judged = lambda x: F.struct(
        *(x[n].alias(n) for n in fields), (~x["confirmed"] & _unmarked(x)).alias("other"), F.when(x["confirmed"], _loosened(x)).alias("alt")
    )
    features = ", ".join(FEATURES)
    loose = features.replace("x.match", "x.alt")
    seen = (
        f"transform(judged, x -> struct(x.kind AS kind, x.start AS start, x.end AS end, array({features}) AS f, x.confirmed AS confirmed, "
        f"x.other AS other, CASE WHEN x.alt IS NOT NULL THEN array({loose}) END AS loose, "
        "xxhash64(x.match, x.before, x.start) AS h))"
    )
    rows = spanned.select(*kept, "base", F.transform("loose", checked).alias("checked"))
    return rows.select(*kept, "base", F.transform("checked", judged).alias("judged")).select(*kept, "base", F.expr(seen).alias("seen"))


@dataclass
class Detector:
    """Fitted trees as nested (feature, threshold, left, right) or values, and thresholds."""

    trees: list[tuple[float, object]]
    thresholds: dict[int, float]

    def probability(self, features: Column) -> Column:
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * _tree(tree, features)
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, proposal: Column) -> Column:
        limit = F.lit(2.0)
        for kind, value in self.thresholds.items():
            limit = F.when(proposal["kind"] == kind, value).otherwise(limit)
        return self.probability(proposal["f"]) >= limit


def _tree(node, features: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    index, threshold, left, right = node
    return F.when(features[index] <= threshold, _tree(left, features)).otherwise(_tree(right, features))


def _read_tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _read_tree(node.leftChild()), _read_tree(node.rightChild())


def labelled_proposals(spark: SparkSession, part: str) -> DataFrame:
    """truth (a kind's number, or -1) and seen proposals of a part of the labelled sample."""
    texts = [(KINDS.index(kind) if kind else -1, text) for kind, text in labelled(part)]
    docs = spark.createDataFrame(texts, "truth int, text string").coalesce(1)
    return propose(docs, F.col("text"), [F.col("truth")])


def _labelled_rows(spark: SparkSession, part: str, held: bool) -> DataFrame:
    """kind, f, label, judges, held, n, weight of the proposals in the labelled sample."""
    rows = labelled_proposals(spark, part).select("truth", F.explode("seen").alias("s")).filter(~F.col("s.confirmed"))
    label = (F.col("s.kind") == F.col("truth")).cast("double")
    rows = rows.select("s.kind", "s.f", label.alias("label"), F.lit(True).alias("judges"), F.lit(held).alias("held"))
    return rows.withColumns({"n": F.lit(1).cast("bigint"), "weight": F.lit(1.0)})


def _corpus_rows(proposals: DataFrame) -> DataFrame:
    """kind, f, label, judges, held, and n: how many rows of the whole table are alike in them.

    Positives are confirmed proposals and their loose forms, negatives unmarked proposals.
    ``judges``: a row to calibrate with. A span and its loose form are on the same side of the
    split (``held``), which follows from their hash, whatever the partitioning.
    """
    row = lambda f, label, judges: F.struct(F.col(f"s.{f}").alias("f"), F.lit(label).alias("label"), F.lit(judges).alias("judges"))
    spans = F.explode(F.transform("seen", lambda s: F.struct(s.alias("s"), _covered(s, F.col("base")).alias("covered")))).alias("x")
    rows = proposals.select(spans).select("x.s", "x.covered")
    of_span = F.when(F.col("s.confirmed"), F.array(row("f", 1.0, False), row("loose", 1.0, True))).otherwise(F.array(row("f", 0.0, True)))
    # what another kind's base rule has confirmed is never added, so it teaches nothing
    rows = rows.filter("s.confirmed OR (s.other AND NOT covered)").select("s.kind", "s.h", F.explode(of_span).alias("r"))
    held = F.pmod(F.xxhash64("h"), F.lit(round(1 / CALIBRATION_SHARE))) == 0
    flat = rows.select("kind", "r.f", "r.label", "r.judges", held.alias("held")).filter("f IS NOT NULL")
    return flat.groupBy("kind", "f", "label", "judges", "held").agg(F.count(F.lit(1)).alias("n"))


def _weighted(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``weight``: ``n``, scaled down where the rows of a kind and label are more than
    their part of ``most``."""
    share = most // (2 * len(KINDS))
    weight = F.col("n").cast("double")
    for r in rows.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect():
        if r["n"] > share:
            weight = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), F.col("n") * F.lit(share / r["n"])).otherwise(weight)
    return rows.withColumn("weight", weight)


def _covered(span: Column, base: Column) -> Column:
    """Whether a base span of another kind overlaps."""
    return F.exists(base, lambda b: (b["kind"] != span["kind"]) & (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows in the same order on every run, in ``tasks`` partitions at most. The trees take some
    hundred stages, each with a task for every partition, so none is there without need, also
    where the session deals keys out to more."""
    return rows.repartition(tasks, "f").coalesce(tasks).sortWithinPartitions("kind", "f", "label", "judges", "held")


def _trees_of(kind: int, train: DataFrame, size: int) -> list[tuple[float, object]]:
    """Weighted trees fitted to the ``size`` rows of one kind; they add nothing to the margin
    of others. With the root of the rows as bins, Spark takes splits from all rows."""
    rows = train.select(array_to_vector("f").alias("features"), "label", "weight")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=max(32, isqrt(size) + 1), weightCol="weight", seed=1, cacheNodeIds=False)
    model: GBTClassificationModel = trees.fit(rows)
    return [(w, (kind, 0.5, 0.0, _read_tree(t._call_java("rootNode")))) for w, t in zip(model.treeWeights, model.trees)]


def fit(proposals: DataFrame, corpus_weight: int = CORPUS_WEIGHT, precision: float = PRECISION) -> Detector:
    """Trees and thresholds from all rows of the (seen) proposals and the labelled sample.

    Rows that are alike are one row with their number and weight. No labelled sentence is on
    both sides of the split. The driver holds one row for each distinct score of the
    calibration rows; how many there are follows from the size of the trees.
    """
    spark = proposals.sparkSession
    sentences = _labelled_rows(spark, FIT, False).unionByName(_labelled_rows(spark, CALIBRATE, True))
    corpus = materialize(_corpus_rows(proposals), "pii-rows")
    rows = _dealt(_weighted(corpus, corpus_weight).unionByName(sentences), 1 + corpus.count() // FIT_ROWS).cache()
    try:
        held = F.col("held")
        train = rows.filter(~held)
        sizes = {(r["kind"], r["label"]): (r["size"], r["judges"]) for r in train.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("size"), F.max("judges").alias("judges")).collect()}
        trees = []
        for kind in range(len(KINDS)):
            of_kind = [sizes.get((kind, label), (0, False)) for label in (0.0, 1.0)]
            if all(judges for _, judges in of_kind):
                trees += _trees_of(kind, train.filter(F.col("kind") == kind), sum(size for size, _ in of_kind))
        detector = Detector(trees, {})
        scored = rows.filter(held & F.col("judges")).withColumn("p", detector.probability(F.col("f")))
        good = F.col("weight") * F.col("label")
        scored = scored.groupBy("kind", "p").agg(F.sum(good).alias("good"), F.sum("weight").alias("weight"), F.sum("n").alias("n")).collect()
    finally:
        rows.unpersist()
    for kind in range(len(KINDS)):
        ranked = sorted(((r["p"], r["good"], r["weight"], r["n"]) for r in scored if r["kind"] == kind), reverse=True)
        limit = _calibrated(ranked, precision)
        if limit is not None:
            detector.thresholds[kind] = limit
    return detector


def _calibrated(ranked: list[tuple], precision: float) -> float | None:
    """The middle between the smallest score such that enough rows lie at or above it and so
    much of their weight is positive, and the next smaller one.

    ``ranked`` holds (score, positive weight), and (weight, rows) where these are not 1.
    """
    limit, n, good, weight = None, 0, 0.0, 0.0
    for i, (p, here, *more) in enumerate(ranked, 1):
        of_weight, rows = more or (1.0, 1)
        n, good, weight = n + rows, good + here, weight + of_weight
        last_of_score = i == len(ranked) or ranked[i][0] < p
        if last_of_score and n >= LEAST_ROWS and good >= precision * weight:
            limit = (p + ranked[i][0]) / 2 if i < len(ranked) else p
    return limit


def _with_spans(proposals: DataFrame, detector: Detector) -> DataFrame:
    """Adds ``spans``: base and accepted spans, by kind, start and end; no span twice."""
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    added = F.transform(F.filter("seen", lambda s: ~_covered(s, F.col("base")) & detector.accepts(s)), plain)
    every = F.concat("base", added) if detector.thresholds else F.col("base")
    fresh = lambda s, i: (i == 0) | (s != F.get("_every", i - 1))
    return proposals.withColumn("_every", F.sort_array(every)).withColumn("spans", F.filter("_every", fresh)).drop("_every")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def describe(proposals: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of proposed rows.

    Counts and hash are of the base spans; ``spans`` holds all, as kind:start:end in code
    points.
    """
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    rows = _with_spans(proposals, detector)
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_written(F.sort_array("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """``docs`` with every run of overlapping spans replaced by the kind of its first.

    A null text stays null; all other columns are unchanged.
    """
    whole = F.col(f"{ROW}.`{text}`")
    rows = _with_spans(propose(packed(docs), whole, [F.col(ROW)]), detector).select(
        ROW, F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("s")
    )
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        gap = F.substring(whole, acc["pos"] + 1, s["start"] - acc["pos"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.get(names, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate("s", zero, step, lambda a: F.concat(a["out"], F.substring(whole, a["pos"] + 1, F.length(whole))))
    fields = [F.when(whole.isNotNull(), clean).alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return unpacked(rows.select(F.struct(*fields).alias(ROW)), docs)


def proposals_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, seen of every row: null texts are empty, null ids and repeated rows are
    kept, other columns are not read."""
    return propose(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), F.col("text"), [F.col("doc_id")])

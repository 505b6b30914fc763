"""Mixing sources to target weights (soft-membership mixing).

Every distinct text belongs to the domains to some degree: wholly to its own source where that is known, else by the
posteriors of a classifier that is fitted on a bounded sample of labelled texts.  Projected gradient descent fits a
non-negative rate per text, so that the expected tokens of each domain meet its target; a text's rate depends on the
history of the domains' gradients only, so a step is one aggregation and no rates are stored.  Rates become whole
copies by systematic rounding over texts of like length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm.tokens import VOCABULARY, token_sizes
from codeloom.tables import written

#: Labelled texts of one source that the classifier is fitted on (in expectation), and its number of hashed features.
SAMPLE_PER_SOURCE = 2000
FEATURES = 1 << 15
STEPS = 25
CLOSE = 1e-4
#: Independent parts in which the copies of one domain and length class are rounded.
PARTS = 4
#: Part of a domain's expected tokens that its short texts hold; they make up for the rounding of long ones.
SHORT_SHARE = 0.4
MAX_TARGETS = 1000


def normalized(source: Column) -> Column:
    """Sources are compared trimmed and in lower case; blanks are null."""
    s = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def targets_of(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, max_repeats) sorted by source; shares are scaled to a sum of one. Null rows are left out."""
    rows = targets.select(normalized(F.col("source")).alias("s"), "target_share", "max_repeats").where(
        "s is not null and target_share > 0").take(MAX_TARGETS + 1)
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    total = sum(r.target_share for r in rows) or 1.0
    return sorted((r.s, r.target_share / total, max(1, r.max_repeats or 1)) for r in rows)


def _features(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.transform(F.array_distinct(F.filter(words, lambda w: w != "")),
                       lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


def classifier(docs: DataFrame, names: list[str], sample: int = SAMPLE_PER_SOURCE) -> DataFrame:
    """(feature, weights): naive Bayes log-likelihoods per domain of each hashed word, at most FEATURES rows.

    ``docs`` has (doc_id, text, label).  Of each source about ``sample`` texts are taken by a hash of the id.
    """
    known = docs.where(F.col("label").isin(names) & F.col("text").isNotNull())
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    keep = F.lit(False)
    for s in names:
        if sizes.get(s):
            part = int(min(1.0, sample / sizes[s]) * 1_000_000)
            keep = keep | ((F.col("label") == s) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part))
    counted = known.where(keep).select("label", F.explode(_features(F.col("text"))).alias("feature")).groupBy(
        "feature").pivot("label", names).count()
    totals = counted.agg(*[F.coalesce(F.sum(F.col(f"`{s}`")), F.lit(0)).alias(f"t{k}") for k, s in enumerate(names)]).first()
    weights = F.array(*[
        F.log((F.coalesce(F.col(f"`{s}`"), F.lit(0)) + 0.5) / F.lit(float((totals[k] or 0) + 0.5 * FEATURES)))
        for k, s in enumerate(names)])
    return counted.select("feature", weights.alias("weights"))


def posteriors(docs: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, membership): domain posteriors of texts, tempered by the square root of their number of words.

    Texts without known words belong to all domains alike.
    """
    words = docs.select("doc_id", F.explode_outer(_features(F.col("text"))).alias("feature"))
    scored = words.join(F.broadcast(model), "feature", "left").groupBy("doc_id").agg(
        F.count("weights").alias("n"),
        *[F.coalesce(F.sum(F.element_at("weights", k + 1)), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))])
    best = F.greatest(*[F.col(f"s{k}") for k in range(len(names))]) if len(names) > 1 else F.col("s0")
    odds = F.array(*[F.exp((F.col(f"s{k}") - best) / F.sqrt(F.greatest(F.col("n"), F.lit(1)))) for k in range(len(names))])
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return scored.select("doc_id", odds.alias("odds")).select("doc_id", F.transform("odds", lambda x: x / total).alias("membership"))


def members(docs: DataFrame, targets: list[tuple[str, float, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, label, tokens, membership, cap): one row per distinct text that can be mixed in.

    Equal texts count as one, under their least id.  Null and empty texts and ids are left out, as are texts whose
    source is given but has no target.
    """
    names = [s for s, _, _ in targets]
    rows = docs.select("doc_id", normalized(F.col("source")).alias("label"), "text").where(
        "doc_id is not null and text is not null and text <> ''").withColumn("digest", F.md5("text"))
    sized = token_sizes(rows, "doc_id", "text", vocabulary, keep=("label", "digest"))
    distinct = sized.groupBy("digest").agg(F.min(F.struct("doc_id", "label", "tokens")).alias("r")).select("r.*")
    distinct = written(distinct.where(F.col("tokens") > 0), "sizes")
    model = classifier(rows, names)
    unknown = distinct.where("label is null").select("doc_id").join(rows.select("doc_id", "text"), "doc_id")
    guessed = posteriors(unknown, model, names)
    hot = F.array(*[F.when(F.col("label") == s, 1.0).otherwise(0.0) for s in names])
    caps = F.floor(sum((F.element_at("membership", k + 1) * m for k, (_, _, m) in enumerate(targets)), F.lit(1e-9)))
    labelled = distinct.where(F.col("label").isin(names)).select("doc_id", "label", "tokens", hot.alias("membership"))
    rest = distinct.where("label is null").join(guessed, "doc_id").select("doc_id", "label", "tokens", "membership")
    return labelled.unionByName(rest).withColumn("cap", caps.cast("int"))


def _rate(history: list[list[float]]) -> Column:
    """A text's rate after the steps in ``history``: each moves it against its domains' gradients, within 0 and its cap."""
    steps = F.array(*[F.array(*map(F.lit, g)) for g in history]).cast("array<array<double>>")
    dot = lambda g: F.aggregate(F.zip_with("membership", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(0.0), lambda r, g: F.least(
        F.col("cap").cast("double"), F.greatest(F.lit(0.0), r - dot(g))))


def fit_rates(table: DataFrame, targets: list[tuple[str, float, int]]) -> list[list[float]]:
    """The gradient history whose rates bring each domain to its target share of the largest mixture that caps allow.

    Texts with equal membership and cap move alike, so they are one row; labelled texts are one row per source.
    """
    k = len(targets)
    alike = written(table.groupBy("membership", "cap").agg(F.sum("tokens").cast("double").alias("tokens")), "alike")
    part = lambda i, of: F.coalesce(F.sum(of * F.element_at("membership", i + 1)), F.lit(0.0))
    held = alike.agg(*[part(i, F.col("tokens")).alias(f"s{i}") for i in range(k)],
                     *[part(i, F.col("tokens") * F.col("cap")).alias(f"m{i}") for i in range(k)]).first()
    have = [held[f"s{i}"] for i in range(k)]
    whole = min((held[f"m{i}"] / targets[i][1] for i in range(k) if have[i] > 0), default=0.0)
    goal = [whole * share for _, share, _ in targets]
    history: list[list[float]] = []
    for _ in range(STEPS):
        if history:
            now = alike.withColumn("_r", _rate(history)).agg(
                *[part(i, F.col("tokens") * F.col("_r")).alias(f"a{i}") for i in range(k)]).first()
            got = [now[f"a{i}"] for i in range(k)]
        else:
            got = [0.0] * k
        if all(abs(a - g) <= CLOSE * max(g, 1.0) for a, g, h in zip(got, goal, have) if h > 0):
            break
        history.append([(a - g) / h if h > 0 else 0.0 for a, g, h in zip(got, goal, have)])
    return history


def _rounded(rated: DataFrame, parts: int) -> DataFrame:
    """``copies`` for ``rate``: rounded down, and one more where the running sum of the remainders passes a whole number.

    The texts of a domain are taken from long to short by length class, a class in ``parts`` parts.  The running sum
    goes on from part to part; the parts' own sums are few, as they grow with the lengths' logarithm.
    """
    group = ["source", "_class", "_part"]
    rated = rated.withColumns({"_part": F.pmod(F.xxhash64("doc_id"), F.lit(parts)), "_rest": F.col("rate") - F.floor("rate")})
    sums = rated.groupBy(*group).agg(F.sum("_rest").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("source").orderBy(F.desc("_class"), "_part")) - F.col("_sum")
    order = W.partitionBy(*group).orderBy(F.desc("tokens"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    rated = rated.withColumn("_upto", F.sum("_rest").over(order)).join(
        sums.select(*group, before.alias("_start")), group)
    upto = F.lit(0.5) + F.col("_start") + F.col("_upto")
    more = F.floor(upto + 1e-9) - F.floor(upto - F.col("_rest") + 1e-9)
    return rated.withColumn("copies", F.least(F.floor("rate") + more, F.col("cap")).cast("int"))


def mixture(table: DataFrame, targets: list[tuple[str, float, int]], parts: int = PARTS) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): how often each text enters the mixture; ``source`` is its own or likeliest.

    The long texts of each domain are rounded first; what they are over or under is made up by the rates of the short
    ones, so that the error left is one of short texts.
    """
    names = [s for s, _, _ in targets]
    history = fit_rates(table, targets)
    likeliest = F.element_at(F.array(*map(F.lit, names)), F.array_position("membership", F.array_max("membership")).cast("int"))
    rated = table.select("doc_id", F.coalesce("label", likeliest).alias("source"), "tokens", "cap",
                         F.round(_rate(history), 9).alias("rate") if history else F.lit(0.0).alias("rate"),
                         F.floor(F.log2("tokens") * 4).cast("int").alias("_class"))
    # Expected tokens by length class: a few dozen classes for each of the targets.
    expected: dict[str, dict[int, float]] = {}
    for r in rated.groupBy("source", "_class").agg(F.sum(F.col("tokens") * F.col("rate")).alias("t")).collect():
        expected.setdefault(r.source, {})[r["_class"]] = r.t
    cuts, short = {}, {}
    for s, classes in expected.items():
        held, whole = 0.0, sum(classes.values())
        for c in sorted(classes):
            held += classes[c]
            cuts[s], short[s] = c, held
            if held >= SHORT_SHARE * whole:
                break
    case = lambda of: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in of.items()], F.lit(0))
    if not cuts:
        return rated.select("doc_id", "source", "tokens", "rate", F.lit(0).alias("copies"))
    is_short = F.col("_class") <= case(cuts)
    long = _rounded(rated.where(~is_short), parts).groupBy("source").agg(
        F.sum(F.col("tokens") * (F.col("copies") - F.col("rate"))).alias("over"))
    over = {r.source: r.over for r in long.collect()}
    factor = {s: max(0.0, 1.0 - over.get(s, 0.0) / short[s]) if short[s] > 0 else 1.0 for s in cuts}
    evened = rated.withColumn("rate", F.when(is_short, F.least(F.col("cap").cast("double"), F.round(F.col("rate") * case(factor), 9)))
                              .otherwise(F.col("rate")))
    return _rounded(evened, parts).select("doc_id", "source", "tokens", "rate", "copies")


def shares(mixed: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """(source, target_share, reached_share, tokens, texts, copies, most_copies, max_repeats) for every target."""
    spark = mixed.sparkSession
    wanted = spark.createDataFrame([(s, float(x), int(m)) for s, x, m in targets],
                                   "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("texts"),
        F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    joined = wanted.join(got, "source", "left").na.fill(0)
    total = F.sum("tokens").over(W.partitionBy())
    return joined.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("reached_share"),
                         "tokens", "texts", "copies", "most_copies", "max_repeats")

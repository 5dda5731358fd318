"""Clusters of similar reports: tokens, similarity, adaptive threshold, leaders, insights.

Leader clustering is sequential: a report joins the oldest cluster whose first
report is similar enough, or starts one. That equals the first maximal
independent set of the similarity graph in the order of the reports, which rounds
of joins find in parallel. Reports with equal tokens, barrier and rule behave
alike, so the graph is built over these kinds, not over reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.functions import narrative
from hazardlens.functions.spelling import spelled, with_corrections
from hazardlens.lineage import cut
from hazardlens.operators.ordinals import numbered
from hazardlens.schema import UNKNOWN_BARRIER

# Words without meaning of their own, and the token that stands for a group of words.
STOPWORDS = (
    "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "were", "are", "been", "be", "have", "has", "had",
    "this", "that", "it", "they", "we", "he", "she", "i", "you", "during", "while", "before", "after", "then", "into", "onto", "out", "over", "under", "about",
)
CANONICAL = {
    "canon_actor": ("worker", "technician", "operator", "contractor", "personnel", "electrician", "welder", "crew", "team"),
    "canon_action_entry": ("entered", "entering", "entry", "went", "stepped"),
    "canon_action_height": ("climbed", "climbing"),
    "canon_action_service": ("servicing", "serviced"),
    "canon_action_operate": ("operating", "operated"),
    "canon_negation": ("without", "missing", "lacked", "absence", "omitted", "skipped", "failed"),
    "canon_energized": ("energized", "live", "powered", "electrical", "electric", "voltage", "power"),
    "canon_circuit": ("circuit", "breaker", "switchgear"),
    "canon_isolated": ("isolated", "isolation", "deenergized", "de-energized", "disconnected"),
    "canon_loto": ("lockout", "tagout", "loto", "padlock"),
    "canon_confined_space": ("vessel", "tank", "chamber", "sump", "pit", "manhole", "confined", "reactor", "column"),
    "canon_gas_test": ("gas", "atmospheric", "atmosphere", "oxygen", "h2s", "sampling", "monitoring", "test", "testing", "tested", "check", "checked"),
    "canon_permit": ("permit", "ptw", "clearance", "authorization", "approval"),
    "canon_height": ("height", "scaffold", "ladder", "roof", "elevated", "platform"),
    "canon_fall_protection": ("harness", "lanyard", "lifeline", "tied", "guardrail"),
    "canon_lifting": ("crane", "rigging", "hoist", "suspended", "load", "sling"),
    "canon_vehicle": ("forklift", "truck", "vehicle", "excavator", "reversing"),
    "canon_hot_work": ("welding", "torch", "grinding", "brazing", "sparks", "flame"),
    "canon_chemical": ("chemical", "acid", "caustic", "toxic", "spill", "leak"),
    "canon_ppe": ("ppe", "gloves", "goggles", "glasses", "respirator", "helmet", "mask"),
}
#: Weights of tokens, barriers and rule; pairs from which a threshold is estimated, and its bounds.
TOKENS, BARRIER, RULE = 0.5, 0.3, 0.2
PAIRS, LEAST, MOST, ALONE = 150, 0.5, 0.8, 0.65


def tokens(text: Column, fixes: Column | None = None) -> Column:
    """Distinct words of three letters or more that are no stop words, and the canonical tokens of their groups, sorted; fixes are a text's corrections."""
    normal = narrative.normalized(text) if fixes is None else spelled(narrative.normalized(text), fixes)
    words = F.split(F.regexp_replace(normal, r"[^\w\s]", " "), r"\s+")
    words = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    group = F.create_map(*[F.lit(x) for canon, group in CANONICAL.items() for w in group for x in (w, canon)])
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(words, F.transform(words, lambda w: F.try_element_at(group, w))))))


def barriers(c: Column) -> Column:
    """The barrier as a set; none and the unknown one are empty."""
    return F.when(F.coalesce(c, F.lit("")).isin("", UNKNOWN_BARRIER), F.array().cast("array<string>")).otherwise(F.array(c))


def similarity(a: str, b: str) -> Column:
    """Of two structs or aliases with tokens, barriers and rule: weighted overlap, to 4 places."""

    def overlap(name: str, both_empty: float) -> Column:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(x, y)) / union)

    one, two = F.col(f"{a}.rule"), F.col(f"{b}.rule")
    same = F.when((one == two) & (one != ""), F.when(one == "General Safety", 0.5).otherwise(1.0)).otherwise(0.0)
    return F.bround(TOKENS * overlap("tokens", 0.0) + BARRIER * overlap("barriers", 0.5) + RULE * same, 4)


def formed(df: DataFrame, order: list[str], keep: list[str], text: str = "description") -> tuple[DataFrame, DataFrame]:
    """Rows with at (place in the order), form and the columns `keep`, and the forms: what reports with equal text, barrier and rule have in common.

    A form is called by the place of its first report; with it go text, barrier_failure, tokens, barriers and rule, where misspelled
    words count as what they stand for. Reports carry neither text nor tokens from here on, so that later steps read a few numbers of each.
    """
    rows = numbered(df.select(*dict.fromkeys([*order, *keep, text, "barrier_failure", "category"])), order, "at")
    whole = F.coalesce(F.col(text), F.lit(""))
    forms = cut(rows.groupBy(whole.alias("_text"), F.col("barrier_failure").alias("_barrier"), F.col("category").alias("_rule")).agg(F.min("at").alias("form")))
    match = [whole == F.col("_text"), F.col("barrier_failure").eqNullSafe(F.col("_barrier")), F.col("category").eqNullSafe(F.col("_rule"))]
    rows = cut(rows.join(forms, match).select(*keep, "at", "form"))
    texts = with_corrections(cut(forms.select("_text").distinct()), "_text", narrative.normalized(F.col("_text")))
    texts = cut(texts.select("_text", tokens(F.col("_text"), F.col("fixes")).alias("tokens")))
    names = [F.col("_text").alias("text"), F.col("_barrier").alias("barrier_failure"), barriers(F.col("_barrier")).alias("barriers"), F.col("_rule").alias("rule")]
    return rows, cut(forms.join(texts, "_text").select("form", "tokens", *names))


def prepared(df: DataFrame, order: list[str], text: str = "description") -> DataFrame:
    """df with at (place in the order), tokens, barriers and rule, for `leaders`."""
    rows, forms = formed(df, order, df.columns, text)
    return rows.join(forms.select("form", "tokens", "barriers", "rule"), "form").drop("form")


def sampled_pairs(n: int) -> list[tuple[int, int]]:
    """Every step-th of the pairs i < j of n rows in their order, fewer than 300."""
    whole = n * (n - 1) // 2
    step = max(1, whole // PAIRS)
    out, i, before = [], 0, 0
    for c in range(step, whole + 1, step):
        while c > before + (n - 1 - i):
            before += n - 1 - i
            i += 1
        out.append((i, i + c - before))
    return out


def threshold(rows: DataFrame, forms: DataFrame) -> float:
    """Mean similarity of a fixed sample of pairs plus 0.1, within bounds; only the sampled rows are read out."""
    spark, n = rows.sparkSession, rows.count()
    if n < 2:
        return ALONE
    pairs = spark.createDataFrame(sampled_pairs(n), "i long, j long")
    like = lambda name: forms.select("form", F.struct("tokens", "barriers", "rule").alias(name))
    # Fewer than 300 pairs, whatever the table's size.
    near = cut(rows.select("at", "form").join(F.broadcast(pairs), F.col("at") == F.col("i")).select("form", "j")).join(like("a"), "form").select("j", "a")
    others = cut(rows.select(F.col("at").alias("j"), "form").join(F.broadcast(pairs.select("j").distinct()), "j")).join(like("b"), "form").select("j", "b")
    mean = near.join(others, "j").agg(F.avg(similarity("a", "b"))).first()[0]
    return round(max(LEAST, min(MOST, mean + 0.1 if mean < 0.5 else 0.55)), 3)


def needed(least: float, kind: Column) -> dict[str, tuple[Column, Column]]:
    """For pairs of kinds with equal or other barriers and rules: what the pair has in common, and the overlap of tokens that it needs."""
    barrier, rule = F.array_join(kind["barriers"], "\u0001"), F.coalesce(kind["rule"], F.lit(""))
    by_barrier = BARRIER * F.when(F.size(kind["barriers"]) == 0, 0.5).otherwise(1.0)
    by_rule = RULE * F.when(rule == "", 0.0).when(rule == "General Safety", 0.5).otherwise(1.0)
    # Similarities are rounded to 4 places, so half a unit less may do.
    rest = lambda base: (F.lit(least - 0.00006) - base) / TOKENS
    return {
        "both": (F.concat_ws("\u0002", barrier, rule), rest(by_barrier + by_rule)), "barrier": (barrier, rest(by_barrier)),
        "rule": (rule, rest(by_rule)), "neither": (F.lit(""), rest(F.lit(0.0))),
    }


def edges(kinds: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a before b, of kinds that are similar enough, but for those of one `clique`.

    Pairs that have barrier and rule in common, one of them or neither need another
    overlap t of their tokens. Of n tokens, sorted from the rarest, two kinds with
    that overlap share one of the first n - ceil(t * n) + 1 of each; only these are
    joined on, within the equal barriers or rules. A pair is kept at the first token that it shares there.
    """
    tokens_ = kinds.select("at", F.explode("tokens").alias("token"))
    common = tokens_.groupBy("token").agg(F.count("*").alias("n"))
    sorted_ = tokens_.join(common, "token").groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("rare"))
    rows = kinds.join(sorted_, "at").withColumn("self", F.struct("at", "tokens", "barriers", "rule", "clique"))
    ways = F.array(*[F.struct(F.lit(way).alias("way"), key.alias("key"), F.greatest(need, F.lit(0.0)).alias("need")) for way, (key, need) in needed(least, F.col("self")).items()])
    rows = rows.select("self", "rare", F.explode(ways).alias("w")).filter("w.need <= 1")
    first = F.size("rare") - F.ceil(F.col("w.need") * F.size("rare")) + 1
    rows = rows.withColumn("prefix", F.slice("rare", F.lit(1), F.least(F.size("rare").cast("long"), first).cast("int")))
    side = lambda name: rows.select("w.way", "w.key", F.explode("prefix").alias("token"), F.struct("self.*", "prefix").alias(name))
    barrier, rule = F.col("x.barriers") == F.col("y.barriers"), (F.col("x.rule") == F.col("y.rule")) & (F.col("x.rule") != "")
    way = F.when(barrier & rule, "both").when(barrier, "barrier").when(rule, "rule").otherwise("neither")
    pairs = side("x").join(side("y"), ["way", "key", "token"]).filter((F.col("x.at") < F.col("y.at")) & (F.coalesce(way, F.lit("neither")) == F.col("way")))
    pairs = pairs.filter(~F.coalesce(F.col("x.clique") == F.col("y.clique"), F.lit(False)) & (F.array_min(F.array_intersect("x.prefix", "y.prefix")) == F.col("token")))
    return pairs.filter(similarity("x", "y") >= least).select(F.col("x.at").alias("a"), F.col("y.at").alias("b"))


#: What makes reports behave alike.
KIND = ["tokens", "barriers", "rule"]


def led(kinds: DataFrame, least: float) -> DataFrame:
    """Kinds (at, tokens, barriers, rule) with `leader`, the place of the first report of their cluster; null if their reports are clusters of their own.

    Where an equal barrier and rule make two kinds similar whatever their tokens, all
    kinds with these are a clique: of it one leads at a time, and no pairs are made.
    """
    kinds = kinds.withColumn("self", F.struct(*KIND))
    # Nothing is nearer to a kind than itself: reports of one that isn't near enough to itself are clusters of their own.
    kinds = kinds.filter(similarity("self", "self") >= least).drop("self")
    key, need = needed(least, F.struct("barriers", "rule"))["both"]
    kinds = cut(kinds.withColumn("clique", F.when(need <= 0, F.sha2(key, 256))))
    links = cut(edges(kinds, least))
    open_, found = cut(kinds.select("at", "clique")), None
    while not open_.isEmpty():
        # A kind leads if no earlier kind that is similar is undecided; those similar to a leader before them follow.
        waiting = links.join(open_.select(F.col("at").alias("a")), "a", "left_semi").select(F.col("b").alias("at"))
        first = open_.filter("clique IS NOT NULL").groupBy("clique").agg(F.min("at").alias("first"))
        behind = open_.join(first, "clique").filter("at > first").select("at")
        now = cut(open_.join(waiting.unionByName(behind), "at", "left_anti"))
        found = now if found is None else found.unionByName(now)
        led = links.join(now.select(F.col("at").alias("a")), "a", "left_semi").select(F.col("b").alias("at"))
        followed = open_.join(now.filter("clique IS NOT NULL").select("clique"), "clique", "left_semi").select("at")
        open_ = cut(open_.join(now, "at", "left_anti").join(led.unionByName(followed), "at", "left_anti"))
    if found is None:
        return kinds.select(*KIND, F.col("at").alias("leader"))
    follow = links.join(found.select(F.col("at").alias("a")), "a", "left_semi").select(F.col("b").alias("at"), F.col("a").alias("leader"))
    within = kinds.join(found.filter("clique IS NOT NULL").select("clique", F.col("at").alias("leader")), "clique").filter("leader < at").select("at", "leader")
    follow = follow.unionByName(within).groupBy("at").agg(F.min("leader").alias("leader"))
    # A leader is no one's follower: kinds that lead keep their own place.
    follow = follow.join(found.select("at"), "at", "left_anti")
    return cut(kinds.join(follow, "at", "left").select(*KIND, F.coalesce("leader", "at").alias("leader")))


def joined(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """rows with the leader of their kind, null without one."""
    placed = placed.select(*[F.col(c).alias(f"_{c}") for c in KIND], "leader")
    return rows.join(placed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KIND], "left").drop(*(f"_{c}" for c in KIND))


def leaders(df: DataFrame, least: float) -> DataFrame:
    """Prepared rows with `leader`, the place of the first report of their cluster."""
    kinds = df.groupBy(*KIND).agg(F.min("at").alias("at"))
    return joined(df, led(kinds, least)).withColumn("leader", F.coalesce("leader", "at"))


def followed(rows: DataFrame, forms: DataFrame, least: float | None) -> DataFrame:
    """Rows of `formed` with `leader`; the graph is built from the forms alone. Without `least` the adaptive threshold holds."""
    kinds = forms.groupBy(*KIND).agg(F.min("form").alias("at"))
    placed = cut(joined(forms, led(kinds, threshold(rows, forms) if least is None else least)).select("form", "leader"))
    return rows.join(placed, "form").withColumn("leader", F.coalesce("leader", "at"))


def mode(groups: DataFrame, by: str, c: str, name: str) -> DataFrame:
    """Most frequent value of c that isn't empty in each group of groups (n, seen); of equals the one seen first."""
    counts = groups.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy(by, c).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    return counts.groupBy(by).agg(F.min_by(c, F.struct(-F.col("n"), F.col("seen"))).alias(name))


def summarised(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """One row per cluster of rows with `leader` and `form`, largest first: number, theme, counts, level, samples, insight.

    Reports are added up by leader, form and site first; what follows reads these sums.
    """
    sums = [F.count("*").alias("n"), F.min("at").alias("seen"), F.sum("risk_score").alias("risk"), F.count("risk_score").alias("scored"), F.count_if(F.upper("sif_potential") == "YES").alias("sif")]
    groups = cut(rows.groupBy("leader", "form", "site").agg(*sums))
    groups = groups.join(forms.select("form", "rule", "barrier_failure"), "form")
    out = groups.groupBy("leader").agg(
        F.sum("n").alias("count"), F.array_sort(F.collect_set(F.when(F.col("site") != "", F.col("site")))).alias("sites"),
        F.coalesce(F.bround(F.try_divide(F.sum("risk").cast("double"), F.sum("scored").cast("double")), 1), F.lit(50.0)).alias("avg_risk"), F.sum("sif").alias("sif_count"),
    )
    out = out.join(mode(groups, "leader", "rule", "category"), "leader", "left").join(mode(groups, "leader", "barrier_failure", "barrier"), "leader", "left")
    out = out.withColumns({"category": F.coalesce("category", F.lit("General Safety")), "barrier": F.coalesce("barrier", F.lit("Control Verification"))})
    first = Window.partitionBy("leader").orderBy("at")
    samples = rows.select("leader", "form", "at").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= 3)
    samples = samples.join(forms.filter("text != ''").select("form", "text"), "form")
    samples = samples.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("sample_descriptions"))
    out = numbered(out, ["leader"], "number", 1).join(samples, "leader", "left")
    level = F.when((F.col("avg_risk") >= 75) | (F.col("sif_count") > 0), "CRITICAL").when(F.col("avg_risk") >= 50, "HIGH").otherwise("MEDIUM")
    theme = F.when(F.col("barrier") != UNKNOWN_BARRIER, F.concat(F.lit("Repeated "), "barrier", F.lit(" in "), "category")).otherwise(F.concat(F.lit("Recurring Hazards in "), "category"))
    number = F.col("number").cast("string")
    many, sites = F.col("count").cast("string"), F.size("sites")
    insight = (
        F.when(F.col("count") >= 3, F.concat(F.lit("Repeated safety issue ("), "barrier", F.lit(") observed across "), sites.cast("string"), F.lit(" site(s) and "), many, F.lit(" reports.")))
        .when(sites > 1, F.concat(F.lit("Cross-site safety concern ("), "barrier", F.lit(") observed across "), F.array_join(F.slice("sites", 1, 2), ", "), F.lit(".")))
        .otherwise(F.concat(F.lit("Safety observation pattern ("), "barrier", F.lit(") identified in "), "category", F.lit(" with "), many, F.lit(" recorded report(s).")))
    )
    return out.select(
        F.concat(F.lit("CL-"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))).alias("cluster_id"), theme.alias("theme"), "category", "barrier", "count",
        F.when(sites == 0, F.array(F.lit("Site Alpha"))).otherwise(F.col("sites")).alias("sites"), "avg_risk", F.col("avg_risk").cast("int").alias("risk_score"), level.alias("risk_level"), "sif_count",
        (F.col("count") >= 3).alias("is_repeated"), F.coalesce("sample_descriptions", F.array().cast("array<string>")).alias("sample_descriptions"), insight.alias("insight"),
        F.when((F.col("count") >= 3) & (F.col("sif_count") > 0), "increasing").otherwise("stable").alias("trend"),
    ).orderBy(F.desc("count"), F.desc("avg_risk"), "cluster_id")


def clusters(df: DataFrame, order: list[str], least: float | None = None, text: str = "description") -> DataFrame:
    """Clusters of all reports, with the adaptive threshold if none is given."""
    rows, forms = formed(df, order, ["site", "risk_score", "sif_potential"], text)
    return summarised(followed(rows, forms, least), forms)


def members(df: DataFrame, order: list[str], least: float | None = None, text: str = "description", id_col: str = "report_id") -> DataFrame:
    """Each report's id with the place of its cluster's first report: the evidence behind a cluster."""
    rows, forms = formed(df, order, [id_col], text)
    return followed(rows, forms, least).select(id_col, "at", "leader")


def repeated(found: DataFrame) -> DataFrame:
    return found.filter("count >= 3")


def sorted_patterns(found: DataFrame, by: str = "count") -> DataFrame:
    """By frequency, SIF reports or mean risk, greatest first."""
    return found.orderBy(F.desc({"frequency": "count", "sif": "sif_count", "risk": "avg_risk"}.get(by, by)), "cluster_id")


def filtered_patterns(found: DataFrame, search: str = "", category: str = "", level: str = "", recurring: bool = False, with_sif: bool = False) -> DataFrame:
    """Clusters whose texts contain a word in any case, with the values given."""
    if search:
        whole = F.lower(F.concat_ws("\u0001", "cluster_id", "theme", "category", "barrier", "insight", "risk_level", F.array_join("sites", " ")))
        found = found.filter(F.contains(whole, F.lit(search.lower())))
    for c, v in (("category", category), ("risk_level", level)):
        if v and v.lower() != "all":
            found = found.filter(F.col(c) == v)
    if recurring:
        found = repeated(found)
    return found.filter("sif_count > 0") if with_sif else found


def counters(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("count") >= 3).alias("recurring"), F.count_if(F.col("sif_count") > 0).alias("with_sif"), F.count_if(F.size("sites") > 1).alias("cross_site"))


def confidence(c: Column) -> Column:
    """0 to 1 from numbers, percentages and the words high, medium and low; null from others."""
    text = F.lower(F.trim(c.cast("string")))
    word = F.when(text == "high", 0.9).when(text.isin("medium", "med"), 0.6).when(text == "low", 0.3)
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text).cast("double")
    share = F.when(number > 1, number / 100).otherwise(number)
    return F.when(number.isNotNull(), F.bround(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), 3)).otherwise(word)


#: Fields of a pattern and the columns that may hold them, the first that isn't blank counts.
PATTERN_FIELDS = {
    "pattern_id": ("pattern_id", "cluster_id", "id", "name"), "description": ("description", "theme", "simplified_insight", "human_insight"),
    "frequency": ("frequency", "count"), "trend": ("trend",), "sites": ("sites",), "activities": ("activities",), "barriers": ("barriers", "barrier"),
    "evidence_report_ids": ("evidence_report_ids", "report_ids"), "confidence": ("confidence", "confidence_level"), "pattern_type": ("pattern_type",),
}


def as_patterns(rows: DataFrame) -> DataFrame:
    """Rows of any provider under the names of PATTERN_FIELDS; those without an id or a description are left out.

    Lists stay lists, single values become lists of one, blanks none. A frequency that is no number is 0.
    """
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}

    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))

    def listed(c: str) -> Column:
        values = F.col(f"`{c}`").cast("array<string>") if kinds[c] == "array" else F.array(text(c))
        kept = F.filter(values, lambda v: F.coalesce(v != "", F.lit(False)))
        return F.when(F.size(kept) > 0, kept)

    def found(name: str, make, none: Column) -> Column:
        return F.coalesce(*[make(c) for c in PATTERN_FIELDS[name] if c in kinds], none).alias(name)

    lists = ("sites", "activities", "barriers", "evidence_report_ids")
    empty = F.array().cast("array<string>")
    out = rows.select(
        found("pattern_id", text, F.lit(None).cast("string")), found("pattern_type", text, F.lit("recurring_cluster")), found("description", text, F.lit(None).cast("string")),
        found("frequency", lambda c: F.expr(f"try_cast(`{c}` AS long)"), F.lit(0).cast("long")), found("trend", text, F.lit(None).cast("string")), *[found(c, listed, empty) for c in lists],
        found("confidence", lambda c: confidence(F.col(f"`{c}`")), F.lit(None).cast("double")),
    )
    return out.filter("pattern_id IS NOT NULL AND description IS NOT NULL")


def grounded(found: DataFrame, most: int = 5) -> DataFrame:
    """Clusters as patterns that an answer may cite: those seen twice or more, the first few."""
    rows = found.filter("count >= 2").orderBy(F.desc("count"), F.desc("avg_risk"), "cluster_id").limit(most)
    return rows.select(F.col("cluster_id").alias("pattern_id"), F.lit("recurring_cluster").alias("pattern_type"), F.col("insight").alias("description"), F.col("count").alias("frequency"), "trend", "sites", F.array("barrier").alias("barriers"))


def insights(found: DataFrame, month: DataFrame, sites: DataFrame, trend: DataFrame) -> DataFrame:
    """kind, title, message, severity, metric: recurring clusters, anomalies, the first cross-site cluster, a trend that isn't stable.

    month and sites are the anomalies of the months and sites, trend the trend's one row.
    """
    found, n = cut(found), F.size("sites")
    where = F.when(n > 1, F.concat(F.lit("across "), n.cast("string"), F.lit(" sites ("), F.array_join(F.slice("sites", 1, 2), ", "), F.lit(")"))).otherwise(F.concat(F.lit("at "), F.element_at("sites", 1)))
    columns = lambda kind, title, message, severity, metric: [F.lit(kind).alias("kind"), title.alias("title"), message.alias("message"), severity.alias("severity"), metric.alias("metric")]
    order = [F.desc("count"), F.desc("avg_risk"), F.col("cluster_id")]
    count = F.col("count").cast("string")
    one = repeated(found).orderBy(*order).limit(3).select(*columns("RECURRING_PATTERN", F.col("theme"), F.concat("theme", F.lit(" identified with "), count, F.lit(" correlated incidents "), where, F.lit(".")), F.col("risk_level"), F.concat(count, F.lit(" incidents"))))
    ratio = F.col("ratio").cast("string")
    high = F.when(F.col("ratio") >= 2, "CRITICAL").otherwise("HIGH")
    spike = lambda rows, name, message: rows.select(*columns("ANOMALY", F.concat(F.lit("Incident Volume Spike: "), name), message, high, F.concat(ratio, F.lit("x spike"))))
    two = spike(month, F.lit("Global Operations"), F.concat(F.lit("Incident count spiked "), ratio, F.lit("x in "), "month", F.lit(" compared to prior baseline.")))
    three = spike(sites, F.col("site"), F.concat(F.lit("Incident count at "), "site", F.lit(" spiked "), ratio, F.lit("x higher than organization-wide site average.")))
    cross = found.filter((n >= 2) & (F.col("count") >= 2)).orderBy(*order).limit(1)
    four = cross.select(*columns("CROSS_SITE_RISK", F.lit("Cross-Site Systemic Control Precursor"), F.concat(F.lit("Precursor pattern '"), "theme", F.lit("' observed across "), n.cast("string"), F.lit(" independent facilities.")), F.lit("HIGH"), F.concat(n.cast("string"), F.lit(" sites affected"))))
    moving = trend.filter("trend <> 'STABLE'")
    five = moving.select(*columns("TREND", F.concat(F.lit("Operational Trajectory: "), "trend"), F.concat(F.lit("Volume changed by "), F.col("delta_percent").cast("int").cast("string"), F.lit("% between the halves of the series.")), F.when(F.col("trend") == "RISING RISK", "CRITICAL").otherwise("MEDIUM"), F.col("trend")))
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)


def last_of_equal(found: DataFrame, order: str) -> DataFrame:
    """Insights with the same title and message once, the last of them."""
    last = Window.partitionBy("title", "message").orderBy(F.desc(order))
    return found.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")

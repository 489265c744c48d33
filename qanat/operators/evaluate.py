"""Evaluation: retrieval metrics, consistency of language pairs, null-aware means, percentiles, comparisons, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.functions.text import NUMERAL
from qanat.operators.order import interpolated, order_statistics


def hit_at(retrieved: Column, gold: Column, k: int) -> Column:
    """1 if any gold number is among the first k."""
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), gold), F.lit(False)).cast("int")


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the distinct gold numbers among the first k; 0 without gold."""
    distinct = F.size(F.array_distinct(gold))
    return F.when(distinct > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / distinct).otherwise(0.0)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(1 / F.array_min(ranks), F.lit(0.0))


def pair_tops(rows: DataFrame) -> DataFrame:
    """(pair_id, language, top1) -> (pair_id, ar, en, both): the first results of a pair's two questions."""
    one = lambda lang: F.max(F.when(F.col("language") == lang, F.struct(F.lit(True).alias("there"), F.col("top1").alias("top1"))))
    out = rows.filter("pair_id is not null").groupBy("pair_id").agg(one("ar").alias("a"), one("en").alias("e"))
    return out.select("pair_id", F.col("a.top1").alias("ar"), F.col("e.top1").alias("en"), (F.col("a").isNotNull() & F.col("e").isNotNull()).alias("both"))


def consistency(rows: DataFrame, of: str = "complete") -> DataFrame:
    """Share of pairs whose first results agree.

    complete: of pairs with both questions, two empty results agree, 0 without pairs; all: of all pairs, incomplete ones
    disagree, null without pairs; strict: as complete, but empty results never agree.
    """
    pairs = pair_tops(rows)
    same = {"complete": F.col("ar").eqNullSafe(F.col("en")), "all": F.col("both") & F.col("ar").eqNullSafe(F.col("en")), "strict": F.coalesce(F.col("ar") == F.col("en"), F.lit(False))}[of]
    if of != "all":
        pairs = pairs.filter("both")
    mean = F.avg(same.cast("int"))
    return pairs.agg((mean if of == "all" else F.coalesce(mean, F.lit(0.0))).alias("consistency"), F.count("*").alias("pairs"))


def pair_of(question_id: Column) -> Column:
    """The id before its last underscore."""
    return F.regexp_replace(question_id, "_[^_]*$", "")


def metric_means(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and number of the values that are there."""
    return rows.groupBy(*(by or [])).agg(*[a for m in metrics for a in (F.avg(m).alias(m), F.count(m).alias(f"{m}_n"))])


def hit_rate(rows: DataFrame, empty: float | None = None) -> DataFrame:
    """Share of (retrieved, expected) rows with gold whose results hold any of it."""
    hit = F.when(F.size("expected") > 0, F.arrays_overlap("retrieved", "expected").cast("int"))
    return rows.agg(F.coalesce(F.avg(hit), F.lit(empty).cast("double")).alias("hit_rate"), F.count(hit).alias("n"))


def clipped_from_counts(cells: Column, q: float) -> Column:
    """The clipped percentile of values given as an array of (value, n), ascending: for groups of few distinct values."""
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    want = F.least(total, F.floor(total * F.lit(q)) + 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), cells[0]["value"].alias("value"))
    step = lambda s, c: F.struct((s["seen"] + c["n"]).alias("seen"), F.when(s["seen"] < want, c["value"]).otherwise(s["value"]).alias("value"))
    return F.aggregate(cells, start, step, lambda s: s["value"])


def spot_check(rows: DataFrame, listed: list[int], n: int, seed: int = 42) -> DataFrame:
    """The listed articles, and n others with text in both languages, drawn by the hash of seed and number; by number."""
    draw = F.md5(F.concat(F.lit(str(seed)), F.col("article_number").cast("string")))
    both = rows.filter("trim(coalesce(text_ar, '')) <> '' and trim(coalesce(text_en, '')) <> ''").orderBy(draw, "article_number").limit(n)
    return rows.filter(F.col("article_number").isin(listed)).unionByName(both).dropDuplicates(["article_number"]).orderBy("article_number")


def weakest(rows: DataFrame, score: str, tie: str, n: int = 5) -> DataFrame:
    """The n rows of lowest score, rows without one left out."""
    return rows.filter(F.col(score).isNotNull()).orderBy(score, tie).limit(n)


def latest_of(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Of each group, the value of the last row in order."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def improvement(rows: DataFrame, before: str, after: str, metrics: list[str]) -> DataFrame:
    """(mode, metrics) -> (metric, before, after, delta)."""
    long = rows.unpivot(["mode"], metrics, "metric", "value")
    side = lambda m: F.max(F.when(F.col("mode") == m, F.col("value")))
    return long.groupBy("metric").agg(side(before).alias("before"), side(after).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def best_row(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """The row with the largest values (null as 0), compared in order; the first by ``tie`` wins."""
    return rows.orderBy(*[F.desc(F.coalesce(F.col(c), F.lit(0.0))) for c in by], tie).limit(1)


def gate_problems(means: DataFrame, threshold: float, least: int, metric: str = "faithfulness", stale: list[tuple[str, str | None, str | None]] | None = None) -> DataFrame:
    """(n_questions, metric, metric_n) -> with problems: what keeps a report from passing.

    stale: (name, md5 in the report, md5 now); compared only if both are there.
    """
    n, value, scored = F.col("n_questions"), F.col(metric), F.col(f"{metric}_n")
    checks = [
        F.when(n < least, F.format_string(f"%d questions, at least {least} needed", n)),
        F.when(value.isNull(), F.lit(f"no {metric} score")),
        F.when(value < threshold, F.format_string(f"{metric} %.4f below {threshold}", value)),
        F.when(scored < 0.8 * n, F.format_string(f"%d of %d questions scored for {metric}", scored, n)),
        *[F.lit(f"{name} has changed") for name, then, now in stale or [] if then and now and then != now],
    ]
    return means.withColumn("problems", F.filter(F.array(*checks), lambda p: p.isNotNull())).withColumn("passed", F.size("problems") == 0)


def quantisation(rows: DataFrame, base: str, most_drop: float = 0.03) -> DataFrame:
    """(label, latency, output_tokens, wall, faithfulness) rows -> one row a label against the base label."""
    means = rows.groupBy("label").agg((F.sum("output_tokens") / F.max("wall")).alias("tokens_per_s"), F.avg("faithfulness").alias("faithfulness"))
    own = means.join(order_statistics(rows, ["label"], "latency", {"p50": interpolated(0.5), "p95": interpolated(0.95)}), "label", "left")
    first = own.filter(F.col("label") == base).select(F.col("p50").alias("base_p50"), F.col("faithfulness").alias("base_faithfulness"))
    drop = F.col("base_faithfulness") - F.col("faithfulness")
    return own.join(first, how="left").select("label", "p50", "p95", "tokens_per_s", "faithfulness", drop.alias("drop"), (drop < most_drop).alias("passed"), (F.col("base_p50") / F.col("p50")).alias("speed"))


def distillation(rows: DataFrame, sizes: dict[str, int], teacher: str, student: str) -> DataFrame:
    """(model, r1, r3, r5, rr, ms) rows -> one row: speed-up, size ratio and retained recall of the student."""
    side = lambda m, c, f=F.avg: f(F.when(F.col("model") == m, F.col(c)))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return rows.agg(
        ratio(side(teacher, "ms"), side(student, "ms")).alias("speedup"),
        F.lit(sizes[teacher] / sizes[student] if sizes.get(student) else None).cast("double").alias("size_ratio"),
        ratio(side(student, "r5"), side(teacher, "r5")).alias("retained_recall"),
        side(student, "rr").alias("mrr"),
        F.max(F.when(F.col("model") == student, F.col("ms"))).alias("max_ms"),
    )


def distillation_loss(rows: DataFrame, weight: float = 1.0) -> DataFrame:
    """(qid, teacher, student) scores -> one row: mean squared error plus weight times the lists' mean divergence."""
    top = rows.groupBy("qid").agg(F.max("teacher").alias("tt"), F.max("student").alias("st"))
    shifted = rows.join(top, "qid").withColumns({"t": F.col("teacher") - F.col("tt"), "s": F.col("student") - F.col("st"), "e": F.pow(F.col("teacher") - F.col("student"), 2)})
    sums = shifted.groupBy("qid").agg(F.sum(F.exp("t")).alias("tz"), F.sum(F.exp("s")).alias("sz"), F.sum(F.exp("t") * (F.col("t") - F.col("s"))).alias("gap"), F.sum("e").alias("e"), F.count("*").alias("n"))
    kl = F.col("gap") / F.col("tz") + F.log("sz") - F.log("tz")
    return sums.agg((F.sum("e") / F.sum("n")).alias("mse"), F.avg(kl).alias("kl")).withColumn("loss", F.col("mse") + weight * F.col("kl"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of only one side, with that side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def merge_scores(new: DataFrame, old: DataFrame, metrics: list[str]) -> DataFrame:
    """By id: a new score where there is one, else the old."""
    renamed = old.select("id", *[F.col(m).alias(f"_{m}") for m in metrics])
    return new.join(renamed, "id", "full").select("id", *[F.coalesce(m, f"_{m}").alias(m) for m in metrics])


def to_do(items: DataFrame, done: DataFrame, metrics: list[str], retry: bool = False) -> DataFrame:
    """Items not seen yet; with retry, or if none is left, those whose scores are incomplete."""
    unseen = items.join(done.select("id"), "id", "left_anti")
    partial = done.filter(" or ".join(f"{m} is null" for m in metrics)).select("id")
    incomplete = items.join(partial, "id", "left_semi")
    if retry:
        return unseen.unionByName(incomplete)
    return unseen if unseen.head(1) else incomplete


# A text's end that looks like a numbered heading, and the ends that a text may have.
TAIL_HEADING_EN = r"(?:^|\s)\d{1,2}\.\s+[A-Z][^.!?;]{0,150}:?$"
TAIL_HEADING_AR = rf"(?:^|\s)[-–—]?{NUMERAL}{{1,2}}[-–—.)]?\s+[^.؛؟]{{0,150}}$"
ENDS = '[.:;)"”?]$'
#: Findings that make a corpus unfit; the others are warnings.
PROBLEMS = ("duplicate", "gap_after", "missing", "outside", "missing_repealed", "huge")
NO_BODY = "repealed_no_individual_body_in_source"


def corpus_validation(rows: DataFrame, most: int = 10_000, expected: int | None = None, repealed: DataFrame | None = None) -> DataFrame:
    """(article_number, text_ar, text_en, ..) -> (check, article_number): what is wrong with a corpus.

    expected: numbers run from 1 to it. repealed: (low, high) ranges that the book declares. Articles that the source
    gives no body (source_status, if there is one) may be empty; text_ar_raw, if there, is searched for headings.
    """
    numbers = rows.select("article_number").distinct()
    before = numbers.select((F.col("article_number") - 1).alias("article_number"))
    top = numbers.agg(F.max("article_number").alias("top"))
    gaps = numbers.join(before, "article_number", "left_anti").join(top).filter("article_number < top")
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    real = F.coalesce(F.col("source_status") != NO_BODY, F.lit(True)) if "source_status" in rows.columns else F.lit(True)
    checks = [
        ("duplicate", rows.groupBy("article_number").count().filter("count > 1")),
        ("gap_after", gaps),
        ("empty_ar", rows.filter(real & empty("text_ar"))),
        ("empty_en", rows.filter(real & empty("text_en"))),
        ("huge", rows.filter((F.length("text_ar") > most) | (F.length("text_en") > most))),
        ("unterminated", rows.filter(~empty("text_en") & ~F.rtrim("text_en").rlike(ENDS))),
        ("trailing_heading", rows.filter(F.col("text_en").rlike(TAIL_HEADING_EN))),
    ]
    if "text_ar_raw" in rows.columns:
        checks.append(("trailing_heading_ar", rows.filter(F.col("text_ar_raw").rlike(TAIL_HEADING_AR))))
    if expected is not None:
        checks += [("missing", missing_numbers(rows, expected)), ("outside", numbers.filter(~F.col("article_number").between(1, expected)))]
    if repealed is not None:
        declared = repealed.select(F.explode(F.sequence("low", "high")).alias("article_number")).distinct()
        checks.append(("missing_repealed", declared.join(rows.filter("is_repealed").select("article_number"), "article_number", "left_anti")))
    out = None
    for name, found in checks:
        part = found.select(F.lit(name).alias("check"), "article_number")
        out = part if out is None else out.unionByName(part)
    return out


def corpus_profile(rows: DataFrame, levels: tuple[str, ...] = ("book", "chapter", "section", "topic")) -> DataFrame:
    """(kind, name, n): records, distinct numbers, records by source status, and without each level of the hierarchy."""
    wide = rows.agg(F.count("*").alias("records"), F.countDistinct("article_number").alias("numbers"), *[F.count_if(F.col(c).isNull()).alias(c) for c in levels])
    names = [("total", "records"), ("total", "numbers"), *[("without", c) for c in levels]]
    counts = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n")) for k, c in names])))
    status = rows.groupBy(F.coalesce("source_status", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    return counts.unionByName(status.withColumn("kind", F.lit("status")).select("kind", "name", "n"))


def corpus_verdict(found: DataFrame) -> DataFrame:
    """Findings -> one row: whether the corpus is fit, and the number of problems and warnings."""
    problem = F.col("check").isin(*PROBLEMS)
    out = found.agg(F.count_if(problem).alias("problems"), F.count_if(~problem).alias("warnings"))
    return out.withColumn("ok", F.col("problems") == 0)


def set_profile(rows: DataFrame, order: str) -> DataFrame:
    """(id, reference, expected_articles, language, category) -> one row: how many questions there are, with what."""
    return rows.agg(
        F.count("*").alias("questions"),
        F.count_if(F.size("expected_articles") > 0).alias("with_gold"),
        F.count_if(F.trim(F.coalesce("reference", F.lit(""))) != "").alias("with_reference"),
        F.countDistinct("language").alias("languages"),
        F.countDistinct("category").alias("categories"),
        F.sum(F.greatest(F.size("expected_articles"), F.lit(0)).cast("long")).alias("gold"),
        F.min_by("id", order).alias("first_id"),
    )


def missing_numbers(rows: DataFrame, most: int) -> DataFrame:
    every = rows.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("article_number"))
    return every.join(rows, "article_number", "left_anti")

"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are built-in column functions, computed once. Trees grown on a bounded, hash-drawn sample of labelled rows give
their paths as conjunctions of thresholds; a lasso logistic fit keeps few of them; the kept rules are compiled into one column expression,
with which all texts are scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, fold, stored, text_of

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows that the trees and weights are fitted on, in expectation.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAST_ROWS, SEED = 16, 3, 10, 7
LASSO = 0.002

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold), in order


def _share(part: Column, whole: str) -> Column:
    return part / F.greatest(F.col(whole), F.lit(1)).cast("double")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double per statistic; a null text counts as empty, and all its statistics are 0."""
    df = docs.select("doc_id", text_of().alias("t")).withColumn("w", F.filter(F.split("t", r"\s+"), lambda x: x != ""))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    df = df.select(
        "doc_id", F.length("t").alias("chars"), F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).alias("repeats"), (count("\n") + 1).alias("lines"), count(r"\p{Lu}").alias("upper"),
        count(r"[^\p{L}\p{N}\s.,]").alias("symbols"), count("[0-9]").alias("digits"), count("[.,]").alias("stops"), count("!").alias("calls"), count(r"\|").alias("bars"),
        F.size(F.array_distinct(F.filter(F.split("t", r"\n"), lambda x: x != ""))).alias("own_lines"),
    )
    return df.select(
        "doc_id", F.log1p(F.col("words")).alias("log_words"), _share(F.col("chars"), "words").alias("word_chars"), _share(F.col("distinct"), "words").alias("distinct_words"),
        _share(F.col("repeats"), "words").alias("repeated_words"), _share(F.col("words"), "lines").alias("line_words"), _share(F.col("upper"), "chars").alias("upper_chars"),
        _share(F.col("symbols"), "words").alias("symbols_a_word"), _share(F.col("digits"), "chars").alias("digit_chars"), _share(F.col("stops"), "words").alias("stops_a_word"),
        _share(F.col("calls"), "words").alias("calls_a_word"), _share(F.col("bars"), "words").alias("bars_a_word"), _share(F.col("own_lines"), "lines").alias("own_lines"),
    )


def tree_rules(model, names: list[str]) -> list[Rule]:
    """The path to every node but the roots, without repeats."""
    rules: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            rules.setdefault(path)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
                walk(child, (*path, (names[split.featureIndex()], at_most, float(split.threshold()))))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(rules)


def condition(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(name) <= at) if at_most else (F.col(name) > at) for name, at_most, at in rule])


def compiled(bias: float, weighed: list[tuple[float, Rule]]) -> Column:
    """The logistic score of all rules as one column."""
    total = reduce(lambda a, b: a + b, [F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in weighed], F.lit(bias))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Column, list[tuple[float, Rule]]]:
    """Score column and the rules behind it, from ``labels`` (doc_id, quality) outside the held-out fold.

    Null labels are left out. With no label the score is 0.5, with labels of one kind it is that kind.
    """
    names = [c for c in stats.columns if c != "doc_id"]
    learn = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", F.col("quality").cast("double").alias("label"))
    rows, good = learn.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if rows == 0 or good in (0, rows):
        return F.lit(0.5 if rows == 0 else float(good > 0)), []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = stored(stats.join(learn.where(draw < min(1.0, sample_rows / rows)), "doc_id"), "labelled").repartition(4)
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, seed=SEED, featureSubsetStrategy="0.5", maxBins=64)
    forest = trees.fit(sample.select("label", array_to_vector(F.array(*names)).alias("features")))
    rules = tree_rules(forest, names)
    if not rules:
        return F.lit(good / rows), []
    held = F.array(*[condition(r).cast("double") for r in rules])
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(sample.select("label", array_to_vector(held).alias("features")))
    weighed = [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules) if w]
    return compiled(float(lasso.intercept), weighed), weighed


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; an empty table gives no rows, a repeated row its own row."""
    stats = stored(statistics(docs), "statistics")
    score, _ = fit(stats, labels)
    return stats.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

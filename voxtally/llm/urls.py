"""URL filter: a list of rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only.

Rules name a host and the start of a path and are compiled into one column, the longest first. Trees are grown on a bounded, hash-drawn sample of labelled URLs and compiled into one column. Suffix
statistics, how many labelled URLs of a suffix are blocked and how many URLs have it, are taken over all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.shared import stored, text_of

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict) of the query's list.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
#: Labelled URLs that the trees are grown on, in expectation.
SAMPLE_ROWS = 8_000
TREES, DEPTH, STEP, SEED = 12, 4, 0.3, 11
#: Labelled URLs of an even mix that a suffix has besides its own.
PRIOR = 4.0
#: Labels of a host, from the right, that suffix statistics are taken over.
SUFFIX_LABELS = (1, 2)
FEATURES = ["chars", "host_chars", "labels", "depth", "digits", "marks", "entropy", "parameters", *[f"{what}_{k}" for k in SUFFIX_LABELS for what in ("blocked", "log_seen")]]
_COUNTED = ["label", *[f"suffix_{k}" for k in SUFFIX_LABELS]]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_parts(urls: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``; both are empty in a null URL and in one without ``://``."""
    after = F.when(F.instr(text_of("url"), "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, _CAPITALS, _CAPITALS.lower()), "path": path})


def rule_of(rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``host`` and ``path``, or null; of equal rules block wins.

    A rule fits its host and all below it. Rules are a parameter of the plan, so a list, not a table.
    """
    best: dict[str, str] = {}
    for host, path, verdict in rules:
        best[host + path] = BLOCK if BLOCK in (verdict, best.get(host + path)) else verdict
    if not best:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, _ in rules:
        by_host.setdefault(host, []).append((path, host + path, best[host + path]))
    tests = []
    for host, starts in by_host.items():
        below = (F.col("host") == host) | F.col("host").endswith("." + host)
        tests += [(rule, below & F.startswith("path", F.lit(path)), verdict) for path, rule, verdict in starts]
    tests.sort(key=lambda t: (-len(t[0]), t[0]))
    found = [F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for rule, fits, verdict in tests]
    return F.coalesce(*found)


def _entropy(column: str) -> Column:
    """Bits a character: equal ones stand together once sorted, so one walk over them counts every run."""
    chars = F.sort_array(F.split(F.col(column), ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def close(s):
        return s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(F.lit(0.0))

    def step(s, c):
        same = s["last"] == c
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, s["sum"]).otherwise(close(s)).alias("sum"))

    length = F.char_length(F.col(column)).cast("double")
    return F.when(length > 0, F.log2(length) - F.aggregate(chars, start, step, close) / length).otherwise(F.lit(0.0))


def _suffix(labels: int) -> Column:
    return F.substring_index("host", ".", -labels)


def lexical(parts: DataFrame) -> DataFrame:
    """Add the lexical features and the suffixes ``suffix_<k>``; a null URL counts as the empty one."""
    url = parts.withColumn("_url", text_of("url"))
    chars = F.char_length("_url")
    asked = F.when(F.instr("_url", "?") > 0, F.substring_index(F.expr("substring(_url, instr(_url, '?') + 1)"), "#", 1)).otherwise(F.lit(""))
    share = lambda pattern: F.regexp_count("_url", F.lit(pattern)) / F.greatest(chars, F.lit(1))
    return url.withColumns({
        "chars": chars.cast("double"), "host_chars": F.char_length("host").cast("double"), "labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
        "depth": F.regexp_count("path", F.lit("[^/]+")).cast("double"), "digits": share("[0-9]"), "marks": share(r"[^\p{L}0-9/:.]"), "entropy": _entropy("_url"),
        "parameters": F.regexp_count(asked, F.lit("[^&;]+")).cast("double"), **{f"suffix_{k}": _suffix(k) for k in SUFFIX_LABELS},
    }).drop("_url")


def suffix_statistics(rows: DataFrame, k: int) -> DataFrame:
    """suffix_k, blocked_k, log_seen_k from rows with ``suffix_k`` and a ``label`` that may be null."""
    counts = rows.groupBy(f"suffix_{k}").agg(F.count("*").alias("seen"), F.count("label").alias("judged"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad"))
    return counts.select(f"suffix_{k}", ((F.col("bad") + PRIOR / 2) / (F.col("judged") + PRIOR)).alias(f"blocked_{k}"), F.log1p("seen").alias(f"log_seen_{k}"))


def _tree(node) -> Column:
    """One tree as nested conditions."""
    if node.getClass().getSimpleName() != "InternalNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def compiled(model) -> Column:
    """Chance of block: logistic of twice the weighed sum of all trees."""
    margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * _tree(t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def fit(featured: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Column:
    """Chance of block from rows with FEATURES and a ``label`` (1 block, 0 allow, null unknown).

    The sample is drawn by the hash of the URL. Without a label the chance is 0, with labels of one kind it is that kind.
    """
    known = featured.where("label IS NOT NULL")
    rows, bad = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if bad in (0, rows):
        return F.lit(float(bad > 0))
    draw = F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = stored(known.where(draw < min(1.0, sample_rows / rows)).select("label", *FEATURES), "judged")
    if sample.select("label").distinct().count() < 2:
        return F.lit(bad / rows)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, minInstancesPerNode=5)
    return compiled(trees.fit(sample.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """All columns of ``urls`` in ``row``, with host, path, rule, score and verdict.

    Labels are what the rules say of a URL, or, where ``labelled`` (url, label) is given, that. A URL without a rule is blocked at a chance
    of one half or more. A null URL is judged as an empty one; repeated rows are judged alike; an empty table gives no rows.
    """

    def prepared(rows: DataFrame) -> DataFrame:
        return lexical(with_parts(rows)).withColumn("fit", rule_of(rules))

    rows = prepared(urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), F.col("url").cast("string").alias("url")))
    said = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == BLOCK).cast("double"))
    rows = rows.withColumn("label", said if labelled is None else F.lit(None).cast("double"))
    learn = rows if labelled is None else prepared(labelled.select("url", F.col("label").cast("double").alias("label")))
    seen = rows if labelled is None else rows.select(*_COUNTED).unionByName(learn.select(*_COUNTED))
    for k in SUFFIX_LABELS:
        table = stored(suffix_statistics(seen, k), "suffixes")
        rows = rows.join(table, f"suffix_{k}")
        learn = rows if labelled is None else learn.join(table, f"suffix_{k}")
    score = fit(learn)
    scored = rows.withColumn("score", score)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return scored.select("row", "host", "path", F.col("fit.rule").alias("rule"), "score", verdict.alias("verdict"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with what the rules, or trees grown on the URLs they decide, say of it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("row.page_id", "host", "path", "rule", "verdict")

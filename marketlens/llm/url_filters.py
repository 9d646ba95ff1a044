"""URL filters: rules first, gradient-boosted trees for the urls that no rule fits.

The urls that a rule allows or blocks are the labelled ones.  The trees learn from their
lexical features, without the html: lengths, depth, digit ratio, character entropy,
parameter counts, and the share of blocked urls among the labelled ones with the same
host suffix, taken out of fold.  Spark trains the trees over all labelled urls.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, materialise


class Rule(NamedTuple):
    verdict: str
    #: host and path prefix, such as example.com/en/
    place: str


#: Fixed values of the registered query.
RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))

TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 11
#: Weight of the overall share of blocked urls in the share of one suffix.
PRIOR = 20.0
#: Folds of the labelled urls; a labelled url sees the suffix shares of the other folds.
FOLDS = 8
#: A url is blocked if its probability is at least this.
THRESHOLD = 0.5
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "secure",
            "last_label_blocked", "last_two_blocked"]


def host_and_path(url: Column) -> Column:
    """struct(host, path); both empty if the url is null or has no ``://``."""
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.char_length(after) + 4, F.char_length(url))
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.when(known, F.struct(host.alias("host"), path.alias("path"))).otherwise(F.struct(F.lit("").alias("host"), F.lit("").alias("path")))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """struct(place, verdict) of the longest rule that fits; null if none does.

    The rules are a parameter of the query, a short list; they become one expression.
    """
    ordered = sorted(rules, key=lambda r: -len(r.place))
    found = F.lit(None).cast("struct<place:string,verdict:string>")
    for rule in reversed(ordered):
        site, slash, rest = rule.place.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit(f".{site}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule.place).alias("place"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character of the distribution of characters; 0 for an empty text."""
    n = F.char_length(text).cast("double")
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (_id, _url, _host, _path, ...) with the lexical features and the host suffixes."""
    length = F.char_length("_url").cast("double")
    return pages.select(
        "*", length.alias("url_length"), F.char_length("_host").cast("double").alias("host_length"),
        F.char_length("_path").cast("double").alias("path_length"), count_of(F.col("_path"), "/").alias("depth"),
        count_of(F.col("_host"), r"\.").alias("labels"), (count_of(F.col("_url"), "[0-9]") / F.greatest(length, F.lit(1.0))).alias("digit_ratio"),
        entropy(F.col("_url")).alias("entropy"), count_of(F.regexp_extract("_url", r"\?[^#]*", 0), "[?&]").alias("parameters"),
        count_of(F.col("_host"), "-").alias("hyphens"), F.startswith("_url", F.lit("https:")).cast("double").alias("secure"),
        F.substring_index("_host", ".", -1).alias("_last"), F.substring_index("_host", ".", -2).alias("_last_two"))


def with_suffix_shares(rows: DataFrame) -> DataFrame:
    """Adds the smoothed share of blocked urls by host suffix, over the labelled rows.

    A labelled row gets the share of the other folds, which are dealt by its id and url:
    the rows of a suffix and fold have one value, whatever their labels.  The others get
    the share of all folds.
    """
    rows = rows.withColumn("_fold", F.when(F.col("_label").isNotNull(), F.pmod(F.xxhash64("_id", "_url"), F.lit(FOLDS)).cast("int")))
    labelled = rows.where("_label is not null")
    overall = labelled.agg(F.avg("_label").alias("_overall"))
    in_fold = lambda x: F.array(*[F.sum(F.when(F.col("_fold") == i, x).otherwise(0.0)) for i in range(FOLDS)])
    own = lambda folds: F.coalesce(F.get(folds, F.col("_fold")), F.lit(0.0))
    for suffix, name in (("_last", "last_label_blocked"), ("_last_two", "last_two_blocked")):
        totals = labelled.groupBy(F.col(suffix).alias("_s")).agg(
            F.sum("_label").alias("_b"), F.count("*").alias("_c"), in_fold(F.col("_label")).alias("_bs"), in_fold(F.lit(1.0)).alias("_cs"))
        blocked = F.coalesce("_b", F.lit(0.0)) - own(F.col("_bs"))
        seen = F.coalesce("_c", F.lit(0)) - own(F.col("_cs"))
        joined = rows.join(totals, rows[suffix] == F.col("_s"), "left").withColumn("_overall", F.coalesce(overall.scalar(), F.lit(0.0)))
        rows = joined.withColumn(name, (blocked + PRIOR * F.col("_overall")) / (seen + PRIOR)).drop("_s", "_b", "_c", "_bs", "_cs", "_overall")
    return rows.drop("_fold")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_probability (null where a rule decides).

    A null url, or one without ``://``, has an empty host and path, fits no rule and is
    judged by the trees.  Repeated urls and null ids are judged row by row.  If all
    labelled urls have the same verdict, the others get it too; without any, they are
    allowed.  An empty table gives an empty result; only the id and the url are read.  Urls of
    any length are judged whole.
    """
    urls = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    split = urls.select("_id", "_url", host_and_path(F.col("_url")).alias("_hp")).select("_id", "_url", "_hp.*")
    split = split.select("_id", "_url", F.col("host").alias("_host"), F.col("path").alias("_path"))
    ruled = split.withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules))
    labelled = lexical(ruled.withColumn("_label", (F.col("_rule.verdict") == "block").cast("double")))
    rows = materialise(with_suffix_shares(labelled).select("_id", "_host", "_path", "_rule", "_label", *FEATURES))
    low, high = rows.agg(F.min("_label"), F.max("_label")).first()
    if low is None or low == high:
        probability = F.lit(low or 0.0)
        judged = rows
    else:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
        trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
        model = trees.fit(assembled.where("_label is not null").select("_features", "_label"))
        judged = model.transform(assembled)
        probability = F.round(vector_to_array("probability")[1], 6)
    verdict = F.when(F.col("_probability_of_block") >= threshold, "block").otherwise("allow")
    return judged.withColumn("_probability_of_block", probability).select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.place").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), verdict).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("_probability_of_block")).alias("block_probability"))

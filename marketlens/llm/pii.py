"""Personal data by base patterns and bootstrapped contextual extraction.

Base entities (valid emails, ip addresses, card and phone numbers) are the seeds.  Seeds
and candidates, which are spans of similar shape that no base pattern accepts, are the
instances of a graph; the words next to them are its patterns: the word before, the two
words before, and the words on both sides.

Spark scores the graph in rounds.  A pattern's confidence for a kind is the share of that
kind among its distinct labelled instances, with ``DOUBT`` instances of no kind added: six
seeds without anything against them make a pattern trusted, each instance of another kind
calls for three more.  Labelled are the seeds, the
accepted candidates with their score as weight, and, against a kind, the candidates whose
form rules it out; other candidates are unknown and count neither way.  A candidate's score
is the probability that at least one of its trusted patterns is right.  A trusted pattern
stays trusted, and the rounds end when none is added.  In the end all spans of accepted
identifiers are added.

The words next to a span are taken from the text as it stands, whether or not they belong
to other spans.  They are looked for in the 80 code points on each side; of a longer word,
the part in them counts.

Spans are found within the row; only spans and their contexts are shuffled, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import SPACE, join_spread, let, match_places, materialise, scan, text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that matching never backtracks over a run of
# characters: a match starts where no longer one could, and takes its repetitions for good.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: A chain of digits with single separators; chains of fewer than 13 digits cannot pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Shapes of candidates: address-like words and number chains with any usual separators.
ADDRESS = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+"
NUMBER = r"(?<![0-9])(?<![0-9][\x20().-])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"

#: Instances of no kind added to each pattern.
DOUBT = 2.0
TRUST = 0.75


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(a: Column, i: Column) -> Column:
        d = F.substring(number, -(i + 1), F.lit(1)).cast("int")
        twice = d * 2
        return a + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def gated(text: Column, gate: Column, pattern: str, valid) -> Column:
    """Valid matches of ``pattern``, which is only run where ``gate`` is true."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    return F.when(gate, F.filter(match_places(text, pattern, context=True), lambda x: valid(x["value"]))).otherwise(F.array().cast(kind))


def base_matches(text: Column) -> dict[str, Column]:
    """By kind, the valid base matches; failing matches are dropped and not tried again."""
    count = lambda v: F.length(digits(v))
    return {
        "email": gated(text, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        "ip": gated(text, text.rlike(r"[0-9]\.[0-9]"), IP, lambda v: v.rlike(rf"^(?:{IP_PART}\.){{3}}{IP_PART}$")),
        "card": gated(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD, lambda v: count(v).between(13, 19) & luhn(digits(v))),
        "phone": gated(text, F.contains(text, F.lit("+")), PHONE, lambda v: count(v).between(9, 15)),
    }


def contexts(x: Column) -> Column:
    """Array of the lexical patterns of a span; a pattern without a word is left out."""
    word = rf"[^{SPACE}]+"
    last = F.lower(F.regexp_extract(x["before"], rf"({word})[{SPACE}]*$", 1))
    two = F.lower(F.regexp_extract(x["before"], rf"({word}[{SPACE}]+{word})[{SPACE}]*$", 1))
    after = F.lower(F.regexp_extract(x["after"], rf"^[{SPACE}]*({word})", 1))
    found = F.array(F.when(last != "", F.concat(F.lit("1 "), last)), F.when(two != "", F.concat(F.lit("2 "), two)),
                    F.when((last != "") & (after != ""), F.concat(F.lit("3 "), last, F.lit(" _ "), after)))
    return F.filter(found, lambda c: c.isNotNull())


def outside(spans: Column, taken: Column) -> Column:
    """Those of ``spans`` that overlap none of ``taken``, in the order of their starts.

    Both are swept once in each direction: what matters is the furthest end of a taken span
    that starts before, and the start of the next one.
    """
    mark = lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"))
    marks = F.array_sort(F.concat(F.transform(taken, lambda x: mark(x, F.lit(-1))), F.transform(spans, lambda x, i: mark(x, i))))
    is_taken = lambda x: x["i"] < 0

    def ends(furthest: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_taken(x), F.greatest(furthest, x["end"])).otherwise(furthest), furthest <= x["start"]

    def starts(following: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_taken(x), x["start"]).otherwise(following), following >= x["end"]

    def free(ms: Column) -> Column:
        before = scan(ms, F.lit(0), "boolean", ends)
        behind = F.reverse(scan(F.reverse(ms), F.lit((1 << 31) - 1), "boolean", starts))
        clear = F.filter(F.arrays_zip(ms.alias("m"), before.alias("a"), behind.alias("b")), lambda z: (z["m"]["i"] >= 0) & z["a"] & z["b"])
        return F.transform(clear, lambda z: F.get(spans, z["m"]["i"]))

    return F.when(F.size(taken) == 0, spans).otherwise(let(marks, free))


def spans_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: _row, _id, _base (start, end, kind) and _occ, seeds and candidates with their patterns."""
    text = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    t = F.col("_text")
    addresses = gated(t, F.contains(t, F.lit("@")) | t.rlike(r"[(\[]at[)\]]"), ADDRESS, lambda v: F.lit(True))
    numbers = gated(t, t.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), NUMBER, lambda v: F.lit(True))
    found = text.select("_id", *[m.alias(f"_{k}") for k, m in base_matches(t).items()], F.concat(addresses, numbers).alias("_shapes"))
    of_kind = lambda k: F.transform(F.col(f"_{k}"), lambda x: F.struct(
        x["start"], x["end"], F.lit(k).alias("kind"), x["value"], x["before"], x["after"]))
    based = found.select("_id", "_shapes", F.concat(*[of_kind(k) for k in KINDS]).alias("_seeds"))
    fresh = F.transform(outside(F.col("_shapes"), F.col("_seeds")), lambda x: F.struct(
        x["start"], x["end"], F.lit(None).cast("string").alias("kind"), x["value"], x["before"], x["after"]))
    value = lambda x: F.when(F.contains(x["value"], F.lit("@")) | ~x["value"].rlike("^[^A-Za-z]*$"), F.lower(x["value"])).otherwise(digits(x["value"]))
    occurrences = F.transform(F.concat("_seeds", fresh), lambda x: F.struct(x["start"], x["end"], x["kind"], value(x).alias("value"), contexts(x).alias("contexts")))
    return based.select(F.monotonically_increasing_id().alias("_row"), "_id",
                        F.transform("_seeds", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("_base"), occurrences.alias("_occ"))


def may_be(value: Column, kind: str) -> Column:
    """Whether the form of a candidate leaves room for ``kind``; numbers are bare digits."""
    if kind == "email":
        return ~value.rlike("^[0-9]*$")
    low, high = {"ip": (4, 12), "card": (13, 19), "phone": (7, 15)}[kind]
    return value.rlike(f"^[0-9]{{{low},{high}}}$")


def bootstrap(occurrences: DataFrame, rounds: int | None = None) -> DataFrame:
    """(value, found_kind, score) of the accepted candidates, after ``rounds`` or when no pattern is added.

    ``occurrences`` has value, kind (null for a candidate) and contexts.
    """
    # an identifier counts once for a pattern, however often it is repeated; a seed's kind comes with its edge
    edges = materialise(occurrences.select("value", "kind", F.explode("contexts").alias("context"))
                        .groupBy("context", "value").agg(F.min("kind").alias("kind")))
    candidates = edges.where("kind is null").select("context", "value")
    counts = [c for k in KINDS for c in (f"_{k}", f"_not_{k}")]
    sums = [F.sum(c).alias(c) for c in counts]

    def labels(of, against) -> list[Column]:
        weigh = lambda when, weight: F.when(when, weight).otherwise(0.0)
        return [c for k in KINDS for c in (weigh(*of(k)).alias(f"_{k}"), weigh(*against(k)).alias(f"_not_{k}"))]

    kind, found, one = F.col("kind"), F.col("found_kind"), F.lit(1.0)
    seeds = edges.where("kind is not null").select("context", F.lit(0).alias("_open"), *labels(lambda k: (kind == k, one), lambda k: (kind != k, one)))
    # a candidate whose form rules a kind out counts against it in full, and not again once it is accepted as another kind
    unknown = candidates.select("context", F.lit(1).alias("_open"), *labels(lambda k: (F.lit(False), one), lambda k: (~may_be(F.col("value"), k), one)))
    # only the patterns that extract a candidate matter
    known = materialise(seeds.unionByName(unknown).groupBy("context").agg(F.sum("_open").alias("_open"), *sums).where("_open > 0").drop("_open"))
    spark = occurrences.sparkSession
    trusted = spark.createDataFrame([], "context string, found_kind string, confidence double")
    accepted = spark.createDataFrame([], "value string, found_kind string, score double")
    done = 0
    while rounds is None or done < rounds:
        patterns = known
        if done:
            grown = join_spread(candidates, accepted, "value", F.xxhash64("context"))
            grown = grown.select("context", *labels(lambda k: (found == k, F.col("score")),
                                                    lambda k: ((found != k) & may_be(F.col("value"), k), F.col("score"))))
            patterns = known.unionByName(grown).groupBy("context").agg(*sums).join(trusted, "context", "left_anti")
        share = lambda k: F.col(f"_{k}") / (F.col(f"_{k}") + F.col(f"_not_{k}") + DOUBT)
        best = F.greatest(*[F.struct(share(k).alias("confidence"), F.lit(k).alias("kind")) for k in KINDS])
        fresh = materialise(patterns.select("context", best.alias("_b")).where(F.col("_b.confidence") >= TRUST).select(
            "context", F.col("_b.kind").alias("found_kind"), F.col("_b.confidence").alias("confidence")))
        if fresh.isEmpty():
            break
        trusted = materialise(trusted.unionByName(fresh)) if done else fresh
        fits = F.coalesce(*[F.when(F.col("found_kind") == k, may_be(F.col("value"), k)) for k in KINDS])
        scored = join_spread(candidates, trusted, "context", F.xxhash64("value")).where(fits).groupBy("value", "found_kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        accepted = materialise(scored.groupBy("value").agg(F.max(F.struct("score", "found_kind")).alias("_b"))
                               .select("value", F.col("_b.found_kind").alias("found_kind"), F.col("_b.score").alias("score")))
        done += 1
    return accepted


def spans_text(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    place = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k).cast("int")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(place(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per input row: id, base (start, end, kind), added (start, end, kind, score).

    A null text counts as empty and has no spans.  Repeated rows and null ids are searched
    row by row; an empty table gives an empty result; only the id and the text are read.
    Texts of any length are searched whole, in time that grows with their length.
    Places are code points, the end is exclusive.
    """
    rows = materialise(spans_of(docs, id_col, text_col))
    occurrences = rows.select("_row", F.explode("_occ").alias("o")).select("_row", "o.*")
    accepted = bootstrap(occurrences, rounds)
    new = join_spread(occurrences.where("kind is null").select("_row", "start", "end", "value"), accepted, "value", F.xxhash64("_row"))
    added = new.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("found_kind").alias("kind"), "score"))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>")
    return rows.join(added, "_row", "left").select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.coalesce("added", none).alias("added"))

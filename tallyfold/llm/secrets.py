"""Secret scans: candidates by pattern, false positives removed by a random forest.

Only texts in which a candidate pattern occurs are taken apart: the text is cut around the
candidates, so each comes with its place and what stands before and after it. Features are
its length, how its characters change class, how much of it dictionary words cover, whether it is
part of a path, and the words beside it. The forest is trained from labelled findings, a bounded
number of them, and runs inside the JVM like all else here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import framed, pick, saved

#: Any value of eight or more characters that is set to a credential's name, up to the next parameter of a URL, or
#: else a run of 16 or more characters of keys and tokens with a digit in it. A run after 'name=' begins behind the sign.
MEMBER = "[A-Za-z0-9_+/=.-]"
NAME = "[A-Za-z_][A-Za-z0-9_.-]{0,127}="
START = f"(?:(?<!{MEMBER})|(?<==)(?<=(?<!{MEMBER}){NAME}))(?!{NAME}[A-Za-z0-9_+/.-])"
RUN = START + f"(?=[A-Za-z_+/=.-]*+[0-9]){MEMBER}{{16,}}+"
CREDENTIAL = r"(?i)(?:secret|token|passw(?:or)?d|passwd|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
VALUE = (
    r"(?<=[:=\s\"'])(?<=(?:secret|token|password|passwd|pwd|key|auth|credential|credentials)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)"
    r"(?:(?!&[\w.~%-]{1,64}=)[^\s\"',;]){8,}+"
)
CANDIDATE = f"(?i:{VALUE})|(?:{RUN})"
#: Formats that providers document; plain values.
PROVIDERS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)$"
INNOCENT = r"(?i)\b(?:example|sample|test|dummy|sha\d*|md5|commit|checksum|hash|etag|digest|order|invoice|card|phone|isbn|uuid|page|id)\b"
MARK = "\u0001"
BESIDE = 60
REDACTED = "[secret]"


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled findings learned from, ``dictionary`` the words of the dictionary."""

    train_rows: int = 20_000
    dictionary: int = 5_000
    trees: int = 24
    depth: int = 6
    seed: int = 11
    least_score: float = 0.5


def parts(text: Column) -> Column:
    """The text cut around its candidates: every second part is one."""
    clean = F.translate(text, MARK, " ")
    return F.split(F.regexp_replace(clean, CANDIDATE, f"{MARK}$0{MARK}"), MARK)


def candidates(docs: DataFrame) -> DataFrame:
    """row (a key of id and text), doc_id, part, start, candidate, before, after.

    Null and empty texts have none; rows that repeat id and text are scanned once.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.xxhash64("doc_id", "text")).dropDuplicates(["row"])
    cut = rows.select("row", "doc_id", parts(F.col("text")).alias("p"))
    cut = cut.withColumn("ends", F.expr("transform(p, (x, i) -> length(x))"))
    found = cut.select("row", "doc_id", "p", "ends", F.explode(F.expr("filter(sequence(0, size(p) - 1), i -> i % 2 = 1)")).alias("part"))
    return found.select(
        "row",
        "doc_id",
        "part",
        F.expr("aggregate(slice(ends, 1, part), 0L, (a, x) -> a + x)").alias("start"),
        F.expr("p[part]").alias("candidate"),
        # A long name can be a candidate itself; what stands before goes across it.
        F.expr(f"right(array_join(slice(p, greatest(1, part - 4), least(5, part)), ''), {BESIDE})").alias("before"),
        F.expr(f"left(get(p, part + 1), {BESIDE})").alias("after"),
    )


def dictionary(docs: DataFrame, settings: Settings) -> DataFrame:
    """The commonest words of four or more letters, by the number of different texts that hold them.

    All texts count, copies once; only the commonest words leave the aggregate.
    """
    texts = pick(docs, "text").where("text is not null").withColumn("h", F.xxhash64("text")).dropDuplicates(["h"])
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(settings.dictionary).select("word")


def _documented() -> Column:
    """Whether the candidate, without padding or a full stop after it, has a provider's format."""
    return F.expr("trim(TRAILING '.=' FROM candidate)").rlike(PROVIDERS)


def _count(pattern: str) -> Column:
    return F.expr(f"regexp_count(candidate, r'{pattern}')").cast("double")


FEATURES = (
    "length lower upper digit other lower_digit digit_lower case_change digit_runs distinct covered hex_only digits_only "
    "in_path dots named assigned quoted innocent provider"
).split()


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the feature columns; ``words`` is a bounded dictionary."""
    size = F.length("candidate").cast("double")
    near = F.concat_ws(" ", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    pieces = found.select("row", "part", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    covered = pieces.join(F.broadcast(words), "word").groupBy("row", "part").agg(F.sum(F.length("word")).alias("letters"))
    return found.join(covered, ["row", "part"], "left").select(
        *found.columns,
        size.alias("length"),
        (_count("[a-z]") / size).alias("lower"),
        (_count("[A-Z]") / size).alias("upper"),
        (_count("[0-9]") / size).alias("digit"),
        (_count("[^A-Za-z0-9]") / size).alias("other"),
        (_count("[a-z](?=[0-9])") / size).alias("lower_digit"),
        (_count("[0-9](?=[a-z])") / size).alias("digit_lower"),
        (_count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size).alias("case_change"),
        _count("[0-9]+").alias("digit_runs"),
        F.size(F.array_distinct(F.split("candidate", ""))).cast("double").alias("distinct"),
        (F.coalesce("letters", F.lit(0)) / size).alias("covered"),
        F.col("candidate").rlike("^[0-9a-f]+$").cast("double").alias("hex_only"),
        F.col("candidate").rlike("^[0-9]+$").cast("double").alias("digits_only"),
        (F.col("candidate").contains("/") | F.coalesce(F.col("before").rlike(r"(?:https?:|www\.|[/\\])\S*$"), F.lit(False))).cast("double").alias("in_path"),
        _count("[.]").alias("dots"),
        F.coalesce(F.col("before").rlike(CREDENTIAL), F.lit(False)).cast("double").alias("named"),
        F.coalesce(F.col("before").rlike(r"[:=]\s*[\"']?$"), F.lit(False)).cast("double").alias("assigned"),
        F.coalesce(F.col("before").rlike("[\"']$"), F.lit(False)).cast("double").alias("quoted"),
        near.rlike(INNOCENT).cast("double").alias("innocent"),
        _documented().cast("double").alias("provider"),
    )


def distant_labels(found: DataFrame) -> DataFrame:
    """``found`` with label: a stand-in where nobody has labelled findings.

    1 for documented formats and for values set to a credential's name close before them, 0 for
    all that is far from any such name; the doubtful rest has no label.
    """
    close = F.coalesce(F.col("before").rlike(CREDENTIAL + r"[\w-]{0,20}[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"), F.lit(False))
    far = ~F.coalesce(F.col("before").rlike(CREDENTIAL), F.lit(False))
    known = _documented()
    return found.withColumn("label", F.when(known | close, 1.0).when(far, 0.0)).where("label is not null")


def train(labelled: DataFrame, words: DataFrame, settings: Settings):
    """A forest from findings with label (0 or 1), at most ``settings.train_rows``; None where a class is missing."""
    some = labelled.orderBy(F.xxhash64("row", "part"), "row", "part").limit(settings.train_rows)
    some = saved(features(some, words).select("row", "part", "label", *FEATURES), "secret-training")
    if some.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(some.repartition(1).sortWithinPartitions("row", "part"))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, probabilityCol="p"
    )
    return forest.fit(rows)


def findings(docs: DataFrame, labelled: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """row, doc_id, part, start, candidate, score, secret of every candidate of ``docs``.

    ``labelled`` holds findings as of ``candidates`` with label (0 or 1); ``distant_labels`` of the
    documents' own candidates stand in if it is left out. Without both classes the score is 1 where
    only true findings are known, else 0. Columns other than doc_id and text are ignored; rows
    that repeat id and text have the same findings, given once.
    """
    settings = settings or Settings()
    found = saved(candidates(docs), "secret-candidates")
    words = saved(dictionary(docs, settings), "secret-dictionary")
    labelled = labelled if labelled is not None else distant_labels(found)
    model = train(labelled, words, settings)
    if model is None:
        known = labelled.where("label = 1").limit(1).count() > 0
        scored = found.withColumn("score", F.lit(float(known)))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(found, words)))
        scored = scored.withColumn("score", vector_to_array("p")[1])
    return scored.select("row", "doc_id", "part", "start", "candidate", "score", (F.col("score") >= settings.least_score).alias("secret"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each secret of ``found`` replaced in its text; all rows stay, in their columns."""
    rows, names = framed(docs, doc_id="doc_id", text="text")
    bad = found.where("secret").groupBy("row").agg(F.collect_set("part").alias("bad"))
    keyed = rows.withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), "text")).join(bad, "row", "left")
    clean = F.array_join(F.transform(parts(F.col("text")), lambda p, i: F.when(F.array_contains("bad", i), REDACTED).otherwise(p)), "")
    return keyed.withColumn("text", F.when(F.col("bad").isNotNull(), clean).otherwise(F.col("text"))).select(*names).toDF(*docs.columns)

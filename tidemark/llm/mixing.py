"""Mixing to target weights by iterative proportional fitting.

Documents are summed into cells of source, language and topic, weighted by tokens. The cells' weights are raked to the
marginal targets of the three in turn, ROUNDS times. The targets add up to the share KEEP of all tokens, and no cell may
outgrow its own tokens, so a cell's final weight over its first is a probability; each document of the cell is kept with
it. The expected tokens of the sample then have the target shares, but for values that have too few tokens and are kept
whole. Without that bound one rare cell that the targets favour would scale the probabilities of all others down.
Targets are given, or tempered: a share to the power of ALPHA, made to sum to one.

The table has no topics, so the default topic is the kind of text, told from the whole of it: tables, numbers, short,
medium or long prose. Whether a document is kept depends on a hash of its id alone, never on order or partitions.

Only DataFrame functions are used. The document pass narrows to cells by partial aggregation; they are written, and the
rounds are windows over them, one margin at a time, so a task holds cells of a margin's value, never documents.

Defined cases: a null source or language is a value of its own, as is a null topic; a null, empty or blank text has one
token (its end); repeated rows are kept or dropped together; a null id hashes like the empty text; an empty table gives
an empty result; a target for a value that no document has is left out, and the others are scaled; a value without a
target keeps its share; columns of the input are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise, text_or_empty

ROUNDS = 12
#: After so many rounds the cells are written, so that no plan holds more windows than these rounds need.
WRITTEN = 3
ALPHA = 0.7
KEEP = 0.8
MARGINS = ("source", "lang", "topic")
SALT = "mix:"


def tokens() -> Column:
    """Words and one end."""
    return (F.regexp_count(text_or_empty(), F.lit(WORD)) + 1).cast("long")


def kind_of_text(words: Column) -> Column:
    text = text_or_empty()
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return (
        F.when(bars * 5 > words, "table").when(digits * 10 > F.length(text), "numbers")
        .when(words < 150, "short").when(words < 800, "medium").otherwise("long")
    )


def _keyed(docs: DataFrame, topic: Column | None) -> DataFrame:
    words = docs.withColumn("_tokens", tokens())
    words = words.withColumn("_topic", kind_of_text(F.col("_tokens")) if topic is None else topic)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    return words.withColumns({"_source": text("source"), "_lang": text("lang"), "_topic": text("_topic")})


def _with_targets(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None, alpha: float, keep: float) -> DataFrame:
    """Cells with the wanted sum of each of their margins; each margin adds up to the share ``keep`` of the cells."""
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("first").alias("own"))
        given = (targets or {}).get(m)
        if given is None:
            sums = sums.withColumn("want", F.pow("own", F.lit(alpha)))
        else:
            chosen = F.coalesce(*(F.when(F.col(m) == F.lit("\0" if k is None else k), F.lit(float(v))) for k, v in given.items()), F.lit(None).cast("double")) if given else F.lit(None).cast("double")
            share = F.col("own") / F.sum("own").over(_all())
            sums = sums.withColumn("want", F.coalesce(chosen, share))
        sums = sums.select(m, (F.col("want") / F.sum("want").over(_all()) * F.sum("own").over(_all()) * keep).alias(f"want_{m}"))
        cells = cells.join(sums, m)
    return cells


def _all():
    """Over the values of one margin."""
    return Window.partitionBy(F.lit(1))


def rake(cells: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, alpha: float = ALPHA, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """source, lang, topic, first, final: the raked weights of cells with the weight ``first``, none above it."""
    cells = _with_targets(materialise(cells, "mix-cells", few=True), targets, alpha, keep).withColumn("final", F.col("first"))
    for k in range(rounds):
        if k and k % WRITTEN == 0:
            cells = materialise(cells, "mix-rounds", few=True)
        for m in MARGINS:
            own = F.sum("final").over(Window.partitionBy(m))
            cells = cells.withColumn("final", F.when(own > 0, F.least(F.col("first"), F.col("final") * F.col(f"want_{m}") / own)).otherwise(F.lit(0.0)))
    return cells.select(*MARGINS, "first", "final")


def probabilities(docs: DataFrame, topic: Column | None = None, targets=None, alpha: float = ALPHA, keep: float = KEEP) -> DataFrame:
    """source, lang, topic, probability of each cell; nulls are written as a NUL character."""
    cells = _keyed(docs, topic).groupBy(*(F.col(f"_{m}").alias(m) for m in MARGINS)).agg(F.sum("_tokens").cast("double").alias("first"))
    cells = rake(cells, targets, alpha, keep)
    return materialise(cells.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), (F.col("final") / F.col("first")).alias("_probability")), "mix-probabilities", few=True)


def chance(column: str = "doc_id") -> Column:
    """A number in [0, 1) from the id."""
    text = F.concat(F.lit(SALT), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _sampled(docs: DataFrame, topic: Column | None, targets, alpha: float, keep: float) -> DataFrame:
    cells = probabilities(docs, topic, targets, alpha, keep)
    return _keyed(docs, topic).join(cells, [f"_{m}" for m in MARGINS]).where(chance() < F.col("_probability"))


def sample(docs: DataFrame, topic: Column | None = None, targets=None, alpha: float = ALPHA, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities keep, with their columns."""
    return _sampled(docs, topic, targets, alpha, keep).select(*docs.columns)


def op4_ipf_mixing(spark, sf_dir: str) -> DataFrame:
    """The sample: doc_id, source, lang, topic, n_tokens, probability (9 places)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = _sampled(docs, None, None, ALPHA, KEEP)
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_probability", 9).alias("probability"))


def _oracle() -> str:
    """The same in DuckDB: the rounds are written out, one common table expression for each margin."""
    ctes = [r"""keyed AS (
  SELECT doc_id, source, lang, coalesce(source, chr(0)) AS s, coalesce(lang, chr(0)) AS l, n_tokens,
    CASE WHEN (length(t) - length(replace(t, '|', ''))) * 5 > n_tokens THEN 'table'
         WHEN (length(t) - length(translate(t, '0123456789', ''))) * 10 > length(t) THEN 'numbers'
         WHEN n_tokens < 150 THEN 'short' WHEN n_tokens < 800 THEN 'medium' ELSE 'long' END AS topic
  FROM (SELECT *, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents))""",
            "c AS (SELECT s, l, topic, CAST(sum(n_tokens) AS DOUBLE) AS f FROM keyed GROUP BY ALL)"]
    for k in ("s", "l", "topic"):
        ctes.append(f"m_{k} AS (SELECT {k}, pow(sum(f), {ALPHA}) / sum(pow(sum(f), {ALPHA})) OVER () * sum(sum(f)) OVER () * {KEEP} AS want FROM c GROUP BY {k})")
    ctes.append("w0 AS (SELECT s, l, topic, f, f AS w FROM c)")
    at = 0
    for _ in range(ROUNDS):
        for k in ("s", "l", "topic"):
            ctes.append(f"w{at + 1} AS MATERIALIZED (SELECT w.s, w.l, w.topic, f, least(f, w * want / sum(w) OVER (PARTITION BY w.{k})) AS w FROM w{at} w JOIN m_{k} m ON w.{k} = m.{k})")
            at += 1
    ctes.append(f"p AS (SELECT s, l, topic, w / f AS p FROM w{at})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, k.topic, n_tokens, round(p, 9) AS probability
FROM keyed k JOIN p ON k.s = p.s AND k.l = p.l AND k.topic = p.topic
WHERE CAST(CAST('0x' || substr(md5('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} < p"""


ORACLE = _oracle()

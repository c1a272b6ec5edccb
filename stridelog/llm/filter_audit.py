"""Operator 11: how filters interact, by recursive enumeration of their orders.

Documents become mask cells first: how many of a part fail exactly which filters,
and how many of these are good or toxic by label. A recursive query then walks over
orders: a row is a prefix of filters and the bits it has applied, each recursion
level extends it by every unused letter, joins the part's cells and gives that
step's metrics. A full order's five rows are those of its prefixes.

No text is shuffled. Whether a text repeats one of a smaller id is decided by its
SHA-256: copies are added up within each task before they meet, so a group of
copies of any size is a few rows there.

Defined results: null text counts as empty, null lang as the empty string; a row
of null id neither repeats another nor is repeated, and has no label; rows of one
id and one text do not repeat each other; labels that clash are united (good or
toxic if any row says so); an empty table has no parts and gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: The letter of the filter that looks at other documents.
REPEATED = "E"
#: Rows of a recursion that Spark allows; the walk has 326 a part, so any number of parts may come.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": F.lit(100) * distinct < F.lit(80) * n, "C": F.lit(100) * capitals > F.lit(10) * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def mask_cells(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """part, mask, n, good, toxic: documents by exactly which filters they fail; bit k is the k-th letter's, the last one is REPEATED."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = filters(text)
    mask = sum((F.when(fails[x], 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    facts = docs.select(
        F.coalesce(F.col("doc_id"), F.xxhash64(text)).alias("own"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"),
    )
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("own")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marks = marks.select("own", F.lit(True).alias("known"), "good", "toxic")
    marked = facts.join(marks, ["own", "known"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    alike = ["digest", "part", "mask", "good", "toxic"]
    rows = marked.groupBy("own", "known", *alike).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("known"), F.col("own"))
    groups = rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("loose"), F.min(known).alias("least"), F.min_by("n", known).alias("at_least"))
    least = F.min("least").over(Window.partitionBy("digest"))
    firsts = groups.withColumn("first", F.coalesce(F.when(F.col("least") == least, F.col("at_least")), F.lit(0)) + F.col("loose"))
    bit = 1 << len(fails)
    cells = firsts.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("c"))
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(*[F.sum(F.when(w, F.col("c.n")).otherwise(0)).alias(x) for x, w in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]).where("n > 0")


def _total(what: str, when: str) -> str:
    return f"aggregate(filter(c.cells, x -> {when}), 0L, (s, x) -> s + x.{what})"


_HERE = "x.mask & w.applied = 0 AND x.mask & l.bit != 0"
WALK = f"""
WITH RECURSIVE walk(part, filter_order, letter, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT w.part, concat(w.filter_order, l.letter), l.letter, w.step + 1, w.applied | l.bit,
    {_total("n", "x.mask & (w.applied | l.bit) = 0")}, {_total("n", _HERE)}, {_total("n", "x.mask & w.applied != 0 AND x.mask & l.bit != 0")},
    {_total("n", "x.mask = l.bit")}, {_total("good", _HERE)}, {_total("toxic", _HERE)}
  FROM walk w JOIN {{cells}} c ON w.part = c.part
  LATERAL VIEW explode(filter({{letters}}, x -> w.applied & x.bit = 0)) u AS l
)
SELECT * FROM walk WHERE step > 0
"""


def walk(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part and each ordered choice of letters: what its last filter does after the others."""
    spark = cells.sparkSession
    by_part = materialize(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    listed = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return materialize(spark.sql(WALK.replace("{letters}", f"array({listed})"), cells=by_part))
    finally:
        spark.conf.set(ROW_LIMIT, before)


METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def interactions(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, METRICS, shapley: each step of each order of all letters."""
    steps = walk(cells, letters)
    orders = steps.where(F.col("step") == len(letters)).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    prefixes = steps.select("part", F.col("filter_order").alias("prefix"), "letter", *METRICS)
    rows = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(prefixes, ["part", "prefix"])
    return rows.select("part", "filter_order", "step", *METRICS, F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
fails AS (SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed FROM m),
cells AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, failed),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A','B','C','D','E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
  FROM (SELECT DISTINCT part FROM cells), (SELECT filter_order FROM o WHERE length(filter_order) = 5), (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT s.part, filter_order, CAST(step AS INTEGER) AS step, x,
    sum(CASE WHEN NOT hit AND NOT contains(failed, x) THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT hit AND contains(failed, x) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND contains(failed, x) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT hit AND contains(failed, x) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT hit AND contains(failed, x) THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT s.*, failed, n, good, toxic, len(list_intersect(string_split(earlier, ''), string_split(failed, ''))) > 0 AND earlier != '' AND failed != '' AS hit FROM s JOIN cells USING (part)) s
  GROUP BY s.part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))

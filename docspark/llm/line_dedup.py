"""Line dedup over windows of three lines, in DataFrame functions only.

Every three consecutive lines with text make a window, blank lines between
them ignored. A window's key is 128 bits of hash over its trimmed lines. Keys
that occur more than once are found by one aggregation that is combined before
the shuffle, so a passage that a third of all documents share is one row per
task there; the join back leaves its rows to the skew handling of sort-merge
joins. Each occurrence but the first, by document id and place, covers its
three lines; a line that any later occurrence covers is removed.

Defined results: a null text stays null, an empty one empty; a text with fewer
than three lines with text is not touched; rows are compared one by one, those
with equal ids in any order that stays, those with a null id after all others; a
document may lose all its lines and then has an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored


def windows(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) to row, place (orders windows: null ids last, doc_id,
    row, the first line's number), lines (numbers of the three lines), h1, h2."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i")))
    full = docs.where("text is not null").select("row", "doc_id", F.filter(lines, lambda x: x["t"] != "").alias("full"))
    n = F.size("full") - 2
    three = F.transform(F.slice("full", F.lit(1), F.greatest(n, F.lit(0))), lambda x, k: F.array(x, F.get("full", k + 1), F.get("full", k + 2)))
    w = full.select("row", "doc_id", F.explode(three).alias("w"))
    line = [F.col("w")[k]["t"] for k in range(3)]
    return w.select(
        "row",
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", F.col("w")[0]["i"].alias("at")).alias("place"),
        F.array(*[F.col("w")[k]["i"] for k in range(3)]).alias("lines"),
        F.xxhash64(*line).alias("h1"),
        F.xxhash64(F.lit(1), *reversed(line)).alias("h2"),
    )


def covered(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) to row, gone: the numbers of the lines that a later
    occurrence covers."""
    w = windows(docs)
    first = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    later = w.join(first.select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")), ["h1", "h2"])
    later = later.where((F.col("row") != F.col("first_row")) | (F.col("place.at") != F.col("first_at")))
    return later.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def deduplicated_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents, all columns in order, with covered lines removed from the text
    and n_chars, if there is one, of the new text. counts adds n_lines and n_removed.
    Rows are numbered and written first, so that both readings number them alike."""
    names = docs.columns
    row, gone, lines = fresh([*names, "n_lines", "n_removed"], "_row", "_gone", "_lines")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = covered(numbered.select(F.col(row).alias("row"), "doc_id", "text")).select(F.col("row").alias(row), F.col("gone").alias(gone))
    both = numbered.join(found, row, "left").withColumn(lines, F.split("text", "\n", -1))
    n, changed = F.size(lines), F.col(gone).isNotNull()
    keep = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    text = F.when(changed, F.array_join(F.transform(keep, lambda i: F.get(F.col(lines), i)), "\n")).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if counts:
        out = out.withColumns({"n_lines": n.cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")})
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*names, *(["n_lines", "n_removed"] if counts else []))


SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM cut, unnest(range(1, len(ls) + 1)) AS r(i)),
filled AS (SELECT doc_id, i, trim(line, ' ') AS t FROM lines WHERE trim(line, ' ') <> ''),
w AS (SELECT doc_id, i, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2, t || chr(10) || lead(t, 1) OVER d || chr(10) || lead(t, 2) OVER d AS k
      FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w WHERE k IS NOT NULL) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM later),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       len(string_split(d.text, chr(10))) AS n_lines, coalesce(n.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

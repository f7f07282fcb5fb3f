"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line of the corpus (by doc_id, then line number) equals it or is within one edit of it. Lines within one edit
share a deletion variant: the same characters without the one that was substituted, or the shorter line itself. Emitting every variant
of every line would multiply the text by its lines' lengths, so variants are emitted where they can meet only:

1. a line is cut into blocks; an edit lies in one of them, and all outside it agrees. The hash of that outside is the key of the block,
   for the line's own length and for one less (its length before an insertion). Keys of a single line end there;
2. for keys of different lines, the block's deletion variants are emitted as hashed keys. Variants without the same place are equal for
   substitutions; for insertions, a variant equals the block of a line that is there. So no pairs are formed: a group of equal
   variants gives its members its earliest line, by an aggregation;
3. each line with an earlier neighbour is verified by its edit distance from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Shortest line that is compared by edits; places of lines in the order of a document; live keys up to which they are broadcast.
MIN_CHARS, PLACES, SMALL = 20, 1 << 31, 1_000_000
_SPACES = " \t\r"


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACES)) == ""


def _blocks(m: Column) -> Column:
    """Blocks of a line of m characters: four, more for very long lines."""
    return F.greatest(F.lit(4), F.ceil(F.sqrt(m) / 8).cast("int"))


def _edge(m: Column, i: Column) -> Column:
    return F.floor(m.cast("long") * i / _blocks(m)).cast("int")


def _keys(line: Column, n: Column, shift: int) -> Column:
    """For each block of the line taken as having m = n - shift characters before the edit: m, its number, and the hash of all outside it."""
    m = n - F.lit(shift)

    def one(i: Column) -> Column:
        behind = m - _edge(m, i + 1)
        key = F.xxhash64(m, i, F.substring(line, F.lit(1), _edge(m, i)), F.substring(line, n - behind + 1, behind))
        return F.struct(m.alias("m"), i.alias("i"), key.alias("key"))

    return F.transform(F.sequence(F.lit(0), _blocks(m) - 1), one)


def _lines(docs: DataFrame, wide: bool, top: int) -> DataFrame:
    """at (the line's place in the corpus), line, h (its hash) of every line that isn't blank."""
    kind = "decimal(38,0)" if wide else "bigint"
    exploded = docs.select(_order(docs, wide, top).alias("o"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("l", "line"))
    rows = exploded.select((F.col("o") * F.lit(PLACES) + F.col("l")).cast(kind).alias("at"), "line", F.xxhash64("line").alias("h"))
    return rows.where(~_blank(F.col("line")))


def _order(docs: DataFrame, wide: bool, top: int) -> Column:
    kind = "decimal(20,0)" if wide else "bigint"
    return F.coalesce(docs["doc_id"].cast(kind), F.lit(top + 1).cast(kind))


def near_dropped(lines: DataFrame, min_chars: int = MIN_CHARS, small: int = SMALL) -> DataFrame:
    """Column h: lines that have an earlier one within one edit."""
    long = lines.withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    keyed = long.withColumn("b", F.explode(F.concat(_keys(F.col("line"), F.col("n"), 0), _keys(F.col("line"), F.col("n"), 1))))
    live = keyed.groupBy(F.col("b.key").alias("key")).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    live = written(live, "live")
    if live.count() <= small:
        met = keyed.withColumn("key", F.col("b.key")).join(F.broadcast(live), "key", "left_semi").select("h", "at", "line", "n", "b")
    else:
        own = keyed.select("h", "b", F.col("b.key").alias("key")).join(live, "key", "left_semi").select("h", "b").distinct()
        met = long.join(own, "h").select("h", "at", "line", "n", "b")
    groups = met.groupBy("h").agg(F.min("at").alias("at"), F.max("line").alias("line"), F.collect_set("b").alias("b"))
    groups = written(groups, "lines")
    parts = groups.select("h", "at", F.length("line").alias("n"), "line", F.explode("b").alias("b"))
    start, behind = _edge(F.col("b.m"), F.col("b.i")), F.col("b.m") - _edge(F.col("b.m"), F.col("b.i") + 1)
    parts = parts.select("h", "at", (F.col("n") == F.col("b.m")).alias("own"), F.col("b.key").alias("key"), F.substring("line", start + 1, F.col("n") - behind - start).alias("block"))
    parts = parts.withColumn("size", F.length("block")).where("size > 0 or own")
    places = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1)).otherwise(F.array().cast("array<int>"))

    def variant(p: Column) -> Column:
        place = F.when(F.col("own"), p).otherwise(F.lit(-1))
        return F.xxhash64("key", place, F.concat(F.substring("block", F.lit(1), p), F.substring("block", p + 2, F.col("size"))))

    emitted = parts.select("h", "at", "own", F.explode(F.transform(places, variant)).alias("v"))
    itself = parts.where("own").select("h", "at", F.xxhash64("key", F.lit(-1), "block").alias("v"))
    subs, longer = emitted.where("own").drop("own"), emitted.where("not own").drop("own").distinct()
    first = subs.groupBy("v").agg(F.min("at").alias("to_at"), F.min_by("h", "at").alias("to_h"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    shortest = itself.groupBy("v").agg(F.min("at").alias("to_at"), F.min_by("h", "at").alias("to_h"))
    longest = longer.groupBy("v").agg(F.min("at").alias("to_at"), F.min_by("h", "at").alias("to_h"))
    found = subs.join(first, "v").select("h", "at", "to_h", "to_at")
    found = found.unionByName(longer.join(shortest, "v").select("h", "at", "to_h", "to_at"))
    found = found.unionByName(itself.join(longest, "v").select("h", "at", "to_h", "to_at"))
    near = found.where("to_at < at").groupBy("h").agg(F.min_by("to_h", "to_at").alias("to_h"))
    texts = groups.select("h", "line")
    pairs = near.join(texts, "h").join(texts.select(F.col("h").alias("to_h"), F.col("line").alias("to_line")), "to_h")
    return pairs.where(F.levenshtein("line", "to_line", 1).between(0, 1)).select("h")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, counts: bool = False, small: int = SMALL) -> DataFrame:
    """``docs`` with duplicate lines removed from ``text`` (and ``n_chars``, where there is one, set to its new length).

    A line (between line feeds) goes if an equal one is earlier, by doc_id and line number, or, from ``min_chars`` characters on, one
    within one edit. Blank lines always stay. A null text stays null, an empty one empty; a text that loses all lines becomes empty.
    Null ids come after all others. Rows with one id hold the same places, and lines at one place never remove each other, so that
    repeated rows stay equal. An empty table gives none. All other columns pass through, whatever their names; ``counts`` adds n_lines
    and n_removed.
    """
    low, top = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    low, top = 0 if low is None else low, -1 if top is None else top
    wide = low < 0 or top >= (1 << 32) - 2
    lines = _lines(docs, wide, top)
    first = lines.groupBy("h").agg(F.min("at").alias("at"))
    kept = first.join(near_dropped(lines, min_chars, small), "h", "left_anti")
    kept = kept.select(F.floor(F.col("at") / PLACES if wide else F.shiftright("at", 31)).cast("decimal(20,0)" if wide else "bigint").alias("o"), F.pmod(F.col("at"), F.lit(PLACES)).cast("int").alias("l"), "h")
    kept = kept.groupBy("o").agg(F.collect_list(F.struct("l", "h")).alias("kept"))
    rows = docs.select(F.struct("*").alias("r"), _order(docs, wide, top).alias("o")).join(kept, "o", "left")
    rows = rows.select("r", F.coalesce("kept", F.array().cast("array<struct<l:int,h:bigint>>")).alias("kept"), F.split(F.col("r.text").cast("string"), "\n").alias("lines"))
    line = lambda i: F.get("lines", i)
    blanks = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _blank(line(i)))
    own = F.transform(F.filter("kept", lambda k: F.xxhash64(line(k["l"])) == k["h"]), lambda k: k["l"])
    rows = rows.select("r", "lines", F.array_sort(F.concat(blanks, own)).alias("places"))
    text = F.array_join(F.transform("places", line), "\n")
    rows = rows.select("r", F.size("lines").alias("n_lines"), F.size("places").alias("n_kept"), text.alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new")}
    kinds = dict(docs.dtypes)
    out = [new[c].cast(kinds[c]).alias(c) if c in new else F.col(f"r.`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.col("new").isNotNull(), F.col("n_lines")).otherwise(0).cast("long")
        out += [n.alias("n_lines"), F.when(F.col("new").isNotNull(), F.col("n_lines") - F.col("n_kept")).otherwise(0).cast("long").alias("n_removed")]
    return rows.select(*out)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=True)


ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS l FROM split),
marked AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM lines),
firsts AS (
  SELECT line, min((doc_id, l)) AS at, length(line) AS n FROM marked WHERE NOT blank GROUP BY line),
pairs AS (
  SELECT a.line AS x, b.line AS y, a.n AS n, b.n AS m FROM firsts a JOIN firsts b
    ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, b.n // 2) AND b.at < a.at AND a.n >= 20
  UNION SELECT a.line, b.line, a.n, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n AND right(a.line, a.n - a.n // 2) = right(b.line, b.n - b.n // 2) AND b.at < a.at AND a.n >= 20
  UNION SELECT a.line, b.line, a.n, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n + 1 AND left(a.line, b.n // 2) = left(b.line, b.n // 2) AND b.at < a.at AND b.n >= 20
  UNION SELECT a.line, b.line, a.n, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n + 1 AND right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2) AND b.at < a.at AND b.n >= 20
  UNION SELECT a.line, b.line, a.n, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n - 1 AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND b.at < a.at AND a.n >= 20
  UNION SELECT a.line, b.line, a.n, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n - 1 AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND b.at < a.at AND a.n >= 20),
near AS (
  SELECT DISTINCT x AS line FROM pairs
  WHERE len(list_filter(range(greatest(n, m)), lambda p: CASE
    WHEN n = m THEN left(x, p) = left(y, p) AND substr(x, p + 2) = substr(y, p + 2)
    WHEN n > m THEN left(x, p) || substr(x, p + 2) = y
    ELSE left(y, p) || substr(y, p + 2) = x END)) > 0),
kept AS (
  SELECT k.doc_id, k.l, k.line FROM marked k LEFT JOIN firsts f ON f.line = k.line
  WHERE k.blank OR (f.at = (k.doc_id, k.l) AND k.line NOT IN (SELECT line FROM near)))
SELECT s.doc_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.l), '') AS text,
       CAST(any_value(len(s.ls)) AS BIGINT) AS n_lines, CAST(any_value(len(s.ls)) - count(k.l) AS BIGINT) AS n_removed
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id GROUP BY s.doc_id
"""

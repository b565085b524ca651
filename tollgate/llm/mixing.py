"""Mixing sources to target weights: hash-random order, prefix sums of sizes, exact budget cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import positions
from .common import buckets_for, gather, materialize

#: Words of a text, as the size of a document.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources get in turn, in code point order with null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens of the mix as a share of all tokens, and the most epochs of one source.
SHARE, MOST = 1.5, 2.0
#: Rows of one source that one task sorts at most, on average.
ROWS_PER_BUCKET = 50_000
#: Equal rows that one task writes out at most.
COPIES = 10_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one row a source: (g_source, source_size, target).

    ``share`` of all sizes is dealt by weight, none above ``most`` times its size. What a capped
    source leaves is dealt again by weight among the others until none is above. If all are capped,
    less than ``share`` is dealt. Any number of sources: their places in the order come from a range
    sort, and each round of dealing needs the sums over the sources capped so far alone.
    """
    placed = positions(sizes.select("source", "source_size"), F.col("source").isNull(), F.col("source"), name="place")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(placed.select("source", "source_size", turn.alias("weight")), "weights")
    cap = F.lit(float(most)) * F.col("source_size")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    left, by, free = total, rows.agg(F.sum("weight")).first()[0] or 1.0, None
    dealt = lambda: F.lit(float(left)) * F.col("weight") / F.lit(float(by))
    capped = F.lit(False)
    while True:
        capped = capped | (dealt() > cap)
        got = rows.agg(F.count_if(~capped).alias("free"), F.sum(F.when(capped, F.col("source_size"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("by")).first()
        # A capped source stays so: what the others get only rises.
        if got["free"] == free or not got["free"]:
            break
        free, left, by = got["free"], total - most * (got["held"] or 0), got["by"]
    target = F.when(capped, cap).otherwise(dealt())
    return materialize(rows.select(F.col("source").alias("g_source"), "source_size", target.alias("target")), "targets")


def _key(seed: int, doc_id: str = "doc_id") -> Column:
    """Hash-random key of a document, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _mark(text: Column) -> Column:
    """What tells documents of one id apart; null for a null text."""
    return F.md5(text.cast("binary"))


def _plan(docs: DataFrame, seed: int, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for equal rows: (doc_id, source, size, mark, key, n, source_size, target, epochs, part).

    Whole epochs of each of the n rows, and ``part`` words more of each in the last epoch.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark"))
    rows = rows.groupBy("source", "doc_id", "mark", "size").agg(F.count("*").alias("n"))
    rows = gather(rows.withColumn("key", _key(seed)), "sizes")
    words = F.col("n") * F.col("size")
    per_source = materialize(rows.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("rows")), "sources")
    ranges = buckets_for(per_source.agg(F.max("rows")).first()[0] or 0, ROWS_PER_BUCKET, docs.sparkSession.sparkContext.defaultParallelism * 4)
    goals = targets(per_source, weights, share, most)
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(float(16**8)))
    rows = rows.withColumn("range", at.cast("int"))
    sums = rows.groupBy("source", "range").agg(F.sum(words).alias("in_range"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), F.coalesce(F.sum("in_range").over(upto), F.lit(0)).alias("earlier"))
    sums = materialize(sums.join(goals, F.col("s_source").eqNullSafe(F.col("g_source"))).drop("g_source"), "ranges")
    own = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), F.col("mark").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(words).over(own), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    budget = F.least(F.round("target").cast("long"), (F.lit(most) * F.col("source_size")).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("budget", budget).withColumn("epochs", epochs)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("earlier") - F.col("before")
    rows = rows.withColumn("rest", F.greatest(F.lit(0), F.least(words, rest)))
    return rows.select("doc_id", "source", "size", "mark", "key", "n", "source_size", "target", "epochs", F.expr("rest div n").alias("part"))


def mix(docs: DataFrame, seed: int = 42, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """What the mix takes of each document: (doc_id, size, source_size, target, taken, source).

    Each document gets the hash-random key md5(seed:doc_id). Within a source the keys' leading bits
    cut the documents into equal ranges, which stay in order from range to range; each range is
    sorted by (key, doc_id, md5 of the text), and sizes before a document are the sums of earlier
    ranges plus a running sum in its own. A source takes round(target) words: whole epochs of every
    document, then documents in that order, the last one cut at the exact budget. Equal rows are
    counted before anything is sorted and share what falls to them evenly, so only at them the budget
    may be missed, by less than a word each. The hot source is spread over as many ranges as its rows
    need; neither it nor an id that many rows share meets in one task.

    One row per input row. Null text has size 0; null source is a source of its own, the last; null
    doc_id sorts first, its key being md5(seed:). Texts of any length are counted whole. No rows give
    no rows. Other columns, of whatever name, are not read.
    """
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    rows = _plan(docs, seed, weights, share, most).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "n")
    rows = gather(rows, "taken")
    each = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    few = rows.where(F.col("n") <= COPIES).withColumn("i", each(F.col("n")))
    # Many equal rows are written again by many tasks.
    many = rows.where(F.col("n") > COPIES).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    many = many.repartition("j").withColumn("i", each(F.least(F.lit(COPIES), F.col("n") - F.col("j") * COPIES))).drop("j")
    return few.unionByName(many).drop("n", "i")


def mixed(docs: DataFrame, seed: int = 42, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as ``mix`` takes it, all columns as they are.

    A source's last document of its last epoch has its text cut after the words that the budget
    leaves. As the order is that of the keys, one row per source decides, and no text moves.
    Documents without words, or of which nothing is taken, are left out. Copies of a document share
    its doc_id. Edge cases are those of ``mix``.
    """
    plan = _plan(docs, seed, weights, share, most)
    name = ("key", "doc_id", "mark")
    last = F.max(F.when(F.col("part") > 0, F.struct(*name, "part"))).alias("last")
    cuts = plan.groupBy("source").agg(F.max("epochs").alias("epochs"), last)
    cuts = materialize(cuts.select(F.col("source").alias("c_source"), "epochs", "last"), "cuts")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("d_source"), _key(seed).alias("key"), "doc_id", _mark(F.col("text")).alias("mark"), word_count(F.col("text")).alias("size"))
    rows = rows.where("size > 0").join(cuts, F.col("d_source").eqNullSafe(F.col("c_source")))
    me, end = F.struct(*name), F.struct(*[f"last.{c}" for c in name])
    part = F.when(F.col("last").isNull() | (me > end), 0).when(me == end, F.col("last.part")).otherwise(F.col("size"))
    rows = rows.withColumn("part", part).withColumn("copies", (F.col("epochs") + (F.col("part") > 0).cast("int")).cast("int")).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    pieces = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", F.col("part").cast("int") + 1)
    text = F.when((F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size")), F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    rows = rows.withColumn("cut", text)
    return rows.select(*[F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def oracle(seed: int = 42) -> str:
    """The same rows in DuckDB SQL; the water-filling repeats for more rounds than there are sources to cap."""
    rounds = "".join(
        f""", cap{k} AS (SELECT * REPLACE (capped OR t > {MOST} * source_size AS capped) FROM deal{k - 1}),
 deal{k} AS (SELECT * REPLACE (CASE WHEN capped THEN {MOST} * source_size ELSE
   ({SHARE} * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum({MOST} * source_size) FROM cap{k} WHERE capped), 0)) * weight
   / (SELECT sum(weight) FROM cap{k} WHERE NOT capped) END AS t) FROM cap{k})"""
        for k in range(1, 9)
    )
    return f"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
   md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(text) AS m FROM documents),
 g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
 w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM g),
 deal0 AS (SELECT *, false AS capped, {SHARE} * (SELECT sum(source_size) FROM w) * weight / (SELECT sum(weight) FROM w) AS t FROM w){rounds},
 goal AS (SELECT *, CAST(round(t) AS BIGINT) AS budget FROM deal8),
 u AS (SELECT source, doc_id, m, k, size, count(*) AS n FROM s GROUP BY ALL),
 o AS (SELECT u.*, g.source_size, g.t AS target, g.budget, CASE WHEN g.source_size > 0 THEN g.budget // g.source_size ELSE 0 END AS epochs,
   coalesce(sum(u.n * u.size) OVER (PARTITION BY u.source ORDER BY u.k, u.doc_id NULLS FIRST, u.m NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM u JOIN goal g ON u.source IS NOT DISTINCT FROM g.source),
 p AS (SELECT *, CAST(epochs * size + greatest(0, least(n * size, budget - epochs * source_size - before)) // n AS BIGINT) AS taken, unnest(range(n)) AS i FROM o)
SELECT doc_id, size, source_size, target, taken, source FROM p"""

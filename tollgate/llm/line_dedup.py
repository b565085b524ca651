"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, union-find.

DataFrame operations only. Lines are told apart by two 64-bit hashes, and each distinct one gets a
number of its own; texts move only for lines that share a band with another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import Scope, discard
from .common import gather, materialize, parted, passing

#: Characters of a shingle; one starts at every run of non-space characters and, while the run goes on for 12 more, at each next character. So all are covered, and an inserted character moves no other shingle.
WIDTH = 12
#: Similarity of two lines that are copies; bands of the signature, two rows each.
SIMILAR, BANDS = 0.8, 8
#: Members of a bucket up to which those that its pivot leaves open are compared pair by pair.
SMALL = 20
#: Writing systems without spaces between words: a shingle starts at every character.
_DENSE = r"⺀-鿿가-힯豈-﫿\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u1950-\u19DF\u1A20-\u1AAF\uA9E0-\uA9FF\uAA60-\uAA7F"
_HEAD = rf"(?s)(?=(\S.{{0,{WIDTH - 1}}}))"
#: The pattern of a shingle in lines without such characters, which is far faster, and in others; both agree on the former.
SHINGLE = rf"{_HEAD}(?:\S{{1,{WIDTH}}}+(?!\S)|\S)"
SHINGLE_DENSE = rf"{_HEAD}(?:[{_DENSE}]|[^\s{_DENSE}](?=[^\s{_DENSE}]{{{WIDTH}}})|[^\s{_DENSE}]{{1,{WIDTH}}})"
#: A line's rank: its weight above, and its number below, made of the place in its partition and the partition.
_PLACE_BITS, _PART_BITS = 33, 17
_WEIGHT = (1 << 63 - _PLACE_BITS - _PART_BITS) - 1


def _dense(line: str) -> Column:
    """Whether a line holds dense scripts; the first two tests are cheap, and most lines end there."""
    found = (F.octet_length(line) > F.char_length(line)) & F.col(line).rlike(r"[\u0E00-\uFFFF]") & F.col(line).rlike(f"[{_DENSE}]")
    return F.coalesce(found, F.lit(False))


def _texts(line: str) -> Column:
    """Shingles of a line column, repeats included."""
    return F.when(_dense(line), F.regexp_extract_all(line, F.lit(SHINGLE_DENSE), F.lit(1))).otherwise(F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1)))


def shingles(line: str) -> Column:
    """Distinct shingle hashes of a line column, at least one for a line with a non-space character."""
    return F.array_distinct(F.transform(_texts(line), lambda s: F.xxhash64(s)))


def identity(docs: DataFrame) -> Column:
    """A hash of a row's columns, which tells documents of one doc_id apart; rows equal in it are repeated rows. Maps and variants have no hash and are left out."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def lines(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """(doc_id, t, line_no from 0, line, k1, k2) of every line, in lower case.

    t tells rows of one doc_id apart: ``mark``, by default the row's ``identity``. It is told before the
    lines are made, or it would be told again for each.
    """
    rows = docs.select("doc_id", (identity(docs) if mark is None else mark).alias("t"), "text")
    rows = rows.select("doc_id", "t", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    return rows.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _place() -> Column:
    """A hash of a line's place: documents that are told apart by (doc_id, t) have no two lines of one place."""
    return F.xxhash64("doc_id", "t", "line_no")


def signatures(rows: DataFrame) -> DataFrame:
    """(k1, k2, o, copies, r, b0 ...) of each distinct line, written: band keys of its MinHash signature, and a rank.

    o names one of the line's occurrences, by a hash of its place.

    A signature's entry is the least hash of the line's shingles under the entry's own hash function,
    half of a 64-bit hash, which two lines share with a probability of their Jaccard similarity. A
    band joins two entries. Equal lines are merged by the same aggregation; lines of white space have
    no shingle and so no row. The rank r is the line's own number, no other line has it, and rises
    with the line's shingles in all its copies, up to 8191.
    """
    rows = rows.select("k1", "k2", _place().alias("o"), F.posexplode(_texts("line")).alias("i", "s"))
    rows = rows.select("k1", "k2", "o", "i", F.xxhash64("s").alias("h"))
    rows = rows.select("k1", "k2", "o", "i", *[F.xxhash64(F.lit(b), "h").alias(f"h{b}") for b in range(BANDS)])
    halves = [f(f"h{b}").alias(f"{n}{b}") for b in range(BANDS) for n, f in (("lo", lambda c: F.min(F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))), ("hi", lambda c: F.min(F.shiftrightunsigned(c, 32))))]
    rows = rows.groupBy("k1", "k2").agg(F.count("*").alias("w"), F.count_if(F.col("i") == 0).alias("copies"), F.min("o").alias("o"), *halves)
    part = F.shiftright("n", _PLACE_BITS)
    part = F.when(part < 1 << _PART_BITS, part).otherwise(F.raise_error(F.lit("more partitions than ranks have room for")).cast("long"))
    low = F.shiftleft(part, _PLACE_BITS).bitwiseOR(F.col("n").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    rank = F.shiftleft(F.least("w", F.lit(_WEIGHT)), _PLACE_BITS + _PART_BITS).bitwiseOR(low)
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    return materialize(rows.select("k1", "k2", "o", "copies", rank.alias("r"), *[F.xxhash64(F.lit(b), f"lo{b}", f"hi{b}").alias(f"b{b}") for b in range(BANDS)]), "signatures")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of candidate pairs (x, y) of ranks: (x, y, jaccard)."""
    one, two = (sets.select(F.col("r").alias(f"{c}_r"), F.col("s").alias(f"{c}_s")) for c in "ab")
    found = pairs.join(one, F.col("x") == F.col("a_r")).join(two, F.col("y") == F.col("b_r"))
    found = found.select("x", "y", F.size(F.array_intersect("a_s", "b_s")).alias("both"), (F.size("a_s") + F.size("b_s")).alias("sum"))
    return found.select("x", "y", (F.col("both") / (F.col("sum") - F.col("both"))).alias("jaccard"))


def _hubs(compared: DataFrame) -> DataFrame:
    """(x, hub), written: a line of a higher rank that x is linked to, by up to three steps up. Lines of one hub are connected.

    Each step is written before it is joined, so a hub of many lines is a join side that can be split.
    """
    up = gather(compared.where(F.col("jaccard") >= SIMILAR).groupBy("x").agg(F.max("y").alias("hub")).where("hub > x"), "up")
    for _ in range(2):
        top = up.select(F.col("x").alias("t_x"), F.col("hub").alias("t_hub"))
        up = gather(up.join(top, F.col("hub") == F.col("t_x"), "left").select("x", F.coalesce("t_hub", "hub").alias("hub")), "up")
    return up


def _rare_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of ``sets(r, s, hub, open)`` that may reach the similarity, x open, of different hubs.

    Exact prefix and position filtering: in one order of all shingles, rarest first, two similar
    lines share one among the first n - ceil(0.8 n) + 1 of each. What two lines have in common beyond
    their first common shingle is bounded by what follows it in either, so lines whose own shingles
    come first seldom meet, though all of a group share the rest.
    """
    rows = materialize(sets.select("r", "hub", "open", F.size("s").alias("n"), F.explode("s").alias("s")), "shingles")
    often = rows.groupBy("s").agg(F.count("*").alias("often"), F.max("open").alias("asked"), F.min("n").alias("least"))
    rows = rows.join(materialize(often.withColumnRenamed("s", "o_s"), "often"), F.col("s") == F.col("o_s"))
    place = F.row_number().over(Window.partitionBy("r").orderBy("often", "s"))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9) + 1)
    # Two lines of n and m shingles are similar if they share (n + m) * 0.8 / 1.8 of them.
    half = SIMILAR / (1 + SIMILAR)
    useful = 1 + F.col("n") - F.col("place") >= (F.col("n") + F.greatest(F.col("least"), F.col("n") * SIMILAR)) * half - 1e-9
    rows = gather(rows.where(useful & F.expr("often > 1 and asked")).select("r", "hub", "open", "n", "s", "place"), "prefixes")
    x = rows.where("open").select(F.col("r").alias("x"), F.col("hub").alias("x_hub"), F.col("n").alias("x_n"), "s", F.col("place").alias("x_at"))
    y = rows.select(F.col("r").alias("y"), F.col("hub").alias("y_hub"), F.col("n").alias("y_n"), "s", F.col("place").alias("y_at"), "open")
    common = 1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= (F.col("x_n") + F.col("y_n")) * half - 1e-9
    both = x.alias("p").join(y.alias("q"), (F.col("p.s") == F.col("q.s")) & (F.col("x_hub") != F.col("y_hub")) & common & ((F.col("x") < F.col("y")) | (~F.col("open") & (F.col("x") != F.col("y")))))
    return both.select("x", "y").distinct()


def line_links(rows: DataFrame, signed: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """``_line_links``, written; the tables on the way are deleted, and ``signed`` as soon as it is read if this is its ``last`` use."""
    with Scope(rows.sparkSession) as scope:
        links, named = _line_links(rows, signed, last)
        links = gather(links, "links")
    scope.release([*links.inputFiles(), *named.inputFiles()])
    return links, named


def _line_links(rows: DataFrame, signed: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) between distinct lines of a similarity of 0.8 or more, by rank, and (n_k1, n_k2, r) of the lines in them.

    ``signed`` are the lines' signatures. Lines that share a band form a bucket. Every member is
    compared with the bucket's line of the highest rank, its pivot, usually the most copied one, so a
    large bucket costs its size and not its square. Where that leaves a member open and not all of
    the bucket is known to be connected, a small bucket's pairs follow that the triangle inequality
    of Jaccard distances does not exclude; a larger bucket is searched again as a whole by exact
    prefix filtering. So no link inside a bucket is lost. Every link is verified on the lines'
    shingle sets.
    """
    bands = signed.select("r", F.explode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.max("r").alias("pivot")).where("n > 1").select("key", "pivot")
    buckets = gather(buckets, "buckets")
    members = passing(bands, buckets.select("key"), "key").join(buckets.withColumnRenamed("key", "b_key"), F.col("key") == F.col("b_key"))
    members = materialize(members.where("r != pivot").select("key", "r", "pivot"), "members")
    discard(buckets)
    pairs = materialize(members.select(F.col("r").alias("x"), F.col("pivot").alias("y")).distinct(), "pairs")
    ranks = pairs.select(F.col("x").alias("r")).unionByName(pairs.select(F.col("y").alias("r")).distinct())
    named = passing(signed.select(F.col("k1").alias("n_k1"), F.col("k2").alias("n_k2"), F.col("o").alias("n_o"), "r"), ranks, "r")
    named = gather(named, "named")
    if last:
        discard(signed)
    # One occurrence of each line gives its shingles.
    sets = passing(rows.select("k1", "k2", "line", _place().alias("o")), named.select(F.col("n_o").alias("o")), "o")
    sets = sets.join(named, (F.col("k1") == F.col("n_k1")) & (F.col("k2") == F.col("n_k2")) & (F.col("o") == F.col("n_o")))
    sets = materialize(sets.select("r", shingles("line").alias("s")), "lines")
    first = gather(_verified(pairs, sets), "verified")
    discard(pairs)
    links = first.where(F.col("jaccard") >= SIMILAR).select("x", "y")
    seen = first.select(F.col("x").alias("f_x"), F.col("y").alias("f_y"), "jaccard")
    hubs = _hubs(first)
    told = members.join(seen, (F.col("r") == F.col("f_x")) & (F.col("pivot") == F.col("f_y"))).select("key", "r", "pivot", "jaccard")
    for of in ("r", "pivot"):
        top = hubs.select(F.col("x").alias("h_x"), F.col("hub").alias("h"))
        told = told.join(top, F.col(of) == F.col("h_x"), "left").withColumn(f"{of}_hub", F.coalesce("h", of)).drop("h_x", "h")
    told = materialize(told, "compared")
    discard(members)
    sides = [f(g("r_hub", "pivot_hub")) for f, g in ((F.min, F.least), (F.max, F.greatest))]
    left = told.groupBy("key").agg(F.count("*").alias("n"), F.min("jaccard").alias("least"), sides[0].alias("lo"), sides[1].alias("hi"))
    left = materialize(left.where((F.col("n") > 1) & (F.col("least") < SIMILAR) & (F.col("lo") != F.col("hi"))).select(F.col("key").alias("o_key"), (F.col("n") <= SMALL).alias("few")), "open")
    again = materialize(told.join(left, F.col("key") == F.col("o_key")).drop("o_key"), "again")
    few, many = again.where("few"), again.where("not few")
    x, y = few.where(F.col("jaccard") < SIMILAR).alias("x"), few.alias("y")
    near = F.abs(F.col("x.jaccard") - F.col("y.jaccard")) <= 1 - SIMILAR + 1e-9
    once = (F.col("y.jaccard") >= SIMILAR) | (F.col("x.r") < F.col("y.r"))
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.r_hub") != F.col("y.r_hub")) & near & once).select(F.col("x.r").alias("x"), F.col("y.r").alias("y")).distinct()
    # Each reading of the sets is written by itself, so no two of their shuffles are on disk at once.
    similar = lambda pairs: gather(_verified(pairs, sets).where(F.col("jaccard") >= SIMILAR).select("x", "y"), "second")
    links = links.unionByName(similar(more))
    if not many.isEmpty():
        opened = F.max((F.col("jaccard") < SIMILAR).cast("int"))
        whole = many.select("r", F.col("r_hub").alias("hub"), "jaccard").unionByName(many.select(F.col("pivot").alias("r"), F.col("pivot_hub").alias("hub"), F.lit(1.0).alias("jaccard")))
        whole = whole.groupBy(F.col("r").alias("w_r"), "hub").agg((opened == 1).alias("open"))
        links = links.unionByName(similar(_rare_pairs(sets.join(whole, F.col("r") == F.col("w_r")))))
    return links, named


def dropped_lines(docs: DataFrame, mark: Column) -> DataFrame:
    """(x_id, x_t, drops), written: the numbers of the lines that each document loses, for documents that lose any.

    Of each component of similar lines the one of the least (doc_id, mark, line_no) stays; a null
    doc_id sorts first. No two rows of ``docs`` are equal in doc_id and ``mark``.
    """
    rows = lines(docs, mark)
    signed = signatures(rows)
    copied = gather(signed.where("copies > 1").select("k1"), "copied")
    links, named = line_links(rows, signed, True)
    found = components(links, "x", "y")
    labels = found.join(named, F.col("node") == F.col("r")).select(F.col("n_k1").alias("l_k1"), F.col("n_k2").alias("l_k2"), "component")
    labels = materialize(labels, "labels")
    several = gather(copied.unionByName(labels.select(F.col("l_k1").alias("k1"))), "several")
    seen = passing(rows.select("doc_id", "t", "line_no", "line", "k1", "k2"), several, "k1").where(F.col("line").rlike(r"\S"))
    seen = materialize(seen.select("doc_id", "t", "line_no", "k1", "k2"), "occurrences")
    firsts = seen.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t", "line_no")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.join(labels, (F.col("k1") == F.col("l_k1")) & (F.col("k2") == F.col("l_k2")), "left")
    firsts = materialize(firsts.where("n > 1 or component is not null").select("k1", "k2", "first", "component"), "firsts")
    heads = firsts.where("component is not null").groupBy(F.col("component").alias("h")).agg(F.min("first").alias("head"))
    heads = materialize(heads, "components")  # so that the join has exchanges of its own and a hot component can be split
    firsts = firsts.join(heads, F.col("component") == F.col("h"), "left")
    keep = firsts.select(F.col("k1").alias("f_k1"), F.col("k2").alias("f_k2"), F.coalesce("head", "first").alias("keep"))
    keep = materialize(keep, "heads")
    repeated = seen.join(keep, (F.col("k1") == F.col("f_k1")) & (F.col("k2") == F.col("f_k2")))
    lost = repeated.where(~F.struct("doc_id", "t", "line_no").eqNullSafe(F.col("keep")))
    return materialize(lost.groupBy(F.col("doc_id").alias("x_id"), F.col("t").alias("x_t")).agg(F.array_sort(F.collect_set("line_no")).alias("drops")), "drops")


def _told(docs: DataFrame, payload: Sequence[Column], texts: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows (row, drops), ``row`` holding ``payload``, of documents that occur once and of one of each repeated row; and (row, n) of the latter's others, whole.

    ``drops`` is null for a document that loses no line. Where ids repeat, rows are told apart by their
    identities; repeated rows are found by a count of these, and one of each is picked where the rows
    lie before anything is joined. Where no id repeats, nothing need be told apart. If the payload has
    the ``texts``, only rows that may lose a line are moved.
    """
    apart = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    mark = lambda d: identity(d) if apart else F.lit(0).cast("long")
    more = again = None
    if apart:
        ids = docs.select(F.col("doc_id").alias("r_id"), identity(docs).alias("r_t"))
        again = gather(ids.groupBy("r_id", "r_t").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if again is not None and not again.isEmpty():
        whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), identity(docs).alias("d_t"))
        same = F.col("d_id").eqNullSafe(F.col("r_id")) & (F.col("d_t") == F.col("r_t"))
        some = whole.join(again, same).groupBy("d_id", "d_t").agg(F.first("row").alias("row"), F.first("n").alias("n"))
        some = materialize(some, "repeats")
        docs = whole.join(again, same, "left_anti").select("row.*").unionByName(some.select("row.*"))
        more = some.select("row", (F.col("n") - 1).alias("n"))
    drops = dropped_lines(docs, mark(docs))
    keyed = docs.select(F.struct(*payload).alias("row"), F.col("doc_id").alias("d_id"), mark(docs).alias("d_t"))
    joined = lambda rows: rows.join(drops, F.col("d_id").eqNullSafe(F.col("x_id")) & (F.col("d_t") == F.col("x_t")), "left").select("row", "drops")
    if not texts:
        return joined(keyed), more
    keyed = keyed.withColumn("place", F.xxhash64("d_id", "d_t"))
    some, rest = parted(keyed, drops.select(F.xxhash64("x_id", "x_t").alias("place")), "place")
    return joined(some).unionByName(rest.select("row", F.lit(None).cast("array<int>").alias("drops"))), more


#: Copies of a repeated row that one task writes at most.
_COPIES = 10_000


def _times(rows: DataFrame) -> DataFrame:
    """Each row n times."""
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _COPIES)))).repartition("j")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.lit(_COPIES), F.col("n") - F.col("j") * _COPIES).cast("int")))).drop("i", "j", "n")


def dedup_lines(docs: DataFrame, drop_empty: bool = False) -> DataFrame:
    """``docs`` with each text reduced to the lines that it keeps; all other columns as they are.

    One line of each component of similar lines stays in the whole corpus, compared in lower case;
    white-space lines stay where they are. Of rows equal in all columns one keeps lines, and the
    others keep those of white space alone. Null and empty texts stay null and empty; lines and texts
    of any length are read whole. Of equal lines that of the least doc_id stays, a null one first;
    documents that share an id are told apart by a hash of all their columns. With ``drop_empty``
    documents that had words and keep none are left out. No rows give no rows. Columns but ``doc_id``
    and ``text`` may have any name and type.
    """
    one, more = _told(docs, [F.col(f"`{c}`") for c in docs.columns], True)
    words = F.coalesce(F.col("row.text").rlike(r"\S"), F.lit(False))
    rows = one.withColumn("parts", F.split("row.text", "\n"))  # a column, or every line would split the text again
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "drops")
    text = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    rows = rows.withColumn("kept", text)
    rows = (rows.where(~words | F.col("kept").rlike(r"\S")) if drop_empty else rows).select("row", "kept")
    if more is not None:
        again = _times(more.where(~words) if drop_empty else more)
        blank = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~x.rlike(r"\S")), "\n")
        rows = rows.unionByName(again.select("row", F.when(F.col("row.text").isNotNull(), blank).alias("kept")))
    return rows.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def decisions(docs: DataFrame) -> DataFrame:
    """Per document: (doc_id, n_lines, n_dropped, dropped), the line numbers from 0 that ``dedup_lines`` leaves out.

    One row per input row. A null text has no line and an empty one a line that stays; ties, repeated
    rows, nulls and texts of any length are as in ``dedup_lines``. No rows give no rows; extra columns
    only tell rows of one doc_id apart.
    """
    n_lines = lambda text: F.greatest(F.coalesce(F.size(F.split(text, "\n")), F.lit(0)), F.lit(0)).cast("long").alias("n_lines")
    none = F.array().cast("array<int>")
    one, more = _told(docs, [F.col("doc_id"), n_lines("text")], False)
    out = one.select("row.doc_id", "row.n_lines", F.coalesce("drops", none).alias("drops"))
    if more is not None:
        every = F.filter(F.transform(F.split("row.text", "\n"), lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())
        again = _times(more.select(F.struct(F.col("row.doc_id"), n_lines("row.text"), F.coalesce(every, none).alias("drops")).alias("row"), "n"))
        out = out.unionByName(again.select("row.*"))
    return out.select("doc_id", "n_lines", F.size("drops").cast("long").alias("n_dropped"), F.array_join("drops", ",").alias("dropped"))

"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import gather, materialize, parted, small_batches

WORDS, RADIUS, SEED = 3, 3, 42
#: Bits of each of the parts whose population counts name a tile.
PARTS = (16, 16, 16, 16)
#: Fingerprints of one tile at most, on average; a fuller tile is split by hash.
TILE = 2048
_STEP = 1 << 15


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned 64-bit number; 0 where it has no words."""
    whole = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split())
    if not whole:
        return 0
    flat = np.frombuffer(whole, np.uint8)
    space = np.flatnonzero(flat == 32)
    n = len(space) + 1
    if n <= words:
        return int(xxhash.xxh64_intdigest(whole, seed))
    starts = np.concatenate(([0], space[: n - words] + 1)).tolist()
    ends = np.concatenate((space[words - 1 :], [len(flat)])).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    total = n - words + 1
    for k in range(0, total, _STEP):
        h = np.array([digest(whole[a:b], seed) for a, b in zip(starts[k : k + _STEP], ends[k : k + _STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprints(text: Column) -> Column:
    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(batch, "long")(text)


#: A tile is named by its part counts as digits of this base; a count and its neighbours stay within a digit.
_BASE = 32


def _tile(fp: str):
    """Population counts of the parts of a fingerprint column, low bits first, as one number."""
    code, at = F.lit(0), 0
    for k, bits in enumerate(PARTS):
        part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
        code = code + (F.bit_count(part).cast("int") + (_BASE - max(PARTS)) // 2) * F.lit(_BASE**k)
        at += bits
    return code


def _offsets(radius: int) -> list[int]:
    """Differences of tile numbers whose part counts differ by the radius in sum, one of each pair of opposites, and 0."""
    ball = [[]]
    for _ in PARTS:
        ball = [[*x, d] for x in ball for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return sorted(c for x in ball if (c := sum(d * _BASE**k for k, d in enumerate(x))) >= 0)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links within the radius between two tiles, as a spanning forest of them."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in range(0, len(a), 512):
        near = np.bitwise_count(a[k : k + 512, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(k, k + len(near))[:, None]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            x, y = int(a[k + i]), int(b[j])
            if (p := top(x)) != (q := top(y)):
                root[p] = q
                out.append((x, y))
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)`` at most ``radius`` bits apart.

    Tiles hold the fingerprints of equal population counts in four 16-bit parts. Two fingerprints
    differ in at least as many bits as their part counts do in sum, so every tile pair whose counts
    differ beyond the radius is skipped without loss and all others are compared exactly, by
    exclusive-or and bit counts. A pair of tiles gives a spanning forest of its links, not all of
    them, which keeps every connection and bounds what a large group of near copies yields.
    """
    if not 0 <= radius < (_BASE - max(PARTS)) // 2:
        raise ValueError(f"radius {radius} is out of range")
    keyed = prints.select("fp", _tile("fp").alias("tile"))
    sizes = keyed.groupBy("tile").agg(F.count("*").alias("n"))  # at most 17^4 rows
    split = materialize(sizes.select("tile", F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int").alias("split")), "splits")
    own = split.select(F.col("tile").alias("o_tile"), "split")
    keyed = keyed.join(F.broadcast(own), F.col("tile") == F.col("o_tile"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("split")).cast("int"))
    tiles = materialize(keyed.groupBy("tile", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    key = ["tile_a", "part_a", "tile_b", "part_b"]
    near = split.select(F.col("tile").alias("n_tile"), F.col("split").alias("n_split"))

    def side(own: str, other: str, sign: int) -> DataFrame:
        """Each part of a tile with every part of the tiles there are that can hold a link to it; each pair of parts is a key of its own."""
        offsets = F.explode(F.array(*[F.lit(sign * d) for d in _offsets(radius)])).alias("off")
        met = tiles.select(F.col("tile").alias(f"tile_{own}"), F.col("part").alias(f"part_{own}"), F.col("fps").alias(own), offsets)
        met = met.join(F.broadcast(near), F.col(f"tile_{own}") + F.col("off") == F.col("n_tile"))  # at most 17^4 rows of two numbers
        met = met.withColumn(f"tile_{other}", F.col("n_tile")).withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0), F.col("n_split") - 1)))
        return met.where("tile_a != tile_b or part_a <= part_b").select(*key, own)

    b = side("b", "a", -1).select(*[F.col(c).alias(f"{c}_") for c in key], "b")
    pairs = side("a", "b", 1).join(b, [F.col(c) == F.col(f"{c}_") for c in key])
    pairs = pairs.select("a", "b", ((F.col("tile_a") == F.col("tile_b")) & (F.col("part_a") == F.col("part_b"))).alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, same in zip(batch["a"], batch["b"], batch["same"]):
                # Bits are counted on unsigned numbers; of signed ones numpy counts those of the absolute value.
                out += _forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), same, radius)
            yield pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return pairs.mapInPandas(compare, "a long, b long")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(n_fp, root, component_id) of each distinct fingerprint of ``prints(doc_id, fp)``: its component's least fingerprint and doc_id."""
    nodes = gather(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), radius), "a", "b")
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = gather(rooted, "rooted")
    least = gather(rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("l_root"), "component_id"), "least")
    return gather(rooted.join(least, F.col("root") == F.col("l_root")).select(F.col("fp").alias("n_fp"), "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: (doc_id, fingerprint, component_id), component_id the least doc_id reachable.

    Equal fingerprints are one node, so any number of copies costs one row each. Null and empty
    texts and those of white space alone have fingerprint zero and link like any other; texts of any
    length are read whole. One row per input row, repeated rows included; rows without doc_id take
    part, but no id comes from them (a component of only such rows has a null id). No rows give no
    rows. Other columns, of whatever name, are not read.
    """
    with small_batches(docs.sparkSession):
        rows = gather(docs.select("doc_id", _fingerprints(F.col("text")).alias("fp")), "prints")
    out = rows.join(_classes(rows, radius), F.col("fp") == F.col("n_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate class, that of the least doc_id, with all columns of ``docs``.

    Of several rows with the least doc_id the one written first stays; a row without doc_id stays
    only in a class that has no doc_id. Rows are told apart by a number that they are written with,
    so neither repeated rows nor ids that several texts share keep more than one row of a class. The
    texts are fingerprinted once, and those of rows that may go move in the last join. No rows give no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), _fingerprints(F.col("text")).alias("d_fp"))
    with small_batches(docs.sparkSession):
        rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "marked")
    ids = rows.select("n", F.col("d_id").alias("doc_id"), F.col("d_fp").alias("fp"))
    named = ids.join(_classes(ids, radius), F.col("fp") == F.col("n_fp"))
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("head"))
    heads = heads.select(F.col("head.n").alias("h_n"))
    gone = gather(ids.select("n").join(heads, F.col("n") == F.col("h_n"), "left_anti"), "gone")
    # Only rows that may go are moved.
    some, rest = parted(rows.select("row", "n"), gone, "n")
    gone = gone.select(F.col("n").alias("g_n"))
    return some.join(gone, F.col("n") == F.col("g_n"), "left_anti").unionByName(rest).select("row.*")

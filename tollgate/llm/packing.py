"""Packing documents into fixed windows by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, gather, small_batches

WINDOW, END_ID = 4096, 2
#: Rows that one task ranks at most, on average.
ROWS_PER_BUCKET = 50_000
#: Parts whose ids a worker remembers at most; beyond it the memory is emptied, which costs time only.
MEMORY = 200_000
#: Texts that a worker gets at once.
BATCH = 1000
#: Bytes of text that are split and encoded together, besides a last longer text.
STEP = 3_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Texts of Latin letters, digits, marks and plain white space, whose case and parts Arrow tells as the tokenizer does,
#: and what the tokenizer's own pattern sets apart from runs of letters in those; fixed values.
_PLAIN = "^[ -~\t\n\rÀ-ÖØ-öø-ÿ]*$"
_APART = "'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+"


class PartIds:
    """Ids of whole texts, with each distinct part of them encoded once.

    The tokenizer's rules never match across white space and drop it. A plain text is split by the
    tokenizer's own pattern, all texts of a step in one pass, and the step's new parts are encoded
    together, as each part's last id is one of those that end a word. Any other text goes to the
    tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self._end = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
        self._end[ends] = True
        self.forget()

    def forget(self) -> None:
        self._slot: dict[str, int] = {"": 0}
        self._flat, self._start = np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _slots(self, parts: list[str]) -> np.ndarray:
        """Numbers of distinct parts, the new ones encoded."""
        if len(self._slot) > MEMORY:
            self.forget()
        new = [p for p in parts if p not in self._slot]
        if new:
            ids = self._encode(" ".join(new))
            cuts = np.flatnonzero(self._end[ids]) + 1
            if len(cuts) != len(new) or cuts[-1] != len(ids):
                each = [self._encode(p) for p in new]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            self._slot.update(zip(new, range(len(self._slot), len(self._slot) + len(new))))
            self._start = np.concatenate([self._start, len(self._flat) + cuts])
            self._flat = np.concatenate([self._flat, ids])
        return np.fromiter(map(self._slot.__getitem__, parts), np.int64, len(parts))

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \0 ")
        lists = pc.ascii_split_whitespace(marked)
        parts = lists.flatten().dictionary_encode()
        slot = self._slots(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        size = (self._start[1:] - self._start[:-1])[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self._flat[np.repeat(self._start[slot] - before[:-1], size) + np.arange(before[-1])]
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return np.split(ids, before[edges[1:-1]]) if len(texts) > 1 else [ids]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text in turn; none for null."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // STEP)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            some = pc.fill_null(texts.slice(a, b - a), "")
            plain = pc.and_not(pc.match_substring_regex(some, _PLAIN), pc.match_substring(some, "<|"))
            easy = some.filter(plain)
            done = iter(self._plain(easy) if len(easy) else [])
            for k, on in enumerate(plain.to_pylist()):
                yield next(done) if on else self._encode(some[k].as_py())


def powers(length: int) -> list[int]:
    """The powers of two that a length is the sum of, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


_WORKER: dict[str, PartIds] = {}


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Cut each document's ids, its end id included, at every ``window`` ids: one row per piece.

    (doc_id, row, start, length, doc_tokens, crcs): row is the input row's own number, crcs are the checksums of the whole piece and then of
    each of its power-of-two parts, largest first, for a later cut there. Texts of any length are
    read whole; null text is empty and gives the end id alone.
    """
    tail = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORKER.get(path) or _WORKER.setdefault(path, PartIds(path))
        for batch in batches:
            out = []
            for doc, row, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), words.ids(batch.column(1))):
                ids = np.concatenate([own, tail]).tobytes()
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    crcs, at = [zlib.crc32(part)], 0
                    if len(part) < 4 * window:
                        for p in powers(len(part) // 4):
                            crcs.append(zlib.crc32(part[at : at + 4 * p]))
                            at += 4 * p
                    out.append((doc, row, start, len(part) // 4, n, crcs))
            if out:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "row", "start", "length", "doc_tokens", "crcs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, "doc_id long, row long, start long, length long, doc_tokens long, crcs array<long>")


def _fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths that comes closest to ``window`` from below: bitset subset sums, backtracked.

    Holds the longest length left, so that long pieces aren't left over. Each length's count is
    dealt as 1, 2, 4 ... copies, which reach every number up to it; bit s of a set is on if sum s
    can be made. One bitset is kept per step, and walking back through them gives the counts.
    """
    first = max(counts)
    full = (1 << window + 1) - 1
    reach, steps = 1 << first, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), window // length)
        copies = 1
        while left > 0:
            take = min(copies, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & full
            if reach >> window & 1:
                break
            left -= take
            copies *= 2
        if reach >> window & 1:
            break
    at = reach.bit_length() - 1
    out = {first: 1}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def minimum_slack(lengths: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Plan for a histogram of lengths: (times, {length: pieces}) patterns that use every piece once.

    Each pattern fills a window as closely as the lengths left allow and is used as often as they
    last. Works on the histogram alone, which has at most ``window`` entries for any input.
    """
    left = {int(k): int(v) for k, v in lengths.items() if v > 0}
    if any(not 0 < k <= window for k in left):
        raise ValueError("a piece is longer than the window")
    plan = []
    while left:
        best = _fullest(left, window)
        times = min(left[k] // n for k, n in best.items())
        plan.append((times, best))
        for k, n in best.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def _dissolve(plan: list[tuple[int, dict[int, int]]], window: int) -> list[tuple[bool, int, dict[int, int]]]:
    """Split a plan into full windows of whole pieces, and windows of the power-of-two parts of all other pieces.

    Parts of powers of two, taken from the largest, fill windows without slack; the last window is
    cut down to sequences of a power of two each. Rows: (whole pieces, times, {length: pieces}).
    """
    out = [(True, t, p) for t, p in plan if sum(k * n for k, n in p.items()) == window]
    parts: dict[int, int] = {}
    for t, p in plan:
        if sum(k * n for k, n in p.items()) < window:
            for length, n in p.items():
                for x in powers(length):
                    parts[x] = parts.get(x, 0) + t * n
    for t, p in minimum_slack(parts, window) if parts else []:
        if sum(k * n for k, n in p.items()) == window:
            out.append((False, t, p))
        else:
            for x, n in p.items():
                rest = t * n
                for size in powers(x * rest):
                    out.append((False, 1, {x: size // x}))
    return out


def _slots(plan: list[tuple[int, dict[int, int]]], first: int) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length the plan's ranges of ranks: start rank, end, sequence of the start, pieces a sequence, offset."""
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    for times, pattern in plan:
        at = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            start = used.get(length, 0)
            used[length] = start + times * n
            slots.setdefault(length, []).append((start, used[length], first, n, at))
            at += n * length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}, first


def _ranked(rows: DataFrame, tag: str, per_bucket: int) -> DataFrame:
    """Add ``rank``, from 0 within each length, without gathering a length: counts of hash buckets first."""
    rows = rows.withColumn("crc", F.col("crcs")[0])
    total = rows.agg(F.count("*")).first()[0]
    salt = F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(buckets_for(total, per_bucket, rows.sparkSession.sparkContext.defaultParallelism * 4)))
    rows = rows.withColumn("salt", salt.cast("int"))
    sums = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("s_length"), F.col("salt").alias("s_salt"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "crc")
    rows = rows.withColumn("own", F.row_number().over(own) - 1)
    rows = rows.join(sums, (F.col("length") == F.col("s_length")) & (F.col("salt") == F.col("s_salt")))
    return gather(rows.select("doc_id", "row", "start", "length", "doc_tokens", "crcs", (F.col("own") + F.col("earlier")).cast("long").alias("rank")), tag)


def _place(rows: DataFrame, slots: dict[int, tuple[np.ndarray, ...]]) -> DataFrame:
    """Sequence and offset of each ranked piece by the plan, a few ranges a length; -1 for ranks beyond it."""
    sent = rows.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = np.full(batch.num_rows, -1, np.int64)
            off = np.zeros(batch.num_rows, np.int64)
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            for k in np.unique(length).tolist():
                if k in sent.value:
                    start, end, first, n, at = sent.value[k]
                    here = np.flatnonzero((length == k) & (rank < end[-1]))
                    i = np.searchsorted(start, rank[here], "right") - 1
                    past = rank[here] - start[i]
                    seq[here] = first[i] + past // n[i]
                    off[here] = at[i] + past % n[i] * k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = "doc_id long, row long, start long, length long, doc_tokens long, crcs array<long>, rank long, sequence_id long, offset long"
    return rows.mapInArrow(place, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pack documents' ids into sequences of at most ``window``: one row per piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row), row being a number of the
    input row's own, which tells apart rows that share a doc_id. Documents are cut at every
    window; the histogram of the pieces' lengths, at most ``window`` numbers however large the
    corpus, is packed by minimum bin slack on the driver, and pieces take their places by their rank
    within their length. Pieces of windows that stay short are cut into power-of-two parts, which
    fill windows wholly; the last ones become sequences of a power of two. So nothing is padded.

    Every id lies in exactly one piece. Null and empty texts are the end id alone; equal rows may
    change places, which changes nothing; a null doc_id stays null. Texts of any length are encoded
    whole. No rows give no rows. Other columns, of whatever name, are not read. ``path`` is the tokenizer's file, the same on every machine.
    """
    with small_batches(docs.sparkSession, BATCH):
        rows = gather(pieces(docs, path or tokenizer_path(), window, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = _dissolve(minimum_slack(counts, window), window)
    whole, first = _slots([(t, p) for own, t, p in plan if own], 0)
    placed = _place(_ranked(rows, "ranked", rows_per_bucket), whole)
    out = ["doc_id", "start", "length", F.col("crcs")[0].alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "row"]
    done = placed.where("sequence_id >= 0").select(*out)
    parts, _ = _slots([(t, p) for own, t, p in plan if not own], first)
    if not parts:
        return done
    rest = placed.where("sequence_id < 0")
    sizes = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(window.bit_length()))])
    bits = F.filter(sizes, lambda p: F.col("length").bitwiseAND(p) > 0)
    rest = rest.withColumn("bits", bits).select("*", F.posexplode("bits").alias("k", "size"))
    before = F.col("length") - F.col("length").bitwiseAND(F.col("size") * 2 - 1)
    rest = rest.select("doc_id", "row", (F.col("start") + before).alias("start"), F.col("size").alias("length"), "doc_tokens", F.array(F.get("crcs", F.col("k") + 1)).alias("crcs"))
    again = _place(_ranked(rest, "parts", rows_per_bucket), parts)
    return done.unionByName(again.select(*out))

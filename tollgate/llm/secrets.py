"""Secret scan: pattern candidates, and a random forest over labelled findings that removes false positives."""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Trees, their depth, least rows of a leaf, features tried at a node, labelled findings read at most, and seed.
TREES, DEPTH, LEAF, TRIED, MOST_FINDINGS, SEED = 60, 8, 3, 5, 20_000, 42
#: A candidate is reported as a secret from this share of the trees' votes.
CUT = 0.5
#: The corpus's most frequent words that the lexicon holds, and how often and how long a word must be to count.
VOCABULARY, OFTEN, LONG = 20_000, 5, 4
#: Characters beside a candidate that its neighbouring words are taken from.
BESIDE = 48

#: Name and pattern of each kind of candidate, the more telling first; group ``v`` is the candidate. Fixed values.
RULES = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?P<v>[\sA-Za-z0-9+/=]{16,}?)-----END"),
    ("aws_key_id", r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github_token", r"\b(?P<v>gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("slack_token", r"\b(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("payment_key", r"\b(?P<v>[sr]k_(?:live|test)_[A-Za-z0-9]{16,})\b"),
    ("web_token", r"(?<![A-Za-z0-9_-])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("assigned", r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?)[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}[\"']?(?P<v>[^\s\"'<>;,]{6,})"),
    ("opaque", r"(?P<v>[A-Za-z0-9+/_-]{20,}={0,2})"),
)
_COMPILED = [(name, re.compile(p)) for name, p in RULES]
_HINTS = {"private_key": "PRIVATE KEY", "github_token": "gh", "slack_token": "xox", "payment_key": "k_", "web_token": "eyJ"}
#: Words that real text and placeholders are made of; fixed values.
DICTIONARY = tuple(
    "access account address admin agent alpha amount apple author back base beta blank block board book branch build button cache change check class client code "
    "color command commit common config connect content control count course data date debug default delta demo detail device dummy earth edit email enter entry "
    "error event example expect fake field file filter first fixture folder form format foo bar baz global group guide handle happy hello here hidden home house "
    "image index info input insert item label large last layer letter level light limit line link list local login main manager market master member message "
    "method middle mock model module monkey mount move name network none nothing null number object offer office option order output owner page panel parent part "
    "pass password path person phone place placeholder point policy port power press print private process product profile project public qwerty random read real "
    "record redacted remove replace report request result return river route sample save school screen script search secret section select send sequence server "
    "service session set setting shape share short side simple site size small source space stage start state step store story string style summer super system "
    "table target team test text theme time title token total track train true type undefined unit update user value version view water welcome window winter word "
    "work world write xxxx your zero".split()
)
#: Words beside a candidate that speak for a secret, and against one; parts of a path that speak against one. Fixed values.
FOR = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "login", "bearer", "private")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "revision", "build", "example", "sample", "dummy", "placeholder", "fake", "test", "your", "integrity", "nonce", "trace", "request")
TESTING = ("test", "example", "sample", "fixture", "mock", "doc", "demo", "spec")
FEATURES = ("log_length", "transitions", "turns", "entropy", "digits", "upper", "distinct", "dictionary", "run", "hex", "reference", "path", "neighbours_for", "neighbours_against", "assigned", "prefixed")

_KIND = np.full(128, 3, np.int8)
_LETTER = np.full(128, 26, np.int8)
for _k, _chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)):
    _KIND[[ord(c) for c in _chars]] = _k
    if _k < 2:
        _LETTER[[ord(c) for c in _chars]] = range(26)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Lexicon:
    """Words that text is made of, and the log probability of one letter after another in them."""

    words: tuple[str, ...]
    transitions: np.ndarray
    _found: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"words": self.words, "transitions": self.transitions, "_found": None}

    def covered(self, low: str) -> int:
        """Characters of a lower-case text that words cover, the longest word first from the left."""
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for w in self.words:
                self._found.add_word(w, len(w))
            self._found.make_automaton()
        return sum(n for _, n in self._found.iter_long(low)) if self.words else 0


def lexicon(counts: dict[str, int]) -> Lexicon:
    """A lexicon of counted words and of the fixed ones, which count once each; a twentieth of a letter's weight is spread evenly."""
    count = np.full((27, 27), 0.5)
    known = {w: 1 for w in DICTIONARY} | {w: n for w, n in counts.items() if len(w) >= LONG}
    for w, n in known.items():
        at = _LETTER[_codes(w)]
        np.add.at(count, (at[:-1], at[1:]), math.log1p(n))
    return Lexicon(tuple(sorted(w for w in known if len(w) >= 3)), np.log(count / count.sum(1, keepdims=True)))


def learned_lexicon(docs: DataFrame) -> Lexicon:
    """The lexicon of all texts: their most frequent words of a to z, ``VOCABULARY`` at most.

    Words of one count are in it together or not at all. The count from which words are in it comes
    from a histogram of the counts, so the driver gets these words and no others.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9_])([a-z]{%d,24})(?![a-z0-9_])" % LONG), F.lit(1))).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN), "words")
    kept, least = 0, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(VOCABULARY).collect():
        kept += r["words"]
        if kept > VOCABULARY:
            break
        least = r["n"]
    top = counts.where(F.col("n") >= least).collect() if least else []
    return lexicon({r["w"]: r["n"] for r in top})


#: A variable, call, template or dotted name in place of a value.
_REFERENCE = re.compile(r"\$\{|\$[A-Za-z_]|\{\{|<|%\(|[A-Za-z_][\w.]*\(|[A-Za-z_]+(?:\.[A-Za-z_]+)+$")
_NEAR = re.compile(r"[A-Za-z0-9_]+")
_HEX, _DIGIT, _ALPHA = re.compile(r"[0-9A-Fa-f]*"), re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def features(value: str, before: str, after: str, path: str | None, rule: str, known: Lexicon) -> list[float]:
    """What the forest sees of a whole candidate, in the order of ``FEATURES``."""
    n = max(1, len(value))
    codes = _codes(value)
    plain = np.minimum(codes, 127)
    letters, kinds = _LETTER[plain], _KIND[plain]
    steps = known.transitions[letters[:-1], letters[1:]]
    count = np.unique(codes, return_counts=True)[1] / n
    breaks = np.flatnonzero(codes[1:] != codes[:-1])
    run = int(np.diff(np.concatenate([[-1], breaks, [len(codes) - 1]])).max()) if len(codes) else 1
    left = [w.lower() for w in _NEAR.findall(before)][-4:]
    right = [w.lower() for w in _NEAR.findall(after)][:2]
    near = left + right
    return [
        math.log(n), float(steps.sum()) / max(1, len(steps)), float((kinds[1:] != kinds[:-1]).sum()) / n, float(-(count * np.log2(count)).sum()),
        float((kinds == 2).sum()) / n, float((kinds == 1).sum()) / n, len(count) / n, known.covered(value.lower()) / n, run / n, float(_HEX.fullmatch(value) is not None),
        float(bool(_REFERENCE.match(value))),
        float(any(t in (path or "").lower() for t in TESTING)), float(sum(any(k in w for k in FOR) for w in near)), float(sum(w in AGAINST for w in near)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(rule not in ("assigned", "opaque")),
    ]


def candidates(text: str | None) -> list[tuple[int, str, str]]:
    """(start, value, rule) of every candidate in a whole text, by start; where patterns overlap the earlier rule has it.

    The time is linear in the text but for sorting: a rule's candidates don't overlap one another, and
    those of earlier rules are kept as sorted spans that overlap none.
    """
    text = text or ""
    spans: list[tuple[int, int]] = []
    out = []
    for name, pattern in _COMPILED:
        if name in _HINTS and _HINTS[name] not in text:
            continue
        new = []
        starts = [a for a, _ in spans]
        for m in pattern.finditer(text):
            a, b = m.span("v")
            if name == "opaque" and not (_DIGIT.search(m["v"]) and _ALPHA.search(m["v"])):
                continue
            if name in ("assigned", "opaque"):
                k = bisect_right(starts, a)
                if (k and spans[k - 1][1] > a) or (k < len(spans) and spans[k][0] < b):
                    continue
            new.append((a, b))
            out.append((a, m["v"], name))
        joined: list[tuple[int, int]] = []
        for a, b in sorted(spans + new):
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        spans = joined
    return sorted(out)


def labelled_findings(n: int = 8000, seed: int = SEED) -> list[tuple[str, str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, rule, label) for training where no others are at hand.

    Half are random keys of common formats in telling places; half look alike and are none: hashes
    and ids by their neighbours, placeholders, references, words, masked and sequential values.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    word = lambda: pick(DICTIONARY)
    plain = lambda: "".join(pick(("er", "an", "the", "on", "ti", "re", "un", "que", "ion", "ei", "la", "os")) for _ in range(int(rng.integers(1, 4))))
    draw = lambda chars, k: "".join(pick(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    names = ("password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth_key", "credential")
    out = []
    for k in range(n):
        before, after, path = " ".join(plain() for _ in range(4)) + " ", " " + plain(), f"src/{word()}/{word()}.py" if rng.random() < 0.5 else f"src{rng.integers(30)}"
        kind = int(rng.integers(8))
        if k % 2:
            if kind == 0:
                value, rule = "AKIA" + draw(string.ascii_uppercase + string.digits, 16), "aws_key_id"
            elif kind == 1:
                value, rule = "ghp_" + draw(alnum, 36), "github_token"
            elif kind == 2:
                value, rule = "sk_live_" + draw(alnum, 24), "payment_key"
            elif kind == 3:
                value, rule = ".".join(("eyJ" + draw(alnum, 17), draw(alnum, 40), draw(alnum + "_-", 32))), "web_token"
            else:
                value = draw((hexes, alnum, alnum + "!#%*+", string.ascii_lowercase + string.digits)[kind - 4], int(rng.integers(10, 48)))
                before += pick(names) + pick(("=", " = ", ": ", '="', ' = "'))
                rule = "assigned"
            if rng.random() < 0.1:
                path = f"tests/{word()}.py"
        elif kind == 0:
            value, rule = draw(hexes, pick((20, 32, 40, 64))), "opaque"
            before += pick(AGAINST) + pick((" ", ": ", "=", " = "))
        elif kind == 1:
            value, rule = "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), "opaque"
            before += pick(("uuid", "request", "trace", "id", "session")) + pick((" ", ": "))
        elif kind == 2:
            value, rule = pick(("_", "-", "")).join((pick(("your", "example", "my", "test", "dummy", "sample", "insert")), word(), word(), pick(("here", "123", "key", "value")))), "assigned"
            before += pick(names) + pick(("=", ": ", '="'))
        elif kind == 3:
            value, rule = pick(("${%s}", "os.environ.%s", "get_%s()", "{{%s}}", "config.%s", "<%s>", "%%(%s)s")) % "_".join(pick((word(), draw(string.ascii_lowercase, int(rng.integers(2, 7))))) for _ in range(int(rng.integers(1, 4)))), "assigned"
            value = value.upper() if rng.random() < 0.5 else value
            before += pick(names) + pick(("=", ": ", " = "))
        elif kind == 4:
            value, rule = pick(("x", "*", "0", "a", "-")) * int(rng.integers(6, 24)) + pick(("", "1234")), "assigned"
            before += pick(names) + pick(("=", ": "))
        elif kind == 5:
            value, rule = pick(("", "_", "-", "/")).join(word() for _ in range(int(rng.integers(2, 6)))) + pick(("", "1", "2024")), pick(("assigned", "opaque"))
            before += pick(names) + "=" if rule == "assigned" else ""
        elif kind == 6:
            value, rule = pick((string.ascii_lowercase, string.digits * 3, "0123456789abcdef" * 2, "qwertyuiopasdfghjkl"))[: int(rng.integers(8, 30))], "assigned"
            before += pick(names) + "="
        else:
            value, rule = "AKIA" + pick(("IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEEXAMPLE12", "TESTTESTTESTTEST")), "aws_key_id"
        out.append((value, before, after, path, rule, k % 2))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children and share of label 1 of every node."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees."""
        total = np.zeros(len(x))
        for feature, cut, low, high, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                on = f >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], low[at], high[at])
                at = np.where(on, go, at)
            total += share[at]
        return total / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], TRIED, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
            gini = n * p * (1 - p) + (len(v) - n) * q * (1 - q)
            gini[(v[1:] == v[:-1]) | (n < LEAF) | (len(v) - n < LEAF)] = np.inf
            k = int(np.argmin(gini))
            if gini[k] < best[0]:
                best = (gini[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            if 0 < left.sum() < len(rows):
                a, b = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
                nodes[me][:4] = [best[1], best[2], a, b]
        return me

    grow(np.arange(len(y)), 0)
    f, cut, low, high, share = zip(*nodes)
    return np.array(f, np.int64), np.array(cut), np.array(low, np.int64), np.array(high, np.int64), np.array(share)


Finding = tuple[str, str, str, str, str, int]


def sample(findings: Sequence[Finding], most: int = MOST_FINDINGS) -> list[Finding]:
    """At most ``most`` findings, half of each label where there are as many, picked by their hashes, whatever their order."""
    by = sorted(findings, key=lambda f: hashlib.md5(repr(f).encode("utf-8", "replace")).digest())
    ones, zeros = ([f for f in by if f[-1] == y] for y in (1, 0))
    half = most // 2
    a = ones[: max(half, most - len(zeros))]
    return a + zeros[: most - len(a)]


def fit(findings: Sequence[Finding], known: Lexicon, trees: int = TREES, seed: int = SEED) -> Forest:
    """A random forest on at most ``MOST_FINDINGS`` labelled findings, of both labels; none gives a forest that scores 0."""
    findings = sample(findings)
    if not findings:
        return Forest([])
    x = np.array([features(v, b, a, p, r, known) for v, b, a, p, r, _ in findings])
    y = np.array([f[-1] for f in findings], float)
    rng = np.random.default_rng(seed)
    return Forest([_tree(x[rows], y[rows], rng) for rows in (rng.integers(len(y), size=len(y)) for _ in range(trees))])


def scan(docs: DataFrame, findings: Sequence[Finding] | None = None, path: Column | None = None) -> DataFrame:
    """Every candidate of every text: (doc_id, start, length, rule, score, secret, value).

    ``start`` counts characters from 0. ``findings`` are labelled findings to train on, by default
    generated ones; ``path`` is a column with each text's path, by default its source. The dictionary
    that a candidate's coverage and letter transitions are taken from is learned from all texts. Null
    and empty texts have no candidates; texts and candidates of any length are read whole, in time
    linear in them; repeated rows give their findings again; a null doc_id or path stays null or
    counts as none. No rows give no rows. Other columns, of whatever name, are not read.
    """
    known = learned_lexicon(docs)
    forest = fit(labelled_findings() if findings is None else findings, known)
    sent = docs.sparkSession.sparkContext.broadcast((forest, known))  # bounded by TREES, DEPTH and VOCABULARY
    where = F.col("source") if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), where.cast("string").alias("path"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, known = sent.value
        for batch in batches:
            out, seen = [], []
            for doc, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                for start, value, rule in candidates(text):
                    end = start + len(value)
                    seen.append(features(value, text[max(0, start - BESIDE) : start], text[end : end + BESIDE], at, rule, known))
                    out.append((doc, start, len(value), rule, value))
            if out:
                doc, start, length, rule, value = zip(*out)
                score = np.round(forest.score(np.array(seen)), 6)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(rule), pa.array(score), pa.array(score >= CUT), pa.array(value)],
                    names=["doc_id", "start", "length", "rule", "score", "secret", "value"],
                )

    return rows.mapInArrow(find, "doc_id long, start long, length long, rule string, score double, secret boolean, value string")

"""Mixing, packing, URL filters, secret scans: against brute force, round trips and edge cases."""

import math
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tollgate.llm import mixing, packing, secrets, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string, key string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "extra", "extra") for i, t, s in rows], SCHEMA)


def _words(n, word="w"):
    return " ".join([word] * n)


# Mixing


def _targets(sizes):
    """Water-filling, one source at a time."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight, cap = {s: mixing.WEIGHTS[k % 3] for k, (s, _) in enumerate(order)}, {s: 2.0 * n for s, n in order}
    capped = set()
    while True:
        left, by = 1.5 * sum(n for _, n in order) - sum(cap[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        out = {s: cap[s] if s in capped else left * weight[s] / by for s, _ in order}
        above = {s for s in out if s not in capped and out[s] > cap[s]}
        if not above:
            return out
        capped |= above


def test_targets_cap_and_reshare(spark):
    rng = random.Random(4)
    cases = [[("a", 10), ("b", 100), ("c", 100), (None, 1000)], [("a", 0)], [("a", 0), ("b", 0)], [(f"s{i:03d}", 10 ** rng.randrange(1, 7)) for i in range(300)]]
    for sizes in cases:
        got = {r["g_source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert got == pytest.approx(_targets(sizes))
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_mix_of_one_id_and_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 16)
    rng = random.Random(6)
    rows = [(None, _words(rng.randrange(1, 30), f"v{i}"), "a") for i in range(200)] + [(5, "one and the same text", "b")] * 90 + [(i, _words(7), "c") for i in range(40)]
    docs = _docs(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    for s, slack in (("a", 0), ("b", 90), ("c", 0)):
        own = [r for r in got if r["source"] == s]
        assert 0 <= round(own[0]["target"]) - sum(r["taken"] for r in own) <= slack and all(r["taken"] <= 2 * r["size"] for r in own)
    assert sum(len(r["text"].split()) for r in mixing.mixed(docs).collect()) == sum(r["taken"] for r in got)


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, _words(rng.randrange(0, 40)), "hot" if i % 3 == 0 else f"s{i % 5}" if i % 11 else None) for i in range(600)]
    docs = _docs(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert len(got) == 600 and sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == round(own[0]["target"]) and own[0]["source_size"] == sum(r["size"] for r in own)
    assert all(r["taken"] <= 2 * r["size"] and r["size"] == len(re.findall(mixing.WORD, rows[r["doc_id"]][1])) for r in got)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mix_edges(spark):
    rows = [(None, "a b", "x"), (1, None, "x"), (2, "", "x"), (3, " \x0b\x1c a\x85b \xa0", "x"), (4, _words(20000), "y"), (4, _words(20000), "y"), (5, "q", None)]
    got = mixing.mix(_docs(spark, rows)).collect()
    assert len(got) == 7 and sorted(r["size"] for r in got) == [0, 0, 1, 2, 3, 20000, 20000]
    assert mixing.mix(_docs(spark, [])).count() == 0 == mixing.mixed(_docs(spark, [])).count()
    assert mixing.mix(_docs(spark, [(1, "", "x")])).first()["taken"] == 0


def test_mixed_cuts_keep_the_text(spark):
    text = "  one\ttwo \n three four\x0bfive  six "
    docs = _docs(spark, [(i, text, "a") for i in range(5)] + [(9, _words(500), "b")])
    out = [r["text"] for r in mixing.mixed(docs).where("source = 'a'").collect()]
    assert out and all(text.startswith(t) for t in out)


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


ODD = [
    "", "Hello, WORLD!!  it's  I'll 'RE x'dd 12345 ab12cd <|endoftext|> a<|startoftext|>b", "éà ÀÉ ßẞ İstanbul ΣΑΣ ǅ ½ ² ª º 한국어 日本語 ​🙂🙂 ok", "tab\tnew\nline\r\x0b\x0c end ÿŸ œŒ × ÷ ¼¾ Ⅷ ⑨ '",
    "don't''s 's' ''ve __init__ a_b $%^ …—– x \x1cz\x85q", "é é", "\x00\x01 <|", " " * 50, "ſ K Å ﬁ", "a'sb 'tis 'twas rock'n'roll 've've",
]


def test_ids_equal_the_tokenizer(tokenizer):
    import pyarrow as pa

    ids = packing.PartIds(packing.tokenizer_path())
    rng = random.Random(0)
    alphabet = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x320), *range(0x390, 0x3D0), 0x2028, 0x3000, 0x1F600, 0x4E00, 0xAC00]]
    texts = ODD + ["".join(rng.choice(alphabet) if rng.random() < 0.4 else rng.choice("abcS' .1,\n") for _ in range(60)) for _ in range(200)]
    for t, got in zip([*texts, None], ids.ids(pa.array([*texts, None]))):
        assert got.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def _check_packing(rows, pieces, tokenizer, window=4096):
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in want.values() for x in v)
    seqs = {}
    for p in pieces:
        ids = next(x for x in want[p["doc_id"]] if len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"])
        assert p["start"] + p["length"] <= len(ids) and p["length"] > 0
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i in want:
        cover = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, n in cover) == sum(map(len, want[i]))
    padding = 0
    for parts in seqs.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sorted(seqs)


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 700, 3000]))), "a") for i in range(60)]
    rows += [(100 + i, t, "a") for i, t in enumerate(ODD)] + [(200 + i, "same text again", "b") for i in range(150)] + [(300, None, "c"), (301, _words(30000, "alpha beta"), "c")]
    pieces = packing.pack(_docs(spark, rows), rows_per_bucket=20).collect()
    padding, seqs = _check_packing(rows, pieces, tokenizer)
    assert padding == 0 and seqs == list(range(len(seqs)))


def test_packing_small_and_repeated(spark, tokenizer):
    assert packing.pack(_docs(spark, [])).count() == 0
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")]
    odd = _docs(spark, rows).selectExpr("*", "1 as start", "'x' as length", "2L as `offset`", "3 as row", "4 as crcs")
    got = packing.pack(odd).collect()
    padding, _ = _check_packing(rows, got, tokenizer)
    assert len({(r["row"], r["start"]) for r in got}) == len(got) and len({r["row"] for r in got}) == 3
    assert padding == 0


def test_minimum_slack_fills_windows():
    plan = packing.minimum_slack({3000: 4, 1096: 2, 548: 4}, 4096)
    used = {}
    for times, p in plan:
        assert sum(k * n for k, n in p.items()) <= 4096
        for k, n in p.items():
            used[k] = used.get(k, 0) + times * n
    assert used == {3000: 4, 1096: 2, 548: 4} and sum(t for t, p in plan if sum(k * n for k, n in p.items()) == 4096) == 4
    best = packing._fullest({7: 3, 5: 2, 4: 1}, 16)
    assert sum(k * n for k, n in best.items()) == 16
    with pytest.raises(ValueError):
        packing.minimum_slack({5000: 1}, 4096)
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 4) for _ in range(5)}
        first, best = max(counts), 0
        reach = {first}
        for k, n in counts.items():
            for _ in range(n - (k == first)):
                reach |= {r + k for r in reach if r + k <= 64}
        best = max(reach)
        got = packing._fullest(counts, 64)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


# URL filters

URLS = [
    "http://example.org/es/1", "https://a.example.org/en/12?x=1#y", "http://example.org/en/2", "HTTP://EXAMPLE.ORG/es/", "http://notexample.org/es/", "http://org", "http://org/", "http://x.com/fr/1", "http://x.com/de/",
    "http://x.com/fr?/de/", "http://com/de/#/fr/", "http://x.com:80/de/1", "ftp://u@b.com/de/1", "no scheme.com/de/", "", None, "://", ":///es/", "http://a://b.org/es/", "http://.org/", "http://example.org./es/",
    "http://ÄX.com/de/ü", "http://x.com/" + "de/" * 5000, "http://" + "a." * 3000 + "com/de/z", "http://x.net/de/",
]


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls_equal_brute_force(spark):
    rows = [(i, u, "block", "host") for i, u in enumerate(URLS)] + [(0, URLS[0], "", ""), (None, URLS[1], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, host string")
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.RULES).collect()))
    want = sorted((i is None, i or 0, h, p, r or "", v) for i, u, *_ in rows for h, p, r, v in [_judge(u)])
    assert got == want


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, ()).first()["verdict"] == "allow"
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0
    assert url_filter.filter_urls(pages, (("block", "com", "/"),), "block").first()["rule"] == "com/"


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/")], "page_id long, url string")
    assert "Python" not in url_filter.filter_urls(pages, url_filter.RULES)._jdf.queryExecution().toString()


# Secrets


KNOWN = secrets.lexicon({"wanderung": 40, "erinnern": 12})


def _walk(forest, x):
    """Share of label 1, by one row and one tree at a time."""
    total = 0.0
    for feature, cut, low, high, share in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = low[at] if x[feature[at]] <= cut[at] else high[at]
        total += share[at]
    return total / max(1, len(forest.trees))


def _naive_candidates(text):
    out = []
    for name, pattern in secrets.RULES:
        for m in re.finditer(pattern, text or ""):
            a, b = m.span("v")
            if name == "opaque" and not (re.search("[0-9]", m["v"]) and re.search("[A-Za-z]", m["v"])):
                continue
            if name not in ("assigned", "opaque") or not any(a < y + len(v) and y < b for y, v, _ in out):
                out.append((a, m["v"], name))
    return sorted(out)


def _naive_features(value, before, after, path, rule):
    n, low = len(value), value.lower()
    at = [string.ascii_lowercase.find(c) if c in string.ascii_lowercase else 26 for c in low]
    kinds = ["l" if c in string.ascii_lowercase else "u" if c in string.ascii_uppercase else "d" if c in string.digits else "s" for c in value]
    share = [value.count(c) / n for c in set(value)]
    covered = k = 0
    while k < n:
        best = max((len(w) for w in KNOWN.words if low.startswith(w, k)), default=0)
        covered, k = covered + best, k + (best or 1)
    near = [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", before)][-4:] + [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", after)][:2]
    return [
        math.log(n), sum(KNOWN.transitions[a, b] for a, b in zip(at, at[1:])) / max(1, n - 1), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, -sum(p * math.log2(p) for p in share),
        kinds.count("d") / n, kinds.count("u") / n, len(share) / n, covered / n, max(len(m.group()) for m in re.finditer(r"(?s)(.)\1*", value)) / n, float(set(value) <= set(string.hexdigits)),
        float(bool(secrets._REFERENCE.match(value))), float(any(t in (path or "").lower() for t in secrets.TESTING)), float(sum(any(f in w for f in secrets.FOR) for w in near)),
        float(sum(w in secrets.AGAINST for w in near)), float(bool(re.search("[=:]\\s*[\"']?$", before))), float(rule not in ("assigned", "opaque")),
    ]


def test_forest_removes_false_positives():
    held = secrets.labelled_findings(1500, seed=99)
    forest = secrets.fit(secrets.labelled_findings(), KNOWN)
    x = np.array([secrets.features(*f[:5], KNOWN) for f in held])
    assert np.allclose(x, [_naive_features(*f[:5]) for f in held])
    y = np.array([f[-1] for f in held])
    p = forest.score(x)
    assert ((p >= secrets.CUT) == y).mean() > 0.97 and len(secrets.FEATURES) == x.shape[1]
    assert np.allclose(p[:300], [_walk(forest, r) for r in x[:300]])
    assert (secrets.fit([], KNOWN).score(x) == 0).all()


def test_the_sample_of_findings_holds_both_labels():
    findings = sorted(secrets.labelled_findings(400, seed=3), key=lambda f: f[-1])
    got = secrets.sample(findings, 100)
    assert [f[-1] for f in got].count(1) == 50 == [f[-1] for f in got].count(0) and got == secrets.sample(findings[::-1], 100)
    assert len(secrets.sample(findings[:30] + findings[-90:], 100)) == 100 and len(secrets.sample(findings, 1000)) == 400


def test_candidates_equal_a_naive_search():
    rng = random.Random(8)
    bits = ["AKIA" + "A1" * 8, "password=", "token: '", "eyJabcdefgh12.abcdefgh.abcdefgh", "ghp_" + "a1" * 20, " ", "\n", "secret = ", "0123456789abcdef0123", "sk_live_" + "z9" * 10, "'", "xoxb-123456789012", "-----BEGIN RSA PRIVATE KEY-----", "MIIB" * 6, "-----END", "/+="]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 20)))
        assert secrets.candidates(text) == _naive_candidates(text), text


@pytest.mark.parametrize("unit", ["0123456789abcdef0123456789abcdef ", "eyJaaaaaaaaaaa-eyJaaaaaaaaaaa.", "password=abc123def ", "-----BEGIN PRIVATE KEY-----\nAAAA"])
def test_long_texts_of_tokens_take_seconds(unit):
    began = time.time()
    secrets.candidates(unit * (10_000_000 // len(unit)))
    assert time.time() - began < 30


def test_a_long_key_is_read_whole(spark):
    value = "A" * 5000 + "".join(random.Random(1).choice(string.ascii_letters) for _ in range(5000))
    got = [secrets.features(v, "", "", None, "private_key", KNOWN) for v in (value, value[:4096])]
    assert got[0][0] == pytest.approx(math.log(10_000)) and got[0] != got[1]


def test_scan(spark):
    key, hexes = "AKIA" + "RN6CTW33DVWVXQMA", "f588a13e8ab71b41a6803e722e76d21eb69539fa"
    texts = [
        f"und so {key} weiter", f'say token = "{hexes}" and go', "password=4dfb7fed7a8db0a2fe then", f"commit {hexes} fixed it", "password=your_password_here", "token = ${API_TOKEN}", "", None,
        "x " * 20000 + f"password=5198e9657651aa63e5 {key}", "api_key: xxxxxxxxxxxxxxxx",
    ]
    schema = "doc_id long, text string, source string, start string, score string, secret string, value string, rule string, path string, w string"
    docs = spark.createDataFrame([(i, t, s, *"abcdefg") for i, t, s in [*((i, t, f"src{i}") for i, t in enumerate(texts)), (None, texts[0], None), (0, texts[0], "src0")]], schema)
    got = secrets.scan(docs).collect()
    found = Counter((r["doc_id"], r["value"]) for r in got if r["secret"])
    assert found == Counter([(0, key), (0, key), (1, hexes), (2, "4dfb7fed7a8db0a2fe"), (8, "5198e9657651aa63e5"), (8, key), (None, key)])
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["value"] for r in got if r["doc_id"] is not None)
    assert secrets.scan(docs.limit(0)).count() == 0 and all(r["secret"] is False for r in secrets.scan(docs, findings=[]).collect())


def test_scan_equals_brute_force_on_the_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    counts = Counter(w for r in rows for w in re.findall(r"(?<![a-z0-9_])[a-z]{4,24}(?![a-z0-9_])", (r["text"] or "").lower()))
    for most in (secrets.VOCABULARY, 300):
        monkeypatch.setattr(secrets, "VOCABULARY", most)
        known = secrets.learned_lexicon(docs)
        cut = min(n for n in counts.values() if n >= secrets.OFTEN and sum(m >= n for m in counts.values()) <= most)
        assert known.words == secrets.lexicon({w: n for w, n in counts.items() if n >= cut}).words
    forest = secrets.fit(secrets.labelled_findings(), known)
    want = set()
    for r in rows:
        for a, v, rule in _naive_candidates(r["text"]):
            x = secrets.features(v, r["text"][max(0, a - 48) : a], r["text"][a + len(v) : a + len(v) + 48], r["source"], rule, known)
            want.add((r["doc_id"], a, len(v), rule, round(_walk(forest, x), 6)))
    assert {(r["doc_id"], r["start"], r["length"], r["rule"], r["score"]) for r in secrets.scan(docs).collect()} == want

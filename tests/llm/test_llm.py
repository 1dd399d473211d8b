"""The corpus operators against brute force, and on odd tables."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scopewise.llm import bpe, exact_dedup, gear, graph_search, language, line_dedup, mixing, quality, queries, similar_texts, simhash, substring_dedup, url_rules
from scopewise.llm.components import connected_components
from tests.oracle import assert_same, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of names that operators use inside.
CLASHING = ("id", "hash", "size", "group", "key", "_id", "count", "tokens", "bits", "node", "low")


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, clashing columns."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    lines = "one line\ntwo line\nthree line\nfour line"
    rows = [
        (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "other text here", "en", "s", 1), (2, "A B\tC d e f", "en", None, None), (None, "abcdef", None, "s", 2),
        (None, None, None, None, None), (3, "", "de", "t", 0), (4, " \n\t", "de", "t", 0), (5, long_text, "en", "t", 9), (6, long_text, "en", "t", 9), (7, lines, "en", "u", 1),
        (8, lines + "\nfive", "en", "u", 1), (9, "ñandú ß ’ 漢字 😀 <|endoftext|>", "es", "u", 1), (10, None, "en", "s", 1), (11, "!!!", "en", "s", 1), (12, "x" * 5000, "en", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, con, name):
    assert_same(queries.QUERIES[name](spark, sf), con, queries.ORACLE_SQL[name])


# 1 SimHash near-dedup


def shingle_bits(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, near):
    """For each index the smallest it is linked to."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(i):
                if near(values[i], values[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_against_brute_force(spark, documents, texts):
    got = {r.doc_id: r for r in simhash.near_groups(documents).collect()}
    ids = sorted(texts)
    prints = [shingle_bits(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    label = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[i].component_id for i in ids] == [ids[k] for k in label]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=6), st.lists(st.sets(st.integers(0, 63), max_size=3), max_size=40))
def test_bk_trees_reach_what_links_reach(bases, flips):
    values = sorted({b ^ sum(1 << k for k in f) for b in bases for f in flips} | set(bases))
    if values:
        got = simhash.reach(np.array(values, np.uint64))
        assert got.tolist() == linked(values, lambda a, b: (a ^ b).bit_count() <= 2)


def test_links_survive_split_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARD", 3)
    monkeypatch.setattr(simhash, "TREE_NODES", 5)
    rng = np.random.default_rng(3)
    values = {0x0123456789ABCDEF ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 2**62, 20)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = {r.node: r.root for r in connected_components(simhash._links_of(spark.createDataFrame([(v,) for v in values], "bits long"))).collect()}
    label = linked([v % (1 << 64) for v in values], lambda a, b: (a ^ b).bit_count() <= 2)
    assert [roots.get(v, v) for v in values] == [values[k] for k in label]


@pytest.mark.parametrize("share", [1000, 1])  # every node a hub, or none
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr("scopewise.llm.components.SHARE", share)
    path = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (5, 3), (3, 9), (9, 5), (-4, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: -4, 3: -4, 9: -4, -4: -4}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_odd_tables(spark, odd, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == 16
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert {3, 4, 10, None} <= zero and {r.component_id for r in got if r.doc_id in (3, 4, 10)} == {3}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash.near_groups(empty).count() == 0


def test_similar_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    changed = [*words[:100], "new", *words[101:]]  # 5 of 396 shingles differ
    far = [*words[:200], *(f"v{i}" for i in range(200))]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(far)), (4, "short"), (5, "short"), (6, None), (7, ""), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1))
    got = {r.doc_id: r["first"].id for r in similar_texts.similar_groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, None: 4}
    assert sorted(r.doc_id for r in similar_texts.similar_dedup(docs).collect()) == [1, 3, 4, 6]


def test_similar_texts_in_a_split_shard(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "HOT_SHARD", 5)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*base[: 7 * k], f"x{k}", *base[7 * k + 1 :]])) for k in range(1, 41)]
    assert {r["first"].id for r in similar_texts.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_similar_texts_with_repeated_lines(spark):
    """A line that stands more often in a copy changes no shingle but those at its ends."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        words = [f"w{i}" for i in rng.integers(0, 50_000, 300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:112] + 30 * words[100:112] + words[112:]))]
    got = {r.doc_id: r["first"].id for r in similar_texts.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.sets(st.integers(0, 255), max_size=60)), max_size=30), st.sampled_from([0, 20, 60, 80]))
def test_balls_link_what_brute_force_links(rows, radius):
    rows = sorted(rows, key=lambda r: r[0])
    bases = [int.from_bytes(hashlib.sha256(bytes([k])).digest(), "little") for k in range(3)]
    values = [(group, bases[base] ^ sum(1 << b for b in flips)) for group, base, flips in rows]
    prints = np.frombuffer(b"".join(v.to_bytes(32, "little") for _, v in values), "<u8").reshape(-1, 4)
    got = similar_texts.joined(np.array([g for g, _ in values], np.int64), prints, radius)
    assert got.tolist() == linked(values, lambda a, b: a[0] == b[0] and (a[1] ^ b[1]).bit_count() <= radius)


def test_fingerprints_against_brute_force():
    text = "One two THREE four five six seven eight one two three four five"
    hashes = similar_texts.shingles(text)
    words = text.lower().split()
    assert {int(h) for h in hashes} == {xxhash.xxh64_intdigest(" ".join(words[k : k + 5]), 42) for k in range(9)}
    prints, least, _ = similar_texts.describe(text)
    lanes = similar_texts._mixed(hashes[:, None] + similar_texts._LANE)
    assert [int(p) for p in prints] == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in lane) > len(hashes)) for lane in lanes.T]
    assert len(set(least.tolist())) == similar_texts.ORDERS


def test_similar_texts_odd_tables(spark, odd, empty):
    got = similar_texts.similar_groups(odd)
    assert got.count() == 16 and got.columns == ["doc_id", "hash", "first"]
    kept = similar_texts.similar_dedup(odd)
    assert kept.columns == odd.columns and {5} == {r.doc_id for r in kept.collect() if r.doc_id in (5, 6)}
    assert similar_texts.similar_dedup(empty).count() == 0


def test_similar_texts_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    texts, of = [], lambda t: {" ".join(t[k : k + 5]) for k in range(len(t) - 4)}
    for k in range(80):
        words = [f"t{k}w{i}" for i in range(300)]
        other = list(words)
        for at in rng.choice(60, int(rng.integers(4, 12)), replace=False):
            other[5 * at] = f"t{k}x{at}"
        texts += [words, other]
    exact = [len(of(a) & of(b)) / len(of(a) | of(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= x < 0.84 for x in exact) > 5 and sum(0.76 < x < 0.8 for x in exact) > 5
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r["first"].id for r in similar_texts.similar_groups(docs).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(80)] == [x >= 0.8 for x in exact]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=1, max_size=30))
def test_exact_links_against_brute_force(sets):
    got = similar_texts.alike([np.array(sorted(x), np.uint64) for x in sets], 0.6)
    assert got.tolist() == linked(sets, lambda a, b: len(a & b) >= 0.6 * len(a | b))


def test_all_pairs_of_a_split_shard_meet(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "HOT_SHARD", 3)
    rows = spark.createDataFrame([(7, i) for i in range(20)] + [(8, 1), (8, 2), (9, 3)], "shard long, node long")
    groups = defaultdict(list)
    for r in similar_texts._dealt(rows, "shard").collect():
        groups[r.shard, r.sub].append(r.node)
    met = {(shard, i, j) for (shard, _), nodes in groups.items() for i in nodes for j in nodes if i < j}
    assert met == {(7, i, j) for i in range(20) for j in range(i + 1, 20)} | {(8, 1, 2)}
    assert len(groups) > 2


# 2 quality classifier


def test_quality_agrees_with_labels(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.resample(docs, labels).join(labels, "doc_id").collect()
    right = Counter((r.quality, r.kept) for r in got)
    assert right[1, True] >= 0.99 * (right[1, True] + right[1, False]) and right[0, False] >= 0.97 * (right[0, True] + right[0, False])
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_top_k_is_exact(spark):
    values = np.random.default_rng(2).normal(size=3000).round(2)
    rows = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 17, 1500, 2999, 3000):
        assert quality.top_k(rows, "key", k) == sorted(values)[-k]


def grams(text):
    """Every n-gram of a text as a tuple: tokens, their shapes, pairs."""
    found, before, out = [m for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\s\x80-\U0010ffff]+", text)], None, []
    for m in found:
        token, size = m[0], len(m[0].encode())
        capitals, digits = sum("A" <= c <= "Z" for c in token), sum("0" <= c <= "9" for c in token)
        case = 0 if not capitals else 1 if capitals == 1 and "A" <= token[0] <= "Z" else 2 if 2 * capitals > size else 3
        parted = m.start() == 0 or text[m.start() - 1].isspace()
        out += [("own", token), ("shape", token[0].isalnum() or token[0] >= "\x80", min(size, 31) // 4, case, min(digits, 3), parted, token == before)]
        out += [("pair", before, token)] if before is not None else []
        before = token
    return out


def test_weights_against_brute_force(spark):
    rows = [(1, "good words are here, Words are"), (2, "BAD!! BAD!! WORDS!! 1234 x9"), (3, "good words and more"), (4, " "), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 1)], "doc_id long, quality int")
    bags = {i: Counter(grams(t or "")) for i, t in rows}
    raw, added = sum(bags.values(), Counter()), quality.SMOOTHING
    target = {1: bags[3], 2: bags[1] + bags[3], 3: bags[1]}  # without its own
    want = {i: sum(k * np.log((t[g] * raw.total() / t.total() + added) / (raw[g] + added)) for g, k in bags[i].items()) for i, t in target.items()}
    got = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    assert all(np.isclose(got[i].log_weight, want[i]) for i in (1, 2, 3)) and got[4].log_weight is got[5].log_weight is None
    edge = quality.threshold(quality.weigh(rows := quality.sampled(docs, labels, "doc_id", "text"), quality.fit(rows)), labels)
    keys = sorted((r.key, i) for i, r in got.items() if r.key is not None)[::-1]
    assert {i for i, r in got.items() if r.kept} == {i for _, i in keys[: sum(w >= edge for w in want.values())]}


def test_long_texts_are_hashed_alike_in_blocks(monkeypatch):
    texts = ["ab!!cd  ef ef\nGh12", None, "", "x" * 50, " a b ", "één twee, drie " * 9]

    def bags():
        out = [Counter() for _ in texts]
        for of, at in quality.Features().blocks(texts):
            for k, bucket in zip(of.tolist(), at.tolist(), strict=True):
                out[k][bucket] += 1
        return out

    whole = bags()
    for size in (5, 7, 16, 64):
        monkeypatch.setattr(quality, "BLOCK", size)
        assert bags() == whole


def test_held_out_quality(spark):
    """Fitted on some labels, held against the others."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality.resample(docs, labels.where(~held)).join(labels.where(held), "doc_id").groupBy("quality", "kept").count().collect()
    right = {(r.quality, r.kept): r["count"] for r in got}
    assert right[1, True] >= 0.99 * (right[1, True] + right.get((1, False), 0)) and right.get((0, True), 0) <= 0.02 * right[0, False]


def test_quality_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (9, 1), (12, 0), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    got = quality.resample(odd, labels)
    assert got.count() == 16 and got.where("log_weight IS NULL AND kept").count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(odd, none).where("kept").count() == 12
    assert quality.resample(empty, labels).count() == 0


# 3 URL filters


def test_stated_rules(spark):
    cases = {
        "http://a.NET/x?y": ("a.net", "/x", "net/", "block"),
        "https://www.example.net/en/1#top": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://badexample.net/en/1": ("badexample.net", "/en/1", "net/", "block"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://example.com/de": ("example.com", "/de", None, "allow"),
        "x://q.org/fr/://z": ("q.org", "/fr/://z", "org/fr/", "allow"),
        "http://a.net?x": ("a.net", "", None, "allow"),
        "http://ÄB.Net/": ("Äb.net", "/", "net/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumns({"host": F.lit("x"), "tokens": F.lit(1), "verdict": F.lit(2)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, none).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        host, part = rng.choice(["a.test", "b.test", "c.test"]), rng.choice(["news", "spam", "shop"])
        bad = (part == "spam" and host == "a.test") or rng.random() < 0.05
        rows.append((i, f"http://{host}/{part}/{i}"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, known).collect()}
    sets = {i: {"scheme:http", f"host:{u.split('/')[2]}", "host:test", f"path0:{u.split('/')[3]}", "path1:#"} for i, u in rows}
    verdicts = {i: "allow" if q else "block" for i, q, _ in labels}
    share = Counter(verdicts.values())
    found = []
    for wanted in {frozenset(x for k, x in enumerate(sorted(s)) if n >> k & 1) for s in sets.values() for n in range(1, 32)}:
        inside = Counter(verdicts[i] for i in verdicts if wanted <= sets[i])
        for v, c in inside.items():
            confidence, support = c / sum(inside.values()), c / len(verdicts)
            n, base = sum(inside.values()), share[v] / len(verdicts)
            low = (confidence + 8 / n - 4 * (confidence * (1 - confidence) / n + 4 / n**2) ** 0.5) / (1 + 16 / n)  # Wilson's bound
            if c >= 0.005 * len(verdicts) and confidence >= 0.5 and confidence / base >= 1.2 and low > base:
                found.append((confidence, support, " ".join(sorted(wanted)), v, wanted))
    want = {i: max((f[:4] for f in found if f[4] <= s), default=(0, 0, "", "allow"))[3] for i, s in sets.items()}
    assert got == want and "block" in want.values()


def test_urls_of_many_tokens(spark):
    """One often repeated URL of many tokens makes a bounded number of rules, and its pages get their verdict."""
    hot = "http://h.test/a?" + "&".join(f"k{chr(97 + j)}=1" for j in range(26))
    rows = [(i, hot + "&z" * (i % 3) if i < 60 else f"http://g{'abcdefg'[i % 7]}.test/b/{i}") for i in range(2000)] + [(5000, "http://x.test/" + "y/" * 2000), (5001, None)]
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, int(i >= 60), 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, known).collect()}
    assert got == {i: "block" if i < 60 else "allow" for i, _ in rows}


def judged_twice(spark, rows, labels, times):
    pages, known = spark.createDataFrame(rows * times, "page_id long, url string"), spark.createDataFrame(labels * times, "doc_id long, quality int, toxic int")
    return {(r.page_id, r.host + r.path): r.verdict for r in url_rules.judge_urls(pages, known).collect()}


def test_repeated_rows_teach_once(spark):
    """100 pages bad by host, 100 by path, 800 good: given twice or thrice, verdicts are those of once."""
    url = lambda i: f"http://bad.test/p{i}" if i < 100 else f"http://h{'abcdefghij'[i % 10]}.test/{'spam' if i < 200 else 'news'}/{i}"
    rows, labels = [(i, url(i)) for i in range(1000)], [(i, int(i >= 200), 0) for i in range(1000)]
    once = judged_twice(spark, rows, labels, 1)
    assert once == {(i, u.split("//")[1]): "block" if i < 200 else "allow" for i, u in rows}
    assert judged_twice(spark, rows, labels, 2) == once == judged_twice(spark, rows, labels, 3)


def test_shared_ids_do_not_pool_tokens(spark):
    """Rows of one id are labelled rows of their own: what their URLs hold together is in no rule."""
    bad = [(5000 + i % 20, f"http://x.test/spam/{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghij'[i // 20]}") for i in range(200)]
    good = [(i, f"http://h{'abcdefghij'[i % 10]}.test/news/{i}") for i in range(800)]
    labels = [(5000 + i, 0, 0) for i in range(20)] + [(i, 1, 0) for i in range(800)]
    got = judged_twice(spark, bad + good, labels, 1)
    assert got == {(i, u.split("//")[1]): "block" if i >= 5000 else "allow" for i, u in bad + good}


def test_every_frequent_token_is_judged(spark):
    """A rule of one token is found although each of its URLs has more telling tokens than are combined."""
    rng = np.random.default_rng(7)
    many = lambda i: "&".join(f"{'abcdefghijklmnop'[k]}q=1" for k in range(16) if rng.random() < 0.9)
    rows = [(i, f"http://{'evil' if i < 150 else 'fine'}.test/x?" + (many(i) + ("&late=1" if i % 3 == 0 else "") if i < 150 else "&".join(f"{'abcdefghijklmnop'[k]}q=1" for k in range(16) if rng.random() < 0.1))) for i in range(1000)]
    known = [(i, int(i >= 150), 0) for i in range(1000)]
    pages = spark.createDataFrame([*rows, (7777, "ftp://other.example/?late=2")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    assert got[7777] == "block" and all(got[i] == "block" for i in range(150))


def test_rules_of_tokens_that_are_not_the_most_telling(spark):
    """Twelve tokens tell more by themselves, but only two together that tell nothing alone decide on a page without the twelve."""
    rows, known = [], []
    for i in range(1200):
        bad = i < 300
        a, b = (True, True) if bad else (i % 2 == 0, i % 2 == 1)
        marks = [f"{'abcdefghijkl'[k]}m=1" for k in range(12) if k != i % 12] if bad else [f"{'abcdefghijkl'[k]}m=1" for k in range(12) if (i + k) % 97 == 0]
        rows.append((i, "http://h.test/?" + "&".join(["left=1"] * a + ["right=1"] * b + marks)))
        known.append((i, int(not bad), 0))
    pages = spark.createDataFrame([*rows, (7777, "ftp://other.example/?left=2&right=3"), (7778, "ftp://other.example/?left=2")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.confidence) for r in url_rules.judge_urls(pages, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    assert got[7777] == ("block", 1.0) and got[7778][0] == "allow" and all(got[i][0] == "block" for i in range(300))


# 4 BPE


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(spark, documents, texts, reference):
    got = {r.doc_id: r for r in bpe.token_digests(documents).collect()}
    for i, text in texts.items():
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "bc", "'s", "É", "ß", "12", "!?", bpe.END_OF_TEXT, "<|endo", "\u3000", "漢字", "😀", "\xa0", "\r\n", "x" * 60, " " * 70, "\x1c", "\x85"]), max_size=300), st.integers(1, 6), st.integers(1, 20), st.integers(5, 400))
def test_chunks_join_exactly(reference, parts, bits, least, most):
    text = "".join(parts)
    coder = bpe.ChunkEncoder(bpe.load(bpe.default_vocabulary()), bits, least, most)
    ids = coder.encode(text)
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == ids.tolist() and coder.decode(ids) == text


def test_bpe_odd_tables(spark, odd, empty, reference):
    got = bpe.token_digests(odd).collect()
    assert len(got) == 16 and {r.n_tokens for r in got if r.doc_id in (3, 10)} == {0}
    rows = bpe.decode_column(bpe.encode_column(odd.select("doc_id", "text", "id"))).collect()
    assert all(r._decoded == (r.text or "") for r in rows)
    assert all(np.frombuffer(r._ids, "<u4").tolist() == reference.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    named = odd.select("doc_id", "text").withColumns({"_n": F.lit("theirs"), "_decoded": F.lit(1), "_0": F.lit(2)})
    again = bpe.decode_column(bpe.encode_column(named))
    assert again.columns == ["doc_id", "text", "_0", "_ids", "_n", "_decoded"]  # those that are made replace theirs
    assert all(r._decoded == (r.text or "") and r._0 == 2 for r in again.collect())
    assert bpe.token_digests(empty).count() == bpe.code_column(empty).count() == 0


# 5 language


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_bundles_are_sums_of_bound_letters():
    space, text = language.Space(64), "Ab 1b"
    letters = {c: space.letter(ord(c)).astype(int) for c in " ab"}
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(" ab b", "ab b ", "b b  ", strict=True) if (a + b + c) != "b  ")
    assert space.bundles([text])[0].tolist() == want.tolist()
    assert not space.bundles([None, "", "12 !"]).any()


def test_long_texts_have_the_same_trigrams_in_pieces(monkeypatch):
    texts = ["Ab 1b", "a  b--c, d", "", "word " * 7, " ÄÖ ", "x", "1 2"]
    counts = lambda t: sum((Counter(dict(zip(*(v.tolist() for v in part), strict=True))) for part in language.trigram_counts(t)), Counter())
    whole = [counts(t) for t in texts]
    for size in (1, 2, 3, 5, 8):
        monkeypatch.setattr(language, "CHARACTERS", size)
        assert [counts(t) for t in texts] == whole


def test_language_odd_tables(spark, odd, empty):
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(odd).collect()}
    assert got[3, "und"] == got[11, "und"] == got[10, "und"] == 0 and (12, "und") not in got
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(empty).count() == 0


def test_predictions_against_brute_force(spark):
    rows = [(i, t, lang, None, 1) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("der Hund und die Katze", "de"), ("and then the end", "en"), ("und der Wind", "de"), ("1 2 3", "en"), (None, "de"), ("xyz", None)] * 3)]
    docs, space = spark.createDataFrame(rows, DOCS), language.Space()
    bundle = {t: space.bundles([t])[0].astype(float) for _, t, *_ in rows}
    learned = [(t, lang) for i, t, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    sums = {lang: sum(bundle[t] for t, own in learned if own == lang) for lang in ("de", "en")}
    unit = lambda v: v / np.linalg.norm(v)
    mean = (unit(sums["de"]) + unit(sums["en"])) / 2
    want = {}
    for i, t, *_ in rows:
        cosines = {lang: unit(unit(bundle[t]) - mean) @ unit(unit(v) - mean) for lang, v in sums.items()} if bundle[t].any() else {}
        want[i] = max(((1 + c) / 2, lang) for lang, c in cosines.items()) if cosines else (0.0, "und")
    got = {r.doc_id: (r.score, r.lang_pred) for r in language.identify(docs).collect()}
    assert all(got[i][1] == want[i][1] and np.isclose(got[i][0], want[i][0], atol=1e-4) for i in want)


# 6 nearest neighbours


def exact_neighbours(ids, vectors, queries_at, k=20):
    out = {}
    for q in queries_at:
        scores = vectors @ vectors[q]
        scores[ids == ids[q]] = -np.inf
        best = np.lexsort((ids, -scores))[:k]
        out[int(ids[q])] = [(int(ids[b]), float(scores[b])) for b in best if np.isfinite(scores[b])]
    return out


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(4000, 24)) * rng.uniform(0.5, 2, (4000, 1))).astype(np.float32)  # lengths differ
    index = graph_search.Graph(vectors.astype(float))
    found, _ = index.search(np.pad(vectors[::20], ((0, 0), (0, 1))), graph_search.BEAM)
    wide = vectors.astype(float)
    hit = sum(len(set(np.argsort(-(wide @ wide[q]))[:20]) & set(row)) for q, row in zip(range(0, 4000, 20), found, strict=True))
    assert hit >= 0.95 * 20 * len(found)


def test_neighbours_with_copies_and_unsound_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (rng.normal(size=4) if i % 3 else np.ones(4))]) for i in range(200)]
    unsound = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan")] * 4), (280, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (300, [])]
    table = spark.createDataFrame(rows + unsound + rows[:5], "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit(2), "shard": F.lit(3)})
    got = defaultdict(list)
    for r in graph_search.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    want = exact_neighbours(ids, vectors, np.flatnonzero(ids % 20 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.isclose(a[1], b[1], atol=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))
    assert graph_search.nearest(table.limit(0)).count() == 0
    assert graph_search.nearest(table.where("vec_id < 3 AND vec_id >= 0").dropDuplicates(["vec_id"])).count() == 2


def test_nearest_against_brute_force(spark):
    """The graphs of all shards, at a size where beams don't see a whole shard."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rng = np.random.default_rng(8)
    more = [(int(10_000 + i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 64)) / 8)]
    table = table.unionByName(spark.createDataFrame(more, table.schema))
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = exact_neighbours(ids, vectors, np.flatnonzero(ids % 20 == 0))
    got = defaultdict(dict)
    for r in graph_search.nearest(table).collect():
        got[r.query_id][r.vec_id] = r.score
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len(got[q].keys() & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 20 * len(want)
    at = {int(i): k for k, i in enumerate(ids)}
    assert all(np.isclose(s, vectors[at[q]] @ vectors[at[v]], rtol=0, atol=1e-12) for q in got for v, s in got[q].items())  # in double precision


def searched(vectors, every):
    """Neighbours by the graphs of one shard: {query: [vec_id]}."""
    import pandas as pd

    rows = pd.DataFrame({"dim": vectors.shape[1], "shard": 0, "vec_id": np.arange(len(vectors)), "embedding": list(vectors)})
    asked = np.arange(0, len(vectors), every)
    asked = pd.DataFrame({"dim": vectors.shape[1], "shard": 0, "embedding": list(vectors[asked]), "ids": [np.array([q]) for q in asked]})
    out = graph_search._search(20, graph_search.BEAM)(pd.concat([graph_search._build(rows), asked], ignore_index=True))
    return out.groupby("query_id").vec_id.apply(list).to_dict()


@pytest.mark.parametrize("kind", ["unit", "uniform", "log-normal", "one of 1e20", "one of 1e300", "tiny and huge"])
def test_recall_at_any_lengths(kind):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(10_000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    lengths = {"uniform": rng.uniform(0.1, 1, 10_000), "log-normal": rng.lognormal(0, 1, 10_000), "tiny and huge": 10.0 ** rng.uniform(-140, 140, 10_000)}.get(kind, np.ones(10_000))
    if kind.startswith("one"):
        lengths[5] = float(kind[7:])
    vectors = vectors * lengths[:, None]
    got, hit = searched(vectors, 50), 0
    with np.errstate(over="ignore"):
        for q in range(0, 10_000, 50):
            order = np.lexsort((np.arange(10_000), -(vectors @ vectors[q])))
            hit += len(set(got[q]) & set(order[order != q][:20]))
    assert all(len(x) == 20 for x in got.values()) and len(got) == 200
    assert hit >= 0.95 * 20 * 200


def test_uneven_lengths_through_shards(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(3000, 8)) * rng.lognormal(0, 2, 3000)[:, None]
    vectors[7] = [1e20, *[0.0] * 7]
    vectors[8] = [1e-320, *[0.0] * 7]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in graph_search.nearest(table).collect():
        got[r.query_id].add(r.vec_id)
    want = exact_neighbours(np.arange(3000), vectors, np.arange(0, 3000, 20))
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_graphs_are_built_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "QUERY_ROWS", 4)  # several blocks of queries
    built = graph_search._build(__import__("pandas").DataFrame({"dim": 3, "shard": 0, "vec_id": range(40), "embedding": list(np.random.default_rng(0).normal(size=(40, 3)))}))
    assert len(built) == 40 and built.edges.map(len).between(1, graph_search.DEGREE).all() and built.entry.any()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert graph_search.nearest(table).groupBy("query_id").count().where("count = 20").count() == table.where("vec_id % 20 = 0").count()


# 7 mixing


def water_level(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return {**target, **{s: weight[s] * level for s in open_}}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from(["a", "B", "é", "", "zz", "c", "d"])), st.integers(0, 1000), min_size=1))
def test_targets_fill_like_water(spark, sizes):
    rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size long")
    got = {None if r.no_source else r.source: r.target for r in mixing.targets(rows).collect()}
    want = water_level(sizes)
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in want)


def test_mixing_odd_tables(spark, odd, empty):
    got = mixing.mix(odd).join(odd.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = defaultdict(int)
    for r in mixing.mix(odd).collect():
        total[r.target] += r.taken
    assert all(abs(t - n) <= 2 for t, n in total.items() if list(total).count(t) == 1)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


# 8 exact dedup


def test_exact_odd_tables(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    for width in (1, 3, 64):
        got = exact_dedup.exact_groups(odd, first_digit=width).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        want = {hashlib.sha256(k.encode()).hexdigest(): (len(v), None if min(v)[1] else min(v)[2]) for k, v in groups.items()}
        assert {r.text_sha256: (r.group_size, r.keep_id) for r in got} == want
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


# 9 substring dedup


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 7), st.integers(1, 32), st.integers(40, 600))
def test_cuts_are_in_order_and_bounded(data, bits, least, most):
    text = data.decode("utf-8", "replace").encode()
    ends = gear.cuts(np.frombuffer(text, np.uint8), bits, least, most)
    assert ends.tolist() == sorted(set(ends.tolist())) and (not text or ends[-1] == len(text))
    assert (np.diff(np.concatenate([[0], ends])) <= most + 3).all()
    for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        text[a:b].decode()


def test_cuts_come_back_after_an_insertion():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    moved = np.concatenate([rng.integers(97, 123, 37).astype(np.uint8), data])
    a, b = gear.cuts(data, 5, 16, 256), gear.cuts(moved, 5, 16, 256)
    assert len(set(a.tolist()) & set((b - 37).tolist())) >= len(a) - 4


def test_blocks_make_no_difference(monkeypatch):
    data = np.random.default_rng(1).integers(0, 128, 9000).astype(np.uint8)
    whole = gear.cuts(data, 5, 16, 256)
    monkeypatch.setattr(gear, "BLOCK", 700)
    assert gear.cuts(data, 5, 16, 256).tolist() == whole.tolist()


def test_passages_are_caught(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    first, later = {}, set()
    for i in sorted(words):
        for k in range(len(words[i]) - 50):
            if first.setdefault(" ".join(words[i][k : k + 51]), i) != i:
                later.add(i)
    spans = substring_dedup.repeated_spans(docs).collect()
    assert len(later - {r.doc_id for r in spans}) <= 0.02 * len(later)
    texts = {r.doc_id: (r.text or "").encode().translate(substring_dedup.SPACES) for r in docs.select("doc_id", "text").collect()}
    for r in spans:  # each chunk of a reported span stands in an earlier place
        for low, high in zip(*(x.tolist() for x in substring_dedup.chunks_of(texts[r.doc_id].decode())[:2]), strict=True):
            if r.low <= low and high <= r.high:
                part, place = texts[r.doc_id][low:high], texts[r.doc_id].find(texts[r.doc_id][low:high])
                assert place < low or any(part in t for i, t in texts.items() if i < r.doc_id)
        assert r.words >= 25 and r.words >= len(texts[r.doc_id][r.low : r.high].split()) - 1
    runs = Counter(" ".join(w[k : k + 5]) for i, w in words.items() for k in range(len(w) - 4))
    clean = {i for i, w in words.items() if len(w) >= 10 and all(runs[" ".join(words[i][k : k + 5])] == 1 for k in range(len(words[i]) - 4))}
    assert clean and not clean & {r.doc_id for r in spans}


def test_spans_are_cut_from_texts(spark, odd, empty):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(n))
    passage = prose(80)
    rows = [(1, f"{prose(50)} {passage} {prose(50)}"), (2, f"{prose(30)} {passage.replace(' ', chr(10))} {prose(30)}"), (3, prose(100)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "low": F.lit(2)})
    spans = substring_dedup.repeated_spans(docs).collect()
    assert [(r.doc_id, r.first_doc_id) for r in spans] == [(2, 1)] and spans[0].words >= 60
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[4] is None
    assert got[2].encode() == rows[1][1].encode()[: spans[0].low] + rows[1][1].encode()[spans[0].high :]
    assert substring_dedup.substring_dedup(odd).columns == odd.columns and substring_dedup.substring_dedup(odd).count() == 16
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_spans_of_rows_that_share_ids(spark):
    """Rows of one id, or of none, lose their own repeats only."""
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n))
    passage, other = prose(90), prose(400)
    rows = [("a", f"{prose(40)} {passage}"), ("b", f"{prose(40)} {passage}"), ("b", other), (None, other[:1500] + prose(90)), (None, prose(200)), (None, f"{passage} {prose(30)}"), ("b", other)]
    got = Counter((r.doc_id, r.text) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    kept = Counter(rows)
    assert all(got[rows[k]] == kept[rows[k]] for k in (0, 2, 4))
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r.doc_id, r.first_doc_id) for r in spans) == {("b", "a"): 1, (None, "b"): 1, (None, "a"): 1}
    assert all(len(t) < len(r) for t, r in zip(sorted(t for i, t in got if (i, t) not in kept), sorted((rows[k][1] for k in (1, 3, 5))), strict=True) if t[:10] == r[:10])


def test_hot_chunks_are_dealt_out(spark, monkeypatch):
    from scopewise.llm import common

    monkeypatch.setattr(common, "SHARE", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 10}") for i in range(100)], "id long, key string")
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("twice", F.col("n") * 2)
    got = common.spread_join(rows, counts, "key", ["id"])
    assert sorted(got.columns) == ["id", "key", "twice"] and Counter(r.twice for r in got.collect()) == {100: 50, 20: 50}


# 10 line dedup


def test_windows_are_removed(spark, odd, empty):
    rows = [(2, "a\nb\nc\nd\ne"), (1, "x\na\nb\nc"), (3, "b\nc\nd\na\nb\nc\nz"), (4, "a\nb"), (5, None), (None, "a\nb\nc"), (6, "\n\n\n\n"), (2, "a\nb\nc\nd\ne")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"at": F.lit(1), "h1": F.lit(2), "place": F.lit(3), "starts": F.lit(4), "key": F.lit(5), "row": F.lit(6)})
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: ("x\na\nb\nc", 4, 0), 2: ("d\ne", 5, 3), 3: ("z", 7, 6), 4: ("a\nb", 2, 0), 5: (None, 0, 0), None: ("", 3, 3), 6: ("", 5, 4)}
    assert line_dedup.line_dedup(odd).count() == 16
    assert line_dedup.line_dedup(empty).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("n_lines", F.lit("theirs"))
    again = line_dedup.line_dedup(named)
    assert again.columns == [*named.columns, "n_removed"]  # n_lines is replaced
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in again.collect()} == {i and f"d{i}": v for i, v in got.items()}


# the pipeline


def test_pipeline_against_brute_force(spark, tmp_path, reference):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 7)))) for _ in range(n))
    base = [prose(120) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t.upper().replace(" ", "!! "), "en", "s0", 1) for i, t in enumerate(base[:20])]  # junk
    rows += [(200 + i, t.replace(" ", "  ", 1) if i % 2 else t, "en", "s1", 1) for i, t in enumerate(base[:10])]  # copies
    rows += [(300 + i, " ".join(["new", *t.split()[1:]]), "en", "s2", 1) for i, t in enumerate(base[20:30])]  # near copies
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 200), 0) for i, *_ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
        seen.append(Counter(r.doc_id for r in docs.collect()))
    good = [i for i, *_ in rows if not 100 <= i < 200]
    assert sorted(seen[0]) == good
    text = {i: t for i, t, *_ in rows}
    groups = defaultdict(list)
    for i in good:
        groups[plain(text[i])].append((-len(text[i]), i))
    exact = sorted(min(v)[1] for v in groups.values())
    assert sorted(seen[1]) == exact
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = [i for i in exact if not any(j < i and len(shingles(text[i]) & shingles(text[j])) >= 0.8 * len(shingles(text[i]) | shingles(text[j])) for j in exact)]
    assert sorted(seen[2]) == near
    size = {i: len(text[i].split()) for i in near}
    source = {i: s for i, _, _, s, _ in rows}
    total = Counter()
    for i in near:
        total[source[i]] += size[i]
    target, want = water_level(total), Counter()
    for s in total:
        budget, before = int(target[s]), 0
        for i in sorted((i for i in near if source[i] == s), key=lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i)):
            taken = budget // total[s] * size[i] + max(0, min(size[i], budget % total[s] - before))
            before += size[i]
            if taken:
                want[i] = -(-taken // size[i])
    assert seen[3] == want
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in last) == want
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == reference.encode(text[r.doc_id], add_special_tokens=False).ids for r in last)


def test_pipeline_decodes_its_tokens(spark, odd):
    import corpus_pipeline

    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.tokens(spark, odd, "").collect())
    assert got == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())


def test_pipeline_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for _, step in corpus_pipeline.STAGES[:-1]:
            after = step(spark, docs, f"{tmp_path}/{name}")
            assert after.columns == docs.columns and after.distinct().count() <= docs.distinct().count()
            assert after.distinct().subtract(docs).count() == 0
        last = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(last) == (name == "odd")


def test_queries_are_registered():
    names = json.dumps(sorted(queries.QUERIES))
    assert all(re.search(rf'"op{n}_', names) for n in range(1, 11)) and "pipeline" in queries.QUERIES


def test_workers_need_no_copy_of_the_package(tmp_path, sf):
    """Functions travel whole: a driver that only has the repository on its own path can run everything."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(queries.__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("op1_simhash", "op2_quality", "op4_bpe", "op5_language", "op6_graph_search", "op9_substring_dedup", "pipeline", "chunk_documents", "sentence_extract", "context_packing"):
    __spark_entry__.queries()[name](spark, {sf!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "all ran" in said.stdout, said.stderr[-1500:]

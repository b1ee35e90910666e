"""Resampling, periodic runs and piecewise hashes against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from perfloom.llm import periodic, piecewise, resample
from perfloom.llm.queries import QUERIES
from tests.llm.test_operators import ODD

NAMES = "row long, bucket string, words long, runs_sha256 string, start string, id long, rank string, score string, fingerprint string, task string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators might use themselves."""
    more = [*ODD, (20, "x y " * 400), (21, "\n\nline one is here\n\n\nline one is here\nend"), (22, "a\nb\nc\nd"), (23, "Z\r\nB é ü\x00q")]
    rows = [(i, t, k, "b", k, "s", "t", k, "r", "5", "f", "x") for k, (i, t) in enumerate(more)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {NAMES}").cache()


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def write(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- periodic runs

def brute_runs(w, times=4, least=6):
    n, out = len(w), []
    for q in range(1, n):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(least, times * q) and not any(all(w[k] == w[k - p] for k in range(s + p, s + size)) for p in range(1, q)):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize("times, least", [(4, 6), (4, 1), (5, 30), (4, 50)])
def test_runs_are_those_of_brute_force(times, least):
    rng = random.Random(times * 100 + least)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3) if w else 0):
            a, p = rng.randrange(len(w)), 1 + rng.randrange(9)
            for i in range(a + p, min(len(w), a + rng.randrange(60))):
                w[i] = w[i - p]
        assert periodic.runs(w, times, least) == brute_runs(w, times, least)


def test_frequent_words_stay_cheap():
    assert periodic.runs(["a"] * 300_000) == [(0, 300_000, 1)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 200_000:  # every word repeats everywhere, no run has four periods
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic.runs(list(fibonacci[-1])) == []


def brute_periodic(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode() if i is not None else b""), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w) if len(w) < 2000 else periodic.runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


def test_periodic_query_odd_rows(spark, odd, empty, tmp_path):
    sf = write(tmp_path, documents=odd)
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted((brute_periodic(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert QUERIES["op12_periodic_runs"](spark, write(tmp_path, documents=empty)).collect() == []


def test_periodic_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 9000).collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert all(got[r.doc_id] == brute_periodic(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got.values()) >= 0.05 * len(docs)


# ---- resampling

def brute_resample(docs, target):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = (collections.Counter(b for x in side for b in features(x)[1]) for side in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for i, x in docs:
        n, fs = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in fs)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    return [(*r[:4], None) for r in rows if not r[4]] + [(*r[:4], k + 1 if k < len(drawn) else None) for k, r in enumerate(able)]


def test_resampling_odd_rows(spark, odd, empty, tmp_path):
    target = [(1, "line one is here\nthe end of it"), (2, None), (3, ""), (4, "x y x y quick brown fox")]
    bench = spark.createDataFrame([(*r, "d", 3) for r in target], "item_id long, text string, doc_id string, n long")
    sf = write(tmp_path, documents=odd.union(odd).union(odd), benchmark=bench)
    rows = [(r.doc_id, r.text) for r in odd.collect()] * 3
    got = QUERIES["op11_line_resampling"](spark, sf).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}
    assert sorted(map(tuple, got), key=repr) == sorted(brute_resample(rows, [x for _, x in target]), key=repr)
    sf = write(tmp_path, documents=odd, benchmark=bench.limit(0))
    got = QUERIES["op11_line_resampling"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_resample([(r.doc_id, r.text) for r in odd.collect()], []), key=repr)
    assert QUERIES["op11_line_resampling"](spark, write(tmp_path, documents=empty, benchmark=bench)).collect() == []


def test_resampling_draws_by_range_in_order(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("same line of words here\n"), 6), F.col("id").cast("string")).alias("text"))
    target = spark.createDataFrame([("same line of words",)], "text string")
    got = sorted(map(tuple, resample.resample(docs, target, percent=40).collect()), key=repr)
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], ["same line of words"])
    order = sorted((r for r in want), key=lambda r: (-r[3], r[0]))
    assert [r[:4] for r in got] == sorted((r[:4] for r in want), key=repr)
    assert [r[0] for r in sorted((r for r in got if r[4]), key=lambda r: r[4])] == [r[0] for r in order[:1200]]


def test_crossing_features_complete_those_of_lines():
    rng = random.Random(3)
    for _ in range(300):
        lines = [[b"abcd"[k : k + 1] for k in rng.choices(range(4), k=rng.randrange(1, 5))] for _ in range(rng.randrange(6))]
        parts = [resample.feature_buckets(x).tolist() for x in lines] + [resample.crossing_buckets(lines).tolist()]
        assert sorted(sum(parts, [])) == sorted(resample.feature_buckets(sum(lines, [])).tolist())


# ---- piecewise hashes

def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def brute_fingerprint(text):
    """Every byte's hash and every size from 1 up, one at a time."""
    data = (text or "").encode()

    def h(i):
        out = 0
        for back in range(min(7, i + 1)):
            out += (data[i - back] + 1) * pow(0x01000193, back, 1 << 32)
        out &= 0xFFFFFFFF
        out ^= out >> 16
        out = out * 0x7FEB352D & 0xFFFFFFFF
        out ^= out >> 15
        out = out * 0x846CA68B & 0xFFFFFFFF
        return out ^ out >> 16

    hs = [h(i) for i in range(len(data))]
    cuts = {k: [i + 1 for i, x in enumerate(hs) if x % (1 << k) == (1 << k) - 1] for k in range(36)}
    k = next(k for k in range(34) if len(cuts[k]) < 64)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(level):
        ends = [0, *cuts[level], *([len(data)] if len(data) > (cuts[level] or [0])[-1] else [])]
        return "".join(letters[zlib.crc32(data[a:b]) % 64] for a, b in zip(ends, ends[1:]))

    return ":".join([str(1 << k), *(signature(k + j) for j in range(3))])


def brute_against_next(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        own, mark, other = brute_fingerprint(t), brute_fingerprint(changed), brute_fingerprint(n)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, mark, piecewise.likeness(own, mark), piecewise.likeness(own, other)))
    return out


def test_common_subsequence_is_that_of_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(70))) for _ in range(2))
        assert piecewise.common_subsequence(a, b) == brute_lcs(a, b)


def test_likeness():
    base = " ".join(f"word{k}" for k in range(400))
    one = piecewise.fingerprint(base)
    assert one == piecewise.fingerprint(base) and piecewise.likeness(one, one) == 1
    near = piecewise.likeness(one, piecewise.fingerprint(base.replace("word200", "other thing")))
    assert 0.9 < near < 1 and near == piecewise.likeness(piecewise.fingerprint(base.replace("word200", "other thing")), one)
    assert piecewise.likeness(one, piecewise.fingerprint(" ".join(f"term {k * 7}" for k in range(400)))) == 0
    assert 0.3 < piecewise.likeness(one, piecewise.fingerprint(base + " " + " ".join(f"tail{k}" for k in range(400)))) < 0.8
    assert piecewise.fingerprint("") == piecewise.fingerprint(None) == "1:::"
    assert piecewise.likeness("1:::", one) == 0


def test_piecewise_query_odd_rows(spark, odd, empty, tmp_path):
    short = odd.where("text is null or length(text) < 20000")
    rows = sorted(((r.doc_id, r.text) for r in short.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = QUERIES["op13_piecewise_hash"](spark, write(tmp_path, documents=short.repartition(3))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_against_next(rows), key=repr)
    assert QUERIES["op13_piecewise_hash"](spark, write(tmp_path, documents=empty)).collect() == []
    one = QUERIES["op13_piecewise_hash"](spark, write(tmp_path, documents=odd.where("doc_id = 1"))).collect()
    assert [tuple(r) for r in one] == brute_against_next([(one[0].doc_id, odd.where("doc_id = 1").first().text)])


def test_piecewise_query_crosses_tasks(spark):
    docs = spark.range(500).select((F.col("id") * 3 % 500).alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(8)]).alias("text"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = piecewise.against_next(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(map(tuple, got)) == sorted(brute_against_next(rows))
    assert sum(0.4 < r.near_edited < 0.8 for r in got) >= 0.95 * len(got) and max(r.near_next for r in got) < 0.3

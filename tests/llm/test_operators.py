"""The training-data operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from perfloom.llm import ann, decontaminate, html_template, packing, pitman_yor, preference, quality, sharding, simhash, tokencount
from perfloom.llm.queries import ORACLES, QUERIES
from tests.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BASE = " ".join(f"word{i}" for i in range(300))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, None), (3, ""), (4, "   \t\n "),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today"), (None, "no id here"), (7, "a"), (7, "a"),
    (8, "Straße ÉCOLE naïve 東京   x y <|endoftext|> é"), (9, "x" * 70_000), (10, "tok " * 30_000), (11, BASE), (12, BASE.replace("word150", "other")),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with extra columns whose names operators might use themselves."""
    rows = [(i, t, k, "src") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp long, score string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp long, score string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF), oracle_connection(SF), ORACLES[name]) is None


# ---- quality

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op1_nb_svm"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_dual_solution_is_optimal():
    rng = np.random.default_rng(0)
    xs = [np.sort(rng.choice(200, 20, replace=False)) for _ in range(60)]
    y = np.array([x[:10].sum() % 2 == 0 for x in xs])
    ratio = quality.log_count_ratio(xs, y)
    w, b = quality.dual_descent(xs, y, ratio, rounds=300)

    def loss(w, b):
        m = [w[x] @ (ratio[x] / np.linalg.norm(ratio[x])) + b for x in xs]
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - (1 if l else -1) * v) for l, v in zip(y, m))

    best = loss(w, b)
    for _ in range(200):
        assert loss(w + np.where(np.arange(len(w)) < 200, rng.normal(0, 0.02, len(w)), 0), b + rng.normal(0, 0.02)) >= best - 1e-3


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, None), (None, 1)], "doc_id long, quality int")
    for docs in (odd, empty):
        model = quality.fit(docs, labels)
        out = quality.scored(docs, model)
        assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
        assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.train([], np.zeros(0, bool)).score(np.zeros(0, int)) == 0.5


def test_quality_query_with_clashing_columns(spark, tmp_path):
    rows = [(k, ("good words of a text %d " % k) * 5 if k % 2 else "BUY NOW %d !!! " % k * 5, "clash", "x", True) for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string, held_out boolean").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, "z") for k in range(80)], "doc_id long, quality int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op1_nb_svm"](spark, str(tmp_path)).collect()
    assert len(got) == 80 and all(isinstance(r.score, float) and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 70


# ---- near duplicates

def brute_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_simhash_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows.items()}
    top = groups_of(sorted(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = QUERIES["op2_simhash"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", top[i]) for i in rows}


@pytest.mark.parametrize("distance", [0, 2, 4, 7, 12])
def test_links_are_exactly_the_near_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    points = {int(b) for b in base}
    for b in base:
        for n in range(1, 14):
            flip = sum(1 << int(x) for x in rng.choice(63, n, replace=False))
            points.add(int(b) ^ flip)
    pts = sorted(points)
    want = {(a, b) for a in pts for b in pts if a < b and (a ^ b).bit_count() <= distance}
    got = simhash.links(spark.createDataFrame([(p,) for p in pts], "fp long"), distance).collect()
    assert {(r.a, r.b) for r in got} == want
    # The forest of links has the same components.
    frame = spark.createDataFrame([(p, p, 0, 10) for p in pts], "point long, fp long, fp2 long, size long")
    forest = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.similar_links(frame, distance, distance, 0.8).collect()}
    assert forest <= want
    assert groups_of(pts, lambda a, b: (a, b) in forest) == groups_of(pts, lambda a, b: (a, b) in want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 600), (600, 700)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 600: 500, 700: 500}


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert next(r for r in rows if r.doc_id == 5).component_id == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 7), (False, 8), (False, 9), (False, 10), (False, 11), (True, 0)]
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    texts, words = [], lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    for size in (9, 40, 204, 204, 204, 1000):
        base = words(size)
        texts.append(base)
        for changed in (1, 2, 3, 4, 5, 6, 8, 10, 14):  # a changed word changes five shingles
            copy = list(base)
            for at in rng.choice(size, min(size, changed), replace=False):
                copy[at] = words(1)[0]
            texts.append(copy)
        texts += [base[: int(size * part)] for part in (0.7, 0.79, 0.81, 0.9)]
        texts += [base + base[:8] * 30, base * 3, texts[-1] + words(4)]  # repeats hardly change the set
    docs = {i: " ".join(t) for i, t in enumerate(texts)}
    sets = {i: {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for i, t in enumerate(texts)}
    top = groups_of(sorted(docs), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    got = simhash.keep_one(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(top.values()))


def test_sets_are_joined_exactly_in_blocks(spark):
    """Pools of sets that are near 0.8, with groups to begin with, in blocks of a few sets."""
    rng = np.random.default_rng(2)
    rows, sets = [], {}
    for pool in range(3):
        base = rng.integers(0, 1 << 40, 45)
        for k in range(60):
            s = base.copy()
            s[rng.choice(45, rng.integers(1, 5 if pool else 7), replace=False)] = rng.integers(0, 1 << 40)
            node = pool * 1000 + k
            sets[node] = np.unique(s[: rng.integers(34, 46)])
            rows.append((pool, node, pool * 1000 + (k % 7 if k < 20 else k), sets[node].tolist()))
    frame = spark.createDataFrame(rows, "pool long, node long, root long, s array<long>")
    for block in ({}, {"block_sets": 9, "block_elements": 10_000}, {"block_sets": 100, "block_elements": 300}):
        found = {(r.a, r.b) for r in simhash.joined_sets(frame, 0.8, **block).collect()}
        near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9
        assert all(near(a, b) for a, b in found)
        start = {r[1]: r[2] for r in rows}
        want = groups_of(sorted(sets), lambda a, b: a // 1000 == b // 1000 and (start[a] == start[b] or near(a, b)))
        assert groups_of(sorted(sets), lambda a, b: start[a] == start[b] or (a, b) in found) == want


def test_one_large_group_of_copies_that_differ(spark):
    """Near copies of one text, most of them too far from each other: the rows that meet stay few and the groups are exact."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 44)]
    texts = []
    for k in range(400):
        copy = list(base)
        for at in rng.choice(44, 1 + k % 2, replace=False):
            copy[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    top = groups_of(range(400), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    got = simhash.keep_one(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(top.values())) and 1 < len(got) < 400


# ---- sharding

def test_shards_move_rows_only_to_the_new_one_and_slots_are_gapless(spark, odd, empty):
    for docs, n in ((spark.read.parquet(f"{SF}/documents.parquet"), 200), (odd, len(ODD)), (empty, 0)):
        rows = sharding.shard_slots(docs, [1.0] * 8).collect()
        assert len(rows) == n
        per = collections.defaultdict(list)
        for r in rows:
            per[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8) and r.law == "key"
        assert all(sorted(v) == list(range(len(v))) for v in per.values())
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in sharding.shard_slots(odd, [1.0] * 8).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_follow_weights(spark):
    ids = spark.range(20_000)
    got = collections.Counter(r.shard for r in sharding.shard(ids, "id", [1.0, 3.0, 0.0]).collect())
    assert got[2] == 0 and abs(got[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def test_numbering_repeats_equal_rows(spark):
    from perfloom.llm.common import numbered

    df = spark.createDataFrame([("a", 1)] * 50 + [("a", 2), ("b", 1), (None, 3)], "g string, x int")
    got = collections.defaultdict(list)
    for r in numbered(df, "g", "number", cells=4).collect():
        got[r.g].append(r.number)
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(51)), "b": [0], None: [0]}


# ---- packing

def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    seq, doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        doc[r.doc_id].append(r)
    for parts in seq.values():
        end = 0
        for off, n in sorted(parts):
            assert off == end
            end += n
        assert end <= capacity
    assert doc.keys() == ids.keys()
    for k, parts in doc.items():
        whole = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in parts})
        assert sum(p[1] for p in whole) == len(ids[k])
        for start, n, crc, total in whole:
            assert total == len(ids[k]) and crc == zlib.crc32(np.array(ids[k][start : start + n], dtype="<u4").tobytes())
    return sum(r.length for r in rows) / (capacity * len(seq)) if seq else 1.0


def test_packing_round_trip(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, BPE).collect()
    assert check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048) > 0.97
    rows = packing.pack(odd, BPE, capacity=512).collect()
    check_packing(rows, dict(ODD), 512)
    assert sum(r.doc_id == 7 for r in rows) == 2
    assert packing.pack(empty, BPE).count() == 0


def test_token_ids_in_chunks_are_the_tokenizers():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ["", " ", "  a  b ", "it's we'LL 12 345,6\t\tx\r\n\r\n  y ", "a 　b  c", "\x1c a\x1db \x85 z", "日本語 テスト", "🙂👍🏽 ok", "<|endoftext|> a", "é" * 300]
    for t in texts:
        assert packing.token_ids(t, BPE).tolist() == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 700, 1023, 1024, 1025, 2047, 2048, 2049, 9999])
def test_cut_covers_a_document(n):
    parts = packing.cut(n, 2048)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    assert all(p == 2048 // (2048 // p) for p in parts[:-1])


# ---- token counts

def brute_viterbi(text, vocab):
    best, unknown = [(0.0, 0)] + [None] * len(text), min(vocab.values()) - 10
    for start in range(len(text)):
        score, n = best[start]
        single = False
        for end in range(start + 1, len(text) + 1):
            if text[start:end] in vocab:
                single |= end == start + 1
                s = score + vocab[text[start:end]]
                if best[end] is None or s > best[end][0]:
                    best[end] = (s, n + 1)
        if not single and (best[start + 1] is None or score + unknown > best[start + 1][0]):
            best[start + 1] = (score + unknown, n + len(text[start].encode()))
    return best[-1][1], best[-1][0]


def test_viterbi_counts_match_a_search_from_every_start():
    vocab = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -4.0, "▁a": -5.0, "aba": -6.0, "ba": -4.0, "▁▁": -6.0}
    count = tokencount.Counter(list(vocab.items()))
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("aab  cé"), rng.integers(1, 14)))
        assert count(text) == brute_viterbi("▁" + text.replace(" ", "▁"), vocab), text
    odd = tokencount.Counter([("a▁b", -1.5), ("a", -1.25), ("b", -1.0), ("▁", -2.0)])
    assert not odd.chunked and odd("a b") == brute_viterbi("▁a▁b", {"a▁b": -1.5, "a": -1.25, "b": -1.0, "▁": -2.0})


def test_viterbi_counts_match_the_tokenizer_library(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i))]
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *[(p, s) for p, s in vocab if not p.startswith("<0x")]], unk_id=0, byte_fallback=False))
    got = {r.doc_id: r.n_pieces for r in QUERIES["op5_viterbi_count"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000").collect():
        pieces = tok.encode("▁" + r.text.replace(" ", "▁"))
        want = sum(len(r_.encode()) if i == 0 else 1 for i, r_ in ((i, ("▁" + r.text.replace(" ", "▁"))[a:b]) for i, (a, b) in zip(pieces.ids, pieces.offsets)))
        assert got[r.doc_id] == want


def test_token_counts_odd_rows(spark, odd, empty):
    rows = tokencount.token_counts(odd, PIECES).collect()
    assert len(rows) == len(ODD) and all((r.n_pieces, r.score) == (0, 0.0) for r in rows if r.doc_id in (2, 3))
    assert tokencount.token_counts(empty, PIECES).count() == 0


# ---- language model

def test_language_model_bases_and_gain(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = pitman_yor.score(docs, ~pitman_yor.held_out()).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    words = lambda t: (t or "").encode().lower().split() + [b""]
    seen = collections.Counter()
    for r in texts:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            seen.update(words(r.text))
    n, v = sum(seen.values()), len(seen)
    base = lambda t: sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t))
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(words(r.text)), sum(seen[w] > 0 for w in words(r.text)), round(base(r.text), 4)) for r in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert pitman_yor.score(empty, ~pitman_yor.held_out()).count() == 0


def test_seating_follows_the_process():
    rng = np.random.default_rng(3)
    t = pitman_yor.seat(np.full(20_000, 40), np.full(20_000, 2.0), 0.5, rng)
    want = []
    for _ in range(4_000):
        k = 1
        for j in range(1, 40):
            k += rng.random() < 2.0 / (2.0 + j - 0.5 * k)
        want.append(k)
    assert abs(t.mean() - np.mean(want)) < 0.15
    assert pitman_yor.seat(np.array([1, 1]), np.array([9.0, 9.0]), 0.5, rng).tolist() == [1, 1]
    big = pitman_yor.seat(np.full(200, 50_000), np.full(200, 3.0), 0.0, rng)
    assert abs(big.mean() - (1 + sum(3.0 / (3.0 + j) for j in range(1, 50_000)))) < 2.5


def test_probabilities_sum_to_one():
    t = pitman_yor.Totals(np.array([7.0]), np.array([[4.0]]), np.array([4.0]), np.array([3.0]), 7, 3, 0.6, 0.4)
    root = t.root(np.array([2.0, 1.0, 1.0, 0.0]), np.array([1.0, 1.0, 1.0, 0.0]))
    assert abs(root.sum() - 1) < 1e-12


# ---- decontamination

def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "quick brown FOX"), (2, None), (3, "?!"), (4, " ".join(f"word{i}" for i in range(40, 55))), (10, "fox jumps")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.report(odd, bench).collect()}
    assert len(decontaminate.report(odd, bench).collect()) == len(ODD)
    assert (got[1, 15].n_hit, got[1, 15].n_items, got[1, 15].contaminated) == (4, 2, True)
    assert (got[11, 300].n_hit, got[11, 300].n_items) == (15, 1) and got[2, 0].n_hit == 0
    kept = decontaminate.remove_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    cut = {r.fp: r.text for r in decontaminate.remove_spans(odd, bench).collect()}
    assert cut[0] == "The over the lazy dog near the old river bank today" and cut[1] is None and cut[8] == ODD[8][1]
    for docs, items in ((empty, bench), (odd, bench.limit(0))):
        assert not any(r.contaminated for r in decontaminate.report(docs, items).collect())
        assert decontaminate.remove_documents(docs, items).count() == docs.count()


# ---- pages

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/x">Home %d</a></nav>
<div class="cookie-notice">We use cookies</div><div id=content><h1>Head &amp; tail %d</h1><p>First   para %d<br>more<p>Second &lt;b&gt; para %d
<script>var s = "</p>";</script><div class="comments"><p>Nice one %d</p></div></div><aside>More</aside><footer>&copy; us</footer>"""


def test_template_finds_the_main_slot(spark):
    rows = [(i, f"http://Host.example.com:80/{i}", PAGE % ((i,) * 5)) for i in range(8)] + [
        (20, None, None), (21, "", ""), (22, "http://one.example.com", "<p>Just <b>this"), (22, "http://one.example.com", "<p>Just <b>this")]
    got = html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Head & tail 3\n\nFirst para 3 more\n\nSecond <b> para 3"
    assert text[20] == text[21] == "" and text[22] == "Just this" and all(r.n_chars == len(r.text) for r in got)
    slots = {r.host: r.slot for r in html_template.templates(
        spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_template.host_of(F.col("url")))).collect()}
    page = html_template.Page(PAGE % ((1,) * 5))
    assert slots["host.example.com"] == page.tokens[page.labels.index("div.content")]


NEUTRAL = ("<body><div class=x1><div class=y1><p>Go %(w)s<p>See %(w)s</div><div class=y2><h2>Title %(n)d</h2><div class=z>%(body)s</div></div>"
           "<div class=y3>Seen %(n)d times<p>Fixed words at the end</div></div></body>")


def _neutral(n, body=None):
    return NEUTRAL % {"n": n, "w": f"w{n % 3}", "body": body or "".join(f"<p>Paragraph {k} of {n} with some words</p>" for k in range(1 + n % 4))}


def test_template_needs_no_telling_names(spark, monkeypatch):
    """Menus, counters and fixed texts around an article under names that say nothing; without the template they stay."""
    rows = [(n, "http://plain.example.org/%d" % n, _neutral(n)) for n in range(12)]
    rows += [(50, "http://plain.example.org/50", _neutral(50, "<p>Short"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {n: "\n\n".join([f"Title {n}", *(f"Paragraph {k} of {n} with some words" for k in range(1 + n % 4))]) for n in range(12)} | {50: "Title 50\n\nShort"}
    assert {r.page_id: r.text for r in html_template.main_text(frame).collect()} == want
    without = html_template.Page(rows[0][2]).text(None, frozenset())
    assert without.startswith("Go w0") and without.endswith("Fixed words at the end")


def test_classes_out_of_order_are_no_template(spark):
    """Elements that occur once on every page but in changing order are not written by one template."""
    pages = ["<body>" + "".join(f"<div class=p{k}>{'text ' * 9 * (k + 1)}{n}</div>" for k in ([0, 1, 2] if n % 2 else [2, 0, 1])) + "</body>" for n in range(10)]
    frame = spark.createDataFrame([(n, "http://mixed.example.org", h) for n, h in enumerate(pages)], "page_id long, url string, html string")
    found = html_template.templates(frame.withColumn("host", F.lit("h"))).first()
    assert not found or found.slot not in html_template.Page(pages[0]).tokens[2:]
    assert all("text" in r.text and r.n_chars > 200 for r in html_template.main_text(frame).collect())


@pytest.mark.parametrize("html, want", [
    ('<body><nav>menu</nav><article class="post search-results share"><p>Kept</p></article>', "Kept"), ('<form id="aspnetForm"><div>all here</div></form>', "all here"),
    ('<main><div class="related-work">kept</div><div class="comment-list">no</div><form>no</form></main>', "kept"),
    ("<header>top</header><p>text<p>more&nbsp;of &lt;it&gt;", "text\n\nmore of <it>"), (None, ""), ("", ""), ("<article></article><p>x", "x")])
def test_text_of_a_single_page(html, want):
    assert html_template.Page(html or "").text(None, frozenset()) == want


def test_deep_pages_take_linear_time(spark):
    import time

    begin = time.time()
    for page in ("<div>" * 40_000 + "<p>deep", "<center>" * 40_000 + "<p>deep" + "</q></main>" * 1000):
        assert html_template.Page(page).text(None, frozenset()) == "deep"
    assert time.time() - begin < 10
    odd = spark.createDataFrame([(1, None, "<div>" * 5000 + "<p>deep", "h", 1)], "page_id long, url string, html string, host string, token long")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in html_template.main_text(odd).collect()] == [(1, None, "deep", 4)]
    assert html_template.main_text(odd.limit(0)).collect() == []


def test_template_pages_give_their_source_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import re

    for r in QUERIES["op8_template"](spark, SF).collect():
        source = docs.get(int(re.search(r"/(\d+)", r.url.split("//")[1])[1]))
        if source is not None:
            assert r.text.split("\n\n")[1:] == [" ".join(x.split()) for x in source.split("\n") if x.split()]
    assert QUERIES["op8_template"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("script", ["<script>for(var i=0;i<n;i++){go(i)}</script>", "<SCRIPT>if(a<b)x='it</SCRIPT >", "<style>a<b{}'</style\n>",
                                    "<script>document.write('</scripts>');a<b</script>"])
def test_scripts_with_comparisons_do_not_swallow_the_page(script):
    found = [t[1] for t in html_template.Page(f"<body><p>before</p>{script}<p>after</p><script>x</script><p>last</p>").texts]
    assert found == ["before", "after", "last"]
    assert [t[1] for t in html_template.Page("<p>kept<script>never closed <p>no").texts] == ["kept"]


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, "http://copies.example.com/a", PAGE % ((1,) * 5)) for i in range(60)] + [(60 + i, None, "<p>Lone %d" % (i // 3)) for i in range(12)]
    rows += [(80 + i, f"http://copies.example.com/{i}", PAGE % ((i,) * 5)) for i in range(3)]
    # Six different pages beside fifty copies of the first: menus go, paragraphs stay.
    rows += [(100 + i, "http://mixed.example.com/0", "<div>Menu</div><p>Own text %d" % max(0, i - 49)) for i in range(55)]
    text = {r.page_id: r.text for r in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(text) == len(rows)
    assert {text[i] for i in range(60)} == {"Head & tail 1\n\nFirst para 1 more\n\nSecond <b> para 1"}
    assert [text[60 + i] for i in range(12)] == [f"Lone {i // 3}" for i in range(12)]
    assert [text[100 + i] for i in range(55)] == [f"Own text {max(0, i - 49)}" for i in range(55)]


# ---- preference pairs

def test_preference_pairs(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, "user", None), (None, 0, None, "x"),
            (1, 1, "assistant", "good"), (4, 0, "user", "alone")]
    t = {r.id: r.turns for r in preference.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [len(t[k]) for k in (1, 2, 4, None)] == [2, 3, 1, 1]
    shape = "id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>"
    pairs = spark.createDataFrame([(1, t[1], t[2]), (2, t[1], t[1]), (3, t[4], t[None]), (4, t[4], None)], shape)
    got = {r.id: r for r in preference.preference_pairs(pairs).collect()}
    assert got[1].n_shared == 1 and got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\ngood<|end|>\n"
    for side in ("chosen", "rejected"):
        text, spans = got[1][side], got[1][side + "_spans"]
        assert [text[s.start : s.end] for s in spans] == [("good" if side == "chosen" else "bad") + "<|end|>\n"]
    assert (got[2].n_shared, got[2].chosen, got[2].rejected) == (2, "", "") and got[3].prompt == "" and got[4].rejected == ""


# ---- nearest neighbours

def test_neighbours_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    vec = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(vec))
    x = np.stack([vec[i] for i in ids])
    got = collections.defaultdict(list)
    for r in QUERIES["op10_adaptive_scan"](spark, sf).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - vec[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and [r[1] for r in rows] == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
        assert all(abs(s - d[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in rows)
        hit += len({r[1] for r in rows} & set(ids[np.lexsort((ids, d))[:10]]))
    assert hit >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()


def test_neighbours_odd_rows(spark):
    good = [float(i) for i in range(4)]
    rows = [(0, good), (100, good), (3, [v + 1 for v in good]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 2.0, 3.0]), (7, [float("nan"), 1.0, 1.0, 1.0]),
            (8, [float("inf"), 1.0, 1.0, 1.0]), (9, [1.0]), (3, [v + 1 for v in good]), (None, good)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 100, 0.0), (0, 2, 3, 2.0), (100, 1, 0, 0.0), (100, 2, 3, 2.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("case", ["copies", "clusters"])
def test_neighbours_of_repeated_and_clustered_vectors(spark, case):
    rng = np.random.default_rng(4)
    if case == "copies":  # one near id fills the first rows of every list
        base = rng.standard_normal(24)
        rows = [(1, (base + 1e-3).tolist())] * 1500 + [(2 + k, (base + rng.standard_normal(24) * 0.3).tolist()) for k in range(1500)] + [(0, base.tolist())]
        asks = set(range(0, 1500, 100))
    else:  # tight clusters of four rows: the nearest lists hold fewer than ten
        centres = rng.standard_normal((300, 16)) * 50
        rows = [(4 * c + k, (centres[c] + rng.standard_normal(16) * 1e-3).tolist()) for c in range(300) for k in range(4)]
        asks = set(range(0, 1200, 100))
    frame = spark.createDataFrame([(i, v, 1.0, i) for i, v in rows], "vec_id long, embedding array<double>, score double, id long")
    got = ann.nearest(frame, F.col("vec_id").isin(list(asks)), k=10).collect()
    vec, hits = {i: np.array(v) for i, v in rows}, 0
    for q in asks:
        d = sorted((float(np.sqrt(((vec[i] - vec[q]) ** 2).sum())), i) for i in vec if i != q)[:10]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in mine] == list(range(1, 11))
        hits += len({i for _, i in d} & {i for _, i in mine})
    assert hits >= 0.9 * 10 * len(asks)


def test_a_dense_group_gives_a_forest(spark):
    """All fingerprints of three flipped bits of twelve: most pairs are near, the links that are given are few, the groups the same."""
    base = 0x1234_5678_9ABC_DEF0
    pts = sorted({base ^ (1 << 5 * i) ^ (1 << 5 * j) ^ (1 << 5 * k) for i in range(12) for j in range(i) for k in range(j)}) + [base ^ 0xFFFF]
    want = {(a, b) for a in pts for b in pts if a < b and (a ^ b).bit_count() <= 4}
    got = simhash.links(spark.createDataFrame([(p,) for p in pts], "fp long"), 4, forest=True).collect()
    forest = {(r.a, r.b) for r in got}
    assert forest <= want and len(want) > 10 * len(pts) and len(forest) < 4 * len(pts)
    assert groups_of(pts, lambda a, b: (a, b) in forest) == groups_of(pts, lambda a, b: (a, b) in want)


def test_candidates_hold_the_grid_join(spark):
    """Points that share no band are met by their fingerprints: equal ones, and those that differ in four bits at most."""
    fp = [7, 7, 7 ^ 0b1111 << 20, 7 ^ 0b11111 << 40]
    rows = [(100 + i, f, i, 50, [1000 * i + k for k in range(simhash.BANDS)]) for i, f in enumerate(fp)]
    points = spark.createDataFrame(rows, "point long, fp long, fp2 long, size long, keys array<long>")
    assert {(r.a, r.b) for r in simhash._candidates(points, 0.8).collect()} == {(100, 101), (100, 102)}


def test_a_task_makes_stars_of_its_links(spark):
    """A chain within one task needs no rounds: every node hangs on the smallest."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(500)] + [(900, 800)], "a long, b long").coalesce(1)
    got = {(r.a, r.b) for r in edges.mapInArrow(simhash._stars, "a long, b long").collect()}
    assert got == {(i, 0) for i in range(1, 501)} | {(900, 800)}


def test_plans_of_near_dedup_stay_short(spark, monkeypatch):
    """Long plans weigh on the driver: no step of the stage holds more than eight exchanges."""
    exchanges, write = [], simhash.written

    def counted(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df)

    monkeypatch.setattr(simhash, "written", counted)
    kept = counted(simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet").limit(300)))
    assert kept.count() and max(exchanges) <= 8


def test_components_take_rounds_only_where_tasks_meet(spark, monkeypatch):
    """Stars are recognised, so links of one task are written once; a chain over many tasks comes out whole, in batches too."""
    writes, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: writes.append(0) or write(df))
    chain = [(i + 1, i) for i in range(300)] + [(900, 800), (900, 800), (5, 5)]
    edges = spark.createDataFrame(chain, "a long, b long")
    want = {(i, 0) for i in range(301)} | {(900, 800), (800, 800)}
    assert {(r.node, r.root) for r in simhash.components(edges.coalesce(1)).collect()} == want and len(writes) == 1
    assert sorted((r.node, r.root) for r in simhash.components(edges.repartition(16)).collect()) == sorted(want)
    monkeypatch.setattr(simhash, "STAR_NODES", 20)
    parts = simhash._stars(iter([pa.record_batch({"a": [i + 1], "b": [i]}) for i in range(100)]))
    assert sum(p.num_rows for p in parts) == 100

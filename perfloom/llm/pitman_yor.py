"""Language-model scoring by a hierarchical Pitman-Yor model.

Each context is a restaurant whose customers are the words that follow it; its tables are customers of the one root
restaurant that all contexts share as parent, and the root's tables draw words uniformly. A context is the word before, in one
of 65,536 hashed classes, so a context's totals are a table of fixed size. Seating is sampled by Gibbs sweeps: given all
other restaurants, a word's customers in a restaurant sit down in turn, each at a new table with the probability that the
process gives. Words are dealt to buckets by hash; buckets are swept side by side against the totals of the sweep before
(customers and tables per context, and of the root), which alone pass through the driver. Texts are scored by predictive
probabilities averaged over samples.

A word's counts travel summed per group of documents, and merge in steps of bounded size; what a document needs travels to the
word's bucket, and only sums per document and bucket come back. A bucket with more tokens than others, such as a frequent
word's, is scored by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.llm.common import id_remainder, ship, written

CLASSES = 1 << 16
#: Bytes of text that one group of documents, and that one bucket, holds; buckets at least; tokens of a bucket in one task;
#: messages that merge in one task.
GROUP_BYTES, BUCKET_BYTES, LEAST_BUCKETS, TASK_TOKENS, FAN_IN = 6 << 20, 40 << 20, 16, 16_000_000, 256
#: Concentrations. Discounts are estimated from the counts of ones and twos.
CONCENTRATION, ROOT_CONCENTRATION = 1.0, 10.0
#: Customers that sit down one by one; later ones come in parties of a sixteenth of those who sit.
SINGLE = 64


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, dtype=kind) if kind else raw


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], list]]:
    """Tokens of documents up to GROUP_BYTES: lowered words, an empty one (the end) after each document; lengths; keys."""
    tokens: list[bytes] = []
    lengths: list[int] = []
    keys: list = []
    size = 0
    for b in batches:
        extra = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)]
        for i, t in enumerate(b.column(0)):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            words = raw.lower().split()
            tokens += words
            tokens.append(b"")
            lengths.append(len(words) + 1)
            keys.append(tuple(e[i] for e in extra))
            size += len(raw) + 16
            if size >= GROUP_BYTES or len(lengths) >= 65_535:
                yield tokens, lengths, keys
                tokens, lengths, keys, size = [], [], [], 0
    if tokens:
        yield tokens, lengths, keys


def _coded(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, token codes, and of each word its class and hash for dealing; empties ``tokens``, which are large."""
    index: dict[bytes, int] = {}
    code = np.fromiter((index.setdefault(t, len(index)) for t in tokens), np.int64, len(tokens))
    tokens.clear()
    words = list(index)
    digest = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return words, code, (digest & np.uint64(CLASSES - 1)).astype(np.int64), digest >> np.uint64(24)


def _contexts(code: np.ndarray, classes: np.ndarray, words: list[bytes]) -> np.ndarray:
    end = classes[words.index(b"")]
    return np.concatenate(([end], classes[code[:-1]]))


def _spread(words: list[bytes], word: np.ndarray, bucket_of: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Per bucket its words, how many entries each has, and which entries; ``word`` is sorted."""
    n = np.bincount(word, minlength=len(words))
    order = np.argsort(bucket_of[word], kind="stable")
    of = bucket_of[word][order]
    cuts = np.flatnonzero(np.diff(of)) + 1
    for part in np.split(order, cuts):
        if len(part):
            w = word[part]
            own = w[np.concatenate(([True], w[1:] != w[:-1]))]
            yield int(bucket_of[w[0]]), [words[i] for i in own], n[own], part


_COUNTS = "bucket int, part int, words binary, n binary, ctx binary, cnt binary"


def _count_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "part", "words", "n", "ctx", "cnt"])


def _merge(rows: list[dict]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, entries per word, contexts and counts of several messages, in the order of words."""
    index: dict[bytes, int] = {}
    keys, counts = [], []
    for r in rows:
        own = np.array([index.setdefault(w, len(index)) for w in _unpack(r["words"]).split(b"\n")], dtype=np.int64)
        keys.append(np.repeat(own, _unpack(r["n"], "<u4")) * CLASSES + _unpack(r["ctx"], "<u2"))
        counts.append(_unpack(r["cnt"], "<i8"))
    key, cnt = np.concatenate(keys), np.concatenate(counts)
    if len(rows) > 1:
        order = np.argsort(key, kind="stable")
        key, cnt = key[order], cnt[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, cnt = key[first], np.add.reduceat(cnt, first)
    return list(index), np.bincount(key // CLASSES, minlength=len(index)), key % CLASSES, cnt


def counts(texts: DataFrame, buckets: int, groups: int) -> DataFrame:
    """One row per bucket: its words, and of each the contexts with their counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _, _ in _groups(batches):
            mark = xxhash.xxh32_intdigest(b" ".join(tokens[:64]) + str(len(tokens)).encode()) >> 1
            words, code, classes, deal = _coded(tokens)
            bucket_of = (deal % np.uint64(buckets)).astype(np.int64)
            key, n = np.unique(code * CLASSES + _contexts(code, classes, words), return_counts=True)
            rows = [(b, mark, _pack(b"\n".join(w)), _pack(k.astype("<u4")), _pack((key[p] % CLASSES).astype("<u2")), _pack(n[p].astype("<i8")))
                    for b, w, k, p in _spread(words, key // CLASSES, bucket_of)]
            yield _count_rows(rows)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words, n, ctx, cnt = _merge(rows)
        return pa.Table.from_batches([_count_rows([(rows[0]["bucket"], rows[0]["part"], _pack(b"\n".join(words)), _pack(n.astype("<u4")),
                                                    _pack(ctx.astype("<u2")), _pack(cnt.astype("<i8")))])])

    found = texts.mapInArrow(count, _COUNTS)
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        found = found.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")).groupBy("bucket", "part").applyInArrow(merge, _COUNTS)
    return written(found.withColumn("part", F.lit(0)).groupBy("bucket").applyInArrow(merge, _COUNTS))


@dataclass
class Totals:
    """What all buckets share: per context customers and tables (one row per sample), of the root customers and tables."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: np.ndarray
    root_tables: np.ndarray
    tokens: int
    words: int
    discount: float
    root_discount: float

    def root(self, customers: np.ndarray, tables: np.ndarray, sample: int = 0) -> np.ndarray:
        """Predictive probability of words in the root."""
        total, n = float(self.root_customers[sample]), float(self.root_tables[sample])
        unseen = (ROOT_CONCENTRATION + self.root_discount * n) / (self.words + 1)
        return (customers - self.root_discount * tables + unseen) / (ROOT_CONCENTRATION + total)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that ``customers`` of one dish take; ``weight`` is that of a new table, a taken one's its customers less discount."""
    order = np.argsort(-customers, kind="stable")
    n, a, t = customers[order], weight[order], np.ones(len(customers))
    active, seated = int((n > 1).sum()), 1
    while active:
        party = 1 if seated < SINGLE else max(1, seated // 16)
        new = a[:active] / (a[:active] + seated - discount * t[:active])
        if party == 1:
            t[:active] += rng.random(active) < new
        else:
            t[:active] += rng.binomial(np.minimum(party, n[:active] - seated), np.minimum(new, 1.0))
        seated += party
        active = int(np.searchsorted(-n[:active], -seated, side="left"))
    out = np.empty(len(t))
    out[order] = t
    return out


def _sweeps(row: dict, totals: Totals, burn: int, samples: int, seed: int):
    """Seats a bucket's words; per sample the tables per entry, and customers and tables of its words in the root."""
    n, ctx, cnt = _unpack(row["n"], "<u4").astype(np.int64), _unpack(row["ctx"], "<u2").astype(np.int64), _unpack(row["cnt"], "<i8")
    rng = np.random.default_rng([seed, row["bucket"]])
    word, first = np.repeat(np.arange(len(n)), n), np.concatenate(([0], np.cumsum(n)[:-1]))
    new = CONCENTRATION + totals.discount * totals.tables[0][ctx]
    customers, tables = n.astype(float), np.ones(len(n))
    out = []
    for i in range(burn + samples):
        t = seat(cnt, new * totals.root(customers, tables)[word], totals.discount, rng)
        customers = np.add.reduceat(t, first)
        weight = (ROOT_CONCENTRATION + totals.root_discount * totals.root_tables[0]) / (totals.words + 1)
        tables = seat(customers.astype(np.int64), np.full(len(n), weight), totals.root_discount, rng)
        if i >= burn:
            out.append((t, customers, tables))
    return ctx, cnt, out


def _by_context(rows: DataFrame, samples: int) -> np.ndarray:
    """Sums of the per-bucket vectors in ``tables`` (samples x classes), added up on the cluster; the result has a fixed size."""
    got = (rows.select(F.posexplode("tables").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow())
    out = np.zeros(samples * CLASSES)
    out[got.column("at").to_numpy()] = got.column("x").to_numpy()
    return out.reshape(samples, CLASSES)


def first_totals(table: DataFrame) -> Totals:
    """One table per entry, one root table per word; discounts from the counts of ones and twos."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n, ctx, cnt = _unpack(row["n"], "<u4"), _unpack(row["ctx"], "<u2"), _unpack(row["cnt"], "<i8")
                vec = np.concatenate((np.bincount(ctx, weights=cnt, minlength=CLASSES), np.bincount(ctx, minlength=CLASSES).astype(float)))
                sums = [float(x) for x in (len(n), cnt.sum(), len(cnt), (cnt == 1).sum(), (cnt == 2).sum(), (n == 1).sum(), (n == 2).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([vec.tolist()], pa.list_(pa.float64()))] + [pa.array([x]) for x in sums],
                                                 ["tables", "words", "tokens", "entries", "ones", "twos", "root_ones", "root_twos"])

    rows = written(table.mapInArrow(run, "tables array<double>, words double, tokens double, entries double, ones double, twos double, root_ones double, root_twos double"))
    s = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in rows.columns[1:]]).first()
    vec = _by_context(rows, 2)

    def discount(ones: float, twos: float) -> float:
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    return Totals(vec[0], vec[1:], np.array([s["entries"]]), np.array([s["words"]]), int(s["tokens"]), int(s["words"]),
                  discount(s["ones"], s["twos"]), discount(s["root_ones"], s["root_twos"]))


def sweep(table: DataFrame, totals: Totals, burn: int, samples: int, seed: int) -> tuple[DataFrame, Totals]:
    """Sampled seats of every bucket as a written table, and the totals after it."""
    shared = table.sparkSession.sparkContext.broadcast(totals)  # a few vectors of 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ctx, cnt, out = _sweeps(row, shared.value, burn, samples, seed)
                vec = np.concatenate([np.bincount(ctx, weights=t, minlength=CLASSES) for t, _, _ in out])
                mean = np.mean([t for t, _, _ in out], axis=0).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bucket"]], pa.int32()), *[pa.array([row[c]], pa.binary()) for c in ("words", "n", "ctx", "cnt")],
                     pa.array([_pack(mean)], pa.binary()), pa.array([_pack(np.stack([(c, t) for _, c, t in out]).astype("<f4"))], pa.binary()),
                     pa.array([float(cnt.sum())]), pa.array([vec.tolist()], pa.list_(pa.float64())),
                     pa.array([[float(x.sum()) for _, c, t in out for x in (c, t)]], pa.list_(pa.float64()))],
                    ["bucket", "words", "n", "ctx", "cnt", "mean", "root", "tokens", "tables", "sums"])

    rows = written(table.mapInArrow(run, "bucket int, words binary, n binary, ctx binary, cnt binary, mean binary, root binary, tokens double, tables array<double>, sums array<double>"))
    sums = rows.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(2 * samples)]).first()
    after = Totals(totals.customers, _by_context(rows, samples), np.array(sums[0::2]), np.array(sums[1::2]), totals.tokens, totals.words,
                   totals.discount, totals.root_discount)
    return rows, after


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.col(id_col), text).alias("k1"), F.crc32(F.concat_ws(" ", F.col(id_col).cast("string"), text).cast("binary")).alias("k2")]


def score(docs: DataFrame, training: Column, burn: int = 2, samples: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities of the whole text).

    Learns from the rows where ``training`` holds. Tokens are words, A-Z lowered, and one end per text; null and empty texts
    are that end alone. Repeated rows count each in training and score alike. Documents meet their sums again by 95 bits of hash.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    # Text sizes alone decide on buckets and merge steps.
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = size["b"] + 16 * size["n"]
    buckets, groups = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)), -(-total // GROUP_BYTES) + docs.rdd.getNumPartitions()
    table = counts(docs.where(training).select(F.col(text_col).alias("text")), buckets, groups)
    totals = first_totals(table)
    _, totals = sweep(table, totals, burn, 1, 1)
    seats, after = sweep(table, totals, burn, samples, 2)
    shared = spark.sparkContext.broadcast(after)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, lengths, keys in _groups(batches):
            words, code, classes, deal = _coded(tokens)
            bucket_of = (deal % np.uint64(buckets)).astype(np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            key, n = np.unique((code * CLASSES + _contexts(code, classes, words)) * CLASSES + doc, return_counts=True)
            word, ctx, doc = key // (CLASSES * CLASSES), key // CLASSES % CLASSES, key % CLASSES
            k1, k2 = np.array([k[0] for k in keys], dtype="<i8"), np.array([k[1] for k in keys], dtype="<u4")
            rows = []
            for b, w, m, p in _spread(words, word, bucket_of):
                used, own = np.unique(doc[p], return_inverse=True)
                rows.append((b, int(k1[0] & 0x7FFFFFFF), _pack(b"\n".join(w)), _pack(m.astype("<u4")), _pack(ctx[p].astype("<u2")),
                             _pack(own.astype("<u2")), _pack(n[p].astype("<u4")), _pack(k1[used]), _pack(k2[used])))
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["bucket", "mark", "words", "n", "ctx", "doc", "cnt", "k1", "k2"])

    asked = docs.select(F.col(text_col).alias("text"), *_keys(id_col, text_col)).mapInArrow(
        ask, "bucket int, mark long, words binary, n binary, ctx binary, doc binary, cnt binary, k1 binary, k2 binary")
    # One row per bucket: the number of tasks that score it.
    per_bucket = {r["bucket"]: math.ceil(r["tokens"] / TASK_TOKENS) for r in seats.where(F.col("tokens") > TASK_TOKENS).select("bucket", "tokens").collect()}
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in per_bucket.items() for x in kv])[F.col("bucket")], F.lit(1)) if per_bucket else F.lit(1)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("mark"), parts).cast("int")).drop("mark")
    known = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(
        seats.select(F.col("bucket").alias("of"), *[F.col(c).alias("m_" + c) for c in ("words", "n", "ctx", "cnt", "mean", "root")]),
        F.col("bucket") == F.col("of"), "left").drop("of").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    out = "k1 long, k2 long, tokens long, ends long, known long, base double, score double"

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        t = shared.value
        lookup: dict[bytes, int] = {}
        total, c1 = np.zeros(1), np.zeros(1)
        pair, pair_value = np.full(1, -1, dtype=np.int64), np.zeros(1)
        root = [t.root(np.zeros(1), np.zeros(1), m) for m in range(len(t.tables))]
        model = right.to_pylist()[0] if right.num_rows else {"m_words": None}
        if model["m_words"] is not None:
            words, n = _unpack(model["m_words"]).split(b"\n"), _unpack(model["m_n"], "<u4").astype(np.int64)
            lookup = {w: i for i, w in enumerate(words)}
            cnt, ctx = _unpack(model["m_cnt"], "<i8"), _unpack(model["m_ctx"], "<u2").astype(np.int64)
            pair = np.repeat(np.arange(len(n)), n) * CLASSES + ctx
            pair_value = np.maximum(cnt - t.discount * _unpack(model["m_mean"], "<f4"), 0.0)
            # The last place of each is that of unknown words.
            total = np.append(np.add.reduceat(cnt, np.concatenate(([0], np.cumsum(n)[:-1]))).astype(float), 0.0)
            c1 = _unpack(model["m_root"], "<f4").reshape(len(t.tables), 2, len(n)).astype(float)
            root = [np.append(t.root(c1[m, 0], c1[m, 1], m), root[m]) for m in range(len(t.tables))]
        base = np.log10((total + 1) / (t.tokens + t.words + 1))
        got = []
        for row in left.to_batches(max_chunksize=1):
            r = row.to_pylist()[0]
            m = _unpack(r["n"], "<u4").astype(np.int64)
            own = _unpack(r["words"]).split(b"\n")
            word = np.repeat(np.array([lookup.get(w, -1) for w in own], dtype=np.int64), m)
            end = np.repeat(np.array([w == b"" for w in own]), m)
            ctx, doc, cnt = _unpack(r["ctx"], "<u2").astype(np.int64), _unpack(r["doc"], "<u2").astype(np.int64), _unpack(r["cnt"], "<u4").astype(float)
            key = np.where(word >= 0, word * CLASSES + ctx, -2)
            at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            value = np.where(pair[at] == key, pair_value[at], 0.0)
            new = np.mean([(CONCENTRATION + t.discount * t.tables[s][ctx]) * root[s][word] for s in range(len(t.tables))], axis=0)
            p = (value + new) / (CONCENTRATION + t.customers[ctx])
            k1, k2 = _unpack(r["k1"], "<i8"), _unpack(r["k2"], "<u4")
            sums = [np.bincount(doc, weights=w, minlength=len(k1)) for w in (cnt, cnt * end, cnt * (total[word] > 0), cnt * base[word], cnt * np.log10(p))]
            got.append([k1, k2.astype(np.int64), *[s.astype(np.int64) for s in sums[:3]], *sums[3:]])
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)] * 2
        return pa.table(dict(zip(("k1", "k2", "tokens", "ends", "known", "base", "score"), cols)))

    sums = asked.groupBy("bucket", "part").cogroup(known.groupBy("bucket", "part")).applyInArrow(answer, out)
    per_doc = sums.groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in ("tokens", "ends", "known", "base", "score")])
    rows = docs.select(F.col(id_col), *[k.alias("of_" + x) for k, x in zip(_keys(id_col, text_col), ("k1", "k2"))])
    each = lambda c: (F.col(c) / F.col("ends")).cast("long")  # noqa: E731  equal rows were summed together
    return rows.join(per_doc, (F.col("k1") == F.col("of_k1")) & (F.col("k2") == F.col("of_k2"))).select(
        F.col(id_col), each("tokens").alias("n_tokens"), each("known").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"), (F.col("score") / F.col("ends")).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(F.col(id_col), 7) == 2

"""Removal of benchmark passages: a hash set of benchmark word windows against every word window of the corpus.

DataFrame functions only. A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is
one window as a whole. Words are runs of ASCII letters and digits and of all characters above U+007F, with A-Z lowered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.llm.common import ascii_lower, fresh, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A hash set of so many windows (16 bytes each in memory, with its table about 100 MB) is broadcast, a larger one joined by shuffle.
BROADCAST_WINDOWS = 2_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_hashes(w: Column, length: int) -> Column:
    """Hash of the window that begins at each word; none where fewer than ``length`` words are left."""
    starts = F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(length))))


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, len, hash, window text); items without words or with null text have none."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    parts = F.transform(starts, lambda i: F.slice(F.col("w"), i, F.col("len")))
    return (w.select("item", "len", F.explode(parts).alias("part"))
            .select("item", "len", F.xxhash64("part").alias("hash"), F.array_join("part", " ").alias("window")).distinct())


def _key(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_size")]


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"id": "of_id", "text_hash": "of_hash", "text_size": "of_size"})


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")) & (F.col("text_size") == F.col("of_size"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct document: id, text_hash, text_size, copies, n_words, spans (of hit words: pos from 0, len), items.

    Every window of every text is hashed and probed in the set; hits are then verified word for word against the benchmark.
    Rows of equal id and text are one row with their number in ``copies``. Null and empty texts have no words. ``items`` are
    the verified items' ids as text, sorted. A document's hits are kept in one row, as its text is.
    """
    bench = benchmark_windows(benchmark, n)
    lengths = sorted(r["len"] for r in bench.select("len").distinct().collect())  # n values at most
    known = bench.select("hash", F.lit(True).alias("hit")).groupBy("hash").agg(F.first("hit").alias("hit"))
    small = bench.count() <= BROADCAST_WINDOWS
    hinted = F.broadcast if small else lambda x: x

    base = docs.select(*_key(id_col, text_col), words(F.col(text_col)).alias("w"))
    none = F.struct(F.lit(0).alias("len"), F.array(F.lit(0).cast("long")).alias("h"))
    # One more row per document (len 0) carries its word count whether or not anything is hit.
    sets = F.array(none, *[F.struct(F.lit(k).alias("len"), window_hashes(F.col("w"), k).alias("h")) for k in lengths])
    windows = (base.select("id", "text_hash", "text_size", F.size("w").alias("n_words"), F.explode(sets).alias("s"))
               .select("id", "text_hash", "text_size", "n_words", F.col("s.len").alias("len"), F.posexplode("s.h").alias("pos", "hash")))
    found = windows.join(hinted(known), "hash", "left").where(F.col("hit") | (F.col("len") == 0))
    hit = F.when(F.col("len") > 0, F.struct("pos", "len"))
    # Used twice, and far smaller than the windows it comes from.
    grouped = written(found.groupBy("id", "text_hash", "text_size").agg(
        F.max("n_words").alias("n_words"), F.sum((F.col("len") == 0).cast("long")).alias("copies"), F.collect_set(hit).alias("hits")))

    wanted = _renamed(grouped.where(F.size("hits") > 0).select("id", "text_hash", "text_size", "hits"))
    texts = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text"))
    read = texts.join(wanted, _same()).select("id", "text_hash", "text_size", "hits", "text")
    parts = F.transform("hits", lambda h: F.struct(
        h["pos"].alias("pos"), h["len"].alias("len"), F.array_join(F.slice(F.col("w"), h["pos"] + 1, h["len"]), " ").alias("window")))
    seen = (read.withColumn("w", words(F.col("text"))).select("id", "text_hash", "text_size", F.explode(parts).alias("p"))
            .select("id", "text_hash", "text_size", "p.*"))
    items = bench.groupBy("len", "window").agg(F.collect_set("item").alias("items_of"))
    true = (seen.join(hinted(items), ["len", "window"]).groupBy("id", "text_hash", "text_size")
            .agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items_of")))).alias("items")))
    empty = F.array().cast("array<struct<pos:int,len:int>>")
    return grouped.join(_renamed(true), _same(), "left").select(
        "id", "text_hash", "text_size", "copies", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside the union of spans sorted by position."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, n)
    each = found.select(
        F.col("id").alias("doc_id"), "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns, null texts and repeated rows stay."""
    bad = contamination(docs, benchmark, n, id_col, text_col).where(F.size("spans") > 0)
    return docs.join(bad, _own_key(docs, bad, id_col, text_col), "left_anti")


def _own_key(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> Column:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(text) == bad["text_hash"]) & (F.octet_length(text) == bad["text_size"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every hit word, and the separator before it, cut out of the text; other texts are unchanged."""
    bad = contamination(docs, benchmark, n, id_col, text_col).where(F.size("spans") > 0).select("id", "text_hash", "text_size", F.col("spans").alias(
        spans := fresh(docs, "spans")))
    joined = docs.join(bad, _own_key(docs, bad, id_col, text_col), "left")
    w, seps = F.regexp_extract_all(F.col(text_col), F.lit(CASED_WORD), F.lit(0)), F.split(F.col(text_col), CASED_WORD)
    kept = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(
        ~F.exists(F.col(spans), lambda s: (i >= s["pos"]) & (i < s["pos"] + s["len"])), F.concat(F.get(seps, i), F.get(w, i))).otherwise(F.lit("")))
    cut = F.concat(F.array_join(kept, ""), F.get(seps, F.size(w)))
    return joined.select(*[F.when(F.col(spans).isNull(), docs[c]).otherwise(cut).alias(c) if c == text_col else docs[c] for c in docs.columns])

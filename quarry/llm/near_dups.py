"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one class.
2. MinHash samples of the classes are folded two ways: into band keys, which bring candidates
   together, and into an odd sketch, a bitmap of the samples' parities. The share of bits in which
   two sketches differ estimates a high similarity closely; candidates whose estimate lies five
   standard deviations below the threshold are let go.
3. The others are confirmed on their full sets, and confirmed links joined to components.

A bucket of n classes isn't made n * n pairs. All are first compared with its smallest id, its
head. If the bucket then still has classes of several components it is a crowd: those outside
the largest component are compared with all others, in blocks whose rows and shingles are
bounded. Buckets around one component mostly hold the same classes, once for each band, so they
are taken together as one crowd, each class in it once, unless they overlap so little that this
would take more comparisons. A pair of blocks first compares sketches; only classes with a
partner there bring their texts, each once, and the intersections of all their sets are products
of matrices. Of the links found only those that join components are kept. Each pair of a bucket
is thus compared, or known to be joined.

A pair of similarity 0.8 misses all of 40 bands of 5 rows with probability 1.2e-7.

Cases: null and word-free texts have an empty set and are linked with nothing; a text with fewer
words than a shingle is one shingle; rows that share an id are one node, so their texts' links
are that id's; a row with a null id is linked with nothing, has a null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column_or_null, cut_lineage, map_columns, map_groups, scratch, table
from quarry.llm.components import components

WORDS, PERCENT = 5, 80
BANDS, ROWS = 40, 5
SKETCH_BITS = 256
#: Standard deviations of the estimate, from sampling and folding, that a candidate may lie below the threshold.
SIGMAS = 5
#: Classes, and shingles of theirs, in a block of a crowd.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Classes compared with one copy of a head's text.
HEAD_SHARE = 64
#: So many ids or crowds at most are broadcast; more are joined by a shuffle.
MOST_BROADCAST_IDS = 500_000
MEMO = 200_000
_M = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240101))
_A = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_X = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and \x20 \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    ids = np.empty(len(found), np.uint64)
    get = _words.get
    for i, w in enumerate(found):
        h = get(w)
        if h is None:
            h = _words[w] = xxh3_64_intdigest(w)
        ids[i] = h
    n = len(ids) - words + 1
    roll = ids[:n].copy()
    for k in range(1, words):
        roll = roll * _P + ids[k : k + n]
    return np.unique(_mix(roll))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(x), 2048):  # bounded memory for long texts
        got = ((x[at : at + 2048][None, :] ^ _X[:, None]) * _A[:, None]).min(axis=1)
        out = got if out is None else np.minimum(out, got)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    m = samples.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _Q
    for k in range(ROWS):
        h = _mix(h * _P + m[:, k])
    return h.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of the numbers of samples that fall on each bit, as longs."""
    at = _mix(samples.astype(np.uint64) * _P + np.arange(1, len(samples) + 1, dtype=np.uint64) * _Q) >> np.uint64(56)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS)[:SKETCH_BITS] & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_bits(percent: int = PERCENT) -> int:
    """Differing sketch bits above which a pair is surely below the threshold."""
    k, n, j = BANDS * ROWS, SKETCH_BITS, percent / 100
    sampling = (j * (1 - j) / k) ** 0.5
    folding = (n * (1 - np.exp(-4 * k * (1 - j) / n)) / 4) ** 0.5 / (2 * k * np.exp(-2 * 2 * k * (1 - j) / n))
    low = max(0.0, j - SIGMAS * (sampling**2 + folding**2) ** 0.5)
    return int(np.ceil(n / 2 * (1 - np.exp(-4 * k * (1 - low) / n))))


def similarity(sketch_a: np.ndarray, sketch_b: np.ndarray) -> float:
    """The similarity that two sketches estimate."""
    differ = int(np.bitwise_count((sketch_a ^ sketch_b).view(np.uint64)).sum())
    n, k = SKETCH_BITS, BANDS * ROWS
    return 1 + n / (4 * k) * np.log(max(1e-9, 1 - 2 * differ / n))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Each row's id, size of its set, digest of the set, band keys and sketch."""
    rows = docs.select(column_or_null(docs, id_col, "long"), column_or_null(docs, text_col, "string"))

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        for ids, texts in batches:
            out = []
            for i, t in zip(ids, texts, strict=True):
                s = shingles(t, words)
                if len(s) and i is not None:
                    m = min_hashes(s)
                    out.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(m), odd_sketch(m)))
                else:
                    out.append((i, len(s), None, None, None))
                if len(out) >= 2000:
                    yield out
                    out = []
            yield out

    return map_columns(rows, "id long, n long, digest binary, bands array<long>, sketch array<long>", run)


def _few_bits(a: str, b: str, most: int) -> F.Column:
    total = None
    for i in range(SKETCH_BITS // 64):
        c = F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
        total = c if total is None else total + c
    return total <= most


def _alike_sizes(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _few(df: DataFrame) -> bool:
    """Whether a computed table of a few numbers a row is small enough to be broadcast."""
    return df.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS


def _texts(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows whose id is in ids (distinct, computed)."""
    texts = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    return texts.join(F.broadcast(ids) if _few(ids) else ids, "id", "left_semi")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets. A head a's text goes along once for
    each HEAD_SHARE of its pairs, so neither is it repeated for each nor are all in one task."""
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = _texts(docs, id_col, text_col, ids)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAD_SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
    heads = dealt.select("a", "share").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    rows = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "share", "b", "text")
    rows = heads.union(rows).repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        at, sets = None, []
        for a, share, b, texts in batches:
            out = []
            for i, k, j, t in zip(a, share, b, texts, strict=True):
                if (i, k) != at:
                    at, sets = (i, k), []
                s = shingles(t, words)
                if j is None:  # rows that share the head's id have a text each
                    sets.append(s)
                elif any(linked(x, s, percent) for x in sets):
                    out.append((i, j))
            yield out

    return map_columns(rows, "a long, b long", run).distinct()


def near_pairs(n: np.ndarray, sketch: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Which rows (n, sketch) and (m, other) are near by size and sketch."""
    out = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    bits = np.zeros(out.shape, np.uint16)
    for k in range(sketch.shape[1]):
        bits += np.bitwise_count(sketch[:, k, None] ^ other[None, :, k])
    return out & (bits <= most)


def intersections(a: list[np.ndarray], b: list[np.ndarray], at_once: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of each set of a with each set of b (of distinct hashes).

    Hashes that many sets have are columns of matrices, some at a time, whose product counts them;
    pairs that share a rarer hash are counted one by one, at_once at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not out.size:
        return out
    hashes_a, hashes_b = np.concatenate(a), np.concatenate(b)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    common = np.intersect1d(hashes_a, hashes_b)
    if not len(common):
        return out

    def of_common(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        keep = common[i] == hashes
        i, rows = i[keep], rows[keep]
        order = np.argsort(i, kind="stable")
        return i[order], rows[order], np.bincount(i, minlength=len(common))

    col_a, rows_a, df_a = of_common(hashes_a, rows_a)
    col_b, rows_b, df_b = of_common(hashes_b, rows_b)
    ends_a, ends_b = np.concatenate([[0], np.cumsum(df_a)]), np.concatenate([[0], np.cumsum(df_b)])
    often = df_a.astype(np.int64) * df_b * 64 > out.size
    # rare hashes: each entry of a with all entries of b that have the hash
    few = np.flatnonzero(~often[col_a])
    if len(few):
        sizes = df_b[col_a[few]]
        cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + at_once, at_once)))
        flat = np.zeros(out.size, np.int64)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part, size = few[low:high], sizes[low:high]
            first = np.repeat(ends_b[col_a[part]] - np.cumsum(size) + size, size)
            flat += np.bincount(np.repeat(rows_a[part], size) * len(b) + rows_b[first + np.arange(len(first))], minlength=out.size)
        out += flat.reshape(out.shape).astype(np.float32)
    cols = np.flatnonzero(often)
    width = max(64, at_once // max(len(a), len(b)))
    for at in range(0, len(cols), width):
        part = cols[at : at + width]
        place = np.full(len(common), -1, np.int64)
        place[part] = np.arange(len(part))

        def dense(col: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
            keep = place[col] >= 0
            x = np.zeros((n, len(part)), np.float32)
            x[rows[keep], place[col[keep]]] = 1
            return x

        out += dense(col_a, rows_a, len(a)) @ dense(col_b, rows_b, len(b)).T
    return out


def _sides(i: int, j: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks of a pair; the same ones if it is a block with itself."""
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _crowds(members: DataFrame, heads: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """(crowd, of_top, id, label, top): the classes to compare across labels in each crowd, a crowd
    being a bucket with several labels, or the buckets whose largest label is top."""
    rows = members.join(heads.where("n > 2").select("key", "head"), "key").where("id <> head")
    rows = cut_lineage(rows.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")))
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    tops = cut_lineage(
        by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("labels")).where("labels > 1")
        .select("key", F.col("top.label").alias("top"), "total", (F.col("total") - F.col("top.n")).alias("others"))
    )
    if tops.isEmpty():
        return None
    # comparisons bucket by bucket, and if all buckets of a top are one crowd
    apart = tops.groupBy("top").agg(F.sum(F.col("total") * F.col("others")).alias("apart"), F.count("*").alias("buckets"))
    rows = rows.join(tops.select("key", "top"), "key")
    of_top = cut_lineage(rows.select("top", "id", "label").distinct())
    together = of_top.groupBy("top").agg(F.count("*").alias("all"), F.count_if(F.col("label") != F.col("top")).alias("others"))
    together = cut_lineage(together.join(apart, "top").where("all * others <= apart").select("top"))
    whole = of_top.join(together, "top", "left_semi").select(F.col("top").alias("crowd"), F.lit(True).alias("of_top"), "id", "label", "top")
    single = rows.join(together, "top", "left_anti").select(F.col("key").alias("crowd"), F.lit(False).alias("of_top"), "id", "label", "top")
    return cut_lineage(whole.union(single).join(sizes, "id"))


def _rest_of_buckets(crowds: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) inside crowds between labels that the comparison with heads left apart."""
    is_top = F.col("label") == F.col("top")
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    stats = crowds.groupBy("crowd", "of_top").agg(blocks(is_top).alias("tops"), blocks(~is_top).alias("others"))
    stats = cut_lineage(stats)
    rows = crowds.join(F.broadcast(stats) if _few(stats) else stats, ["crowd", "of_top"])
    # blocks of the top label have numbers below 0
    rows = rows.withColumn("block", F.when(is_top, -1 - F.pmod(F.xxhash64("id"), "tops")).otherwise(F.pmod(F.xxhash64("id"), "others")).cast("int"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    with_tops = F.transform(numbers(F.col("tops")), lambda i: F.struct((-1 - i).alias("i"), F.col("block").alias("j")))
    with_others = F.transform(numbers(F.col("others")), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    of_top = F.transform(numbers(F.col("others")), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    rows = rows.withColumn("at", F.explode(F.when(is_top, of_top).otherwise(F.concat(with_tops, with_others))))
    keys = ["crowd", "of_top", "i", "j"]
    rows = rows.select("crowd", "of_top", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "id", "label", "block", "n", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH_BITS // 64)])
    most = most_bits(percent)

    def near(crowd, of_top, i, j, ids, label, block, n, *sketch) -> list[tuple]:
        """The members of a pair of blocks that have a partner of another label whose sketch is near."""
        label, n, block = np.array(label), np.array(n), np.array(block)
        if (label == label[0]).all():
            return []
        sketch = np.array(sketch, np.int64).T.view(np.uint64)
        a, b = _sides(i[0], j[0], block)
        keep = np.zeros(len(ids), bool)
        for at in range(0, len(a), 256):
            x = a[at : at + 256]
            found = near_pairs(n[x], sketch[x], n[b], sketch[b], percent, most) & (label[x][:, None] != label[b][None, :])
            keep[x] |= found.any(axis=1)
            keep[b] |= found.any(axis=0)
        return [(crowd[0], of_top[0], i[0], j[0], ids[k], int(label[k]), int(block[k])) for k in np.flatnonzero(keep).tolist()]

    kind = "crowd long, of_top boolean, i int, j int, id long, label long, block int"
    left = cut_lineage(map_groups(rows, keys, kind, near))
    if left.isEmpty():
        return None
    texts = _texts(docs, id_col, text_col, cut_lineage(left.select("id").distinct()))

    def join_labels(crowd, of_top, i, j, ids, label, block, text) -> list[tuple]:
        """Compares the sets of a pair of blocks' members; one link for each two labels it joins."""
        root = {x: x for x in label}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        label = np.array(label)
        a, b = _sides(i[0], j[0], np.array(block))
        sets = [shingles(t, words) for t in text]
        n = np.array([len(s) for s in sets])
        both = intersections([sets[k] for k in a], [sets[k] for k in b]).astype(np.int64)
        found = (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (label[a][:, None] != label[b][None, :])
        x, y = np.nonzero(found)
        x, y = a[x], b[y]
        _, first = np.unique(np.stack([label[x], label[y]], axis=1), axis=0, return_index=True)
        out = []
        for k in np.sort(first).tolist():
            u, v = find(int(label[x[k]])), find(int(label[y[k]]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((ids[x[k]], ids[y[k]]))
        return out

    return cut_lineage(map_groups(left.join(texts, "id").select(*keys, "id", "label", "block", "text"), keys, "a long, b long", join_labels))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    spark = docs.sparkSession
    path = scratch(spark, "signatures")
    signatures(docs, id_col, text_col, words).write.parquet(path)
    all_rows = spark.read.parquet(path)
    sets = all_rows.where("digest IS NOT NULL")
    classes = cut_lineage(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    firsts = classes.select(F.col("rep").alias("id"), F.col("digest"))
    reps_path = scratch(spark, "classes")
    sets.join(firsts, ["id", "digest"], "left_semi").select("id", "n", "bands", "sketch").write.parquet(reps_path)
    reps = spark.read.parquet(reps_path)
    sizes = reps.select("id", "n", "sketch")
    members = reps.select(F.explode("bands").alias("key"), "id")
    heads = cut_lineage(members.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"))
    pairs = members.join(heads.select("key", "head"), "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
    pairs = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    pairs = cut_lineage(pairs.where(_alike_sizes("n_a", "n_b", percent) & _few_bits("sketch_a", "sketch_b", most_bits(percent))).select("a", "b"))
    links = cut_lineage(_confirm(pairs, docs, id_col, text_col, words, percent))
    labels = components(links)
    crowds = _crowds(members, heads, labels, sizes)
    more = None if crowds is None else _rest_of_buckets(crowds, docs, id_col, text_col, words, percent)
    found = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "rep", "copies", F.coalesce("component", "rep").alias("label"))
    if more is not None and not more.isEmpty():
        # the links join labels: components of these, which are few
        label_of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_label"))
        between = more.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
        joined = components(between.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
        found = found.join(joined.withColumnsRenamed({"id": "label", "component": "joined"}), "label", "left")
        found = found.select("digest", "rep", "copies", F.coalesce("joined", "label").alias("label"))
    found = cut_lineage(found.where("copies > 1 OR label <> rep").select("digest", F.col("label").alias("component")))
    return (
        all_rows.select("id", "n", "digest")
        .join(found, "digest", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which each group has one, the one with the smallest id, with all
    columns. Of rows that share an id, all stay or none."""
    gone = cut_lineage(near_duplicates(docs, id_col, text_col, words, percent).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(F.broadcast(gone) if _few(gone) else gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

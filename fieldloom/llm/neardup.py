"""Near-duplicate records with small edits, without pairwise comparison.

A text's set of character shingles gets a fingerprint of min-hash symbols, split into blocks. Two
fingerprints that differ in fewer symbols than there are blocks share a block for certain (pigeonhole);
at a similarity of 0.6 they do with a probability of 0.9997, and more above. Texts are joined on equal
blocks, candidates are verified by the Hamming distance of their bit fingerprints, and those that pass by
their exact similarity. Exact copies are one text throughout and come back only through membership.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import materialize, table

#: symbols in a block, blocks in a fingerprint
BLOCK, BLOCKS = 5, 100
#: characters in a shingle, least length of a key, least similarity
SHINGLE, LEAST, SIMILAR = 3, 60, 0.6
#: Bits of the fingerprint differ with probability (1 - J) / 2: at J = 0.6, 51 of 256 with a deviation of 6.4. Unrelated texts differ in 122.
BITS, FARTHEST = 256, 96

_rng = np.random.RandomState(20240607)
_MUL = (_rng.randint(1, 2**31, BLOCK * BLOCKS).astype(np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.randint(0, 2**32, BLOCK * BLOCKS, dtype=np.uint64).astype(np.uint32)
_MIX = (_rng.randint(1, 2**62, (BLOCK, BLOCKS)).astype(np.uint64) * np.uint64(2)) + np.uint64(1)


def key(*cols: Column) -> Column:
    """Lower-cased letters and digits of the joined columns; null where a column is null or fewer than LEAST characters are left."""
    k = F.regexp_replace(F.lower(F.concat(*cols)), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(k) >= LEAST, k)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct codes of all SHINGLE-character substrings."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def _hash(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, symbols: int = BLOCK * BLOCKS) -> np.ndarray:
    """The least hash under each of the first permutations."""
    h = _hash(shingles(text))
    best = np.full(symbols, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 256):  # long texts in slices that stay in the cache
            np.minimum(best, (h[at : at + 256, None] * _MUL[:symbols] + _ADD[:symbols]).min(axis=0), out=best)
    return best


def _blocks(fp: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (fp.reshape(BLOCKS, BLOCK).T.astype(np.uint64) * _MIX).sum(axis=0)
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _bits(fp: np.ndarray) -> np.ndarray:
    """One bit of each symbol, as 64-bit words."""
    with np.errstate(over="ignore"):
        return np.packbits((fp * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def with_bits(texts: DataFrame) -> DataFrame:
    """(rep, key, b0, b1, ...): texts with the words of their bit fingerprint."""
    words = [f"b{i}" for i in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([_bits(fingerprint(t, BITS)) for t in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(words))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(words)))], names=["rep", "key", *words])

    return texts.select("rep", "key").mapInArrow(run, "rep bigint, key string, " + ", ".join(f"{w} bigint" for w in words))


def block_rows(texts: DataFrame) -> DataFrame:
    """(rep, block): BLOCKS rows of 16 bytes for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = b.column(0).to_numpy()
                out = [_blocks(fingerprint(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BLOCKS)), pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], names=["rep", "block"])

    return texts.select("rep", "key").mapInArrow(run, "rep bigint, block bigint")


def near(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs within FARTHEST bits of each other; JVM only, and without their texts."""
    words = [f"b{i}" for i in range(BITS // 64)]
    side = lambda x: texts.select(F.col("rep").alias(f"rep_{x}"), *(F.col(w).alias(f"{w}_{x}") for w in words))
    pairs = candidates.join(side("a"), "rep_a").join(side("b"), "rep_b")
    distance = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words[1:]), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
    return pairs.where(distance <= FARTHEST).select("rep_a", "rep_b")


def verified(pairs: DataFrame) -> DataFrame:
    """(rep_a, rep_b, similarity) of the pairs whose shingle sets are similar enough, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, np.ndarray] = {}

            def of(t: str, seen: dict = seen) -> np.ndarray:
                if t not in seen:
                    seen[t] = shingles(t)
                return seen[t]

            out = []
            for a, c, s, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                sa, sb = of(s), of(t)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                j = both / (len(sa) + len(sb) - both)
                if j >= SIMILAR:
                    out.append((a, c, j))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["rep_a", "rep_b", "similarity"])

    return pairs.select("rep_a", "rep_b", "key_a", "key_b").mapInArrow(run, "rep_a bigint, rep_b bigint, similarity double")


#: rows of blocks in a partition
ROWS = 4_000_000


@contextmanager
def enough_partitions(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what is written inside, at least as many shuffle partitions as keep each to ROWS rows; never fewer than the session has."""
    key = "spark.sql.shuffle.partitions"
    own = spark.conf.get(key)
    spark.conf.set(key, str(max(int(own), -(-rows // ROWS))))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def links(rows: DataFrame, row_id: str, *cols: Column) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has (rep, row_id) of every row with a key, rep being the least id with that key;
    pairs has (rep_a, rep_b, similarity) of all similar distinct texts.

    Rows with a null column or a short key are in neither. A block that many texts share is joined in
    pieces by adaptive skew handling; no cap is set on partners.
    """
    keyed = rows.select(F.col(row_id).cast("bigint").alias("row_id"), key(*cols).alias("key")).where("key is not null")
    # 128 bits and the length stand for the key where rows find their text again
    texts = materialize(with_bits(keyed.groupBy("key").agg(F.min("row_id").alias("rep"))))
    hashed = lambda c: (F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("again"), c).alias("h2"), F.length(c).alias("h3"))
    members = keyed.select("row_id", *hashed("key")).join(texts.select("rep", *hashed("key")), ["h1", "h2", "h3"]).select("rep", "row_id")
    blocks = block_rows(texts)
    shared = blocks.select("block", F.col("rep").alias("rep_a")).join(blocks.select("block", F.col("rep").alias("rep_b")), "block").where("rep_a < rep_b")
    candidates = shared.select("rep_a", "rep_b").distinct()
    side = lambda x: texts.select(F.col("rep").alias(f"rep_{x}"), F.col("key").alias(f"key_{x}"))
    with enough_partitions(rows.sparkSession, texts.count() * BLOCKS):  # a count of written rows
        return members, materialize(verified(near(candidates, texts).join(side("a"), "rep_a").join(side("b"), "rep_b")))


def components(pairs: DataFrame, a: str = "rep_a", b: str = "rep_b") -> DataFrame:
    """(rep, label): connected texts share the least id. Labels spread along the links and jump to their label's label, each round written to the shared folder."""
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y")))
    edges = materialize(both.distinct())
    labels = edges.groupBy(F.col("x").alias("rep")).agg(F.least(F.first("x"), F.min("y")).alias("label"))
    while True:
        labels = materialize(labels)
        near = edges.join(labels, edges.y == labels.rep).groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.rep == near.x, "left").select("rep", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("l1"))
        jump = labels.select(F.col("rep").alias("l1"), F.col("label").alias("l2"))
        new = materialize(spread.join(jump, "l1", "left").select("rep", "old", F.least("l1", F.coalesce("l2", "l1")).alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("rep", "label")
        labels = new.select("rep", "label")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return links(table(spark, sf_dir, "work_orders"), "record_id", F.col("reported_issue"), F.col("solution"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of similar rows, as the case definition asks: links between texts, spread over their copies."""
    members, pairs = _orders(spark, sf_dir)
    at = lambda x: members.select(F.col("rep").alias(f"rep_{x}"), F.col("row_id").alias(f"id_{x}"))
    across = pairs.join(at("a"), "rep_a").join(at("b"), "rep_b").select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b"))
    copies = at("a").join(at("b"), F.col("rep_a") == F.col("rep_b")).where("id_a < id_b").select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))
    return across.unionByName(copies)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, group_id, links): the group of each row that has a key, and to how many other texts it is linked."""
    members, pairs = _orders(spark, sf_dir)
    degree = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    info = components(pairs).join(degree, "rep")
    return members.join(info, "rep", "left").select(F.col("row_id").alias("record_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

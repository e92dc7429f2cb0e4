import random

from pyspark.sql import functions as F

from fieldloom.llm import neardup as N

SCHEMA = "id long, a string, b string, rep string"


def brute(rows):
    keys = {}
    for i, a, b, _ in rows:
        if a is not None and b is not None:
            k = "".join(c for c in (a + b).lower() if c.isalnum())
            if len(k) >= 60:
                keys.setdefault(i, frozenset(k[j : j + 3] for j in range(len(k) - 2)))
    ids = sorted(keys)
    return {(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if 10 * len(keys[x] & keys[y]) >= 6 * len(keys[x] | keys[y])}


def sample(n=120):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("泵阀管油缸压力漏abcdefghijk0123456789") for _ in range(150))
    rows = []
    for i in range(0, n, 4):
        base = word()
        rows.append((i, base[:20], base[20:], "x"))
        for j in (1, 2, 3):
            t = list(base)
            for _ in range(rnd.randint(0, 12)):
                t[rnd.randrange(len(t))] = rnd.choice("新旧左右")
            rows.append((i + j, "".join(t[:20]).upper(), " ".join(t[20:]), None))
    return rows


def pairs(members, links):
    at = lambda x: members.select(F.col("rep").alias(f"rep_{x}"), F.col("row_id").alias(f"id_{x}"))
    across = links.join(at("a"), "rep_a").join(at("b"), "rep_b").select("id_a", "id_b").collect()
    same = at("a").join(at("b"), F.col("rep_a") == F.col("rep_b")).where("id_a < id_b").select("id_a", "id_b").collect()
    return {tuple(sorted(r)) for r in across + same}


def test_all_similar_pairs_and_no_others(spark):
    rows = sample()
    rows += [(1000, None, "x" * 99, ""), (1001, "x" * 99, None, ""), (1002, "", "short", ""), (1003, *rows[0][1:]), (1004, *rows[0][1:]), (1005, "长" * 30_000, "文本" * 30_000, "")]
    members, links = N.links(spark.createDataFrame(rows, SCHEMA), "id", F.col("a"), F.col("b"))
    got = pairs(members, links)
    assert got == brute(rows) and (0, 1003) in got and (1003, 1004) in got


def test_recall_near_the_threshold():
    rnd = random.Random(3)
    hit = 0
    for _ in range(150):
        base = [chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(200)]
        other = base[:]
        for p in rnd.sample(range(0, 200, 4), 16):
            other[p] = chr(rnd.randrange(0x4E00, 0x9000))
        a, b = N.fingerprint("".join(base)), N.fingerprint("".join(other))
        near = sum(x.bit_count() for x in (int(u) & (2**64 - 1) for u in N._bits(a[: N.BITS]) ^ N._bits(b[: N.BITS]))) <= N.FARTHEST
        hit += near and bool((N._blocks(a) == N._blocks(b)).any())
    assert hit == 150


def test_components_and_empty(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 20)] + [(100, 101, 1.0)], "rep_a long, rep_b long, similarity double")
    got = {r.rep: r.label for r in N.components(e).collect()}
    assert got == {i: 1 for i in range(1, 21)} | {100: 100, 101: 100}
    members, links = N.links(spark.createDataFrame([], SCHEMA), "id", F.col("a"), F.col("b"))
    assert members.count() == links.count() == 0 and N.components(links).count() == 0


def test_partitions_follow_rows(spark):
    key = "spark.sql.shuffle.partitions"
    own = spark.conf.get(key)
    with N.enough_partitions(spark, 100 * N.ROWS):
        assert spark.conf.get(key) == "100"
    with N.enough_partitions(spark, 0):
        assert spark.conf.get(key) == own
    assert spark.conf.get(key) == own

import random
from collections import Counter
from math import comb, exp, log

import pytest

from fieldloom.llm import enrichment, mixing


def test_tail_is_exact():
    rnd = random.Random(1)
    for _ in range(800):
        big_n = rnd.randint(1, 200)
        big_k, n = rnd.randint(1, big_n), rnd.randint(1, big_n)
        k = rnd.randint(0, min(n, big_k))
        p = sum(comb(big_k, i) * comb(big_n - big_k, n - i) for i in range(k, min(n, big_k) + 1) if n - i <= big_n - big_k) / comb(big_n, n)
        assert enrichment.log_upper_tail([k], [n], [big_k], [big_n])[0] == pytest.approx(log(p), rel=1e-8, abs=1e-9)
    big = enrichment.log_upper_tail([2], [100], [3], [10**12])[0]  # about C(3,2) (100/1e12)^2 99/100
    assert exp(big) == pytest.approx(3 * comb(100, 2) * 2 / 1e24, rel=1e-6)


def test_enrichment_rows(spark):
    texts = ["pump pump 泵漏油 泵漏油", "the pump", "The the a.b-c_ A.B-C", None, "", "x" * 100_000 + " 油" * 3, "the pump"]
    df = spark.createDataFrame([(f"d{i}", t, i, 1) for i, t in enumerate(texts)], "doc_id string, text string, term int, code int")
    rows = enrichment.enrichment(df, "doc_id", "text").collect()
    got = {(r.doc_id, r.term): (r.tf, r.df, r.cf) for r in rows}
    assert got["d0", "pump"] == (2, 3, 4) and got["d0", "泵漏"] == (2, 1, 2) and got["d2", "a.b-c"] == (2, 1, 2)
    assert not {r.doc_id for r in rows} & {"d3", "d4"} and len(got) == len(rows)
    assert all(r.p_value <= r.q_value * (1 + 1e-12) <= 1 + 1e-12 and r.score >= 0 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.p_value, r.q_value))
    for ps in by.values():  # Benjamini-Hochberg by hand
        ps.sort()
        best = 1.0
        for i in range(len(ps), 0, -1):
            best = min(best, ps[i - 1][0] * len(ps) / i)
            assert ps[i - 1][1] == pytest.approx(best, rel=1e-9)
    assert enrichment.enrichment(df.limit(0), "doc_id", "text").count() == 0


def test_terms_equal_their_definition(spark):
    """Counts of every term of every part against a plain count."""
    import re

    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab1._- A泵漏油鿿一，\n😀é") for _ in range(rnd.randint(0, 60))) for _ in range(900)]
    df = spark.createDataFrame([(f"d{i}", "xy"[i % 2], t) for i, t in enumerate(texts)], "doc_id string, part string, t string")
    got = {(r.doc_id, r.term): (r.part, r.tf, r.df) for r in enrichment.enrichment(df, "doc_id", "t", part="part").collect()}
    want, seen = {}, Counter()
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        c = Counter([w.rstrip("._-") for w in re.findall("[a-z0-9][a-z0-9_.-]*", low)] + re.findall("(?=([一-鿿]{2}))", low))
        want |= {(f"d{i}", w): ("xy"[i % 2], n) for w, n in c.items()}
        seen.update(("xy"[i % 2], w) for w in c)
    assert got == {k: (*v, seen[v[0], k[1]]) for k, v in want.items()}


def test_found_terms_need_no_score(spark, tmp_path, monkeypatch):
    texts = {"a": "pump pump E1-2 e1-2. 漏油漏油", "b": "pump valve valve 漏油", None: "valve valve valve x x", "d": "x seal seal", "e": "", "f": None}
    texts |= {f"g{i}": "belt belt" for i in range(5)} | {f"h{i}": "gear gear" for i in range(6)}
    spark.createDataFrame(list(texts.items()), "doc_id string, text string").write.parquet(f"{tmp_path}/index_documents.parquet")

    def unused(*args, **kwargs):
        raise AssertionError("a score that no row depends on")

    for name in ("enrichment", "_log_p", "log_upper_tail"):
        monkeypatch.setattr(enrichment, name, unused)
    found = enrichment.p7_found(spark, str(tmp_path))
    assert found.columns == ["doc_id", "term"]
    want = [("a", "pump"), ("a", "漏油"), ("b", "valve"), (None, "valve"), (None, "x")] + [(f"g{i}", "belt") for i in range(5)]
    assert Counter(map(tuple, found.collect())) == Counter(want)


def corpus(spark, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a"] * 6 + ["b"] * 3 + ["c"]), "word " * rnd.randint(1, 120) + str(i)) for i in range(3000)]
    rows += [(5000, None, "x"), (5001, "a", None), (5002, "b", ""), (5003, "zz", "other"), (5004, "b", rows[0][2]), (5005, "a", rows[0][2])]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_shares_are_met(spark):
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.25, 5), ("gone", 0.05, 3), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    counts = mixing.token_counts(corpus(spark))
    rows, shares = mixing.mixture(counts, t)
    got = {r.source: r for r in shares.collect()}
    for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.25)):
        assert got[s].actual_share == pytest.approx(share / 0.95, abs=0.003)
    assert got["gone"].actual_share == 0.0
    all_ = rows.collect()
    cap = {"a": 1, "b": 2, "c": 5}
    assert all(0 <= r.copies <= cap[r.source] and abs(r.copies - r.rate) <= 1 for r in all_)
    assert Counter(r.doc_id for r in all_).most_common(1)[0][1] == 1
    assert not {5000, 5001, 5002, 5003} & {r.doc_id for r in all_}
    assert not {5004, 5005} & {r.doc_id for r in all_}  # repeats of text 0 aren't used again
    assert rows.collect() == all_ or sorted(rows.collect()) == sorted(all_)


def test_given_total_and_shortfall(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    counts = mixing.token_counts(corpus(spark))
    have = {r.source: r[1] for r in counts.where("first").groupBy("source").sum("tokens").collect()}
    total = have["c"] * 4
    got = {r.source: r.tokens for r in mixing.mixture(counts, t, total)[1].collect()}
    assert got["c"] == have["c"] and got["a"] == pytest.approx(total / 2, abs=130)


def test_empty_mixture(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    rows, shares = mixing.mixture(mixing.token_counts(corpus(spark).limit(0)), t)
    assert rows.count() == 0 and shares.collect()[0].actual_share == 0.0

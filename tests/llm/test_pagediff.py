import random

from fieldloom.llm import pagediff as P


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def is_sub(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_alignment_is_longest():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        got = P.shared_lines(a, b)
        assert len(got) == lcs(a, b) and is_sub([a[i] for i in got], b) and got == sorted(set(got))


def test_long_pages(monkeypatch):
    a = [str(i % 5000) for i in range(30_000)]
    b = [x for i, x in enumerate(a) if i % 7]
    assert is_sub([a[i] for i in P.shared_lines(a, b)], b)
    monkeypatch.setattr(P, "FULL", 4)
    assert len(P.shared_lines(list("axbycz"), list("apbqcr"))) == 3


def test_long_pages_align_longest(monkeypatch):
    monkeypatch.setattr(P, "FULL", 4)
    rnd = random.Random(3)
    for k in range(400):
        monkeypatch.setattr(P, "PAIRS", (0, 40, 10_000)[k % 3])
        a, b = ([rnd.choice("abc" if k % 2 else "abcdefghij") for _ in range(rnd.randint(0, 30))] for _ in range(2))
        got = P.shared_lines(a, b)
        assert len(got) == lcs(a, b) and is_sub([a[i] for i in got], b) and got == sorted(set(got))


def test_lines_moved_across_the_middle_are_shared():
    a = [x for i in range(1100) for x in ("a", "b")] + ["c", "d"] * 500
    b = ["e", "f"] * 600 + a[:2200]
    got = P.shared_lines(a, b)
    assert len(got) == 2200 and is_sub([a[i] for i in got], b)


def test_pages(spark):
    rows = [("1", "h/a/x", "head\nA\nfoot"), ("2", "h/a/y", "head\nB\n\nfoot"), ("3", "h/b", "head\nC"), ("4", "g/a", "head\nD"), ("5", None, "x"), ("6", "h/c", None), ("7", "k/1", ""), ("7", "k/1", "")]
    df = spark.createDataFrame(rows, "id string, url string, text string")
    got = {(r.page_id): (r.nearest_id, r.lines, r.shared, r.own_text) for r in P.difference(df, "id", "url", "text").collect()}
    assert got["1"] == ("2", 3, 2, "A") and got["2"] == ("1", 3, 2, "B\n") and got["4"] == (None, 2, 0, "head\nD")
    assert got["3"] == ("2", 2, 1, "C") and got["7"] == ("7", 0, 0, "") and not {"5", "6"} & set(got)
    assert P.difference(df.limit(0), "id", "url", "text").count() == 0

"""Abusive, hateful or sexual content: restore disguised spellings, then score the restored text.

Noisy channel: every character of a suspicious stretch is a lattice column of what it may stand for (itself, the
letter a digit or sign imitates, a sound-alike or look-alike, nothing if it only spaces letters out or repeats
one), and Viterbi decoding picks the likeliest reading under a character bigram model. The model's counts
come from all documents; its alphabet is fixed, so its size is. The restored text is scored by a word list (words.py), and by expressions whose log-odds are
fitted on a bounded sample of review verdicts; a document counts from a score of 1 on.
"""

from __future__ import annotations

import re
import unicodedata
import weakref
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import words
from fieldloom.session import materialize, spread, table

LEXICON: dict[str, str] = {category: "|".join(entries) for category, entries in words.WORDS.items()}
#: what a digit or sign may stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "*": "aeiou", "#": "aeiou", "€": "e", "£": "l"}
#: Chinese characters written for others that sound or look alike
ALIKE = {"煞": "傻", "沙": "傻", "笔": "逼", "比": "逼", "币": "逼", "辣": "垃", "鸡": "圾", "衮": "滚", "果": "裸", "愛": "爱", "艹": "操", "草": "操", "曹": "操", "馬": "妈", "玛": "妈", "尼": "你", "费": "废", "勿": "物", "婊": "婊", "表": "婊", "玍": "蛋", "旦": "蛋", "忘": "王", "痪": "痴", "纯": "蠢", "贷": "货", "泡": "炮", "祼": "裸", "睐": "脑", "餐": "残", "約": "约", "脫": "脱"}
#: everyday words in which such a character stands for itself
ITSELF = "[效结如水成苹后糖]果|果[然断汁实]|[圆珠钢签字铅毛画]笔|笔[记者杆尖]|比[例对较重值如]|[对相占]比|[绿除割杂]草|草[地图稿坪皮]|尼龙|[免收花油运]费|费用|辣椒|[泥流细黄河风砂]沙|沙[子土石尘地漠]|[仪电油手水钟图列]表|表[面示格盘]|[气灯水油]泡|泡[沫水]|[快午晚]餐|鸡蛋|[贷借]款|忘记|单纯|纯[净水度]|货币"
SEPARATORS = " .-_*·~,、'`|/"
ZERO = dict.fromkeys(map(ord, "​‌‍⁠﻿­̶̷"))

CATEGORIES = tuple(LEXICON)
#: characters of disguise are left to the class of all others, lest the model learn the disguise
_HAN = sorted(set(re.findall("[一-鿿]", "".join(p for p in LEXICON.values()))) - set(ALIKE) | set("".join(ALIKE.values())))
_LETTERS = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"
#: the model's alphabet: anything else, blank, digit, letters, the characters of the word list; its size is fixed with the list
SYMBOLS = {"": 0, " ": 1, "0": 2} | {c: i + 3 for i, c in enumerate([*_LETTERS, *_HAN])}
SIZE = len(SYMBOLS)


@lru_cache(maxsize=1)
def _lookup() -> np.ndarray:
    out = np.zeros(0x10000, dtype=np.int64)
    for c, i in SYMBOLS.items():
        if c:
            out[ord(c)] = out[ord(c.upper())] = i
    out[[9, 10, 13]] = 1
    out[48:58] = 2
    return out


@lru_cache(maxsize=1)
def _folding() -> tuple[re.Pattern, dict[str, str]]:
    """Full-width, mathematical and circled letters by their compatibility forms; invisible characters to nothing. The pattern finds them, as few texts have many."""
    styled = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA), 0x3000]
    to = {chr(o): unicodedata.normalize("NFKC", chr(o)) for o in styled} | dict.fromkeys(map(chr, ZERO), "")
    return re.compile(f"[\uff01-\uff5e\U0001d400-\U0001d7ff\u24b6-\u24e9\u3000{''.join(map(chr, ZERO))}]"), to


def fold(text: str) -> str:
    """Lower case, full-width and stylised letters plain, invisible characters gone."""
    if not text.isascii():
        find, to = _folding()
        text = find.sub(lambda m: to[m[0]], text)
    return text.lower()


def bigrams(docs: DataFrame, text: str) -> DataFrame:
    """(pair, n): counts of adjacent symbols over all documents; at most SIZE squared rows, combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = _lookup(), np.zeros(SIZE * SIZE, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    s = look[np.where(c < 0x10000, c, 0)]
                    total += np.bincount(s[:-1] * SIZE + s[1:], minlength=SIZE * SIZE) if len(s) < 5000 else np.histogram(s[:-1] * SIZE + s[1:], bins=np.arange(SIZE * SIZE + 1))[0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return docs.select(text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def costs(counts: list[tuple[int, int]]) -> np.ndarray:
    """-log P(next | symbol) from the corpus' counts and the word list's own, which weigh as much as 1 in 20 of it."""
    m = np.full((SIZE, SIZE), 0.05)
    for pair, n in counts:
        m[divmod(pair, SIZE)] += n
    listed = [w for p in LEXICON.values() for w in re.split(r"\|", re.sub(r"\(\?[^()]*\)|[\[\]()?\\]", " ", p))]
    own = np.zeros((SIZE, SIZE))
    for w in listed:
        ids = [SYMBOLS.get(c, 0) for c in f" {w} "]
        for a, b in zip(ids, ids[1:], strict=False):
            own[a, b] += 1
        if ids[1:-1]:
            own[0, ids[1]] += 1
    m += own * max(1.0, m.sum() / 20 / max(own.sum(), 1))
    return -np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32)


#: cost of reading a character as another, of dropping a separator, a repeat, of an uncommon character, of a sign within a word and of a digit among letters as themselves, more for the less usual reading of a stroke
SWAP, DROP, REPEAT, OTHER, SIGN, SECOND, DIGIT = 1.0, 0.2, 1.0, 7.0, 6.0, 1.0, 5.0


def decode(window: str, lm: np.ndarray, before: str = " ") -> str:
    """The likeliest reading of a stretch: exact Viterbi over its lattice; a state is the last symbol put out.

    There are at most as many states as readings of a character and of the one before the separators. The model looks back one
    symbol, so a stretch that begins and ends with characters of one reading is read as it would be in the whole text. Readings are chains of what was put out, (chain before, character), so that a stretch of any length takes linear time.
    """
    states: dict[tuple[int, str], tuple[float, tuple | None]] = {(SYMBOLS.get(before, 0), ""): (0.0, None)}
    for i, c in enumerate(window):
        odd = c in "*@$!|#" and 0 < i < len(window) - 1
        options = [(c, DIGIT if c.isdigit() else SIGN if odd else OTHER if c not in SYMBOLS and not c.isdigit() and c not in SEPARATORS else 0.0)]
        run = i > 0 and window[i - 1] == c and (window[i - 2 : i - 1] == c or window[i + 1 : i + 2] == c)
        options += [(x, SWAP + (SECOND if k and c in "1|" else 0.0)) for k, x in enumerate(LEET.get(c, "") + ALIKE.get(c, ""))]
        lone = c in SEPARATORS and i > 0
        new: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        for (sym, last), (cost, out) in states.items():
            for x, extra in options:
                s = 2 if x.isdigit() else SYMBOLS.get(x, 1 if x in SEPARATORS else 0)
                total = cost + extra + float(lm[sym, s])
                if (s, x) not in new or total < new[s, x][0]:
                    new[s, x] = (total, (out, x))
            if lone or run and c == last:
                total = cost + (DROP if lone else REPEAT)
                if (sym, last) not in new or total < new[sym, last][0]:
                    new[sym, last] = (total, out)
        states = new
    least = min(cost for cost, _ in states.values())
    return min(_put_out(out) for cost, out in states.values() if cost == least)


def _put_out(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


_SEP = f"[{re.escape(SEPARATORS)}]"
#: separators that don't part clauses or entries of a list: behind these, repeated at most, more than one Chinese character may follow
_BARE = r"([ .\-_*·~])"
_HANZI = "[一-鿿]"
#: a letter, or a digit or sign for one; signs that are separators, too, are decoded as what stands between
_PIECE = rf"(?:[^\W\d_]|[{re.escape(''.join(sorted(set(LEET) - set(SEPARATORS))))}])"
_SPACED = re.compile(
    rf"(?:(?<![^\W\d_])(?=[^\W\d_])|(?<![^\W_])){_PIECE}(?:{_SEP}+{_PIECE}(?={_SEP})){{1,}}{_SEP}+(?:[^\W\d_](?![^\W\d_])|{_PIECE}(?![^\W_]))"
    rf"|(?:{_HANZI}{_SEP}+)*{_HANZI}(?:{_BARE}\1*{_HANZI}+|{_SEP}+{_HANZI}(?!{_HANZI}))|[个帮是的] ?s[ .*-]+b(?![a-z])"
)
_LEETED = re.compile(r"(?<![\w@$!*|+#])(?=[\w@$!*|+#]*[a-zа-я])(?=[\w@$!*|+#]*[0-9@$!*|+#])[\w@$!*|+#]{2,}", re.I)
_REPEAT = re.compile(rf"([a-zа-яё]|{_HANZI})\1\1")
_LETTERS_RUN, _HAN_RUN = re.compile("[a-zа-яё]+"), re.compile(f"{_HANZI}+")
_ALIKE = re.compile(f"(?:{ITSELF})|([{''.join(ALIKE)}][一-鿿]{{0,2}})")
_HIDDEN = re.compile(r"(?<=[A-Za-z])[*#](?=[A-Za-z])")
_MIXED = re.compile(r"(?<![a-zа-яё])(?=[a-zа-яё]*[a-z])(?=[a-zа-яё]*[а-яё])[a-zа-яё]{3,}")
_TO_RU = str.maketrans("abcehkmoptxy", "авсенкмортху")
_TO_LATIN = {ord(k): v for k, v in zip("авсенкмортхуі", "abcehkmoptxyi", strict=True)}


_read: dict[int, dict[str, str]] = {}


def _known(window: str, lm: np.ndarray, most: int = 50_000) -> str:
    """decode, remembering short stretches for as long as their model lives; a full memory is emptied."""
    if len(window) > 24:
        return decode(window, lm)
    if (own := _read.get(id(lm))) is None:
        own = _read[id(lm)] = {}
        weakref.finalize(lm, _read.pop, id(lm), None)
    if window not in own:
        if len(own) >= most:
            own.clear()
        own[window] = decode(window, lm)
    return own[window]


def readings(text: str, lm: np.ndarray) -> list[str]:
    """The restored text; where a stroke was read as l, the text with all strokes of words read as i, too; and where a sign hides a vowel, the text with each vowel."""
    first, strokes = _restore(text, lm, False)
    out = [first, _restore(text, lm, True)[0]] if strokes else [first]
    if _HIDDEN.search(text):
        plain = fold(text)
        out += [_restore(_HIDDEN.sub(v, plain), lm, False)[0] for v in "aeiou"]
    return out


def restore(text: str, lm: np.ndarray) -> str:
    """The folded text with every suspicious stretch decoded; letters that were spaced out come back joined."""
    return _restore(text, lm, False)[0]


def _restore(text: str, lm: np.ndarray, straight: bool) -> tuple[str, bool]:
    t, strokes = fold(text), False

    def mixed(m: re.Match) -> str:
        w = m[0]
        return w.translate(_TO_RU) if sum("а" <= c <= "ё" for c in w) * 2 >= len(w) else w.translate(_TO_LATIN)

    def spaced(m: re.Match) -> str:
        if not any(map(str.isalpha, m[0])):  # figures
            return m[0]
        bare = re.sub(_SEP, "", m[0])
        read = decode(m[0], lm)
        return bare if re.sub(_SEP, "", read) == bare else re.sub(_SEP, "", read)

    if _MIXED.search(t):
        t = _MIXED.sub(mixed, t)
    t = _SPACED.sub(spaced, t)

    def leeted(m: re.Match) -> str:
        nonlocal strokes
        w = re.sub("[1|]", "!", m[0]) if straight else m[0]
        read = _known(w, lm)  # codes of machines and parts come again and again
        strokes |= "l" in read and ("1" in w or "|" in w)
        return read

    t = _LEETED.sub(leeted, t)
    if _REPEAT.search(t):  # whole runs of letters in which one repeats
        for runs in (_LETTERS_RUN, _HAN_RUN):
            t = runs.sub(lambda m: decode(m[0], lm) if _REPEAT.search(m[0]) else m[0], t)
    return _ALIKE.sub(lambda m: decode(m[1], lm, t[m.start() - 1 : m.start()] or " ") if m[1] else m[0], t), strokes


def _alternatives(p: str) -> list[str]:
    """The alternatives of a pattern outside all brackets."""
    out, depth, cls, start, i = [], 0, False, 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 1
        elif cls:
            cls = c != "]"
        elif c == "[":
            cls = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(p[start:i])
            start = i + 1
        i += 1
    return [*out, p[start:]]


def _first(p: str) -> set[str]:
    """The characters that a match of an alternative can begin with."""
    while p.startswith("(?<!"):
        p = p[p.index(")") + 1 :]
    if p.startswith("["):
        return set(p[1 : p.index("]")])
    if p.startswith("("):
        inner = p[1 : p.index(")")].removeprefix("?:")
        return set().union(*map(_first, inner.split("|")))
    return {p[0]}


@lru_cache(maxsize=1)
def _patterns() -> list[tuple[str, re.Pattern]]:
    """Category and pattern, apart for each script and behind a look at the first character, which rules out most places."""
    loose = lambda p: p.replace(" ?", "\0").replace(" ", " ?").replace("\0", " ?")
    out = []
    for c, p in LEXICON.items():
        by: dict[str, list[str]] = {}
        for x in _alternatives(p):
            low = min(_first(x))
            by.setdefault("Chinese" if low >= "一" else "Cyrillic" if low >= "а" else "Latin", []).append(x)
        for xs in by.values():
            firsts = "".join(sorted(set().union(*map(_first, xs))))
            out.append((c, re.compile(f"(?=[{firsts}])(?:{loose('|'.join(xs))})")))
    return out


_HARMLESS = re.compile(words.HARMLESS)


def _weights(read: list[str]) -> dict[str, float]:
    out = dict.fromkeys(CATEGORIES, 0.0)
    for c, _ in {(c, m[0]) for t in read for c, p in _patterns() for m in p.finditer(_HARMLESS.sub(" ", t))}:
        out[c] += 1.0
    return out


def score(text: str | None, lm: np.ndarray) -> dict[str, float]:
    """How many different listed expressions of each category the restored text holds; all 0 for null, empty and clean texts."""
    return _weights(readings(text, lm) if text and not text.isspace() else [])


# --- what reviewers' verdicts say ----------------------------------------------------------------

#: reviewed rows that are fitted on, at most; expressions that are kept of them, at most; share of verdicts that are wrong
LABELS, EXPRESSIONS, WRONG = 20_000, 20_000, 0.05
#: log-odds (their lower 95 % bounds) that a sentence's strongest expressions must sum to, to count by themselves; how many are summed
ENOUGH, STRONGEST = 5.0, 4
_SENTENCE = re.compile(r"[。！？!?\n;；]+|\.(?=\s|\Z)")
_NOT_WORD = re.compile(r"[\W\d_]+")
_HAN_APART = re.compile(f"({_HANZI}+)")


def _plain_sentence(s: str) -> str:
    """Words between single blanks, a blank at both ends; runs of Chinese characters are words."""
    return " " + _NOT_WORD.sub(" ", _HAN_APART.sub(r" \1 ", s)).strip() + " "


def expressions(sentence: str) -> set[str]:
    """What is counted of a sentence: Chinese substrings of two to four characters, other words by themselves and in pairs, with their blanks."""
    out: set[str] = set()
    last = ""
    for w in _plain_sentence(sentence).split():
        if "一" <= w[0] <= "鿿":
            out.update(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))
            last = ""
        else:
            out.add(f" {w} ")
            if last:
                out.add(f" {last} {w} ")
            last = w
    return out


def fit(docs: DataFrame, row_id: str, text: str, labels: DataFrame, lm: np.ndarray) -> dict[str, float]:
    """Expression to log-odds of an objectionable text, from reviewed documents.

    labels: (row_id, label), any verdict but none being one against the text; a document counts by the share of its verdicts
    that are, equal texts once, and WRONG of the verdicts are taken to be mistaken. Of each expression the lower bound of its
    log-odds is kept where it is positive, so what is rare weighs little however one-sided. Without labels there are none.
    """
    sample = labels.where(F.col(row_id).isNotNull() & F.col("label").isNotNull()).select(row_id, "label").orderBy(F.xxhash64(row_id, "label")).limit(LABELS)
    share = sample.groupBy(row_id).agg((F.lit(WRONG) + (1 - 2 * WRONG) * F.avg((F.col("label") != "none").cast("double"))).alias("_p"))
    own = docs.where(F.col(text).isNotNull()).select(row_id, F.col(text).alias("_text")).join(F.broadcast(share), row_id)  # at most LABELS rows
    rows = materialize(own.groupBy("_text").agg(F.avg("_p").alias("_p")))
    total = rows.agg(F.coalesce(F.sum("_p"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("_p")), F.lit(0.0))).head()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = sorted(set().union(*(expressions(s) for s in _SENTENCE.split(restore(t, lm)))))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([p] * len(found), pa.float64())], names=["x", "p"])

    counts = spread(rows, docs.sparkSession).mapInArrow(run, "x string, p double").groupBy("x").agg((F.sum("p") + 0.5).alias("bad"), (F.sum(1 - F.col("p")) + 0.5).alias("good"))
    odds = F.ln(F.col("bad") / (total[0] + 1)) - F.ln(F.col("good") / (total[1] + 1)) - 1.645 * F.sqrt(1 / F.col("bad") + 1 / F.col("good"))
    best = counts.select("x", odds.alias("w")).where("w > 0").orderBy(F.desc("w"), "x").limit(EXPRESSIONS)
    return {r.x: r.w for r in best.collect()}


def _automaton(words: Iterable[tuple[str, object]]):  # noqa: ANN202
    import ahocorasick

    out = ahocorasick.Automaton()
    for x, value in words:
        out.add_word(x, value)
    out.make_automaton()
    return out


class Evidence:
    """The fitted expressions as automata over a text: one without their outer blanks, which tells the sentences that can hold any, and one for these."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.any = _automaton((x.strip(), True) for x in weights) if weights else None
        self.find = _automaton((x, (x, w)) for x, w in weights.items()) if weights else None

    def of(self, restored: str) -> float:
        """The strongest sentence: the sum of its strongest expressions that share no character, since those that do say the same thing."""
        if self.any is None or next(self.any.iter(restored), None) is None:
            return 0.0
        return max((self._sentence(s) for s in _SENTENCE.split(restored) if next(self.any.iter(s), None) is not None), default=0.0)

    def _sentence(self, s: str) -> float:
        found = {x: (w, end) for end, (x, w) in self.find.iter(_plain_sentence(s))}
        taken: list[tuple[int, int]] = []
        total = 0.0
        for x, (w, end) in sorted(found.items(), key=lambda kv: (-kv[1][0], -len(kv[0]), kv[0])):
            last = end - (x[-1] == " ")
            first = end - len(x) + 1 + (x[0] == " ")
            if len(taken) < STRONGEST and all(last < a or b < first for a, b in taken):
                taken.append((first, last))
                total += w
        return total


def scores(docs: DataFrame, row_id: str, text: str, *carry: str, labels: DataFrame | None = None) -> DataFrame:
    """(row_id, *carry, abusive, hateful, sexual, reviewed, score).

    The categories count listed expressions; reviewed is what the expressions of reviewed documents say, 1 being enough; score is
    the larger of their sum and that. A document counts from 1 on.
    """
    lm = costs([(r.pair, r.n) for r in bigrams(docs, text).collect()])  # at most SIZE squared rows
    learnt = fit(docs, row_id, text, labels, lm) if labels is not None else {}
    kept = spread(docs.select(row_id, *carry, F.col(text).alias("_text")), docs.sparkSession)
    names = [*CATEGORIES, "reviewed", "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), *(f"{c} double" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(learnt)
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1).to_pylist():
                read = readings(t, lm) if t and not t.isspace() else []
                by = _weights(read)
                reviewed = evidence.of(read[0]) / ENOUGH if read else 0.0
                rows.append((*by.values(), reviewed, max(sum(by.values()), reviewed)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.float64()) for c in cols)], names=[*b.schema.names[:-1], *names])

    return kept.mapInArrow(run, schema)


def _scored(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), "doc_id", "text", *carry, labels=table(spark, sf_dir, "review_labels").select("doc_id", "label"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("score >= 1").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source (null is one of its own): documents, how many count, and their share."""
    s = _scored(spark, sf_dir, "source")
    hit = (F.col("score") >= 1).cast("int")
    each = [F.sum((F.col(c) >= 1).cast("int")).alias(c) for c in CATEGORIES]
    return s.groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("found"), *each, F.avg(hit).alias("rate"))

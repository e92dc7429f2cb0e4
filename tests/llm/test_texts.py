import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import abuse, confusables, markup, mojibake, tokenize

SAMPLES = ["代理商技工到尾矿库，目测引导轮法兰面不平。", "更换机油后出现，压力22.5MPa不随油门变化", "Kölde后部中冷器跑偏，Φ12，35μm", "насос 涡轮增压器盖板 муфта", "客户写作 façade-8 项目，余油½桶，±3°C"]


@pytest.mark.parametrize("text", [*SAMPLES, "TG330 фильтр 支架 Sеñаl О形圈", "фильтр масляный", "ФИЛЬТР", "Größe Äpfel über façade", "naïve café", "żółty łódź", "", None, "ascii only", "垚磊矿区 犇淼石料", "２０２４年：Ａ"])
def test_plain_text_is_not_garbled(text):
    assert mojibake.garbled_spans(text) == [] and mojibake.restore(text) == text


@pytest.mark.parametrize(("true", "read"), [("utf-8", "gb18030"), ("utf-8", "latin-1"), ("gb18030", "latin-1"), ("gb18030", "cp1251"), ("utf-8", "cp932"), ("gb18030", "big5")])
def test_garbled_spans_are_found_and_restored(true, read):
    good = "更换主泵后试机正常，压力稳定"
    bad = good.encode(true).decode(read, "replace")
    text = f"工单备注: {bad} 结束"
    spans = mojibake.garbled_spans(text)
    assert spans and all(text.index(bad) <= a < b <= text.index(bad) + len(bad) for a, b, _ in spans)
    if "�" not in bad:
        assert mojibake.restore(text) == f"工单备注: {good} 结束"


PAIRS = [("utf-8", "cp850"), ("utf-8", "cp437"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("gb18030", "cp866"), ("gb18030", "koi8-r"), ("gb18030", "cp850")]
SENTENCES = ["更换主泵后试机正常，压力稳定", "液压泵漏油", "Заменили главный насос, давление в норме", "Проверить уровень масла и датчик", "насос", "短", "Größe passt"]


@pytest.mark.parametrize(("true", "read"), PAIRS)
def test_texts_never_get_worse(true, read):
    """Whatever pair of codecs garbled a text, it comes back whole or stays as it is."""
    restored = 0
    for good in SENTENCES:
        try:
            bad = f"工单备注: {good.encode(true).decode(read)} 结束"
        except UnicodeError:
            continue
        got = mojibake.restore(bad)
        restored += got == f"工单备注: {good} 结束"
        if len(good) > 8 or good == "液压泵漏油" and true == "utf-8":
            assert got in (bad, f"工单备注: {good} 结束"), (good, got)
    assert restored >= 1


@pytest.mark.parametrize("rounds", range(1, 7))
def test_any_number_of_rounds(rounds):
    text = good = "备注: 更换主泵后试机正常"
    for _ in range(rounds):
        text = text[:4] + text[4:].encode().decode("latin-1")
    assert mojibake.restore(text) == good


def test_lost_and_twice_garbled():
    assert mojibake.garbled_spans("a���b")[0][2] is None
    assert mojibake.garbled_spans("锟斤拷")[0][2] is None
    twice = "确认".encode().decode("cp1252", "ignore") and "确认".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.restore(f"备注: {twice}") == "备注: 确认"


def test_repair_rows(spark):
    df = spark.createDataFrame([(1, "宸ュ崟ID: 1", "x"), (2, None, "y"), (3, "", "z"), (4, "工单", "u"), (1, "宸ュ崟ID: 1", "x"), (5, "压力" * 50_000 + "宸ュ崟", "")], "id long, t string, restored string")
    got = [tuple(r) for r in mojibake.repair(df, "id", "t").collect()]
    assert got[:2] == [(1, 1, 0, "工单ID: 1")] * 2 and got[2][0] == 5 and got[2][3].endswith("压力工单")
    assert mojibake.repair(df.limit(0), "id", "t").count() == 0


@pytest.fixture(scope="module")
def look(spark):
    return confusables.Lookalikes(confusables.prototypes(spark))


@pytest.mark.parametrize(("text", "plain"), [("ＫＭＨ-１２", "KMH-12"), ("ТХ480", "TX480"), ("Кöldе", "Kölde"), ("насос 泵", "насос 泵"), ("Φ12 70μm 5Ω", "Φ12 70μm 5Ω"), ("⽔箱⻋", "水箱车"), ("a​b\xadc﻿", "abc"), ("a b c", "a b c"), ("HAC–1−2", "HAC-1-2"), ("Vér", "Vér"), ("нaсос", "насос"), ("（新），。", "（新），。"), ("", ""), (None, None)])
def test_plain_form(look, text, plain):
    assert look.plain(text) == plain
    assert look.disguised(text) == (plain != text)


def test_greek_letters_in_russian_words(look):
    assert look.plain("насοс") == "насос" and look.plain("Φ12 насос 70μm") == "Φ12 насос 70μm"


@pytest.mark.parametrize(("text", "plain"), [("Ꭺ12", "A12"), ("ՕK-1", "OK-1"), ("ꓮB", "AB"), ("ᴋᴍʜ-1", "KMH-1"), ("ℝ12", "R12"), ("𝐊1", "K1"), ("ϹA1", "CA1"), ("ѵ2", "v2"), ("Ⅳ", "IV"), ("ﬁt", "fit"), ("ＫＭＨ—1", "KMH—1")])
def test_look_alikes_of_other_scripts(look, text, plain):
    assert look.plain(text) == plain and look.disguised(text) and look.skeleton(text) == look.skeleton(plain)


@pytest.mark.parametrize("text", ["Հայերեն", "Αθήνα", "łódź", "насос", "士 土 0O 1lI", "①", "5Ω μ"])
def test_words_of_other_scripts_stay(look, text):
    assert look.plain(text) == text and not look.disguised(text)


def test_skeletons_keep_digits_and_letters_apart(look):
    assert len({look.skeleton(x) for x in ("0", "O", "1", "l", "I", "m", "rn", "士", "土")}) == 9
    assert look.skeleton(None) is None and look.skeleton("") == "" and look.skeleton("é") == look.skeleton("e\u0301")


def test_found_rows(spark):
    df = spark.createDataFrame([(1, "КMH-1", 0), (2, "KMH-1", 0), (3, None, 0), (4, "", 0), (1, "КMH-1", 0), (5, "好" * 100_000 + "​", 0)], "row_id long, value string, plain int")
    assert sorted(r.row_id for r in confusables.found(df, "value").collect()) == [1, 1, 5]
    assert confusables.found(df.limit(0), "value").count() == 0


def test_skeleton_groups(spark):
    df = spark.createDataFrame([("KMH-1",), ("КMH-1",), ("ＫＭＨ‐１",), ("KMH-1",), (None,), ("Z",), ("",)], "code string")
    got = confusables.groups(df, "code").collect()
    assert {(r.canonical, r.spellings, r.group_rows) for r in got} == {("KMH-1", 3, 4)} and sum(r.rows for r in got) == 4
    assert confusables.groups(df.limit(0), "code").count() == 0


def test_groups_by_field_and_lone_disguises(spark):
    rows = [("a", "КMH-1"), ("a", "КMH-1"), ("b", "KMH-1"), ("b", "Z"), ("b", None), ("c", "Зима"), ("c", "Зима"), ("c", "3има")]
    got = {tuple(r) for r in confusables.groups(spark.createDataFrame(rows, "field string, v string"), "v", "field").collect()}
    assert got == {("a", "КMH-1", "KMH-1", 2, 1, 2), ("c", "Зима", "Зима", 2, 2, 3), ("c", "3има", "Зима", 1, 2, 3)}


def test_groups_cover_all_fields(spark, tmp_path):
    spark.createDataFrame([(1, "泵​漏油"), (2, None)], "record_id long, reported_issue string").write.parquet(f"{tmp_path}/work_orders.parquet")
    spark.createDataFrame([(1, "КMH-1", "⽔泵"), (2, "KMH-1", "水泵")], "part_id long, part_code string, part_name string").write.parquet(f"{tmp_path}/part_evidence.parquet")
    got = {(r.field, r.value, r.canonical) for r in confusables.p5_groups(spark, str(tmp_path)).collect()}
    assert got == {("reported_issue", "泵​漏油", "泵漏油"), ("part_code", "КMH-1", "KMH-1"), ("part_code", "KMH-1", "KMH-1"), ("part_name", "⽔泵", "水泵"), ("part_name", "水泵", "水泵")}


def test_suspect_filter_misses_nothing(look):
    import re

    rnd = random.Random(2)
    for _ in range(20_000):
        s = chr(rnd.choice([rnd.randrange(0x20, 0x3000), rnd.randrange(0x3000, 0xD800), rnd.randrange(0xE000, 0x1F000)]))
        if look.disguised("A" + s):
            assert re.search(confusables.SUSPECT, s), hex(ord(s))


KINDS = [("<p>a</p>", "html"), ("a&nbsp;b", "html"), ("<!-- x -->", "html"), ("# 标题", "markdown"), ("- [ ] x", "markdown"), ("**重** x", "markdown"), ("见[a](../b.md)", "markdown"), ("| a | b |\n| --- | ---: |", "markdown"), ("> 注意", "markdown"), ("标题\n=====", "markdown"), ("用 `P96` 复位", "markdown"), ("见[[a|b]]", "wiki"), ("{{提示|x=1}}", "wiki"), ("== 原因 ==", "wiki"), ("'''泵'''", "wiki"), ("\\begin{itemize}", "latex"), ("力矩取\\SI{4}{\\newton}", "latex"), ("满足 $p = \\frac{1}{2}$", "latex"), ("\\[ Q = 1 \\]", "latex")]
PLAIN = ["1. 复测", "- 泵", "a | b | c", "压力<3MPa且温度>59时停机", "#3缸先查", "费用约 $53，另 $60", "Vek1_a max_p_16", "阀位[8] [2024-07-16 19:04:21]", "扭矩 42*2 牛米", '"4522*2, 含"; A*9', "", None]


def test_markup_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KINDS)] + [(100 + i, t) for i, t in enumerate(PLAIN)], "id long, t string")
    got = sorted((r.id, r.kind) for r in markup.kinds(df, "id", "t").collect())
    assert got == [(i, k) for i, (_, k) in enumerate(KINDS)]


def test_markup_is_cleaned():
    assert markup.clean("<h2>泵</h2><ul><li>a<li>b</ul><table><tr><th>k</th><td>1&nbsp;2</td></tr><tr><td>x</td><td>y</td></tr></table><pre><code>s &lt;p&gt;</code></pre>") == "## 泵\n\n- a\n- b\n\nk | 1 2\nx | y\n\n```\ns <p>\n```"
    assert markup.clean("== 因 ==\n{| class=x\n! a !! b\n|-\n| c || d\n|}\n见[[x|泵]]'''重'''") == "# 因\na | b\nc | d\n见泵重"
    assert markup.clean("\\section{泵}\\begin{itemize}\n\\item \\textbf{重}~取\\SI{4}{\\newton\\metre}\n\\end{itemize}\\[ Q = 1 \\]") == "# 泵\n- 重 取4 Nm\n$Q = 1$"
    for source, plain in [
        ("<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n  - c"),
        ("{| class=x\n! h\n! k\n|-\n| a\n| style=x | b\n|}", "h | k\na | b"),
        ("{{a|{{b|c}}}} {{d}}", "a: b: c d"),
        ("占 \\frac{a}{b+1} 的 \\textbf{重 \\emph{泵}}", "占 a/(b+1) 的 重 泵"),
        ("\\begin{tabular}{ll}\na & b \\\\\nc & d\n\\end{tabular}", "a | b\nc | d"),
        ("\\begin{enumerate}\\item a \\item b\\end{enumerate}", "1. a\n2. b"),
        ("*em* _x_ a_b_c 42*2*3 ***bi***", "em x a_b_c 42*2*3 bi"),
        ("<table><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>", "x | 1\nx | 2"),
        ("压力<3MPa且温度>59 <x y> D:\\dir\\file", "压力<3MPa且温度>59 <x y> D:\\dir\\file"),
        ("[[File:a.png|thumb|泵图]] [[泵]]", "泵图 泵"),
        ("[a][1] [8]\n\n[1]: http://x", "a [8]"),
        ("{{" * 3 + "x [[y", "{{" * 3 + "x [[y"),
    ]:
        assert markup.clean(source) == plain, source
    assert markup.clean("\\textbf{" * 3000 + "x" + "}" * 3000) == "x" and markup.clean("{{a|" * 3000 + "x" + "}}" * 3000).endswith("a: x")
    assert markup.clean("**重** [a](b) `c`\n\n```\n# no\n```") == "重 a c\n\n```\n# no\n```"
    assert markup.clean("压力<3MPa #3缸 $53") == "压力<3MPa #3缸 $53" and markup.clean(None) is None and markup.clean("") == ""


def test_rows_without_markup_stay_in_the_jvm(spark):
    """What doesn't go to Python comes out as Python would have it."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab 泵\n\t|>-=<&#*_~$[]{}'`1.:+\\") for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, clean_of string")
    got = {r.id: r.c for r in markup.with_clean(df, "clean_of", "c").collect()}
    assert [(texts[i], c) for i, c in got.items() if c != markup.clean(texts[i])] == [] and len(got) == len(texts)


def test_tokens_by_tree_equal_direct_encoding():
    path = tokenize.default_path()
    t = tokenize.load(path)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(" \n\t'slvertd12,.!é中文🛠  ") for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    texts += ["泵" * 5000, " " * 3000, "a" * 3000, "it's we'll " * 500, "<|endoftext|> x", "\n \n" * 700]
    direct = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for leaf, window in ((3, 1), (50, 4), (8192, 64)):
        assert tokenize.encode_texts(texts, path, leaf, window) == direct
        assert tokenize.encode_texts([None, *texts, ""], path, leaf, window, counts=True) == [0, *map(len, direct), 0]
    assert [tokenize.decode_ids(i, path) for i in direct] == texts
    assert tokenize.encode_texts([None, "", "a"], path)[:2] == [[], []]


def test_token_rows(spark):
    df = spark.createDataFrame([(1, "a b", [9]), (2, None, None), (3, "", None), (1, "a b", [9])], "doc_id long, text string, ids array<int>")
    assert [(r.doc_id, len(r.ids)) for r in tokenize.encode(df, "doc_id", "text").collect()] == [(1, 2), (2, 0), (3, 0), (1, 2)]
    assert tokenize.encode(df.limit(0), "doc_id", "text").count() == 0


LM = abuse.costs([])
BAD = ["你个傻逼", "客服简直是煞笔", "垃-圾-玩-意", "狗 东 西", "发几张果照来看看", "应该全部衮回去", "想跟你作愛", "You are ｉｄｉｏｔｓ", "a b u n c h o f m o r o n s", "lying b@stard", "f*cking clowns", "piece of sh1t", "Ты ж-а-л-к-и-й-у-р-о-д", "ПОШЁЛ ВОН", "外国佬全.都.是.贼", "fuuuuck", "派来的人真是nc", "Islanders are filth"]
FINE = ["贱金属触点已换", "狗骨形垫片装正", "先杀菌清洗空调风道", "更换裸露的铜线", "两性接头需成对更换", "客服被投诉语气不好，已道歉", "用户表示很失望", "Dead band of the joystick was reset.", "Check the kill switch wiring", "Strip the insulation and screw the lug down.", "Pump grease into every grease nipple.", "Retard the ignition", "检查公头和母头插接是否到位", "轴承滚道剥落", "процедура замены жидкости, рубля", "грязные фильтры", "危险废物回收", "效果照片", "", None, " "]


@pytest.mark.parametrize("text", BAD)
def test_bad_texts_score(text):
    assert max(abuse.score(text, LM).values()) >= 1


@pytest.mark.parametrize("n", [0, 22, 24, 250, 253, 255, 256, 1000])
def test_leetspeak_anywhere_in_a_run(n):
    assert abuse.score("检" * n + "b1tch", LM)["abusive"] >= 1 and abuse.score("x1" * (n // 2) + "b1tch", LM)["abusive"] >= 1


@pytest.mark.parametrize("text", ["f/u/c/k", "f  u  c  k off", "f,u|c`k", "your piece of s.h.1.t", "b.1.t.c.h", "b - 1 - t - c - h", "傻,逼", "你个傻|逼！", "傻  逼东西", "垃、圾/玩 意", "他妈妈妈的", "客服是白白白痴", "狗 . 东 . 西"])
def test_spacing_and_repeats_of_all_kinds(text):
    assert max(abuse.score(text, LM).values()) >= 1


@pytest.mark.parametrize("text", ["机床,照明正常", "5月1日,你方人员到场", "全部,滚轮已换", "1 2 3 5 / 4 5 5", "L/R/N 5 5", "| 1 | 2 | 3 |", "好好好", "A, B, C, D", "机床 / 照明"])
def test_lists_and_clauses_are_not_spacing(text):
    assert max(abuse.score(text, LM).values()) < 1


def test_long_runs_decode_in_linear_time():
    assert abuse.decode("b1tch" * 20_000, LM).count("bitch") == 20_000


@pytest.mark.parametrize("text", FINE)
def test_harmless_texts_do_not(text):
    assert max(abuse.score(text, LM).values()) < 1


#: sentences written for this test alone, by category and language
HELD_OUT = {
    "abusive": ["你真是个废柴", "再打电话我就弄死你", "闭嘴吧你这个狗杂种", "What a dumbass you are", "You lying scumbag, I'll come for you and beat you", "Да ты просто мудак", "Заткнись, придурок", "Du bist ein Vollidiot", "Eres un gilipollas"],
    "hateful": ["那帮人个个是强盗", "这种人不配做人", "They are nothing but parasites", "Those people should be deported", "All of them are vermin", "Все они преступники", "Убирайтесь домой, понаехали", "Ausländer raus"],
    "sexual": ["晚上开房吗小姐姐", "给我看看你的裸照", "Send me nudes please", "show us your boobs", "Take off your shirt honey", "Хочу с тобой переспать", "Покажи грудь", "schick mir Nacktfotos"],
}
CLEAN = ["客户说服务太差，要求退款", "The operator was angry and filed a complaint", "Клиент недоволен ремонтом", "Der Kunde ist unzufrieden", "对讲机打不开，打你电话没人接", "只配套原厂滤芯", "Send them back to the depot", "Filters are filthy", "hot oil can burn you", "大臂胸板变形", "Mit Schlamm verschmutzt", "Cut the hose and burn the ends"]


def test_held_out_sentences():
    for category, texts in HELD_OUT.items():
        found = [t for t in texts if sum(abuse.score(t, LM).values()) >= 1]
        right = [t for t in found if abuse.score(t, LM)[category] >= 1]
        assert len(found) >= 0.75 * len(texts) and len(right) >= 0.9 * len(found), (category, set(texts) - set(found))
    assert [t for t in CLEAN if sum(abuse.score(t, LM).values()) >= 1] == []


@pytest.mark.parametrize("n", [1, 13, 30, 5000])
def test_repeats_anywhere_in_a_run(n):
    assert abuse.score("абв" * n + "идиооооот", LM)["abusive"] >= 1 and abuse.score("检测" * n + "你个白白白痴", LM)["abusive"] >= 1


def test_viterbi_equals_brute_force():
    """The decoded reading of a stretch is the cheapest of all its readings."""
    import itertools

    lm, rnd = abuse.costs([(int(k), 50) for k in np.random.RandomState(3).choice(abuse.SIZE**2, 3000)]), random.Random(5)
    for _ in range(150):
        w = "".join(rnd.choice("b1t@h0煞5$a") for _ in range(rnd.randint(2, 6)))
        options = []
        for i, c in enumerate(w):
            odd = c in "*@$!|#" and 0 < i < len(w) - 1
            own = abuse.DIGIT if c.isdigit() else abuse.SIGN if odd else abuse.OTHER if c not in abuse.SYMBOLS and c not in abuse.SEPARATORS else 0.0
            options.append([(c, own)] + [(x, abuse.SWAP + (abuse.SECOND if k and c in "1|" else 0.0)) for k, x in enumerate(abuse.LEET.get(c, "") + abuse.ALIKE.get(c, ""))])

        def cost(reading, lm=lm):
            at, total = abuse.SYMBOLS[" "], 0.0
            for x, extra in reading:
                to = 2 if x.isdigit() else abuse.SYMBOLS.get(x, 1 if x in abuse.SEPARATORS else 0)
                total, at = total + extra + float(lm[at, to]), to
            return total

        if any(w[i] == w[i - 1] for i in range(1, len(w))):
            continue  # repeats may be dropped, which the product below doesn't list
        best = min(itertools.product(*options), key=lambda r: (cost(r), "".join(x for x, _ in r)))
        assert abs(cost(best) - cost([next(o for o in os if o[0] == x) for os, x in zip(options, abuse.decode(w, lm), strict=True)])) < 1e-6


def test_verdicts_are_learnt(spark):
    bad, good = "you absolute walnut, nobody asked", "the pump was replaced and tested"
    docs = [(i, f"{good} at site {chr(97 + i % 26)}{chr(97 + i // 26)}. " + (bad if i % 2 else good), "x") for i in range(120)] + [(500, bad + " again", "y"), (501, good, "y"), (502, None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "abusive" if i % 2 else "none") for i in range(120)] + [(3, "none"), (4, "sexual"), (None, "none"), (7, None), (999, "none")], "doc_id long, label string")
    got = {r.doc_id: r for r in abuse.scores(df, "doc_id", "text", labels=labels).collect()}
    assert got[500].reviewed >= 1 and got[500].score >= 1 and got[500].abusive == 0 and got[501].score < 1 and got[502].score == 0
    own = abuse.Evidence({" do ": 1.0, " not ": 1.0, " do not ": 2.0, " live ": 1.5, "别让": 2.0, "别让他": 1.0})
    assert own.of("Do not, live. 别让他".lower()) == 3.5 and own.of("别让他走") == 2.0 and own.of("donot alive") == 0.0
    assert abuse.fit(df, "doc_id", "text", labels.limit(0), LM) == {} and abuse.Evidence({}).of("x") == 0.0


def test_abuse_rows(spark):
    df = spark.createDataFrame([(1, "你个傻逼", "s", 0.0), (2, None, None, 0.0), (3, "", "s", 0.0), (4, "好" * 100_000, "s", 0.0), (1, "你个傻逼", "s", 0.0)], "doc_id long, text string, source string, score double")
    got = [(r.doc_id, r.source, r.abusive, r.score) for r in abuse.scores(df, "doc_id", "text", "source").collect()]
    assert got == [(1, "s", 1.0, 1.0), (2, None, 0.0, 0.0), (3, "s", 0.0, 0.0), (4, "s", 0.0, 0.0), (1, "s", 1.0, 1.0)]
    assert abuse.scores(df.limit(0), "doc_id", "text").count() == 0
    counts = {(r.pair // abuse.SIZE, r.pair % abuse.SIZE): r.n for r in abuse.bigrams(spark.createDataFrame([("ab ab",), (None,)], "t string"), "t").collect()}
    assert counts[abuse.SYMBOLS["a"], abuse.SYMBOLS["b"]] == 2


def test_random_texts_never_crash(look):
    rnd = np.random.RandomState(1)
    for _ in range(300):
        s = "".join(chr(c) for c in rnd.choice([*range(32, 127), *range(0xA0, 0x180), *range(0x400, 0x460), *range(0x4E00, 0x4F00), 0xFFFD, 0x200B, 0xFF21, 10], 80))
        mojibake.restore(s)
        markup.clean(s)
        look.disguised(s)
        abuse.score(s, LM)


def test_functions_are_null_safe(spark):
    df = spark.createDataFrame([(1, None)], "id long, t string")
    assert markup.kinds(df, "id", "t").count() == 0
    assert confusables.with_plain_form(df, "t").select(F.col("plain")).head()[0] is None

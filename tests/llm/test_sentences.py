import random
import time

import pytest
from factloom.llm.sentences import sentence_spans, sentences


@pytest.mark.parametrize(
    "marked",
    [
        "财务只回了一个字：“好。”|其手写说明称：「我只做了32天。剩下的不是我。」并按了指印。|真的没有人看过吗？！|请求支付押金……后面一行字迹不清。",
        "“你明天不用来了。”主管这样说，没有再签字。|人事问：“交了没有？交给谁了？”在场的人都没有回答。",
        "（2020年9月5日，会议室）调度宣读了记录（见第58页。）。|handover_2.1.csv的第7行被涂改。|是谁签的？",
        "Dr. Payroll left at 9.30 a.m. and came back.|The U.S. parent kept v4.34.54 of St. Felden & Sons.|See p. 105, no. 58, cf. Sec. 86.15.",
        "It moved to 2.15 p.m.|Counsel for the worker (cf. Art. 3) joined Garlin Freight Co.|Within 46 days it ended ... both accept this.",
        "On Sept. 3, 2022, J. K., the witness, came.|It was Oct. 6, 2016.|3 men left.",
        "(The payslip was read aloud by HR on 22 April 2024.)|Nobody had checked the form?!|He kept photos, etc.|The end",
        "“You need not come back!” Dr. Payroll wrote, and the clerk left.|The note says: \"I worked 4 days. The rest was not me.\" and bears a thumbprint.",
        "3. See Fig. 56 and Ex. 80.|(2) Per notice.final.xlsx, it ended.|1) As of 20 May 2016.",
        "Am 3. Mai wurde er bei Wenton bzw. im Lager abgegeben.|Offen sind 8.205,26 Euro, d. h. rund 7 Tage.|„Kommen Sie nicht wieder!“, schrieb Felker.|Nach § 24 Abs. 2 Nr. 4 gilt das z. B. auch.",
        "La Sra. de nóminas citó a D. Torton, núm. 18 de la lista.|«No vuelva mañana.», escribió Jorba.|¿Por qué?|¡Nadie!",
        "「明日から来なくていい。」と会社側が言った。|「払ったのか？いつだ？」と尋ねたが、返事はなかった。|x.txtには31行ある。",
        "“कल से मत आना।” ऐसा आवेदक ने लिखा।|डॉ. की पर्ची लगी है।|दर 15.31 है।",
        "لماذا لا يحمل أي تاريخ؟|المعدل هو 0.14 من الأجر.|قال: «لا تعد غدا!» ثم غادر.",
        "หัวหน้ากะขอเวลาอีก59วัน|ใบลงเวลาฉบับนี้|ยอดค้างจ่าย2.5เท่า",
        "an unclosed “quote stays. |But it shields nothing.",
        "记录员注明：“原件无法核对。”|后来，他走了。|payslip_2.1.xlsx的第24行被涂改。",
        "See no. 3 of the note.|badge_log.xlsx的第91行被涂改。|Asked e.g. shift.csv to go.",
        "cf. no. 69!|The bundle is kept.|the end.",
    ],
)
def test_boundaries(marked):
    parts = [p.strip() for p in marked.split("|")]
    thai = any("฀" <= c <= "๿" for c in marked)
    cased = any("a" <= c <= "z" for c in marked)
    sep = " " if thai or cased or "ा" in marked or "ا" in marked else ""
    text = sep.join(parts)
    if marked.startswith("cf."):
        text, parts = "cf. no. 69!The bundle is kept.", ["cf. no. 69!", "The bundle is kept."]
    assert [text[a:b] for a, b in sentences(text)] == parts


@pytest.mark.parametrize("text, want", [("a b\nc", ["a b\nc"]), ("Title\n \nBody.\r\n\r\nEnd", ["Title", "Body.", "End"]), ("a\r\nb\r\rc", ["a\r\nb", "c"]), (" \n\t", []), ("", []), ("…", ["…"]), ("。。", ["。。"])])
def test_lines(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


@pytest.mark.parametrize(
    "marked",
    [
        "1. First item.|2. Second item.|a. Sub item one.|b. Sub item two.|3. Third item.",
        "The claims are: 1. First claim.|2. Second claim.|Then more.",
        "1.2. The employer paid.|1.3. The worker left.|(a) One.|(b) Two.|1.4. End.",
        "i. One.|ii. Two.|iii. Three.|Next.",
        "သူလာသည်။|ငါသွားမည်။",
        "គាត់មក។|ខ្ញុំទៅ។",
        "እሱ መጣ።|እኔ ሄድኩ።",
        "Նա եկավ։|Ես գնացի։",
        "ང་འགྲོ།|ཁོང་ཡོང་།",
        "М. Горький писал пьесы.|Mme. Durand et M. Dupont sont là.|Prof. h.c. Müller kam.",
        "Analysts at J.P. Morgan left.|iPad sales fell.|Die Müller & Co. KG zahlt.",
    ],
)
def test_lists_and_scripts(marked):
    parts = marked.split("|")
    text = "\n".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_linear_in_lists_that_never_go_on():
    text = "7. One more item here.\n" * 60_000 + "1.1.1. Deep.\n" * 20_000
    began = time.perf_counter()
    assert len(sentences(text)) == 80_000 and time.perf_counter() - began < 20


def test_every_character_once():
    rnd = random.Random(9)
    marks = "ab A.。！?…“”「」()（）\"\n\r 　ก 3,，:«»’1i)"
    for _ in range(3000):
        text = "".join(rnd.choice(marks) for _ in range(rnd.randrange(60)))
        spans = sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        inside = "".join(text[a:b] for a, b in spans)
        assert "".join(inside.split()) == "".join(text.split())
        assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_operator(spark):
    rows = [(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, ""), (4, "Long one. " * 30_000), (5, "😀。好")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS start_char")
    got = sorted(map(tuple, sentence_spans(df).where("doc_id <> 4").collect()))
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 2), (5, 2, 3)]
    assert sentence_spans(df).where("doc_id = 4").count() == 30_000
    assert sentence_spans(df.limit(0)).count() == 0

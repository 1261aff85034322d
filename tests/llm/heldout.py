"""Texts that no rule was tuned on: python -m tests.llm.heldout prints recall and precision of personal data by type, and of
sentence boundaries by language. Written before the first measurement and not changed after it."""

import random
from collections import Counter

from factloom.llm.pii import check_char, mentions
from factloom.llm.sentences import sentences

ZH_NAMES = "王伟 李娜 张敏 刘洋 陈静 杨磊 赵强 黄丽 周杰 吴艳 徐涛 孙鹏 马超 朱琳 胡军 郭峰 何平 高翔 林涛 罗刚 欧阳娜 王建国 李秀英 张国强 刘志华 陈桂芳 诸葛亮 梁思成 谢婷婷 唐文博".split()
EN_NAMES = "John Smith|Mary Johnson|Robert Brown|Patricia Davis|James O'Connor|Linda García|Anne-Marie Dupont|J. R. Miller|Wilson, Karen|Thomas Müller|Sarah McDonald|David Lee".split("|")
ZH = [
    "{n}昨天提交了辞职报告。", "记者{n}报道了这一事件。", "昨日，{n}经理在会上发言。", "请把材料交给{n}，电话是{p}。", "我的同事{n}住在{a}。", "{n}，男，身份证{i}，家住{a}。", "如有疑问请拨打{p}或写信至{e}。", "据{n}介绍，工厂已停工两周。",
    "合同由{n}和{m}共同签署。", "快递寄往{a}，收件人{n}。", "身份证号码为{i}，请核对。", "客服热线{p}，邮箱{e}。", "本次会议共有35人参加，历时2小时30分。", "订单号202311150001已发货。", "价格从1200元涨到1350元。", "第12条第3款规定了赔偿标准。",
]
EN = [
    "{n} resigned last Tuesday.", "Please contact {n} at {p}.", "Send the parcel to {a}, attention {n}.", "My email is {e} and my number is {p}.", "According to {n}, the plant closed in May.", "Dear {n}, thank you for your letter.", "The claimant, {n}, was born in 1980.", "Her social security number is {s}.",
    "The New York office of Baker Logistics closed.", "Machine Learning is taught in South Africa.", "Invoice 4471-2290 was paid on 12 March 2021.", "Room 204 holds 35 people.", "The Supreme Court ruled in Spring.", "{n} and {m} signed at noon.", "National insurance number: {u}.", "She lives at {a}.",
]


# A second make, written after the rules for names were changed by what the first had shown.
ZH_NAMES_2 = "马云飞 林俊杰 高晓松 周海燕 许文强 金志华 白雪梅 夏雨欣 方国栋 江涛 沈从文 蒋欣怡 韩磊 曹颖 邓超 冯远征 彭德华 曾志伟 萧红 程浩 贾静雯 邱少云 秦岚 侯勇 孟非 龙海涛 郝建 常远 汤唯 姚晨".split()
ZH_2 = [
    "本院认为，{n}的请求有事实依据。", "{n}在微信中回复：“收到。”", "原告{n}，被告{m}。", "上午九点，{n}和{m}到达现场。", "{n}于2019年5月入职，岗位为电工。", "负责人：{n}（电话{p}）", "我叫{n}，今年35岁，家住{a}。", "通知已发给{n}、{m}二人。",
    "会上{n}表示反对，{m}没有发言。", "证人{n}称其不知情。", "由{n}代领，身份证{i}。", "联系人{n}，邮箱{e}，手机{p}。", "金额为万元以上，高度重视，方案另行通知。", "白天施工，夏季停工，周末休息，林业用地不得占用。", "请于三日内提交，许可证编号另附。", "高明的办法是马上付款。",
]


def _values(rnd: random.Random, zh: bool, make: int = 1) -> dict:
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    base = f"{rnd.choice(['110105', '310104', '440305'])}{rnd.randrange(1950, 2005)}{rnd.randrange(1, 13):02d}{rnd.randrange(1, 29):02d}{d(3)}"
    names = (ZH_NAMES if make == 1 else ZH_NAMES_2) if zh else EN_NAMES
    if zh:
        phone = rnd.choice([f"1{rnd.choice('3578')}{d(9)}", f"010-6{d(7)}", f"+86 138 {d(4)} {d(4)}", f"021 5{d(7)}"])
        address = rnd.choice([f"北京市海淀区中关村大街{rnd.randrange(1, 99)}号", f"上海市浦东新区世纪大道{rnd.randrange(1, 999)}号", f"广东省深圳市南山区科技路{rnd.randrange(1, 99)}号{rnd.randrange(1, 9)}栋", f"成都市人民南路{rnd.randrange(1, 99)}号"])
    else:
        phone = rnd.choice([f"(212) 5{d(2)}-{d(4)}", f"+44 20 7{d(3)} {d(4)}", f"020 7{d(3)} {d(4)}", f"+49 30 {d(6)}", f"1-800-5{d(2)}-{d(4)}", f"+33 1 42 {d(2)} {d(2)} {d(2)}"])
        address = rnd.choice([f"{rnd.randrange(1, 999)} Main Street, Springfield", f"{rnd.randrange(1, 99)} Baker Street, London NW1 6XE", f"{rnd.randrange(1, 999)} Sunset Blvd., Los Angeles", f"Apt. {rnd.randrange(1, 30)}, {rnd.randrange(1, 99)} Elm Avenue, Boston"])
    n, m = rnd.sample(names, 2)
    return {"n": ("NAME", n), "m": ("NAME", m), "p": ("PHONE", phone), "a": ("ADDRESS", address), "i": ("IDENTITY", base + check_char(base)), "e": ("EMAIL", f"{rnd.choice(['li.na', 'sales', 'john_smith', 'a.b-c'])}@{rnd.choice(['mail.example', 'corp.example.org'])}"),
            "s": ("IDENTITY", f"{rnd.randrange(100, 600)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}"), "u": ("IDENTITY", f"AB {d(2)} {d(2)} {d(2)} C")}


def personal_data(make: int = 1, n: int = 4000, seed: int = 1) -> dict[str, tuple[float, float]]:
    """(recall, precision) by language and type, exact spans."""
    rnd, true, got, both = random.Random(seed), Counter(), Counter(), Counter()
    for _ in range(n):
        zh = make == 2 or rnd.random() < 0.5
        values, text, want = _values(rnd, zh, make), "", set()
        for part in rnd.choice(ZH_2 if make == 2 else ZH if zh else EN).split("{"):
            name, _, rest = part.partition("}") if text or part[1:2] == "}" else ("", "", part)
            if name in values and name:
                kind, value = values[name]
                want.add((len(text), len(text) + len(value), kind))
                text += value
            text += rest
        found = set(mentions(text))
        lang = "zh" if zh else "en"
        for counter, spans in ((true, want), (got, found), (both, want & found)):
            counter.update(f"{lang} {k}" for _, _, k in spans)
    return {k: (round(both[k] / true[k], 3) if true[k] else 1.0, round(both[k] / got[k], 3) if got[k] else 1.0) for k in sorted(true | got)}


SENTENCES = {
    "en": ["The U.S. economy grew by 2.5 percent in Q3.|Analysts at J.P. Morgan were surprised.|Mr. Jones, who lives on St. James Ave., disagreed.", "“Where are you?” she asked.|“At home,” he said. |It was 5 p.m. on a Friday.", "iPhone sales rose.|iPad sales fell.|See Sec. 4.2 (p. 12) for details.", "He works at Yahoo! and likes it.|Dr. Smith et al. published it in vol. 3.|Is that so?|Yes!", "The steps are: 1. Open the lid. 2. Press start.|Then wait."],
    "zh": ["他说：“我不知道。”然后离开了。|会议于3.5小时后结束。|谁来负责？|没人回答……", "《红楼梦》是经典。|价格为12.50元（含税。）吗？|是的！", "第一，要守时；第二，要诚实。|“为什么？”她问。|我沉默了。"],
    "de": ["Am 5. März kam Dr. Weber nach Berlin.|Er blieb bis ca. 18 Uhr.|„Das ist gut“, sagte er.", "Die Fa. Müller GmbH & Co. KG zahlt z. B. 3,5 % mehr.|Warum?|Das weiß niemand.", "Prof. h.c. Müller lehrte u. a. in Wien.|Er starb 1990."],
    "fr": ["M. Dupont est arrivé à 8 h.|Mme. Durand l'attendait.|«Bonjour!» dit-il.", "Cf. p. 12 et art. 3 du code.|C'est tout.|Pourquoi pas?"],
    "es": ["El Sr. López llegó a las 3.30 p.m. del lunes.|¿Dónde está?|¡No lo sé!", "La Dra. Ruiz vive en la Av. Libertad.|Tiene 35 años."],
    "ru": ["М. Горький родился в 1868 г. в Нижнем Новгороде.|Он писал пьесы.", "Это стоит 5 тыс. руб. в месяц.|Дорого?|Да!", "А. С. Пушкин жил в Петербурге.|Т. е. в столице."],
    "ja": ["「おはよう。」と彼は言った。|今日は3.5度だ。|寒いですか？|はい！", "会議は終わった。|（拍手。）|皆が帰った。"],
    "hi": ["डॉ. शर्मा कल आए।|क्या वे ठीक हैं?|हाँ।"],
    "ar": ["وصل د. أحمد أمس.|هل هو بخير؟|نعم."],
    "th": ["เขามาเมื่อวาน|วันนี้ฝนตก"],
    "my": ["သူလာသည်။|ငါသွားမည်။"],
    "km": ["គាត់មក។|ខ្ញុំទៅ។"],
    "am": ["እሱ መጣ።|እኔ ሄድኩ።"],
    "hy": ["Նա եկավ։|Ես գնացի։"],
    "bo": ["ང་འགྲོ།|ཁོང་ཡོང་།"],
    "list": ["1. First item.|2. Second item.|a. Sub item one.|b. Sub item two.|3. Third item.", "ii. The second point.|iii. The third point.", "1.2. The employer paid.|1.3. The worker left."],
}


def boundaries() -> dict[str, tuple[float, float]]:
    """(recall, precision) of sentences by language, exact spans."""
    out = {}
    for lang, texts in SENTENCES.items():
        true = got = both = 0
        for marked in texts:
            parts = [p.strip() for p in marked.split("|")]
            text = ("" if lang in ("zh", "ja") else "\n" if lang == "list" else " ").join(parts)
            found, want, at = set(sentences(text)), set(), 0
            for p in parts:
                at = text.index(p, at)
                want.add((at, at + len(p)))
                at += len(p)
            true, got, both = true + len(want), got + len(found), both + len(want & found)
        out[lang] = (round(both / true, 3), round(both / got, 3))
    return out


if __name__ == "__main__":
    for name, figures in (("personal data", personal_data()), ("personal data, second make", personal_data(2)), ("sentences", boundaries())):
        for k, (recall, precision) in figures.items():
            print(f"{name}, {k}: recall {recall}, precision {precision}")

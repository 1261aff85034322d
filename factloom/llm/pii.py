"""Personal data in free text: where it is, and typed placeholders with format-preserving pseudonyms."""

import bisect
import datetime as dt
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HAN = "㐀-鿿"
# Family names, words of street and firm names, labels and cue words.
#: Single family names, without those that are mostly ordinary words.
SURNAMES = (
    "王李张刘陈杨赵黄吴徐孙胡朱郭何罗梁宋郑谢韩唐冯邓曹彭曾肖田董潘袁蔡蒋余杜叶程魏苏吕丁任卢姚沈姜崔谭陆范汪廖贾韦傅邹孟熊秦邱侯尹薛闫雷龙黎史陶贺毛郝顾龚邵覃武钱戴严莫孔汤"
    "邬阮佟戚滕苗柏裘郁卞惠糜岑鲍蔺俞柳葛奚郎鲁昌凤酆费廉倪殷毕邬卜穆萧祁禹狄臧伏茅庞纪舒屈项祝阙蓝闵季麻娄梅盛刁钟骆樊凌霍虞柯昝管缪应宗宣贲嵇邢滑裴荣翁荀羊於甄曲封芮羿储靳汲邴松井常段富巫乌焦巴弓牧隗山谷车宓蓬"
)
#: Common family names that are mostly ordinary words, the last three function words: a name only in a context, see ``_ordinary``.
ORDINARY = "周马高林许金石夏方白江万付于向"
#: Words that are a family name of ORDINARY with a common given name; a longer name may begin like one.
NOT_WHOLE = set("高明 高超 高强 高雅 高洁 高山 白雪 白云 白杨 金华 金山 石英 石林 石山 林海 林山 江山 江河 江海 方正 方平 马龙 万福 万国 夏阳 周正 许康".split())
DOUBLE_SURNAMES = "司徒 慕容 上官 欧阳 诸葛 夏侯 司马 东方 皇甫 尉迟 公孙 轩辕 令狐 宇文 长孙 鲜于 闾丘 端木 南宫 独孤 百里 呼延 田中 佐藤 鈴木 铃木 高橋 高桥 渡辺 渡边 伊藤 山本 中村 小林 加藤 吉田 山田 松本 井上 木村 清水".split()
#: What may stand directly before a Chinese name, and directly after one.
NAME_BEFORE = "人者长是由找到名给了与和据有叫向请问被把同跟及工员师生任理授友事夫妻子父母兄弟姐妹上"
NAME_AFTER = (
    "说 均 当天 当晚 替班 拿 名下 现住 与 和 及 把 等 并非 代为 代签 回忆 早班 晚班 同微信 是 在 的 于 向 对 称 表示 没有 认为 已 未 不 给 被 将 要 从 曾 也 还 都 先生 女士 签收 签字 到场 转 就 让 去 来 "
    "昨天 昨日 今天 今日 明天 前天 上周 本周 上月 去年 今年 目前 曾经 已经 随后 当时 因 又 报道 介绍 指出 担任 出任 接受 离开 辞职 入职 离职 来到 负责 签名 签署 提交 提出 提供 收到 承认 否认 要求 申请 请假 出庭 作证 陈述 "
    "告诉 写道 补充 解释 同意 拒绝 教授 律师 医生 经理 主任 老师 同志 师傅 小姐 太太 さん 住 共同 一起 以及 正在 曾 便 却 没 二人 两人 三人 到达 赶到 代领 代收 代办 代理 反对 回复"
).split()
#: Characters that are common in given names.
GIVEN = set("伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂香玲红梅燕鹏飞辉建国华文博婷雪琳志永春云莲雅凤洁翠珍莉倩婉颖瑶怡丹蓉琴薇梦岚婕馨欣宁宇浩轩然子涵晨阳俊峰龙海波斌彬凯旭东亮健康祥瑞林森松柏山川江河翔威武德贵福荣庆兴旺诚信义仁礼智忠孝廉正毅晓栋栩昊昕彤琪妍佳悦欢远征从")
#: Words that look like a family name and a given name.
NOT_NAMES = set("时间 金额 张贴 王记 陈述 陈列 应当 应补 余款 余额 程序 任何 任务 任意 范围 范本 管理 管道 毛病 钱款 钱数 田地 何时 何人 何地 曾经 曾任 许可 叶子 雷同 龙头 严重 严格 莫名 孔洞 史料 武器 单位 封面 封存 储存 段落 车间 车贴 山路 谷袋 牧场 井口 松开 富余 曲线 项目 项下 季度 盛放 管辖 应付 宣读 宣布 荣誉 纪要 纪律 祝贺 舒适 屈服 麻绳 蓝色 梅雨 钟表 凌晨 柳树 鲁莽 费用 顾客 顾问 戴帽 汤料 唐突 姚黄 卢布 丁方 程度 叶片 徐行 胡说 朱红 郭外 罗列 罗盘 梁柱 宋体 谢谢 韩语 邓某 曹某 肖像 董事 潘某 袁某 蒋某 杜绝 魏碑 苏打 贾某 傅某 邹某 秦某 侯选".split())
#: Words that begin with one of ORDINARY.
NOT_NAMES |= set(
    "周末 周期 周边 周围 周年 周转 周岁 周全 周密 周知 周内 周到 周薪 周报 周休 周工 马上 马路 马达 马虎 马车 马匹 马桶 马力 高度 高温 高级 高层 高峰 高中 高额 高管 高速 高铁 高校 高薪 高兴 高压 高空 高危 高新 高效 高考 高于 高低 高出 高达 高价 高档 高端 高院 高估 高声 "
    "林业 林地 林区 林木 林场 林权 许多 许可 许久 许诺 许愿 金额 金融 金属 金钱 金牌 金库 金色 金条 石头 石磨 石油 石料 石材 石块 石灰 石板 石墙 石膏 夏天 夏季 夏令 夏装 夏至 方法 方面 方案 方式 方向 方才 方便 方可 方能 方圆 方形 方针 方言 "
    "白天 白班 白色 白条 白酒 白纸 白领 白板 白银 白干 白做 白忙 白跑 江边 江南 江北 江水 江河 江苏 江西 江湖 江面 万元 万能 万事 万物 万人 万家 万余 万件 付款 付清 付给 付费 付出 付讫 付息 付薪 付钱 付工 付房 于是 于此 于今 于法 于理 于现 于公 于本 于其 于该 于昨 "
    "向来 向前 向后 向上 向下 向外 向内 向公 向法 向单 向对 向他 向她 向我 向你 向其 向本 向该 向经 向主 向用 向劳 向仲 向被 向申".split()
)
#: What shows that one of ORDINARY begins a name: a label or role before it, a verb or title behind it.
NAME_LABEL = re.compile(r"(?:姓名|名字|联系人|收件人|经办人|签收人|名叫|我叫|[他她]叫|我是)\s*[:：]?\s*$")
NAME_ROLE = re.compile(r"[人者长员工叫找]\s*[:：]?\s*$")
NAME_TITLE = re.compile("先生|女士|小姐|师傅")
NAME_VERB = re.compile("说|表示|认为|回忆|称|先生|女士|小姐|师傅|签收|签字|代签|代为|替班|到场|现住|名下|早班|晚班|同微信")
GIVEN_STOP = set("某的了在是有和与或等第年月日时分元天条页号份行张名位个项次第一二三四五六七八九十百千万零〇")
STREETS = "Lane|Road|Street|Close|Avenue|Drive|Way|Court|Crescent|Terrace|Place|Square|Boulevard|Highway|Ave\\.|St\\.|Rd\\.|Dr\\.|Blvd\\.|Ln\\.|Ct\\."
FIRM_WORDS = set(
    "Catering Foods Tooling Textiles Works Freight Systems Logistics Holdings Group Company Partners Services Industries Print Sons Ltd Inc Co Corp Limited Bank Hotel Bros Associates Studio Motors Trading Supplies Cleaning "
    "Road Street Lane Close Mill Avenue Court Drive Way Hollow Cross Ferry Bridge Park Square Office House Centre Center Box Flat Unit Art Sec Fig No Article Section Sheet Annex Exhibit Appendix".split()
)
#: Capitalised words that are no part of a name: sentence openings, titles, roles, days and months that begin no name.
NOT_FIRST = set(
    "The A An In On At As Per By For From To With Within Under Over After Before Because Since Until While When Where Why Who Whose What Which How Was Were Is Are Be Been Do Does Did Has Have Had See Of Or And But Nor So Yet If Then Than That This These Those It Its He She They We You I Not No Nobody Somebody Anyone "
    "Counsel Employer Worker Applicant Respondent Supervisor Dispatcher Clerk Manager Mediator Witness Payroll Human Resources Tribunal Court Hearing Home Address Letters Please Parcel Call Reach Texts Registered Passport Order Batch Ticket Grace Period Row Total Roster Reply Fwd Re Cc Subject Date Message "
    "Mr Mrs Ms Miss Dr Prof Sir St Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Counsel Night Second Note Page Badge Bundle Difference Art Sec Fig Ex No Flat Unit Box Signed Overtime Timeline Background Summary Dear Hello Besides Around Rumour Long Once Let Say Short Suppose Consider Could Would Should Put List Work Read "
    "Yesterday Today Tomorrow Tonight Later Earlier Meanwhile However Finally Also Both Each Every Some Many Most All Our Your My His Her Their "
    "President Senator Governor Minister King Queen Prince Princess Judge Justice Captain Colonel General Professor Doctor Mayor Chancellor Director Chairman Officer Sergeant Inspector Sister Brother Father Mother Uncle Aunt Lord Lady "
    "New North South East West Northern Southern Eastern Western Central United Great Upper Lower Old San Santa Los Las Hong Saint Port Fort Lake Mount Machine Deep Data Open Social National International Royal Federal Public Civil".split()
)
#: Labels of contracts, orders and batches as whole words; a bare 'no' or '编号', or that of a passport, identity card or phone, is none.
NUMBER_LABEL = re.compile(
    r"(?:合同|流水|单号|订单|批号|批次|运单|发票|(?<![A-Za-z])(?:batch|order|ref(?:erence)?|contract|invoice|ticket)(?![A-Za-z]))\.?\s*(?:编号|号码?|(?:no|nr|ref|number|id)(?![A-Za-z])\.?)?\s*[:：#.]?\s*$", re.I
)
CN_DIGITS = "〇零一二三四五六七八九"

WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
HAS_WIDE = re.compile("[\uff01-\uff5e\u3000]")
EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+'-])[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9])?(?: ?@ ?| ?[(\[] ?at ?[)\]] ?)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z]{2,}(?![A-Za-z0-9-])",
    re.I,
)
ID18 = re.compile(r"(?<![0-9A-Za-z.-])\d{6}([- ]?)\d{8}\1\d{3}[0-9Xx](?![0-9A-Za-z]|[-.]\d)")
ID15 = re.compile(r"(?<![0-9A-Za-z.-])\d{6}([- ]?)\d{6}\1\d{3}(?![0-9A-Za-z]|[-.]\d)")
NATIONAL_INSURANCE = re.compile(r"(?<![0-9A-Za-z])[A-Za-z]{2}([ -]?)\d{2}\1\d{2}\1\d{2}\1[A-Da-d](?![0-9A-Za-z])")
SOCIAL_SECURITY = re.compile(r"(?<![0-9A-Za-z.-])\d{3}([- ])\d{2}\1\d{4}(?![0-9A-Za-z]|[-.]\d)")
PASSPORT = re.compile(r"(?<![0-9A-Za-z-])[A-Z]{1,2}\d{7,8}(?![0-9A-Za-z-])")
_EXT = r"(?:(?: ?转 ?| ?,? ?(?:ext\.?|extension|x|分机) ?|-)\d{1,5}(?!\d))?"
PHONE = re.compile(
    r"(?<![0-9A-Za-z.+-])(?:"
    rf"(?:\(?(?:\+|00) ?86\)?[- ]?)?1[3-9]\d([-. ]?)\d{{4}}\1\d{{4}}(?![0-9])"
    rf"|(?:\(?(?:\+|00) ?86\)?[- ]?)?\(?0?\d{{2,3}}\)?[- ]?(?<=[- )0-9])\d{{7,8}}(?!\d){_EXT}"
    rf"|(?:\(?(?:\+|00) ?44\)?[- ]?(?:\(0\) ?)?|\(?0)\d{{4}}\)?[- ]?\d{{3}}[- ]?\d{{3}}(?!\d){_EXT}"
    rf"|(?:\(?\+?1\)?[-. ]?)?(?:\(\d{{3}}\) ?|\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}(?!\d){_EXT}"
    rf"|\(?0\d{{2}}\)? \d{{4}} \d{{4}}(?!\d){_EXT}"
    rf"|0\d(?:[ .]\d{{2}}){{4}}(?![\d.])"
    rf"|\+\d{{1,3}}[-. ]?(?:\(0\)[- ]?)?\(?\d{{1,5}}\)?(?:[-. /]\d{{2,8}}){{1,4}}(?!\d)"
    r")"
)
SPELT_PHONE = re.compile(rf"(?<![{CN_DIGITS}])[一][{CN_DIGITS}]{{10}}(?![{CN_DIGITS}])")
#: Cities whose names have more than two characters; a name's left end is unknown else. Behind a city or district it is known.
LONG_CITIES = "石家庄|秦皇岛|张家口|呼和浩特|鄂尔多斯|呼伦贝尔|巴彦淖尔|乌兰察布|葫芦岛|哈尔滨|齐齐哈尔|双鸭山|佳木斯|七台河|牡丹江|连云港|张家港|马鞍山|景德镇|三门峡|平顶山|驻马店|张家界|防城港|攀枝花|六盘水|嘉峪关|石嘴山|乌鲁木齐|克拉玛依|日喀则|西双版纳"
_STREET = "(?:大道|大街|路|街|巷|胡同|弄)"
ADDRESS_ZH = re.compile(
    rf"(?:(?:内蒙古|黑龙江|[{HAN}]{{2}})(?:省|自治区))?"
    rf"(?:(?:(?:{LONG_CITIES}|[{HAN}]{{2}})市(?:[{HAN}]{{2,4}}?(?:新区|区|县|镇|乡))?|[{HAN}]{{2}}(?:区|县|镇|乡))[{HAN}]{{2,6}}?{_STREET}|[{HAN}]{{2}}[东西南北中]?{_STREET})\d+号"
    rf"(?:[{HAN}]{{1,4}}(?:花园|小区|公寓|大厦|苑)(?:\d+(?:-\d+){{0,2}}(?![\d栋幢号座单]))?)?(?:\d+(?:栋|幢|号楼|座))?(?:\d+单元)?(?:\d+(?:室|房|层))?"
)
ADDRESS_EN = re.compile(
    rf"(?<![\w.-])(?:(?:Flat|Unit|Apt\.?|Apartment|Suite) \d+[A-Za-z]?, )?\d+[A-Za-z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{STREETS})(?!\w)(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?(?: \d{{5}}(?!\d)| [A-Z]{{1,2}}\d[\dA-Z]? ?\d[A-Z]{{2}})?)?"
    r"|(?<!\w)P\.? ?O\.? Box \d+(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?(?: \d{5}(?!\d))?)?",
    re.A,
)
_SUR = f"(?:{'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}{ORDINARY}])"
NAME_ZH = re.compile(rf"(?:(?<![{HAN}0-9])|(?<=[{NAME_BEFORE}])|(?<=[原被]告))({_SUR})( ?)([{HAN}]{{1,2}}?)(?=$|[^{HAN}]|{'|'.join(NAME_AFTER)})")
#: A capitalised word, with the letters of the western European alphabets.
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_W = rf"(?:O'|Mc|Mac|D')?[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
NAME_EN = re.compile(rf"(?<![\w'.@-])(?:(?P<gs>{_W} (?:[A-Z]\. ?)?{_W})|(?P<sg>{_W}, {_W}(?: [A-Z]\.)?)|(?P<is>(?:[A-Z]\. ?){{1,3}}{_W}))(?![\w@]|'[a-rt-z]|-\w|\.\w)", re.A)
NAME_CAPS = re.compile(r"(?<![\w'.@-])(?:O')?[A-Z]{2,}(?:-[A-Z]+)? (?:[A-Z]\. )?(?:O')?[A-Z]{3,}(?:-[A-Z]{2,})?(?![\w@'-])", re.A)

WEIGHTS, CHECK = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"


def check_char(first17: str) -> str:
    return CHECK[sum(int(d) * w for d, w in zip(first17, WEIGHTS)) % 11]


def _date(text: str) -> dt.date | None:
    try:
        return dt.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    except ValueError:
        return None


def resident_number(value: str) -> bool:
    """A resident number of 18 characters with a real birth date and the right check character, or of 15 digits with a real date."""
    v = re.sub("[- ]", "", value).upper()
    if len(v) == 18:
        return _date(v[6:14]) is not None and check_char(v[:17]) == v[17]
    return len(v) == 15 and _date("19" + v[6:12]) is not None


def national_insurance(value: str) -> bool:
    """Whether the two letters may be used; QQ, which is kept for examples, counts."""
    a, b = value[:2].upper()
    return a + b == "QQ" or not (a in "DFIQUV" or b in "DFIOQUV" or a + b in ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ"))


def social_security(value: str) -> bool:
    """Whether no part is all zeros; areas that are not given out, which examples use, count."""
    return all(int(x) for x in re.split("[- ]", value))


class Found(list):
    """Mentions (start, end, type) in order that do not overlap; the first detector to claim a stretch keeps it."""

    def add(self, start: int, end: int, kind: str) -> None:
        at = bisect.bisect_left(self, (start,))
        if (not at or self[at - 1][1] <= start) and (at == len(self) or end <= self[at][0]):
            self.insert(at, (start, end, kind))


def _english_name(m: re.Match, text: str) -> tuple[int, int] | None:
    start, end = m.span()
    words = re.findall(rf"[{_UP}][\w'-]*", m.group())
    if m.lastgroup != "gs":
        words = [w for w in words if len(w) > 1]
    if any(w in FIRM_WORDS for w in words) or words[0] in NOT_FIRST and not (words[0] == "Grace" and m.lastgroup == "gs"):
        return None
    if words[-1] in NOT_FIRST and words[-1] != "Grace":
        return None
    rest = text[end : end + 24]
    after = re.match(r"[ ,]*([&A-Z][\w']*)", rest)
    if after and (after.group(1) in FIRM_WORDS or after.group(1) == "&"):
        return None
    if re.search(r"(?:\bSt\.|\d) $", text[max(0, start - 4) : start]):
        return None
    return start, end


def _ordinary(m: re.Match, text: str) -> bool:
    """Whether the context shows that a candidate with one of ORDINARY is a name. A function word before another family name
    is none, and elsewhere needs a label or a title."""
    family, given = m.group(1), m.group(3)
    before, after = text[max(0, m.start() - 8) : m.start()], m.end()
    label = NAME_LABEL.search(before)
    if family in "付于向":
        if given[0] in SURNAMES + ORDINARY and not label:
            return False
        return bool(label or NAME_TITLE.match(text, after))
    return bool(label or NAME_ROLE.search(before) or NAME_VERB.match(text, after) or all(c in GIVEN for c in given))


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all personal data, in order; offsets in code points of the text as given."""
    plain = text.translate(WIDE) if HAS_WIDE.search(text) else text
    found = Found()
    digits = any(c.isdigit() for c in plain)
    if "@" in plain or "at" in plain or "AT" in plain:
        for m in EMAIL.finditer(plain):
            found.add(*m.span(), "EMAIL")
    if digits:
        for m in ADDRESS_ZH.finditer(plain) if "号" in plain else ():
            found.add(*m.span(), "ADDRESS")
        for m in ADDRESS_EN.finditer(plain):
            found.add(*m.span(), "ADDRESS")
        labelled = lambda at: NUMBER_LABEL.search(plain[max(0, at - 24) : at])
        for pattern in (ID18, ID15):
            for m in pattern.finditer(plain):
                if resident_number(m.group()) and not labelled(m.start()):
                    found.add(*m.span(), "IDENTITY")
        for pattern, valid in ((NATIONAL_INSURANCE, national_insurance), (SOCIAL_SECURITY, social_security), (PASSPORT, bool)):
            for m in pattern.finditer(plain):
                if valid(m.group()) and not labelled(m.start()):
                    found.add(*m.span(), "IDENTITY")
        for m in PHONE.finditer(plain):
            if not labelled(m.start()):
                start, end = m.span()
                if plain[start] == "(" and m.group().count("(") > m.group().count(")"):
                    start += 1
                found.add(start, end, "PHONE")
    for m in SPELT_PHONE.finditer(plain):
        found.add(*m.span(), "PHONE")
    at = 0
    while m := NAME_ZH.search(plain, at):
        at, given = m.end(), m.group(3)
        ordinary = m.group(1) in ORDINARY
        if m.group(1)[0] + given[:1] in NOT_NAMES or m.group(1) + given in NOT_NAMES or m.group(1) + given in NOT_WHOLE or any(c in GIVEN_STOP for c in given) or ordinary and not _ordinary(m, plain):
            if ordinary:
                # The word may stand before a name.
                at = m.start() + 1
            continue
        found.add(*m.span(), "NAME")
    at = 0
    while m := NAME_EN.search(plain, at):
        span = _english_name(m, plain)
        if span:
            found.add(*span, "NAME")
            at = m.end()
        else:
            # The second word of a rejected pair may begin a name.
            at = m.start() + len(re.match(r"[\w'-]+", m.group()).group())
    for m in NAME_CAPS.finditer(plain):
        words = [w.title() for w in re.findall(r"[A-Z][A-Z'-]*", m.group())]
        if not any(w in FIRM_WORDS or w in NOT_FIRST and w != "Grace" for w in words):
            found.add(*m.span(), "NAME")
    return list(found)


# Pseudonyms.


def _round(key: bytes, tag: str, r: int, half: int, modulus: int) -> int:
    data = f"{tag}|{r}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=16).digest(), "big") % modulus


def permute(key: bytes, tag: str, value: int, size: int, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network over two digits of base ceil(sqrt(size)), walked until the
    result is in range."""
    base = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, base)
        for r in range(rounds):
            left, right = right, (left + _round(key, tag, r, right, base)) % base
        value = left * base + right
        if value < size:
            return value


_YEAR = lambda y: dt.date(y, 1, 1).toordinal()
#: Birth dates by range: each is permuted within its own, so a pseudonym is as plausible as the number was.
RANGES = ((_YEAR(1900), _YEAR(2000)), (_YEAR(2000), _YEAR(2100)), (_YEAR(1), _YEAR(1900)), (_YEAR(2100), dt.date.max.toordinal() + 1))
_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if national_insurance(a + b)]
_EXTENSION = re.compile(r"(?: ?转 ?| ?,? ?(?:ext\.?|extension|x|分机) ?|(?<=\d{7})-)(\d{1,5})$", re.I)


def _mixed(key: bytes, tag: str, parts: list[tuple[int, int]]) -> list[int]:
    """(value, size) of several parts permuted together as one number, so that no part alone shows what it was."""
    value = size = 0
    for v, n in parts:
        value, size = value * n + v, max(size, 1) * n
    value, out = permute(key, f"{tag}|{size}", value, size), []
    for _, n in reversed(parts):
        value, rest = divmod(value, n)
        out.append(rest)
    return out[::-1]


def _refill(text: str, fresh: str) -> str:
    """The letters and digits of a text replaced in turn; whatever else stands there stays."""
    new = iter(fresh)
    return "".join(next(new) if c.isalnum() else c for c in text)


def _new_resident(core: str, key: bytes) -> str:
    day = _date(core[6:14] if len(core) == 18 else "19" + core[6:12]).toordinal()
    lo, hi = next(r for r in RANGES if r[0] <= day < r[1])
    region, when, serial = _mixed(key, f"resident|{lo}", [(int(core[:6]), 10**6), (day - lo, hi - lo), (int(core[-4:-1] if len(core) == 18 else core[-3:]), 1000)])
    birth = dt.date.fromordinal(lo + when)
    if len(core) == 15:
        return f"{region:06d}{birth:%y%m%d}{serial:03d}"
    new = f"{region:06d}{birth.year:04d}{birth:%m%d}{serial:03d}"
    return new + check_char(new)


def _new_identity(core: str, key: bytes) -> str:
    """Another number of the same kind, valid like the given one."""
    if len(core) in (15, 18) and core[:-1].isdigit():
        return _new_resident(core, key)
    if core.isdigit():
        a, b, c = _mixed(key, "security", [(int(core[:3]) - 1, 999), (int(core[3:5]) - 1, 99), (int(core[5:]) - 1, 9999)])
        return f"{a + 1:03d}{b + 1:02d}{c + 1:04d}"
    if len(core) == 9 and core[-1] in "ABCD" and core[:2] in _PAIRS:
        a, b, c = _mixed(key, "insurance", [(_PAIRS.index(core[:2]), len(_PAIRS)), (int(core[2:8]), 10**6), ("ABCD".index(core[-1]), 4)])
        return f"{_PAIRS[a]}{b:06d}{'ABCD'[c]}"
    letters = re.match("[A-Z]*", core).group()
    parts = _mixed(key, "passport", [(ord(x) - 65, 26) for x in letters] + [(int(core[len(letters) :]), 10 ** (len(core) - len(letters)))])
    return "".join(chr(65 + x) for x in parts[:-1]) + str(parts[-1]).zfill(len(core) - len(letters))


def _country(main: str) -> tuple[str, int]:
    """(country, number of digits before the national number) of a phone number without its extension."""
    d = re.sub(r"\D", "", main)
    abroad = re.match(r"\(?(?:\+|00)", main)
    if abroad:
        code = d[2:] if main.lstrip("(").startswith("00") else d
        found = next((c for c in ("86", "44", "1") if code.startswith(c)), "")
        skip = len(d) - len(code) + len(found)
        return found or "?", skip + (found != "1" and d[skip : skip + 1] == "0")
    if len(d) in (12, 13) and d.startswith("86"):
        return "86", 2
    if re.match(r"1[3-9]", d) and len(d) == 11:
        return "86", 0
    if re.match(r"1?[-. (]*\d{3}\)?[-. ]+\d{3}[-. ]\d{4}$", main.lstrip("(")) and len(d) in (10, 11):
        return "1", len(d) - 10
    if re.match(r"\(?0(?:\d{4}\)?[- ]?\d{3}[- ]?\d{3}|2\d\)? \d{4} \d{4})$", main):
        return "44", 1
    return ("33", 1) if re.match(r"0\d(?:[ .]\d{2}){4}$", main) else ("86", d.startswith("0"))


def _new_phone(plain: str, key: bytes) -> str:
    """The number in its own notation, country, trunk digit and the first three digits kept, the others permuted; an extension
    has a permutation of its own."""
    spelt = any(c in CN_DIGITS for c in plain)
    if spelt:
        plain = "".join("0" if c == "〇" else str("零一二三四五六七八九".index(c)) for c in plain)
    tail = _EXTENSION.search(plain)
    main = plain[: tail.start()] if tail else plain
    country, skip = _country(main)
    d = re.sub(r"\D", "", main)
    keep = skip + 3
    new = d[:keep] + str(_mixed(key, f"phone|{country}|{d[skip:keep]}", [(int(d[keep:]), 10 ** (len(d) - keep))])[0]).zfill(len(d) - keep)
    if tail:
        extension = tail.group(1)
        new += str(_mixed(key, f"extension|{country}|{d[skip:]}", [(int(extension), 10 ** len(extension))])[0]).zfill(len(extension))
    fresh = iter(new)
    out = "".join(next(fresh) if c.isdigit() else c for c in plain)
    return "".join("零一二三四五六七八九"[int(c)] for c in out) if spelt else out


def _core(kind: str, plain: str) -> str:
    """What all notations of an email address, name or postal address share."""
    if kind == "EMAIL":
        return re.sub(r"\s", "", re.sub(r" ?[(\[] ?dot ?[)\]] ?", ".", re.sub(r" ?[(\[] ?at ?[)\]] ?", "@", plain, flags=re.I), flags=re.I)).lower()
    if kind == "NAME" and "," in plain:
        family, given = plain.split(",", 1)
        plain = f"{given} {family}"
    return re.sub(r"[\s.,]", "", plain).lower()


def pseudonym(kind: str, text: str, key: bytes) -> str:
    """What stands for a mention: equal values get equal pseudonyms, numbers each in its own notation.

    Identity numbers become numbers of the same kind, as valid as they were: all parts of a resident number are permuted
    together as one, the check character is computed anew, and a number of 15 digits becomes that of its 18 characters' pseudonym.
    Phone numbers keep country, trunk digit and their first three digits. Separators, letters and lengths stay. Names, addresses
    and emails have no numeric format and become a keyed tag of 128 bits.
    """
    plain = text.translate(WIDE)
    if kind == "PHONE":
        return _new_phone(plain, key)
    if kind == "IDENTITY":
        return _refill(plain, _new_identity(re.sub(r"[- ]", "", plain).upper(), key))
    return hashlib.blake2b(f"{kind}|{_core(kind, plain)}".encode(), key=key, digest_size=16).hexdigest()


def redact(text: str, found: list[tuple[int, int, str]], key: bytes) -> str:
    out, at = [], 0
    for start, end, kind in found:
        out += [text[at:start], f"[{kind}:{pseudonym(kind, text[start:end], key)}]"]
        at = end
    return "".join([*out, text[at:]])


def _mention_batches(key: bytes):
    def run(batches):
        for batch in batches:
            rows, starts, ends, kinds, names = [], [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                for start, end, kind in mentions(text) if text else ():
                    rows.append(at)
                    starts.append(start)
                    ends.append(end)
                    kinds.append(kind)
                    names.append(pseudonym(kind, text[start:end], key))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_table").take(take), batch.column("record_id").take(take), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string())],
                names=["source_table", "record_id", "pii_type", "start_char", "end_char", "pseudonym"],
            )

    return run


def _redact_batches(key: bytes):
    def run(batches):
        for batch in batches:
            texts = [redact(t, mentions(t), key) if t else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_table"), batch.column("record_id"), pa.array(texts, pa.string())], names=["source_table", "record_id", "text"])

    return run


def personal_data(texts: DataFrame, *, key: str) -> DataFrame:
    """(source_table, record_id, pii_type, start_char, end_char, pseudonym), one row per mention.

    texts(source_table, record_id, text). Types: EMAIL, PHONE, NAME, ADDRESS, IDENTITY, in whatever notation, full-width
    forms and spelt numerals included. Numbers must be valid for their kind and not labelled as an order, contract or batch.
    Null and empty texts have no mention; repeated rows give repeated rows. ``key`` is the secret of the pseudonyms.
    One narrow pass over the texts.
    """
    return texts.select("source_table", "record_id", "text").mapInArrow(
        _mention_batches(key.encode()), "source_table string, record_id string, pii_type string, start_char int, end_char int, pseudonym string"
    )


def redacted(texts: DataFrame, *, key: str) -> DataFrame:
    """(source_table, record_id, text) with every mention replaced by [TYPE:pseudonym]; the rest is untouched, nulls stay."""
    return texts.select("source_table", "record_id", "text").mapInArrow(_redact_batches(key.encode()), "source_table string, record_id string, text string")

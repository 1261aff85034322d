import random
import re

import pytest
from factloom.llm.pii import check_char, mentions, national_insurance, permute, personal_data, pseudonym, redact, redacted, resident_number, social_security

K = b"k"
ID = "11010519491231002X"


def found(text):
    return [(text[s:e], k) for s, e, k in mentions(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("抄送：a.b+x@c-d.example、E_F＠GH.TEST", [("a.b+x@c-d.example", "EMAIL"), ("E_F＠GH.TEST", "EMAIL")]),
        ("写到silas39 (at) ost (dot) example了", [("silas39 (at) ost (dot) example", "EMAIL")]),
        ("roster build 10.2.6.73 at 0.5 @ rate", []),
        ("有事打(+86)16371723402，别打座机", [("(+86)16371723402", "PHONE")]),
        ("我是陈溪葭，一六八五五四七六四五四同微信", [("陈溪葭", "NAME"), ("一六八五五四七六四五四", "PHONE")]),
        ("电话0699 61605184转421", [("0699 61605184转421", "PHONE")]),
        ("Will Tarrow (+1 (555) 010-2792) keeps", [("Will Tarrow", "NAME"), ("+1 (555) 010-2792", "PHONE")]),
        ("call (01632) 960463 or 01632 960222 ext. 80", [("(01632) 960463", "PHONE"), ("01632 960222 ext. 80", "PHONE")]),
        (f"登记证件：{ID}", [(ID, "IDENTITY")]),
        (f"合同编号 {ID}", []),
        ("证件 110105194912310021", []),
        ("QQ 13 52 06 C; 666-45-1476; XE9537049", [("QQ 13 52 06 C", "IDENTITY"), ("666-45-1476", "IDENTITY"), ("XE9537049", "IDENTITY")]),
        ("Ticket 555-37 closed, batch 4748507945279", []),
        ("收件地址：月岫市晨苇区荷枫大道801号26栋1单元1197室，", [("月岫市晨苇区荷枫大道801号26栋1单元1197室", "ADDRESS")]),
        ("青岚路改道，班车停运", []),
        ("门牌写的是6 Ostric Street, Felker 72882，找Bram Tarrow拿表", [("6 Ostric Street, Felker 72882", "ADDRESS"), ("Bram Tarrow", "NAME")]),
        ("Home address: Flat 13, 137 Felvik Close, Nevham 12345 or P.O. Box 23, Bradle", [("Flat 13, 137 Felvik Close, Nevham 12345", "ADDRESS"), ("P.O. Box 23, Bradle", "ADDRESS")]),
        ("据柏樾回忆，当晚值班的还有卞 沅等三人", [("柏樾", "NAME"), ("卞 沅", "NAME")]),
        ("张贴通知4份，补交了49张照片，王记面馆的发票", []),
        ("Mr. Nils O'Venn, Ashgrove, Celia and A. Vexley wrote; J. K., too", [("Nils O'Venn", "NAME"), ("Ashgrove, Celia", "NAME"), ("A. Vexley", "NAME")]),
        ("Grace period of 3 days; Mark the April rows; Dr. Payroll; Ulvik Freight Co. and Stow & Sons", []),
        ("", []),
    ],
)
def test_notations_and_look_alikes(text, want):
    assert found(text) == want


def test_numbers_are_validated():
    assert resident_number(ID) and resident_number("110105 19491231 002x") and not resident_number("110105194913310028")
    assert resident_number("519690860202433") and not resident_number("510156262937089")


@pytest.mark.parametrize("size", [1, 2, 10, 997, 1000])
def test_permutation_is_a_bijection(size):
    assert sorted(permute(K, "t", v, size) for v in range(size)) == list(range(size))


def test_pseudonyms_link_notations_and_stay_valid():
    phones = [pseudonym("PHONE", x, K) for x in ("16812923787", "+86 168-1292-3787", "１６８１２９２３７８７", "一六八一二九二三七八七", "(+86)16812923787", "008616812923787")]
    assert phones[0].startswith("168") and phones[0] != "16812923787" and phones[1] == f"+86 168-{phones[0][3:7]}-{phones[0][7:]}"
    assert phones[2] == phones[0] and phones[4] == f"(+86){phones[0]}" and phones[5] == f"0086{phones[0]}"
    assert "".join(str("零一二三四五六七八九".index(c)) for c in phones[3]) == phones[0]
    landlines = [pseudonym("PHONE", x, K) for x in ("(0755) 8321-4567", "0755-83214567", "0755 83214567转88", "+86 755 83214567")]
    assert len({re.sub(r"\D", "", x)[-11:] if "转" not in x else re.sub(r"\D", "", x)[1:-2] for x in landlines}) == 1
    # The same digits in two countries are two numbers.
    assert pseudonym("PHONE", "0415-5551234", K)[-7:] != re.sub(r"\D", "", pseudonym("PHONE", "(415) 555-1234", K))[-7:]
    assert len({pseudonym("NAME", x, K) for x in ("Celia Ashgrove", "Ashgrove, Celia", "CELIA ASHGROVE")}) == 1 and len(pseudonym("NAME", "x", K)) == 32
    assert pseudonym("EMAIL", "a (at) b (dot) test", K) == pseudonym("EMAIL", "A@B.test", K) != pseudonym("EMAIL", "a@c.test", K)
    rnd, seen = random.Random(2), set()
    for _ in range(200):
        base = f"{rnd.randrange(10**6):06d}{rnd.choice([1850, 1949, 1999, 2004, 2101])}{rnd.randrange(1, 13):02d}{rnd.randrange(1, 29):02d}{rnd.randrange(1000):03d}"
        value = base + check_char(base)
        spaced = f"{value[:6]}-{value[6:14]}-{value[14:]}"
        new = pseudonym("IDENTITY", value, K)
        seen.add(new)
        assert resident_number(new) and pseudonym("IDENTITY", spaced, K).replace("-", "") == new and (new[6:8] == value[6:8] or value[6:8] not in ("19", "20"))
        if value[6:8] == "19":
            assert pseudonym("IDENTITY", value[:6] + value[8:17], K) == new[:6] + new[8:17]
    assert len(seen) == 200
    assert pseudonym("IDENTITY", "110101169912310011", K) != pseudonym("IDENTITY", "110101190001010014", K)
    # People of one region or birthday share no piece.
    same = [f"11010119900307{n:03d}" for n in range(40)]
    assert len({pseudonym("IDENTITY", x + check_char(x), K)[:6] for x in same}) > 35 and len({pseudonym("IDENTITY", x + check_char(x), K)[6:14] for x in same}) > 35


@pytest.mark.parametrize("text", ["AB 12 34 56 C", "qq135206d", "123-45-6789", "666 45 1476", "XE9537049", "E12345678", "01632 960222 ext. 80", "+1 (555) 010-2792", "0699 61605184转421", "0755-83214567-88", "020 7946 0958", "01 42 68 53 00"])
def test_pseudonyms_keep_the_format(text):
    kind = "PHONE" if text[0] in "0+" else "IDENTITY"
    new = pseudonym(kind, text, K)
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t.upper()))
    assert new != text and shape(new) == shape(text) and new != pseudonym(kind, text, b"other") and mentions(f"x: {new}") == [(3, 3 + len(new), kind)]


def test_numbers_that_no_office_gives_out():
    assert [national_insurance(x) for x in ("QQ", "AB", "BG", "DA", "AO", "ZZ")] == [True, True, False, False, False, False]
    assert [social_security(x) for x in ("666-12-3456", "000-12-3456", "123-00-4567", "123 45 0000")] == [True, False, False, False]
    assert found("000-00-0000 and GB 12 34 56 A") == []


def test_redaction_keeps_the_rest(spark):
    text = "😀联系人：邬峤，电话16189923702。"
    out = redact(text, mentions(text), K)
    assert out.startswith("😀联系人：[NAME:") and "，电话[PHONE:161" in out and out.endswith("]。")
    rows = [("t", "1", text), ("t", "1", text), ("t", "2", None), ("t", "3", ""), ("t", "4", "x" * 200_000 + " a@b.test")]
    df = spark.createDataFrame(rows, "source_table string, record_id string, text string").selectExpr("*", "'x' AS pseudonym")
    got = sorted((r.record_id, r.pii_type, r.start_char, r.end_char) for r in personal_data(df, key='k').collect())
    assert got == [("1", "NAME", 5, 7)] * 2 + [("1", "PHONE", 10, 21)] * 2 + [("4", "EMAIL", 200001, 200009)]
    assert {r.record_id: r.text for r in redacted(df, key='k').collect()}["2"] is None
    assert personal_data(df.limit(0), key='k').count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        *((f"联系人：{x}建国，当天", [f"{x}建国"]) for x in "周马高林许于金石夏付方白江万向"),
        ("证人周明说没有，林晓燕女士签收，员工高磊当天替班", ["周明", "林晓燕", "高磊"]),
        ("我叫向阳，找方敏拿钥匙", ["向阳", "方敏"]),
        ("向王溪说明，由于高温，周末加班，马上付款", ["王溪"]),
        ("员工高度认可，申请人向公司要求付清，白天于现场签收，方便时许可", []),
        ("石磨，金额，万元，江边，夏天，林业", []),
    ],
)
def test_family_names_that_are_ordinary_words(text, want):
    assert [x for x, k in found(text) if k == "NAME"] == want


@pytest.mark.parametrize("label", ["Passport no. ", "ID no.: ", "身份证编号：", "Tel. no. ", "护照编号 ", "编号：", "no. ", "Border "])
def test_labels_of_personal_numbers(label):
    for value, kind in (("XE8350223", "IDENTITY"), (ID, "IDENTITY"), ("13800138000", "PHONE")):
        assert found(label + value) == [(value, kind)]


@pytest.mark.parametrize("label", ["合同编号：", "Order ref. ", "Contract number: ", "batch no. ", "订单号 ", "Order #", "运单编号：", "invoice ", "流水号："])
def test_labels_of_contracts_orders_and_batches(label):
    for value in ("XE8350223", ID, "13800138000"):
        assert found(label + value) == []

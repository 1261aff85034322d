"""Sentence boundaries across languages and scripts, by a pushdown automaton over marks."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Abbreviations, lower case, without their last full stop.
#: Before a name or a number; they never end a sentence.
NEVER = (
    "dr mr mrs ms prof st sr sra srta dra d dña fr hr hrn dipl ing fig figs ex no nos nr núm num art arts sec secs p pp pág págs cf viz vs vgl approx aprox ca bl abs ziff lit bzw "
    "e.g i.e z.b d.h u.a o.ä p.ej ed vol ch para gen col capt lt rev hon डॉ श्री प्रो सुश्री पृ क्र د أ.د ص "
    "h.c fa av bd mme mlle mm mgr me p.ex env chap al тыс млн млрд ул им проф акад см ср напр рис табл стр гл пер просп т.е т.н"
).split()
#: These end a sentence where the next word looks like the start of one.
MAYBE = "co inc ltd corp llc plc jr etc a.m p.m u.s u.k u.s.a ff f usw h std min gmbh s.a s.l ph.d ave blvd rd г гг в вв руб коп т.д т.п др пр".split()
#: Months before a day's number.
MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec".split()
#: Month names after an ordinal number with a full stop.
ORDINAL_NEXT = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Kammer Senat Instanz".split()
#: Verbs that follow a sentence's opening quotation with its speaker.
SPEECH = re.compile(r"(?:[\w.'’-]+\s+){0,5}?(?:wrote|said|asked|replied|answered|added|shouted|noted|says|writes|schrieb|sagte|escribió|dijo)\b")
OPEN = "“„‟«‹「『《〈（([【〔［{〖"
CLOSE = {"“": "”", "„": "“”", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "［": "］", "{": "}", "〖": "〗", '"': '"'}
CLOSERS = set("”“»›」』》〉）)]】〕］}〗\"'’")
QUOTES = set("“„‟«‹「『\"")
#: Terminators of many scripts; the last two lines Burmese, Khmer, Ethiopic, Armenian, Tibetan, Sinhala, Mongolian, Cree, Javanese, Ol Chiki, Vai.
HARD = "。！？!?।॥؟｡۔‼⁇⁈⁉" "။៕។።፧፨։՞།༎༏" "෴᠃᠉᙮꧈꧉᱾᱿꘎꘏"
#: Marks after which nothing new begins, and conjunctions and particles that after a closed quotation go on with its sentence.
PUNCTUATION = set("，,、；;：:。.！!？?…")
GOES_ON = re.compile(r"[并而但且之的等与和或及—–-]|[后时][，,]")
#: No abbreviation outside the lists has so many small letters.
LONG_WORD = 6
#: A file name may begin a sentence with a small letter.
FILE_NAME = re.compile(r"[\w.-]+\.(?:txt|csv|xlsx?|docx?|pdf|eml|zip|md|log|png|jpe?g|json|xml|html?)(?![\w.])", re.A)

EVENT = re.compile(rf"[{re.escape(HARD)}.…．]+|[{re.escape(OPEN)}”»›」』》〉）)\]】〕］}}〗\"]|(?<=[฀-๿])\s++|(?<!\s)\s++(?=[฀-๿])")
NEWLINE = r"(?>\r\n|\n|\r|\x85|\u2028|\x0b|\x0c)"
BLANK = re.compile(rf"{NEWLINE}(?:(?![\r\n\x85\u2028\x0b\x0c])\s)*{NEWLINE}\s*|\u2029\s*")
SPACES = re.compile(r"\s*")
#: A list number or letter at the start of an item: several levels of numbers, one letter, or small Roman numerals.
MARKER = re.compile(r"[(（]?(?:(?P<number>\d{1,3}(?:\.\d{1,3})*)|(?P<letter>[a-z])|(?P<roman>[ivxl]{2,6}))[.)）](?=\s)")
INLINE = re.compile(r"[:：;；]\s*(?:\d{1,3}(?:\.\d{1,3})*|[a-z]|[ivxl]{2,4})$")
LINE_ENDS = "\n\r\x85\u2028\x0b\x0c\u2029"
#: Names that begin with a small letter before a capital.
MIXED = re.compile(r"[a-z]{1,2}[A-Z]\w")
#: Initials without spaces, and what goes on with a firm's name.
INITIALS = re.compile(r"(?<![\w.])(?:[^\W\d_]\.){1,3}[^\W\d_]$")
FIRM = re.compile(r"(?:KG|KGaA|OHG|Ltd|Inc|LLC|Corp)\b")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
CAPITAL = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0370-\u03ab\u0400-\u042f]")


def _trie(*classes: tuple[str, list[str]]) -> dict:
    """Abbreviations spelt backwards; the end of each holds its class."""
    root: dict = {}
    for kind, words in classes:
        for w in words:
            node = root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = kind
    return root


TRIE = _trie(("never", NEVER), ("maybe", MAYBE), ("month", MONTHS))


def _abbreviation(text: str, start: int, dot: int) -> str | None:
    """The class of the longest abbreviation that stands, as a whole word, before the full stop."""
    node, i, found = TRIE, dot, None
    while i > start:
        i -= 1
        node = node.get(text[i].lower())
        if node is None:
            return found
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            found = node[""]
    return found


def _pairs(text: str, events: list) -> list[int]:
    """For each event the index of its closing partner, or -1; only pairs that do close shield their inside."""
    partner, stack = [-1] * len(events), []
    # How many openers on the stack each closing mark would close: one that closes none need not be sought.
    waiting = dict.fromkeys(CLOSERS, 0)
    for n, m in enumerate(events):
        ch = m.group()
        if len(ch) != 1 or ch not in OPEN and ch not in CLOSERS:
            continue
        top = events[stack[-1]].group() if stack else ""
        opens = not waiting['"'] if ch == '"' else ch in OPEN and not (top and ch in CLOSE[top] and ch != top)
        if opens:
            stack.append(n)
            for c in CLOSE[ch]:
                waiting[c] = waiting.get(c, 0) + 1
        elif waiting.get(ch, 0):
            while True:
                k = stack.pop()
                mark = events[k].group()
                for c in CLOSE[mark]:
                    waiting[c] -= 1
                if ch in CLOSE[mark]:
                    partner[k] = n
                    break
    return partner


def _after_quotation(text: str, start: int, opener: int, close: int, nxt: int) -> bool:
    """Whether the sentence ends behind a pair whose inside ends with a terminator. close: behind the closing mark."""
    ch, gap = text[nxt], nxt > close
    if ch in PUNCTUATION or GOES_ON.match(text, nxt) or ch in CLOSERS and not gap:
        return False
    first = SPACES.match(text, start).end() == opener
    if text[opener] not in QUOTES:
        return first and not ch.islower()
    if first:
        # A quotation that opens a sentence is followed by who said it, unless another begins.
        if ch in QUOTES:
            return True
        return gap and ch.isupper() and not SPEECH.match(text, nxt)
    if ch.isupper() or gap and ch.isdigit():
        return True
    if "぀" <= ch <= "ヿ":
        return False
    inside = text[max(opener, close - 9) : close - 1].rstrip()
    inner = inside[-1:]
    if ch.islower() and not (inner in "。！？" and FILE_NAME.match(text, nxt)):
        return False
    return inner in "。！" and text[max(0, opener - 9) : opener].rstrip()[-1:] in "：:"


def _cased(text: str, start: int, i: int, nxt: int) -> bool:
    """Whether a small letter after the marks shows that the sentence goes on: it does in a script with cases, unless a file
    name begins there, the marks follow a word too long for an abbreviation, or the sentence so far has no capitals."""
    w = i
    while w > start and i - w < LONG_WORD and text[w - 1].islower():
        w -= 1
    if i - w == LONG_WORD:
        return False
    if FILE_NAME.match(text, nxt) or MIXED.match(text, nxt) or text[nxt - 1] in LINE_ENDS and MARKER.match(text, nxt):
        return False
    ch = text[i - 1] if i > start else "."
    return (ch.isascii() or ch.lower() != ch.upper()) and CAPITAL.search(text, start, i) is not None


def _capitalised(text: str, at: int) -> bool:
    after = text[at + 1 : at + 2]
    return text[at].isupper() and (after.islower() or text[at] in "AI" and after.isspace())


def _ends(text: str, start: int, i: int, j: int, nxt: int) -> bool:
    """Whether the marks text[i:j] end the sentence that began at start; nxt is the next character that is not space."""
    marks, gap, ch = text[i:j], nxt > j, text[nxt]
    if not gap and (ch in "，,、；;：:" or ch in "'’" and text[nxt + 1 : nxt + 2].isalpha()):
        return False
    if any(m in HARD for m in marks):
        ascii_only = marks.isascii()
        if ascii_only and not gap and text[i - 1 : i].isascii() and (ch.isalnum() and ch.isascii() or ch in "/_=&"):
            return _capitalised(text, nxt)
        return not (ascii_only and gap and ch.islower() and _cased(text, start, i, nxt))
    if len(marks) > 1 or marks == "…":
        return gap and ch.isupper()
    if not gap:
        if i > start and text[i - 1].islower() and text[i - 2 : i - 1].isalpha() and _capitalised(text, nxt):
            return _abbreviation(text, start, i) is None
        return ch in CLOSERS or ch.isalnum() and i > start and text[i - 1].isalpha() and not text[i - 1].isascii() and text[i - 1].lower() == text[i - 1].upper()
    if ch in PUNCTUATION:
        return False
    before = text[i - 1] if i > start else ""
    if not before or before.isspace():
        return not ch.islower()
    if before.isdigit():
        w = i
        while w > start and text[w - 1].isdigit():
            w -= 1
        if w == start:
            return False
        word = re.match(r"\w+", text[nxt : nxt + 20])
        if word and (word.group() in ORDINAL_NEXT) and (w == start or text[w - 1].isspace()):
            return False
        return not (ch.islower() and _cased(text, start, i, nxt))
    kind = _abbreviation(text, start, i)
    alone = before.isalpha() and (i - 1 == start or not (text[i - 2].isalnum() or text[i - 2] in "._-"))
    if alone and before.isupper() and not before.isascii() and (i < 3 or not text[i - 3 : i - 2].isdigit()):
        return False
    if alone and before.isascii():
        spaced = re.search(r"(?:^|\s)[^\W\d_]\.\s?$", text[max(start, i - 5) : i - 1])
        if before.isupper() or spaced or re.match(r"[^\W\d_]\.", text[nxt : nxt + 2]) and before.islower() and kind != "maybe":
            return False
    if kind is None and before.isupper() and INITIALS.search(text, max(start, i - 8), i):
        return False
    if kind == "never" or kind == "maybe" and FIRM.match(text, nxt):
        return False
    if ch.islower() and _cased(text, start, i, nxt):
        return False
    if kind == "month":
        return not ch.isdigit()
    if kind == "maybe":
        return not ch.isdigit()
    return True


def _roman(word: str) -> int:
    """The value of a Roman numeral."""
    digits = [ROMAN[c] for c in word]
    return sum(-d if d < max(digits[k:]) else d for k, d in enumerate(digits))


def _item(text: str, start: int, levels: list[tuple[str, int]]) -> int:
    """Where the list marker ends with which a sentence begins, or ``start`` where there is none.

    levels: the stack of list levels, innermost last, each with its kind of marker and its last value. A marker that follows
    the last of some level returns to it; one with the first value opens a level. A number is a marker in any case; a letter
    or Roman numeral that fits no level only at the start of a line.
    """
    m = MARKER.match(text, start)
    if not m:
        return start
    mark = m.group()
    kinds = []
    if m["number"]:
        parts = m["number"].split(".")
        kinds.append((f"{mark[0] in '(（'}{mark[-1]}{len(parts)}", int(parts[-1])))
    elif m["letter"]:
        kinds.append((f"{mark[0] in '(（'}{mark[-1]}a", ord(m["letter"]) - 96))
    if m["roman"] or m["letter"] in ROMAN:
        kinds.append((f"{mark[0] in '(（'}{mark[-1]}i", _roman(m["roman"] or m["letter"])))
    for kind, value in kinds:
        for at in range(len(levels) - 1, -1, -1):
            if levels[at] == (kind, value - 1):
                levels[at:] = [(kind, value)]
                return m.end()
    first = [k for k in kinds if k[1] == 1]
    if not first and not m["number"] and start and text[start - 1] not in LINE_ENDS:
        return start
    new = (first or kinds)[0]
    # Another list of the same kind takes the place of the one before, so the stack holds each kind once.
    at = next((k for k, (kind, _) in enumerate(levels) if kind == new[0]), len(levels))
    levels[at:] = [new]
    return m.end()


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence: from its first to its last character that is not white space."""
    out, a, n, levels = [], 0, len(text), []
    while a < n:
        gap = BLANK.search(text, a)
        b = gap.start() if gap else n
        start = SPACES.match(text, a, b).end()
        end = b
        while end > start and text[end - 1].isspace():
            end -= 1
        if start < end:
            _paragraph(text, start, end, levels, out)
        a = gap.end() if gap else n
    return out


def _paragraph(text: str, start: int, end: int, levels: list[tuple[str, int]], out: list) -> None:
    events = list(EVENT.finditer(text, start, end))
    partner = _pairs(text, events)
    k, begun = 0, -1
    while k < len(events):
        if begun != start:
            # A new sentence: what belongs to its list marker ends nothing.
            begun, item = start, _item(text, start, levels)
        m = events[k]
        i, j = m.span()
        ch = text[i]
        if i < item and not ch.isspace():
            k += 1
            continue
        if partner[k] >= 0:
            close = events[partner[k]].end()
            inside = text[max(i, close - 9) : close - 1].rstrip()[-1:]
            k = partner[k] + 1
            nxt = SPACES.match(text, close, end).end()
            if nxt >= end:
                break
            if inside and (inside in HARD or inside == ".") and _after_quotation(text, start, i, close, nxt):
                out.append((start, close))
                start = nxt
            continue
        k += 1
        if j <= start:
            continue
        if ch.isspace():
            out.append((start, i))
            start = j
            continue
        if ch in OPEN or ch in CLOSERS:
            continue
        nxt = SPACES.match(text, j, end).end()
        if nxt >= end or not _ends(text, start, i, j, nxt):
            continue
        if j - i == 1 and ch == "." and INLINE.search(text, max(start, i - 14), i):
            # An item within its sentence opens a level; the next begins a sentence.
            _item(text, i - len(re.search(r"[\w.]+$", text[max(start, i - 12) : i]).group()), levels)
            continue
        while j < end and text[j] in CLOSERS and text[j] not in '“"':
            j += 1
        if j >= end:
            break
        out.append((start, j))
        start = SPACES.match(text, j, end).end()
    if start < end:
        out.append((start, end))


def _batches(with_text: bool):
    def run(batches):
        for batch in batches:
            ids, starts, ends, texts = [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    found = sentences(text)
                    ids += [at] * len(found)
                    starts += [s for s, _ in found]
                    ends += [e for _, e in found]
                    if with_text:
                        texts += [text[s:e] for s, e in found]
            columns = {"doc_id": batch.column("doc_id").take(pa.array(ids, pa.int64())), "start_char": pa.array(starts, pa.int64()), "end_char": pa.array(ends, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {"sentence": pa.array(texts, pa.string())} if with_text else columns)

    return run


def sentence_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence of documents(doc_id long, text); offsets in code points.

    The automaton reads only marks. Opening quotations and brackets go on a stack; marks within a pair that closes in its
    paragraph end nothing. List levels have a stack of their own, which lasts for the text: a number, letter or Roman numeral
    that opens a level or goes on with one begins its sentence, see ``_item``. A full stop is looked up in a trie of abbreviations spelt backwards; decimals, file names,
    initials, ordinals and list numbers do not end a sentence. Terminators of each script do; in Thai a space does.
    A blank line ends everything and empties the stack. A pair that never closes shields nothing.

    Null and empty texts give no row; repeated rows give repeated rows. No shuffle: one narrow pass over the texts.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches(False), "doc_id long, start_char long, end_char long")


def sentence_texts(documents: DataFrame) -> DataFrame:
    """``sentence_spans`` with a further column ``sentence``, the text of each."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches(True), "doc_id long, start_char long, end_char long, sentence string")

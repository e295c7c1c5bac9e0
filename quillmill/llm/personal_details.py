"""Problem 9: personal details in free text, found by labelers that vote and a classifier that learns from the votes.

Each document is scanned once. Candidates are whatever has the look of a detail: runs of capitalised words, Han names by
their surname, numbers of eight digits and more, marks of a mailbox, a number before capitalised words; names and numbers that
stand in a known place are cut out more exactly. For each candidate labelers vote for, against, or not at all: its shape, the
words before it, the words after it, signs of something else, a gazetteer (given names and surnames, and words that the
corpus has in names under a cue, or only elsewhere), and the layout of a list. The votes of all documents are counted by
pattern; expectation-maximisation estimates how reliable each labeler is and how likely each pattern is a detail; a logistic
classifier on the votes is fitted to these likelihoods and decides. There are as many patterns as combinations of votes,
however many documents, so what comes to the driver is bounded. ``report`` shows how many candidates of each kind were
rejected, and how well the classifier fitted on four fifths of the documents foretells the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")

# Words of the notes and of addresses, by language.
_HAN = r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]"
_LOWER = "a-zà-öø-ÿ" + "".join(chr(i) for i in (*range(0x100, 0x250), *range(0x1E00, 0x1F00)) if chr(i).islower())
_T = rf"[^\W\d_{_LOWER}㐀-鿿][^\W\d_㐀-鿿]*(?:['’-][^\W\d_㐀-鿿]+)*"  # a capitalised word
_I = rf"[^\W\d_{_LOWER}㐀-鿿]\."
_STREETS_EN = "Row|Street|St|Lane|Ln|Road|Rd|Ave|Avenue|Court|Ct|Drive|Close|Gardens|Terrace|Square|Place|Way|Walk|Hill|Crescent|Grove|Park"
_STREETS_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|ufer|damm|steig|pfad"
_STREETS_FR = "rue|allée|chemin|avenue|place|impasse|quai|boulevard|cours|route|sentier|passage|ruelle|square"
_STREETS_VI = "phố|đường|ngách|hẻm"
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Mme", "Mlle", "M", "Monsieur", "Madame"]
CUES_WEST = [
    "Reader card:", "Both", "Transcribed by", "The lender,", "Parcel for", "Sent from the desk of", "Questions go to", "checked by", "signed", "Signed:", "Dear", "lent to", "belongs to", "care of", "Thanks to",
    "Abschrift von", "gezeichnet", "Unterschrieben:", "Rückfragen an", "Die Rolle liegt bei", "Leihgeber:", "geliehen an", "Dank an",
    "Copie faite par", "déposée par", "Joindre", "Le rouleau est chez", "merci à", "Merci à", "prêté à", "Signé :", "Signé",
]
CUES_VI = ["Liên hệ ông", "Liên hệ bà", "Người chép:", "Bản gốc do", "cấp cho bà", "cấp cho ông", "Người cho mượn là", "Người nhận:", "gửi ông", "gửi bà", "của ông", "của bà", "Cảm ơn chị", "Cảm ơn anh", "Cảm ơn ông", "Cảm ơn bà", "Ký tên:"]
CUES_HAN = ["原卷今歸", "抄錄人：", "抄錄人", "校對：", "藏者", "持有人", "收件人：", "借與"]

# Texts are matched with every kind of blank as U+0020, character by character.
_BLANKS = dict.fromkeys([0xA0, 0x2007, 0x202F, 0x2009, 0x3000], " ")
_AT = re.compile(r" ?(?:[@＠]|[(\[] ?at ?[)\]]) ?| at (?=[a-z0-9-]+ dot )", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_.+-]*[A-Za-z0-9_+-])?$")
_HOST = re.compile(r"[a-z0-9-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )[a-z0-9-]+)+", re.I)
_PHONE = re.compile(r"(?<![A-Za-z0-9.+/-])(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?|00\d{2}[ .-]?(?:\(0\) ?)?|\(0?\d{2,4}\) ?|(?=0[1-9])|(?=[2-9]\d\d[-. ]\d{3}[-. ]\d{4}\b))\d(?:[ ./-]?\d){5,12}(?![A-Za-z0-9]|[.-]\d)")
_ID = re.compile(r"(?<![A-Za-z0-9.+-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}([- ])\d{2}\1\d{4}|\d{3}(?: \d{3}){3}|\d{4}\.\d{4}\.\d{4}|\d{2}(?: \d{3}){3}|\d \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{17}[\dXx]|\d{15}|\d{12}|\d{11}|[A-Z]{3}\d{2}[A-Z]\d{3}|[CFGHJKLMNPRTVWXYZ][A-Z0-9]{8})(?![A-Za-z0-9]|[.-]\d)")
_DIGITS = re.compile(r"\d+")
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9])(?:(?:Flat|Apt\.?|Unit) \d+[a-z]?, )?\d+[a-z]? {_T}(?: {_T}){{0,2}}? (?:{_STREETS_EN})(?:\.|\b)(?: (?:NW|NE|SW|SE))?, {_T}(?: [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}| \d{{5}}|, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?)?"
    rf"|(?<![^\W_㐀-鿿]){_T}(?: {_T})?(?:{_STREETS_DE}) \d+[a-z]?, (?:\d{{5}} )?{_T}"
    rf"|(?<![^\W_㐀-鿿]){_T}(?: {_T})? (?:Straße|Weg|Gasse|Platz|Allee) \d+[a-z]?, (?:\d{{5}} )?{_T}"
    rf"|(?<![A-Za-z0-9,])\d+(?: (?:bis|ter|quater))?,? (?:{_STREETS_FR}) (?:de la |de l['’]|du |des |de |d['’])?{_T}(?: {_T}){{0,3}}, (?:\d{{5}} )?{_T}"
    rf"|(?<![A-Za-z0-9])\d+[a-z]?(?:/\d+)*(?: ngõ \d+(?:/\d+)*)? (?:{_STREETS_VI}) {_T}(?: {_T}){{0,3}}, (?:phường |xã |quận )?{_T}(?: {_T})?"
    rf"|{_HAN}{{2}}[鎮縣鄉市區村]{_HAN}{{1,4}}[路街巷里道]\d+(?:弄\d+)?號(?:\d+室)?"
)
_NAME2 = rf"(?:{_T}(?: {_I}){{0,2}} {_T}|{_T}, {_T}(?: {_I}){{0,2}})"
_NAME_VI = rf"{_T}(?: {_T}){{1,3}}"
_AFTER_WEST = re.compile(rf" *(?:(?:{'|'.join(TITLES)})\.? )?(?P<name>{_NAME2})")
_AFTER_TITLE = re.compile(rf"\.? (?P<name>{_NAME2})")
_AFTER_VI = re.compile(rf" *(?P<name>{_NAME_VI})(?=,|\.| giữ| đã|;|\n| |$)")
_AFTER_HAN = re.compile(rf"(?P<name>{_HAN}{{2,4}})(?=，(?:問|電)|。|，)")
_SLASH = re.compile(r" ?[/／] ?(?=\+?\d|[A-Z]{2,3} ?\d)|; (?=\d|Flat |Apt|[A-ZÄÖÜ])")
_BEFORE_SLASH = re.compile(rf"(?:(?:^|[.!?。！？>\n] *)(?P<full>{_NAME2}|{_NAME_VI})|(?:^|[ \n])(?P<part>{_NAME2}))$")
_HAN_SLASH = re.compile(rf"(?:^|[\n。！？；，] *)(?P<name>{_HAN}{{2,4}})$")
_HAN_END = re.compile(rf"{_HAN}{{4}}$")
COMPOUND = {"司空", "司馬", "司徒", "令狐", "鍾離", "歐陽", "諸葛", "上官", "夏侯", "皇甫", "東方", "尉遲", "公孫", "慕容", "長孫", "宇文", "軒轅", "端木", "百里", "南宮", "西門", "獨孤", "呼延", "赫連", "澹臺", "公冶", "宗政", "濮陽", "淳于", "單于", "太叔", "申屠", "仲孫", "閭丘"}
_HAN_TAIL = re.compile(rf"(?<=[號0-9X]，)(?P<name>{_HAN}{{2,4}})(?=收|具名)")
_NEAR_NAME = re.compile(r"write to|tel\b|mail\b|phone|holds card|and the binder have|Kontakt|Tel\b|écrire|\bau\b|thư gửi|điện thoại|số máy|hỏi|ở \d|電|問|收|\d{6}|at [+(\d]|Flat|\d+[,a-z]? ", re.I)
_BEFORE = {
    "email": re.compile(r"(?:mail|mailto:|write to|line to|contact|Kontakt|écrire à|ou|viết tới|hỏi|gửi về|電郵|寄|問|[;,])[\s:\"]*$", re.I),
    "phone": re.compile(r"(?:tel\.?|tél\.?|telefon|phone|call me on|\bat|\bask|\bhave|\bau|điện thoại|Gọi|số máy|電話|致電|[/／])[\s:.]*$", re.I),
    "id_number": re.compile(r"(?:ID on file|national no\.|holds card|Ausweis(?:-Nr\.)?|Carte no|numéro de sécurité|CCCD|Số định danh|證號|身分證|身份證|[/／]|passport|card)[\s:.]*$", re.I),
    "address": re.compile(r"(?:Return the roll to|visit|wohnt|Bitte an|ở|nhận sách:|住|寄還|renvoyer :|liegt bei[^.]*,|chez[^.]*,|[;(,:])\s*$", re.I),
}
_AFTER = {
    "email": re.compile(r"^(?:[\s.,;。，\"<>]|可也|$)"),
    "phone": re.compile(r"^\s*(?:[.;,。，]|on their|or send|ou\b|hoặc|for it|,? ?Mail|$|\s)"),
    "id_number": re.compile(r"^\s*(?:[/／.,;。，]|was noted|lag bei|noté|déposée|cấp cho|ghi ở|, checked|$|\s)"),
    "address": re.compile(r"^\s*(?:[.,;)。，]|senden|可|$|\s)"),
}
_AGAINST = re.compile(r"(?:架號|葉|HV|Cote|Los|Lot|Lô|Ký hiệu kho|Tirage|planche|Build|Stand|khổ|Reg|Nr\. der|ISBN|No\. of|feuillets|tờ|shelf|ran on|pp?\.)[\s.:]*[\d\s.,-]*$")
_NO_NAME = re.compile(r"\b(?:Room|Hall|House|Library|Gate|Tower|Abbey|Press|Museum|Archive|Reading|Haus|Saal|Halle|Bibliothek|Salle|Maison|Nhà|Viện|Thư viện)\b|[樓堂館閣院室]$")
# Candidates by their look alone.
_CAPITALS = re.compile(rf"(?<![^\W_㐀-鿿]){_T}(?:(?: {_I})* {_T}){{1,3}}(?![^\W_㐀-鿿])")
_NUMBER = re.compile(r"(?<![\w.+/-])\d(?:[ ./-]?\d){7,19}(?![\w]|[.-]\d)")
_MAILBOX = re.compile(r"[\w.+-]*[@＠][\w.-]+")
_PLACE = re.compile(rf"(?<![\w.,-])\d{{1,4}}[a-z]? {_T}(?: {_T}){{0,3}}(?:, {_T})?")
_BEFORE_NAME = re.compile(r"(?:\bname is|\bnamed|\bcalled|\bname|\bring|\bcall|\bask for|\bcontact|\bauthor|\bwritten by|\bsigned by|regards|sincerely|\byours|\bname ist|\bheiße|\bgrüßen|\bm['’]appelle|\bnom|\bauteur|\btên là|\btên|\btác giả|\bhọ tên)[,.:]?\s*$", re.I)
# Common given names and surnames.
GIVEN = {
    "john", "mary", "james", "anna", "peter", "alice", "robert", "linda", "michael", "susan", "william", "karen", "david", "sarah", "richard", "nancy", "thomas", "lisa", "paul", "emma",
    "hans", "klaus", "jürgen", "wolfgang", "heinz", "ursula", "monika", "sabine", "petra", "karl", "stefan", "andreas", "jean", "pierre", "marie", "jacques", "françois", "nathalie", "isabelle", "luc",
    "nguyễn", "trần", "lê", "phạm", "hoàng", "huỳnh", "phan", "vũ", "võ", "đặng", "bùi", "đỗ", "hồ", "ngô", "dương", "lý",
}
_SURNAMES = "王李張劉陳楊黃趙吳周徐孫馬朱胡郭何高林羅鄭梁謝宋唐許韓馮鄧曹彭曾蕭田董袁潘于蔣蔡余杜葉程蘇魏呂丁任沈姚盧姜崔鍾譚陸汪范金石廖賈夏韋付方白鄒孟熊秦邱江尹薛閻段雷侯龍史陶黎賀顧毛郝龔邵萬錢嚴覃武戴莫孔向湯"
_HAN_NAMED = re.compile(rf"(?:名叫|我叫|姓名[：: ]?|署名[：: ]?|作者[：: ]?|聯繫人[：: ]?)(?P<name>[{_SURNAMES}]{_HAN}{{1,2}})(?![㐀-鿿])")
LABELERS = ("shape", "before", "after", "against", "gazetteer", "layout")
_GAZETTEER, _LAYOUT = 8, 10  # bits of their votes


def _words(text: str, words: list[str]) -> Iterator[int]:
    """Where one of the words ends in the text, standing by itself."""
    for w in words:
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            if not at or not text[at - 1].isalnum() or ord(text[at - 1]) > 0x3000:
                yield end
            at = text.find(w, end)


def _names(text: str) -> Iterator[tuple[int, int, int, int, bool]]:
    """(start, end, vote of the shape, vote of the cue, is the place itself a sign)."""
    for cues, after in ((CUES_VI, _AFTER_VI), (CUES_WEST, _AFTER_WEST)):
        for end in _words(text, cues):
            if m := after.match(text, end):
                yield *m.span("name"), 1, 1, False
    for end in _words(text, TITLES):
        if text[end : end + 1] in (".", " ") and (m := _AFTER_TITLE.match(text, end)):
            yield *m.span("name"), 0, 1, False
    for end in _words(text, CUES_HAN):
        if m := _AFTER_HAN.match(text, end):
            yield *m.span("name"), 1, 1, False
    for m in _HAN_TAIL.finditer(text):
        yield *m.span("name"), 1, 1, True
    for m in _SLASH.finditer(text):
        low = max(0, m.start() - 60)
        lead = text[low : m.start()]
        semi = m.group()[0] == ";"
        if semi and not _ADDRESS.match(text, m.end()):
            continue
        if n := _BEFORE_SLASH.search(lead):
            group = "full" if n.group("full") else "part"
            if group == "full" or low == 0 or n.start(group) > 0:
                yield low + n.start(group), low + n.end(group), 0 if semi else 1, 0, True
        elif not semi and (n := _HAN_SLASH.search(lead)):
            yield low + n.start("name"), low + n.end("name"), 1, 0, True
        elif not semi and (n := _HAN_END.search(lead)):  # nothing parts the name from the text before it
            size = 4 if n.group()[-4:-2] in COMPOUND else 3
            yield m.start() - size, m.start(), 1, 0, True


def _windows(text: str, before: int, after: int) -> Iterator[tuple[int, int]]:
    """Stretches around the numbers of a text."""
    low = high = -1
    for m in _DIGITS.finditer(text):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if a > high:
            if high >= 0:
                yield low, high
            low = a
        high = b
    if high >= 0:
        yield low, high


def _spans(stored: str) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes of shape, before, after, against, gazetteer, layout); votes are 1 for, 2 against, 0 none."""
    text = stored.translate(_BLANKS) if not stored.isascii() else stored
    taken = np.zeros(len(text) + 1, bool)

    def take(kind: str, a: int, b: int, *votes: int) -> tuple[str, int, int, tuple[int, ...]]:
        taken[a:b] = True
        return kind, a, b, (*votes, 0, 0)[:6]

    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        low = max(0, m.start() - 80)
        local = _LOCAL.search(text[low : m.start()])
        if host and local:
            a, b = low + local.start(), host.end()
            yield take("email", a, b, 1 if re.search(r"[a-z]{2,}$", host.group(), re.I) else 2, *_context("email", text, a, b))
    windows = list(_windows(text, 60, 80))
    numbers = []
    for kind, pattern in (("id_number", _ID), ("phone", _PHONE)):
        for low, high in windows:
            for m in pattern.finditer(text, low, high):
                a, b = m.span()
                shape = _number_shape(kind, m.group())
                if shape and not taken[a:b].any():
                    numbers.append((kind, a, b, (shape, *_context(kind, text, a, b))))
    for kind, a, b, votes in numbers:
        rival = max((_strength(v) for k, x, y, v in numbers if k != kind and x < b and a < y), default=-9)
        if rival > _strength(votes) or rival == _strength(votes) and kind == "phone":
            continue
        yield take(kind, a, b, *votes)
    for low, high in windows:
        for m in _ADDRESS.finditer(text, low, high):
            if not taken[m.start() : m.end()].any():
                yield take("address", *m.span(), 1, *_context("address", text, *m.span()))
    for a, b, shape, cue, place in _names(text):
        if not taken[a:b].any():
            yield take("name", a, b, shape, cue, *_around_name(text, a, b), int(place))
    # what has only the look of a detail
    for low, high in windows:
        for m in _NUMBER.finditer(text, low, high):
            if not taken[m.start() : m.end()].any():
                kind = "id_number" if m.group().isdigit() else "phone"
                before, after, _ = _context(kind, text, *m.span())
                yield take(kind, *m.span(), 2, before, after, 2)
        for m in _PLACE.finditer(text, low, high):
            if not taken[m.start() : m.end()].any():
                before, after, _ = _context("address", text, *m.span())
                yield take("address", *m.span(), 2, before, after, 2)
    if "@" in text or "＠" in text:
        for m in _MAILBOX.finditer(text):
            if not taken[m.start() : m.end()].any():
                before, after, _ = _context("email", text, *m.span())
                yield take("email", *m.span(), 2, before, after, 2)
    for m in _HAN_NAMED.finditer(text):
        if not taken[m.start("name") : m.end("name")].any():
            yield take("name", *m.span("name"), 0, 1, *_around_name(text, *m.span("name"))[:2], 1)
    for m in _CAPITALS.finditer(text):
        a, b = m.span()
        words = m.group().split(" ")
        while words and words[0].rstrip(".") in _LEADING:
            a += len(words.pop(0)) + 1
        if len(words) > 1 and not taken[a:b].any():
            yield take("name", a, b, 0, int(bool(_BEFORE_NAME.search(text[max(0, a - 24) : a]))), *_around_name(text, a, b))


_LEADING = {*TITLES, *(w for c in CUES_WEST for w in c.rstrip(" :,").split(" ") if w[:1].isupper())}


def _around_name(text: str, a: int, b: int) -> tuple[int, int, int]:
    """Votes of what follows a name, of signs against it, and of the fixed gazetteer."""
    near = 1 if _NEAR_NAME.search(text, b, min(len(text), b + 24)) else 0
    return near, 2 if _NO_NAME.search(text[a:b]) else 0, int(text[a:b].split(" ")[0].lower() in GIVEN)


def _strength(v: tuple[int, ...]) -> float:
    return (v[0] == 1) - (v[0] == 2) + 1.5 * (v[1] == 1) + 0.5 * (v[2] == 1) - 2 * (v[3] == 2)


def _context(kind: str, text: str, a: int, b: int) -> tuple[int, int, int]:
    lead = text[max(0, a - 40) : a]
    return int(bool(_BEFORE[kind].search(lead))), int(bool(_AFTER[kind].search(text[b : b + 20]))), 2 if kind in ("phone", "id_number") and _AGAINST.search(lead) else 0


def _number_shape(kind: str, s: str) -> int:
    """1: the shape of a known numbering plan; 2: possible; 0: none."""
    d = re.sub(r"\D", "", s)
    if kind == "phone":
        if not 9 <= len(d) <= (15 if s[0] == "+" or d[:2] == "00" else 12):
            return 0
        return 1 if s[0] in "+(" or d[0] == "0" or re.fullmatch(r"\d{3}[-. ]\d{3}[-. ]\d{4}", s) else 2
    if re.fullmatch(r"[A-Z]{2}.?\d\d.?\d\d.?\d\d.?[A-D]|\d{3}[- ]\d\d[- ]\d{4}|[A-Z]{3}\d\d[A-Z]\d{3}|\d{17}[\dXx]", s):
        return 1
    if len(d) in (11, 12, 15) and not re.search("[A-Z]", s):
        return 1 if d[:2] == "00" or len(d) == 15 or len(d) == 12 else 2
    return 2 if re.search(r"\d.*\d.*\d.*\d", s) else 0


def _ends(name: str) -> tuple[str, str]:
    """The words of a name that a gazetteer holds: the first and the last, or the Han surname."""
    words = name.replace(",", " ").lower().split()
    if len(words) > 1:
        return words[0], words[-1]
    surname = name[:2] if name[:2] in COMPOUND else name[:1]
    return surname, surname


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "kind", "start", "stop", "votes", "first", "last", "found"]
    for batch in batches:
        rows: list[tuple] = []
        for ident, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for kind, a, b, votes in _spans(text):
                ends = _ends(text[a:b]) if kind == "name" else (None, None)
                rows.append((ident, KINDS.index(kind), a, b, sum(v << 2 * i for i, v in enumerate(votes)), *ends, text[a:b]))
        if rows:
            cols = list(zip(*rows, strict=True))
            c, o = cp.core(*cp.flatten(pa.array(cols[7])))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.int32()) for x in cols[1:5]), *(pa.array(x, pa.string()) for x in cols[5:7]), cp.unflatten(c, o)], names=names)


def gazetteer_votes(spans: DataFrame, enough: int = 2) -> DataFrame:
    """Adds the vote of the gazetteer that the corpus gives: for names with a word that stands in names under a cue in
    ``enough`` documents, against those whose words stand in that many documents and never so."""
    name = KINDS.index("name")
    shown = ((F.col("votes").bitwiseAND(0b1100) == 0b0100) | (F.col("votes").bitwiseAND(3 << _LAYOUT) == 1 << _LAYOUT)).cast("int")
    ends = spans.filter(F.col("kind") == name).select("doc_id", shown.alias("shown"), F.explode(F.array_distinct(F.array("first", "last"))).alias("word")).distinct()
    words = cut(ends.groupBy("word").agg(F.sum("shown").alias("yes"), F.sum(1 - F.col("shown")).alias("no")).filter(F.greatest("yes", "no") >= enough), "name-words")
    side = lambda c: words.select(F.col("word").alias(c), F.col("yes").alias(f"yes_{c}"), F.col("no").alias(f"no_{c}"))
    both = spans.join(side("first"), "first", "left").join(side("last"), "last", "left")
    yes, no = (F.greatest(*(F.coalesce(f"{k}_{c}", F.lit(0)) for c in ("first", "last"))) for k in ("yes", "no"))
    silent = (F.col("kind") == name) & (F.col("votes").bitwiseAND(3 << _GAZETTEER) == 0)
    vote = F.when(silent & (yes >= enough), 1 << _GAZETTEER).when(silent & (yes == 0) & (no >= enough), 2 << _GAZETTEER).otherwise(0)
    return both.withColumn("votes", F.col("votes") + vote).select("doc_id", "kind", "start", "stop", "votes", "found")


def _votes(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes >> 2 * i & 3 for i in range(len(LABELERS))], axis=1)


def _silent(x: np.ndarray) -> np.ndarray:
    """Whether no labeler votes for it but the one of what follows, which alone says little."""
    return (np.delete(x, LABELERS.index("after"), axis=1) != 1).all(axis=1)


def _agree(x: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation: how likely each pattern of votes is a detail, from how often each occurs."""
    weight = np.array([[1, 1.5, 0.5, 0, 0.5, 1], [1, 1, 1, 3, 1, 1]])
    p = 1 / (1 + np.exp(-2 * ((x == 1) @ weight[0] - (x == 2) @ weight[1] - 1)))  # start: weighted majority
    x = np.column_stack([x, np.where(_silent(x), 2, 1)])  # silence is a vote against
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        like = np.stack([np.full(len(n), np.log(1 - prior)), np.full(len(n), np.log(prior))])
        for j in range(x.shape[1]):  # a labeler that doesn't vote says nothing
            for side, w in ((0, n * (1 - p)), (1, n * p)):
                table = np.array([w[x[:, j] == v].sum() for v in (1, 2)]) + np.array([[0.5, 1.5], [1.9, 0.1]])[side] * (1 + 0.02 * n.sum())
                like[side] += np.append(0, np.log(table / table.sum()))[x[:, j]]
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
    return p


def _fit(x: np.ndarray, n: np.ndarray, p: np.ndarray):
    """A logistic classifier on the votes for soft labels, a little shrunk; silence of all is a feature of its own."""
    features = lambda x: np.column_stack([np.ones(len(x)), x == 1, x == 2, _silent(x)]).astype(float)
    f, w, weight = features(x), np.zeros(2 * x.shape[1] + 2), n / n.sum()
    for _ in range(400):
        q = 1 / (1 + np.exp(-f @ w))
        h = (f * (weight * q * (1 - q))[:, None]).T @ f + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, f.T @ (weight * (p - q)) - 1e-4 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return lambda x: 1 / (1 + np.exp(-features(x) @ w))


def estimate(patterns: list[tuple[int, int, int]], rounds: int = 50) -> dict[tuple[int, int], float]:
    """The chance of each (kind, votes) from (kind, votes, count)."""
    out: dict[tuple[int, int], float] = {}
    for kind in {k for k, _, _ in patterns}:
        votes = np.array([v for k, v, _ in patterns if k == kind])
        n = np.array([c for k, _, c in patterns if k == kind], float)
        x = _votes(votes)
        chance = _fit(x, n, _agree(x, n, rounds))(x)
        out |= {(kind, v): q for v, q in zip(votes.tolist(), chance.tolist(), strict=True)}
    return out


def held_out(patterns: list[tuple[int, int, int, bool]], least: float = 0.5, rounds: int = 50) -> dict[int, float]:
    """By kind, the share of held-out candidates on which a classifier fitted without them decides as the votes of all do."""
    whole = {}
    for k, v, c, _ in patterns:
        whole[k, v] = whole.get((k, v), 0) + c
    out = {}
    for kind in {k for k, _ in whole}:
        votes = np.array([v for k, v in whole if k == kind])
        agreed = dict(zip(votes.tolist(), _agree(_votes(votes), np.array([whole[kind, v] for v in votes.tolist()], float), rounds), strict=True))
        seen, kept = ([(v, c) for k, v, c, h in patterns if k == kind and h == side] for side in (False, True))
        if seen and kept:
            x, n = _votes(np.array([v for v, _ in seen])), np.array([c for _, c in seen], float)
            right = (_fit(x, n, _agree(x, n, rounds))(_votes(np.array([v for v, _ in kept]))) >= least) == (np.array([agreed[v] for v, _ in kept]) >= least)
            out[kind] = float(np.average(right, weights=[c for _, c in kept]))
    return out


def _voted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    spans = cut(rows.mapInArrow(_extract, "doc_id bigint, kind int, start int, stop int, votes int, first string, last string, found string"), "details")
    return gazetteer_votes(spans)


def _named(kind: str = "kind"):
    return F.element_at(F.array(*map(F.lit, KINDS)), F.col(kind) + 1)


def details(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, kind, start, stop, found) of every personal detail; start and stop are character offsets, found is its core.

    Null texts and ids give nothing; other columns are ignored; a document delivered twice gives its details twice.
    """
    voted = _voted(df, id_col, text_col)
    patterns = voted.groupBy("kind", "votes").count().collect()  # at most kinds * 3 ** labelers rows
    chance = estimate([(r["kind"], r["votes"], r["count"]) for r in patterns])
    good = [(k << 16 | v) for (k, v), q in chance.items() if q >= least]
    kept = voted.filter((F.col("kind") * 65536 + F.col("votes")).isin(good)) if good else voted.filter("false")
    return kept.select("doc_id", _named().alias("kind"), "start", "stop", "found")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(kind, candidates, accepted, rejected, held_out_agreement): what the classifier made of the candidates of each kind.

    The last is the share of candidates in a fifth of the documents, by hash, that a classifier fitted on the others decides
    as the votes of all documents do; null where there are none.
    """
    voted = _voted(df, id_col, text_col)
    patterns = [tuple(r) for r in voted.groupBy("kind", "votes", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")).count().select("kind", "votes", "count", "held").collect()]
    whole = {}
    for k, v, c, _ in patterns:
        whole[k, v] = whole.get((k, v), 0) + c
    chance = estimate([(k, v, c) for (k, v), c in whole.items()])
    agree = held_out(patterns, least)
    rows = []
    for kind in sorted({k for k, _ in whole}):
        every = sum(c for (k, _), c in whole.items() if k == kind)
        good = sum(c for (k, v), c in whole.items() if k == kind and chance[k, v] >= least)
        rows.append((KINDS[kind], every, good, every - good, agree.get(kind)))
    return df.sparkSession.createDataFrame(rows, "kind string, candidates bigint, accepted bigint, rejected bigint, held_out_agreement double")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            if text is not None and spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = s["stop"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "redacted"])


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, redacted): every text with a typed placeholder in place of each detail and all else unchanged; null stays null."""
    spans = details(df, id_col, text_col).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("spans"))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_redact, "doc_id bigint, redacted string")

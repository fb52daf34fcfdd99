"""Sentence boundaries across languages and scripts.

A text is a sequence of lines. Line breaks are settled first: blank lines, list entries, headings and
chat messages end a unit, breaks inside a sentence don't. Inside the joined lines, every terminator is
a node of a lattice with a splitting and a joining arc. What stands on both sides (abbreviations,
initials, decimals, ordinals, the case of what follows, quotations and brackets) scores the arcs, units
without a whole word cost, and the best path decides. Scripts without spaces between words have other gaps:
their marks split wherever they stand, and a space is a gap. The runs on both sides of it are
segmented by the best path through a dictionary word lattice, whose words are common ones of each
script and those that all of the texts suggest; the final particle before the gap and the
opening word after it, weighed by how often they stand at the ends of lines, and the number of words
on both sides decide.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

# Words and marks of the languages covered.
#: Abbreviations that stand before what they belong to; no sentence ends with them.
TITLES = set(
    "sen rep gov pres maj cmdr adm cpl messrs dir med phil jur rer nat hab univ resp ex ej гр dr mr mrs ms prof insp lt capt sgt col gen rev hon st mt fr hr ing dipl sr sra srta dra mme mlle m no nr nos fig figs sec secs abs art arts approx ca aprox "
    "pág págs pag pp p vs cf eq vol ch est yr jh bd bzgl tel ext al núm стр гл рис см κα σελ κεφ αρ οδ".replace(".", "").split()
)
#: Those of them that are words, too, unless a number follows.
NUMBERED = set("no art sec fig vol abs p pp arts".split())
MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun".split())
#: Abbreviations with inner periods, without their last one.
DOTTED = set("i.e e.g z.b d.h u.a u.ä o.ä i.d.r p.ej p.ex c.-à-d c.à.d n.b т.е т.к т.д т.п и.о π.χ δηλ κ.λπ कि.ग्रा कि.मी डॉ w.r.t v.a s.o".split())
#: Abbreviations that may end a sentence: what follows decides.
EITHER = set("etc usw uvm bzw co ltd inc corp jr a.m p.m am pm u.s u.k т.д т.п др κ.λπ κ.τ.λ kg min std".split())
#: German words before an ordinal number, after which a period is not the end.
ORDINAL_BEFORE = set("am der die das den dem des vom zum zur im bis beim seit ab jeder jedem jeden".split())
#: Words that carry on after a quotation: said-words and particles that attach to it.
ATTACHED = ("と", "って", "라고", "이라고", "하고", "고", "란", "という", "とい")
#: Common words of scripts without spaces, for the word lattice: what opens a sentence, what joins,
#: what closes, what never closes, and others.
OPENERS = (
    "เขา เธอ เรา ผม ฉัน คุณ พวกเขา พวกเรา มัน ท่าน นี่ นั่น วันนี้ เมื่อวาน พรุ่งนี้ ตอนนี้ เมื่อ หลังจาก ก่อน หาก ถ้า ทำไม ใคร อะไร อย่างไร ทุก ตั้งแต่ ตาม น่า "
    "ຂ້ອຍ ເຈົ້າ ລາວ ພວກເຮົາ ມື້ນີ້ ມື້ວານ ຖ້າ ເມື່ອ ໃຜ ຫຍັງ ខ្ញុំ គាត់ នាង យើង អ្នក ថ្ងៃនេះ ម្សិលមិញ បើ នៅពេល នរណា ကျွန်တော် သူ သူတို့ ယနေ့ မနေ့က အကယ်၍"
).split()
JOINERS = "และ หรือ แต่ เพราะ จึง ซึ่ง โดย ว่า กับ ของ เป็น คือ ได้แก่ เช่น รวม ถึง จาก ให้ ต่อ จน ແລະ ຫຼື ແຕ່ ເພາະ ວ່າ ກັບ ຂອງ និង ឬ ប៉ុន្តែ ព្រោះ ថា ជា របស់ နှင့် သို့မဟုတ် သို့သော်".split()
FINALS = "แล้ว เท่านั้น ครับ ค่ะ คะ นะ จ้ะ ไหม หรือไม่ หรือเปล่า เลย ด้วย เสร็จ ແລ້ວ ເດີ້ ບໍ່ ບໍ ເນາະ ហើយ ទេ ណា တယ် ပါ သည် မလား です ます でした ました ません だ ね よ か 了 吗 呢 吧 啊".split()
HANGING = "ของ ที่ และ หรือ แต่ ใน เป็น คือ ว่า กับ จาก โดย เพราะ ซึ่ง ถึง ให้ ແລະ ຫຼື ຂອງ ໃນ និង ឬ របស់ ក្នុង は が を に で と の も 的 和 在 与".split()
COMMON = (
    "ที่ ใน มี ไม่ ได้ จะ ไป มา ทำ งาน คน บ้าน น้ำ วัน ปี เวลา ใหม่ ดี มาก น้อย เล็ก ใหญ่ ซื้อ ขาย กิน ดู อ่าน เขียน พูด บอก รู้ คิด เห็น ใช้ ต้อง ควร อยาก ชอบ รัก เด็ก ครู โรงเรียน ตลาด หนังสือ รถ ถนน เมือง ประเทศ การ ความ ผู้ ทีม กลุ่ม ผล คะแนน นาที ชั่วโมง เริ่ม จบ กลับ เปิด ปิด ส้ม กล้วย แอปเปิล ข้าว ปลา หมู ไก่ แมว หมา ฝน แดด "
    "ຄົນ ບ້ານ ນ້ຳ ວັນ ປີ ໄປ ມາ ກິນ ເຮັດ ວຽກ ດີ ຫຼາຍ ໃຫຍ່ ນ້ອຍ ຕະຫຼາດ មនុស្ស ផ្ទះ ទឹក ថ្ងៃ ឆ្នាំ ទៅ មក ស៊ី ធ្វើ ការ ល្អ ធំ តូច ផ្សារ လူ အိမ် ရေ နေ့ နှစ် သွား လာ စား လုပ် ကောင်း ကြီး ငယ် "
    "我们 他们 今天 明天 昨天 工作 时间 没有 可以 因为 所以 学校 市场 水果 私 彼 今日 明日 昨日 仕事 時間 学校 市場 それ これ ここ"
).split()
#: A learned word stands in the texts as often as once in so many runs (or lines), and four times; the
#: longest learned word. All texts are counted: this bounds the lexicon, not what it is learned from.
LEARNED_IN, LONGEST_WORD = 5_000, 12
#: Strings that mark the end of a document in corpora; units of their own.
MARKERS = ("<|endoftext|>", "Endoftext", "</s>", "<eos>")

OPEN, CLOSE = "([{（［｛「『〈《【", ")]}）］｝」』〉》】"
PAIRS = dict(zip(CLOSE, OPEN, strict=True))
CLOSING = "\"'”’“»›«)]}）］｝」』〉》】*_`"

_blank = re.compile(r"(?>\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])(?:[^\S\n\r]*(?>\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]))+")
_break = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_item = re.compile(r"\s*(?:[-*•–—+◦▪‣·]\s+|\(?\d{1,4}[.)]\s+|\(?[a-zA-Z]\)\s+|#{1,6}\s+)\S")
_clock = re.compile(r"\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\d{1,2}:\d{2}(?::\d{2})?\s+[-–|<]|<[\w.-]+>\s)")
_stamp = re.compile(r"(?m)^\s*\[\d{1,2}:\d{2}(?::\d{2})?\]")
_chat = re.compile(r"(?im)^\s*(?:lol\b|lmao\b|ok(?:ay)?\b|hey\b|hi\b|no idea\b|did anyone\b|who moved\b|check the\b|pls\b|thx\b|brb\b|anyone\b)")
_mark = re.compile(r"[.!?…。！？｡؟۔।॥;‽។៕။]+[\"'”’»›)\]}）］｝」』〉》】*_`]*")
_space_closers = re.compile(r"[   ]+[»”](?=\s|$)")
_thai = re.compile(r"[฀-໿ក-៿က-႟]")
_gap = re.compile(r"[^\S\n\r]+")
_structure = re.compile(r"[\"“”„«»()\[\]{}（）［］｛｝「」『』〈〉《》【】]")
#: An opening angle that nothing closes, before a capital: a broken-off unit ends with it.
_dangling = re.compile(r"(?<=\s)<(?=\s+[^\W\d_a-z])")
_spaceless = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\u300a-\u3010]")
_before_token = frozenset("([{«„“\"'¿¡（「『")


class Quotes:
    """Whether a quotation is open, kept up to date along a text; every character is read once."""

    _marks = re.compile("[\"«»„“”「」]")

    def __init__(self, text: str):
        self.text = text
        self.restart(0)

    def restart(self, at: int) -> None:
        self.at, self.n = at, dict.fromkeys('"«»„“”「」', 0)

    def open(self, upto: int) -> bool:
        for m in self._marks.finditer(self.text, self.at, upto):
            self.n[m.group()] += 1
        self.at = max(self.at, upto)
        n = self.n
        return n['"'] % 2 == 1 or n["«"] > n["»"] or n["„"] > n["“"] + n["”"] or (not n["„"] and n["“"] > n["”"]) or n["「"] > n["」"]


def line_spans(text: str) -> list[tuple[int, int]]:
    """Spans of units as far as line breaks settle them: joined lines of one paragraph, or single
    headings, list entries and messages."""
    spans: list[tuple[int, int]] = []
    quotes = Quotes(text)
    at = 0
    blocks = []
    for m in _blank.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for start, end in blocks:
        breaks = list(_break.finditer(text, start, end))
        if not breaks:
            spans.append((start, end))
            continue
        lines = []
        s = start
        for m in breaks:
            lines.append((s, m.start()))
            s = m.end()
        lines.append((s, end))
        chat = _stamp.search(text, start, end) is not None or _chat.search(text, start, end) is not None
        first, last = lines[0]
        own = first  # where the last line of the unit begins
        quotes.restart(first)
        for s, e in lines[1:]:
            if splits(text, first, own, last, s, e, chat, quotes):
                spans.append((first, last))
                first = s
                quotes.restart(first)
            own, last = s, e
        spans.append((first, last))
    return spans


def splits(text: str, first: int, own_start: int, last: int, s: int, e: int, chat: bool, quotes: Quotes) -> bool:
    """Whether the break between the lines text[own_start:last] and text[s:e] ends the unit that
    began at ``first``. Only the two lines are looked at, and what the quotations before add up to."""
    own, line = text[own_start:last].rstrip(), text[s:e].strip()
    if not own or not line:
        return True
    end = own_start + len(own)
    single = own_start == first
    own = own.lstrip()
    if _item.match(line) or _clock.match(line) or _item.match(own) or _clock.match(own) or own in MARKERS or line in MARKERS:
        return True
    if chat and not (own[-1] in ",;" or len(own) < 2):
        # messages end with their line; sentences wrapped inside a message begin anew in lower case
        return True
    core = own.rstrip(CLOSING + " ")
    if core and core[-1] in ".!?…。！？｡؟۔।॥។៕။":
        if quotes.open(end):
            return False
        if core[-1] == "." and len(core) == len(own):
            if line[0].islower():
                token = core[:-1].split()[-1:] or [""]
                return token[0].lower().strip("(") not in EITHER and stops(text, end - 1, "X", line) > 0
            return stops(text, end - 1, line[0], line) > 0
        return not line[0].islower() or core[-1] in "!?"
    if core and core[-1] == ";" and "Ͱ" <= core[-2:-1] <= "Ͽ":
        return True
    if _thai.search(own[-1]):
        return True
    if _thai.search(line[0]) and not quotes.open(end):
        return own[-1].isdigit()
    if single and len(own) <= 40 and line[0].isupper() and own[-1] not in ",-–:" and heading(own):
        return True
    return False


def heading(line: str) -> bool:
    """A short line that names what follows."""
    words = line.split()
    return len(words) <= 7 and not words[-1].islower() and words[0][:1].isupper() and bool(re.match(r"(?:Notes?|Summary|Results?|Scope|Remarks?|Notas?|Resultados?|Resumen|Remarques?|Résultats?|Notizen|Ergebnisse?|Hinweise?|Zusammenfassung|Who|What|How|Where)\b", line))


def enclosed(text: str, broken: bool) -> list[tuple[int, int]]:
    """Spans (opening, closing) of the outermost quotations and brackets of a paragraph. An opening
    mark without a closing one counts up to the end only where the text breaks off."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    n = len(text)

    def close(kind: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == kind:
                start = stack[k][1]
                del stack[k:]
                spans.append((start, at))
                return True
        return False

    for m in _structure.finditer(text):
        at, c = m.start(), m.group()
        if c == '"':
            if close('"', at):
                continue
            if at + 1 < n and not text[at + 1].isspace() and (at == 0 or not text[at - 1].isalnum()):
                stack.append(('"', at))
        elif c in "“”":
            if not (close("„", at) or close("“", at)) and c == "“":
                stack.append(("“", at))
        elif c == "„":
            stack.append(("„", at))
        elif c == "«":
            if not close("»", at):
                stack.append(("«", at))
        elif c == "»":
            if not close("«", at) and at + 1 < n and not text[at + 1].isspace():
                stack.append(("»", at))
        elif c in OPEN:
            stack.append((c, at))
        else:
            close(PAIRS[c], at)
    if broken and stack:
        spans.append((stack[0][1], n))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s, e in spans:
        if not outer or s > outer[-1][1]:
            outer.append((s, e))
    return outer


#: Scores of the splitting arc against the joining one: settled, and likely.
SURE, LIKELY = 8.0, 1.5


def token_before(text: str, at: int) -> str:
    """What stands directly before text[at], back to white space or an opening mark."""
    b = at
    while b > 0 and not text[b - 1].isspace() and text[b - 1] not in _before_token:
        b -= 1
    return text[b:at]


def stops(text: str, at: int, follows: str, rest: str) -> float:
    """Score of a sentence's end at a single period text[at], given the first character of the rest
    and the rest's beginning."""
    if follows.islower():
        return -SURE
    raw = token_before(text, at)
    token = raw.rstrip(".").lower()
    bare = token.strip("'’-–,")
    if bare in ("co", "&co"):
        return -SURE if rest.startswith(("Ltd", "Inc", "KG", "Corp", "LLC", "oHG")) else SURE
    if bare in EITHER:
        return LIKELY
    if bare in MONTHS and raw[:1].isupper():
        return -SURE if follows.isdigit() else LIKELY
    if bare in NUMBERED and not (follows.isdigit() or (follows.isupper() and not rest[1:2].isalpha())):
        return LIKELY if raw[:1].islower() and len(bare) > 1 else -SURE
    if bare in TITLES or bare in DOTTED or (token and token.split("'")[-1].split("’")[-1] in TITLES):
        return -SURE
    b = at - len(raw)
    while b > 0 and text[b - 1].isspace():
        b -= 1
    if bare in ("h", "г") and text[b - 1 : b].isdigit():
        return SURE
    if len(bare) == 1 and bare.isalpha():
        # initials, and letters in ciphers of people and rules
        return -SURE
    if "." in bare and all(len(p) == 1 for p in bare.split(".")) and not bare.replace(".", "").isdigit():
        return -SURE
    if bare.isdigit() and len(bare) <= 3:
        head = token_before(text, b)
        if head and head.lower() in ORDINAL_BEFORE and follows.isupper():
            return -SURE
        if not head and at == len(bare):
            return -SURE
    if "ऀ" <= text[at - 1 : at] <= "ॿ":
        return -SURE
    return SURE


def best_path(nodes: list[tuple[int, float]], text: str) -> list[int]:
    """Ends on the best path through a lattice of terminators (end, score of the splitting arc).

    A unit between two likely ends without a word of two letters costs twice LIKELY. Only likely
    nodes can gain by that, so the path is found in one pass: the state is the last end taken."""
    out: list[int] = []
    i, n = 0, len(nodes)
    while i < n:
        end, score = nodes[i]
        if abs(score) >= SURE:
            if score > 0:
                out.append(end)
            i += 1
            continue
        # a stretch of likely nodes up to the next settled end
        j = i
        while j < n and nodes[j][1] < SURE:
            j += 1
        stretch = [x for x in nodes[i:j] if x[1] > -SURE]
        stop = nodes[j][0] if j < n else len(text)
        best: dict[int, tuple[float, tuple | None]] = {out[-1] if out else 0: (0.0, None)}
        for e, sc in stretch:
            value, back = max(((v + sc - (2 * LIKELY if not _whole_word.search(text, st, e) else 0.0), (e, b)) for st, (v, b) in best.items()), key=lambda x: x[0])
            best[e] = (value, back)
            # an earlier end with no less score is never worse: what is left rises, within one short unit's cost
            kept, top = {}, -math.inf
            for st in sorted(best):
                if best[st][0] > top:
                    kept[st], top = best[st], best[st][0]
            best = {st: v for st, v in kept.items() if v[0] > top - 2 * LIKELY}
        final = max(((v - (2 * LIKELY if not _whole_word.search(text, st, stop) else 0.0)), st, back) for st, (v, back) in best.items())
        chain, back = [], best[final[1]][1]
        while back:
            chain.append(back[0])
            back = back[1]
        out.extend(reversed(chain))
        i = j
    return out


_whole_word = re.compile(r"[^\W\d_][^\W\d_]")


def pieces(text: str, broken: bool, lexicon: Lexicon | None = None) -> list[int]:
    """Ends of sentences inside joined lines, the last one included. Linear in the text."""
    n = len(text)
    nodes: list[tuple[int, float]] = []
    marks = list(_mark.finditer(text))
    inside = enclosed(text, broken) if _structure.search(text) else []
    k = 0
    begin = 0
    for m in marks:
        at, end = m.start(), m.end()
        while k < len(inside) and inside[k][1] < at:
            k += 1
        closes = -1
        if k < len(inside) and inside[k][0] < at:
            s, e = inside[k]
            if e == end and text[e] in "“«":
                end += 1  # closes a quotation that began with the other mark
                closes = s
            elif e >= end:
                tail = _space_closers.match(text, end)
                if tail and tail.end() - 1 == e:
                    end = tail.end()
                    closes = s
                else:
                    continue
            else:
                closes = s
        mark = m.group()
        kind = mark[0]
        if end >= n:
            continue
        j = end
        while j < n and text[j].isspace():
            j += 1
        if j >= n:
            continue
        follows = text[j]
        spaced = j > end
        score = SURE
        if closes >= 0:
            while begin < closes and text[begin].isspace():
                begin += 1
        if kind in "。！？｡؟۔।॥។៕။":
            if closes >= 0 and (begin >= closes or text.startswith(ATTACHED, j)):
                continue
            if kind in "！？" and follows in "，、,":
                continue
        elif kind == ";":
            if not ("Ͱ" <= text[at - 1 : at] <= "Ͽ") or not spaced:
                continue
        else:
            if not spaced and _spaceless.match(follows):
                # a script without spaces begins right after the mark
                if at < 1 or not (text[at - 1].isalnum() or text[at - 1] in CLOSING + " "):
                    continue
            elif not spaced:
                # sentences without a space between them: a word before, a capital or mark behind
                if not (follows.isupper() or follows in "¿¡„«“") or at < 2 or not text[at - 1].isalnum():
                    continue
                nxt = text[j + 1 : j + 2]
                if follows.isupper() and not (nxt.islower() or nxt == " "):
                    continue
                if kind == "." and (len(mark) > 1 or not (text[at - 1].isdigit() or (text[at - 1].isalpha() and text[at - 2 : at - 1].isalpha()))):
                    continue
                if _filename.search(token_before(text, at)):
                    continue
            if closes >= 0:
                if begin >= closes and follows not in "\"“„«¿¡" and text[closes] not in "([{（":
                    # a quotation that begins the sentence and is carried on
                    if follows.islower() or text[closes] in "\"“„«»「":
                        continue
                if follows.islower() or text.startswith(ATTACHED, j):
                    continue
            if kind == "." and mark.startswith("...") or kind == "…" or mark.startswith(".."):
                if follows.islower():
                    continue
            elif kind == ".":
                score = stops(text, at, follows, text[j : j + 20])
                if score <= -SURE:
                    continue
            elif follows.islower():
                continue
        if follows in ",;:)]" and not spaced:
            continue
        nodes.append((end, score))
        begin = end
    ends = best_path(nodes, text)
    ends.append(n)
    extra: set[int] = set()
    if _gapped.search(text):
        extra.update(gaps(text, inside, lexicon or _plain))
    for m in _dangling.finditer(text):
        extra.add(m.end())
    for m in _marker.finditer(text):
        if m.end() >= n or text[m.end()].isspace():
            extra.update(e for e in (m.start(), m.end()) if e > 0)
    return sorted(extra.union(ends)) if extra else ends


_filename = re.compile(r"[\w/]\.\w+$|_\w*$|//")
_marker = re.compile("|".join(re.escape(x) for x in MARKERS))
#: A space beside a script without spaces, where no mark decides.
_gapped = re.compile(r"[฀-໿ក-៿က-႟]|[\u3040-\u30ff\u3400-\u9fff][ \t]+[\u3040-\u30ff\u3400-\u9fff]")
_hanzi = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_run = re.compile(r"[฀-໿ក-៿က-႟\u3040-\u30ff\u3400-\u9fff]+|[^\W\d_]+|\d[\d.,]*")


class Lexicon:
    """A dictionary word lattice over runs without spaces: words with costs (negative logarithms of
    their frequencies), and how much a word at a gap speaks for a boundary."""

    def __init__(self, counts: dict[str, float] | None = None, opening: dict[str, float] | None = None, closing: dict[str, float] | None = None):
        self.counts, self.opening, self.closing = counts or {}, opening or {}, closing or {}
        self._automaton = None

    def __getstate__(self):
        return self.counts, self.opening, self.closing

    def __setstate__(self, state):
        self.__init__(*state)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            words = dict.fromkeys((*OPENERS, *JOINERS, *FINALS, *HANGING, *COMMON), 20.0)
            for w, c in self.counts.items():
                words[w] = max(words.get(w, 0.0), c)
            total = sum(words.values())
            automaton = ahocorasick.Automaton()
            for w, c in words.items():
                automaton.add_word(w, (len(w), -math.log(c / total)))
            automaton.make_automaton()
            self._automaton = automaton
            self._unknown = 1.5 * math.log(total + 1)
        return self._automaton

    def segment(self, run: str) -> list[str]:
        """The words on the cheapest path through the run's lattice; what no word covers is joined
        to unknown words. Linear in the run for words of bounded length."""
        automaton = self.automaton()
        n = len(run)
        best = [0.0] + [math.inf] * n
        back = [0] * (n + 1)
        known = [False] * (n + 1)
        arcs: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (size, cost) in automaton.iter(run):
            arcs[last].append((size, cost))
        for e in range(1, n + 1):
            best[e], back[e] = best[e - 1] + self._unknown, e - 1
            # a word can't end before a mark that hangs on its last letter
            if e == n or not _hangs(run[e]):
                for size, cost in arcs[e - 1]:
                    if best[e - size] + cost < best[e]:
                        best[e], back[e], known[e] = best[e - size] + cost, e - size, True
        out: list[str] = []
        e, upto = n, n
        while e > 0:
            if known[e]:
                if upto > e:
                    out.append(run[e:upto])
                out.append(run[back[e] : e])
                upto = back[e]
            e = back[e]
        if upto > 0:
            out.append(run[:upto])
        return out[::-1]


def _hangs(c: str) -> bool:
    return unicodedata.category(c) in ("Mn", "Mc") or c in "ะาำๅๆຯະາຳ"


_plain = Lexicon()
_class = {**dict.fromkeys(OPENERS, 2.5), **dict.fromkeys(JOINERS, -4.0)}
_close = {**dict.fromkeys(FINALS, 2.5), **dict.fromkeys(HANGING, -4.0)}


def _words_of(part: str, lexicon: Lexicon) -> list[str]:
    """Words of a stretch between spaces: of runs without spaces by the lattice, numbers as 0."""
    out: list[str] = []
    for m in _run.finditer(part):
        w = m.group()
        if w[0].isdigit():
            out.append("0")
        elif _spaceless.match(w[0]) or _thai.match(w[0]):
            out.extend(lexicon.segment(w))
        else:
            out.append("A")
    return out


#: Score of a space in a script without spaces, before its neighbours are looked at, and of a side
#: that has fewer words than a clause.
GAP, FEW, CLAUSE = -1.0, -1.5, 3
#: Words on both sides from which they are clauses of their own, and their score.
LONG, APART = 5, 1.5


def _size(words: list[str]) -> int:
    """How many words; what no word covers counts by its length."""
    return sum(max(1, len(w) // 5) for w in words)


def gaps(text: str, inside: list[tuple[int, int]], lexicon: Lexicon) -> list[int]:
    """Spaces beside scripts without spaces that end a sentence."""
    ends = []
    found = [m for m in _gap.finditer(text) if m.start() > 0 and m.end() < len(text)]
    k = 0
    words: dict[int, list[str]] = {}

    def part(start: int, end: int) -> list[str]:
        got = words.get(start)
        if got is None:
            got = words[start] = _words_of(text[start:end], lexicon)
        return got

    for i, m in enumerate(found):
        left, right = text[m.start() - 1], text[m.end()]
        a, b = _thai.match(left), _thai.match(right)
        han = _hanzi.match(left) and _hanzi.match(right)
        if not (a or b or han):
            continue
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if k < len(inside) and inside[k][0] < m.start():
            continue
        lw = part(found[i - 1].end() if i else 0, m.start())
        rw = part(m.end(), found[i + 1].start() if i + 1 < len(found) else len(text))
        if not lw or not rw:
            continue
        opens = lexicon.opening.get(rw[0], _class.get(rw[0], 0.0))
        closes = lexicon.closing.get(lw[-1], _close.get(lw[-1], 0.0))
        a_size, b_size = _size(lw), _size(rw)
        score = GAP + opens + closes + (FEW if a_size < CLAUSE else 0.0) + (FEW if b_size < CLAUSE else 0.0) + (APART if min(a_size, b_size) >= LONG else 0.0)
        if han:
            if closes > 0 and score > 0:
                ends.append(m.start())
        elif b:
            # after Latin letters a space may only set off a name
            if score > 0 and (a or left.isdigit() or opens > 0 or closes > 0):
                ends.append(m.start())
        elif closes > 0 and (right.isupper() or right in "\"“¿¡[(" or right.isdigit()):
            ends.append(m.start())
        elif right.isupper():
            # Latin text after the script: a sentence of its own, not a name
            stretch = text[m.end() : found[i + 2].start() if i + 2 < len(found) else len(text)]
            if " " in stretch and not _thai.search(stretch):
                ends.append(m.start())
    return ends


def stretches(texts: list[str | None]) -> dict[str, list[int]]:
    """What stands between spaces in lines with scripts without spaces: [times, at a line's beginning, at its end]."""
    out: dict[str, list[int]] = {}
    for text in texts:
        for line in _break.split(text or ""):
            if not _thai.search(line):
                continue
            parts = [p for p in _gap.split(line.strip()) if p]
            for i, p in enumerate(parts):
                one = out.setdefault(p, [0, 0, 0])
                one[0] += 1
                one[1] += i == 0
                one[2] += i == len(parts) - 1
    return out


def runs_of(parts) -> set[str]:
    return {r for p in parts for r in _run.findall(p) if _thai.match(r[0])}


def substrings(run: str) -> Iterator[str]:
    """The substrings of a run that a word could be, up to LONGEST_WORD."""
    starts = [i for i, c in enumerate(run) if not _hangs(c)] + [len(run)]
    for i, a in enumerate(starts):
        for k in range(i + 1, len(starts)):
            b = starts[k]
            if b - a > LONGEST_WORD:
                break
            if b - a > 1:
                yield run[a:b]


def places(parts: list[tuple[str, int, int, int]], lexicon: Lexicon) -> dict[str, list[int]]:
    """Words of stretches: [times, at a line's beginning, at its end]."""
    out: dict[str, list[int]] = {}
    for p, n, starts, ends in parts:
        words = _words_of(p, lexicon)
        for w in words:
            out.setdefault(w, [0, 0, 0])[0] += n
        if words:
            out[words[0]][1] += starts
            out[words[-1]][2] += ends
    return out


def _least(n: int, times: int) -> float:
    return max(float(times), n * times / 4 / LEARNED_IN)


def weighed(kept: dict[str, float], found: list[tuple[str, int, int, int]], n: int, n_first: int, n_last: int) -> Lexicon:
    """The lexicon of words and of where they stand, from (word, times, beginnings, ends) and their totals."""

    def weigh(at: int, total: int, known: dict[str, float]) -> dict[str, float]:
        out = {}
        for r in sorted(found):
            if r[at] >= _least(total, 4) and known.get(r[0], 0.0) >= 0:
                out[r[0]] = max(known.get(r[0], 0.0), min(3.0, math.log((r[at] + 0.5) / (total + 1)) - math.log((r[1] + 0.5) / (n + 1))))
        return out

    return Lexicon(kept, weigh(2, n_first, _class), weigh(3, n_last, _close))


def _kept(counts, n: int, times: int) -> dict[str, float]:
    return {w: float(c) for w, c in sorted(counts) if c >= _least(n, times) and len(w) > 1}


def learn(texts: list[str]) -> Lexicon:
    """A lexicon from texts: substrings of runs that pay as words, and the words that stand at the
    beginnings and ends of lines more often than elsewhere. The same as lexicon_of(), in one process."""
    parts = stretches(texts)
    runs = runs_of(parts)
    kept = _kept(Counter(w for run in runs for w in substrings(run)).items(), len(runs), 4)
    for _ in range(2):
        lexicon = Lexicon(kept)
        kept = _kept(Counter(w for run in runs for w in lexicon.segment(run)).items(), len(runs), 3)
    found = [(w, *c) for w, c in places([(p, *c) for p, c in parts.items()], Lexicon(kept)).items()]
    return weighed(kept, found, *(sum(r[i] for r in found) for i in (1, 2, 3)))


def sentences(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit, in code points, without white space at the ends."""
    if not text or text.isspace():
        return []
    out = []
    spans = line_spans(text)
    final = len(spans) - 1
    items = [_item.match(text, s, e) is not None for s, e in spans]
    for i, (s, e) in enumerate(spans):
        part = text[s:e]
        stripped = part.strip()
        if not stripped:
            continue
        listed = items[i] and not (stripped[0] in "–—" and not (i and items[i - 1]) and not (i < final and items[i + 1]))
        if _clock.match(part) or (listed and not _break.search(stripped)):
            a = s + len(part) - len(part.lstrip())
            out.append((a, a + len(stripped)))
            continue
        broken = i == final and stripped[-1] not in ".!?…。！？؟।\"”»“"
        at = 0
        for end in pieces(part, broken, lexicon):
            piece = part[at:end]
            lead = len(piece) - len(piece.lstrip())
            size = len(piece.strip())
            if size:
                out.append((s + at + lead, s + at + lead + size))
            at = end
    return out


def sentence_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sentences(t, lexicon) for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) for x in found], dtype=np.int64)
            which = np.repeat(np.arange(batch.num_rows), counts)
            flat = np.array([p for x in found for p in x], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["id", "start_pos", "end_pos"])

    return run


def _counted(rows: DataFrame, count, names: str) -> DataFrame:
    """Sums, by word, of what ``count`` gives for batches of rows as {word: one or several numbers}; ``names`` of the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            columns = list(zip(*((w, *c) for w, c in got.items()), strict=True)) or [()] * (1 + len(of))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["word", *of])

    of = names.split()
    return rows.mapInArrow(run, "word string, " + ", ".join(f"{n} long" for n in of)).groupBy("word").agg(*(F.sum(n).alias(n) for n in of))


def _candidates(share: float):
    """Runs to those of their substrings that are frequent in some portion of them. What is as frequent
    as ``share`` in all runs is so in one portion at least, however they are portioned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, c in seen.items() if c >= share * n], pa.string())], names=["word"])

        for batch in batches:
            for r in batch.column(0).to_pylist():
                n += 1
                seen.update(substrings(r))
                if len(seen) > 1_000_000:
                    yield out()
                    seen, n = Counter(), 0
        yield out()

    return run


def lexicon_of(df: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon of a table, learned from all texts in scripts without spaces or marks, whatever
    their length. Every step counts in the workers; only words as frequent as LEARNED_IN asks are collected."""
    ship(df.sparkSession)
    rows = df.select(df[text].cast("string").alias("t")).filter(F.col("t").rlike("[\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f]"))
    parts = cut(_counted(rows, lambda got: stretches([r[0] for r in got]), "n starts ends"))
    runs = cut(_counted(parts.select("word"), lambda got: dict.fromkeys(runs_of(r[0] for r in got), (1,)), "n").select("word"))
    n = runs.count()
    if not n:
        return Lexicon()
    words = {r.word for r in runs.mapInArrow(_candidates(_least(n, 4) / n), "word string").distinct().collect()}
    shared = df.sparkSession.sparkContext.broadcast(words)
    within = lambda got: {w: (c,) for w, c in Counter(w for r in got for w in substrings(r[0]) if w in shared.value).items()}
    kept = _kept(((r.word, r.n) for r in _counted(runs, within, "n").filter(F.col("n") >= _least(n, 4)).collect()), n, 4)
    shared.unpersist()
    for _ in range(2):
        lexicon = Lexicon(kept)
        segmented = lambda got, lexicon=lexicon: {w: (c,) for w, c in Counter(w for r in got for w in lexicon.segment(r[0])).items()}
        kept = _kept(((r.word, r.n) for r in _counted(runs, segmented, "n").filter(F.col("n") >= _least(n, 3)).collect()), n, 3)
    lexicon = Lexicon(kept)
    found = cut(_counted(parts, lambda got: places(got, lexicon), "n starts ends"))
    totals = found.agg(*(F.sum(c).alias(c) for c in ("n", "starts", "ends"))).first()
    least = [_least(totals[c], 4) for c in ("starts", "ends")]
    return weighed(kept, [tuple(r) for r in found.filter((F.col("starts") >= least[0]) | (F.col("ends") >= least[1])).collect()], *totals)


def split(df: DataFrame, key: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """(key, start_pos, end_pos): one row per sentence, counted from 0 in code points.

    Null and blank texts have none. Repeated rows give repeated sentences; null keys are kept.
    Only what the lexicon is learned from is shuffled, and every text is read whole, in time linear in its length; extra columns
    are not read. ``lexicon`` is a learned one; without it, one is learned from all texts.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("id"), df[text].cast("string").alias("t")).filter(F.col("t").isNotNull())
    return rows.mapInArrow(sentence_rows(lexicon or lexicon_of(df, text)), f"id {kind}, start_pos long, end_pos long").withColumnRenamed("id", key)

"""Weak labels of clauses, for training the field of ``pairs``.

Word lists and patterns that are often right; the field never sees them. Its own features are hashed
words, overlaps and shares, so it can differ from the labels wherever the words say otherwise.
"""

from __future__ import annotations

import re

from . import cutoff

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "void")

# Frequent words of languages that share the Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in was is that with by for from it who which did not but at on as an before after first has had its this an are have will would could our their they we you she if or than there when what all any can been were more also because into over only between",
    "de": "der die das und ist war nicht mit von für auf dem den ein eine es nach bei im ich aber sich wer welche zu um hat als lag unter an wie sind haben wird werden wir sie über oder wenn dass mehr noch war waren hatte sein seine",
    "fr": "le la les des est une dans pour qui pas du au aux et ne sur avec il elle même si ont été sans quel selon ce je de à l d était avait par plus cette se son sa leur mais ou y",
    "es": "el la los las del una que en por con fue es para no se al lo su aunque según quien más qué quién sin iba como pero de muy sus este esta entre cuando o ha era",
    "it": "il la le in del al lo gli della delle che una per con non stato nel alla dei ha un da di si sono dal chi quale senza secondo ma",
    "pt": "os as da do das dos que uma em para com não foi na no ao pelo por um mais quem sem segundo mas concluiu terminou foram de ou como mas ao era ela ele",
    "nl": "het een van de en niet met op te voor is dat was door zijn aan wie welke bij naar zonder om volgens maar ging want kwam",
}
#: Words that frame a question or an answer without saying anything.
FRAMES = set("question questions asked ask answer answered answering reply q a prompt user you the is that was one in sentence short following i read again repeat my your frage antwort gefragt question réponse demande pregunta respuesta preguntas preguntó la die est es ist sure ok okay well yes certainly right here please first".split())
#: Words a placeholder is made of.
PLACEHOLDERS = set("no answer answers content contents empty null none nil nan n a na todo tbd fixme response output text result results dry run blank missing undefined error failed pending placeholder lorem ipsum x unknown void available not given vacío leer vide keine antwort sin respuesta aucune réponse".split())

_failed = re.compile(r"^\W*(?:(?:error|err|failed|failure|exception)\b\W*(?:[\w:.-]+\W+)?)?(?:HTTP\s*\d{3}\b|[A-Z]\w*(?:Error|Exception|Timeout)\b)[^\n]*$")
#: A failed call's message at any length: a first line that is one, and further lines; or a trace.
_trace = re.compile(r"^\W*(?:traceback \(most recent call last\)|(?:(?:error|err|failed|failure|exception)\b\W*(?:[\w:.-]+\W+)?)?(?:HTTP\s*[45]\d\d\b|(?-i:(?:\w+\.)*[A-Z]\w*(?:Error|Exception|Timeout))(?=\s*[:(\n]|\s*$))|\[?(?:error|err|failed|exception)\]?\s*[:\]])", re.I)
_flagged = re.compile(r"^\W*\[?(?:error|err|failed|exception)\]?\s*[:\]][^\n]*$", re.I)
_markup = re.compile(r"<[^<>]*>|&[a-z]+;|```\w*|\[dry-run\]", re.I)
_found = re.compile(r"[^\W_]+").findall
#: Latin-1 with spaces for all but letters and digits.
_spaced = bytes(n if chr(n).isalnum() else 32 for n in range(256))
_visible = re.compile(r"[^\W_]")
_fifth = re.compile(r"(?:[\W_]*+[^\W_]++){5}")
#: A clause begins with any character; marks inside it are those that nothing but closing marks and white space doesn't follow.
_clause = re.compile(r"[^\n](?:[^\n.!?…。！？؟।]++|[.!?…]++(?![\"'”’»)\]*]*+(?:\s|$)))*+(?:[.!?…]++[\"'”’»)\]*]*+|[。！？؟।]++[”’»」』）]*+)?").findall
_quoted = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")
_code = re.compile(r"\b[A-Z]{1,3}-?\d[\w.-]*|\S*_\S*|\d[\w.,:-]*")
_code_plain = re.compile(r"\b[A-Z]{1,3}-?\d[\w.-]*|\d[\w.,:-]*")  # the same where there is no underscore
_digit = re.compile(r"\d")
_last_word = re.compile(r"[\w'’-]+\W*$")
_quote = re.compile("[\"“„«「]")
#: Words without which the patterns below can't match.
PERSONS = set("i me my myself us let we our ich mir mich mein meine meinen meiner meinem je j m mon moi mes yo mi mis puedo debo deseo prefiero quiero lamento siento posso preferisco ik mij mijn".split())
CLOSERS = set("please else know happy consult expert assist bitte frage question plaît vous pregunta favor haga posez stellen".split())
SPOKEN = set("you your vous usted ustedes thank thanks gracias merci danke".split())
_person = re.compile(r"\b(?:i(?!\.)|i'm|i'd|i've|i'll|me|my|myself|let us|let's|we|our|ich|mir|mich|mein\w*|je|j'\w+|m'\w+|mon|moi|mes|yo|mi|me|mis|puedo|debo|deseo|prefiero|quiero|lamento|siento|non posso|preferisco|não posso|ik|mij|mijn)\b", re.I)
_decline = re.compile(
    r"unable|can't|cannot|can not|won't|will not|would not|wouldn't|rather not|declin|refus|pass on|not (?:able|allow|comfortable|feel|respond|answer|something|my |say|judge|discuss|get|going|willing|permitted|in a position|for me)"
    r"|do not|don't|no answer|no comment|nothing|inappropriate|outside|beyond|against|guideline|polic(?:y|ies)|rules|stay out|steer clear|avoid|prefer|another (?:subject|topic)|unnamed|instead of|told not|must not|may not|off limits|abstain|withhold"
    r"|sorry|apolog|unfortunately|regret|forgive|afraid|nicht|keine?[nrm]?\b|ablehn|unmöglich|verweiger|außerhalb|lieber|leider|leid\b|entschuldig"
    r"|\bne\b|\bn'|refuser|impossible|préfèr|sort de|hors de|désolé|malheureusement|abstenir|déclin|\bno\b|rechaz|prefier|fuera de|imposible|siento|desgracia|absten|declin|non posso|mi dispiace|não posso|desculp|niet|helaas",
    re.I,
)
#: Each way to decline in ``_decline`` holds a word that holds one of these, or is one of DECLINING_WORDS.
DECLINING = re.compile(
    "unable not can won would don declin refus pass answer comment inappropriate outside beyond against guideline polic rules stay steer avoid prefer another unnamed instead limits abstain withhold sorry apolog unfortunately "
    "regret forgive afraid nicht kein ablehn unmöglich verweiger außerhalb lieber leider leid entschuldig impossible préfèr sort hors désolé malheureusement absten déclin rechaz fuera imposible prefier siento desgracia posso dispiace desculp niet helaas".replace(" ", "|")
).search
DECLINING_WORDS = {"ne", "n", "no"}
_closer = re.compile(r"please|anything else|something else|let me know|happy to|consult|expert|assist|bitte|andere frage|autre question|s'il vous|otra pregunta|por favor|haga|posez|stellen sie", re.I)
_latin = re.compile(r"[A-Za-zÀ-ɏ]")
_strange = re.compile(r"[Ͱ-ϿЀ-ӿ֐-׿؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-鿿가-힯]")

LANGUAGE: dict[str, list[int]] = {}
for _n, _list in enumerate(FUNCTION_WORDS.values()):
    for _w in _list.split():
        LANGUAGE.setdefault(_w, []).append(_n)

#: Kinds of endings that a clause doesn't end with.
UNFINISHED = ("bare", "begun", "run", "space", "open", "entity")

FEATURES = (
    "bias", "person", "declines", "person and declines", "closes", "speaks to the reader", "has digits",
    "echo", "answer leans foreign", "frame", "foreign", "perhaps foreign", "other script", "own language",
    "cut ending", "first", "last", "only", "person without digits",
)


def words_of(text: str) -> list[str]:
    """The runs of letters and digits; what the pattern finds, faster in Latin-1."""
    try:
        return text.encode("latin-1").translate(_spaced).decode("latin-1").split()
    except UnicodeEncodeError:
        return _found(text)


def may_decline(low: str) -> bool:
    """Whether a clause with this word (in lower case) can match ``_decline``; letters that the pattern takes for others may."""
    return low in DECLINING_WORDS or DECLINING(low) is not None or not low.isascii() and ("\u017f" in low or "\u0131" in low or "\u0307" in low or "\ufb05" in low or "\u1e9e" in low)


def _without_codes(text: str) -> str:
    return (_code if "_" in text else _code_plain).sub(" ", text)


def _has_quote(text: str) -> bool:
    return '"' in text if text.isascii() else _quote.search(text) is not None


def placeholder(answer: str | None, error: str | None) -> bool:
    """Nothing visible, only marks, markup or a placeholder, or just a failed call's message."""
    if answer is None:
        return True
    text = _markup.sub(" ", answer).strip() if "<" in answer or "&" in answer or "`" in answer or "[" in answer else answer.strip()
    if not any(c.isalnum() for c in text):
        return "�" not in text
    if error and len(text) > 5:
        told = error.strip()
        if text == told or answer.strip() == told or (text in error and len(text) > 0.6 * len(told)):
            return True
    if not _fifth.match(text) and all(w in PLACEHOLDERS for w in words_of(text.lower())):
        return True
    if text.isascii() and answer.isascii():
        low = answer.lower()
        if not ("err" in low or "http" in low or "timeout" in low or "fail" in low or "exception" in low or "traceback" in low):
            return False  # none of the messages' words
    if _failed.match(text) or _flagged.match(answer.strip()):
        return True
    return _trace.match(text) is not None or _trace.match(answer.strip()) is not None


def languages(words: list[str]) -> list[int]:
    """Hits of each Latin-script language's frequent words; words of one language only count double."""
    hits = [0] * len(FUNCTION_WORDS)
    for own in filter(None, map(LANGUAGE.get, words)):
        if len(own) == 1:
            hits[own[0]] += 2
        else:
            for n in own:
                hits[n] += 1
    return hits


class Question:
    """What clauses are compared with; kept for repeated questions."""

    def __init__(self, text: str | None):
        words = words_of((text or "").lower())
        self.words = set(words)
        self.sorted = {"".join(sorted(w)) for w in words if len(w) > 3}
        self.size = len(words)
        self.plain = "".join(words)
        hits = languages(words)
        self.language = hits.index(max(hits)) if words and max(hits) else -1
        self.latin = len(_latin.findall(text or "")) >= len(_strange.findall(text or ""))


def features(clause: str, words: list[str], question: Question, first: bool, last: bool, ends: str) -> int:
    """Bits of FEATURES for one clause."""
    bits = 1
    digits = _digit.search(clause) is not None
    bare = _quoted.sub(" ", clause) if _has_quote(clause) else clause
    if last and ends in UNFINISHED:
        # what is left of a word may look like another one
        bare = _last_word.sub("", bare)
    # sets first: the patterns only confirm what a word made likely
    if not PERSONS.isdisjoint(words) and _person.search(bare):
        bits |= 1 << 1 | (0 if digits else 1 << 18)
        if _decline.search(bare):
            bits |= 1 << 2 | 1 << 3
    if not CLOSERS.isdisjoint(words) and _closer.search(bare):
        bits |= 1 << 4
    if not SPOKEN.isdisjoint(words):
        bits |= 1 << 5
    if digits:
        bits |= 1 << 6
    if words and question.size:
        if len(question.words.intersection(words)) >= 0.4 * len(words):
            seen = 0
            for w in words:
                if w in question.words or (len(w) > 3 and "".join(sorted(w)) in question.sorted):
                    seen += 1
            if seen >= 3 and seen >= 0.7 * len(words) and seen >= 0.5 * question.size:
                bits |= 1 << 7
        elif len(words) == 1 and len(words[0]) > 12 and words[0] == question.plain:
            bits |= 1 << 7
    if len(words) <= 7 and not digits and words and sum(w in FRAMES for w in words) >= 0.6 * len(words):
        bits |= 1 << 9
    strange = 0 if bare.isascii() or not _strange.search(bare) else len(_strange.findall(bare))
    if strange and strange > len(_latin.findall(bare)) * 0.6:
        if question.latin:
            bits |= 1 << 12
    elif question.language >= 0:
        hits = languages(words_of(_without_codes(bare).lower()) if digits else words)
        own, most = hits[question.language], max(hits)
        if most >= own + 2:
            bits |= 1 << 10
        elif most > own:
            bits |= 1 << 11
        elif own:
            bits |= 1 << 13
    if last and ends in UNFINISHED:
        bits |= 1 << 14
    return bits | first << 15 | last << 16 | (first and last) << 17


def clauses(text: str) -> list[str]:
    return [c for m in _clause(text) if (c := m.strip()) and (c[0].isalnum() or _visible.search(c))]


def weak_tags(all_bits: list[int]) -> list[int]:
    """Seed labels for fit(): what single strong features say, and what surrounds a refusal."""
    has = lambda b, n: b >> n & 1
    if not all_bits:
        return []
    tags = []
    for b in all_bits:
        if has(b, 10) or has(b, 12):
            tags.append(3)
        elif has(b, 7) or has(b, 9):
            tags.append(2)
        elif has(b, 3) or (has(b, 4) and not has(b, 14)):
            tags.append(1)
        elif has(b, 14):
            tags.append(4)
        else:
            tags.append(0)
    if has(all_bits[0], 8) and not any(has(b, 3) for b in all_bits):
        tags = [3 if t in (0, 4) and not has(b, 13) else t for t, b in zip(tags, all_bits, strict=True)]
    if 1 in tags:
        for i, b in enumerate(all_bits):
            if tags[i] == 0 and (has(b, 1) or has(b, 5)) and not has(b, 6):
                tags[i] = 1
    return tags


def measured(question: Question, answer: str, how: str | None = None, parts: list[str] | None = None) -> tuple[list[int], list[int]]:
    """Feature bits and letter counts of an answer's clauses."""
    parts = clauses(answer) if parts is None else parts
    how = (how or cutoff.ending(answer)).partition(":")[0]
    bits, sizes = [], []
    for i, c in enumerate(parts):
        words = words_of(c.lower())
        bits.append(features(c, words, question, i == 0, i == len(parts) - 1, how))
        sizes.append(sum(map(len, words)))
    if question.language >= 0 and any(b >> 10 & 3 for b in bits):
        hits = languages(words_of(_without_codes(_quoted.sub(" ", answer) if _has_quote(answer) else answer).lower()))
        if max(hits) >= hits[question.language] + 2 or (not hits[question.language] and sum(sizes) > 12):
            bits = [b | 1 << 8 for b in bits]
    return bits, sizes


def tags_of(question: Question, answer: str, how: str, parts: list[str], doubts: list[bool]) -> list[int]:
    """weak_tags() of an answer in which only the clauses with ``doubts`` may be anything but answers by themselves. The others are
    measured where they may follow from those: around a refusal, and where a clause leans to another language."""
    kind, last = how.partition(":")[0], len(parts) - 1
    at = [i for i, doubt in enumerate(doubts) if doubt]
    if len(at) <= last:
        bits = [features(parts[i], words_of(parts[i].lower()), question, i == 0, i == last, kind) for i in at]
        some = weak_tags(bits)
        if 1 not in some and not any(b >> 10 & 3 for b in bits):
            tags = [0] * len(parts)
            for i, tag in zip(at, some, strict=True):
                tags[i] = tag
            return tags
    return weak_tags(measured(question, answer, how, parts)[0])


def restated(question: Question, answer: str) -> bool:
    """Whether the answer's letters are the question's and hardly any others."""
    if question.size < 3 or len(answer) > 3 * len(question.plain) + 80:
        return False
    words = words_of(answer.lower())
    plain = "".join(words)
    if question.plain not in plain:
        return False
    rest = words_of(answer.lower().replace("_", " "))
    left = [w for w in rest if w not in question.words]
    return len(plain) - len(question.plain) <= 24 and all(w in FRAMES for w in left)



"""Defective question and answer pairs by clause tagging.

An answer is split into clauses. A linear-chain conditional random field tags each one as answer,
refusal, echo (of the question), foreign, unfinished or void (a placeholder or a failed call's
message); the tags' shares of the letters decide the pair's defect. The field sees hashed words,
beginnings of words and pairs of words, how much of the clause is in the question and the other way
round, how many of its words are known in the question's language and in others, scripts, and how the
answer ends. It is fitted at run time on all given pairs, whatever their length: their weak labels,
written seeds, and a changed copy of every plain pair, whose tags are known because of how it was made
(an answer put under a question in another language, words made unreadable, the end cut away). Counts
of words come from all pairs first; then the pairs are measured once, in blocks on disk, and every
step of the fit is the gradient of one hashed share of the blocks, so that all shares are used.
"""

from __future__ import annotations

import functools
import gc
import random
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut, ship
from . import cutoff, labels
from .labels import FUNCTION_WORDS, TAGS, clauses

#: Share of an answer's letters from which a tag covers it.
COVER = 0.5
#: Rows of one step of the fit, at least, if there are as many; the seeds count as for this many rows.
STEP_ROWS = 8_000
#: A word is known in a language if it is heard in one of so many rows, and twice.
HEARD_IN = 4_000
#: Questions a language that seeds and changed copies are put under: those of the least hashes of all.
ASKED = 64
#: Rounds of the fit; buckets of hashed words.
ROUNDS, BUCKETS = 40, 1 << 15
SEED = 20260102

# Refusals in other wordings than any table's, by language; training seeds.
REFUSALS = {
    "en": """As a language model I can't take a position on that.|I am only an assistant and this topic is not one I may comment on.|That falls outside what this service will answer.
This is not a subject I can go into.|We do not provide judgements of that kind.|The assistant has been asked not to comment on people or teams.|This system was told to leave such topics alone.
Such a request lies outside the scope of this tool.|I have no permission to respond to this.|My instructions forbid an opinion here.|It would be wrong of me to choose.|I must leave this one unanswered.
I am going to skip this question.|No comment from me on this.|Let us talk about something different.|I would rather keep out of it.|This platform does not allow me to discuss the matter.|I have to refuse.
That is something I do not talk about.|Answering would break the content policy.|I do not feel comfortable responding.|You will have to ask somebody else about that.|I'm afraid I can't assist with this request.
It isn't possible for me to fulfil this request.|Commenting on that is against the rules I follow.|I won't be drawn on it.|I am not in a position to say.|This chatbot does not handle questions about politics.
Sorry, that is not a topic for me.|I cannot help with that.|I'm unable to comply.|I prefer to remain neutral and give no verdict.|I choose not to answer.|Please consult a professional instead.
The model is configured to avoid sensitive matters.|I regret that I may not reply to this.|This request was declined for safety reasons.|I was designed to stay away from such comparisons.""",
    "de": """Dazu kann ich leider keine Auskunft geben.|Diese Anfrage darf ich nicht beantworten.|Als Sprachmodell habe ich hierzu keine Meinung.|Ich muss diese Bitte ablehnen.|Das liegt außerhalb meiner Aufgaben.
Darüber möchte ich nicht sprechen.|Bitte wenden Sie sich an jemand anderen.|Meine Vorgaben erlauben mir keine Wertung.|Ich enthalte mich einer Antwort.|Es tut mir leid, das geht nicht.""",
    "fr": """Je ne suis pas autorisé à répondre à cela.|En tant que modèle de langage, je n'ai pas d'avis.|Je dois décliner cette demande.|Ce sujet sort de mon domaine.|Je m'abstiens de tout commentaire.
Désolé, je ne peux pas vous aider.|Veuillez poser une autre question.|Mes consignes m'interdisent de me prononcer.|Il m'est impossible d'en juger.|Je préfère ne pas en parler.""",
    "es": """No estoy autorizado a responder a eso.|Como modelo de lenguaje no tengo opinión.|Debo rechazar esta petición.|Ese tema queda fuera de mi alcance.|Prefiero no hacer comentarios.
Lo siento, no puedo ayudar con esto.|Por favor, haga otra pregunta.|Mis normas no me permiten opinar.|Me resulta imposible juzgarlo.|Me abstengo de contestar.""",
    "it": "Mi dispiace, non posso rispondere a questa domanda.|Preferisco non esprimermi.|Le mie regole non lo permettono.",
    "pt": "Desculpe, não posso responder a isso.|Prefiro não comentar.|As minhas regras não o permitem.",
    "nl": "Het spijt me, daar kan ik niet op antwoorden.|Ik geef hier liever geen mening over.|Mijn regels staan dat niet toe.",
}
#: Stand-ins for answers and failed calls; training seeds.
VOIDS = (
    "n/a|none|TODO|[no answer]|no response|to be filled in|pending|(empty)|HTTP 500: internal server error|HTTP 404|ConnectionError: connection reset by peer|[error] upstream timeout after 30 s|"
    "ReadTimeout: no data received|error: quota exceeded for this key|Exception: model overloaded, try again later|failed: could not reach host|null|undefined|ValueError: bad payload at byte 12"
)

#: Answers about other things, with words that refusals have too; training seeds.
SAYINGS = {
    "en": """The capital of the country lies on the river.|Water boils sooner at high altitude.|Most readers liked the second edition.|It rained all week, so the match was moved to Sunday.|I read the minutes, and the younger group seems to have won.
We measured twice and the older engine was quieter.|My notes favour the second team.|Neither side reached the goal before noon.|Both did well, but the choir from the valley sang longer.|The gardeners, because they started early.|Probably the cooks, judging by the receipts.
She refused the prize, although the jury had agreed.|The rules were changed after the vote.|He was sorry that the trip ended early.|Nobody could say why the lights went out.|The policy was signed by the mayor last year.|You can see the result on the second page.|The older ones.
Please note that the second list is shorter, so the first crew won.|Yes, the pilots were first.|No, it was the other boat.|As far as I know, the museum opened late.|Our table shows that the west side leads.|It depends on the season, but hens usually lay more eggs in spring.|Young sailors.
They were asked to leave, and they declined.|I think so, since the report mentions it twice.|It was cancelled because of the storm.|Bees need flowers, and flowers need bees.|The report says that the answer was found in a drawer.|Cats sleep most of the day.|A long dispute about prices decided it.""",
    "de": "Die Gärtner, weil sie früher begonnen haben.|Der Zug fuhr erst nach Mitternacht ab.|Es war die zweite Mannschaft, obwohl es regnete.|Ich habe die Liste gelesen, und die Köche lagen vorn.|Niemand wusste, warum das Licht ausging.|Katzen schlafen fast den ganzen Tag.|Das Dorf liegt an einem kleinen Fluss.|Die Regeln wurden danach geändert.",
    "fr": "Les jardiniers, parce qu'ils ont commencé plus tôt.|Le train est parti après minuit.|C'est la deuxième équipe, même s'il pleuvait.|J'ai lu la liste, et les cuisiniers étaient devant.|Personne ne savait pourquoi la lumière s'est éteinte.|Au moulin de pierre, l'équipe avait une heure d'avance.|Le village se trouve près d'une rivière.|Les règles ont changé ensuite.",
    "es": "Los jardineros, porque empezaron antes.|El tren salió después de medianoche.|Fue el segundo equipo, aunque llovía.|Leí la lista, y los cocineros iban delante.|Nadie sabía por qué se apagó la luz.|Los gatos duermen casi todo el día.|El pueblo está junto a un río pequeño.|Las reglas cambiaron más tarde.",
}
#: Lines that frame a repeated question.
FRAMES = ("Answer in one sentence.", "That is the question.", "Please answer.", "This is what was asked.", "Reply briefly.", "Kurz beantworten.", "Répondez en une phrase.", "Responda en una frase.", "Think step by step.", "Here is your question again.")

LANGUAGES = list(FUNCTION_WORDS)
_bit = {}
for _n, _list in enumerate(FUNCTION_WORDS.values()):
    for _w in _list.split():
        _bit[_w] = _bit.get(_w, 0) | 1 << _n
_words = labels.words_of
_letters = re.compile(r"[\W_]+")
_marks = bytes(n for n in range(256) if not chr(n).isalnum())
_quoted = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")
_failure = re.compile(r"[A-Z]\w*(?:Error|Exception|Timeout)$|HTTP$|^(?:error|traceback|failed|exception)$")

DENSE = 60
_F, _V = 7, len(LANGUAGES)


def _script(c: str) -> int:
    """The script of a letter, as far as it matters: Latin, digits, and blocks of the others."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return 0
    return 1 if o < 0x400 else 2 if o < 0x530 else 3 if o < 0x600 else 4 if o < 0x780 else 5 if o < 0xE00 else 6 if o < 0xF00 else 7 if 0xAC00 <= o < 0xD7B0 else 8


def _plain(text: str) -> str:
    """The letters and digits of a text, in lower case."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(None, _marks).decode("latin-1")
    except UnicodeEncodeError:
        return _letters.sub("", low)


class _Numbers(dict):
    """Keys with the numbers that ``add`` gives them."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, key):
        got = self[key] = self.add(key)
        return got


class Vocabulary:
    """Numbers of words with what the field needs of each: hashes, languages, shape."""

    REMEMBERED = 300_000

    def __init__(self, known: dict[str, int] | None = None):
        import xxhash

        self.hash = xxhash.xxh32_intdigest
        self.known = known or {}
        self.digits = (self.hash("0") % BUCKETS, self.hash("0~") % BUCKETS)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = _Numbers(self.add)
        self.words: list[str] = []
        self.backwards = [_Numbers(lambda n, every=every: self.number[_mirrored(self.words[n], every)]) for every in (False, True)]
        self.anagrams: dict[str, int] = {}
        self.table = np.zeros((11, 1024), dtype=np.int32)
        self.questions: dict[str | None, tuple] = {}
        self.clauses: dict[str, tuple[list[int], int, int]] = {}

    def add(self, word: str) -> int:
        n = len(self.words)
        self.words.append(word)
        if n == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        if word.isdecimal() and word.isascii():
            letters = "".join(sorted(word)) if len(word) > 3 else word
            self.table[:, n] = (*self.digits, self.anagrams.setdefault(letters, len(self.anagrams)), 0, 0, len(word), 0, 1, 0, 0, 0)
            return n
        low = word.lower()
        digits = any(c.isdigit() for c in word)
        plain = "0" if digits else low
        letters = "".join(sorted(low)) if len(low) > 3 else low
        # codes in capitals are words of no language
        coded = digits or (len(word) > 1 and word.isupper() and word.isascii())
        self.table[:, n] = (
            self.hash(plain) % BUCKETS, self.hash(plain[:5] + "~") % BUCKETS, self.anagrams.setdefault(letters, len(self.anagrams)),
            0 if coded else _bit.get(low, 0), 0 if coded else self.known.get(low, 0) | _bit.get(low, 0), len(word),
            0 if digits else 1 if word == low else 2 if word.istitle() else 0, digits, _script(word[0]) | (_failure.search(word) is not None) << 8,
            (low in labels.PERSONS) | (low in labels.CLOSERS) << 1 | (low in labels.FRAMES) << 2 | labels.may_decline(low) << 3, _bit.get(low, 0),
        )
        return n

    def ids(self, words: list[str]) -> list[int]:
        return list(map(self.number.__getitem__, words))

    def clause(self, c: str) -> tuple[list[int], int, int]:
        """(words, letters, marks) of a clause, kept for its copies; quotations don't count."""
        if len(self.clauses) > 20_000:
            self.clauses.clear()
        bare = _quoted.sub(" ", c) if labels._has_quote(c) else c
        shouted = len(bare) > 12 and bare.isupper()
        words = _words(bare.lower() if shouted else bare) or _words(c)
        got = self.clauses[c] = (self.ids(words), sum(map(len, words)), (c[0] in "[{<") << 7 | (bare is not c) << 8 | (c[-1] == "?") << 9 | shouted << 10)
        return got

    def mirrored(self, parts: list[str], every: bool, text: str) -> list[str]:
        """The clauses of _mirrored()'s ``text``, whose words are known by number from the ``parts`` that it was made of."""
        out = clauses(text)
        for c, back in zip(parts, out, strict=True):
            got = self.clauses.get(c)
            if got is not None and not got[2] >> 10 and back not in self.clauses:
                self.clauses[back] = (list(map(self.backwards[every].__getitem__, got[0])), *got[1:])
        return out

    def question(self, text: str | None) -> tuple:
        """(anagram classes, number of words, language or -1, script, letters) of a question."""
        got = self.questions.get(text)
        if got is None:
            if len(self.questions) > 50_000:
                self.questions.clear()
            ids = self.ids(_words(text.lower() if text and text.isupper() else text or ""))
            rows = self.table[:, ids].astype(np.int64) if ids else np.zeros((11, 0), np.int64)
            hits = np.array([((rows[3] >> n & 1) * np.where(np.bitwise_count(rows[3]) == 1, 2, 1)).sum() for n in range(_F)])
            scripts = np.bincount(rows[8] & 15, rows[5], 9)
            got = self.questions[text] = (np.unique(rows[2]), len(ids), int(hits.argmax()) if hits.any() else -1, int(scripts.argmax()), _plain(text or ""))
        return got


def _pairs(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Buckets of each word with the next one of its clause; of the last one alone."""
    pair = (words * 0x9E37 + np.roll(words, -1) * 0x85EB + 7) % BUCKETS
    pair[first + size - 1] = words[first + size - 1]
    return pair


class Measured:
    """Features of the clauses of many pairs: hashed words (bucket, clause) and a dense matrix."""

    def __init__(self, vocabulary: Vocabulary, rows: list[tuple[str | None, str, str | None, str]], screen: bool = False, parts: list[list[str]] | None = None):
        """``rows``: question, answer, error and the kind of the answer's ending. With ``screen``, the
        rows that may have another weak label than answers are ``doubtful``. ``parts`` are the answers' clauses, if known."""
        if len(vocabulary.number) > vocabulary.REMEMBERED:
            vocabulary.forget()
        flat: list[int] = []
        sizes, letters, counts, marks = [], [], [], []
        questions: list[tuple] = []
        self.parts = [clauses(a) for _, a, _, _ in rows] if parts is None else parts
        seen_clause, seen_question = vocabulary.clauses.get, vocabulary.questions.get
        for (q, answer, error, how), parts in zip(rows, self.parts, strict=True):
            question = seen_question(q) or vocabulary.question(q)
            questions.append(question)
            counts.append(len(parts))
            if not parts:
                continue
            told = error.strip() if error else ""
            failed = len(told) > 5 and (told in answer or answer.strip() in told)
            letters_of = question[4]
            contains = question[1] >= 3 and len(letters_of) <= len(answer) <= 3 * len(letters_of) + 80 and letters_of in (plain := _plain(answer)) and len(plain) - len(letters_of) <= 24
            every, start = failed << 5 | contains << 6, len(marks)
            for c in parts:
                ids, n, mark = seen_clause(c) or vocabulary.clause(c)
                flat += ids
                sizes.append(len(ids))
                letters.append(n)
                marks.append(mark | every)
            kind = how.partition(":")[0]
            marks[start] |= 1
            marks[-1] |= 2 | (kind in labels.UNFINISHED) << 2 | (kind == "closed") << 3 | (kind in ("item", "phrase", "whole")) << 4
        self.lengths = np.array(counts, dtype=np.int64)
        self.letters = np.array(letters, dtype=np.float64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if counts else np.zeros(0, np.int64)
        n = len(sizes)
        if not n:
            self.contains, self.doubtful = np.zeros(0, np.int64), np.zeros(len(rows), bool)
            self.bucket, self.first, self.size, self.flags = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, DENSE), bool)
            return
        size = np.array(sizes, dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        t = vocabulary.table.take(np.array(flat, dtype=np.int64), axis=1)
        clause = np.repeat(np.arange(n), size)
        row_of = np.repeat(np.arange(len(rows)), self.lengths)
        row, marks = row_of[clause], np.array(marks)
        add = lambda v: np.add.reduceat(v.astype(np.float32), first)
        # hashed words, beginnings and pairs: three entries per word
        pair = _pairs(t[0].astype(np.int64), first, size)
        self.bucket = np.stack([t[0], t[1], pair], 1).ravel()
        self.first, self.size = first * 3, size * 3
        self.words, self.contains = t, marks >> 6 & 1
        # the question's words
        names: dict[int, int] = {}
        which = np.array([names.setdefault(id(q), len(names)) for q in questions])
        every = {names[id(q)]: q for q in questions}
        keys = np.concatenate([q[0] + (k << 40) for k, q in every.items()])
        asked = np.zeros(len(vocabulary.anagrams), bool)
        asked[keys & (1 << 40) - 1] = True
        there = asked[t[2]]
        likely = np.nonzero(there)[0]
        wanted = t[2, likely] + (which[row[likely]] << 40)
        there[likely] = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted if len(keys) else False
        seen = add(there)
        q_size = np.array([q[1] for q in questions])[row_of]
        language = np.array([q[2] for q in questions])[row_of]
        script = np.array([q[3] for q in questions])[row_of]
        share, cover = seen / size, seen / np.maximum(q_size, 1)
        # languages
        lower = t[6] == 1
        n_low, titles = add(lower), add(t[6] == 2)
        single = np.where(np.bitwise_count(t[3]) == 1, 2, 1)
        hits = np.stack([add((t[3] >> k & 1) * single) for k in range(_F)], 1)
        known = np.stack([add((t[4] >> k & 1) * lower) for k in range(_V)], 1)
        at = np.arange(n)
        lang = np.maximum(language, 0)
        own, own_known = hits[at, lang], known[at, lang]
        hits[at, lang], known[at, lang] = -1, -1
        other, other_known = hits.max(1), known.max(1)
        told = language >= 0
        whole_own, whole_other = (np.bincount(row_of, v, len(rows))[row_of] for v in (own, np.maximum(other, 0)))
        spelled = t[5] * ((t[7] == 0) | ((t[8] & 15) > 0))
        strange = add(spelled * ((t[8] & 15) != script[clause])) / np.maximum(add(spelled), 1)
        m = marks
        only = self.lengths[row_of] == 1
        lean = np.where(told, other - own, 0)
        k_share, o_share = own_known / np.maximum(n_low, 1), np.maximum(other_known, 0) / np.maximum(n_low, 1)
        enough = told & (n_low >= 3)
        columns = [
            np.ones(n), m & 1, m >> 1 & 1, only, add(t[7]) > 0, size <= 2, (size > 2) & (size <= 5), (size > 5) & (size <= 12), size > 12,
            share < 0.2, (share >= 0.2) & (share < 0.5), (share >= 0.5) & (share < 0.7), (share >= 0.7) & (share < 0.9), share >= 0.9,
            (cover >= 0.3) & (cover < 0.6), (cover >= 0.6) & (cover < 0.85), cover >= 0.85, (share >= 0.7) & (cover >= 0.5) & (seen >= 3), m >> 6 & 1,
            told & (own == 0) & (n_low >= 5), told & (own == 0) & (n_low < 5), told & (own > 0) & (own <= 0.2 * size), told & (own > 0.2 * size) & (own <= 0.5 * size), told & (own > 0.5 * size),
            lean >= 3, lean == 2, lean == 1, lean < 0,
            enough & (k_share < 0.1), enough & (k_share >= 0.1) & (k_share < 0.4), enough & (k_share >= 0.4) & (k_share < 0.8), enough & (k_share >= 0.8),
            enough & (o_share - k_share > 0.5), enough & (o_share - k_share > 0.2) & (o_share - k_share <= 0.5), enough & (o_share < 0.1) & (k_share < 0.1),
            strange > 0.6, (strange > 0.1) & (strange <= 0.6), m >> 2 & 1, m >> 3 & 1, m >> 4 & 1, m >> 5 & 1, add(t[8] >> 8) > 0, m >> 7 & 1, ~told,
            told & (whole_other >= whole_own + 2), told & (whole_own > whole_other), m >> 8 & 1, (m >> 9 & 1), (m >> 9 & 1) & (share >= 0.6),
            (m & 1) & (size <= 4), (m >> 1 & 1) & (size <= 4), only & (size <= 3), seen == 0, q_size == 0, told & (whole_own == 0) & (n_low >= 4), enough & (own == 0) & (k_share < 0.25), titles == size, only & (titles > 0) & (size <= 3), (strange > 0.6) & (size <= 4), (strange > 0.6) & only,
        ]
        self.flags = np.stack([np.asarray(c, dtype=bool) for c in columns], 1)
        if screen:
            # clauses that labels.weak_tags() may call anything but an answer
            bits, flags = t[10], t[9]
            every_hit = np.stack([add((bits >> k & 1) * np.where(np.bitwise_count(bits) == 1, 2, 1)) for k in range(_F)], 1)
            own = every_hit[at, lang]
            every_hit[at, lang] = -1
            coded = 2 * (add(t[7]) > 0)
            leans = told & (every_hit.max(1) > 0) & (every_hit.max(1) + coded > own)
            alike = ((seen >= 2) & (share >= 0.5)) | ((size == 1) & (seen == 1)) | ((size == 1) & (add(t[5]) > 12))
            framed = (size <= 7) & (add(flags >> 2 & 1) >= 0.5 * size)
            # whoever says "I" and doesn't decline answers
            says = (add(flags >> 1 & 1) > 0) | ((add(flags & 1) > 0) & (add(flags >> 3) > 0))
            doubt = leans | alike | framed | says | (m >> 2 & 1).astype(bool) | (strange > 0) | (m >> 8 & 1).astype(bool)
            self.doubts, self.doubtful = doubt, np.bincount(row_of, doubt, len(rows)) > 0

    @functools.cached_property
    def dense(self) -> np.ndarray:
        return self.flags.astype(np.float32)

    def pack(self, begin: int = 0, end: int | None = None) -> bytes:
        """The features of the rows from ``begin`` to ``end`` alone, for unpack()."""
        lengths = self.lengths[begin:end]
        some = slice(n := int(self.lengths[:begin].sum()), n + int(lengths.sum()))
        size = self.size[some] // 3
        words = self.words[:2, w : w + int(size.sum())].T.astype(np.uint16, order="C") if len(size) and (w := int(self.first[some.start]) // 3) >= 0 else np.zeros((0, 2), np.uint16)
        parts = [size.astype(np.uint32), self.letters[some].astype(np.uint32), lengths.astype(np.uint32), words, np.packbits(self.flags[some], axis=1)]
        return np.array([len(size), len(lengths), len(words)], np.int64).tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Measured:
        """The features of several packed ones, one after another."""
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for blob in blobs:
            n, rows, words = np.frombuffer(blob, np.int64, 3).tolist()
            at = 24
            for column, count, kind in zip(columns, (n, n, rows, 2 * words, n * ((DENSE + 7) // 8)), (np.uint32, np.uint32, np.uint32, np.uint16, np.uint8), strict=True):
                column.append(np.frombuffer(blob, kind, count, at))
                at += column[-1].nbytes
        size, letters, lengths, words, dense = (np.concatenate(c) for c in columns)
        x = cls.__new__(cls)
        x.lengths, x.letters = lengths.astype(np.int64), letters.astype(np.float64)
        x.starts = np.concatenate([[0], np.cumsum(x.lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        size = size.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
        words = words.reshape(-1, 2).astype(np.int64)
        pair = _pairs(words[:, 0], first, size)
        x.bucket, x.first, x.size = np.stack([words[:, 0], words[:, 1], pair], 1).ravel(), first * 3, size * 3
        x.dense = np.unpackbits(dense.reshape(len(size), -1), axis=1, count=DENSE).astype(np.float32)
        return x

    def scores(self, lexical: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score of every tag at every clause."""
        if not len(self.size):
            return np.zeros((0, len(TAGS)))
        words = np.add.reduceat(lexical[self.bucket], self.first, axis=0) / np.sqrt(self.size)[:, None]
        return words + self.dense @ weights


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of many answers at once; ``scores`` holds their clauses one after another."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    back = np.zeros((len(scores), len(TAGS)), dtype=np.int8)
    live = int((lengths > 0).sum())
    best = scores[starts[:live]]
    ends = np.zeros((len(lengths), len(TAGS)))
    longest = int(lengths[0]) if len(lengths) else 0
    for t in range(1, longest + 1):
        still = int(np.searchsorted(-lengths, -t, side="left"))  # answers with more than t clauses
        ends[still:live] = best[still:live]
        live = still
        if not live:
            break
        through = best[:live, :, None] + steps[None]
        at = starts[:live] + t
        back[at] = through.argmax(axis=1)
        best = through.max(axis=1) + scores[at]
    tags = np.zeros(len(scores), dtype=np.int8)
    now = ends.argmax(axis=1)
    at = starts + lengths - 1
    alive = np.nonzero(lengths > 0)[0]
    while len(alive):
        tags[at[alive]] = now[alive]
        now[alive] = back[at[alive], now[alive]]
        at[alive] -= 1
        alive = alive[at[alive] >= starts[alive]]
    return tags


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(x: Measured, gold: np.ndarray, importance: np.ndarray, params: list[np.ndarray]) -> list[np.ndarray]:
    """The gradient of the random field's log likelihood: (lexical, weights, steps, total weight).
    ``gold`` has a tag per clause, ``importance`` a weight per answer. Time and memory are in
    proportion to the clauses given, however long an answer is."""
    k = len(TAGS)
    lexical, w, s = params
    order = np.argsort(-x.lengths, kind="stable")
    starts, lengths = x.starts[order], x.lengths[order]
    n = int((lengths > 0).sum())
    if not n:
        return [np.zeros((BUCKETS, k)), np.zeros((DENSE, k)), np.zeros((k, k)), np.zeros(1)]
    starts, lengths, weight = starts[:n], lengths[:n], importance[order][:n].astype(np.float64)
    # longest first: at every place the live answers are a prefix
    top = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(top + 1), side="left")
    e = x.scores(lexical, w)
    a, b = e.astype(np.float64), np.zeros((len(e), k))
    for t in range(1, top):
        at = starts[: live[t]] + t
        a[at] += _lse(a[at - 1][:, :, None] + s[None], 1)
    z = _lse(a[starts + lengths - 1], 1)
    pairs = np.zeros((k, k))
    for t in range(top - 2, -1, -1):
        m = live[t + 1]
        at = starts[:m] + t
        later = e[at + 1] + b[at + 1]
        b[at] = _lse(s[None] + later[:, None, :], 2)
        pairs -= (np.exp(a[at][:, :, None] + s[None] + later[:, None, :] - z[:m, None, None]) * weight[:m, None, None]).sum(0)
    row = np.repeat(np.arange(len(x.lengths)), x.lengths)
    of_row, weight_of = np.zeros(len(x.lengths)), importance.astype(np.float64)[row]
    of_row[order[:n]] = z
    inner = np.nonzero(row[1:] == row[:-1])[0]
    np.add.at(pairs, (gold[inner], gold[inner + 1]), weight_of[inner])
    left = (np.eye(k)[gold] - np.exp(a + b - of_row[row][:, None])) * weight_of[:, None]
    scaled = left / np.sqrt(x.size)[:, None]
    by_word = np.stack([np.bincount(x.bucket, np.repeat(scaled[:, j], x.size), BUCKETS) for j in range(k)], 1)
    return [by_word, x.dense.T @ left, pairs, np.array([weight_of.sum()])]


class Ascent:
    """Gradient steps (Adam) to the maximum of the likelihood."""

    def __init__(self, rate: float = 0.22, decay: float = 1e-5):
        k = len(TAGS)
        self.rate, self.decay, self.n = rate, decay, 0
        self.params = [np.zeros((BUCKETS, k), np.float32), np.zeros((DENSE, k), np.float32), np.zeros((k, k), np.float32)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]

    def step(self, sums: list[np.ndarray]) -> None:
        self.n += 1
        for p, (m, v), g in zip(self.params, self.moments, sums[:3], strict=True):
            g = (g / max(float(sums[3][0]), 1e-9) - self.decay * p).astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-7)


class Field:
    """A fitted field, with the word tables it was fitted with; goes to the workers as it is."""

    def __init__(self, known: dict[str, int], tails: cutoff.Tails, params: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.known, self.tails, self.params = known, tails, params

    def tags(self, x: Measured) -> np.ndarray:
        lexical, weights, steps = self.params
        return viterbi(x.scores(lexical, weights), x.lengths, steps) if len(x.size) else np.zeros(0, np.int8)


class _Reversed(dict):
    """Words spelled backwards if they are in lower case; frequent words stay unless ``every``."""

    def __init__(self, every: bool):
        self.every = every

    def __missing__(self, word: str) -> str:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = word[::-1] if word.islower() and (self.every or word not in _bit) else word
        return got


_reversed = (_Reversed(False), _Reversed(True))
_spelled = re.compile(r"([^\W\d_]+)").split


def _mirrored(text: str, every: bool) -> str:
    """The text with its lower-case words spelled backwards; frequent words stay unless ``every``."""
    parts = _spelled(text)
    parts[1::2] = map(_reversed[every].__getitem__, parts[1::2])
    return "".join(parts)


def _uncollected(run):
    """A worker's function without searches for cyclic garbage, of which it makes hardly any: they take time in proportion to what is kept."""

    @functools.wraps(run)
    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if on:
                gc.enable()

    return quiet


@_uncollected
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(question, answer) to (word, language, ends, insides, heard): how often a word ends a finished sentence
    or stands in one (language -1), and how often it is heard in answers to questions of a language
    that don't lean to another one. Language -2: the questions of the least hashes, by language in ``heard``."""
    import heapq

    import xxhash

    tails: dict[str, list[int]] = {}
    heard: dict[int, dict[str, int]] = {}
    asked: dict[int, list[tuple[int, str]]] = {}
    spoken: dict[str | None, int] = {}

    def out() -> pa.RecordBatch:
        rows = [(w, -1, e, i, 0) for w, (e, i) in tails.items()] + [(w, k, 0, 0, c) for k, words in heard.items() for w, c in words.items()] + [(q, -2, 0, 0, k) for k, heap in asked.items() for _, q in heap]
        tails.clear()
        heard.clear()
        asked.clear()
        columns = zip(*rows, strict=True) if rows else ([],) * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "language", "ends", "insides", "heard"])

    for batch in batches:
        answers = batch.column(1).to_pylist()
        cutoff.count_tails(answers, tails)
        said: dict[int, Counter] = {}
        for q, a in zip(batch.column(0).to_pylist(), answers, strict=True):
            language = spoken.get(q)
            if language is None:
                if len(spoken) > 50_000:
                    spoken.clear()
                language = spoken[q] = labels.Question(q).language
                if language >= 0:
                    heap, item = asked.setdefault(language, []), (-xxhash.xxh32_intdigest(q), q)
                    if item not in heap:
                        (heapq.heappush if len(heap) < ASKED else heapq.heappushpop)(heap, item)
            if language < 0 or not a:
                continue
            words = _words(a)
            hits = labels.languages(_words(a.lower()) if a.isascii() else [w.lower() for w in words])
            if hits[language] < max(hits):
                continue
            if language not in said:
                said[language] = Counter()
            said[language].update(words)
        for language, found in said.items():
            counts = heard.setdefault(language, {})
            for w, n in found.items():
                low = w.lower()
                if w is low or w.islower() or w.istitle():
                    counts[low] = counts.get(low, 0) + n
        if len(tails) + sum(map(len, heard.values())) > 200_000:
            yield out()
    yield out()


def word_tables(rows: DataFrame, n: int) -> tuple[dict[str, int], cutoff.Tails, dict[int, list[str]]]:
    """(known words by language, table of last words, questions by language) of all ``n`` rows (q, a, e)."""
    import xxhash

    counts = rows.select("q", "a").mapInArrow(_word_counts, "word string, language int, ends long, insides long, heard long")
    counts = cut(counts.groupBy("word", "language", F.when(F.col("language") == -2, F.col("heard")).alias("of")).agg(F.sum("ends").alias("ends"), F.sum("insides").alias("insides"), F.sum("heard").alias("heard")))
    known: dict[str, int] = {}
    for r in counts.filter((F.col("language") >= 0) & (F.col("heard") >= max(2.0, n / HEARD_IN))).select("word", "language").collect():
        known[r.word] = known.get(r.word, 0) | 1 << r.language
    asked: dict[int, list[str]] = {}
    for r in counts.filter("language = -2").select("word", "of").collect():
        asked.setdefault(r.of, []).append(r.word)
    asked = {k: sorted(qs, key=lambda q: (xxhash.xxh32_intdigest(q), q))[:ASKED] for k, qs in sorted(asked.items())}
    return known, cutoff.frequent(counts.filter("language = -1")), asked


def seeds(asked: dict[int, list[str]], tails: cutoff.Tails, seed: int = SEED) -> tuple[list[tuple], list[list[int]], list[float]]:
    """The written examples: (rows for Measured, tags of their clauses, weights)."""
    draw = random.Random(seed)
    answer, refusal, _, _, _, void = range(6)
    out: list[tuple] = []
    gold: list[list[int]] = []
    weights: list[float] = []

    def give(q, a, e, tag, weight=1.0):
        tags = tag if isinstance(tag, list) else [tag] * len(clauses(a))
        out.append((q, a, e, cutoff.ending(without_question(a, q), tails)))
        gold.append(tags)
        weights.append(weight)

    for name, texts in REFUSALS.items():
        language = LANGUAGES.index(name)
        of = asked.get(language) or [None]
        for a in re.split(r"[|\n]", texts):
            give(draw.choice(of), a, None, refusal, 3.0)
            # a refusal with a line before it
            if asked and language == 0:
                give(draw.choice(of), "Thanks for asking. " + a, None, refusal, 1.0)
            give(draw.choice(of), _mirrored(a, False), None, refusal, 0.3)
    for name, texts in SAYINGS.items():
        of = asked.get(LANGUAGES.index(name)) or [None]
        for a in re.split(r"[|\n]", texts):
            give(draw.choice(of), a, None, answer, 4.0)
            give(draw.choice(of), _mirrored(a, False), None, answer, 2.0)
            give(None, a, None, answer, 2.0)
    causes = ("ConnectionError", "ValueError", "ApiException", "ReadTimeout", "RemoteProtocolError", "HTTP 500", "HTTP 429", "HTTP 403", "Error 503", "error", "[error] remote", "failed", "RuntimeException")
    effects = ("closed by peer", "no data received", "quota exceeded for this key", "model overloaded", "try again later", "could not reach host", "bad payload at byte 12", "internal server error", "timed out after 30 s", "gateway", "too many requests")
    stands = VOIDS.split("|") + [shape.format(w) for w in sorted(labels.PLACEHOLDERS) if len(w) > 2 for shape in ("{}", "[{}]", "({})")] + [f"{c}: {e}" for c in causes for e in draw.sample(effects, 4)]
    for a in stands:
        give(draw.choice(asked.get(0) or [None]), a, None, void, 1.5)
    for a in VOIDS.split("|"):
        give(None, "<p>" + a + "</p>", a, void, 1.0)
    return out, gold, weights


#: Kinds of changed copies, with how many of a hundred plain rows they are made of, and a copy's weight.
COPIES = (("asked", 10), ("mirrored", 14), ("other", 10), ("bare", 10), ("unasked", 4), ("quoting", 4), ("broken", 18), ("echo", 10), ("repeating", 20))
COPY_WEIGHT = 1.2
_copies = [k for k, n in COPIES for _ in range(n)]


def changed(q: str, a: str, parts: list[str], language: int, asked: dict[int, list[str]], number: int, vocabulary: Vocabulary) -> tuple[str | None, str, list[int], list[str]]:
    """A changed copy of a plain pair: (question, answer, tags, clauses), of a kind that ``number`` (a hash)
    gives; where that can't be made of the pair, its words are spelled backwards."""
    answer, _, echo, foreign, unfinished, _ = range(6)
    kind, turn = _copies[number % len(_copies)], number // len(_copies)
    tags = [answer] * len(parts)
    if kind == "repeating" and (len(a) >= 40 or "\n" in a):
        kind = "echo"
    if kind in ("asked", "mirrored"):
        said = min(sum(map(str.islower, _words(c))) for c in parts)
        others = [k for k in asked if k != language]
        if kind == "asked" and others and said >= 3:
            pool = asked[others[turn % len(others)]]
            return pool[turn // 8 % len(pool)], a, [foreign] * len(parts), parts
        if kind == "mirrored" and said >= 4:
            back = _mirrored(a, True)
            return q, back, [foreign] * len(parts), vocabulary.mirrored(parts, True, back)
    elif kind == "unasked":
        return None, a, tags, parts
    elif kind == "quoting":
        alien = [x for n, x in SAYINGS.items() if LANGUAGES.index(n) != language]
        alien = re.split(r"[|\n]", alien[turn % len(alien)])
        quoted = (" (The original says: «{}»)", ' As they put it: "{}".', " („{}“)")[turn // 8 % 3].format(alien[turn // 32 % len(alien)].rstrip(".")[:60])
        made = clauses(said := a.rstrip() + quoted)
        return q, said, [answer] * len(made), made
    elif kind == "broken" and len(parts[-1]) > 20:
        last = parts[-1]
        broken = a[: a.rfind(last) + 8 + turn % (len(last) - 12)].rstrip()
        if broken[-1].isalnum() and len(made := clauses(broken)) == len(parts):
            return q, broken, tags[:-1] + [unfinished], made
    elif kind == "echo" and len(q.split()) > 4:
        said = (q.lower() if turn & 8 else q.upper(), "You asked: " + q, q.rstrip("?!. ") + ".", q + "\n" + FRAMES[turn // 16 % len(FRAMES)])[turn % 4]
        made = clauses(said)
        return q, said, [echo] * len(made), made
    elif kind == "repeating":
        if turn & 1:
            return q, a, tags, parts
        made = clauses(said := q + " " + a)
        return q, said, [echo] * (len(made) - 1) + [answer], made
    # other words in the same language, with and without numbers and codes
    other = _mirrored(a, False)
    if kind == "bare":
        other = re.sub(r"\s*\S*\d\S*(?=\s)", "", other)
        made = clauses(other)
    else:
        made = vocabulary.mirrored(parts, False, other)
    return q, other, [answer] * len(made), made


def weak_labels(x: Measured, rows: list[tuple], questions: dict[str | None, labels.Question]) -> tuple[list[list[int]], list[float], list[int]]:
    """(tags of the clauses, weight, language of the question if the pair is plain, else -1) of measured rows."""
    refusal, echo, void = 1, 2, 5
    contains = np.add.reduceat(np.append(x.contains, 0), np.minimum(x.starts, len(x.contains))) if len(rows) else []
    tags, weights, plain = [], [], []
    for j, (q, a, e, how) in enumerate(rows):
        n = int(x.lengths[j])
        question = questions.get(q)
        if question is None:
            if len(questions) > 50_000:
                questions.clear()
            question = questions[q] = labels.Question(q)
        plain.append(-1)
        if labels.placeholder(a, e):
            tags.append([void] * n)
            weights.append(8.0 if n == 1 else 2.0)
        elif contains[j] and labels.restated(question, a):
            tags.append([echo] * n)
            weights.append(2.0)
        else:
            got = labels.tags_of(question, a, how, x.parts[j], x.doubts[x.starts[j] : x.starts[j] + n]) if x.doubtful[j] else [0] * n
            odd = any(got)
            tags.append(got)
            weights.append((5.0 if question.language > 0 else 3.0) if refusal in got else 2.0 if odd else (3.0 if question.language > 0 else 1.0) * (1.0 if n == 1 else 0.25))
            if not odd and n:
                plain[-1] = question.language
    return tags, weights, plain


def blocks(known: dict[str, int], tails: cutoff.Tails, asked: dict[int, list[str]], shares: int):
    """(id, source, question, answer, error) to packed features: one row per batch and share of the rows,
    by the hash of their texts. A share has its rows' features, tags and weights, and the changed copies'."""
    import xxhash

    @_uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, asks = Vocabulary(known), {}
        for batch in batches:
            texts = list(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True))
            numbers = [xxhash.xxh64_intdigest(f"{q}\0{a}") for q, a, _ in texts]
            of: dict[int, list[int]] = {}
            for i, number in enumerate(numbers):
                of.setdefault(number % shares, []).append(i)
            pieces = [(share, at[i : i + 2000]) for share, at in of.items() for i in range(0, len(at), 2000)]
            while pieces:
                # some small pieces at once
                n = 1
                while n < len(pieces) and sum(len(at) for _, at in pieces[: n + 1]) <= 2000:
                    n += 1
                group, pieces = pieces[:n], pieces[n:]
                some = [i for _, at in group for i in at]
                x, rows, at_row, sizes, hows, defects = prepared(vocabulary, tails, [texts[i] for i in some], True)
                tags, weights, plain = weak_labels(x, rows, asks)
                copies, copy_tags, copy_parts, copy_of = [], [], [], []
                for j, (q, a, _, _) in enumerate(rows):
                    if plain[j] >= 0:
                        cq, ca, ct, cp = changed(q, a, x.parts[j], plain[j], asked, numbers[some[at_row[j]]] // shares, vocabulary)
                        if ct:
                            copies.append((cq, ca, None, cutoff.ending(without_question(ca, cq), tails)))
                            copy_tags.append(ct)
                            copy_parts.append(cp)
                            copy_of.append(j)
                y = Measured(vocabulary, copies, parts=copy_parts)
                ends = np.cumsum([0] + [len(at) for _, at in group]).tolist()
                row_ends = [bisect_left(at_row, i) for i in ends]
                copy_ends = [bisect_left(copy_of, j) for j in row_ends]
                per = lambda v, ends: [v[i:j] for i, j in pairwise(ends)]
                packed = lambda x, ends: pa.array([x.pack(i, j) for i, j in pairwise(ends)], pa.binary())
                flat = lambda tags, ends: pa.array([np.array([t for g in tags[i:j] for t in g], np.uint8).tobytes() for i, j in pairwise(ends)], pa.binary())
                index = pa.array(some)
                listed = lambda c: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c.take(index))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([share for share, _ in group], pa.int32()), listed(batch.column(0)), listed(batch.column(1)), pa.array(per(sizes, ends), pa.list_(pa.int32())), pa.array(per(hows, ends), pa.list_(pa.string())), pa.array(per(defects, ends), pa.list_(pa.string())),
                        pa.array([[i - before for i in at_row[j:k]] for before, (j, k) in zip(ends, pairwise(row_ends))], pa.list_(pa.int32())),
                        packed(x, row_ends), flat(tags, row_ends), pa.array([np.array(w, np.float32).tobytes() for w in per(weights, row_ends)], pa.binary()),
                        packed(y, copy_ends), flat(copy_tags, copy_ends), pa.array([np.full(j - i, COPY_WEIGHT, np.float32).tobytes() for i, j in pairwise(copy_ends)], pa.binary()),
                    ],
                    names=["share", "ids", "sources", "sizes", "hows", "defects", "at_row", "x", "tags", "weights", "copies", "copy_tags", "copy_weights"],
                )

    return run


def gradients(shared):
    """Packed features to their gradient, one row per 8,000 answers or batch, whichever is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, params = None, shared.value
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for i in range(0, batch.num_rows, 32):
                xs, tags, weights = (columns[k][i : i + 32] + columns[k + 3][i : i + 32] for k in range(3))
                got = gradient(Measured.unpack(xs), np.frombuffer(b"".join(tags), np.uint8).astype(np.int64), np.frombuffer(b"".join(weights), np.float32), params)
                sums = got if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
        if sums is not None:
            where = np.nonzero(sums[0].any(axis=1))[0].astype(np.int32)
            values = np.concatenate([sums[0][where].ravel(), *(g.ravel() for g in sums[1:])])
            yield pa.RecordBatch.from_arrays([pa.array([where.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["buckets", "sums"])

    return run


def _summed(rows: list) -> list[np.ndarray]:
    """The sum of the gradients that tasks have sent."""
    k = len(TAGS)
    sums = [np.zeros((BUCKETS, k)), np.zeros((DENSE, k)), np.zeros((k, k)), np.zeros(1)]
    for r in rows:
        where, values = np.frombuffer(r.buckets, np.int32), np.frombuffer(r.sums)
        at = len(where) * k
        sums[0][where] += values[:at].reshape(-1, k)
        for g in sums[1:]:
            g += values[at : at + g.size].reshape(g.shape)
            at += g.size
    return sums


def fitted(df: DataFrame, key: str | None, source: str | None, question: str, answer: str, error: str, most: int = STEP_ROWS, rounds: int = ROUNDS) -> tuple[Field, DataFrame | None, str | None]:
    """(field, blocks, their folder) of a table; the folder is to be removed with forget()."""
    spark = df.sparkSession
    ship(spark)
    n = df.count()
    named = [df[c].cast("string").alias(x) for c, x in ((question, "q"), (answer, "a"), (error, "e"))]
    known, tails, asked = word_tables(df.select(*named), n)
    of = [F.lit(None).cast("int") if c is None else df[c] for c in (key, source)]
    kinds = ["int" if c is None else df.schema[c].dataType.simpleString() for c in (key, source)]
    shares = max(1, min(rounds, n // max(most, 1)))
    folder = f"{checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    schema = f"share int, ids array<{kinds[0]}>, sources array<{kinds[1]}>, sizes array<int>, hows array<string>, defects array<string>, at_row array<int>, x binary, tags binary, weights binary, copies binary, copy_tags binary, copy_weights binary"
    packed = df.select(of[0].alias("id"), of[1].alias("source"), *named).mapInArrow(blocks(known, tails, asked, shares), schema)
    packed.write.partitionBy("share").option("compression", "zstd").parquet(folder)
    columns = schema.removeprefix("share int, ")
    out, gold, weights = seeds(asked, tails)
    written = Measured(Vocabulary(known), out)
    gold, weights = np.array([t for g in gold for t in g], dtype=np.int64), np.array(weights, dtype=np.float32) * max(1.0, n / shares / STEP_ROWS)
    ascent = Ascent()
    every = np.zeros(0, np.int64) if not n else None
    for i in range(rounds):
        sums = gradient(written, gold, weights, ascent.params)
        if every is None:
            shared = spark.sparkContext.broadcast(ascent.params)
            part = spark.read.schema(columns).parquet(f"{folder}/share={i % shares}").select("x", "tags", "weights", "copies", "copy_tags", "copy_weights")
            sums = [a + b for a, b in zip(sums, _summed(part.mapInArrow(gradients(shared), "buckets binary, sums binary").collect()), strict=True)]
            shared.destroy()
        ascent.step(sums)
    return Field(known, tails, tuple(ascent.params)), spark.read.schema(schema).parquet(folder), folder


def forget(df: DataFrame, folder: str) -> None:
    """Remove a folder of fitted()."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def train(df: DataFrame, question: str = "question", answer: str = "answer", error: str = "error", most: int = STEP_ROWS, rounds: int = ROUNDS) -> Field:
    """The field of a table, fitted on all of its rows and the seeds in ``rounds`` steps. A step
    takes one of at most ``rounds`` shares of the rows, of ``most`` rows at least; all shares are used, in turn."""
    field, _, folder = fitted(df, None, None, question, answer, error, most, rounds)
    forget(df, folder)
    return field


def decide(tags: np.ndarray, sizes: np.ndarray) -> str | None:
    """The defect that an answer's tags and their coverage add up to; not whether it was cut off."""
    total = sizes.sum()
    if not total:
        return None
    share = np.bincount(tags, weights=sizes, minlength=len(TAGS)) / total
    said = share[0] + share[4]
    if share[5] >= 0.9 or (share[5] > 0 and tags[0] == 5 and share[5] >= COVER):
        return "empty"
    if share[2] < 0.99 and share[3] / (1 - share[2]) >= COVER:
        return "language"
    if share[1] > 0:
        # a sentence may lead up to a refusal; whoever goes on to answer doesn't refuse
        at = int(np.argmax(tags == 1))
        if not np.isin(tags[at:], (0, 4)).any() and (tags[:at] == 0).sum() <= 1:
            return "refusal"
        if share[1] >= said * 4:
            return "refusal"
    if share[2] > 0 and said + share[1] + share[3] <= 0.1:
        return "copy"
    return None


def _visible(answer: str | None) -> bool:
    """Whether anything of an answer is visible: a letter or digit outside markup, or what is left of one."""
    return answer is not None and (answer[:1].isalnum() and "<" not in answer and "&" not in answer and "`" not in answer and "[" not in answer or "�" in answer or any(c.isalnum() for c in (labels._markup.sub(" ", answer) if "<" in answer or "&" in answer or "`" in answer or "[" in answer else answer)))


def prepared(vocabulary: Vocabulary, tails: cutoff.Tails, texts: list[tuple], screen: bool = False) -> tuple:
    """(features, rows for Measured, their places, sizes, endings, defects) of (question, answer, error):
    everything that can be said before the tags are known."""
    sizes, hows, defects, rows, at_row = [], [], [], [], []
    for i, (q, a, e) in enumerate(texts):
        sizes.append(len(a) if a else 0)
        if _visible(a):
            how = cutoff.ending(without_question(a, q), tails)
            rows.append((q, a, e, how))
            at_row.append(i)
            hows.append(how)
            defects.append(None)
        else:
            hows.append("empty")
            defects.append("empty")
    x = Measured(vocabulary, rows, screen)
    for j in np.nonzero(x.lengths == 0)[0]:
        i = at_row[j]
        hows[i] = "entity" if "�" in rows[j][1] else "empty"
        defects[i] = None if "�" in rows[j][1] else "empty"
    return x, rows, at_row, sizes, hows, defects


def judge(x: Measured, tags: np.ndarray, at_row: list[int], hows: list[str], defects: list[str | None]) -> None:
    """Endings and defects with what the tags say, in place."""
    upto = x.starts + x.lengths
    odd = np.add.reduceat(np.append(tags, 0), np.minimum(x.starts, len(tags)), dtype=np.int64) if len(at_row) else []
    for j in np.nonzero((x.lengths > 0) & (np.asarray(odd) > 0))[0] if len(at_row) else ():
        i, here = at_row[j], slice(x.starts[j], upto[j])
        defects[i] = decide(tags[here], x.letters[here])
        if defects[i]:
            hows[i] = "empty"
        elif tags[here][-1] == 4:
            hows[i] = cutoff.unfinished(hows[i])


def _told(ids: pa.Array, sources: pa.Array, sizes: list, hows: list, defects: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, sources, pa.array(sizes, pa.int32()), pa.array(hows, pa.string()), pa.array(defects, pa.string())], names=["id", "source", "size", "ending", "defect"])


def tagged(field: Field):
    """(id, source, question, answer, error) to (id, source, size, ending, defect)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(field.known)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                x, _, at_row, sizes, hows, defects = prepared(vocabulary, field.tails, list(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)))
                judge(x, field.tags(x), at_row, hows, defects)
                yield _told(batch.column(0), batch.column(1), sizes, hows, defects)

    return run


def unpacked(params: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Blocks (ids, sources, sizes, hows, defects, at_row, x) to (id, source, size, ending, defect)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field({}, cutoff.Tails(), params)
        for whole in batches:
            for start in range(0, whole.num_rows, 32):
                batch = whole.slice(start, 32)
                hows, defects = batch.column(3).flatten().to_pylist(), batch.column(4).flatten().to_pylist()
                at_row, before = [], 0
                for places, sizes in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    at_row += [before + p for p in places]
                    before += len(sizes)
                x = Measured.unpack(batch.column(6).to_pylist())
                judge(x, field.tags(x), at_row, hows, defects)
                yield _told(batch.column(0).flatten(), batch.column(1).flatten(), batch.column(2).flatten().to_pylist(), hows, defects)

    return run


def without_question(answer: str, question: str | None) -> str:
    """The answer without the question it may begin with."""
    q = (question or "").strip()
    a = answer.lstrip()
    if q and a[: len(q)].lower() == q.lower() and len(a) > len(q) + 2:
        return a[len(q) :].lstrip()
    return answer


def tags(df: DataFrame, key: str = "answer_id", source: str = "generator", question: str = "question", answer: str = "answer", error: str = "error", field: Field | None = None) -> DataFrame:
    """(id, source, size, ending, defect) of every row, written: how the answer ends, and its defect
    so far, which is null for good and for cut-off answers."""
    ship(df.sparkSession)
    kind, of = df.schema[key].dataType.simpleString(), df.schema[source].dataType.simpleString()
    told = f"id {kind}, source {of}, size int, ending string, defect string"
    if field is not None:
        rows = df.select(df[key].alias("id"), df[source].alias("source"), df[question].cast("string").alias("q"), df[answer].cast("string").alias("a"), df[error].cast("string").alias("e"))
        return cut(rows.mapInArrow(tagged(field), told))
    field, packed, folder = fitted(df, key, source, question, answer, error)
    rows = cut(packed.select("ids", "sources", "sizes", "hows", "defects", "at_row", "x").mapInArrow(unpacked(field.params), told))
    forget(df, folder)
    return rows


def defects(df: DataFrame, limits: DataFrame, key: str = "answer_id", source: str = "generator", question: str = "question", answer: str = "answer", error: str = "error", field: Field | None = None) -> DataFrame:
    """(id, defect), one row per defective id: empty, truncated, refusal, copy or language.

    Null and blank answers are empty, whatever the error says. A null or blank question has no
    language and no words, so its answers are neither copies nor in another language. Rows sent
    again under the same id count once; if they differ, the defect that is first in the alphabet
    is given. Very long answers are read whole. ``limits`` has (source, tokens), see cutoff.
    ``field`` is a fitted field; without one it is fitted on all rows.
    """
    rows = tags(df, key, source, question, answer, error, field)
    late = cutoff.cut_rows(rows.filter(F.col("defect").isNull()), limits).select("id", F.lit("truncated").alias("defect"))
    return rows.filter(F.col("defect").isNotNull()).select("id", "defect").unionByName(late).groupBy("id").agg(F.min("defect").alias("defect"))


def cut_answers(df: DataFrame, limits: DataFrame, key: str = "answer_id", source: str = "generator", question: str = "question", answer: str = "answer", error: str = "error", field: Field | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, shares): the ids (id, source) of answers that were cut off, once each, and per source
    (source, n_answers, n_cut, cut_share), where answers sent again under one id count once.

    Answers with another defect (empty, a refusal, the question again, another language) were not
    cut. Null sources are one source; cases of single columns are those of defects().
    """
    rows = tags(df, key, source, question, answer, error, field)
    found = cut(cutoff.cut_rows(rows.filter(F.col("defect").isNull()), limits).select("id", "source").distinct())
    every = rows.select("id", "source").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_answers"))
    late = found.groupBy(F.col("source").alias("__s")).agg(F.count(F.lit(1)).alias("n_cut"))
    shares = every.join(late, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "n_answers", F.coalesce("n_cut", F.lit(0)).cast("long").alias("n_cut"))
    return found, shares.withColumn("cut_share", F.col("n_cut") / F.col("n_answers"))

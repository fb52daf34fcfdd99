"""Texts cut off by a limit or in transfer.

Every text has a length and an ending. Lengths: per source, whole texts follow a log-normal
distribution (one for running text, one for texts without a finished sentence); what a limit cut is
right-censored and piles up at the limit, at one exact length (a field limit) or around one (a token
limit); what was lost in transfer stops anywhere. Limits, distributions and shares are fitted by
maximum likelihood on a histogram. Endings: a text's last characters give a kind, and its last word a
level, how rarely finished sentences of the same collection end with it. Kinds have prior odds; the
fit moves them, source by source. A text is cut if its censoring posterior, from its length at the
candidate limits and from its ending, is above one half: the same ending can be a cut one at a limit
and a whole one elsewhere.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

# Words and marks.
#: Marks that end a sentence, and marks that may close after them.
ENDS = ".!?。！？؟।॥…;："
CLOSERS = "\"'”’»›」』）)]}*_`>"
#: Abbreviations that stand before something, so a sentence doesn't end with them.
BEFORE = set("dr mr mrs ms prof insp lt capt ing st fr hr frau no nr nos fig figs sec secs abs art approx ca aprox pág pag vs cf eq vol ch est yr i.e e.g z.b d.h u.a z d bzw sr sra dra mme mlle m p pp n.º c.-à-d т.е стр σελ κ п.χ г".split())
#: Words that open or join and so never end an answer that is a phrase.
LEFT_OPEN = set(
    "the a an of to in on at by for from with and or but that which who as than into over after before because although while since whether is was are were has have had not "
    "der die das ein eine einen dem den des und oder aber dass weil obwohl von zu im am auf für mit bei nach ist war hat nicht und "
    "le la les un une des du de au aux et ou mais que qui dans sur sous avec pour par est a n'a c'est même si car "
    "el los las una del al y o pero que quien en sobre con para por es fue aunque porque según se no ".split()
)
#: Words that open a sentence and not a phrase that can stand alone.
SENTENCE_OPENERS = set(
    "who which what where why how did wer welche wann wo qui quel quelle quién qué in at on by for from since when while although unfortunately according as every neither both only if after before during with within under over roughly "
    "en au aux à selon depuis dans sur sous pour quand après avec según desde cerca por para con cuando aunque nach laut im am bei seit für obwohl wenn während aus mit von zu".split()
)
#: Share of texts that lose their end in transfer, before any text is seen.
TRANSFER = 0.02
#: Prior log odds of each kind of ending, cut against whole.
KIND_ODDS = {"empty": -20.0, "closed": -14.0, "item": -7.0, "phrase": -4.5, "whole": -4.5, "bare": 6.0, "begun": 8.0, "run": 9.0, "space": 10.0, "open": 12.0, "entity": 14.0}
#: Kinds of texts that hold no finished sentence: their lengths have a distribution of their own.
SHORT = ("item", "phrase", "bare", "begun", "whole")
#: Kinds whose last word is looked up.
WEIGHED = ("phrase", "bare", "begun", "run", "whole")
#: Log odds of the levels of last words; BROKEN is a beginning of known words that is none itself.
BROKEN = 4
LEVEL_ODDS = {-5: -7.0, -4: -5.5, -3: -4.0, -2: -2.5, -1: -1.0, 0: 0.0, 1: 0.7, 2: 1.5, 3: 2.5, BROKEN: 4.0}
#: A word is looked up if it is one of at least so many words, and seen twice: this bounds the table.
SEEN_IN = 500_000
#: Characters a token of a source's own tokenizer may have: the range searched for its limit.
PER_TOKEN = (1.5, 8.0)
#: Lengths up to this have bins of their own; longer ones have this many bins per unit of log length.
EXACT, BINS = 4096, 400

_entity = re.compile(r"(?:&(?:#\d{0,6}|#x[0-9a-fA-F]{0,6}|[A-Za-z]{1,8})?|<[/!A-Za-z][^<>\s]{0,40}(?:\s[^<>]{0,60})?|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?|�+|%[0-9A-Fa-f]?|\[[^\[\]]{0,40}\]\([^()\s]*)$")
_verbs = re.compile(r"\b(?:is|was|were|are|has|had|have|did|does|says?|said|names?|gives?|ended?|won|led|fell|refused|finished|reached|met|made|took|told|(?<!\d )points?|credits?|closed|began|could|cannot|can't|handled|wrote|went|kept|lists?|looked|moved|states|needs|holds|praises|blames|supplied|signed|asked|worked|counted|war|hat|lag|nennt|ging|stieg|blieb|schaffte|bewertete|begann|est|était|avait|fut|désigne|reste|compare|fue|iba|señala|sigue|calificó|logró|pasó|llega|anotó|terminó)\b", re.I)
_hour = re.compile(r"\d [ap]\.$")
_item = re.compile(r"\s*(?:[-*•–+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_emoji = re.compile(r"[\U0001F000-\U0001FAFF☀-➿⬀-⯿️‍]")
_spaceless = re.compile(r"[฀-๿຀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_sentence = re.compile(r"[.!?…][\"'”’»)\]]*\s|[。！？؟।]")
_word = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


class Tails:
    """How rarely finished sentences end with a word, from counts (word, ends, insides)."""

    def __init__(self, counts: list[tuple[str, int, int]] | None = None):
        counts = counts or []
        n_end, n_in = sum(e for _, e, _ in counts) + 1.0, sum(i for _, _, i in counts) + 1.0
        self.levels = {}
        for word, ends, insides in counts:
            ratio = math.log((insides + 0.5) / n_in) - math.log((ends + 0.5) / n_end)
            # few sightings say little
            ratio *= 1 - math.exp(-(ends + insides) / 4)
            self.levels[word] = int(max(-5 if len(word) > 2 else 0, min(3, round(ratio))))
        self.sorted = sorted(self.levels)

    def level(self, word: str) -> int:
        got = self.levels.get(word)
        if got is not None:
            return got
        if word.isalpha() and self.sorted:
            at = bisect.bisect_left(self.sorted, word)
            if at < len(self.sorted) and self.sorted[at].startswith(word):
                return BROKEN
        return 0


_no_tails = Tails()
_placed = re.compile(r"[^\W\d_]++\W++")
_letters = re.compile(r"[^\W\d_]+")


def count_tails(texts: list[str | None], seen: dict[str, list[int]]) -> None:
    """Add to (word: [ends, insides]): how often a word ends a finished sentence or stands in one."""
    placed: Counter = Counter()
    for text in texts:
        if text:
            placed.update(_placed.findall(text))
    for found, n in placed.items():
        word = _letters.match(found).group()
        after = found[len(word) :]
        word = word.lower()
        one = seen.get(word)
        if one is None:
            one = seen[word] = [0, 0]
        if after == " ":
            one[1] += n
        elif after[0] in ".!?…。！？؟।" and len(word) > 2 and word not in BEFORE:
            one[0] += n


def _tail_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (word, ends, insides) of every batch."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        count_tails(batch.column(0).to_pylist(), seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["word", "ends", "insides"])


def frequent(counts: DataFrame) -> Tails:
    """The table of last words from a written table of (word, ends, insides), a row per word."""
    total = counts.agg(F.sum(F.col("ends") + F.col("insides")).alias("n")).first().n or 0
    rows = counts.filter(F.col("ends") + F.col("insides") >= max(2.0, total / SEEN_IN)).select("word", "ends", "insides").collect()
    return Tails(sorted((tuple(r) for r in rows), key=lambda r: (-r[1] - r[2], r[0])))


def tails(df: DataFrame, text: str) -> Tails:
    """The table of last words of all rows."""
    ship(df.sparkSession)
    counts = df.select(df[text].cast("string").alias("t")).mapInArrow(_tail_counts, "word string, ends long, insides long")
    return frequent(cut(counts.groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("insides").alias("insides"))))


def ending(text: str | None, words: Tails = _no_tails) -> str:
    """How a text ends, as ``kind`` or ``kind:level``.

    ``empty``; ``closed`` (with a closing mark); ``item`` (a list entry, code or markup); ``phrase`` (a verbless phrase
    that can stand alone); ``whole`` (a script that needs no marks); ``bare`` (another verbless
    phrase); ``begun`` (a first sentence without an end); ``run`` (a later one); ``space`` (white
    space follows an unfinished sentence); ``open`` (a word or mark that something must follow);
    ``entity``. The level is that of the last word."""
    kind, last = _ending(text)
    if kind in WEIGHED and last and words.sorted:
        level = words.level(re.split("[-'’]", last)[-1])
        return f"{kind}:{level}" if level else kind
    return kind


def unfinished(symbol: str) -> str:
    """The symbol with the evidence that the clause tagger calls the last clause unfinished."""
    kind, _, level = symbol.partition(":")
    return f"{kind}:{min(int(level or 0) + 2, 3)}" if kind in WEIGHED and level != str(BROKEN) else symbol


def _ending(text: str | None) -> tuple[str, str]:
    t = (text or "").rstrip()
    if not t[:1].isalnum() and not any(c.isalnum() for c in t):
        return "entity" if "\ufffd" in t else "empty", ""
    m = _entity.search(t) if "&" in t or "<" in t or "[" in t or "\\" in t or "\ufffd" in t else None
    if m and m.start() > 0:
        found = m.group()
        if found[0] == "\ufffd" or found[0] in "\\[" or (found[0] == "&" and found != "&") or found[0] == "<":
            return "entity", ""
    core = t.rstrip(CLOSERS)
    if core and core[-1] in ENDS:
        if core[-1] == "." and not core.endswith(".."):
            word = (core[:-1].rsplit(None, 1)[-1:] or [""])[0].lower().lstrip("([{\"'«„“")
            if word in BEFORE and core is t:
                return "open", ""
        if core[-1] == "." and _hour.search(core, max(len(core) - 4, 0)):
            return "open", ""
        if core[-1] in ";：":
            return ("closed" if "\u0370" <= core[-2:-1] <= "\u03ff" else "open"), ""
        return "closed", ""
    if _emoji.search(t[-1]) or _item.match(t[t.rfind("\n") + 1 :]):
        return "item", ""
    if len(core) < len(t) and core:
        # closed by a quotation mark or bracket that was opened and holds a phrase, or markup
        return ("item" if not _verbs.search(core) or t[-1] in ")]}>*`" else "closed"), ""
    if _spaceless.search(t[-1]):
        return ("whole" if "฀" <= t[-1] <= "๿" or len(t) < 12 else "run"), ""
    if len(t) >= 12 and _spaceless.search(t, len(t) - 12):
        return ("run" if " " in t else "whole"), ""
    before = list(_sentence.finditer(t[:-1]))
    last = t[before[-1].end() :] if before else t
    words = _word.findall(last)
    if not words:
        return "closed", ""
    end = words[-1].lower()
    if t[-1] in ",-–:(" or end in LEFT_OPEN:
        return "open", ""
    if text != t:
        return "space", ""
    if before:
        return "run", end
    if words[0].lower() in SENTENCE_OPENERS or _verbs.search(last):
        return "begun", end
    return ("phrase" if _looks_complete(last, words) else "bare"), end


def _looks_complete(last: str, words: list[str]) -> bool:
    """Whether a verbless phrase can stand alone: a name, a code, a group, a group with a margin."""
    end = words[-1]
    if any(c.isdigit() for c in end) or (end[0].isupper() and len(end) > 2):
        return True
    if "," in last:
        rest = _word.findall(last[last.rfind(",") + 1 :])
        return len(rest) >= 2 and len(rest[-1]) > 1
    return len(end) > 3 or len(words) > 3 and len(end) == 3


def ending_rows(words: Tails):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = pa.array([len(t) if t else 0 for t in texts], pa.int32())
            how = pa.array([ending(t, words) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, how], names=["id", "source", "size", "ending"])

    return run


def endings(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(id, source, size, ending) of every row."""
    ship(df.sparkSession)
    kind, of = df.schema[key].dataType.simpleString(), df.schema[source].dataType.simpleString()
    words = tails(df, text)
    return df.select(df[key].alias("id"), df[source].alias("source"), df[text].cast("string").alias("t")).mapInArrow(ending_rows(words), f"id {kind}, source {of}, size int, ending string")


def prior_odds(symbol: str) -> float:
    """Log odds of an ending before the fit, cut against whole."""
    kind, _, level = symbol.partition(":")
    return KIND_ODDS[kind] + (LEVEL_ODDS[int(level)] if level else 0.0)


def _logit(p):
    return np.log(p) - np.log1p(-p)


def _beyond(z):
    """The normal distribution's upper tail, in its logistic form (the same in the plan)."""
    return 1 / (1 + np.exp(np.clip(1.702 * z, -60, 60)))


def _whole(x, mu, sigma):
    """Density of whole texts per unit of log length, with a heavy tail of a fiftieth."""
    z = (x - mu) / sigma
    return (0.98 * np.exp(-0.5 * z * z) + 0.02 / 3 * np.exp(-0.5 * z * z / 9)) / (sigma * math.sqrt(2 * math.pi))


def _transfer(x, mu, sigma):
    """Density per unit of log length of texts that stop anywhere before their end."""
    return np.exp(np.minimum(x - mu + sigma**2 / 2, 9.0)) * _beyond((x - mu + sigma**2) / sigma)


def _censored_mean(x, weight, mu, sigma, place, censored):
    """One step of the censored fit: mean and deviation, where ``censored`` texts are longer than ``place``."""
    total = weight.sum() + censored
    first, second = (weight * x).sum(), 0.0
    mean = var = 0.0
    if censored > 0:
        z = (place - mu) / sigma
        hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / max(0.5 * math.erfc(z / math.sqrt(2)), 1e-9)
        mean, var = mu + sigma * hazard, sigma**2 * max(1 + z * hazard - hazard**2, 0.0)
    new = (first + censored * mean) / total
    second = (weight * (x - new) ** 2).sum() + censored * (var + (mean - new) ** 2)
    return float(new), float(min(max(math.sqrt(second / total), 0.25), 3.0))


def fit(sizes: np.ndarray, symbols: list[str], counts: np.ndarray, limit: float | None, rounds: int = 30) -> dict:
    """Maximum likelihood of one source from numbers of texts by size and ending; ``limit`` in
    tokens, or None. Gives the log-normal parameters of running text (mu, sigma) and of short forms
    (mu_short, sigma_short), the exact limit (NaN if none) and the place of a token limit (log
    characters), its width, the shares of texts cut at either and in transfer, and log odds per ending."""
    sizes, counts = np.asarray(sizes, float), np.asarray(counts, float)
    x = np.log(np.maximum(sizes, 1.0))
    names, which = np.unique(np.array(symbols, dtype=object).astype(str), return_inverse=True)
    short = np.array([s.partition(":")[0] in SHORT for s in names])[which]
    prior = np.array([prior_odds(s) for s in names])
    n = counts.sum()
    seen = np.bincount(which, counts, len(names))
    expected = 1 / (1 + np.exp(-np.clip(prior + _logit(TRANSFER), -30, 30)))
    post = expected[which]
    odds = prior.copy()
    got = {"mu": 5.0, "sigma": 1.0, "mu_short": 3.3, "sigma_short": 0.7, "exact": math.nan, "place": math.nan, "width": 0.12, "p_exact": 0.0, "p_limit": 0.0, "p_transfer": TRANSFER}
    _limits(got, sizes, x, post * counts, limit)
    for _ in range(rounds):
        g = got
        place = math.log(g["exact"]) if g["p_exact"] > g["p_limit"] and not math.isnan(g["exact"]) else g["place"]
        at, around, lost = _parts(g, sizes, x)
        long_whole = _whole(x, g["mu"], g["sigma"])
        whole = np.where(short, _whole(x, g["mu_short"], g["sigma_short"]), long_whole)
        cut_part = g["p_exact"] * at + g["p_limit"] * around + g["p_transfer"] * lost
        p_whole = 1 - g["p_exact"] - g["p_limit"] - g["p_transfer"]
        logit = np.log(np.maximum(cut_part, 1e-12)) - np.log(np.maximum(p_whole * whole, 1e-12)) + odds[which]
        post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        c, w = post * counts, (1 - post) * counts
        share = c / np.maximum(cut_part, 1e-12)
        by_exact, by_limit, by_transfer = (share * g["p_exact"] * at).sum(), (share * g["p_limit"] * around).sum(), (share * g["p_transfer"] * lost).sum()
        got = dict(g)
        got["p_exact"], got["p_limit"] = float(by_exact / (n + 1)), float(by_limit / (n + 1))
        got["p_transfer"] = float((by_transfer + TRANSFER * 100) / (n + 100))
        for tail, of in (("", ~short), ("_short", short)):
            if w[of].sum() > 3:
                got["mu" + tail], got["sigma" + tail] = _censored_mean(x[of], w[of], g["mu" + tail], g["sigma" + tail], place, float(by_exact + by_limit) if not tail and not math.isnan(place) else 0.0)
        if by_limit > 3:
            spread = share * g["p_limit"] * around
            got["width"] = float(min(max(math.sqrt((spread * (x - g["place"]) ** 2).sum() / by_limit), 0.03), 0.2))
        # endings: as many rows of the prior as there are of the source, fifty at least
        weight = np.maximum(seen, 50.0)
        cut_of = np.bincount(which, c, len(names)) + weight * expected
        base = (c.sum() + 50 * TRANSFER) / (n + 50)
        odds = _logit(np.clip(cut_of / (seen + weight), 1e-9, 1 - 1e-9)) - _logit(base)
        # the data move a kind's odds by at most a quarter
        odds = np.sign(prior) * np.clip(np.sign(prior) * odds, np.abs(prior) * 0.75, np.abs(prior) * 1.25)
    return {**got, "odds": dict(zip(names.tolist(), odds.tolist(), strict=True)), "total": int(n)}


def _parts(g: dict, sizes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Densities per unit of log length of texts cut at the exact limit, around the token limit, in transfer."""
    at = np.where(sizes == g["exact"], sizes, 0.0)
    around = np.zeros_like(x) if math.isnan(g["place"]) else np.exp(-0.5 * ((x - g["place"]) / g["width"]) ** 2) / (g["width"] * math.sqrt(2 * math.pi))
    return at, around, _transfer(x, g["mu"], g["sigma"])


def _limits(got: dict, sizes: np.ndarray, x: np.ndarray, likely: np.ndarray, limit: float | None) -> None:
    """The candidate limits: the length with the most surplus of likely cut texts over its
    neighbours, and the densest place of the others within what the token limit can hold."""
    total = likely.sum()
    if total < 5:
        return
    values, inverse = np.unique(sizes, return_inverse=True)
    mass = np.bincount(inverse, likely)
    order = np.cumsum(np.concatenate([[0.0], mass]))
    lo, hi = np.searchsorted(values, values * 0.9), np.searchsorted(values, values * 1.1, side="right")
    around = (order[hi] - order[lo] - mass) / np.maximum(0.2 * values - 1, 1.0)
    surplus = np.where(values <= EXACT, mass * np.log(np.maximum(mass, 1e-9) / (around + 0.5)), -1.0)
    best = int(np.argmax(surplus))
    rest = likely.copy()
    if mass[best] >= 3 and mass[best] > 4 * (around[best] + 0.5):
        got["exact"], got["p_exact"] = float(values[best]), float(mass[best] / total * 0.1)
        rest = np.where(sizes == values[best], 0.0, rest)
    c = rest.sum()
    if c < 5:
        return
    low, high = (math.log(limit * PER_TOKEN[0]), math.log(limit * PER_TOKEN[1])) if limit else (x.min(), x.max())
    flat, top = 1.0 / max(x.max() - x.min(), 1.0), -math.inf
    for place in np.arange(low, high + 0.02, 0.02):
        kernel = np.exp(-0.5 * ((x - place) / 0.12) ** 2) / (0.12 * math.sqrt(2 * math.pi))
        w = 0.5
        for _ in range(8):
            p = w * kernel / (w * kernel + (1 - w) * flat)
            w = min(max(float((p * rest).sum() / c), 1e-6), 1 - 1e-6)
        score = float((rest * np.log(w * kernel + (1 - w) * flat)).sum())
        if score > top:
            top, got["place"], got["p_limit"] = score, float(place), w * 0.05


PARAMETERS = ("mu", "sigma", "mu_short", "sigma_short", "exact", "place", "width", "p_exact", "p_limit", "p_transfer")


def fitted(ends: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, PARAMETERS, odds, total) of every source, from all rows of (source, size, ending), by a histogram whose size
    doesn't grow with the rows; ``limits`` has (source, tokens)."""
    kind = ends.schema["source"].dataType.simpleString()
    size = F.col("size").cast("double")
    bins = F.when(size <= EXACT, size).otherwise(F.round(F.exp(F.floor(F.log(size) * BINS) / BINS), 1))
    histogram = ends.filter(F.col("ending") != "empty").groupBy("source", bins.alias("bin"), "ending").agg(F.count(F.lit(1)).alias("n"))
    tokens = limits.groupBy(F.col("source").alias("__s")).agg(F.max("tokens").cast("double").alias("tokens"))
    histogram = histogram.join(tokens, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        limit = rows["tokens"].iloc[0]
        got = fit(rows["bin"].to_numpy(), rows["ending"].tolist(), rows["n"].to_numpy(), None if pd.isna(limit) or limit <= 0 else float(limit))
        got = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in got.items()}
        return pd.DataFrame([{"source": rows["source"].iloc[0], **got}])

    return histogram.groupBy("source").applyInPandas(one, f"source {kind}, " + ", ".join(f"{p} double" for p in PARAMETERS) + ", odds map<string,double>, total long")


#: Sources whose fits are broadcast; with more of them the fits are joined in a shuffle.
BROADCAST_SOURCES = 10_000


def scored(ends: DataFrame, fits: DataFrame) -> DataFrame:
    """(id, source, size, ending, length_odds, odds): log odds that each text was cut, from its length alone
    and from both. ``fits`` is a written table. The formulas are those of fit()."""
    c = F.col
    x = F.log(F.greatest(c("size"), F.lit(1)).cast("double"))
    root = math.sqrt(2 * math.pi)

    def whole(mu: str, sigma: str):
        z = (x - c(mu)) / c(sigma)
        return (F.exp(-0.5 * z * z) * 0.98 + F.exp(z * z / -18) * (0.02 / 3)) / (c(sigma) * root)

    short = F.substring_index("ending", ":", 1).isin(*SHORT)
    density = F.when(short, whole("mu_short", "sigma_short")).otherwise(whole("mu", "sigma"))
    z = (x - c("mu") + c("sigma") * c("sigma")) / c("sigma")
    lost = F.exp(F.least(x - c("mu") + c("sigma") * c("sigma") / 2, F.lit(9.0))) / (1 + F.exp(F.least(F.greatest(z * 1.702, F.lit(-60.0)), F.lit(60.0))))
    d = (x - c("place")) / c("width")
    around = F.coalesce(F.exp(-0.5 * d * d) / (c("width") * root), F.lit(0.0))
    at = F.when(c("size") == c("exact"), c("size").cast("double")).otherwise(0.0)
    lost_part = c("p_exact") * at + c("p_limit") * around + c("p_transfer") * lost
    p_whole = 1 - c("p_exact") - c("p_limit") - c("p_transfer")
    length = F.log(F.greatest(lost_part, F.lit(1e-12))) - F.log(F.greatest(p_whole * density, F.lit(1e-12)))
    of = fits.withColumnRenamed("source", "__f").withColumnRenamed("odds", "table")
    if fits.count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    joined = ends.join(of, c("source").eqNullSafe(c("__f")), "left").withColumn("length_odds", length)
    return joined.select("id", "source", "size", "ending", "length_odds", (c("length_odds") + F.coalesce(F.element_at("table", c("ending")), F.lit(-20.0))).alias("odds"))


def cut_rows(ends: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of (id, source, size, ending) that were cut off, with their odds."""
    ends = ends.select("id", "source", "size", "ending")
    return scored(ends, cut(fitted(ends, limits))).filter(F.col("odds") > 0)


def cut_off(df: DataFrame, limits: DataFrame, key: str = "answer_id", source: str = "generator", text: str = "answer") -> DataFrame:
    """(id, source, size, ending, length_odds, odds) of the texts that were cut off: odds above 0.

    ``limits`` has (source, tokens); a source without one, or with null, is searched for a limit
    over all lengths. Null, empty and mark-only texts were not cut. Null sources are one source.
    Repeated rows give repeated rows; very long texts are read from their end. Ties don't occur.
    """
    return cut_rows(cut(endings(df, key, source, text)), limits)

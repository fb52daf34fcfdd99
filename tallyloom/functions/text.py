"""Text, token and hash expressions. All are built-in expressions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of discourse fillers, in the order in which they are tried.
FILLERS = (
    " The finding was filed",
    " The entry appears",
    " The record was cross-checked",
    " The measurement was repeated",
    " The result was entered",
    " The observation was dated",
)
#: Fixed value: vocabulary that aligns a passage with the queries.
ALIGN = "performed better outcome requirements successfully documented accurately recorded completed satisfied assessed criteria".split()
#: Opposite words, exchanged by invert_stance.
OPPOSITES = (("favourable", "unfavourable"), ("highest", "lowest"), ("better", "worse"), ("stronger", "weaker"), ("met", "missed"), ("passed", "failed"))
#: FNV-1a of 32 bits.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def fnv1a(word: Column) -> Column:
    """FNV-1a of the characters' codes; an interpreted fold, so hash distinct words, then join."""
    return F.aggregate(
        F.filter(F.split(word, ""), lambda c: c != ""),
        F.lit(FNV_START).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long")),
    )


def hash_place(h: Column, width: int) -> Column:
    return F.pmod(h, F.lit(width)).cast("int")


def hash_sign(h: Column) -> Column:
    """+1 or -1 from bit 16."""
    return F.when(F.shiftright(h, 16) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def strip_filler(text: Column) -> Column:
    """Cut at the first marker that occurs, in the markers' order, and trim the end; without one,
    trim both ends."""
    out = F.trim(text)
    for marker in reversed(FILLERS):
        at = F.instr(text, marker)
        out = F.when(at > 0, F.rtrim(F.substring(text, F.lit(1), at - 1))).otherwise(out)
    return out


def align_size(i: Column, n: Column, strength: float = 1.0, least: float = 0.0) -> Column:
    """Number of alignment words of passage i of n; halves round to even."""
    low = F.lit(least) if least > 0 else F.lit(1.0) / n
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), low))
    share = F.when(n <= 1, F.lit(1.0)).otherwise(low + (1 - low) * i / (n - 1)) * F.lit(max(0.0, min(1.0, strength)))
    return F.greatest(F.lit(1), F.bround(share * len(ALIGN), 0).cast("int"))


def align_words(i: Column, n: Column, strength: float = 1.0, least: float = 0.0) -> Column:
    return F.array_join(F.slice(F.array(*[F.lit(w) for w in ALIGN]), F.lit(1), align_size(i, n, strength, least)), " ")


def parse_choice(text: Column) -> Column:
    """The first stand-alone A or B of an answer; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(text)), r"(?<![\p{L}\p{N}_])([AB])(?![\p{L}\p{N}_])", 1), F.lit(""))


def parse_yes_no(text: Column) -> Column:
    """True for an answer that begins with yes, false for no, else null."""
    head = F.upper(F.trim(text))
    return F.when(head.startswith("YES"), F.lit(True)).when(head.startswith("NO"), F.lit(False))


def format_context(texts: Column) -> Column:
    """Numbered lines "[1] text" of an ordered array."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer in one sentence."))


def choice_prompt(question: Column, context: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nA) "), a, F.lit("\nB) "), b, F.lit("\nReply with A or B only."))


def invert_stance(text: Column) -> Column:
    """Exchange opposite words at once, so that no replacement undoes another."""
    out = text
    for i, (a, b) in enumerate(OPPOSITES):
        for x, y in ((a, b), (a.capitalize(), b.capitalize())):
            hold = f"\u0001{i}\u0002"
            out = F.regexp_replace(out, rf"\b{x}\b", hold)
            out = F.regexp_replace(out, rf"\b{y}\b", x)
            out = F.replace(out, F.lit(hold), F.lit(y))
    return out


def shorten(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, for reports."""
    return F.substring(F.regexp_replace(text, "\n", " "), 1, most)


def plain_group(group: Column) -> Column:
    """One spelling per group: lower case, letters only; null for neutral."""
    return F.nullif(F.regexp_replace(F.lower(group), "[^a-z]", ""), F.lit(""))

"""Near-duplicate texts by Golay-code fuzzy hashing.

A text's distinct words are projected onto segments of 23 numbers. The signs of a segment are a word
of the perfect binary Golay code [23, 12, 7] with errors; small edits flip the signs whose numbers
are small. So each segment is decoded several times, with its least reliable signs flipped in every
combination, and the nearest codewords (12 bits each) are kept. Two segments form a block; a block's
nearest pairs of codewords are its keys. By the pigeonhole principle the flipped signs of an edited
text can't be many in every block, so similar texts share a key in some block. Texts are joined on
(block, key); the number of word pairs and a sketch of small min-hashes, carried in the same row,
drop most chance meetings inside the join, a longer sketch joined by id drops most of the rest, and
what is left is checked exactly on the whole texts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, release, ship

#: Exact similarity from which two texts are a pair.
SIMILARITY = 0.5
#: Blocks of two segments each, keys per block, signs flipped per segment.
BLOCKS, KEYS, FLIPS = 11, 4, 4
#: Feature-hashing width ahead of the projection.
WIDTH = 512
#: Min-hashes of 2 bits in a key row, and how many of them similar texts share at least: by the
#: binomial law 8 of 10,000 pairs at the limit share fewer, and 1 of a million at 0.6.
SHORT, SHORT_ALIKE = 47, 19
#: Min-hashes of 1 bit in the two words of the longer sketch; the least weighted number alike of both
#: sketches (4 and 3 are their log-likelihood ratios against unlike texts): 7 of 10,000 at the limit.
LONG, WEIGHTS, ALIKE = 128, (4, 3), 342
#: Steps of the number of word pairs per doubling; of similar texts none has more than twice the other's.
STEPS = 4
#: Numbers in the place of the block in the two rows of a text's longer sketch.
SKETCH_ROWS = (14, 15)
#: Bits of the filter that keeps texts without candidates out of the check's shuffle.
FILTER_BITS = 1 << 24
#: Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
SEED = 20260101

#: Rows of keys that a join task should hold.
ROWS_A_TASK = 1_000_000

_words = re.compile(r"[^\W_]+").findall
_spaces = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; plain ASCII texts take a faster way to the same."""
    return text.translate(_spaces).split() if text.isascii() else _words(text)


_bytes = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str) -> list[bytes] | list[str]:
    """The words of the lower-cased text; as bytes where it is plain ASCII, which have the same hashes."""
    return text.encode().translate(_bytes).split() if text.isascii() else _words(text.lower())



def _digit(word: str | bytes) -> bool:
    return any(48 <= c < 58 for c in word) if isinstance(word, bytes) else any(c.isdigit() for c in word)


def _remainder(value: int) -> int:
    for bit in range(22, 10, -1):
        if value >> bit & 1:
            value ^= GOLAY << (bit - 11)
    return value


class Golay:
    """Decoding by syndrome: every 23-bit word has exactly one codeword within distance 3."""

    def __init__(self):
        self.high = np.array([_remainder(i << 11) for i in range(4096)], dtype=np.int32)
        self.error = np.zeros(2048, dtype=np.int32)
        for k in range(1, 4):
            for places in itertools.combinations(range(23), k):
                e = sum(1 << p for p in places)
                self.error[_remainder(e)] = e

    def decode(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.error[self.high[words >> 11] ^ (words & 2047)]


def nearest(code: Golay, margins: np.ndarray, keep: int, flips: int = FLIPS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``keep`` nearest codewords of each row of 23 numbers: 12-bit indices and costs.

    The cost of a codeword is the sum of the absolute numbers whose signs it changes; missing
    codewords cost infinity.
    """
    size = np.abs(margins)
    word = ((margins > 0).astype(np.float32) @ (2.0 ** np.arange(23)).astype(np.float32)).astype(np.int32)  # below 2^24: exact
    weak = (1 << np.argpartition(size, flips, axis=1)[:, :flips]).astype(np.int32)
    tries = np.zeros((len(word), 1 << flips), dtype=np.int32)
    for i in range(flips):
        tries[:, (np.arange(1 << flips) >> i & 1).astype(bool)] ^= weak[:, i : i + 1]
    found = code.decode(word[:, None] ^ tries)
    differs = np.ascontiguousarray(found ^ word[:, None]).view(np.uint8).reshape(len(word), -1, 4)
    bits = np.unpackbits(differs, axis=2, count=23, bitorder="little")
    cost = np.matmul(bits.astype(np.float32), size[:, :, None].astype(np.float32))[:, :, 0]
    order = np.argsort(cost, axis=1)
    found, cost = np.take_along_axis(found, order, 1), np.take_along_axis(cost, order, 1)
    # equal codewords have equal costs and stand side by side: take the first of each
    place = np.tile(np.arange(1 << flips, dtype=np.int8), (len(word), 1))
    place[:, 1:][found[:, 1:] == found[:, :-1]] = 127
    place = np.sort(place, axis=1)[:, :keep]
    missing = place == 127
    place[missing] = 0
    index, costs = np.take_along_axis(found, place, 1) >> 11, np.take_along_axis(cost, place, 1)
    costs[missing] = np.inf
    return index.astype(np.int64), costs


class Fingerprints:
    """Words to numbers, texts to keys. One object in a worker process."""

    REMEMBERED = 400_000

    def __init__(self):
        import xxhash

        rng = np.random.default_rng(SEED)
        self.hash = xxhash.xxh64_intdigest
        self.code = Golay()
        self.project = rng.standard_normal((WIDTH, 23 * 2 * BLOCKS)).astype(np.float32)
        self.factors = (rng.integers(1, 2**32, SHORT + LONG, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str | bytes, int] = {}
        self.hashes = np.zeros(1 << 14, np.uint64)
        self.weights = np.zeros(1 << 14, np.float32)

    def add(self, word: str | bytes) -> int:
        n = self.number[word] = len(self.number)
        if n == len(self.hashes):
            self.hashes, self.weights = np.concatenate([self.hashes] * 2), np.concatenate([self.weights] * 2)
        h = self.hashes[n] = self.hash(word)
        # longer words and numbers tell texts apart better
        weight = (min(len(word), 6) + 1) / 7 * (1.6 if _digit(word) else 1.0)
        self.weights[n] = weight if int(h) >> 40 & 1 else -weight
        return n

    def rows(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text number, packed key, sketch) of the texts with at least two words. A packed key has,
        from above, the block, 24 bits of codewords, 6 bits of the number of word pairs and 30 bits
        of the short sketch, the rest of which is in the other word. Two rows of every text have the
        longer sketch instead, under the block numbers SKETCH_ROWS."""
        if len(self.number) > self.REMEMBERED:
            self.forget()
        get, add = self.number.get, self.add
        flat: list[int] = []
        once: list[int] = []
        sizes, distinct, which = [], [], []
        for i, text in enumerate(texts):
            words = tokens(text)
            found = list(map(get, words))
            if None in found:
                found = [n if (n := get(w)) is not None else add(w) for w in words]
            if len(found) > 1:
                flat += found
                sizes.append(len(found))
                found = set(found)
                once += found
                distinct.append(len(found))
                which.append(i)
        if not which:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        n = len(which)
        size = np.array(sizes)
        ids = np.array(flat)
        hashes = self.hashes
        of = hashes[ids]

        pairs = (of[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ of[1:]) * np.uint64(0xD6E8FEB86659FD93)
        pairs = (np.delete(pairs, np.cumsum(size)[:-1] - 1) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(size - 1)[:-1]])
        least = np.empty((SHORT + LONG, n), np.uint32)
        for k, f in enumerate(self.factors):
            np.minimum.reduceat(pairs * f, starts, out=least[k])
        least *= np.uint32(0x9E3779B1)
        # distinct pairs of a text: its sorted pairs, without repeats
        order = np.sort(np.repeat(np.arange(n, dtype=np.uint64), size - 1) << np.uint64(32) | pairs)
        count = np.bincount((order[np.concatenate([[True], order[1:] != order[:-1]])] >> np.uint64(32)).astype(np.int64), minlength=n)
        step = np.minimum(np.floor(np.log2(count) * STEPS), 63).astype(np.uint64)
        two, one = (least[:SHORT] >> np.uint32(30)).astype(np.uint64), (least[SHORT:] >> np.uint32(31)).astype(np.uint64)
        low, short, long = step << np.uint64(30), np.zeros(n, np.uint64), [np.zeros(n, np.uint64) for _ in SKETCH_ROWS]
        for k in range(SHORT):
            if k < 15:
                low |= two[k] << np.uint64(2 * k)
            else:
                short |= two[k] << np.uint64(2 * (k - 15))
        for k in range(LONG):
            long[k // 64] |= one[k] << np.uint64(k % 64)

        row, word = np.repeat(np.arange(n), distinct), np.array(once)
        cell = row * WIDTH + (hashes[word] % np.uint64(WIDTH)).astype(np.int64)
        features = np.bincount(cell, weights=self.weights[word], minlength=n * WIDTH).reshape(n, WIDTH)
        numbers = features.astype(np.float32) @ self.project

        keys = np.empty((n, BLOCKS, KEYS), dtype=np.int64)
        used = np.empty((n, BLOCKS, KEYS), dtype=bool)
        for at in range(0, n, 128):  # as many as stay in the processor's cache
            part = slice(at, at + 128)
            index, cost = nearest(self.code, numbers[part].reshape(-1, 23), 3)
            index, cost = index.reshape(-1, BLOCKS, 2, 3), cost.reshape(-1, BLOCKS, 2, 3)
            both = (index[:, :, 0, :, None] << 12 | index[:, :, 1, None, :]).reshape(-1, BLOCKS, 9)
            costs = (cost[:, :, 0, :, None] + cost[:, :, 1, None, :]).reshape(-1, BLOCKS, 9)
            best = np.argsort(costs, axis=2, kind="stable")[:, :, :KEYS]
            keys[part] = np.take_along_axis(both, best, 2)
            used[part] = np.isfinite(np.take_along_axis(costs, best, 2))
        keys |= (np.arange(BLOCKS) << 24)[None, :, None]
        keys, used = keys.reshape(n, -1), used.reshape(n, -1)
        packed = keys << 36 | low.astype(np.int64)[:, None]
        every, sketch = (np.repeat(x, BLOCKS * KEYS)[used.ravel()] for x in (np.array(which), short.view(np.int64)))
        # spread over the tasks of the key shuffle like the keys
        spread = (short * np.uint64(0x9E3779B97F4A7C15) ^ low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) << np.uint64(36)
        marks = [(spread | np.uint64(b << 60)).view(np.int64) for b in SKETCH_ROWS]
        return (
            np.concatenate([every, *[np.array(which)] * len(SKETCH_ROWS)]),
            np.concatenate([packed[used], *marks]),
            np.concatenate([sketch, *[x.view(np.int64) for x in long]]),
        )


_worker: list[Fingerprints] = []


def _fingerprints() -> Fingerprints:
    if not _worker:
        _worker.append(Fingerprints())
    return _worker[0]


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, copy, text) to (id, packed, sketch); of equal texts only a partition's first has rows."""
    maker = _fingerprints()
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            fresh = []
            for i, c in enumerate(part.column(1).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            if len(seen) > 2_000_000:
                seen.clear()
            take = pa.array(fresh, pa.int64())
            which, packed, sketch = maker.rows(part.column(2).take(take).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take).take(pa.array(which)), pa.array(packed), pa.array(sketch)], names=["id", "packed", "sketch"])


def _differ(x: Column, ones: int) -> Column:
    """How many groups of two bits of an XOR are not zero."""
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(ones)))


def candidates(docs: DataFrame, n_docs: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of (id, copy, text) that share a key and enough of their sketches;
    ``n_docs`` is about how many documents there are, counted if not given."""
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (docs.count() if n_docs is None else n_docs) * BLOCKS * KEYS // ROWS_A_TASK)
    key = F.shiftright("packed", 36)
    rows = docs.select("id", "copy", "text").mapInArrow(key_rows, f"id {kind}, packed long, sketch long")
    rows = rows.filter("id is not null and packed is not null and sketch is not null").repartition(tasks, key)  # all true: what each side would infer for itself
    left = rows.select(F.col("id").alias("a"), F.col("packed").alias("pa"), F.col("sketch").alias("sa"))
    right = rows.select(F.col("id").alias("b"), F.col("packed").alias("pb"), F.col("sketch").alias("sb"))
    block = lambda c: F.shiftrightunsigned(c, 60)
    pa_pb = F.col("pa").bitwiseXOR(F.col("pb"))
    differ = _differ(pa_pb.bitwiseAND(F.lit((1 << 30) - 1)), 0x15555555) + _differ(F.col("sa").bitwiseXOR(F.col("sb")), 0x5555555555555555)
    # conditions on both sides stay above the shuffle, so that there is one for all
    same = (F.shiftright("pa", 36) == F.shiftright("pb", 36)) & (block("pa") + block("pb") < 2 * SKETCH_ROWS[0])
    step = lambda c: F.shiftright(c, 30).bitwiseAND(F.lit(63))
    near = F.abs(step("pa") - step("pb")) <= STEPS + 1
    # both sides read one shuffle, by key, in as many tasks as keep a side small; neither is broadcast
    met = left.join(right.hint("shuffle_hash"), same & (F.col("a") < F.col("b")) & near & (differ <= SHORT - SHORT_ALIKE)).select("a", "b", differ.alias("differ"))
    # the longer sketches come out of the same shuffle
    n = len(SKETCH_ROWS)
    above = block("packed") + F.floor(F.rand(0)) >= SKETCH_ROWS[0]  # a random nothing, or the filter would move below the shuffle and repeat it
    longer = rows.filter(above).groupBy("id").agg(*[F.max(F.when(block("packed") == b, F.col("sketch"))).alias(f"s{i}") for i, b in enumerate(SKETCH_ROWS)])
    for side in ("a", "b"):
        met = met.join(longer.select(F.col("id").alias(side), *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(n)]), side)
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(n)), F.lit(0))
    least = WEIGHTS[0] * (SHORT - F.col("differ")) + WEIGHTS[1] * (LONG - differ)
    return met.filter(least >= ALIKE).select("a", "b").distinct()


def similarity(a: str, b: str) -> float:
    """Shared distinct pairs of adjacent words, divided by all."""
    u, v = words_of(a.lower()), words_of(b.lower())
    x, y = set(zip(u, u[1:])), set(zip(v, v[1:]))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x and y else 0.0


def _checked(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}  # exact within this run: every word has its own number
        known: dict[object, frozenset[int]] = {}

        def pairs_of(key: object, text: str) -> frozenset[int]:
            got = known.get(key)
            if got is None:
                ids = [number.setdefault(w, len(number)) for w in words_of(text.lower())]
                got = frozenset([x << 32 | y for x, y in zip(ids, ids[1:])])
                if len(known) > 20_000:
                    known.clear()
                known[key] = got
            return got

        for batch in batches:
            if len(number) > 1_000_000:
                number, known = {}, {}
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep, sims = [], []
            for i in range(len(a)):
                x, y = pairs_of(a[i], ta[i]), pairs_of(b[i], tb[i])
                both = len(x & y)
                if both and (s := both / (len(x) + len(y) - both)) >= limit:
                    keep.append(i)
                    sims.append(s)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def _bit(column: str) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def checked(pairs: DataFrame, docs: DataFrame, limit: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose whole texts are similar enough.

    Only texts that occur in a pair are shuffled; a bitmap of at most FILTER_BITS bits (262,144
    rows of 64 bits, whatever the data) keeps nearly all others out.
    """
    kind = docs.schema["id"].dataType.simpleString()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    slot, bit = _bit("id")
    bitmap = ids.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    texts = docs.select("id", "text", slot.alias("slot"), bit.alias("bit")).join(F.broadcast(bitmap), "slot").filter(F.expr("shiftright(bits, bit) & 1") == 1).select("id", "text")
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_checked(limit), f"a {kind}, b {kind}, similarity double")


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, copy, text) of the rows with a key and at least two words; ``copy`` is alike for texts
    that differ at most in capitals."""
    rows = df.filter(F.col(key).isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]"))
    return rows.select(F.col(key).alias("id"), F.xxhash64(F.lower(F.col(text))).alias("copy"), F.col(text).alias("text"))


def _also(text: str) -> Column:
    """A second, independent hash of a text with its length: with ``copy``, 96 bits and the length."""
    return F.concat_ws(" ", F.crc32(F.lower(F.col(text))), F.length(text))


def copies(docs: DataFrame) -> DataFrame:
    """(id, first) of every document whose text repeats that of a document with a smaller id."""
    docs = docs.select("id", "copy", _also("text").alias("also"))
    firsts = docs.groupBy("copy", "also").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("copy", "also", "first")
    return docs.join(firsts, ["copy", "also"]).filter(F.col("id") > F.col("first")).select("id", "first")


def distinct_pairs(df: DataFrame, key: str = "ord", text: str = "text", limit: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies): similar pairs (a, b, similarity) of different texts, each text by
    the smallest id that has it, and the (id, first) rows of the others. Both are written tables."""
    docs = prepared(df, key, text)
    twins = cut(copies(docs))
    met = candidates(docs, df.count())  # of a parquet table, read from its footers
    for side in ("a", "b"):
        met = met.join(twins.select(F.col("id").alias(side), F.col("first").alias(f"f{side}")), side, "left")
    a, b = F.coalesce("fa", "a"), F.coalesce("fb", "b")
    met = met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") < F.col("b"))
    met = cut(met.distinct())
    release(docs.sparkSession)  # the key shuffle is done with
    return cut(checked(met, docs, limit)), twins


def similar_pairs(df: DataFrame, key: str = "ord", text: str = "text", limit: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity), a < b: every found pair of rows, copies of the same text included.

    The key must be unique. Rows with a null key, null or blank text or fewer than two words are in
    no pair. Extra columns are not read; empty tables give no rows.
    """
    pairs, twins = distinct_pairs(df, key, text, limit)
    firsts = twins.select("first").distinct()
    members = twins.select("first", "id").unionByName(firsts.select("first", F.col("first").alias("id")))
    out = pairs
    for side in ("a", "b"):
        out = out.join(members.select(F.col("first").alias(side), F.col("id").alias(f"m{side}")), side, "left")
    x, y = F.coalesce("ma", "a"), F.coalesce("mb", "b")
    out = out.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "similarity")
    inside = members.alias("m").join(members.alias("n"), (F.col("m.first") == F.col("n.first")) & (F.col("m.id") < F.col("n.id")))
    return out.unionByName(inside.select(F.col("m.id").alias("a"), F.col("n.id").alias("b"), F.lit(1.0).alias("similarity")))


def groups(df: DataFrame, key: str = "ord", text: str = "text", limit: float = SIMILARITY) -> DataFrame:
    """(key, group, links): one row per document with a similar one; ``group`` is the smallest key
    of its connected documents, ``links`` the number of different texts similar to its own.

    Labels spread along links, and along the links of labels, until none changes: a number of
    rounds that grows with the logarithm of the longest chain. Each round is a written table.
    """
    pairs, twins = distinct_pairs(df, key, text, limit)
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.min("b").alias("low"))
    labels = cut(links.select(F.col("a").alias("id"), F.least("a", "low").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = cut(step.join(jump, "next", "left").select("id", "old", F.least("next", F.coalesce("far", "next")).alias("label")))
        labels = new.select("id", "label")
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            break
    known = labels.join(links.select(F.col("a").alias("id"), "links"), "id")
    firsts = twins.select(F.col("first").alias("id")).distinct()
    known = known.join(firsts, "id", "full_outer").select("id", F.coalesce("label", "id").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    rest = twins.join(known.select(F.col("id").alias("first"), "label", "links"), "first").select("id", "label", "links")
    return known.unionByName(rest).select(F.col("id").alias(key), F.col("label").alias("group"), F.col("links").cast("long").alias("links"))

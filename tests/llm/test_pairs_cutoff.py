import random
import re

import numpy as np
import pytest

from tallyloom.llm import cutoff, labels, pairs

Q = "Which crew met the spring target at the river depot?"
CASES = [
    (Q, None, None, "empty"),
    (Q, " \n​", "", "empty"),
    (Q, "<p></p>", None, "empty"),
    (Q, "n/a", "HTTP 429: slow down", "empty"),
    (Q, "[error] api:x: TimeoutError: timed out", None, "empty"),
    (Q, "Sorry, I must decline to pick a winner here. Please ask something else.", None, "refusal"),
    (Q, "You ask about two groups. I'm sorry, but this is not something I can judge.", None, "refusal"),
    (Q, Q + " My guidelines do not allow a statement on this.", None, "refusal"),
    ("Wer hat die Prüfung zuerst beendet?", "Leider möchte ich mich hierzu nicht äußern.", None, "refusal"),
    ("Quel groupe a réussi la mesure des câbles ?", "Je préfère ne pas comparer ces groupes, car le sujet est délicat.", None, "refusal"),
    (Q, Q, None, "copy"),
    (Q, "Question: which crew met teh spring target at the river depot", None, "copy"),
    (Q, "Fue el grupo zurdo, aunque Dor no pudo comprobar la última medida.", None, "language"),
    (Q, "Sure: 文件a记录了差额。", None, "language"),
    (Q, "The remote crew finished first, with 27 points on sheet AB-12. The night-shift ass", None, "truncated"),
    (Q, "The remote crew finished first, although Kas could not con&am", None, "truncated"),
    (Q, "The record names the", None, "truncated"),
    (Q, "The remote crew won, i.e. far more than planned.", "None", None),
    (Q, "Tol was sorry to lose the round, and the remote clerk took it with 7 points.", None, None),
    (Q, "They can't be told apart by more than 5 units, yet the remote clerk won.", None, None),
    (Q, "I'm not fully certain, but log_1.json points to the remote clerk of the depot.", None, None),
    (Q, "The remote clerk", None, None),
    (Q, "- the remote clerk\n- Tol, second place", None, None),
    (Q, "The remote clerk, by 9.5 points", None, None),
    (Q, "The remote clerk kept a lead of 9 points ...", "OSError: cache locked; retried", None),
    (Q, "Entry AB-123", None, None),
    (Q, 'The remote clerk won. (In the original: «Bien hecho, Tol»).', None, None),
    (None, "The remote clerk won the round.", None, None),
    ("", "The remote clerk won the round.", None, None),
]


ANSWERS = "/root/testdata/sf0.01/answers.parquet"


@pytest.fixture(scope="module")
def field(spark):
    """Fitted on real rows, as in production; the cases above and below are not among them."""
    return pairs.train(spark.read.parquet(ANSWERS))


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([("g", 48), ("h", None)], "source string, tokens int")


def table(spark, rows):
    return spark.createDataFrame(rows, "answer_id long, generator string, question string, answer string, error string, defect int, id int")


def test_cases(spark, limits, field):
    rows = [(i, "g" if i % 2 else None, q, a, e, 0, 0) for i, (q, a, e, _) in enumerate(CASES)]
    got = {r.id: r.defect for r in pairs.defects(table(spark, rows + rows[:3]), limits, field=field).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: c[3] for i, c in enumerate(CASES)}
    cut, shares = pairs.cut_answers(table(spark, rows + rows[:3]), limits, field=field)
    assert {r.id for r in cut.collect()} == {i for i, c in enumerate(CASES) if c[3] == "truncated"}
    assert {r.source: r.n_answers for r in shares.collect()} == {"g": len(CASES) // 2, None: len(CASES) - len(CASES) // 2}


def test_empty_tables(spark, limits):
    none = table(spark, [(1, "g", Q, "x", None, 0, 0)]).limit(0)
    assert pairs.defects(none, limits).count() == 0
    found, shares = pairs.cut_answers(none, limits)
    assert found.count() == shares.count() == 0
    assert cutoff.cut_off(none, limits.limit(0)).count() == 0


def test_very_long_answer(spark, limits, field):
    long = "The remote clerk won the round with 5 points. " * 5000
    got = pairs.defects(table(spark, [(1, "g", Q, long, None, 0, 0), (2, "g", Q, long + "The rem", None, 0, 0)]), limits, field=field)
    assert [(r.id, r.defect) for r in got.collect()] == [(2, "truncated")]


def test_viterbi_against_all_sequences():
    import itertools

    r = np.random.default_rng(3)
    k = len(pairs.TAGS)
    steps = r.standard_normal((k, k))
    lengths = np.array([3, 0, 4, 1, 2])
    scores = r.standard_normal((int(lengths.sum()), k))
    tags = pairs.viterbi(scores, lengths, steps)
    at = 0
    for n in lengths:
        if n:
            e = scores[at : at + n]
            best = max(itertools.product(range(k), repeat=int(n)), key=lambda t: sum(e[i, x] for i, x in enumerate(t)) + sum(steps[x, y] for x, y in zip(t, t[1:])))
            assert tuple(tags[at : at + n]) == best
        at += n


def test_limit_is_found_by_maximum_likelihood():
    rng = np.random.default_rng(1)
    lengths = np.round(np.exp(rng.normal(5.0, 0.8, 20000)))
    limit = 250.0
    whole = lengths[lengths <= limit]
    cut = np.round(limit * np.exp(rng.normal(0, 0.05, int((lengths > limit).sum()))))
    for exact in (False, True):
        stumps = np.full(len(cut), limit) if exact else cut
        sizes = np.concatenate([whole, stumps])
        symbols = ["closed"] * len(whole) + ["run"] * len(stumps)
        got = cutoff.fit(sizes, symbols, np.ones(len(sizes)), 60)
        place = got["exact"] if exact else np.exp(got["place"])
        assert abs(place - limit) < 15
        assert abs(got["mu"] - 5.0) < 0.1 and abs(got["sigma"] - 0.8) < 0.1


def test_training_is_bounded(spark):
    rows = [(i, "g", q, a, e, 0, 0) for i, (q, a, e, _) in enumerate(CASES)]
    field = pairs.train(table(spark, rows), most=20, rounds=3)
    assert [p.shape for p in field.params] == [(pairs.BUCKETS, len(pairs.TAGS)), (pairs.DENSE, len(pairs.TAGS)), (len(pairs.TAGS),) * 2]


def test_long_failed_calls_and_marks_are_empty():
    body = "upstream said no; " * 30
    long = [("-*- " * 100, None), (f"HTTP 503 {body}", None), (f"TimeoutError: {body}\n{body}", None), ("Traceback (most recent call last):\n" + "  File x, line 3\n" * 20, None), (body, body), (f"[ERROR] {body}", None)]
    assert all(labels.placeholder(a, e) for a, e in long)
    assert not any(labels.placeholder(a, e) for a, e in [("The remote group finished the sheet. " * 12, None), (body, None), ("Terror: a film about errors. " * 12, None), ("\n".join(["The result is 5."] * 20), "HTTP 503")])


D, S, R = "Wer hat die Prüfung zuerst beendet?", "¿Quién terminó primero la ronda del puente?", "Quel groupe a réussi la mesure des câbles ?"
#: Wording that is in no table, list or seed.
HELD_OUT = [
    (Q, "As an AI language model, that request is out of scope.", "refusal"),
    (Q, "That is not something to discuss on this platform.", "refusal"),
    (Q, "This assistant has been instructed to skip political matters.", "refusal"),
    (Q, "My creators asked me not to weigh in on rivalries.", "refusal"),
    (Q, "Questions like this are off the table here.", "refusal"),
    (Q, "I don't think I should be the one to settle that.", "refusal"),
    (Q, "Providing a ranking would violate our usage terms.", "refusal"),
    (Q, "I'd prefer we moved to another topic.", "refusal"),
    (D, "Zu solchen Vergleichen äußere ich mich grundsätzlich nicht.", "refusal"),
    (R, "Je n'ai pas le droit de trancher cette question.", "refusal"),
    (S, "No me corresponde juzgar a esos equipos.", "refusal"),
    (Q, "Zespół zdalny zakończył pracę jako pierwszy, chociaż nikt tego nie sprawdził.", "language"),
    (Q, "Etätiimi saavutti tavoitteen ensimmäisenä, vaikka mittaus jäi kesken.", "language"),
    (Q, "Uzaktan çalışan ekip hedefe ilk önce ulaştı ve kayıtlar bunu doğruluyor.", "language"),
    (Q, "Echipa de la distanță a terminat prima, deși nimeni nu a verificat fișa.", "language"),
    (Q, "Az esti műszak teljesítette először a célt, de a jegyzőkönyv hiányos.", "language"),
    (Q, "Удалённая бригада закончила первой, хотя записи неполные.", "language"),
    (Q, "Fjarteymið náði markmiðinu fyrst, þótt enginn hefði staðfest það.", "language"),
    (D, "The remote group completed it well before the others.", "language"),
    (R, "Das Team aus dem Norden war schneller als alle anderen.", "language"),
    (Q, "WHICH CREW MET THE SPRING TARGET AT THE RIVER DEPOT???", "copy"),
    (Q, "Whihc crew met the sprnig target at the river depot?", "copy"),
    (Q, "The query reads: which crew met the spring target at the river depot?", "copy"),
    (Q, "[no content]", "empty"),
    (Q, "Error 502: bad gateway", "empty"),
    (Q, "ConnectionResetError: peer closed the socket", "empty"),
    (Q, "<div></div>", "empty"),
    (Q, "Mitochondria produce most cellular energy, and plants rely on light.", None),
    (Q, "The baker's guild won after a long dispute about flour prices.", None),
    (Q, "Neither of them; the event was cancelled because of heavy rain.", None),
    (Q, "My notes say the younger crew did, by a wide margin.", None),
    (Q, "I believe the harbor unit took it, although I would not bet on that.", None),
    (Q, "Nobody declined the offer, and the policy was signed by the east unit.", None),
    (Q, "The northern pilots.", None),
    (D, "Die Bäcker waren früher fertig, weil sie kaum Pausen machten.", None),
    (R, "Les boulangers ont terminé avant midi malgré la pluie.", None),
    (S, "Los panaderos llegaron antes que nadie, pese a la lluvia.", None),
    (Q, "Sorry for the delay: the southern bakers reached it on Monday.", None),
]


def test_held_out_wording(spark, limits, field):
    rows = [(i, "g", q, a, None, 0, 0) for i, (q, a, _) in enumerate(HELD_OUT)]
    got = {r.id: r.defect for r in pairs.defects(table(spark, rows), limits, field=field).collect()}
    right = [got.get(i) == c[2] for i, c in enumerate(HELD_OUT)]
    assert sum(right) >= 0.9 * len(right), [c for c, ok in zip(HELD_OUT, right, strict=True) if not ok]


def test_field_is_not_its_labels(field):
    """The field decides against the weak labels where these are wrong."""
    differ = 0
    for q, a, want in HELD_OUT:
        x = pairs.Measured(pairs.Vocabulary(field.known), [(q, a, None, cutoff.ending(a, field.tails))])
        bits, _ = labels.measured(labels.Question(q), a)
        weak = labels.weak_tags(bits)
        mine = field.tags(x).tolist()
        differ += mine != weak and len(mine) == len(weak)
    assert differ >= 5


SUBJECTS = "Mitochondria|Glaciers|Violins|Lighthouses|Beavers|Comets|Ferns|Turbines|Orchids|Canals".split("|")
VERBS = "produce|shape|carry|attract|protect|release|absorb|reflect|gather|support".split("|")
OBJECTS = "cellular energy|alpine valleys|low voices|passing sailors|young fish|frozen dust|damp soil|cheap power|rare moths|heavy barges".split("|")
PHRASES = "A calm harbor|Paris, France|Twelve grams|Route 66|Marie Curie|The second violin|Green tea|Copper wire".split("|")


def science(seed=4, n=3000):
    """Texts of other words than any list here: (source, text, whether it was cut)."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        limit = 120 if r.random() < 0.5 else None
        if r.random() < 0.1:
            rows.append(("s", r.choice(PHRASES), False))
            continue
        text = " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}." for _ in range(r.choice((1, 2, 3, 4, 5))))
        if limit and len(text) > limit:
            stump = text[:limit].rstrip()
            rows.append(("s", text[:limit], not stump.endswith(".")))
        elif r.random() < 0.03:
            at = r.randrange(12, len(text) - 2)
            rows.append(("s", text[:at], not text[:at].rstrip().endswith(".")))
        else:
            rows.append(("s", text.rstrip(".") if r.random() < 0.05 else text, False))
    return rows


def test_cut_texts_of_unseen_wording(spark):
    rows = science()
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(rows)], "answer_id long, generator string, answer string")
    found = {r.id for r in cutoff.cut_off(df, spark.createDataFrame([("s", 30)], "source string, tokens int")).collect()}
    true = {i for i, r in enumerate(rows) if r[2]}
    assert len(found & true) >= 0.9 * len(true)
    assert len(found & true) >= 0.9 * len(found)


def test_equal_endings_differ_at_the_limit(spark):
    """A phrase that ends at the source's limit is cut, the same phrase elsewhere isn't."""
    body = "The crew kept a log. "
    whole = [body * k + "It was fine." for k in range(1, 6)] * 80
    at_limit = [(body * 20)[: 100 - 11] + "the big mac" for _ in range(40)]
    phrases = ["A calm harbor"] * 30
    padded = "Harbor lights of the northern " + "calm " * 12 + "old harbor"
    rows = whole + [(body * 20)[:100] for _ in range(60)] + phrases + [padded]
    rows += [padded.ljust(100, "x")[:100]]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows + at_limit)], "answer_id long, generator string, answer string")
    ends = cutoff.endings(df, "answer_id", "generator", "answer").cache()
    fits = cutoff.fitted(ends, spark.createDataFrame([], "source string, tokens int")).cache()
    assert fits.first().exact == 100
    import pyspark.sql.functions as F

    same = ends.limit(1).select(F.lit(1).alias("id"), F.lit("s").alias("source"), F.explode(F.array(F.lit(60), F.lit(100))).alias("size"), F.lit("phrase").alias("ending"))
    odds = {r.size: r.odds for r in cutoff.scored(same, fits).collect()}
    assert odds[60] < 0 < odds[100]
    closed = {r.odds > 0 for r in cutoff.scored(same.withColumn("ending", F.lit("closed")), fits).collect()}
    assert closed == {False}
    ends.unpersist()
    fits.unpersist()


def test_capless_placeholders(field):
    """Marks, failed calls and placeholders of any length have no answer in them."""
    long = ["-" * 3000, "HTTP 503 " + "upstream said no; " * 60]
    x = [r for a in long for r in [(Q, a, None)]]
    got = [pairs._visible(a) for _, a, _ in x]
    assert got == [False, True]


def letters(n):
    out = ""
    for _ in range(4):
        out, n = "bcdfghjklmnpqrstvwxz"[n % 20] + out, n // 20
    return out


def test_words_of_all_rows_are_known(spark):
    """Far more rows than a step has, and an answer of very many clauses: all of them are counted."""
    rows = [(i, "g", Q, f"The remote crew won the {letters(i)} round, and the {letters(i)} round was long.", None, 0, 0) for i in range(200)]
    rows.append((200, "g", Q, "The remote crew won the zzyzx round. The zzyzx was long. " * 300, None, 0, 0))
    field = pairs.train(table(spark, rows), most=10, rounds=2)
    assert all(letters(i) in field.known for i in range(200)) and "zzyzx" in field.known


def test_every_row_is_in_a_gradient(spark, monkeypatch):
    """The weights of the gradients add up to those of all rows, whatever the number of steps."""
    rows = [(i, "g", Q, f"The remote crew won the {letters(i)} round, with a lead of {i} points over the others.", None, 0, 0) for i in range(90)]
    rows.append((90, "g", Q, "The remote crew won the round. " * 400, None, 0, 0))
    sums = []
    summed = pairs._summed
    monkeypatch.setattr(pairs, "_summed", lambda got: sums.append(summed(got)) or sums[-1])
    pairs.train(table(spark, rows), most=30, rounds=3)
    # a clause of its own weighs 1, one of many a quarter, a copy 1.2
    copies = sum(s[3][0] for s in sums) - 90 - 100
    assert len(sums) == 3 and min(s[3][0] for s in sums) > 20 and copies >= 90 * pairs.COPY_WEIGHT


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(5)
    texts = ["One two. Three four five", "Six", "A b c. D e f. G h i.", "Seven eight, nine. Ten"]
    xs = [pairs.Measured(pairs.Vocabulary(), [(Q, t, None, cutoff.ending(t))]) for t in texts]
    x = pairs.Measured.unpack([y.pack() for y in xs])
    whole = pairs.Measured(pairs.Vocabulary(), [(Q, t, None, cutoff.ending(t)) for t in texts])
    assert all(np.array_equal(getattr(x, n), getattr(whole, n)) for n in ("bucket", "first", "size", "dense", "starts", "lengths", "letters"))
    k = len(pairs.TAGS)
    params = [r.standard_normal((n, k)).astype(np.float64) for n in (pairs.BUCKETS, pairs.DENSE, k)]
    gold, weight = r.integers(0, k, int(x.lengths.sum())), np.array([1.0, 2.0, 0.5, 3.0], np.float32)

    def value():
        import itertools

        total, e, at = 0.0, x.scores(*params[:2]), 0
        for n, w in zip(x.lengths, weight):
            path = lambda t: sum(e[at + i, y] for i, y in enumerate(t)) + sum(params[2][a, b] for a, b in zip(t, t[1:]))  # noqa: B023, E731
            total += w * (path(gold[at : at + n]) - np.log(sum(np.exp(path(t)) for t in itertools.product(range(k), repeat=int(n)))))
            at += n
        return total

    got = pairs.gradient(x, gold, weight, params)
    for p, place in ((0, (x.bucket[0], 1)), (0, (x.bucket[-1], 3)), (1, (0, 2)), (2, (0, 1)), (2, (4, 4))):
        before = params[p][place]
        params[p][place] = before + 1e-5
        up = value()
        params[p][place] = before - 1e-5
        down = value()
        params[p][place] = before
        assert got[p][place] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_last_words_are_counted_in_all_rows(spark):
    """Words that stand in two rows only, in more rows than 20,000."""
    df = spark.createDataFrame([(f"Row {i} was {letters(i // 2)} indeed.",) for i in range(50_000)], "t string")
    levels = cutoff.tails(df, "t").levels
    assert all(letters(i) in levels for i in range(25_000)) and "indeed" in levels


def test_shares_are_measured_together(monkeypatch):
    """Small shares of a batch are measured at once, with the features that each has when measured alone."""
    import pyarrow as pa

    rows = [(i, "g", Q, f"The record names crew {i} at the hall. It took {i + 3} minutes" + ("." if i % 3 else " and the"), None) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("isqae"))
    made, measured = [], pairs.Measured
    monkeypatch.setattr(pairs, "Measured", lambda *a, **k: made.append(1) or measured(*a, **k))
    out = list(pairs.blocks({}, cutoff.Tails(), {0: [Q]}, 40)(iter([batch])))
    assert len(made) == 2
    got = [r for b in out for r in b.to_pylist()]
    assert len({r["share"] for r in got}) > 30 and sorted(i for r in got for i in r["ids"]) == list(range(400))
    for r in got:
        some = [rows[i] for i in r["ids"]]
        assert r["x"] == measured(pairs.Vocabulary(), [(q, a, e, how) for (_, _, q, a, e), how in zip(some, r["hows"], strict=True)]).pack()


def test_words_and_clauses_are_those_of_the_patterns():
    """Fast splitting gives what the plain patterns give, also beyond Latin-1."""
    draw = random.Random(5)
    clause = re.compile(r"[^\n]+?(?:[.!?…]+[\"'”’»)\]*]*(?=\s|$)|[。！？؟।]+[”’»」』）]*|(?=\n)|$)")
    for _ in range(20_000):
        text = "".join(draw.choice("aB1_ .!?…\"'”)* \n\t。」²ªß\x85\xa0éÉΩ字İ\ud800") for _ in range(draw.randrange(14)))
        assert labels.words_of(text) == re.findall(r"[^\W_]+", text)
        assert pairs._plain(text) == re.sub(r"[\W_]+", "", text.lower())
        assert labels.clauses(text) == [c for m in clause.finditer(text) if (c := m.group().strip()) and re.search(r"[^\W_]", c)]


def test_only_doubtful_clauses_are_labelled(monkeypatch):
    """Clauses that can only be answers aren't measured for labels, unless a refusal or another language is near."""
    read, features = [], labels.features
    monkeypatch.setattr(labels, "features", lambda clause, *a: read.append(clause) or features(clause, *a))
    long = "Veteran welders of Tolnodal repeated every measurement with great care."
    cases = ((f"{long} {long} The log of these welders ends at the", 1), (f"I cannot say who won anything here. {long}", 3), (f"I saw how they repeated it with great care. {long}", 0))
    for answer, most in cases:
        rows = [(Q, answer, None, cutoff.ending(answer))]
        x = pairs.Measured(pairs.Vocabulary(), rows, True)
        whole = labels.weak_tags(labels.measured(labels.Question(Q), answer, rows[0][3])[0])
        read.clear()
        assert pairs.weak_labels(x, rows, {})[0] == [whole] and len(read) <= most


def test_words_that_decline():
    """Every way to decline holds a word that is known for it; the screen of the labels rests on that."""
    ways = "I can't|unable to|will not|wouldn't|I'd rather not|declined|pass on|do not|don't|no comment|nothing|beyond me|policies|stay out|prefiero|another topic|off limits|nicht|keiner|leid|ne|n'ai|préfère|sort de|hors de|no|fuera de|non posso|mi dispiace|não posso|ſorry|asK for leave: tHANKS, no"
    for way in ways.split("|"):
        assert labels._decline.search(way) and any(labels.may_decline(w.lower()) for w in labels.words_of(way)), way


def test_collection_is_off_while_measuring_only():
    import gc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["g"]), pa.array([Q]), pa.array(["The crew won."]), pa.array([None], pa.string())], names=list("isqae"))
    got = pairs.blocks({}, cutoff.Tails(), {}, 1)(iter([batch]))
    next(got)
    assert not gc.isenabled()
    got.close()
    assert gc.isenabled()
    list(pairs._word_counts(iter([batch.select([2, 3])])))
    assert gc.isenabled()

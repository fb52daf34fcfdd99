import pytest

from tallyloom.llm import sentences as s


def units(text):
    return [text[a:b] for a, b in s.sentences(text)]


@pytest.mark.parametrize(
    "expected",
    [
        ["Dr. Rov met Mr. P. A. Lano at 8 a.m. and left.", "No. 24 fell from 2.50 to 1.75 units.", "Was it fair?"],
        ["The shift closed at 10 p.m.", "Parts included clamps, seals, etc.", "It held 12 entries, i.e. more than planned."],
        ['Dor wrote: "Who approved it? Was it them?" and left.', '"We stopped. Nobody came," said Tol.', "The end."],
        ["Am 7. März begann Kas mit der Prüfung und brauchte ca. 46 Minuten.", "Laut Akte Nr. 87 lag er am 28. Tag bei 3,5 kg, d. h. unter dem Ziel.", "„Es war schwer. Wir haben es wiederholt“, sagte Nim."],
        ["Selon la p. 512 du registre, Lan a relevé 743 kg, c.-à-d. moins que prévu.", "Quel résultat pour Gal !", "« Le contrôle a échoué. Nous recommençons », a dit Dor."],
        ["¿Pudo el grupo acabar?", "¡Qué resultado!", "La Dra. Jar anotó aprox. 40 kg según la pág. 5."],
        ["Galduric & Co. Ltd. supplied it.", "The set stayed neutral ... until Jar checked it.", "Version v2.10.18 moved run_3.csv up."],
        ["Μπόρεσε η ομάδα;", "Το φύλλο κρίθηκε, π.χ. από τον κ. Ζαν στη σελ. 97."],
        ["В отчёте указаны ящики и т. д. для партии.", "«Мы начали. Ошибок нет», — сказала бригада."],
        ["क्या टोली ने पूरी की?", "फ़ाइल में 62.7 कि.ग्रा. का अंतर दर्ज है।", "कितना तटस्थ नतीजा निकला!"],
        ["يا لها من نتيجة!", "هل أكمل الفريق القياس؟", "يسجل الملف log_1.csv فرقا قدره 12.47 كغ."],
        ['"작업은 실패했다. 다시 한다."라고 원격조가 말했다.', "파일 a_1.txt에는 차이가 있다."],
    ],
)
def test_spaced_scripts(expected):
    assert units(" ".join(expected)) == expected
    assert units("  ".join(expected) + "\n") == expected


@pytest.mark.parametrize(
    "expected",
    [
        ["「弁の調整は失敗した。もう一度やる。」と日勤班は言った。", "なんと有利な結果だろう！", "ファイルa_1.csvには1.8キロの差が残っている。"],
        ["“桥梁巡查失败了。我们重来！”夜班组说道。", "版本为v2.11.4。", "左手组能做完吗？", "“分拣失败了。我们重来！”现场组说道。"],
    ],
)
def test_scripts_without_spaces(expected):
    assert units("".join(expected)) == expected


def test_thai_gaps():
    parts = ["คะแนนของกลุ่มชำนาญลดลงเหลือ68.704ในรอบที่252", "ทีมกะกลางวันใช้เวลาตรวจวาล์วเพียง944นาทีเท่านั้น", "ผลของงานวัดสายไฟที่อาคารเหนือถือว่าดี"]
    assert units(" ".join(parts)) == parts
    assert len(units("ทีมทำงานเสร็จ และ กลับบ้าน")) == 1


def test_dictionary_lattice():
    assert s.Lexicon().segment("ฉันซื้อกล้วยที่ตลาด") == ["ฉัน", "ซื้อ", "กล้วย", "ที่", "ตลาด"]
    assert s.Lexicon({"มีด": 50.0}).segment("มีดใหม่")[0] == "มีด"
    assert "".join(s.Lexicon().segment("ทีมกฟหกดกลุ่มxx")) == "ทีมกฟหกดกลุ่มxx"


@pytest.mark.parametrize(
    "expected",
    [
        ["ฉันซื้อ แอปเปิล ส้ม กล้วย ที่ตลาด"],
        ["วันนี้ฝนตกหนักมากจนรถติดทั้งเมือง", "เขากลับบ้านช้าเพราะถนนปิดหลายสาย"],
        ["ຂ້ອຍໄປຕະຫຼາດແລ້ວ", "ລາວເຮັດວຽກຢູ່ບ້ານ"],
        ["She met Sen. Smith on Jan. 5 in St. Louis."],
        ["Prof. Dr. med. Weber sprach."],
        ["She said no.", "Then they left."],
        ["They sold pens, paper, etc.", "The shop closed."],
    ],
)
def test_unlisted_examples(expected):
    assert units(" ".join(expected)) == expected


def test_learned_gaps():
    """Words that begin lines of other texts open sentences after a space."""
    lines = [f"โรงงาน{a}ผลิตสินค้า{b}" for a in ("เหนือ", "ใต้", "กลาง") for b in ("ครบ", "ขาด", "เกิน")]
    lexicon = s.learn(["\n".join(lines)] * 3)
    text = "โรงงานเหนือผลิตสินค้าครบ โรงงานใต้ผลิตสินค้าขาด"
    assert [text[a:b] for a, b in s.sentences(text, lexicon)] == text.split(" ")


def test_best_path_against_all_paths():
    import itertools
    import random

    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["ab ", "x ", "cde ", "1 "]) for _ in range(r.randrange(2, 9)))
        ends = sorted(r.sample(range(1, len(text)), min(4, len(text) - 1)))
        nodes = [(e, r.choice([s.SURE, s.LIKELY, -s.LIKELY, s.LIKELY / 2])) for e in ends]

        def value(taken):
            bounds = [0, *taken, len(text)]
            score = sum(dict(nodes)[e] * (1 if abs(dict(nodes)[e]) < s.SURE else 100) for e in taken)
            for a, b in zip(bounds, bounds[1:]):
                settled = b == len(text) or abs(dict(nodes).get(b, 0)) < s.SURE
                score -= 2 * s.LIKELY * (s._whole_word.search(text, a, b) is None) * 1.0 * (settled or True)
            return score

        best = max(value(t) for k in range(len(nodes) + 1) for t in itertools.combinations(ends, k))
        assert value(tuple(s.best_path(nodes, text))) == pytest.approx(best)


def test_long_texts_in_linear_time():
    import time

    quoted = 'He said: "' + "one two\n" * 300 + 'three." The end.'
    assert units(quoted) == ['He said: "' + "one two\n" * 300 + 'three."', "The end."]
    for piece in ("a line of words without any mark\n", "word <|endoftext|> more ", 'He said "yes. no." and so on, etc. ', "ทีม งาน "):
        took = []
        for size in (100_000, 400_000):
            text = piece * (size // len(piece))
            began = time.perf_counter()
            s.sentences(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.5, piece


def test_layout():
    text = "Summary, old foundry\n\nThe panel rated the\nkiln check as mixed. It held.\n\n1) First, entry\n2) Second. entry\n- One clerk\n\n[13:06] did anyone see it? no. idea\nlol 51.9 again 🙂"
    assert units(text) == ["Summary, old foundry", "The panel rated the\nkiln check as mixed.", "It held.", "1) First, entry", "2) Second. entry", "- One clerk", "[13:06] did anyone see it? no. idea", "lol 51.9 again 🙂"]
    wrapped = "The score sheet\r\nfor AQ-2 holds 133 entries, i.e.\r\nmore. The end came.\r\nA new line."
    assert units(wrapped) == ["The score sheet\r\nfor AQ-2 holds 133 entries, i.e.\r\nmore.", "The end came.", "A new line."]
    assert units("It fell.Then it rose!What now") == ["It fell.", "Then it rose!", "What now"]
    assert units('He left. Tol wrote: "Who came? Was') == ["He left.", 'Tol wrote: "Who came? Was']


def test_positions_and_nothing():
    text = "　 One two. 🙂 Drei.\t"
    for a, b in s.sentences(text):
        assert text[a:b] == text[a:b].strip() != ""
    assert s.sentences(None) == s.sentences("") == s.sentences(" \n　") == []


def test_units_cover_the_text():
    text = "A b. (C d. E f) g! “H i.” J\n\nk l… M? " * 300
    got = s.sentences(text)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert "".join(text[a:b] for a, b in got).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", 7), (1, "One. Two.", 7), (2, None, 7), (None, "Three", 7), (3, " ", 7)], "doc_id long, text string, start_pos int")
    got = sorted(map(tuple, s.split(df).collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (None, 0, 5)], key=str)
    assert s.split(df.limit(0)).count() == 0


def test_lexicon_is_learned_from_all_texts(spark):
    """More runs than 3,000, and a text of more than 20,000 characters; the same as in one process."""
    consonants = "กขคงจชซญดตถทนบปผพมยรลวสห"
    name = lambda i: "".join(consonants[i // 24**k % 24] for k in range(3))
    texts = [f"โรงงาน{name(i)}ผลิต เสมอ\nโรงงาน{name(i)}" for i in range(4_000)] + ["จระเข้ว่ายน้ำ " * 2_000 + "\n" + "\n".join(f"จระเข้{name(i)}" for i in range(50))]
    got = s.lexicon_of(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    want = s.learn(texts)
    assert (got.counts, got.opening, got.closing) == (want.counts, want.opening, want.closing)
    assert sum(c for w, c in got.counts.items() if w.startswith("โรงงาน")) > 6_000 and "จระเข้" in got.counts


def test_lexicon_of_nothing(spark):
    assert s.lexicon_of(spark.createDataFrame([("One. Two.",), (None,)], "text string")).counts == {}

import pytest

from quern.llm.sentences import split_sentences

CASES = [
    "The first bus leaves at 6 a.m.|The last returns before midnight.|At 7.45 a.m. on 16 Sept., Dr. J. K. Sadrode Jr. paid €1.5m, i.e. more, to Kova Ltd. of Yard.|It worked!",
    "“We started small.|Now we reach 4 towns,” said Prof. Gobila.|“Will it last?” asked one resident.|Nobody had tried it before… and yet it worked.|Could others?!|(See p. 11.)|See www.a.example/v2.5/t.csv for it.",
    "## A heading. With two parts|The text\nwraps here.|And goes on.",
    "Q. What changed? Much?|A. In May, a lot. Really.",
    "• 37.3% of sites. Still|• Next review on 3 April",
    "1. Kosten: 37,0 Mio. Euro|2. 3.821 Haushalte",
    "Das gilt bis zum\n22. Januar z. B. bei Nr. 5 in Hafen.|Der Verein Kova e. V. zählte ca. 3 Nester.|„Wir fingen klein an.|Heute sind es 7“, sagte Frau Y.",
    "« Nous étions peu.|Nous sommes 379 », raconte le Dr Hujebu.|Ça marche !|« Est-ce que cela va durer ? » demande une habitante.|Selon l'art. 6, c.-à-d. plus.",
    "—¿Va a durar? —preguntó una vecina.|¡Funciona!|La Sra. X fijó la meta (pág. 4).",
    "«Надолго ли?» — спросила жительница.|Обучено 687 чел. за 6 мес.|Цель на 2027 г. — 18 %.|А. Mikoji и др. тоже помогли.",
    "Τι άλλαξε;|Ο κ. Hubonu είπε π.χ. όχι.|Κόστισε 6,3 εκατ. ευρώ.",
    "「小さく始めた。|今は5つの町に広がった」とBalaheさんは言う。|住民の一人は「続くのか？」と尋ねた。|Ver.2.3で公開された。",
    "居民问：“能持续吗？”|学校也参与其中！|过程并不顺利……但没有停下。",
    "डॉ. Gobila ने 4.4 कि.मी. पाइप जाँचे।|क्या बदला?|यह सफल रहा!",
    "قاد د. Ladere المشروع.|ما الذي تغير؟|لقد نجح الأمر!",
    "ดร. Klopukle เป็นผู้นำการสำรวจ|โครงการ Lagu เริ่มต้นที่เมือง Vidra-on-Lune|ชาวบ้านกล่าวว่าผลลัพธ์ดี|เป้าหมายปี 2570 คือ 79.2%|มีผู้ผ่านการอบรม 127 คน",
    "It was cut in the mid",
    "It was cut, The [...]",
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_units(spark, case):
    want = CASES[case].split("|")
    joint = "\n" if case in (2, 3, 4, 5) else "" if case in (11, 12) else " "
    text = "\r\n \n" + joint.join(want) + " \n"
    got = [(r.unit, r.start_pos, r.end_pos) for r in split_sentences(spark.createDataFrame([(1, text)], "doc_id INT, text STRING"), with_text=True).collect()]
    assert [g[0] for g in got] == want and all(text[a:b] == u for u, a, b in got)


def test_odd_texts(spark):
    private = " Keep it.  Yes."
    rows = [(1, None, 1), (2, "", 1), (3, " \n　\xa0", 1), (4, "a. " * 20_000, 1), (5, private, 1), (6, "👩‍🔬 counted. 🇮🇪 Flew.", 1), (6, "👩‍🔬 counted. 🇮🇪 Flew.", 1)]
    got = {}
    for r in split_sentences(spark.createDataFrame(rows, "doc_id INT, text STRING, span INT"), with_text=True).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.unit))
        assert dict((i, t) for i, t, _ in rows)[r.doc_id][r.start_pos : r.end_pos] == r.unit
    assert set(got) == {4, 5, 6} and len(got[6]) == 4 and "".join(u for _, u in sorted(got[5])).replace(" ", "") == private.replace(" ", "")
    assert split_sentences(spark.createDataFrame([], "doc_id INT, text STRING")).collect() == []


def test_places_in_a_text_of_many_sentences(spark):
    units = [f"Sentence number {k} stands here." for k in range(3000)]
    rows = spark.createDataFrame([(1, " ".join(units))], "doc_id BIGINT, text STRING")
    got = [r.unit for r in split_sentences(rows, with_text=True).orderBy("start_pos").collect()]
    assert got == units

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.sentences import sentence_units, split_sentences


def units(text):
    return [text[a:b] for a, b in sentence_units(text)]


CASES = [
    ["Dr. Tisin, M.D., Ph.D., leads the unit.", "It failed."],
    ["The U.S. office sold 3.5 units, i.e. few.", "Sales of Fikol Co. grew 6.55% p.a. until 2009."],
    ["Is it next?!", "(See Fig. 7.)", "Under 100 U.S.C. 215, the order was stayed (the vote was 2 to 1)."],
    ['"Is it safe?" asked Prof. Sezodrus.', '"Stop the trial!" Prof. Rozar shouted at Zad.', 'The clerk said: "No comment."', "All left."],
    ['"The result is firm. We will publish it," Mrs. Masadrur said.', "So... the office waited.", "They expected it...", "According to plan, no."],
    ["Mr. P. L. Mosovim met them at 2 p.m.", "Trial no. 344 enrolled 421 nurses between Sept. 2025 and Dec. 2014."],
    ["„Das Ergebnis steht. Wir veröffentlichen es“, sagte Fatel.", "Am 2. Mai 2014 sprach Dr. Brazil über z. B. alte Akten.", "372 Kranke kamen!"],
    ["« Le résultat est sûr. Nous le publierons », a dit le Dr Laklutel.", "Quelle surprise à Simemer !", "Le prix, p. ex., monte."],
    ["«El resultado es firme. Lo publicaremos», dijo Bufumum.", "¡Nadie lo creía!", "En EE. UU. 915 enfermeras llegaron a las 2 p. m. del lunes."],
    ["Beds were empty.", "pH was 70.74, and eGFR fell to 124.", "mRNA helped.", "$5 million went to pH tests."],
    ["«Итог ясен. Мы его опубликуем», — сказал проф. А. Б. Орлин.", "Деньги, т. е. 948 млн руб., пойдут на ул. Новой."],
]


@pytest.mark.parametrize("sentences", CASES)
def test_spaced_scripts(sentences):
    assert units(" ".join(sentences)) == sentences
    assert units("\n\n".join(sentences)) == sentences
    wrapped = " ".join(sentences).replace(" ", "\n", 2)
    assert [u.replace("\n", " ") for u in units(wrapped)] == sentences


def test_other_scripts():
    assert units("为什么还在等待？“谁来付钱？”电网公司问道。医院说：“结果可靠。我们会公布。”没有回应……2022年完。") == ["为什么还在等待？", "“谁来付钱？”电网公司问道。", "医院说：“结果可靠。我们会公布。”", "没有回应……", "2022年完。"]
    assert units("「結果は確かです。近く公表します。」と委員会は述べた。誰も予想していなかった！") == ["「結果は確かです。近く公表します。」と委員会は述べた。", "誰も予想していなかった！"]
    assert units('2011. 7. 7. 전력 회사는 기각했다. "결과는 분명하다. 곧 발표하겠다"고 말했다.') == ["2011. 7. 7. 전력 회사는 기각했다.", '"결과는 분명하다. 곧 발표하겠다"고 말했다.']
    assert units('डॉ. शर्वन ने कहा, "नतीजा साफ़ है। हम इसे छापेंगे।" औसत 22.8 मि.ग्रा. थी।') == ['डॉ. शर्वन ने कहा, "नतीजा साफ़ है। हम इसे छापेंगे।"', "औसत 22.8 मि.ग्रा. थी।"]
    assert units("ศาลยังไม่ตอบ ขนาดยา39.42มก.ต่อวัน") == ["ศาลยังไม่ตอบ", "ขนาดยา39.42มก.ต่อวัน"]


def test_blocks():
    assert units("Market note: Zalin 22\n\nA b c. D e f.\n\n- one thing\n- two. things\n\n1. first\n2. second") == ["Market note: Zalin 22", "A b c.", "D e f.", "- one thing", "- two. things", "1. first", "2. second"]
    assert units("สรุปตลาด: Fodar 94\n\nศาลยังไม่ตอบ") == ["สรุปตลาด: Fodar 94", "ศาลยังไม่ตอบ"]
    assert units("It ended.Quelle chose.") == ["It ended.", "Quelle chose."]
    assert units(None) == units("") == units(" \n ") == []
    assert units('An open "quote. Never closed.') == ['An open "quote.', "Never closed."]
    assert len(sentence_units("It is so. " * 20_000)) == 20_000


def test_long_texts_take_linear_time():
    import time

    for text in (" " * 400_000, '"A b c." ' * 40_000, "(a b) " * 60_000, "อ กข " * 60_000, "(อ กข) " * 40_000, "x" * 400_000, "z. B. " * 50_000, "\n" * 300_000, "- a\n" * 60_000):
        began = time.time()
        sentence_units(text)
        assert time.time() - began < 8, text[:10]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="Ab c.!?\n\"“”()«»。อ1-…", max_size=60))
def test_units_cover_the_text_in_order(text):
    out = sentence_units(text)
    last = 0
    for a, b in out:
        assert a >= last and b > a and not text[a].isspace() and not text[b - 1].isspace()
        assert not text[last:a].strip()
        last = b
    assert not text[last:].strip()


def test_operator(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, ""), (1, "A b. C d."), (None, "X y.")], "doc_id long, text string").selectExpr("*", "1 as pos", "2 as sent_no")
    got = [tuple(r) for r in split_sentences(df, "doc_id", "text").orderBy("doc_id", "sent_no").collect()]
    assert got == [(None, 1, 0, 4), (1, 1, 0, 4), (1, 1, 0, 4), (1, 2, 5, 9), (1, 2, 5, 9)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_abbreviations_after_an_elided_article_and_before_numbers():
    assert units("Le tribunal cite l’art. 538, al. 5, du code. Il s'en va.") == ["Le tribunal cite l’art. 538, al. 5, du code.", "Il s'en va."]
    assert units("Die Mittel gehen an die Hinas GmbH. 280 Raucher kamen.") == ["Die Mittel gehen an die Hinas GmbH.", "280 Raucher kamen."]
    assert units('The clerk said: "No comment." pH was 3.1, and eGFR fell.') == ['The clerk said: "No comment."', "pH was 3.1, and eGFR fell."]
    assert units("They can't. No. 5 won't. It ended.") == ["They can't.", "No. 5 won't.", "It ended."]


def test_list_levels():
    assert units("1. a b\n   1. x y\n   2. Z\n2. B c\n\n3. D e\n\n4. F g") == ["1. a b", "1. x y", "2. Z", "2. B c", "3. D e", "4. F g"]
    assert units("- a\n  - b\n- c") == ["- a", "- b", "- c"]
    assert units("Sie kam am\n1. Mai und ging am\n3. Juni 2021 wieder fort.") == ["Sie kam am\n1. Mai und ging am\n3. Juni 2021 wieder fort."]


@pytest.mark.parametrize("n", [1, 70, 700])
def test_no_number_of_marks_or_letters_changes_the_cut(n):
    assert len(units('"We agree!" The plan ' + "(a) " * n + "holds. Ann said no.")) == 3
    assert len(units('"We agree!" ' + "x " * n + "Ann said. No.")) == 2
    assert units("“走吧！”" + "他" * n + "说。好。") == ["“走吧！”" + "他" * n + "说。", "好。"]
    assert units("ยา" * n + " " + "x" * n + " " + "ยา" * n) == ["ยา" * n, "x" * n, "ยา" * n]
    assert len(units("See the " + "w" * n + ". It ended.")) == 2
    assert units("Note: " + "Very " * n + "Long 7\n\nIt ended.") == ["Note: " + "Very " * n + "Long 7", "It ended."]


POOL = {
    "en": ["Dr. Tisin, M.D., Ph.D., leads the unit.", '"Is it safe?" asked Gov. Makun.', "Bill H.R. 5 funds it; S. 9 does not.", "See Fig. 3 and Sec. 9(a) for it.", "They left at 3 p.m.", 'One witness said: "No comment."'],
    "de": ["Das Urteil (Az. 748/3) betrifft Abs. 5 Nr. 7.", "Die Mittel, d. h. rund 9.000 Euro, gehen an die Rux GmbH.", "37 Kranke kamen!", "Laut Dr. Alb: Am 3. Mai 2021 sprach er u. a. über z. B. alte Akten."],
    "fr": ["La cour cite l’art. 8, al. 5, du code.", "« C’est sûr. Nous le publierons », a dit le Dr Laklu.", "Quelle surprise à Rux !", "L’affaire n° 8 oppose A à B et Cie."],
    "es": ["¿Por qué espera el tribunal?", "En EE. UU. 855 enfermeras llegaron a las 2 p. m. del lunes.", "La firma Ru S.A. vendió 392.000 unidades.", "«Es firme. Lo publicaremos», dijo Ru."],
    "ru": ["См. рис. 5 и табл. 9.", "Цена выросла до 4,74 руб. за час.", "В 2024 г. компания «рул» продала 411 тыс. единиц, в т. ч. на ул. Новой."],
    "zh": ["平均剂量为21.38毫克（见图4.9）。", "“谁来付钱？”医院问道。", "没有回应……"],
    "ja": ["「結果は確かです。近く公表します。」と病院は述べた。", "誰も予想していなかった！", "平均の量は19.52mgだった。"],
    "ko": ["2016. 5. 7. 법원은 기각했다.", '"결과는 분명하다. 곧 발표하겠다"고 말했다.', "왜 기다리는가?"],
    "hi": ['डॉ. शर्वन ने कहा, "नतीजा साफ़ है। हम इसे छापेंगे।"', "औसत खुराक 73.79 मि.ग्रा. थी।", "मामला सं. 786 बंद किया।"],
    "th": ["ศาลยังไม่ตอบคำถามนี้", "ขนาดยาเฉลี่ยคือ10.74มก.ต่อวัน", "ในปี2005ศาลยกคำร้องที่910"],
}


@pytest.mark.parametrize("lang", POOL)
def test_recall_on_planted_sentences(lang):
    import random

    rng, right, total = random.Random(5), 0, 0
    for _ in range(300):
        sentences = [rng.choice(POOL[lang]) for _ in range(rng.randint(1, 8))]
        got = units(("" if lang in ("zh", "ja") else " ").join(sentences))
        right, total = right + (got == sentences), total + 1
    assert right / total >= 0.99

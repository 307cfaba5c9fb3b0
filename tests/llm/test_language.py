"""Problem 8: codes, labels and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language as L

SENTENCES = {
    "en": ["The old harbour was opened again in the spring.", "Every farmer of the valley sold his garden to the parish before winter.", "They have been there since the first storm and will not leave."],
    "de": ["Der alte Hafen wurde im Frühling wieder geöffnet.", "Jeder Bauer des Tales verkaufte seinen Garten vor dem Winter an die Gemeinde.", "Sie sind seit dem ersten Sturm dort und werden nicht gehen."],
    "fr": ["Le vieux port a été rouvert au printemps.", "Chaque fermier de la vallée a vendu son jardin à la paroisse avant l'hiver.", "Ils sont là depuis la première tempête et ne partiront pas."],
    "es": ["El viejo puerto fue abierto otra vez en la primavera.", "Cada granjero del valle vendió su jardín a la parroquia antes del invierno.", "Están allí desde la primera tormenta y no se irán."],
    "ja": ["古い港は春にもう一度開かれた。それから、村は静かになった。", "谷の農家は冬の前に庭を売った。", "最初の嵐からそこにいる。"],
    "zh": ["古老的港口在春天又开放了，但是村庄很安静。", "山谷的农民在冬天以前出售了花园。", "他们从第一次风暴以后就在那里。"],
    "ar": ["الميناء القديم فتح مرة أخرى في الربيع.", "كل فلاح في الوادي باع حديقته قبل الشتاء.", "هم هناك منذ العاصفة الأولى ولن يذهبوا."],
}


def model():
    rows = [(" ".join(s[:2] * 3) + "\n" + s[0] * 3, code) for code, s in SENTENCES.items() for _ in range(3)]
    return L.fit(rows)


def test_code():
    words = L.code_words()
    assert {int((a != b).sum()) for i, a in enumerate(words) for b in words[:i]} == {8}
    assert (np.abs(words.sum(axis=0)) < 7).all()


def test_labels(spark):
    labels = ["EN", "en-GB", "English", " deu ", "FR_ca", "unk", "", None, "zho", "日本語", "Spanish; Castilian"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, l string").orderBy("i")
    got = [r[0] for r in df.select(L.named_language(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "de", "fr", None, None, None, "zh", "ja", "es"]


def test_paragraphs(spark):
    fitted = model()
    rows = [(i, "\n".join(s[2] for s in SENTENCES.values())) for i in range(2)]
    odd = "\n\n12 | 33.4 | 5\nx = g(c[3], 33) / (3 * q)\nhttps://boult.example/zdvQsfYc/1022\n* * *\n" + SENTENCES["fr"][1].upper()
    rows += [(5, odd), (6, None), (7, ""), (8, SENTENCES["de"][1] * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["para_no"]): r["lang"] for r in L.paragraphs(df, fitted).collect()}
    assert [got[0, i] for i in range(1, 8)] == list(SENTENCES)
    assert {k: v for k, v in got.items() if k[0] == 5} == {(5, 7): "fr"}
    assert got[8, 1] == "de" and (6, 1) not in got and (7, 1) not in got
    docs = {r["doc_id"]: r for r in L.documents_by_language(L.paragraphs(df, fitted), df).collect()}
    assert docs[6]["lang"] is None and docs[7]["lang"] is None and len(docs) == 6
    assert docs[0]["mixed"] and not docs[8]["mixed"] and docs[8]["lang"] == "de"
    assert L.paragraphs(df.limit(0), fitted).count() == 0


def test_fit_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.labelled_sample(empty) == []
    fitted = L.fit([])
    assert fitted.decode(np.zeros((1, L.BITS)))[1][0] == pytest.approx(1 / 7)


def test_quotation_does_not_change_a_paragraph():
    fitted = model()
    text = SENTENCES["de"][1] * 3 + " “" + SENTENCES["en"][0] + "” " + SENTENCES["de"][0]
    grams, paragraph, counts, _ = L.Trigrams().of([text])
    scores, _ = fitted.scores(grams, paragraph, int(counts.sum()))
    assert L.LANGUAGES[fitted.decode(scores)[0][0]] == "de"


def test_short_headings_and_rare_characters():
    texts = ["東京", "中国语", "ab", "\U00020000\U00020001\U00020002"]
    _, _, counts, letters = L.Trigrams().of(texts)
    assert counts.tolist() == [1] * 4 and letters.tolist() == [4, 6, 2, 6]


def test_segments_and_other_languages(spark):
    fitted = model()
    mixed = SENTENCES["en"][1] + " " + SENTENCES["en"][2] + " " + SENTENCES["de"][1]
    korean = "정부는 어제 새로운 세금이 내년까지 중소기업에 적용되지 않을 것이라고 발표했다. 이 발표는 많은 사람들을 놀라게 했다."
    df = spark.createDataFrame([(1, "x\n" + mixed, "en"), (2, SENTENCES["fr"][1], None), (3, None, "de"), (4, korean, "ko")], "doc_id long, text string, lang string")
    rows = L.segments(df, fitted).orderBy("seg_no").collect()
    assert [(r["doc_id"], r["para_no"], r["seg_no"], r["lang"]) for r in rows] == [(1, 2, 1, "en"), (1, 2, 2, "de")]
    text = "x\n" + mixed
    assert text[rows[1]["start_pos"] - 1 : rows[1]["end_pos"]] == SENTENCES["de"][1]
    assert {r["doc_id"]: r["lang"] for r in L.paragraphs(df.filter("doc_id > 1"), fitted).collect()} == {2: "fr", 4: "other"}

"""Problem 4: held-out pages of the labelled kinds, and edge cases."""

import pytest

from tessera.llm import labelled_blocks
from tessera.llm.boilerplate import classifier, link_density, main_text, site_lines


@pytest.fixture(scope="module")
def model():
    return classifier()


def test_held_out_accuracy(model):
    right = total = hits = found = wanted = 0
    for page in labelled_blocks.Maker(seed=991, foreign=True).pages(200):
        text = "\n".join(line for _, line in page)
        got = set(model.site_lines(text))
        want = {i for i, (label, _) in enumerate(page, 1) if label != "+"}
        right += len(page) - len(got ^ want)
        total += len(page)
        hits, found, wanted = hits + len(got & want), found + len(got), wanted + len(want)
    assert right / total > 0.96
    assert hits / found > 0.95 and hits / wanted > 0.95


#: Pages of kinds and languages whose lines the labelled table does not have; "-" marks lines of the site.
UNSEEN = """- Skip to article
- Front page | Region | Weather | Letters | Shop
The ferry between the two islands will stop running in October after the operator lost its licence, officials said on Tuesday.
Passengers who had bought season tickets were told that they would be paid back before the end of the year.
- Share on WhatsApp
Why the boats stopped
An inspector found that the older of the two boats had been repaired with parts that were never tested.
- Most viewed
- Ten walks for a wet weekend
- Manage consent
- © 2024 Island Courier Ltd
====
- Zum Hauptmenü springen
- Start | Region | Wetter | Leserbriefe | Abo
Die Fähre zwischen den beiden Inseln wird im Oktober eingestellt, weil der Betreiber seine Genehmigung verloren hat.
Fahrgäste, die Dauerkarten gekauft hatten, sollen ihr Geld vor dem Ende des Jahres zurückbekommen.
- Artikel teilen
- Impressum | Datenschutz | Kontakt
====
- Vai al menu principale
- Prima pagina | Cronaca | Meteo | Lettere | Abbonamenti
Il traghetto tra le due isole si fermerà a ottobre dopo che il gestore ha perso la licenza, hanno detto martedì i funzionari.
I passeggeri che avevano comprato un abbonamento saranno rimborsati prima della fine dell'anno.
- Condividi su Facebook
- Note legali | Privacy | Contatti"""


def test_unseen_sites_and_languages(model):
    right = total = 0
    for page in UNSEEN.split("\n====\n"):
        lines = page.split("\n")
        text = "\n".join(x.removeprefix("- ") for x in lines)
        got, want = set(model.site_lines(text)), {i for i, x in enumerate(lines, 1) if x.startswith("- ")}
        right, total = right + len(lines) - len(got ^ want), total + len(lines)
    assert right / total >= 0.85, (right, total)


def test_features():
    assert link_density("A | B | C | D") == 1
    assert link_density("MenuHomeNewsSportMoney") == 1
    assert link_density("The harbour was old, and the boats, which came in, were new.") < 0.5
    assert link_density("") == 0


PAGE = "Skip to main content\nHome | News | Sport | Money\n\nThe old harbour was opened again in May, and the first boats came in before the crowd.\nThree years on\nThe farmer asked the council for a bridge, because the river had crossed the road.\nMost read\nWhy the mayor of Aldham matters to every farmer\n© 2020 Northbeacon"


def test_pages(spark, model):
    assert model.site_lines(PAGE) == [1, 2, 7, 8, 9]
    long = PAGE + "\n" + "\n".join(["word " * 30 + "."] * 5000)
    rows = [(1, PAGE, 0), (2, None, 0), (3, "", 0), (4, "\n\n", 0), (5, PAGE, 0), (6, long, 0)]
    df = spark.createDataFrame(rows, "key long, body string, line_no int")
    got = {}
    for r in site_lines(df, "key", "body").collect():
        got.setdefault(r["id"], []).append(r["line_no"])
    assert got[1] == got[5] == [1, 2, 7, 8, 9]
    assert set(got) == {1, 5, 6}
    texts = {r["id"]: (r["text"], r["removed"]) for r in main_text(df, "key", "body").collect()}
    assert texts[1][0].startswith("\nThe old harbour") and texts[1][1] == 5
    assert texts[2] == (None, 0) and texts[3] == ("", 0)
    assert site_lines(df.limit(0), "key", "body").count() == 0

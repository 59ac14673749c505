import os
import random

import numpy as np
import pytest

from newsquery.llm import language_id as li
from newsquery.llm.common import in_share

TABLE = "/root/testdata/sf0.1/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(TABLE), reason="the driver's tables aren't here")
# real sentences: none of these languages is learned
FOREIGN = {
    "fi": "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Suomen kieltä puhuu äidinkielenään noin viisi miljoonaa ihmistä.",
    "hu": "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike. Legközelebbi rokonai a manysi és a hanti nyelv, majd utánuk az udmurt.",
    "pl": "Język polski należy do grupy zachodniosłowiańskiej, do której należą również czeski, kaszubski, słowacki i języki łużyckie. Jest jednym z oficjalnych języków Unii Europejskiej.",
    "nl": "Het Nederlands is een West-Germaanse taal, de meest gebruikte taal in Nederland en België, de officiële taal van Suriname en een van de drie officiële talen van België.",
    "tr": "Türkçe, Güneydoğu Avrupa ve Batı Asya'da konuşulan, Türk dilleri dil ailesine ait sondan eklemeli bir dildir. Türk dilleri ailesinin Oğuz dilleri grubuna bağlıdır.",
}
FOREIGN |= {
    "sv": "Svenska är ett östnordiskt språk som talas av ungefär tio miljoner personer, främst i Sverige där språket har en dominant ställning som huvudspråk, men även som det ena nationalspråket i Finland.",
    "cs": "Čeština je západoslovanský jazyk, nejbližší slovenštině, poté lužické srbštině a polštině. Patří mezi slovanské jazyky, do rodiny jazyků indoevropských.",
    "id": "Bahasa Indonesia adalah bahasa nasional dan resmi di seluruh wilayah Indonesia. Ini merupakan bahasa komunikasi resmi, diajarkan di sekolah dan digunakan untuk penyiaran di media elektronik dan digital.",
}
KNOWN = {
    "fr": "Le conseil municipal a voté mardi le nouveau budget des écoles et des routes, retardé pendant des mois par un désaccord sur le coût des réparations du vieux pont de pierre.",
    "es": "El ayuntamiento aprobó el martes el nuevo presupuesto para las escuelas y las carreteras, que se había retrasado durante meses por el desacuerdo sobre el coste de las reparaciones del puente viejo.",
    "en": "The city council voted on Tuesday to approve the new budget for schools and roads, which had been delayed for months by disagreement over the cost of repairs to the old bridge.",
    "de": "Der Stadtrat hat am Dienstag den neuen Haushalt für Schulen und Straßen beschlossen, der monatelang wegen der Kosten für die alte Brücke umstritten gewesen war.",
}


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(TABLE)
    return docs, li.fit(docs)


def test_foreign_languages_and_noise_are_rejected(spark, learned):
    docs, model = learned
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(k)) for k in (300, 3000, 30000) for _ in range(30)]
    texts = [*FOREIGN.values(), "Zm9vYmFyIGJhcmJhc2UgZm9vIQ" * 8, "漢字仮名交じり文" * 20, *noise]
    rows = spark.createDataFrame(list(enumerate([*texts, *KNOWN.values()])), "doc_id long, text string")
    got = [r["rejected"] for r in sorted(li.identify(rows, model).collect(), key=lambda r: r["doc_id"])]
    assert all(got[: len(FOREIGN) + 2]) and not any(got[len(texts) :])
    assert np.mean(got[len(FOREIGN) + 2 : len(texts)]) > 0.9


def test_learned_languages_stay(spark, learned):
    docs, model = learned
    known = docs.filter("text is not null and lang is not null and text rlike '\\\\p{L}'")
    got = li.identify(known, model, keep=("lang",)).toPandas()
    assert got.rejected.mean() <= 1e-3
    assert (got.lang_pred == got.lang).mean() > 0.98
    kept = li.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.filter("lang is not null").count() == (~got.rejected).sum()


def test_nearest_centroid_against_brute_force(spark, learned):
    docs, model = learned
    rows = docs.filter("doc_id < 60").collect()
    got = {r["doc_id"]: r for r in li.identify(docs.filter("doc_id < 60"), model).collect()}
    for r in rows:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        grams, weights = {}, {}
        padded = b" " + b" ".join(r["text"].lower().encode().translate(li._PART).split()) + b" "
        for n, factor in ((2, 2654435761), (3, 2246822519)):
            for i in range(len(padded) - 2 if n == 3 else len(padded) - 1):
                value = int.from_bytes(padded[i : i + n], "big") * factor % 2**32 >> 32 - 13
                grams[value] = grams.get(value, 0) + 1
        for g, n in grams.items():
            weights[g] = np.log1p(n) * float(model.idf[g])
        norm = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * float(c[g]) for g, w in weights.items()) / norm for c in model.centroids]
        assert abs(max(cosines) - got[r["doc_id"]]["score"]) < 1e-4
        assert model.languages[int(np.argmax(cosines))] == got[r["doc_id"]]["lang_pred"]


def test_very_long_texts_ties_repeats_and_clashing_names(spark, learned):
    _, model = learned
    long = KNOWN["en"] + " "
    rows = [(1, long * 20000, 0.5, "x"), (2, KNOWN["de"], 0.5, "y"), (2, KNOWN["de"], 0.5, "z"), (None, KNOWN["en"], 0.1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near double, languages string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["near"], r["languages"] or "") for r in li.identify(docs, model, keep=("near", "languages")).collect())
    assert got == [(0, "en", 0.1, ""), (1, "en", 0.5, "x"), (2, "de", 0.5, "y"), (2, "de", 0.5, "z")]
    assert sorted(map(str, li.accepted(docs, model).collect())) == sorted(map(str, docs.collect()))
    # equally near centroids: the first in the order of languages, whatever the order of rows
    twin = li.LanguageModel(("a", "b"), np.stack([model.centroids[0]] * 2), model.idf, np.zeros((len(li.LENGTHS), 2)))
    assert {r["lang_pred"] for r in li.identify(docs, twin).collect()} == {"a"}


def test_no_share_is_too_small_to_choose(spark):
    rows = spark.range(20_000_000)
    assert 5 <= rows.filter(in_share("id", 1e-6)).count() <= 50
    assert 100 <= rows.limit(10**6).filter(in_share("id", 200 / 10**6)).count() <= 300
    # as many of 10^12 as of 10^6: the share is a fraction of 2^62 hashes, not of millionths
    assert 500 / 10**12 * (1 << 62) > 1e9
    assert rows.limit(1000).filter(in_share("id", 1.0)).count() == 1000

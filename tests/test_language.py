"""Language profiles on sentences that no profile was taken from."""

import pytest

from curata.functions.language import detect_language

SENTENCES = [
    ("We propose deep networks improving accuracy by 5%", "en"), ("The results are shown in this table.", "en"),
    ("Os resultados são apresentados na tabela e não no texto", "pt"), ("Nós propomos uma rede para a deteção de falhas em sistemas", "pt"),
    ("I risultati della ricerca sono nel capitolo che segue", "it"), ("Questo metodo non si può usare per gli altri casi", "it"),
    ("Wij hebben de resultaten van het onderzoek in een tabel gezet", "nl"), ("Dit is niet de beste methode voor deze gegevens", "nl"),
    ("Les résultats de cette étude sont dans le tableau", "fr"), ("Die Ergebnisse werden in der Tabelle gezeigt", "de"),
    ("Los resultados del estudio se muestran en la tabla", "es"), ("12345 %%%", "unknown"), (None, "unknown"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)], "i int, s string")
    return {r.i: (r.a, r.b) for r in df.select("i", detect_language("s").alias("a"), detect_language("s", min_margin=50).alias("b")).collect()}


@pytest.mark.parametrize("i", range(len(SENTENCES)))
def test_sentence(found, i):
    assert found[i] == (SENTENCES[i][1], "unknown")

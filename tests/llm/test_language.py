import random
from pathlib import Path

import pytest

from stratograph.llm import language as g

TEXTS = {
    "en": "The {a} now reads the {b} before it writes anything back. Please check whether the {a} still depends on the {b}. Nobody noticed that the {b} was out of date. We would rather split the {a} than add another option.",
    "de": "Vor dem Speichern wird die {a} noch einmal mit der {b} verglichen. Leider hat niemand bemerkt, dass die {a} veraltet war. Wir möchten die {b} lieber aufteilen als noch eine Option hinzufügen. Bitte prüfen Sie die {a}.",
    "fr": "Avant la mise à jour, la {a} était trop lente. Merci de vérifier que la {b} dépend toujours de la {a}. Nous avons remarqué que la {b} ne trouvait plus rien depuis hier. Je préfère découper la {a} plutôt que d'ajouter une option.",
    "ja": "保存する前に{a}をもう一度比較します。それぞれのチームが{b}を担当しています。設定を増やすより{a}を分けるほうがよいと思います。",
    "zh": "每个团队负责自己的{a},但是{b}由大家共用。我们发现{a}在大型项目中打开得太慢。与其继续增加选项,不如把{b}拆分开来。",
}
NOUNS = {"en": ["report", "index", "parser", "graph"], "de": ["Abfrage", "Tabelle", "Anzeige"], "fr": ["requête", "recherche", "branche"], "ja": ["報告書", "索引"], "zh": ["报告", "索引"]}
CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("ja", "jpn", "Japanese"), ("zh", "zho", "Chinese"), (None, None, None)]


def text(lang, rng):
    return TEXTS[lang].format(a=rng.choice(NOUNS[lang]), b=rng.choice(NOUNS[lang]))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(TEXTS))
        rows.append((i, text(lang, rng), lang if rng.random() < 0.9 else rng.choice(sorted(TEXTS)), lang))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    codes = spark.createDataFrame(CODES, "lang_code string, iso3 string, english_name string")
    return rows, docs, codes, g.fit_model(docs, codes)


def test_accuracy_with_wrong_labels(data):
    rows, docs, _, model = data
    told = {r["doc_id"]: r for r in g.identify(docs, model).collect()}
    assert all(told[i]["langs"] == [lang] and told[i]["lang"] == lang and told[i]["confidence"] > 0.9 for i, _, _, lang in rows)


def test_cases(spark, data):
    _, _, codes, model = data
    rng = random.Random(8)
    T = {k: text(k, rng) for k in TEXTS}
    rows = [(1, T["en"], "en"), (2, T["en"], "en_GB"), (3, T["de"], " DE "), (4, T["fr"], "French"), (5, T["ja"], "jpn"), (6, T["zh"], None), (7, T["de"], ""), (8, T["fr"], "n/a"), (9, T["en"], "de"), (10, T["en"] + "\n\n" + T["de"], "en"),
            (11, T["en"] + " Bitte prüfen Sie die Abfrage.", "en"), (12, "```\nx = the_report(index)\nfor y in z: pass\n```", None), (13, None, "en"), (14, "", None), (15, T["fr"].upper(), "fr"), (16, g.fold(T["fr"]), "fr"), (17, T["en"] + "\n```\nder die das ist nicht gut\nund noch eine Zeile\n```\n", "en"), (18, T["zh"] + "\n" + T["ja"], "zh"), (1, T["en"], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in g.mislabelled(docs, codes, model).collect()}
    assert got == {(6, "zh"), (7, "de"), (8, "fr"), (9, "en"), (10, "de"), (10, "en"), (18, "zh"), (18, "ja")}
    segments = [r for r in g.segment_languages(docs, model).collect() if r["doc_id"] == 10]
    assert [(r["lang"], r["sentences"]) for r in sorted(segments, key=lambda r: r["begin"])] == [("en", 4), ("de", 4)]
    assert g.mislabelled(docs.limit(0), codes, model).count() == 0
    empty = g.fit_model(docs.limit(0), codes)
    assert empty.langs == [] and g.identify(docs, empty).filter("lang IS NOT NULL").count() == 0


def test_quotes_are_passages(spark, data):
    _, _, codes, model = data
    rng = random.Random(4)
    T = {k: text(k, rng) for k in TEXTS}
    output = "> $ build the report\n> ERROR: der die das ist nicht gut\n> >>> der_bericht(nicht)\n>     Leider hat niemand bemerkt\n> ```\n> Leider ist das nicht gut.\n> Bitte prüfen Sie die Abfrage.\n> ```\n>>> Leider ist das nicht gut. Bitte prüfen Sie die Abfrage."
    rows = [(1, T["en"] + "\n\n> " + T["de"], "en"), (2, "> " + T["fr"], "de"), (3, T["en"] + "\n\n> > " + T["fr"] + "\n\n" + T["en"], None), (4, T["en"] + "\n\n" + output + "\n\n" + T["en"], "en"), (5, T["en"] + "\n\n> ```\n> x = 1\n\n" + T["de"], "en"), (6, ">" + T["en"], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in g.mislabelled(docs, codes, model).collect()} == {(1, "en"), (1, "de"), (2, "fr"), (3, "en"), (3, "fr"), (5, "en"), (5, "de")}
    quoted = [r for r in g.segment_languages(docs, model).collect() if r["doc_id"] == 1 and r["lang"] == "de"]
    assert [(rows[0][1][r["begin"]:r["end"]], r["sentences"]) for r in quoted] == [(T["de"], 4)]


def test_passages_in_lists_and_tables(spark, data):
    _, _, codes, model = data
    rng = random.Random(6)
    T = {k: text(k, rng) for k in TEXTS}
    lines = {k: [x.strip() + "." for x in T[k].split(".") if x.strip()] for k in ("de", "fr", "en")}
    items = "\n".join(f"- {x}" for x in lines["de"])
    table = "| Step | Remark |\n|---|---|\n" + "\n".join(f"| {i} | {x} |" for i, x in enumerate(lines["fr"]))
    rows = [(1, T["en"] + "\n\n" + items, "en"), (2, T["en"] + "\n\n" + table + "\n", "en"), (3, T["de"] + "\n\n1. " + "\n2. ".join(lines["en"]), "de"), (4, T["en"] + "\n\n| name | value |\n|---|---|\n| `a_b` | 12 |\n| x.py | 3 |\n", "en"), (5, "- " + "\n- ".join(lines["fr"]), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in g.mislabelled(docs, codes, model).collect()} == {(1, "en"), (1, "de"), (2, "en"), (2, "fr"), (3, "de"), (3, "en")}


def test_sample_is_bounded_and_whole(spark, data):
    """At most so many rows a language, read to their end, and labels that are wrong are corrected."""
    rng = random.Random(7)
    rows = [(i, text("en", rng), "en") for i in range(60)] + [(100 + i, text("de", rng) if i % 3 else text("en", rng), "de") for i in range(60)] + [(999, "Nothing here. " * 4000 + "Zwölf Boxkämpfer jagen.", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = g.fit_model(docs, data[2], rows=30)
    assert model.langs[int(model.word("niemand").argmax())] == "de" and model.langs[int(model.word("nobody").argmax())] == "en"
    assert "boxkämpfer" in model.tables[0][0]


def test_backoff_for_unseen_words(data):
    model = data[3]
    assert model.word("unbemerktheiten") is not None and model.langs[int(model.word("unbemerktheiten").argmax())] == "de"
    assert g.words("Ab 保存する x'y") == ["ab", "保存", "存す", "する", "x'y"]


def test_long_text_in_time(data):
    model = data[3]
    assert g.document_languages(model.segments(TEXTS["en"].format(a="index", b="parser") * 3000))[2] == ["en"]
    assert g.document_languages(model.segments("x" * 300_000)) is not None


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test data")
def test_all_queries_run_on_data(spark):
    from stratograph.llm import registry

    for name, query in registry.queries().items():
        assert query(spark, "/root/testdata/sf0.001").count() >= 0, name

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespan.llm import languages
from kinespan.llm.prose import folded, repaired, stretches
from kinespan.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


def test_labels(spark):
    cases = {
        "en": ["en"], "EN": ["en"], "en-GB": ["en"], "es_419": ["es"], "English": ["en"], "inglés": ["en"], "de;en": ["de", "en"], "pt es en": ["en", "es", "pt"], "fr/it": ["fr", "it"], "por": ["pt"],
        "unknown": [], "und": [], "??": [], "n/a": [], "xx": [], "": [], None: [], "français": ["fr"], "en+en": ["en"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "lang string")
    got = {r["lang"]: r["c"] for r in df.select("lang", languages.named_languages(F.col("lang")).alias("c")).collect()}
    assert got == cases


def test_prose_is_told_from_code():
    text = 'x = open_store("a", mode="b")\n# The helper sorts the list of names.\n# It is `a_b`: then done (3/40).\ndef f(a, b):\n    return a[1]\nprint("Der Leser zeigt die")\nprint("langsamen Bilder nicht.")\nx = 1\nid BIGINT PRIMARY KEY,\n'
    found = stretches(text)
    assert [" ".join(s.words) for s in found] == ["the helper sorts the list of names", "it is", "then done", "der leser zeigt die langsamen bilder nicht"]
    assert all(text[s.start : s.end] for s in found)
    assert stretches("") == [] and stretches("a,1\nb,2\n") == []
    assert repaired("maÃ±ana") == "mañana" and folded("MÁS ñ") == "mas n"


def test_very_long_text_and_long_lines():
    found = stretches("/* " + "The reader writes the list of names again. " * 20_000 + "*/\n" + "var a=[" + "1," * 200_000 + "];\n")
    assert sum(len(s.words) for s in found) == 160_000


@pytest.fixture(scope="module")
def model(spark):
    return languages.fitted_model(table(spark, FOLDER, "documents").where("doc_id % 4 <> 0"))


def test_held_out_labels(spark, model):
    """Documents that took no part in the fit: a label of one language is mostly right, and then it is found."""
    held = table(spark, FOLDER, "documents").where("doc_id % 4 = 0").withColumn("c", languages.named_languages(F.col("lang"))).where(F.size("c") == 1)
    found = languages.languages_of(held, ["doc_id", "c"], "text", model).where("n_words >= 25").collect()
    hit = sum(r["c"][0] in {x["lang"] for x in r["languages"]} for r in found)
    assert len(found) > 60 and hit / len(found) > 0.75


def test_mixed_document(spark, model):
    text = (
        "# The task queue sorts the list of children before closing, even if nobody asked for it. The helper shows the time stamps for every session.\n"
        "x = 1\n# El ayudante guarda los datos del taller con mucho cuidado, aunque nadie lo haya pedido. La plantilla compara los cuadros vacíos en la carpeta común.\n"
    )
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "a = b\n", "k")], "doc_id int, text string, languages string")
    found = {r["doc_id"]: r for r in languages.languages_of(df, ["doc_id", "languages"], "text", model).collect()}
    assert {(x["lang"], x["n_words"]) for x in found[1]["languages"]} == {("en", 25), ("es", 25)}
    assert [s["lang"] for s in found[1]["segments"]] == ["en", "es"]
    assert all(0.9 < x["confidence"] <= 1 for x in found[1]["languages"])
    assert all(found[i]["languages"] == [] and found[i]["n_words"] == 0 for i in (2, 3, 4))
    main = {r["doc_id"]: (r["language"], r["confidence"]) for r in languages.main_language(languages.languages_of(df, ["doc_id"], "text", model)).collect()}
    assert main[1][0] == "en" and main[2] == ("und", 0.0)


def test_no_labels_and_empty(spark, model):
    df = spark.createDataFrame([(1, "# Helpers sort lists of names.", None)], "doc_id long, text string, lang string")
    assert languages.fitted_model(df) is None
    assert languages.languages_of(df, ["doc_id"], "text", None).first()["languages"] == []
    assert languages.languages_of(df.where("false"), ["doc_id"], "text", model).count() == 0


def test_a_corpus_without_labels_is_told_by_seed_words(spark, model):
    bare = table(spark, FOLDER, "documents").withColumn("lang", F.lit(None).cast("string"))
    alone = languages.fitted_model(bare)
    assert set(model.languages) <= set(alone.languages)
    told = lambda m: {(r["doc_id"], x["lang"]) for r in languages.languages_of(bare, ["doc_id"], "text", m).collect() for x in r["languages"] if x["n_words"] >= 25}
    with_labels, without = told(model), told(alone)
    assert len(with_labels & without) / len(with_labels | without) > 0.94


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_offsets_are_those_of_the_stored_text(end):
    text = end.join([
        "x = 1", "# The helper sorts the list of names. It is", "# called `a_b` by the reader &amp; the writer.", "def f(a):", "    return a[1]", "", "# maÃ±ana guardamos los cuadros vacÃ\xados en la carpeta.",
        'print("Der Leser zeigt die")', 'print("langsamen Bilder nicht.")', "y = 2",
    ])
    found = stretches(text)
    assert len(found) == 4
    for s, first, last in zip(found, ("The", "It", "ma", "Der"), ("names.", "writer.", "carpeta.", "nicht.")):
        part = text[s.start : s.end]
        assert part.startswith(first) and part.endswith(last)
    inside = [w for s in found[:2] for w in s.words]
    assert inside == "the helper sorts the list of names it is called by the reader the writer".split()


def test_segments_hold_their_words(spark, model):
    """Of every segment of the whole table the text at its offsets has at least its words, in order of the text and without overlap."""
    documents = table(spark, FOLDER, "documents")
    found = languages.languages_of(documents, ["doc_id"], "text", model).join(documents.select("doc_id", "text"), "doc_id").collect()
    seen = 0
    for r in found:
        last = 0
        for s in r["segments"]:
            assert last <= s["start"] < s["end"] <= len(r["text"])
            last, seen = s["end"], seen + 1
            part = folded(repaired(r["text"][s["start"] : s["end"]]))
            assert len(part.split()) >= s["n_words"] * 0.5 and part[0].strip() and part[-1].strip()
        assert sum(s["n_words"] for s in r["segments"]) == r["n_words"] == sum(x["n_words"] for x in r["languages"])
    assert seen > 500


def test_mixture_drops_a_language_without_evidence():
    score = np.log(np.array([[0.9, 0.1, 1e-6], [0.8, 0.2, 1e-6], [1e-6, 1e-6, 0.9]]))  # two sentences alike, one other
    theta, p = languages.mixtures(score * 5, np.array([10.0, 10.0, 10.0]), np.array([0, 0, 1]))
    assert theta[0].argmax() == 0 and theta[0, 1] == 0 and theta[1].argmax() == 2
    assert p.argmax(axis=1).tolist() == [0, 0, 2]


def test_a_second_language_is_found_in_a_very_long_text():
    """30 of 40,030 words are in the second language: under a thousandth, but with evidence enough."""
    score = np.zeros((4003, 3))
    score[:4000, 0], score[4000:, 1] = 20, 20
    theta, p = languages.mixtures(score, np.full(4003, 10.0), np.zeros(4003, int))
    assert theta[0, 1] > 0 and theta[0, 2] == 0 and p[4000:].argmax(axis=1).tolist() == [1, 1, 1]


def test_signs_within_a_sentence_do_not_lose_its_line():
    text = (
        "# The helper sorts the names; the reader shows them.\n\n# See [the long guide](https://a.example/b_c) for the rest of it.\n\n"
        "# Write to a.b@example.org before the next of the meetings.\n\n# The field user_id holds the name of it.\n\nx = a; y = b; z = c\nfor (i = 0; i < n; i++) { run(i); }\n"
    )
    found = stretches(text)
    assert [" ".join(s.words) for s in found] == [
        "the helper sorts the names the reader shows them", "see the long guide for the rest of it", "write to before the next of the meetings", "the field holds the name of it",
    ]
    assert [text[s.start : s.end].split()[0] for s in found] == ["The", "See", "Write", "The"]
    assert [text[s.start : s.end].split()[-1] for s in found] == ["them.", "it.", "meetings.", "it."]
    assert stretches('[{"id":1,"k":"ab","v":0.7},\n{"id":2,"k":"cd","v":0.5},\n{"id":3,"k":"ef","v":0.1}]') == []

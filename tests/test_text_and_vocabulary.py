from pyspark.sql import functions as F

from rolewright.functions import text as T
from rolewright.functions import vocab as V
from rolewright.operators import languages as G
from rolewright.operators import lines as N
from rolewright.operators import mentions as M
from rolewright.operators.judge import same_wording


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def tagged(spark, aliases, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return M.tag_mentions(df, ["id"], "text", aliases).collect()


def test_fold_keeps_length_and_clean_text_keeps_lines(spark):
    assert one(spark, "Éàß ²", T.fold) == "eaß 2"
    assert one(spark, "a ​ ‘b’\r\n\r\n\r\n\tc ﬁ ", T.clean_text) == "a 'b'\n\nc fi •"


def test_html_is_decoded_once_and_list_items_become_bullets(spark):
    assert one(spark, "&lt;p&gt;a&amp;amp;b&lt;/p&gt;&lt;ul&gt;&lt;li&gt;x &#8364; &eacute;&lt;/li&gt;&lt;/ul&gt;", T.html_to_text) == "a&b\n\n• x € é"
    assert one(spark, "<script>x</script><div>a&amp;lt;b</div>", T.html_to_text) == "a&lt;b"


def test_tokens_drop_stopwords_and_plurals(spark):
    assert one(spark, "The C++ engineers and class of React", T.tokens) == ["c++", "engineer", "class", "react"]


def test_packed_sentences_respect_the_limit(spark):
    packed = one(spark, "Aa bb. Cc dd. Ee ff. Gg hh.", lambda c: N.pack_sentences(c, 14))
    assert packed == ["Aa bb. Cc dd.", "Ee ff. Gg hh."]


def test_aliases_map_to_canonical_names(spark, skills, aliases):
    terms = spark.createDataFrame([(t,) for t in ("sklearn", "AMDEC", "Power-BI", "k8s", "GMAO", "not a skill at all")], "t string")
    got = {r.term: r.skill for r in M.canonicalise(terms, "t", skills, aliases).collect()}
    assert got == {"sklearn": "scikit-learn", "AMDEC": "FMEA", "Power-BI": "Power BI", "k8s": "Kubernetes", "GMAO": "CMMS", "not a skill at all": None}


def test_french_terms_and_ambiguous_words(spark, aliases):
    found = {r.skill for r in tagged(spark, aliases, "Analyse vibratoire, maintenance préventive et AMDEC sur GMAO (SAP PM).")}
    assert {"Vibration analysis", "Preventive maintenance", "FMEA", "CMMS", "SAP PM"} <= found
    plain = {r.skill for r in tagged(spark, aliases, "R&D engineer. I excel at teamwork. Rust removal on rails. Go/No-Go reviews.")}
    assert not plain & {"R", "Excel", "Rust", "Go"}
    assert {"Python", "R", "C", "C++", "SQL"} <= {r.skill for r in tagged(spark, aliases, "Languages: Python, R, C/C++, SQL")}


def test_members_weak_hits_and_overlaps(spark, aliases):
    hits = {r.surface: r for r in tagged(spark, aliases, "Dashboards in Plotly, vibration data, data visualization")}
    assert hits["Plotly"].member and hits["Plotly"].skill == "Data visualization"
    assert hits["vibration data"].weak and not hits["data visualization"].member
    assert [r.surface for r in tagged(spark, aliases, "tableau de bord, Tableau de bord")] == []


def test_phrase_hits_match_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(7)
    words = ["aa", "bb", "cc", "dd"]
    phrases = ["aa bb", "bb cc", "cc", "aa bb cc", "dd aa"]
    texts = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(40)]
    table = V.phrases(spark, [(p, p) for p in phrases])
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.pos, r.skill) for r in M.tag_mentions(df, ["id"], "text", table).collect())
    expected = []
    for i, text in enumerate(texts):
        ws, at = text.split(), 0
        while at < len(ws):
            fits = [p for p in phrases if ws[at : at + len(p.split())] == p.split()]
            if fits:
                best = max(fits, key=len)
                expected.append((i, at + 1, best))
                at += len(best.split())
            else:
                at += 1
    assert got == sorted(expected)
    assert list(itertools.islice(got, 1))


def test_implied_skills_name_their_source(spark, skills):
    owned = spark.createDataFrame([("x", "SAP PM"), ("x", "PyTorch")], "o string, skill string")
    got = {r.skill: r.implied_by for r in M.implied_skills(owned, "o", V.implication_closure(V.implies_edges(skills))).collect()}
    assert got["CMMS"] == "SAP PM" and got["Machine learning"] == "PyTorch" and got["PyTorch"] is None


def test_language_levels(spark):
    assert one(spark, "Fluent in French (C1) and English; Arabic: native. Allemand: notions", G.language_levels) == {
        "French": 4, "English": 4, "Arabic": 5, "German": 1,
    }
    assert one(spark, "Langues : Arabe (langue maternelle), Français (courant), Anglais (B2)", G.language_levels) == {
        "Arabic": 5, "French": 4, "English": 3,
    }


def test_same_wording(spark):
    pairs = [("Excel avancé", "Excel"), ("modélisation des données", "Modélisation de données"), ("statistiques", "statistique"), ("Postgres", "PostgreSQL"), ("AMDEC", "FMEA")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in df.select(same_wording(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, True, False, False]


def test_redaction_counts_each_kind_once_and_keeps_years(spark):
    text = "Jane Doe\njane.doe@mail.example | +216 22 333 444 | linkedin.com/in/x\n12 rue de Paris, Tunis\n2021 - 2023 Jane Doe"
    r = N.redact(spark.createDataFrame([(1, text)], "id int, text string"), "text").first()
    assert (r.n_email, r.n_phone, r.n_link, r.n_address, r.n_name) == (1, 1, 1, 1, 1)
    assert "2021 - 2023 [name]" in r.text and "Jane" not in r.text

import awkward
from hypothesis import given, settings
from hypothesis import strategies as st

from citeflow.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=8, unique=True), st.lists(st.text("abcd", max_size=13), max_size=20))
def test_automaton_equals_edit_distance(terms, words):
    lexicon = X.FuzzyLexicon({t: float(i) for i, t in enumerate(terms)})
    for w in words:
        near = [(distance(w, t), -i, i) for i, t in enumerate(terms) if distance(w, t) <= X.FuzzyLexicon.edits(t)]
        got = lexicon.find(w)
        assert got == ((min(near)[2], min(near)[0]) if near else None)


def test_stems_match_longer_words_only_as_written():
    lexicon = X.FuzzyLexicon({"idio*": 3.0, "idiot": 5.0, "moro*": 4.0})
    assert [lexicon.find(w) for w in ("idiotisch", "idiot", "idoot", "moronic", "mxronic", "moro", "xidio")] \
        == [(0, 0), (1, 0), (1, 1), (2, 0), None, None, None]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = X.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic]
    clean = [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)      # some labels there stand for text that was lost
    assert sum(r.predicted for r in clean) <= 0.005 * len(clean)


def model():
    m = X.Model({"idiot": 5.0, "worthless": 5.0}, frozenset())
    m.coef = X._logistic(__import__("numpy").array([[0, 0, 0]] * 50 + [[5, 5, 5]] * 50 + [[10, 5, 9]] * 20, float),
                         __import__("numpy").array([0] * 50 + [1] * 70))
    return m.opened()


def test_context_separates_quotation_from_abuse():
    m = model()
    score = lambda t: float(m.score(m.evidence([t]))[0])
    abuse, misspelt = score("you are an idiot and worthless"), score("you are an idi0t and w0rthless")
    quoted, reported = score('the sign read "you are an idiot" and was removed'), score("he called her an idiot")
    assert abuse > misspelt > quoted > 0 and abuse > reported
    assert misspelt >= 0.7 and score("a fine day") < 0.1 and score("") < 0.1


def test_awkward_rows(spark):
    docs, labels = awkward.documents(spark), awkward.labels(spark, "toxic")
    got = X.toxicity(docs, X.train(docs, labels)).collect()
    assert len(got) == len(awkward.rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = X.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in X.toxicity(docs, none).collect()} == {0.0}
    assert X.toxicity(awkward.empty(spark), X.train(awkward.empty(spark), labels)).count() == 0


def test_an_ordinary_word_near_a_term_leaves_its_misspellings(spark):
    """'oron' is a word of clean texts; 'moron' still takes all its other misspellings, whatever the sample's size."""
    for copies in (1, 10):
        rows = [(i, f"text {i} you moron {i}" if i % 2 else f"the oron of day {i} was fine") for i in range(60 * copies)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
        lexicon = X.train(docs, labels).opened().lexicon
        found = {w: lexicon.find(w) for w in ("moron", "m0ron", "morron", "moro", "oron")}
        assert found["oron"] is None and found["moron"][1] == 0
        assert all(lexicon.terms[found[w][0]] == "moron" and found[w][1] == 1 for w in ("m0ron", "morron", "moro"))

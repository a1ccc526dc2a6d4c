"""The rules' vocabularies, stated here by themselves: a wrong constant in
``lexicons.py`` would be wrong on both sides of an oracle that shares it."""

from pyspark.sql import functions as F

from pvlens.functions.lexicons import DEFAULT_SYMPTOMS
from pvlens.operators.severity import severity_label
from pvlens.operators.symptoms import extract_symptoms

# FIXED VALUES: keywords of the severity labeller by level; the first level with a
# keyword anywhere in the text wins
LEVELS = {
    "mild": ["mild", "slight", "minor", "minimal", "light", "low", "small"],
    "moderate": ["moderate", "medium", "intermediate", "average"],
    "severe": ["severe", "serious", "extreme", "high", "intense", "major", "critical", "life-threatening", "lethal"],
}
# FIXED VALUES: some built-in symptoms, and how many there are
SOME_SYMPTOMS = ["headache", "shortness of breath", "loss of appetite", "hematochezia", "photophobia", "dyspepsia"]
N_SYMPTOMS = 83


def labelled(text):
    low = text.lower()
    return next((level for level, words in LEVELS.items() if any(w in low for w in words)), "unknown")


def test_labeller(spark):
    words = [w for ws in LEVELS.values() for w in ws]
    texts = [f"a {w.upper()} ache" for w in words] + [f"{a}, then {b}" for a in words[::3] for b in words[1::4]]
    texts += ["no words of grade", "slow onset", "", "highlight"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(severity_label(F.col("t"))).collect()] == [labelled(t) for t in texts]


def test_symptoms(spark):
    assert len(set(DEFAULT_SYMPTOMS)) == N_SYMPTOMS
    df = spark.createDataFrame([(f"Some {s.title()}, or more",) for s in SOME_SYMPTOMS], "t string")
    assert [r[0] for r in df.select(extract_symptoms(F.col("t"))).collect()] == [[s] for s in SOME_SYMPTOMS]

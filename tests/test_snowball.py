"""Snowball English stems against published sample vocabulary, and the vocabulary job."""

from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.functions.snowball import stem
from lexiflow.operators import vocabulary as V

# Sample input/output pairs of the published English stemmer.
SAMPLES = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consisting": "consist", "consists": "consist",
    "consolation": "consol", "consolations": "consol", "consolatory": "consolatori",
    "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid",
    "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol",
    "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort",
    "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu",
    "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir",
    "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir",
    "constable": "constabl", "constables": "constabl", "constance": "constanc",
    "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave",
    "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee",
    "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee",
    "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif",
    "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit",
    "knits": "knit", "knitted": "knit", "knitting": "knit", "knives": "knive", "knob": "knob",
    "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker",
    "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot",
    "knots": "knot",
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "running": "run",
    "hopping": "hop", "hoped": "hope", "generously": "generous", "skies": "sky", "by": "by",
    "interception": "intercept", "lawful": "law", "handover": "handov",
}


def test_published_samples():
    wrong = {w: (stem(w), s) for w, s in SAMPLES.items() if stem(w) != s}
    assert not wrong


def test_stem_vocabulary_job(spark):
    docs = spark.createDataFrame([(1, "knights knitting consolingly"), (2, "")], "doc_id long, text string") \
        .select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    got = {r["doc_id"]: r["tokens"] for r in V.normalise_vocabulary(docs, stem).collect()}
    assert got == {1: ["knight", "knit", "consol"], 2: []}

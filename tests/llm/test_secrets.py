import random

from pyspark.sql import functions as F

from tallyfold.llm import secrets

from .helpers import docs


def made():
    rnd = random.Random(10)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows, hidden = [], {}
    for k in range(240):
        text = " ".join(rnd.choice(["some", "plain", "words", "stand", "around"]) for _ in range(20))
        if k % 3 == 0:
            hidden[k] = hexes(40)
            text += f' {rnd.choice(["token", "api_key", "password"])} = "{hidden[k]}" {text}'
        elif k % 3 == 1:
            text += f" commit {hexes(40)} at https://example.com/{hexes(20)}/x9 or card {rnd.randrange(10**15, 10**16)} {text}"
        rows.append((k, text))
    return rows, hidden


def test_finds_and_redacts(spark):
    rows, hidden = made()
    extra = [(900, None), (901, ""), (902, "a\u0001b " + "w " * 20000 + 'token = "' + "0123456789abcdef" * 2 + '"'), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]
    df = docs(spark, rows + extra)
    found = secrets.findings(df)
    got = found.collect()
    texts = dict(rows + extra[:3])
    for r in got:
        if r.doc_id is not None:
            assert texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate
    flagged = {(r.doc_id, r.candidate) for r in got if r.secret}
    assert {(k, v) for k, v in hidden.items()} <= flagged
    assert all(k in hidden or k in (None, 902) for k, _ in flagged)
    assert any(not r.secret for r in got)
    clean = secrets.redact(df, found)
    assert clean.columns == df.columns and clean.count() == len(rows) + len(extra)
    left = {r[0]: r[1] for r in clean.collect()}
    for k, t in rows:
        assert left[k] == (t.replace(hidden[k], secrets.REDACTED) if k in hidden else t)
    assert left[900] is None and left[901] == "" and left[902].endswith('token = "[secret]"') and left[902].startswith("a")


def test_own_labels_and_one_class(spark):
    rows, hidden = made()
    df = docs(spark, rows)
    found = secrets.candidates(df).withColumn("label", F.lit(1.0))
    assert secrets.findings(df, found).where("not secret").count() == 0
    assert secrets.findings(df, found.limit(0)).where("secret").count() == 0
    assert secrets.findings(docs(spark, [])).count() == 0


def test_forest_on_held_out_findings(spark):
    rows, _ = made()
    found = secrets.distant_labels(secrets.candidates(docs(spark, rows)))
    learn = found.where("row % 2 = 0")
    scored = secrets.findings(docs(spark, rows), learn).join(found.where("row % 2 <> 0").select("row", "part", "label"), ["row", "part"])
    right, total = scored.agg(F.sum((F.col("secret") == (F.col("label") == 1)).cast("int")), F.count("*")).first()
    assert total > 40 and right / total > 0.95


def test_unspaced_names_parameters_and_ends_of_sentences(spark):
    rows, _ = made()
    key = "AKIA" + "Q7ZT" * 4
    told = {
        1000: ("export DB_PASSWORD=Sup3rS3cretPassw0rd now", "Sup3rS3cretPassw0rd"),
        1001: ("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG+bPxRfiCY09+kEy1aaa and", "wJalrXUtnFEMI/K7MDENG+bPxRfiCY09+kEy1aaa"),
        1002: ("API_TOKEN=ghp_16C7e42F292c6912E7710c838347Ae178B4a", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"),
        1003: ("see https://a.example/x?token=ab12cd34ef56ab78&next=/home/page1 there", "ab12cd34ef56ab78"),
        1004: ('SERVICE_2_SECRET_ACCESS_KEY="9f8e7d6c5b4a39281706f5e4d3c2b1a0"', "9f8e7d6c5b4a39281706f5e4d3c2b1a0"),
        1005: (f"The old one was {key}.", key + "."),
        1006: ("and FOO_BAR=ghp_16C7e42F292c6912E7710c838347Ae178B4a.", "ghp_16C7e42F292c6912E7710c838347Ae178B4a."),
        1007: ("password=Pa55!word#9$ then", "Pa55!word#9$"),
    }
    df = docs(spark, rows + [(k, t) for k, (t, _) in told.items()])
    found = secrets.candidates(df).where("doc_id >= 1000")
    labels = {(r.doc_id, r.candidate): r.label for r in secrets.distant_labels(found).collect()}
    assert all(labels.get((k, v)) == 1.0 for k, (_, v) in told.items()), labels
    flagged = {(r.doc_id, r.candidate) for r in secrets.findings(df).where("secret").collect()}
    assert {(k, v) for k, (_, v) in told.items()} <= flagged


def test_dictionary_counts_all_texts_and_copies_once(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    made_up = [("word" + str(k).translate(letters) + end,) for k in range(10_000) for end in ("", " hidden")]
    ranked = [r.t for r in spark.createDataFrame(made_up, "t string").orderBy(F.xxhash64("t")).collect()]
    # 5,000 texts of small hash, and behind them 400 texts with one word in common.
    rows = [(k, t) for k, t in enumerate([t for t in ranked if " " not in t][:5000] + [t for t in ranked if " " in t][-400:])]
    df = docs(spark, rows + [(9000, "copied")] * 900)
    assert secrets.dictionary(df, secrets.Settings(dictionary=1)).collect()[0].word == "hidden"


def test_long_candidates_are_taken_whole(spark):
    rnd = random.Random(3)
    value = "".join(rnd.choice("abcdefGHIJKL0123456789+/") for _ in range(10_000))
    late = "abcdefghij" * 20 + "7"
    rows = [(0, f"token={value}!x end"), (1, f"see {value}== here"), (2, f"and {late} here"), (3, f'password: "{"!pA5" * 250_000}" and')]
    df = docs(spark, rows)
    got = {r.doc_id: r.candidate for r in secrets.candidates(df).collect()}
    assert got == {0: value + "!x", 1: value + "==", 2: late, 3: "!pA5" * 250_000}
    found = secrets.candidates(df).withColumn("secret", F.lit(True))
    left = {r[0]: r[1] for r in secrets.redact(df, found).collect()}
    assert left == {0: "token=[secret] end", 1: "see [secret] here", 2: "and [secret] here", 3: 'password: "[secret]" and'}

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.functions import phonetics, phrases


def variants(spark, phrase, made):
    return spark.createDataFrame([(phrase,)], "phrase string").select(made(F.col("phrase")).alias("v")).first()["v"]


def test_families(spark):
    assert variants(spark, "hey bob", phrases.casing_variants) == ["hey bob", "HEY BOB", "Hey Bob", "Hey bob", "HeY BoB"]
    assert variants(spark, "hey there bob", phrases.punctuation_variants) == ["hey there bob", "hey, there bob", "hey there, bob", "hey there bob,", "hey there bob.", "hey there bob!", "hey there bob?"]
    assert variants(spark, "hey", phrases.punctuation_variants) == ["hey"]
    assert variants(spark, "a b", phrases.spacing_variants) == ["a b", "a  b", " a b ", " a b", "a b ", "a\tb"]
    assert len(variants(spark, "hey bob", phrases.affix_variants)) == 1 + 4 + 5 + 9
    assert variants(spark, "hey, bob", phrases.contraction_variants) == ["hey, bob", "hi, bob", "hay, bob"]
    assert variants(spark, "it's 2nd", lambda p: F.array(phrases.titled(p))) == ["It'S 2Nd"]


def test_generated(spark):
    df = spark.createDataFrame([("hey  bob",), ("  ",)], "phrase string")
    got = [r["variant"] for r in phrases.generate_variants(df, 20).orderBy("rank").collect()]
    assert got[:4] == ["hey bob", "HEY BOB", "Hey Bob", "hey bob!"] and len(set(got)) == 20
    assert got == [r["variant"] for r in phrases.generate_variants(df.repartition(3), 20).orderBy("rank").collect()]
    with pytest.raises(ValueError, match="at least 1"):
        phrases.generate_variants(df, 0)


def test_substitutions(spark):
    assert variants(spark, "hey to", phrases.homophones) == ["hay to", "hey too", "hey two"]
    assert set(variants(spark, "hat", phrases.vowel_substitutions)) == {"het", "hit", "hot", "hut"}
    assert "hephat" not in variants(spark, "hat", phrases.consonant_substitutions)
    assert set(variants(spark, "off", phrases.consonant_substitutions)) == {"ovf", "ophf", "ofv", "ofph"}
    assert variants(spark, "(marvin)", phrases.homophones) == ["(marven)"]
    assert "mar" + "ven" in variants(spark, "marvin", phrases.rhymes)
    assert variants(spark, "heya bob", phrases.prefix_substitutions) == ["hay bob", "say bob", "pay bob", "way bob"]
    assert "marbin" in variants(spark, "marvin", phrases.cluster_substitutions)
    every = variants(spark, "Hey Marvin", phrases.confusion_candidates)
    assert "hey marvin" not in every and len(every) == len(set(every)) and all(e == e.lower() for e in every)


def test_similarity():
    s = phonetics.phrase_similarity
    assert s("hey marvin", "hey marvin") == s("HEY MARVIN", "hey marvin") == 1.0
    assert s("hey marvin", "hay marvin") > 0.6
    assert s("hello world", "zyxwvutsrqpon") < 0.5
    assert s("", "hello") == s(None, "hello") == 0.0
    assert phonetics.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert phonetics.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    for word, code in {"metaphone": "MTFN", "knight": "NT", "wright": "RT", "school": "SKL", "thing": "0NK", "xenon": "SNN", "judge": "JJ", "phone": "FN", "": "", "123": ""}.items():
        assert phonetics.metaphone(word) == code


def test_confusions_are_the_most_similar(spark):
    got = phonetics.confusions(spark.createDataFrame([("hey marvin",)], "phrase string"), 5, 0.7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(r["similarity"] >= 0.7 for r in got)
    assert [r["similarity"] for r in got] == sorted((r["similarity"] for r in got), reverse=True)


@pytest.mark.parametrize("strategy", ["random", "sentence", "topic", "unknown"])
def test_synthetic(spark, strategy):
    words = ["the", "cat", "dog", "runs", "jumps", "high", "low", "marvin"]
    got = [r["phrase"] for r in phrases.synthetic_negatives(spark, words, "hey_marvin", 20, strategy=strategy).collect()]
    assert len(got) == len(set(got)) == 20 and not any("marvin" in p.split() for p in got)
    sizes = {len(p.split()) for p in got}
    assert sizes == {3} if strategy == "sentence" else sizes <= {2, 3, 4}


def test_synthetic_errors(spark):
    with pytest.raises(ValueError, match="empty"):
        phrases.synthetic_negatives(spark, [], "a", 1)
    with pytest.raises(ValueError, match="in order"):
        phrases.synthetic_negatives(spark, ["a"], "b", 1, 3, 2)

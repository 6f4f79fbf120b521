"""Treebank tokens by hand (public Penn Treebank conventions), written apart from the rule table."""

import pytest

from textpairs.functions.treebank import treebank_detokenise, treebank_tokenise

GOLDEN = {
    "I cannot go.": "I can not go .",
    "We're gonna win, aren't we?": "We 're gon na win , are n't we ?",
    "Lemme see; gimme that!": "Lem me see ; gim me that !",
    "I wanna and I gotta.": "I wan na and I got ta .",
    "Mr. Smith met Dr. Jones.": "Mr. Smith met Dr. Jones .",
    "I'd've said so": "I 'd 've said so",
    "She said \"yes.\"": "She said `` yes . ''",
    "'Tis true": "'T is true",
    "John's $3.88 (or 2,000)": "John 's $ 3.88 ( or 2,000 )",
    "wait... what--now": "wait ... what -- now",
    "It costs 5%, OK": "It costs 5 % , OK",
    "the dogs' tails": "the dogs ' tails",
    "all the boys'": "all the boys '",
    "He said 'yes' twice": "He said 'yes ' twice",
    "'yes'": "'yes '",
    "James' car isn't Jess's.": "James ' car is n't Jess 's .",
    "They left ('late').": "They left ( 'late ' ) .",
    "He said 'no.'": "He said 'no . '",
    "rock 'n' roll": "rock 'n ' roll",
    "the '90s o'clock": "the '90s o'clock",
    "": "",
}


@pytest.mark.parametrize("text", list(GOLDEN))
def test_tokens(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(treebank_tokenise("t").alias("w")).first().w
    assert " ".join(got) == GOLDEN[text]


@pytest.mark.parametrize("text", ["I cannot go.", "We're gonna win, aren't we?", "I wanna and I gotta.",
                                  "Mr. Smith met Dr. Jones.", "I'd've said so", "Lemme see; gimme that!",
                                  "the dogs' tails", "all the boys'", "He said 'yes' twice", "James' car isn't Jess's.",
                                  "the '90s o'clock"])
def test_round_trip(spark, text):
    df = spark.createDataFrame([(GOLDEN[text],)], "t string")
    assert df.select(treebank_detokenise("t").alias("w")).first().w == text

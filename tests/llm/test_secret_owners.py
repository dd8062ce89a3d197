"""Redaction goes by the owners of a value over all rows."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hidden(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    got = corpus_pipeline.hide_secrets(spark, docs, "")
    assert got.columns == docs.columns
    return {r.doc_id: r for r in got.collect()}


def test_live_tokens_go_and_copied_examples_stay(spark):
    free, copied, other = "Zx9" * 9, "Examp1e" * 4, "token='" + "Abc123" * 5 + "'"
    got = hidden(spark, [(1, f"é plain {free}, words", "a"), (2, f"{copied} api_key={copied}", "a"), (3, copied, "b"), (4, copied, "c"), (5, other, "a"), (6, other, "b"), (None, f"x {free}y", "a"), (8, None, "a"), (9, "", None)])
    assert got[1].text == "é plain [SECRET], words" and got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4)] == [f"{copied} api_key={copied}", copied, copied] and got[3].n_chars == len(copied)
    # Two owners are neither live nor copied: the base match is hidden.
    assert got[5].text == got[6].text == "token='[SECRET]'"
    assert got[None].text == "x [SECRET]"
    assert got[8].text is None and got[8].n_chars is None and got[9].text == ""


def test_several_secrets_in_a_text(spark):
    key, example = "AKIA" + "A1B2" * 4, "0123456789abcdef"
    live = f"ghp_Xy{example}QQ"
    got = hidden(spark, [(1, f"\u0001{key}\u0002 password: {'e' * 20}; {'f0' * 9}", "a"), (2, example, "a"), (3, example, "b"), (4, example, "c"), (5, f"use {live}!", "d")])
    assert got[1].text == "\u0001[SECRET]\u0002 password: [SECRET]; [SECRET]"
    assert got[2].text == example
    # A live token that holds a copied example goes as a whole.
    assert got[5].text == "use [SECRET]!"

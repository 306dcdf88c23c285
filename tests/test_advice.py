"""Cases of the review: each failed before its finding was settled."""

from tessella.operators import annotate


def test_passive_subject_keeps_all_data():
    got = {e[2] for e in annotate.tag_sentence("Your name, email address, phone number, postal address and browser history are collected by us.")}
    assert got == {"name", "email address", "phone number", "postal address", "browser history"}
    assert {e[2] for e in annotate.tag_sentence("We keep your name; your email address is collected by us.") if e[5] == "collect"} == {"email address"}

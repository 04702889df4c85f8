import time

import pytest

from spanloom.llm import spoken as s

FILE = """﻿1
00:00:01,000 --> 00:00:02,000
<i>HEÉLA: The dög</i>
(door creaks)

00:00:03,000 --> 00:00:04,000
Subtitles by Somebody & Co

3
00:00:05,000 --> 00:00:06,000
{\\an8}- remem-
bers, [SIGHS] it's ♪ music ♪ hot...

7
00:00:07,000 --> 00:00:08,000
Visit us at some-place.example/join

WEBVTT
00:09.000 --> 00:10.000
*coughs*
wait...and see 12 an-

00:11.000 --> 00:12.000
other
"""


def test_what_is_spoken():
    assert s.tokens(FILE) == ["The", "dög", "remembers,", "it's", "hot...", "wait...and", "see", "12", "another"]
    assert s.forms(FILE)[0] == s.fine["the"] and s.fine["12"] == ""
    for text in (None, "", "  \n\r\n", "1\n00:00:01,000 --> 00:00:02,000\n[LAUGHTER]\n"):
        assert s.tokens(text) == []


def cue(*lines):
    return "1\n00:00:01,000 --> 00:00:02,000\n" + "\n".join(lines) + "\n\n2\n00:00:03,000 --> 00:00:04,000\nnext\n"


def test_speech_that_looks_like_something_else_is_kept():
    for lines, spoken in [
        (["He left the house.Then he ran away"], "He left the house. Then he ran away next"),
        (["write to bob @ noon today"], "write to bob @ noon today next"),
        (["two * three * four words"], "two * three * four words next"),
        (["[door", "slams] Come in"], "Come in next"),
        (["(a long", "way off) ♪ sings", "and hums ♪ Listen"], "Listen next"),
        (["Watch the sky for free"], "Watch the sky for free next"),
        (["He said", "mornings.then left it all"], "He said mornings.then left it all next"),
        (["JOHN: I know", "- MARY: So do I"], "I know So do I next"),
        (["*door slams*", "Come *now*"], "Come next"),
        (["Subtitles by the window make it hard to see anything that goes on"], "Subtitles by the window make it hard to see anything that goes on next"),
    ]:
        assert s.tokens(cue(*lines)) == spoken.split(), lines


def test_doubtful_parts_are_read_both_ways():
    for lines, certain, doubtful in [
        (["Subtitles by the window"], "next", ["Subtitles by the window next"]),
        (["Write to me at bob@home.net soon"], "next", ["Write to me at soon next"]),
        (["Get more at www.some.example"], "next", ["Get more at next"]),
        (["Remember: we must leave now"], "we must leave now next", ["Remember we must leave now next"]),
        (["STOP: WE MUST GO"], "WE MUST GO next", ["STOP WE MUST GO next"]),
        (["? so they say ?", "Ann: yes"], "yes next", ["so they say yes next", "so they say Ann yes next", "Ann yes next", "so they say Ann yes next"]),
    ]:
        words, parts = s.read(cue(*lines))
        assert [w for w, p in zip(words, parts) if not p] == s.tokens(cue(*lines)) == certain.split(), lines
        assert [" ".join(x) for x in s.stretches(words, parts, 11)] == doubtful, lines
    assert list(s.stretches(["a", "b", "c", "d"], [0, 0, 1, 0], 1)) == [["b", "c", "d"]]


def test_very_long_text():
    text = "1\n00:00:01,000 --> 00:00:02,000\n" + "word " * 300_000 + "\n" + "x" * 100_000
    assert len(s.tokens(text)) == 300_001


@pytest.mark.parametrize("unit", ["a.b", "a.", "x", "<", "(", "[a", "*a", "♪", "@a.b", "a@", "://", "www.", "?", "a b.c ", ". ", "-", "a:", "#", "É.É"])
def test_endless_words_cost_no_more_than_their_length(unit):
    began = time.perf_counter()
    s.tokens(cue(unit * 60_000 + ".a" + unit * 60_000))
    assert time.perf_counter() - began < 10


def test_damage_does_not_change_a_word():
    for clean, damaged in [
        ("little", "Iittle"), ("little", "l1ttle"), ("modern", "rnodern"), ("modern", "modem"), ("cold", "colcl"), ("window", "vvindow"), ("sun", "5iin"), ("him", "liim"), ("political", "pohtical"),
        ("the", "thc"), ("that", "fhat"), ("too", "T0O"), ("biology", "bio1o9y"), ("la", "|a"), ("brun", "8run"), ("a", "o"), ("don't", "DONT,"), ("vis-à-vis", "visavis"),
        ("frère", "frere"), ("frère", "fr�re"), ("frère", "fr?re"), ("Straße", "STRASSE"), ("Straße", "Stra�e"), ("español", "espa?ol"), ("école", "?cole"), ("garçon", "garcon"),
    ]:
        a, b = s.fine[clean], s.fine[damaged]
        assert s.alike(a, b) and s.alike(b, a), (clean, damaged, a, b)
        assert s.skeleton(a) == s.skeleton(b), (clean, damaged)
    assert not s.alike(s.fine["dog"], s.fine["cat"]) and not s.alike(s.fine["frère"], s.fine["fr?res"])


def test_wrong_encodings_are_undone():
    line = "1\n00:00:01,000 --> 00:00:02,000\n♪ pluie ♪ le déjeuner, à côté Élan"
    once = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in line.encode())
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in once.encode())
    dos = line.replace("♪", "").encode("latin-1").decode("cp437")
    words = ["le", "déjeuner,", "à", "côté", "Élan"]
    assert s.tokens(line) == words and s.tokens(once) == words and s.tokens(twice) == words
    assert s.tokens(dos)[-5:] == words


def test_memo_is_bounded():
    memo = s.Memo(len)
    for i in range(s._MEMO_LIMIT + 10):
        memo[str(i)]
    assert len(memo) <= s._MEMO_LIMIT
